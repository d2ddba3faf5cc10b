"""Whitening of embeddings: leading eigenvectors of their covariance by block subspace iteration.

Entries become whole numbers, ``floor(SCALE * c)``. The fit list holds each distinct vector of
these once, so copies, however many, count as one; its mean and covariance (divisor n) are what
is whitened. The covariance matrix is never formed: a pass over the fit list computes Xᵀ(XQ) on
centred rows for a block Q of ``BLOCK`` columns, partial sums adding up by matrix row in a
shuffle. The driver sees d x BLOCK numbers a pass and keeps a basis of at most ``MOST_BASIS``
columns with their products: the block is made orthogonal to the basis (QR, twice), Rayleigh-Ritz
on the whole basis gives the best vectors so far, and their residuals, which are both the next
block and the certificate, follow without a pass of their own. When the basis is full, its best
vectors begin a new one. A last pass over the fit list with the result alone certifies it: its
residuals and how far the whitened vectors' covariance is from the identity are measured there.

Sums of whole numbers are exact. The one shuffle of vectors makes the fit list and combines
copies before it. Rows are whitened where they are read.

Defined results: rows with a null vector, one with null or non-finite entries, or one of another
length than the commonest (of equally common ones the shortest) are dropped, rows with a null id
are whitened as others are, repeated rows get a result each; entries beyond ``MOST_ENTRY`` in
size count as that; components whose eigenvalue is 0 but for rounding are left out, so vectors
that are all alike have no result; eigenvectors have their largest entry (the first of those
within rounding of it) positive; equal eigenvalues leave the choice among their vectors open; a
deviation beyond 64 bits is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm._shared import discard, only, settle

SCALE = 256
MOST_ENTRY = 1 << 37
BLOCK = 16
MOST_BASIS = 256
MOST_PASSES = 500
#: Residuals over the largest eigenvalue: those aimed at, and those that still certify where rounding allows no less.
TOLERANCE, CERTIFIED = 2e-15, 1e-11
ZERO = 1e-13


@dataclass
class Fit:
    """n vectors with sums S: their mean and trace, and components (columns) with eigenvalues."""

    n: int
    sums: list[int]
    mean: np.ndarray
    trace: float
    vectors: np.ndarray
    values: np.ndarray
    residual: float
    identity_error: float
    passes: int


def usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))


def whole(vector: Column) -> Column:
    most = F.lit(float(MOST_ENTRY))
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * F.greatest(-most, F.least(most, c.cast("double")))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            for x in np.array_split(_matrix(batch.column("x")), -(-batch.num_rows // 8192)):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1], dtype=np.int32)), pa.array(x.sum(axis=0)), pa.array(np.full(x.shape[1], len(x)))], names=["i", "s", "n"])


def _products(mean: np.ndarray, q: np.ndarray):
    """A task's share of Xᵀ(XQ) on centred rows, a row for each of the matrix, and of its squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(q.shape), np.zeros(len(q))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x")) - mean
                total += x.T @ (x @ q)
                squares += (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(q), dtype=np.int32)), pa.array(squares), *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(q.shape[1])]],
            names=["i", "squares", *[f"v{j}" for j in range(q.shape[1])]],
        )

    return run


def _times(rows: DataFrame, n: int, mean: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """One pass: the covariance times q, and the covariance's trace."""
    names = ["squares", *[f"v{j}" for j in range(q.shape[1])]]
    parts = rows.mapInArrow(_products(mean, q), "i int, " + ", ".join(f"{c} double" for c in names))
    # d rows of a block's width, whatever the input's size.
    got = np.array([tuple(r) for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).orderBy("i").collect()])
    return got[:, 2:] / n, float(got[:, 1].sum()) / n


def _orthogonal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The block's part that the basis lacks, with orthonormal columns; directions lost in rounding go."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        left, kept, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, kept > 1e-8]
    return np.linalg.qr(block - basis @ (basis.T @ block))[0] if block.shape[1] else block


def _ritz(basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, vectors, and these times the covariance."""
    h = basis.T @ product
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], basis @ turn, product @ turn


def _signed(vectors: np.ndarray) -> np.ndarray:
    size = np.abs(vectors)
    top = np.argmax(size >= size.max(axis=0) * (1 - 1e-9), axis=0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def subspace(rows: DataFrame, n: int, mean: np.ndarray, k: int, block: int = BLOCK, most_basis: int = MOST_BASIS) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The k leading eigenvectors and values, the trace and the passes it took.

    rows: x array<bigint>, the fit list.
    """
    d = len(mean)
    k, width = min(k, d), min(d, max(block, 2 * k))
    basis, product = np.zeros((d, 0)), np.zeros((d, 0))
    new = np.linalg.qr(np.random.default_rng(11).standard_normal((d, width)))[0]
    before, trace = np.inf, 0.0
    for passes in range(1, MOST_PASSES + 1):
        made, trace = _times(rows, n, mean, new)
        basis, product = np.hstack([basis, new]), np.hstack([product, made])
        values, vectors, moved = _ritz(basis, product)
        rest = moved - vectors * values
        left = float(np.linalg.norm(rest[:, :k], axis=0).max()) / max(values[0], 1e-300)
        if basis.shape[1] >= d or left <= TOLERANCE or (left <= CERTIFIED and left > before / 2):
            break
        before = left
        if basis.shape[1] + width > max(most_basis, 3 * width):
            basis, product = vectors[:, : 2 * width], moved[:, : 2 * width]
        new = _orthogonal(rest[:, :width], basis)
        if not new.shape[1]:  # what the basis spans is mapped into itself
            break
    else:
        raise RuntimeError(f"no components of residuals under {CERTIFIED} in {MOST_PASSES} passes")
    return vectors[:, :k], values[:k], trace, passes


def fit(rows: DataFrame, k: int, dim: int) -> Fit | None:
    """rows: x array<bigint>, each distinct vector once."""
    sums = rows.mapInArrow(_sums, "i int, s long, n long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    if not sums:
        return None
    n, total = sums[0].n, [int(r.s) for r in sums]
    mean = np.array([s / n for s in total])
    vectors, values, trace, passes = subspace(rows, n, mean, k)
    above = values > ZERO * max(trace, 1e-300) * dim
    vectors, values = _signed(vectors[:, above]), values[above]
    if not len(values):
        return Fit(n, total, mean, trace, vectors, values, 0.0, 0.0, passes)
    # The result alone, once more over all rows.
    moved, trace = _times(rows, n, mean, vectors)
    values = np.einsum("dk,dk->k", vectors, moved)
    residual = float(np.linalg.norm(moved - vectors * values, axis=0).max() / values[0])
    if residual > CERTIFIED:
        raise RuntimeError(f"the components' residual is {residual}")
    covariance = vectors.T @ moved / np.sqrt(np.outer(values, values))
    return Fit(n, total, mean, trace, vectors, values, residual, float(np.abs(covariance - np.eye(len(values))).max()), passes + 1)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The exact sum of (n x - S)^2 over dimensions; null beyond 64 bits."""
    most = max(n * int(np.abs(x).max(initial=0)), n) + max((abs(s) for s in sums), default=0)
    if len(sums) * most * most < 1 << 63:
        off = n * x - np.array(sums, dtype=np.int64)
        return pa.array((off * off).sum(axis=1))
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def _whitened(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Fit = shared.value
        k = len(f.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            row = pa.array(np.repeat(np.arange(len(x)), k))
            component = np.tile(np.arange(k), len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(row),
                    pa.array((component + 1).astype(np.int32)),
                    _deviations(x, f.n, f.sums).take(row),
                    pa.array((((x - f.mean) @ f.vectors) / np.sqrt(f.values)).reshape(-1)),
                    pa.array((f.values / f.trace)[component]),
                ],
                names=["vec_id", "component", "deviation", "whitened", "explained"],
            )

    return run


def whiten(table: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, residual of each row and component."""
    spark = table.sparkSession
    named = only(table, vec_id=id_col, vector=vector_col)
    kind = dict(named.dtypes)["vec_id"]
    rows = named.where(usable(F.col("vector"))).select("vec_id", whole(F.col("vector")).alias("x"))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = f"vec_id {kind}, component int, deviation long, whitened double, explained double"
    if length is None:
        fitted = None
    else:
        rows = rows.where(F.size("x") == length.d)
        distinct = settle(rows.select("x").distinct(), "fit-list")
        fitted = fit(distinct, k, length.d)
        discard(distinct)
    if fitted is None or not len(fitted.values):
        out = spark.createDataFrame([], schema)
        n = error = residual = 0
    else:
        # d x k numbers.
        out = rows.mapInArrow(_whitened(spark.sparkContext.broadcast(fitted)), schema)
        n, error, residual = fitted.n, fitted.identity_error, fitted.residual
    constants = [F.lit(n).cast("long").alias("n"), F.lit(float(error)).alias("identity_error"), F.lit(float(residual)).alias("residual")]
    return out.select("vec_id", "component", constants[0], "deviation", "whitened", "explained", *constants[1:])
