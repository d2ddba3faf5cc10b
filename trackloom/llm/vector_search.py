"""Approximate nearest neighbours: an inverted file of coarse centroids, product-quantised
residuals, asymmetric distance tables, and exact reranking.

Centroids and codebooks are fitted on a bounded sample (``SAMPLE`` rows at most, those with the
smallest id hashes); every row is then assigned and coded. A query looks into the lists whose
centroids have the largest inner product with it, and into further ones until these hold
``k`` other rows, ranks their rows by table look-ups, and reranks by the exact inner product in
double precision the best ``RERANK`` of each block and all others that may be among the ``k``
best: an estimate is wrong by no more than the query's length times what the codes leave of a
row. So nothing in a probed list is missed. How many lists are probed is measured: the true
neighbours of ``ASKED`` of the queries are found among all rows, in one pass over them, and
``TARGET`` of these must lie in probed lists.

Lists are binned to about ``BLOCK_ROWS`` rows a task; one that is larger is cut in blocks of
rows, and a bin's queries in blocks of ``BLOCK_QUERIES``, so a list that holds a third of all
rows becomes many equal tasks. A block of queries is at least as large as a block of rows, so
rows are sent no more often than queries are. What a block returns for a query is at most
``k`` rows. What is broadcast has a number for each list, of which there are ``LISTS_AT_MOST``
at most, besides centroids and codebooks.

Defined results: vectors that are null, empty, zero, of another length than the sample's most
common one, or hold null or non-finite components take no part, nor do rows with a null id;
ties go to the smaller id; rows that repeat an id are candidates each, but of those that repeat
a query's id one is asked, the one with the smallest vector; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.llm._shared import only, settle

SAMPLE = 65536
ROWS_A_LIST = 16  # of the sample, at least
LISTS_AT_MOST = SAMPLE // ROWS_A_LIST
TARGET = 0.97  # of true neighbours, in probed lists
ASKED = 256  # queries whose true neighbours are found to choose the number of probed lists
SUBSPACE = 4
CODES = 256
RERANK = 100
BLOCK_ROWS = 4096
BLOCK_QUERIES = 4096


@dataclass
class Index:
    centroids: np.ndarray  # lists x dim
    codebooks: np.ndarray  # subspaces x codes x width
    dim: int
    padded: int

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.padded - self.dim)))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's list and the codes of its residual."""
        at = nearest(x, self.centroids)
        r = self.pad(x - self.centroids[at])
        m = len(self.codebooks)
        parts = r.reshape(len(x), m, -1)
        return at, np.stack([nearest(parts[:, j], self.codebooks[j]) for j in range(m)], axis=1).astype(np.uint8)

    def lost(self, x: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The length of what a row's list and codes leave of it."""
        r = self.pad(x - self.centroids[at]).reshape(len(x), len(self.codebooks), -1)
        return np.sqrt(sum(((r[:, j] - self.codebooks[j][codes[:, j]]) ** 2).sum(axis=1) for j in range(len(self.codebooks))))

    def ranked(self, q: np.ndarray) -> np.ndarray:
        """All lists by their inner product with each query's vector, the largest first."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")

    def probes(self, q: np.ndarray, n: int, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """Each query's first n lists, and as many more as it takes to hold ``least`` rows."""
        ranked = self.ranked(q)
        held = np.cumsum(sizes[ranked], axis=1)
        enough = np.argmax(held >= np.minimum(least, held[:, -1:]), axis=1) + 1
        return [own[: max(n, m)] for own, m in zip(ranked, enough.tolist(), strict=True)]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query, inner products with all codes: queries x subspaces x codes."""
        parts = self.pad(q).reshape(len(q), len(self.codebooks), -1)
        return np.einsum("qmw,mcw->qmc", parts, self.codebooks, optimize=True)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T), axis=1)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
        if (empty := np.flatnonzero(~full)).size:
            centres[empty] = x[rng.choice(len(x), size=len(empty))]
    return centres


def lists_for(rows: int) -> int:
    """About the root of the rows, twice over: so a list has some rows at every size, and a query's share of them falls as rows grow."""
    return int(np.clip(2 ** round(np.log2(2 * max(1.0, rows) ** 0.5)), 1, LISTS_AT_MOST))


def fit(sample: np.ndarray, rows: int) -> Index:
    """rows: of the whole table; lists grow with its square root."""
    x = np.unique(sample, axis=0).astype(np.float64)
    centres = k_means(x, min(lists_for(rows), max(1, len(x) // 8)), 10, 1)
    dim = x.shape[1]
    padded = -(-dim // SUBSPACE) * SUBSPACE
    r = np.pad(x - centres[nearest(x, centres)], ((0, 0), (0, padded - dim))).reshape(len(x), padded // SUBSPACE, SUBSPACE)
    books = np.stack([np.pad(b, ((0, CODES - len(b)), (0, 0)), mode="edge") for b in (k_means(r[:, j], CODES, 8, 2 + j) for j in range(padded // SUBSPACE))])
    return Index(centres, books, dim, padded)


def valid(vector: Column) -> Column:
    """No nulls or non-finite components, and not zero."""
    bad = F.exists(vector, lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _code(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            if batch.num_rows:
                at, codes = index.assign(_vectors(batch.column("vector")).astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column("vec_id"), batch.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "vec_id", "vector", "codes"])

    return run


def _probe(shared, probes: int, bin_of: np.ndarray, sizes: np.ndarray, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at = index.probes(_vectors(batch.column("vector")).astype(np.float64), probes, sizes, least)
            bins, rows, lists = [], [], []
            for k, own in enumerate(at):
                home = bin_of[own]
                for b in np.unique(home[home >= 0]):
                    bins.append(b)
                    rows.append(k)
                    lists.append(own[home == b].astype("<i4").tobytes())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(bins, dtype=np.int32)), batch.column("vec_id").take(take), batch.column("vector").take(take), pa.array(lists, pa.binary())],
                names=["bin", "query_id", "vector", "lists"],
            )

    return run


def _search(shared, k: int, rerank: int):
    def run(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            index: Index = shared.value
            rows = rows.sort_values("vec_id", kind="stable")
            ids, home = rows["vec_id"].to_numpy(), rows["list"].to_numpy()
            x = np.vstack(rows["vector"].to_numpy()).astype(np.float64)
            codes = np.frombuffer(b"".join(rows["codes"]), dtype=np.uint8).reshape(len(rows), -1)
            q = np.vstack(queries["vector"].to_numpy()).astype(np.float64)
            own, lists = queries["query_id"].to_numpy(), queries["lists"].to_numpy()
            tables, coarse, cells = index.tables(q), q @ index.centroids.T, np.arange(codes.shape[1])[None, :]
            # What rounding may add to an estimate's error goes by the lengths of both vectors.
            long = np.sqrt((q**2).sum(axis=1))
            slack = index.lost(x, home, codes) + 1e-9 * (np.sqrt((x**2).sum(axis=1)) + np.sqrt((index.centroids**2).sum(axis=1))[home])
            member = np.zeros(len(index.centroids), dtype=bool)
            for j in range(len(q)):
                probed = np.frombuffer(lists[j], dtype="<i4")
                member[probed] = True
                near = np.flatnonzero(member[home] & (ids != own[j]))
                member[probed] = False
                if len(near) > max(rerank, k):
                    estimate = coarse[j][home[near]] + tables[j][cells, codes[near]].sum(axis=1)
                    error = long[j] * slack[near]
                    # All rows that tie with the last one are reranked too, so ties are decided by ids alone.
                    bar = min(np.partition(estimate, len(near) - rerank)[len(near) - rerank], np.partition(estimate - error, len(near) - k)[len(near) - k])
                    near = near[(estimate >= bar) | (estimate + error >= bar)]
                exact = (x[near] * q[j]).sum(axis=1)
                best = np.lexsort((ids[near], -exact))[:k]
                out["query_id"].append(np.full(len(best), own[j]))
                out["vec_id"].append(ids[near[best]])
                out["score"].append(exact[best])
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})

    return run


def _true_neighbours(asked, k: int):
    """Each asked query's k nearest of a task's rows, with their lists: exact, and as many at any number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = asked.value
        scores, lists = np.full((len(q), 0), 0.0), np.full((len(q), 0), 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, at = batch.column("vec_id").to_numpy(), batch.column("list").to_numpy().astype(np.int64)
            now = q @ _vectors(batch.column("vector")).astype(np.float64).T
            now[own[:, None] == ids[None, :]] = -np.inf
            scores, lists = np.concatenate([scores, now], axis=1), np.concatenate([lists, np.broadcast_to(at, now.shape)], axis=1)
            if scores.shape[1] > k:
                keep = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                scores, lists = np.take_along_axis(scores, keep, axis=1), np.take_along_axis(lists, keep, axis=1)
        who = np.repeat(np.arange(len(q)), scores.shape[1])
        found = scores.reshape(-1) > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(who[found].astype(np.int32)), pa.array(lists.reshape(-1)[found].astype(np.int32)), pa.array(scores.reshape(-1)[found])], names=["query", "list", "score"])

    return run


def calibrate(index: Index, coded: DataFrame, own: DataFrame, k: int, target: float) -> int:
    """Lists to probe so that, for the queries, so large a share of their true neighbours among all rows is in probed lists."""
    picked = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ASKED).select("vec_id", "vector").collect()
    if not picked:
        return 1
    ids, q = np.array([r.vec_id for r in picked]), np.array([r.vector for r in picked], dtype=np.float64)
    asked = coded.sparkSession.sparkContext.broadcast((ids, q))
    near = coded.select("list", "vec_id", "vector").mapInArrow(_true_neighbours(asked, k), "query int, list int, score double")
    best = near.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "list"))).where(F.col("n") <= k).select("query", "list").collect()
    place = np.argsort(index.ranked(q), axis=1)
    need = np.sort([place[r.query, r.list] for r in best]) + 1
    return int(need[min(len(need) - 1, int(np.ceil(target * len(need))))]) if len(need) else 1


def bins_of(sizes: dict[int, int], lists: int) -> tuple[np.ndarray, list[int]]:
    """Neighbouring lists in bins of about BLOCK_ROWS rows: each list's bin (-1: no rows) and each bin's rows."""
    out, rows = np.full(lists, -1), []
    for k in range(lists):
        if n := sizes.get(k, 0):
            if not rows or rows[-1] + n > BLOCK_ROWS:
                rows.append(0)
            rows[-1] += n
            out[k] = len(rows) - 1
    return out, rows


def search(table: DataFrame, is_query: Column, k: int = 20, probes: int | None = None, rerank: int = RERANK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows found nearest to each query row, not itself.

    ``is_query`` is a condition on ``vec_id``. Without ``probes`` their number is calibrated on
    queries and all rows.
    """
    spark = table.sparkSession
    rows = only(table, vec_id=id_col, vector=vector_col).where(F.col("vec_id").isNotNull() & valid(F.col("vector"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    n = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return spark.createDataFrame([], schema)
    most = min(SAMPLE, max(SAMPLE // 4, ROWS_A_LIST * lists_for(n)))
    share = min(1.0, 1.3 * most / n + 0.001)
    picked = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("vector").collect()
    lengths = pd.Series([len(r.vector) for r in picked])
    dim = int(lengths.value_counts().sort_index().idxmax())
    sampled = np.array([r.vector for r in picked if len(r.vector) == dim])
    index = fit(sampled, n)
    shared = spark.sparkContext.broadcast(index)

    rows = rows.where(F.size("vector") == dim)
    coded = settle(rows.mapInArrow(_code(shared), "list int, vec_id long, vector array<double>, codes binary"), "coded")
    # One number for each list: LISTS_AT_MOST rows, and no more in what is broadcast below.
    sizes = {r.list: r["count"] for r in coded.groupBy("list").count().collect()}
    bin_of, bin_rows = bins_of(sizes, len(index.centroids))
    own = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.count("*").alias("c"))
    probes = probes or calibrate(index, coded, own, k, TARGET)
    held = np.array([sizes.get(i, 0) for i in range(len(index.centroids))])
    least = k + int(own.agg(F.max("c")).first()[0] or 0)
    asked = settle(own.mapInArrow(_probe(shared, probes, bin_of, held, least), "bin int, query_id long, vector array<double>, lists binary"), "probes")
    asked_of = {r.bin: r["count"] for r in asked.groupBy("bin").count().collect()}
    blocks = [(b, -(-n // BLOCK_ROWS), max(1, -(-asked_of.get(b, 0) // BLOCK_QUERIES))) for b, n in enumerate(bin_rows)]
    grid = F.broadcast(spark.createDataFrame(blocks, "bin int, row_blocks int, query_blocks int"))
    home = F.broadcast(spark.createDataFrame([(i, int(b)) for i, b in enumerate(bin_of)], "list int, bin int"))
    left = coded.join(home, "list").join(grid, "bin").select(
        "bin", F.pmod(F.xxhash64("vec_id"), F.col("row_blocks")).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"), "list", "vec_id", "vector", "codes"
    )
    right = asked.join(grid, "bin").select(
        "bin", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("rb"), F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int").alias("qb"), "query_id", "vector", "lists"
    )
    found = left.groupBy("bin", "rb", "qb").cogroup(right.groupBy("bin", "rb", "qb")).applyInPandas(_search(shared, k, rerank), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
