"""Connected components by alternating star contraction.

Large-star links each node's larger neighbours to its smallest one; small-star links each
node's smaller neighbours, and itself, to the smallest. Repeated, all nodes of a component end
as leaves of its smallest node, in rounds that grow with the logarithm of the size. Every
round is written to the shared folder, so lineage stays short; minima are pre-aggregated, and
joins on a hub's key meet two plain exchanges, which Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm._shared import discard, settle

MOST_ROUNDS = 60


def _to_least(pairs: DataFrame, name: str) -> DataFrame:
    """pairs(u, v): each v, and u, linked to the least of u's."""
    least = settle(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
    return least


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.x, row.s


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) of every node that has a link to another."""
    spark = links.sparkSession
    edges = settle(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(),
        "links",
    )
    before = None
    for _ in range(MOST_ROUNDS):
        now = _fingerprint(edges)
        if now == before or now[0] == 0:
            break
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _to_least(both, "large")
        large = settle(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        down = _to_least(large, "small")
        small = settle(
            large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).distinct(),
            "small",
        )
        for gone in (edges, least, large, down):
            discard(gone)
        edges = small
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
