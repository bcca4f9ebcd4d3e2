"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): each node of an edge (u, v) and the smallest node that it reaches.

    Every round links neighbours to the smallest of their neighbourhood; minima are aggregated
    before they are joined, so that no task gathers the neighbours of one node. A stored table a
    round cuts the lineage. Ends when a round changes nothing.
    """
    now = stored(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _fingerprint(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-star")
        now = stored(both.join(small(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = stored(now.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        joined = now.join(small(least), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(joined.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _fingerprint(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
