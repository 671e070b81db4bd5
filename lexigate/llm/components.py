"""Connected components of an edge table by alternating large-star and small-star
rounds (each a few joins and aggregates); every round is written to the shared
folder, so nothing is recomputed and no chain of plans builds up. A node with very
many edges is aggregated map-side and its join can be split by the runtime.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigate.llm.common import stored

MAX_ROUNDS = 60  # far beyond log2(n)^2 for any table seen; more rounds mean a fault


def _round(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with u > v: link each node's larger neighbours to its minimum,
    then each node and its smaller neighbours to theirs."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = (both.join(least, "u").filter(F.col("v") > F.col("u"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    lower = large.groupBy("u").agg(F.min("v").alias("m"))
    small = (large.join(lower, "u").filter(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node of an edge but the smallest of its component, with that
    smallest node. Direction, repeats and loops in ``edges`` do not matter."""
    current = stored(edges.filter(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _signature(current)
    if before[0] == 0:
        return current
    for _ in range(MAX_ROUNDS):
        current = stored(_round(current), "edges")
        now = _signature(current)
        if now == before:
            return current
        before = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
