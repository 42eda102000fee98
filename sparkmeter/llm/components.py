"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Node and smallest node reachable, for each node of ``edges``.

    Returns columns ``node`` and ``component``. Loops and repeated edges are ignored; edges with a null
    end too. Every round is a pair of aggregations with map-side combine and joins that AQE may split,
    so a hub with very many neighbours is never gathered in one task. Rounds end when the edge set stays
    as it is; their number grows with the logarithm of the longest path. Nothing but a count and a
    checksum comes to the driver.
    """
    now = saved(
        edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("b", "a"))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = saved(small.union(lowest.select("a", F.col("m").alias("b"))).distinct())
        found = _mark(after)
        discard(now)
        now = after
        if found == mark:
            break
        mark = found
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)
