"""Sessions that other sessions started: their requests count for the root of the family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import closure, last_started


def known_parents(parents: DataFrame, sessions: DataFrame) -> DataFrame:
    """Edges (session, parent) whose parent is in the corpus; a session whose parent is not stays a session of its own."""
    edges = parents.where(F.col("parent").isNotNull() & (F.col("parent") != F.col("session"))).distinct()
    return edges.join(sessions.select(F.col("session").alias("parent")).distinct(), "parent", "left_semi")


def joined(found: dict[str, DataFrame]) -> DataFrame:
    """Requests of an adapter's result with those of child sessions moved to the root session.

    A child's requests go to the root's last segment that had started when the child did, and carry the child's id
    as ``agent``. Children of a cycle have no root and stay where they are.
    """
    requests, segments = found["requests"], found["segments"]
    edges = known_parents(found["parents"], requests.select("session").union(segments.select("session")))
    roots = closure(edges, "session", "parent").where("root is not null").select(F.col("node").alias("child"), "root")
    starts = segments.groupBy(F.col("session").alias("child")).agg(F.min(F.nullif("start_ts", F.lit(""))).alias("child_ts"))
    children = roots.join(starts, "child", "left").select(F.col("root").alias("session"), "child", "child_ts")
    own = segments.groupBy("session", "seg_id").agg(F.min("start_ts").alias("start_ts"), F.min("label").alias("label"))
    placed = last_started(children, own, "session", "child_ts", "child", "start_ts", "seg_id")
    placed = placed.join(own.select("session", "seg_id", F.col("label").alias("root_label")), ["session", "seg_id"], "left")
    placed = placed.select("child", F.col("session").alias("root"), F.col("seg_id").alias("root_segment"), "root_label")
    rows = requests.join(placed, requests["session"] == placed["child"], "left")
    inside = F.col("child").isNotNull()
    return rows.withColumns({
        "agent": F.col("child"), "session": F.when(inside, F.col("root")).otherwise(F.col("session")),
        "segment": F.when(inside, F.col("root_segment")).otherwise(F.col("segment")), "label": F.when(inside, F.coalesce("root_label", "label")).otherwise(F.col("label")),
    }).drop("child", "root", "root_segment", "root_label")
