"""Joins of the log model: as-of, last started, closure, diff, replacement, idempotent publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable
from .segments import running


def asof(events: DataFrame, segments: DataFrame, scope: str, event_ts: str, event_id: str, segment_ts: str, segment_id: str) -> DataFrame:
    """For each event the segment with the latest start at or before it (ties: highest id), else the scope's last segment, else null.

    A union and one window over the scope: no pairs are made, whatever the number of segments.
    """
    left = segments.where(F.col(segment_ts).isNotNull()).select(scope, F.col(segment_ts).alias("_ts"), F.lit(0).alias("_side"), F.col(segment_id).alias("_seg"), F.lit(None).cast(events.schema[event_id].dataType).alias(event_id))
    right = events.select(scope, F.col(event_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(segments.schema[segment_id].dataType).alias("_seg"), event_id)
    both = left.union(right).withColumn("_found", F.last("_seg", ignorenulls=True).over(running([scope], ["_ts", "_side", "_seg"])))
    last = segments.groupBy(scope).agg(F.max(segment_id).alias("_last"))
    found = both.where("_side = 1").join(last, scope, "left")
    return found.select(scope, event_id, F.col("_ts").alias(event_ts), F.coalesce("_found", "_last").alias(segment_id))


def last_started(children: DataFrame, segments: DataFrame, scope: str, child_ts: str, child_id: str, segment_ts: str, segment_id: str) -> DataFrame:
    """For each child the highest segment id of its scope whose start is at or before the child's; null starts fit always."""
    left = segments.select(scope, F.coalesce(F.col(segment_ts), F.lit("0001-01-01").cast(segments.schema[segment_ts].dataType)).alias("_ts"), F.lit(0).alias("_side"), F.col(segment_id).alias("_seg"), F.lit(None).cast(children.schema[child_id].dataType).alias(child_id))
    right = children.select(scope, F.coalesce(F.col(child_ts), F.lit("9999-12-31").cast(children.schema[child_ts].dataType)).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(segments.schema[segment_id].dataType).alias("_seg"), child_id)
    window = Window.partitionBy(scope).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.union(right).withColumn("_found", F.max("_seg").over(window)).where("_side = 1")
    return both.select(scope, child_id, F.col("_found").alias(segment_id))


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Root of every child by pointer doubling: the number of joins grows with the logarithm of the depth.

    A node that is in a cycle, or hangs from one, has no root: its ``root`` is null. Only nodes whose way is still open take part in
    a round, so the many nodes below one root are never joined on it. A way that meets the same least node in two halves goes round
    a cycle and is closed at once. Rounds are written to the checkpoint folder.
    """
    named = edges.select(F.col(child).alias("node"), F.col(parent).alias("root"))
    inner = named.select(F.col("node").alias("_n")).distinct()
    now = named.join(inner, F.col("root") == F.col("_n"), "left")
    state = F.when(F.col("_n").isNull(), "root").otherwise("open")
    now = durable(now.select("node", "root", F.col("root").alias("_low"), state.alias("_state")))
    found, now = now.where("_state = 'root'"), now.where("_state = 'open'")
    ended = [found]  # each round's rows, by where they were written
    while not now.isEmpty():
        every = ended[0]
        for part in ended[1:]:
            every = every.unionByName(part)
        up = every.unionByName(now).select(F.col("node").alias("_n"), F.col("root").alias("_up"), F.col("_low").alias("_least"), F.col("_state").alias("_of"))
        met = now.join(up, F.col("root") == F.col("_n"))
        state = F.when(F.col("_of") != "open", F.col("_of")).when(F.col("_low") == F.col("_least"), "cycle").otherwise("open")
        after = durable(met.select("node", F.col("_up").alias("root"), F.least("_low", "_least").alias("_low"), state.alias("_state")))
        ended.append(after.where("_state <> 'open'"))
        now = after.where("_state = 'open'")
    every = ended[0]
    for part in ended[1:]:
        every = every.unionByName(part)
    return every.select("node", F.when(F.col("_state") == "root", F.col("root")).alias("root"))


def id_edges(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """Edges (parent, child) of rows that name their parent, where the parent is one of the rows."""
    edges = rows.where(F.col(parent).isNotNull()).select(F.col(parent).alias("parent"), F.col(node).alias("child"))
    return edges.join(rows.select(F.col(node).alias("parent")).distinct(), "parent", "left_semi").distinct()


def folder_edges(rows: DataFrame, node: str, folder: str) -> DataFrame:
    """Edges (parent, child) from the row that owns the nearest folder above a row's own: an equality join over the few folders above, no pairs."""
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    inside = rows.where(F.col(folder).isNotNull()).select(F.col(node).alias("child"), F.explode(above).alias("above"))
    owners = rows.where(F.col(folder).isNotNull()).select(F.col(node).alias("parent"), F.col(folder).alias("above"))
    met = inside.join(owners, "above").where("parent <> child")
    return met.groupBy("child").agg(F.max_by("parent", F.struct(F.length("above"), "parent")).alias("parent")).select("parent", "child")


def descendants(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Every (root, node) with node below root, and how deep; edges of any kind (parent, child), cycles are gone round once.

    ``WITH RECURSIVE`` of Spark has no ``UNION`` that drops what was met, so each round joins the last round's nodes only and leaves
    out known ones. Rounds are as many as the longest shortest way; they are written to the checkpoint folder.
    """
    edges = durable(edges.distinct())
    last = durable(roots.select("root").distinct().join(edges, F.col("root") == F.col("parent")).select("root", F.col("child").alias("node"), F.lit(1).cast("long").alias("depth")).dropDuplicates(["root", "node"]))
    found = last
    while not last.isEmpty():
        ahead = last.join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node"), (F.col("depth") + 1).alias("depth")).dropDuplicates(["root", "node"])
        last = durable(ahead.join(found.select("root", "node"), ["root", "node"], "left_anti"))
        found = found.unionByName(last)
    return found


def orphans(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose key no other table knows."""
    return rows.join(known.select(F.col(known_key).alias("_known")).distinct(), F.col(key) == F.col("_known"), "left_anti")


def covered(rows: DataFrame, turn: str, evidence: DataFrame, named: str, index: str) -> DataFrame:
    """Rows whose turn some evidence covers: the turn that it names if that is over zero, else the one at its index."""
    turns = evidence.select(F.when(F.col(named) > 0, F.col(named)).otherwise(F.col(index)).alias("_turn")).distinct()
    return rows.join(turns, F.col(turn) == F.col("_turn"), "left_semi")


def diff(old: DataFrame, new: DataFrame, key: str = "label") -> DataFrame:
    """Full outer comparison: a key that is absent counts 0, one that is there with unknown cost stays unknown."""
    a = old.select(key, F.col("cost").alias("old_cost"), F.lit(True).alias("in_old"))
    b = new.select(key, F.col("cost").alias("new_cost"), F.lit(True).alias("in_new"))
    both = a.join(b, key, "full_outer")
    before = F.when(F.col("in_old").isNull(), F.lit(0)).otherwise(F.col("old_cost"))
    after = F.when(F.col("in_new").isNull(), F.lit(0)).otherwise(F.col("new_cost"))
    rows = both.select(key, before.cast("long").alias("old_cost"), after.cast("long").alias("new_cost"), (after - before).cast("long").alias("delta"))
    order = Window.orderBy(F.abs(F.coalesce("delta", F.lit(0))).desc(), key)
    return rows.withColumn("rank", F.row_number().over(order).cast("long"))


def replace_window(table: DataFrame, fresh: DataFrame, at: str, start: Column, end: Column) -> DataFrame:
    """What the source now says replaces the rows of a time window; an empty answer erases nothing."""
    some = fresh.agg((F.count("*") > 0).alias("_some"))
    kept = table.join(F.broadcast(some)).where(~F.col("_some") | (F.col(at) < start) | (F.col(at) >= end) | F.col(at).isNull()).drop("_some")
    return kept.unionByName(fresh)


def match_results(calls: DataFrame, results: DataFrame, scope: list[str], name: str, order: str, ident: str | None = None) -> DataFrame:
    """Calls with the order of their result in ``result_ord``.

    A result answers the first call of its scope with its id; one without such a call the n-th call of its name that
    has no answer by id, n counting the results left over; one without any call becomes a call of its own.
    """
    keys = [*scope, name, order, *([ident] if ident else [])]
    calls, results = calls.withColumn("_row", F.lit(True)), results.select(*keys)
    by_id = None
    if ident:
        same = Window.partitionBy(*scope, ident).orderBy(order)
        first = calls.where(F.col(ident).isNotNull()).withColumn("_n", F.row_number().over(same)).where("_n = 1").select(*scope, ident, F.col(order).alias("_call"))
        paired = results.join(first, [*scope, ident], "left").select(*[F.col(c) for c in keys], "_call")
        by_id = paired.where("_call is not null").groupBy(*scope, "_call").agg(F.min(order).alias("_by_id"))
        results = paired.where("_call is null").drop("_call")
        calls = calls.join(by_id.withColumnRenamed("_call", order), [*scope, order], "left")
    else:
        calls = calls.withColumn("_by_id", F.lit(None).cast(results.schema[order].dataType))
    window = Window.partitionBy(*scope, name, "_open").orderBy(order)
    calls = calls.withColumn("_open", F.col("_by_id").isNull()).withColumn("_n", F.when(F.col("_open"), F.row_number().over(window)))
    late = results.withColumn("_n", F.row_number().over(Window.partitionBy(*scope, name).orderBy(order))).withColumnRenamed(order, "result_ord")
    late = late.drop(ident) if ident else late
    found = calls.join(late, [*scope, name, "_n"], "full_outer")
    return found.withColumn("synthetic", F.col("_row").isNull()).withColumn("result_ord", F.coalesce("_by_id", "result_ord")).drop("_n", "_row", "_open", "_by_id")


def ordered_merge(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Several logs as one in order of time, source and line."""
    merged = parts[0].withColumn("source_rank", F.lit(0))
    for rank, part in enumerate(parts[1:], 1):
        merged = merged.unionByName(part.withColumn("source_rank", F.lit(rank)))
    return merged


def latest_version(rows: DataFrame, key: list[str], version: list[str], values: list[str]) -> DataFrame:
    """The row of the highest version (compared field by field) of each key."""
    best = F.max(F.struct(*version, *values)).alias("best")
    return rows.groupBy(*key).agg(best).select(*key, *[F.col(f"best.{c}").alias(c) for c in [*version, *values]])


def publish_once(rows: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """Each content of a key once, by the hash of its JSON form (fields in order of their names, nulls told from empty): publishing again has no effect."""
    body = F.to_json(F.struct(*sorted(content)), {"ignoreNullFields": "false"})
    return rows.select(*key, F.sha2(body, 256).alias("content_hash")).distinct()
