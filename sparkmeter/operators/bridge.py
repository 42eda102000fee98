"""State of the bridge as batch operators: generations, coverage by transcripts, identities, versions, session starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .segments import running

COUNTERS = ["input", "output", "cache_read", "cache_write"]


def generation_max(rows: DataFrame, scope: list[str], generation: str, flag: str | None = None) -> DataFrame:
    """One row for each generation: the highest value of every counter, and of the flag."""
    more = [F.max(flag).alias(flag)] if flag else []
    return rows.groupBy(*scope, generation).agg(*[F.max(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in COUNTERS], *more)


def netted(row_input: Column, read: Column, written: Column) -> Column:
    """Input without its cached tokens, where they fit."""
    fits = (row_input > 0) & (read + written > 0) & (row_input >= read + written)
    return F.when(fits, row_input - read - written).otherwise(row_input)


def combined_usage(transcripts: DataFrame, generations: DataFrame, covered: DataFrame, scope: list[str], turn: str, net: str) -> DataFrame:
    """Transcript totals and the generations of turns that no transcript covers; rows flagged by ``net`` are netted after their maximum."""
    left = generations.join(covered.select(*scope, turn).distinct(), [*scope, turn], "left_anti")
    input_ = F.when(F.col(net), netted(F.col("input"), F.col("cache_read"), F.col("cache_write"))).otherwise(F.col("input"))
    both = transcripts.select(*scope, *COUNTERS).unionByName(left.withColumn("input", input_).select(*scope, *COUNTERS))
    return both.groupBy(*scope).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTERS])


def distinct_warnings(rows: DataFrame, scope: list[str], warning: str, order: str) -> DataFrame:
    """Each warning once, numbered by its first appearance."""
    first = rows.groupBy(*scope, warning).agg(F.min(order).alias(order))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*scope).orderBy(order)).cast("long")).drop(order)


def identity(rows: DataFrame, scope: list[str], order: str) -> DataFrame:
    """First model and folder, first and last time of a session, empty ones passed over."""

    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.length(name) > 0, F.col(order)))

    last = F.max_by("ts", F.when(F.length("ts") > 0, F.col(order)))
    return rows.groupBy(*scope).agg(first("model").alias("model"), first("cwd").alias("cwd"), first("ts").alias("started"), last.alias("updated"))


def session_start(rows: DataFrame, scope: list[str], at: str) -> DataFrame:
    """The earliest start that ever arrived; empty ones do not count."""
    return rows.groupBy(*scope).agg(F.min(F.nullif(F.col(at), F.lit(""))).alias("started"))


def not_stale(rows: DataFrame, scope: list[str], arrival: list[str], version: list[str]) -> DataFrame:
    """Snapshots that were newer than, or the same as, the newest one that had arrived before them."""
    seen = F.max(F.struct(*version)).over(running(scope, arrival))
    return rows.withColumn("_fresh", F.struct(*version) == seen).where("_fresh").drop("_fresh")


def guarded_totals(rows: DataFrame, scope: list[str], arrival: list[str], covered: str, totals: list[str]) -> DataFrame:
    """Transcript totals that hold after all arrivals: one that covers fewer turns than an earlier one is refused, of equal ones the last counts; with a revision that counts changes."""
    kept = not_stale(rows, scope, arrival, [covered])
    window = Window.partitionBy(*scope).orderBy(*arrival)
    before = F.lag(F.struct(covered, *totals)).over(window)
    changed = kept.withColumn("_new", F.when(before.isNull() | (F.struct(covered, *totals) != before), 1).otherwise(0))
    last = F.max_by(F.struct(covered, *totals), F.struct(*arrival)).alias("held")
    return changed.groupBy(*scope).agg(last, F.sum("_new").cast("long").alias("revision")).select(*scope, "held.*", "revision")


def outbox_order(rows: DataFrame, target: str, limit: int) -> DataFrame:
    """The next entries of a target to send: oldest first, then by source."""
    return rows.where(F.col("target") == target).orderBy("created_at", "source_id").limit(limit)


def turn_segments(usage: DataFrame, segments: DataFrame, scope: list[str], turn: str, running_segment: str, segment: str) -> DataFrame:
    """Usage with the segment that its turn id opened, else the one that was running."""
    named = segments.where(F.col(turn).isNotNull()).groupBy(*scope, turn).agg(F.max(segment).alias("_named"))
    found = usage.join(named, [*scope, turn], "left")
    return found.withColumn(segment, F.coalesce("_named", running_segment)).drop("_named")
