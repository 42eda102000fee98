"""Ordered-sequence operators: sticky segments, first uses, counters that only grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def running(scope: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def sticky_segments(rows: DataFrame, scope: list[str], order: list[str], marker: Column, opener: Column) -> DataFrame:
    """Add ``seg_id``: a marker opens a segment that owns all rows up to the next one; an ``opener`` row opens one if none is open yet."""
    opens = F.coalesce(marker, F.lit(False))
    candidate = opens | F.coalesce(opener, F.lit(False))
    flagged = rows.withColumns({"_marks": opens, "_may": candidate})
    flagged = flagged.withColumn("_opens", (F.col("_marks") | (F.col("_may") & (F.sum(F.col("_may").cast("int")).over(running(scope, order)) == 1))).cast("int"))
    return flagged.withColumn("seg_id", F.sum("_opens").over(running(scope, order)).cast("long")).drop("_marks", "_may", "_opens")


def first_use(rows: DataFrame, scope: list[str], key: str, order: list[str]) -> DataFrame:
    """The first row of every key in a scope (a streamed duplicate must not open a segment again)."""
    window = Window.partitionBy(*scope, key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def prompt_backfill(rows: DataFrame, scope: list[str], text: str, order: str) -> DataFrame:
    """The first prompt that is not empty, for each segment."""
    filled = F.when(F.length(text) > 0, F.col(order))
    return rows.groupBy(*scope).agg(F.min_by(text, filled).alias("prompt"))


def sticky_value(rows: DataFrame, scope: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last known value up to each row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(running(scope, order)))


def deltas(rows: DataFrame, scope: list[str], order: list[str], counters: list[str]) -> DataFrame:
    """Increments of cumulative counters: any decrease is a reset, its interval is left out and the row is the new base; zero increments go."""
    window = Window.partitionBy(*scope).orderBy(*order)
    before = {c: F.lag(c).over(window) for c in counters}
    reset = F.lit(False)
    for c in counters:
        reset = reset | F.coalesce(F.col(c) < before[c], F.lit(False))
    marked = rows.withColumns({"reset": reset, **{f"d_{c}": F.col(c) - F.coalesce(before[c], F.lit(0)) for c in counters}})
    moved = F.greatest(*[F.col(f"d_{c}") for c in counters]) > 0 if len(counters) > 1 else F.col(f"d_{counters[0]}") > 0
    return marked.where(~F.col("reset") & moved)


def remainders(rows: DataFrame, scope: list[str], order: list[str], snapshot: str, captured: str) -> DataFrame:
    """What each cumulative snapshot holds beyond captured and already recovered usage: the rise of the running maximum of snapshot - captured, from 0."""
    best = F.greatest(F.lit(0), F.max(F.col(snapshot) - F.col(captured)).over(running(scope, order)))
    window = Window.partitionBy(*scope).orderBy(*order)
    return rows.withColumn("_best", best).withColumn("remainder", F.col("_best") - F.coalesce(F.lag("_best").over(window), F.lit(0))).drop("_best")


def window_middle(cutoff: Column, now: Column) -> Column:
    """Middle of a time window, whole seconds."""
    return F.timestamp_seconds(F.floor((F.unix_seconds(cutoff) + F.unix_seconds(now)) / 2))


def fold_turns(rows: DataFrame, scope: list[str], order: str, role: str = "role", text: str = "text") -> DataFrame:
    """Chat rows to turns: a user row opens a turn, assistant texts are joined in order, other roles are left out."""
    numbered = rows.withColumn("turn_index", F.sum((F.col(role) == "user").cast("int")).over(running(scope, [order])).cast("long"))
    kept = numbered.where(F.col(role).isin("user", "assistant") & (F.col("turn_index") > 0))
    parts = F.array_sort(F.collect_list(F.when(F.col(role) == "assistant", F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    prompt = F.max(F.when(F.col(role) == "user", F.col(text)))
    return kept.groupBy(*scope, "turn_index").agg(prompt.alias("prompt"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("assistant"), F.size(parts).cast("long").alias("n_parts"))
