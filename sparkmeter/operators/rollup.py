"""Rollups of priced usage: groups, totals, tops, medians, trends, measurement levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable
from .usage import BUCKET

LEVELS = ["exact", "partial", "activity_only"]


def aggregates() -> list[Column]:
    """Bucket sums, NULL-aware cost, partial flag."""
    return [
        *[F.sum(c).cast("long").alias(c) for c in BUCKET],
        F.sum("cost").cast("long").alias("cost"),
        F.coalesce(F.bool_or(F.col("cost").isNull()), F.lit(False)).alias("partial"),
    ]


def history(usage: DataFrame, key: str, calls: Column | None = None) -> DataFrame:
    """One row for each key: calls (distinct sessions unless given), bucket sums, cost."""
    count = F.countDistinct("session") if calls is None else calls
    return usage.groupBy(F.col(key).alias("key")).agg(count.cast("long").alias("calls"), *aggregates())


def with_total(usage: DataFrame, key: str) -> DataFrame:
    """Rows for each key and one for all (key null, total = true), in one aggregation."""
    return usage.select(F.col(key).alias("key"), *BUCKET, "cost").rollup("key").agg(F.grouping("key").cast("boolean").alias("total"), *aggregates())


def label_breakdown(usage: DataFrame) -> DataFrame:
    """By label, by label and model, and over all, in one pass."""
    return usage.groupingSets([["label"], ["label", "model"], []], "label", "model").agg(F.grouping_id().cast("long").alias("grain"), *aggregates())


def history_order() -> list[Column]:
    return [F.coalesce("cost", F.lit(0)).desc(), F.col("key")]


def in_history_order(rows: DataFrame) -> DataFrame:
    """Rank by cost (unknown counts as 0) falling, then key; for grains of few keys (one task ranks them), others are sorted by ``history_order``."""
    order = Window.orderBy(F.coalesce("cost", F.lit(0)).desc(), "key")
    return rows.withColumn("rank", F.row_number().over(order).cast("long"))


def top(rows: DataFrame, n: int, key: str = "key") -> DataFrame:
    """The n rows of highest cost with their rank; unknown cost last, ties by key. Only n rows reach the ranking window."""
    head = rows.orderBy(F.col("cost").desc_nulls_last(), key).limit(n)
    return head.withColumn("rank", F.row_number().over(Window.orderBy(F.col("cost").desc_nulls_last(), key)).cast("long"))


def top_of_each(rows: DataFrame, grain: str, n: int, key: str = "key") -> DataFrame:
    order = Window.partitionBy(grain).orderBy(F.coalesce("cost", F.lit(0)).desc(), key)
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def cut_rows(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """How many rows of unknown cost there are, and how many of them the cut hides."""
    counts = rows.agg(F.count_if(F.col("cost").isNull()).cast("long").alias("unpriced"))
    seen = shown.agg(F.count_if(F.col("cost").isNull()).cast("long").alias("shown"))
    return counts.join(F.broadcast(seen)).select("unpriced", (F.col("unpriced") - F.col("shown")).alias("hidden"))


def median(rows: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Exact median (mean of the middle two) of known values, and how many there are, for each group; null for a group without any."""
    return medians(rows, by, {column: name}).withColumnRenamed(f"n_{name}", "n")


def medians(rows: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """Exact medians of some columns, and how many known values each has (``n_`` before its name), for each group.

    No task gathers a group: equal values are counted with map-side combine, counts are summed by stretches of values, and only the
    stretches in which the middle lies are put in order. The counts are written to the checkpoint folder, for they are read twice.
    """
    values = F.array(*[F.struct(F.lit(name).alias("_of"), F.col(c).cast("double").alias("_v")) for c, name in columns.items()])
    counts = rows.select(*by, F.explode(values).alias("_x")).groupBy(*by, "_x._of", "_x._v").agg(F.count("*").alias("_n"))
    stretch = F.signum("_v") * F.floor(F.lit(256) * F.log2(F.abs("_v") + 1))  # never falls as values rise
    counts = durable(counts.withColumn("_at", stretch.cast("long")))
    keys = [*by, "_of"]
    sums = counts.groupBy(*keys, "_at").agg(F.sum("_n").alias("_c"))
    known = F.when(F.col("_at").isNotNull(), F.col("_c")).otherwise(0)
    group = Window.partitionBy(*keys)
    sums = sums.withColumns({"_upto": F.sum(known).over(group.orderBy("_at")), "_all": F.sum(known).over(group)})
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1

    def covers(rank: Column, upto: str, count: str) -> Column:
        return (F.col(upto) - F.col(count) < rank) & (rank <= F.col(upto))

    held = F.col("_at").isNotNull() & (covers(low, "_upto", "_c") | covers(high, "_upto", "_c"))
    near = sums.where(held).select(*[F.col(c).alias(f"_k{c}") for c in [*keys, "_at"]], (F.col("_upto") - F.col("_c")).alias("_before"), "_all")
    same = F.lit(True)
    for c in [*keys, "_at"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_k{c}"))
    run = counts.join(near, same)
    run = run.withColumn("_run", F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_at").orderBy("_v")))
    halves_ = [F.sum(F.when(covers(rank, "_run", "_n"), F.col("_v") * 0.5)) for rank in (low, high)]
    middle = run.groupBy(*keys).agg((halves_[0] + halves_[1]).alias("_m"), F.lit(None).cast("long").alias("_c"))
    both = middle.unionByName(sums.groupBy(*keys).agg(F.lit(None).cast("double").alias("_m"), F.max("_all").alias("_c")))
    picked = [x for name in columns.values() for x in (F.max(F.when(F.col("_of") == name, F.col("_m"))).alias(name), F.max(F.when(F.col("_of") == name, F.col("_c"))).cast("long").alias(f"n_{name}"))]
    return both.groupBy(*by).agg(*picked)


def cache_ratio(read: str = "cache_read") -> Column:
    """Cached reads over all input-side tokens; null without any."""
    return F.try_divide(F.col(read).cast("double"), (F.col(read) + F.col("input") + F.col("cache_5m") + F.col("cache_1h")).cast("double"))


def day_split(requests: DataFrame, scope: list[str]) -> DataFrame:
    """Bucket sums for each day; requests without a day go to the scope's first known day, else to ``unknown``. Only sums are put in order."""
    sums = [F.sum(c).cast("long").alias(c) for c in BUCKET]
    by_day = requests.groupBy(*scope, "day").agg(*sums)
    first = F.min("day").over(Window.partitionBy(*scope))
    return by_day.withColumn("day", F.coalesce("day", first, F.lit("unknown"))).groupBy(*scope, "day").agg(*sums)


def halves(rows: DataFrame, by: list[str], middle: Column, at: str = "ts") -> DataFrame:
    """Cost before and from the middle of the window on; unknown cost counts as 0."""
    known = F.coalesce("cost", F.lit(0))
    before = F.col(at) < middle
    return rows.groupBy(*by).agg(F.sum(F.when(before, known).otherwise(0)).cast("long").alias("before"), F.sum(F.when(before, 0).otherwise(known)).cast("long").alias("after"))


def top_mover(movers: DataFrame, label: str = "label") -> DataFrame:
    """The label whose cost rose most (ties: the greatest label), and its share of the whole rise; no row where spend did not rise from something."""
    best = F.max(F.struct((F.col("after") - F.col("before")).alias("delta"), F.col(label).alias("label"))).alias("best")
    found = movers.agg(best, F.sum("before").alias("first"), F.sum(F.col("after") - F.col("before")).alias("rise"))
    found = found.where("first > 0 and rise > 0 and best.delta > 0")
    return found.select(F.col("best.label").alias("label"), F.col("best.delta").alias("delta"), (F.col("best.delta") / F.col("rise")).alias("share"))


def measurement_tally(rows: DataFrame, by: list[str], level: str = "measurement") -> DataFrame:
    """How many of each level, and the worst one."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col(level))
    worst = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.max(rank).cast("int"))
    return rows.groupBy(*by).agg(*[F.count_if(F.col(level) == x).cast("long").alias(f"n_{x}") for x in LEVELS], worst.alias("worst"))


def hide_unmeasured(rows: DataFrame, level: str = "measurement") -> DataFrame:
    """Costs of sessions that hold activity only are unknown at every grain."""
    return rows.withColumn("cost", F.when(F.col(level) != "activity_only", F.col("cost")))


def long_metrics(rows: DataFrame, key: str) -> DataFrame:
    """Export form: a row for each key and metric; both cache writes are one metric."""
    wide = rows.select(
        key,
        F.col("input").alias("tokens.input"), F.col("output").alias("tokens.output"), F.col("cache_read").alias("tokens.cache_read"),
        (F.col("cache_5m") + F.col("cache_1h")).alias("tokens.cache_write"), F.col("requests").alias("requests"),
    )
    return wide.unpivot(key, [f"`{c}`" for c in wide.columns if c != key], "metric", "value")
