"""Event logs with per-call usage, and cumulative metrics at each shutdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.normalize import copilot as flatten
from ..functions.normalize import copilot_ttl_odd, get
from ..operators.segments import running
from ..operators.usage import COUNTERS, dedupe_first
from ..sources import jsonl

NO_COMMAND = "(no command)"


def events(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Native events and capture lines in order of time; the first event of an id counts."""
    lines = jsonl.numbered(jsonl.records(jsonl.scan(spark, paths, recursive=True, name_glob="*.jsonl")))
    v = F.col("v")
    session = F.first(get(v, "$.data.sessionId"), ignorenulls=True).over(Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = lines.select(session.alias("session"), get(v, "$.id").alias("id"), get(v, "$.type").alias("type"), get(v, "$.timestamp").alias("ts"), F.coalesce(get(v, "$.agentId"), F.lit("")).alias("agent"), get(v, "$.data", "variant").alias("data"), F.struct(get(v, "$.timestamp"), F.col("path"), F.col("n")).alias("ord"))
    return dedupe_first(rows, ["session"], "id", "ord")


def sessions(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """``requests`` (captured calls, and what shutdown metrics hold beyond them) and ``segments``."""
    d = F.col("data")
    rows = events(spark, paths).withColumns({"name": get(d, "$.name"), "text": F.coalesce(get(d, "$.content"), get(d, "$.label")), "model": get(d, "$.model"), "usage": F.when(F.col("type") == "assistant.usage", flatten(d))})
    marker = F.col("type").isin("user.message", "skill.invoked")
    opened = F.sum(marker.cast("int")).over(running(["session", "agent"], ["ord"]))
    main = F.sum((marker & (F.col("agent") == "")).cast("int")).over(running(["session"], ["ord"]))
    rows = rows.withColumns({"_own": opened, "_main": main})
    # an agent without a segment of its own works in the main agent's
    rows = rows.withColumns({"seg_agent": F.when(F.col("_own") > 0, F.col("agent")).otherwise(""), "seg_id": F.when(F.col("_own") > 0, F.col("_own")).otherwise(F.col("_main")).cast("long")}).drop("_own", "_main")
    label = F.when(F.col("type") == "skill.invoked", F.col("name")).otherwise(text.command_label(F.col("text")))
    within = rows.where(marker | F.col("usage").isNotNull()).groupBy("session", "seg_agent", "seg_id")
    segments = within.agg(F.coalesce(F.min_by(label, F.when(marker & label.isNotNull(), F.col("ord"))), F.lit(NO_COMMAND)).alias("label"), F.min("ts").alias("start_ts"))
    own = rows.where("usage is not null").select(
        "session", "seg_agent", "seg_id", "model", "ts", text.local_day(F.col("ts")).alias("day"), *[F.col(f"usage.{c}").alias(c) for c in COUNTERS], F.lit(1).cast("long").alias("requests")
    )
    own = own.join(segments.select("session", "seg_agent", "seg_id", "label"), ["session", "seg_agent", "seg_id"], "left")
    own = own.withColumn("segment", segment_name()).drop("seg_agent", "seg_id")
    return {"requests": own.unionByName(_recovered(rows), allowMissingColumns=True), "segments": segments, "partial": _partial(rows)}


def segment_name() -> Column:
    """A segment's name in its session: its agent (none for the main one) and its number."""
    return F.concat_ws("#", "seg_agent", "seg_id")


def _partial(rows: DataFrame) -> DataFrame:
    """Sessions with calls without valid counters, or with cached tokens of an unknown time to live."""
    lost = (F.col("type") == "assistant.usage") & (F.col("usage").isNull() | copilot_ttl_odd(F.col("data")))
    return rows.where(lost).select("session").distinct()


def _recovered(rows: DataFrame) -> DataFrame:
    """Usage of shutdown snapshots beyond what was captured before: the rise of max(snapshot - captured), by model and counter."""
    metrics = F.try_variant_get("data", "$.modelMetrics", "map<string, variant>")
    shots = rows.where("type = 'session.shutdown'").select("session", "ts", "ord", F.explode(metrics).alias("model", "m")).withColumn("shot", flatten(get(F.col("m"), "$.usage", "variant"))).where("shot is not null")
    shots = shots.select("session", "model", "ts", "ord", F.lit(1).alias("side"), *[F.col(f"shot.{c}").alias(c) for c in COUNTERS], F.coalesce(get(F.col("m"), "$.requests.count", "bigint"), F.lit(0)).alias("requests"))
    calls = rows.where("usage is not null").select("session", "model", "ts", "ord", F.lit(0).alias("side"), *[F.col(f"usage.{c}").alias(c) for c in COUNTERS], F.lit(1).cast("long").alias("requests"))
    both = shots.unionByName(calls).withColumn("written", F.col("cache_5m") + F.col("cache_1h"))
    order, window = ["ord", "side"], Window.partitionBy("session", "model").orderBy("ord")
    fields = ["input", "output", "cache_read", "written", "requests"]
    both = both.withColumns({f"seen_{c}": F.coalesce(F.sum(F.when(F.col("side") == 0, F.col(c))).over(running(["session", "model"], order)), F.lit(0)) for c in fields}).where("side = 1")
    both = both.withColumns({f"best_{c}": F.greatest(F.lit(0), F.max(F.col(c) - F.col(f"seen_{c}")).over(running(["session", "model"], ["ord"]))) for c in fields})
    rise = {c: F.col(f"best_{c}") - F.coalesce(F.lag(f"best_{c}").over(window), F.lit(0)) for c in fields}
    out = both.select("session", "model", "ts", text.local_day(F.col("ts")).alias("day"), F.lit("(recovered at shutdown)").alias("label"), rise["input"].alias("input"), rise["output"].alias("output"), rise["cache_read"].alias("cache_read"), rise["written"].alias("cache_5m"), F.lit(0).cast("long").alias("cache_1h"), rise["requests"].alias("requests"))
    return out.where(F.greatest(*[F.col(c) for c in [*COUNTERS, "requests"]]) > 0)
