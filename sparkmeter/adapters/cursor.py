"""Conversations from hook ledgers, the desktop key-value store, and cloud exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.normalize import cloud_api, cursor_bubble, cursor_hook, get, text_of
from ..operators.segments import sticky_segments
from ..operators.usage import COUNTERS, first_usage_per_generation
from ..sources import jsonl
from ..sources.sqlite import SqliteKeyValue


def ledger_requests(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """One request for each generation of the hook ledgers: its first usage-bearing completion, else one without counters."""
    v = F.col("v")
    lines = jsonl.numbered(jsonl.records(jsonl.scan(spark, root, name_glob="*.jsonl")))
    rows = lines.select(get(v, "$.conversation_id").alias("session"), get(v, "$.generation_id").alias("generation"), get(v, "$.ts").alias("ts"), get(v, "$.hook").alias("hook"), get(v, "$.model").alias("model"), get(v, "$.prompt").alias("prompt"), get(v, "$.label").alias("label"), cursor_hook(get(v, "$.tokens", "variant")).alias("usage"), F.struct("path", "n").alias("ord"))
    done = rows.where(F.col("generation").isNotNull() & F.col("hook").isin("stop", "afterAgentResponse")).select("session", "generation", "ord", *[F.when(F.col("usage").isNotNull(), F.col(f"usage.{c}")).alias(c) for c in COUNTERS])
    named = rows.where("generation is not null").groupBy("session", "generation").agg(F.min_by("model", F.when(F.col("model").isNotNull(), F.col("ord"))).alias("model"), text.activity_label(F.min_by("label", F.when(F.col("label").isNotNull(), F.col("ord"))), F.min_by("prompt", F.when(F.col("prompt").isNotNull(), F.col("ord")))).alias("label"), F.min("ts").alias("ts"))
    return first_usage_per_generation(done, ["session"], "generation", "ord").join(named, ["session", "generation"]).withColumn("day", text.local_day(F.col("ts")))


def desktop(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Composers and bubbles of a desktop store: ``requests`` and ``missing`` (headers without a bubble)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteKeyValue)

    def store() -> DataFrame:  # a relation of its own for each pushed filter
        return spark.read.format("sqlite_kv").option("path", path).load()

    v = F.try_parse_json("value")
    heads = store().where(F.col("key").startswith("composerData:")).select(get(v, "$.composerId").alias("session"), get(v, "$.name").alias("title"), get(v, "$.modelConfig.modelName").alias("composer_model"), F.posexplode(F.try_variant_get(v, "$.fullConversationHeadersOnly", "array<struct<bubbleId string, type bigint>>")).alias("n", "h"))
    heads = heads.select("session", "title", "composer_model", "n", F.col("h.bubbleId").alias("bubble"), F.col("h.type").alias("head_type"))
    bubbles = store().where(F.col("key").startswith("bubbleId:")).select(F.split("key", ":")[1].alias("session"), F.split("key", ":")[2].alias("bubble"), get(v, "$.type", "bigint").alias("type"), get(v, "$.text").alias("text"), get(v, "$.modelType").alias("model"), get(v, "$.createdAt").alias("ts"), cursor_bubble(get(v, "$.tokenCount", "variant")).alias("usage"))
    rows = heads.join(bubbles, ["session", "bubble"], "left").withColumn("kind", F.coalesce("head_type", "type"))
    missing = rows.where("type is null").select("session", "bubble")
    rows = sticky_segments(rows, ["session"], ["n"], F.col("kind") == 1, F.lit(True))
    first = Window.partitionBy("session", "seg_id").orderBy("n")
    rows = rows.withColumn("label", text.activity_label(F.when(F.col("seg_id") == 1, F.first("title").over(first)), F.first("text").over(first)))
    used = rows.where("usage is not null").select("session", F.col("seg_id").alias("segment"), "label", F.coalesce("model", "composer_model").alias("model"), "ts", text.local_day(F.col("ts")).alias("day"), *[F.col(f"usage.{c}").alias(c) for c in COUNTERS], F.lit(1).cast("long").alias("requests"))
    return {"requests": used, "missing": missing}


def prefer_ledger(ledger: DataFrame, store: DataFrame) -> DataFrame:
    """Requests of both; a conversation that has a ledger is taken from there only."""
    return ledger.unionByName(store.join(ledger.select("session").distinct(), "session", "left_anti"), allowMissingColumns=True)


def cloud_requests(events: DataFrame) -> DataFrame:
    """Segments of conversation and local day from cloud usage events (column ``v``): counters, charge in dollars, partial flag."""
    v = F.col("v")
    ms = F.coalesce(get(v, "$.timestamp", "bigint"), get(v, "$.timestamp").try_cast("bigint"))
    rows = events.select(F.coalesce(get(v, "$.cloudAgentId"), F.lit("")).alias("agent"), get(v, "$.conversationId").alias("conversation"), get(v, "$.model").alias("model"), text.millis_to_iso(ms).alias("ts"), cloud_api(get(v, "$.tokenUsage", "variant")).alias("usage"), (F.coalesce(get(v, "$.chargedCents", "double"), get(v, "$.tokenUsage.totalCents", "double")) / 100).alias("charge"))
    rows = rows.withColumn("day", text.local_day(F.col("ts")))
    sums = [F.coalesce(F.sum(f"usage.{c}"), F.lit(0)).cast("long").alias(c) for c in COUNTERS]
    return rows.groupBy("agent", "conversation", "day", "model").agg(*sums, F.count("*").cast("long").alias("requests"), F.sum("charge").alias("charge"), F.bool_or(F.col("usage").isNull()).alias("partial"), F.min("ts").alias("ts"))


def cloud_export(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """``requests`` and ``segments`` of exported conversations, one JSON file each: a user message opens a segment, an answer without counters is a request all the same."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("wholetext", "true").text(root)
    v, m = F.col("v"), F.col("m")
    docs = whole.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json(F.make_valid_utf8("value")).alias("v"))
    rows = docs.select("path", F.coalesce(get(v, "$.id"), F.col("path")).alias("session"), get(v, "$.title").alias("title"), get(v, "$.model").alias("doc_model"), F.posexplode(F.try_variant_get(v, "$.messages", "array<variant>")).alias("n", "m"))
    body = F.coalesce(get(m, "$.text", "variant"), get(m, "$.content", "variant"))
    counted = F.coalesce(get(m, "$.usage", "variant"), get(m, "$.tokenUsage", "variant"))
    rows = rows.select(
        "path", "session", "title", "n", get(m, "$.role").alias("role"), F.coalesce(get(m, "$.timestamp"), get(m, "$.createdAt")).alias("ts"), F.coalesce(text_of(body), F.lit("")).alias("text"),
        F.coalesce(get(m, "$.model"), F.col("doc_model"), F.lit("unknown")).alias("model"), cursor_bubble(counted).alias("usage"),
    ).where(F.col("role").isin("user", "assistant"))
    rows = sticky_segments(rows, ["path"], ["n"], F.col("role") == "user", F.lit(True))
    first = F.struct("role", "text", "title", "ts")
    segments = rows.groupBy("session", "path", "seg_id").agg(F.min_by(first, "n").alias("f"))
    asked = F.when(F.col("f.role") == "user", F.col("f.text"))
    segments = segments.select("session", "path", "seg_id", text.activity_label(F.when(F.col("seg_id") == 1, F.col("f.title")), asked).alias("label"), F.col("f.ts").alias("start_ts"), text.prompt(F.coalesce(asked, F.lit(""))).alias("prompt"))
    used = rows.where("role = 'assistant'").select("session", "path", F.col("seg_id").alias("segment"), "model", "ts", text.local_day(F.col("ts")).alias("day"), *[F.coalesce(F.col(f"usage.{c}"), F.lit(0)).cast("long").alias(c) for c in COUNTERS], F.lit(1).cast("long").alias("requests"))
    return {"requests": used.join(segments.select("path", F.col("seg_id").alias("segment"), "label"), ["path", "segment"]), "segments": segments}
