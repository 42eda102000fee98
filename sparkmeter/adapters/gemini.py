"""Chat recordings: JSON lines, or one JSON object with a list of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.normalize import antigravity as flatten_steps
from ..functions.normalize import gemini as flatten
from ..functions.normalize import get, kind_of, text_of
from ..operators.segments import sticky_segments, sticky_value
from ..operators.usage import COUNTERS, dedupe_requests, unmeasured
from ..sources import jsonl

NO_COMMAND = "(no command)"


def messages(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Messages of both layouts: path, session, n, v."""
    lines = jsonl.numbered(jsonl.records(jsonl.scan(spark, root, recursive=True, name_glob="*.json*")))
    inner = F.try_variant_get("v", "$.messages", "array<variant>")
    rows = lines.select("path", "n", "v", F.max(get(F.col("v"), "$.sessionId")).over(Window.partitionBy("path")).alias("session"), inner.alias("messages"))
    single = rows.where("messages is null").select("path", "session", F.col("n").cast("double").alias("n"), "v")
    listed = rows.where("messages is not null").select("path", "session", "n", F.posexplode("messages").alias("i", "v")).select("path", "session", (F.col("n") + F.col("i") / 1e6).alias("n"), "v")
    return single.unionByName(listed)


def sessions(spark: SparkSession, root: str | list[str]) -> dict[str, DataFrame]:
    """``requests``, ``segments`` and ``partial`` (sessions with messages whose counters were never valid)."""
    v = F.col("v")
    rows = messages(spark, root).select("path", "session", "n", get(v, "$.id").alias("id"), get(v, "$.type").alias("type"), get(v, "$.timestamp").alias("ts"), get(v, "$.model").alias("model"), text_of(get(v, "$.content", "variant")).alias("text"), flatten(get(v, "$.tokens", "variant")).alias("usage"))
    rows = rows.where(F.col("type").isin("user", "gemini"))
    again = F.row_number().over(Window.partitionBy("path", "type", F.coalesce("id", F.col("n").cast("string"))).orderBy("n")) > 1
    rows = sticky_segments(rows.withColumn("marker", (F.col("type") == "user") & ~again), ["path"], ["n"], F.col("marker"), F.lit(True))
    label = text.command_label(F.col("text"))
    segments = rows.groupBy("session", "path", "seg_id").agg(F.coalesce(F.min_by(label, F.when((F.col("type") == "user") & label.isNotNull(), F.col("n"))), F.lit(NO_COMMAND)).alias("label"), F.min("ts").alias("start_ts"), F.min_by(text.prompt(F.col("text")), F.when(F.col("type") == "user", F.col("n"))).alias("prompt"))
    model_rows = rows.where("type = 'gemini'")
    bearing = model_rows.where("usage is not null").select("session", "path", F.col("seg_id").alias("segment"), "model", "ts", text.local_day(F.col("ts")).alias("day"), F.col("id").alias("request_id"), F.col("n").alias("ord"), *[F.col(f"usage.{c}").alias(c) for c in COUNTERS])
    requests = dedupe_requests(bearing, ["session", "path"], first=["segment", "model", "day", "ts"])
    requests = requests.join(segments.select("path", F.col("seg_id").alias("segment"), "label"), ["path", "segment"], "left")
    missing = unmeasured(model_rows.where("usage is null"), model_rows.where("usage is not null"), ["session", "id"]).select("session").distinct()
    parents = messages(spark, root).where(get(v, "$.parentSessionId").isNotNull()).select("session", get(v, "$.parentSessionId").alias("parent")).distinct()
    return {"requests": requests, "segments": segments, "partial": missing, "parents": parents}


#: Fixed wire texts of step logs: the message of a changed model, the model where none is named.
MODEL_SETTING = r"(?s)<USER_SETTINGS_CHANGE>\s*The user changed setting `Model Selection` from .*? to ([A-Za-z0-9][^.\n<]+)"
STEP_MODEL = "gemini-antigravity"


def step_sessions(spark: SparkSession, root: str | list[str]) -> dict[str, DataFrame]:
    """``requests``, ``segments`` and ``partial`` of step logs: prompts and skills open segments, a changed model holds until the next change.

    A step's counters are maxima over its records; steps that never had valid ones make their session partial.
    """
    v, content, step = F.col("v"), F.col("content"), F.col("step")
    lines = jsonl.records(jsonl.scan(spark, root, recursive=True, name_glob="*.jsonl")).where(kind_of(v, "$.step_index") == "BIGINT")
    args = F.transform(F.try_variant_get(v, "$.tool_calls", "array<variant>"), lambda call: F.to_json(F.try_variant_get(call, "$.args", "variant")))
    rows = lines.select(
        "path", "ord", get(v, "$.step_index").alias("step"), get(v, "$.type").alias("type"), get(v, "$.created_at").alias("ts"), F.coalesce(get(v, "$.content"), F.lit("")).alias("content"),
        F.coalesce(get(v, "$.model"), get(v, "$.modelName")).alias("own_model"), flatten_steps(v).alias("usage"), F.array_join(args, "\n").alias("args"),
    ).withColumn("session", F.regexp_extract("path", r"([^/]+)/[^/]*\.jsonl$", 1))
    rows = jsonl.numbered(rows).where(F.col("type").isin("USER_INPUT", "PLANNER_RESPONSE"))
    summary, asks = content.contains("<CONTEXT_SUMMARY>"), content.contains("<USER_REQUEST>")
    is_user = F.col("type") == "USER_INPUT"
    chosen = F.trim(F.regexp_extract(content, MODEL_SETTING, 1))
    rows = rows.withColumn("set_model", F.when(is_user & ~summary & (F.length(chosen) > 0), chosen))
    rows = sticky_value(rows, ["path"], ["n"], "set_model", "now_model")
    again = F.row_number().over(Window.partitionBy("path", "type", "step").orderBy("n")) > 1
    skill = F.regexp_extract(F.regexp_replace("args", r"\\\\+", "/"), r"/skills/([A-Za-z0-9][A-Za-z0-9_:-]*)/SKILL\.md", 1)
    rows = rows.withColumn("skill", F.when(~is_user & (F.length(skill) > 0), F.concat(F.lit("$"), skill)))
    rows = rows.withColumn("prompts", is_user & ~again & ~(summary & ~asks))
    rows = sticky_segments(rows.withColumn("marker", F.col("prompts") | F.col("skill").isNotNull()), ["path"], ["n"], F.col("marker"), ~is_user)
    said = text.antigravity_prompt(content)
    label = F.coalesce("skill", F.when(F.col("prompts"), text.command_label(said)))
    opened = rows.where("seg_id > 0").groupBy("session", "path", "seg_id").agg(
        F.coalesce(F.min_by(label, F.when(F.col("marker"), F.col("n"))), F.lit(NO_COMMAND)).alias("label"), F.min("ts").alias("start_ts"), F.min_by(text.prompt(said), F.when(F.col("prompts"), F.col("n"))).alias("prompt")
    )
    planned = rows.where(~is_user)
    bearing = planned.where("usage is not null").select("session", "path", F.col("seg_id").alias("segment"), F.coalesce("own_model", "now_model", F.lit(STEP_MODEL)).alias("model"), "ts", text.local_day(F.col("ts")).alias("day"), step.alias("request_id"), F.col("n").alias("ord"), *[F.col(f"usage.{c}").alias(c) for c in COUNTERS])
    requests = dedupe_requests(bearing, ["session", "path"], first=["segment", "model", "day", "ts"])
    requests = requests.join(opened.select("path", F.col("seg_id").alias("segment"), "label"), ["path", "segment"], "left")
    missing = unmeasured(planned.where("usage is null"), planned.where("usage is not null"), ["session", "step"]).select("session").distinct()
    return {"requests": requests, "segments": opened, "partial": missing}
