"""Rollouts: turn contexts, cumulative token notifications or per-response records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.normalize import codex as flatten
from ..functions.normalize import get, text_of
from ..operators.segments import deltas, running, sticky_segments, sticky_value
from ..operators.usage import COUNTERS, dedupe_requests
from ..sources import jsonl

NO_COMMAND = "(no command)"


def sessions(spark: SparkSession, root: str | list[str]) -> dict[str, DataFrame]:
    """``requests`` and ``segments`` of the rollouts under ``root``; a session's first file by path (live before archived) counts."""
    lines = jsonl.records(jsonl.scan(spark, root, recursive=True, name_glob="*.jsonl"))
    v = F.col("v")
    kind, inner = get(v, "$.type"), get(v, "$.payload.type")
    rows = lines.select(
        "path", "ord", kind.alias("type"), inner.alias("inner"), get(v, "$.timestamp").alias("ts"), F.coalesce(get(v, "$.payload.id"), get(v, "$.payload.session_id")).alias("meta_id"),
        get(v, "$.payload.model").alias("model_set"), get(v, "$.payload.turn_id").alias("turn_id"), get(v, "$.payload.thread_id").alias("thread_id"), get(v, "$.payload.response_id").alias("response_id"),
        get(v, "$.payload.source.subagent.thread_spawn.parent_thread_id").alias("parent"),
        text_of(get(v, "$.payload.content", "variant")).alias("text"), get(v, "$.payload.role").alias("role"),
        F.when(kind == "token_usage_record", flatten(get(v, "$.payload.usage", "variant"))).alias("own"),
        F.when((kind == "event_msg") & (inner == "token_count"), flatten(get(v, "$.payload.info.total_token_usage", "variant"))).alias("total"),
        (get(v, "$.payload.info.total_token_usage", "variant").isNotNull() & (inner == "token_count")).alias("counts"),
    )
    rows = jsonl.numbered(rows).drop("ord")
    whole = Window.partitionBy("path")
    rows = rows.withColumn("session", F.max(F.when(F.col("type") == "session_meta", F.col("meta_id"))).over(whole)).withColumn("by_record", F.max((F.col("type") == "token_usage_record").cast("int")).over(whole) == 1)
    first = Window.partitionBy("session").orderBy(F.col("path").contains("archived_sessions"), F.col("path").desc())
    chosen = rows.select("path", "session").distinct().withColumn("_n", F.row_number().over(first)).where("_n = 1").select("path")
    rows = sticky_value(rows.join(chosen, "path"), ["path"], ["n"], "model_set", "model")
    seen = F.row_number().over(Window.partitionBy("path", "type", "turn_id").orderBy("n"))
    marker = ((F.col("inner") == "task_started") & (F.col("type") == "event_msg")) | ((F.col("type") == "turn_context") & (seen == 1) & ~F.coalesce(F.max(F.when(F.col("inner") == "task_started", F.col("turn_id"))).over(running(["path"], ["n"])) == F.col("turn_id"), F.lit(False)))
    bears = F.col("own").isNotNull() | F.col("total").isNotNull()
    rows = sticky_segments(rows.withColumn("marker", marker), ["path"], ["n"], F.col("marker"), bears)
    prompt = (F.col("type") == "response_item") & (F.col("role") == "user")
    segments = rows.where("seg_id > 0").groupBy("session", "path", "seg_id").agg(F.coalesce(F.min_by(text.command_label(F.col("text")), F.when(prompt & text.command_label(F.col("text")).isNotNull(), F.col("n"))), F.lit(NO_COMMAND)).alias("label"), F.min("ts").alias("start_ts"), F.min_by(text.prompt(F.col("text")), F.when(prompt, F.col("n"))).alias("prompt"))
    day = text.local_day(F.col("ts")).alias("day")
    base = ["session", "path", F.col("seg_id").alias("segment"), "model", "ts", day, F.col("n").alias("ord")]
    records = rows.where("by_record").where(F.col("own").isNotNull() & (F.col("thread_id").isNull() | (F.col("thread_id") == F.col("session")))).select(*base, F.col("response_id").alias("request_id"), *[F.col(f"own.{c}").alias(c) for c in COUNTERS])
    totals = rows.where("not by_record").where(F.col("total").isNotNull()).select(*base, *[F.col(f"total.{c}").alias(c) for c in COUNTERS])
    moved = deltas(totals, ["path"], ["ord"], COUNTERS).select("session", "path", "segment", "model", "ts", "day", "ord", F.lit(None).cast("string").alias("request_id"), *[F.col(f"d_{c}").alias(c) for c in COUNTERS])
    requests = dedupe_requests(records.unionByName(moved), ["session", "path"], first=["segment", "model", "day", "ts"])
    requests = requests.join(segments.select("path", F.col("seg_id").alias("segment"), "label"), ["path", "segment"], "left")
    lost = rows.where(F.when(F.col("by_record"), (F.col("type") == "token_usage_record") & F.col("own").isNull()).otherwise(F.col("counts") & F.col("total").isNull())).select("session")
    fell = F.lit(False)
    for c in COUNTERS:
        fell = fell | F.coalesce(F.col(c) < F.lag(c).over(Window.partitionBy("path").orderBy("ord")), F.lit(False))
    resets = totals.withColumn("fell", fell).where("fell").select("session")
    return {"requests": requests, "segments": segments, "partial": lost.union(resets).distinct(), "parents": rows.where("type = 'session_meta' and parent is not null").select("session", "parent").distinct()}
