"""From a folder of transcripts to delivered turns: records to events, events to turns, turns to the outbox, the outbox to the other side."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bridge, text
from ..functions.normalize import get, kind_of, text_of
from ..operators import turns
from ..operators.bridge import COUNTERS
from ..session import durable
from ..sources import discovery
from ..streaming.publish import Outbox, publish_batch

ENDPOINT = "turns"
_EVENT = f"array<struct<slot int, kind string, ident string, name string, text string, request string, {', '.join(f'{c} bigint' for c in COUNTERS)}>>"
_BLOCKS = "array<struct<type string, id string, name string, tool_use_id string>>"


def _event(kind: str, slot: Column | int = 0, ident: Column | None = None, name: Column | None = None, said: Column | None = None, request: Column | None = None, used: Column | None = None) -> Column:
    empty = F.lit("")
    counters = [(used[c] if used is not None else F.lit(0)).cast("bigint").alias(c) for c in COUNTERS]
    words = {"ident": ident, "name": name, "text": said, "request": request}
    place = F.lit(slot) if isinstance(slot, int) else slot
    return F.struct(place.cast("int").alias("slot"), F.lit(kind).alias("kind"), *[F.coalesce(c if c is not None else empty, empty).alias(n) for n, c in words.items()], *counters)


def _if(condition: Column, *found: Column) -> Column:
    return F.when(condition, F.array(*found).cast(_EVENT)).otherwise(F.array().cast(_EVENT))


def events(lines: DataFrame) -> DataFrame:
    """Events of ``operators.turns`` from parsed lines (path, ord, v): session, chunk, ord, ts, model and what the event is.

    A session with usage records of its own is counted by these; its cumulative counts are left out, and usage records of other threads too.
    """
    v = F.col("v")
    r = bridge.lifted(v)
    content = F.coalesce(get(r, "$.message.content", "variant"), get(r, "$.content", "variant"))
    counted = F.coalesce(get(r, "$.message.usage", "variant"), get(r, "$.usage", "variant"))
    total = get(v, "$.payload.info.total_token_usage", "variant")
    fields = {
        "kind": get(v, "$.type"), "inner": get(v, "$.payload.type"), "meta_id": F.coalesce(get(v, "$.payload.id"), get(v, "$.payload.session_id")), "role": bridge.role(v), "ts": bridge.timestamp(v), "model": bridge.model(v),
        "said": text.strip(F.coalesce(text_of(content), F.lit(""))), "blocks": F.coalesce(F.try_variant_get(content, "$", _BLOCKS), F.array().cast(_BLOCKS)), "call": bridge.tool_call(v), "request": bridge.request_id(v),
        "own_usage": F.when(F.startswith(F.schema_of_variant(counted), F.lit("OBJECT")), bridge.usage(counted)), "turn_id": get(r, "$.turn_id"), "thread": F.coalesce(get(r, "$.thread_id"), F.lit("")),
        "total_usage": F.when(kind_of(total, "$.input_tokens").isNotNull() & kind_of(total, "$.output_tokens").isNotNull(), bridge.usage(total)),
        "answers": F.coalesce(get(r, "$.call_id"), get(r, "$.tool_call_id"), get(r, "$.tool_use_id"), get(r, "$.id")), "name": get(r, "$.name"),
    }
    # a generator ends the parsed record here: what follows reads each field many times
    rows = durable(lines.select("path", "ord", F.explode(F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))).alias("x")).select("path", "ord", "x.*"))
    flags = rows.groupBy("path").agg(F.bool_or(F.col("kind") == "token_usage_record").alias("by_record"), F.max(F.when(F.col("kind") == "session_meta", F.col("meta_id"))).alias("own"))
    rows = rows.join(flags.withColumn("by_record", F.coalesce("by_record", F.lit(False))), "path")
    kind, used = F.col("kind"), F.col("own_usage")
    mine = F.col("by_record") & ((F.col("thread") == "") | F.col("own").isNull() | (F.col("thread") == F.col("own")))
    speaks, said, clipped = F.col("role") == "assistant", F.col("said") != "", text.clip(F.col("said"), 20_000, "…")
    results = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_result"), lambda b, i: _event("result", i + 1, F.coalesce(b["tool_use_id"], b["id"]), b["name"]))
    calls = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"), lambda b, i: _event("call", i + 1, b["id"], F.coalesce(b["name"], F.lit("tool"))))
    none = F.array().cast(_EVENT)
    record, counts = kind == "token_usage_record", (kind == "event_msg") & (F.col("inner") == "token_count")
    found = F.concat(
        _if(kind == "turn_context", _event("context", 0, F.col("turn_id"))),
        _if(record & mine & used.isNotNull(), _event("usage", 0, request=F.col("request"), used=used)),
        _if(counts & ~F.col("by_record") & F.col("total_usage").isNotNull(), _event("total", used=F.col("total_usage"))),
        _if((F.col("role") == "user") & said, _event("prompt", said=clipped)),
        F.when(F.col("role") == "user", results.cast(_EVENT)).otherwise(none),
        _if(speaks & said, _event("answer", said=clipped)),
        F.when(speaks, calls.cast(_EVENT)).otherwise(none),
        _if(speaks & F.col("call").isNotNull(), _event("call", 1, F.col("call.id"), F.col("call.name"))),
        _if(speaks & ~record & used.isNotNull(), _event("usage", 1000, request=F.col("request"), used=used)),
        _if(F.col("role") == "tool", _event("result", 0, F.col("answers"), F.col("name"))),
    )
    session = F.coalesce("own", F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)).alias("session")
    long = rows.select(session, "path", "ord", "ts", "model", F.explode(found).alias("e"))
    return long.select("session", F.struct("path", F.col("ord.block")).alias("chunk"), F.struct("path", F.col("ord.block"), F.col("ord.line"), F.col("e.slot")).alias("ord"), "ts", "model", *[F.col(f"e.{c}").alias(c) for c in ("kind", "ident", "name", "text", "request", *COUNTERS)])


def turns_of(spark: SparkSession, root: str) -> DataFrame:
    """Turns of all transcripts under a root."""
    return turns.fold(events(discovery.log_lines(spark, root).where("object")), ["session"])


def entries(found: DataFrame) -> DataFrame:
    """Outbox entries of turns: one source for each turn; a turn that grew is a new version of its source."""
    body = F.struct(
        F.col("session"), F.col("turn"), F.coalesce("prompt", F.lit("")).alias("prompt"), "assistant", "model", "ident", "ts", F.struct(*COUNTERS).alias("usage"), F.struct("tools", "answered").alias("tools"),
        text.turn_markdown(F.lit("Turn"), F.col("model"), F.coalesce("prompt", F.lit("")), F.array().cast("array<struct<name string, input string, result string>>"), F.col("assistant")).alias("markdown"),
    )
    grown = (F.length("assistant") + F.col("tools") + F.col("answered") + F.col("input") + F.col("output")).cast("long")
    return found.select(
        F.coalesce("ts", F.lit("")).alias("created_at"), text.source_id(F.col("session"), F.lit(None).cast("string"), F.col("turn")).alias("source_id"), F.lit(ENDPOINT).alias("endpoint"), "session",
        F.lit(False).alias("mutable"), "turn", F.lit(0).cast("long").alias("stage"), grown.alias("revision"), F.to_json(body).alias("body"),
    )


def sync(spark: SparkSession, root: str, outbox: str, post: Callable[[str, dict], int], limit: int = 1000) -> int:
    """Send the turns of the logs that the other side does not have yet; how many still wait."""
    box = Outbox(spark, outbox)
    number = max([-1, *box.line.numbers()]) + 1
    publish_batch(outbox, post, limit)(entries(turns_of(spark, root)), number)
    return box.waiting(number)


def poster(base: str, timeout: float = 10.0) -> Callable[[str, dict], int]:
    """Posts JSON to ``base``/endpoint and gives the status."""

    def post(endpoint: str, body: dict) -> int:
        request = urllib.request.Request(f"{base.rstrip('/')}/{endpoint}", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.status
        except urllib.error.HTTPError as error:
            return error.code

    return post
