"""Turns of a record log, by running values.

Events are rows of a sequence (``scope``, ``ord``) with a kind:

* ``prompt`` opens a turn; ``answer``, ``call`` and ``result`` belong to the turn that is open;
* ``context`` announces a turn: its ident and model go to the next prompt. One that comes when the open turn has content and
  that does not name the open turn says that usage from there on is the next turn's;
* ``usage`` is a request's counters (records of one request keep their maxima);
* ``total`` is a cumulative count: its rise since the last one is usage, a fall begins anew and is none.

Usage before the first prompt, with no answer before it, is the first turn's.

Each pass joins the rows with what their chunks inherit, so rows are written to the checkpoint folder between passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .bridge import COUNTERS
from .joins import match_results
from .scan import prefix


def placed(events: DataFrame, scope: list[str], chunk: str = "chunk", order: str = "ord") -> DataFrame:
    """Events with ``turn``, what the turn inherited (``turn_ident``, ``turn_model``), and totals turned into usage (``used``)."""
    kind = F.col("kind")
    context, total = kind == "context", kind == "total"
    own = F.struct(*COUNTERS)
    events = durable(events)
    rows = prefix(
        events, scope, [order], chunk, {"_seg": kind == "prompt", "_said": kind == "answer"},
        {"_ident": F.when(context, F.nullif("ident", F.lit(""))), "_model": F.when(context, F.nullif("model", F.lit(""))), "_total": F.when(total, own)},
    )
    opens = kind == "prompt"
    announced = F.struct(F.coalesce("_ident", F.lit("")).alias("ident"), F.coalesce("_model", F.lit("")).alias("model"))
    rows = prefix(durable(rows), scope, [order], chunk, lasts={"_turn": F.when(opens, announced)})
    rows = rows.withColumn("_turn", F.when(opens, announced).otherwise(F.col("_turn")))
    has_content = (F.col("_seg") > 0) | (F.col("_said") > 0)
    named = F.coalesce("ident", F.lit(""))
    ahead = context & has_content & ((named == "") | (named != F.coalesce("_turn.ident", F.lit(""))))
    rows = durable(prefix(durable(rows), [*scope, "_seg"], [order], chunk, {"_ahead": ahead}))
    fell, rise = F.lit(False), []
    for c in COUNTERS:
        before = F.coalesce(F.col(f"_total.{c}"), F.lit(0))
        fell = fell | (F.col(c) < before)
        rise.append((F.col(c) - before).alias(c))
    used = F.when(kind == "usage", own).when(total & ~fell, F.struct(*rise))
    silent = rows.where("_seg = 0").groupBy(*scope).agg((F.max("_said") > 0).alias("_spoke"))
    rows = rows.withColumn("used", used).join(silent, scope, "left")
    turn = F.col("_seg") + ((F.col("_ahead") > 0) & used.isNotNull()).cast("long")
    turn = F.when((F.col("_seg") == 0) & F.col("used").isNotNull() & ~F.coalesce("_spoke", F.lit(True)), F.lit(1)).otherwise(turn)
    return rows.select(*events.columns, turn.cast("long").alias("turn"), F.col("_turn.ident").alias("turn_ident"), F.col("_turn.model").alias("turn_model"), "used")


def fold(events: DataFrame, scope: list[str], chunk: str = "chunk", order: str = "ord") -> DataFrame:
    """One row for each turn with content or usage: prompt, answers in order, model, ident, first time, counters, calls and how many were answered.

    Events: ``scope``, order, chunk, kind, ident (call id of calls and results), name, model, ts, text, request and the counters.
    """
    rows = durable(placed(events, scope, chunk, order))
    key = [*scope, "turn"]
    kind, at = F.col("kind"), F.col(order)
    answers = F.array_sort(F.collect_list(F.when((kind == "answer") & (F.length("text") > 0), F.struct(at.alias("o"), F.col("text").alias("t")))))
    spoken = kind.isin("prompt", "answer") & (F.length("model") > 0)
    chats = rows.where(kind.isin("prompt", "answer", "call", "result")).groupBy(*key).agg(
        F.max(F.when(kind == "prompt", F.col("text"))).alias("prompt"), F.array_join(F.transform(answers, lambda a: a["t"]), "\n").alias("assistant"),
        F.coalesce(F.max_by("model", F.when(spoken, at)), F.max("turn_model"), F.lit("")).alias("model"), F.max("turn_ident").alias("ident"), F.min(F.nullif("ts", F.lit(""))).alias("ts"),
    )
    request = F.coalesce(F.nullif("request", F.lit("")), F.concat(F.lit("#"), at.cast("string")))
    usage = rows.where("used is not null").groupBy(*key, request.alias("_request")).agg(*[F.max(f"used.{c}").alias(c) for c in COUNTERS])
    usage = usage.groupBy(*key).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTERS])
    tools = rows.where(kind.isin("call", "result")).select(*key, "kind", F.coalesce("name", F.lit("tool")).alias("name"), F.nullif("ident", F.lit("")).alias("call_id"), at.alias("place"))
    matched = match_results(tools.where("kind = 'call'").drop("kind"), tools.where("kind = 'result'").drop("kind"), key, "name", "place", "call_id")
    tools = matched.groupBy(*key).agg(F.count("*").cast("long").alias("tools"), F.count("result_ord").cast("long").alias("answered"))
    found = chats.join(usage, key, "full_outer").join(tools, key, "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*COUNTERS, "tools", "answered")]
    found = found.select(*key, "prompt", F.coalesce("assistant", F.lit("")).alias("assistant"), F.coalesce("model", F.lit("")).alias("model"), F.coalesce("ident", F.lit("")).alias("ident"), "ts", *zero)
    content = F.col("prompt").isNotNull() | (F.col("assistant") != "") | (F.col("tools") > 0)
    return found.where(content | (F.greatest(*COUNTERS) > 0))
