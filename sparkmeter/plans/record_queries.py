"""Queries over records: normalisers, scalar functions, agents, index tables, bridge state and cloud events.

Records are JSON texts made from the driver's tables by SQL that both engines read (``record_views``); the
functions under test parse them as VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bridge as records
from ..functions import normalize, text
from ..operators import agents, bridge, pricing, rollup, segments, summary, usage
from ..sources import cloud
from . import record_views as views
from .bench_views import Views
from .queries import query

KEYS = ["okey", "line"]


def _usage(v: Views, body: str) -> DataFrame:
    return v.records(views.usage_sql(body), "lineitem").withColumn("v", F.try_parse_json("j"))


def _flat(v: Views, body: str, flatten, *more: Column) -> DataFrame:
    rows = _usage(v, body).select(*KEYS, "v")
    rows = flatten.on(rows, "v", "u") if isinstance(flatten, normalize.Normaliser) else rows.withColumn("u", flatten(F.col("v")))
    return rows.select(*KEYS, F.col("u").isNotNull().alias("valid"), *[F.col(f"u.{c}").alias(c) for c in usage.COUNTERS], *more)


@query
def claude_usage(v: Views) -> DataFrame:
    return _flat(v, views.CLAUDE, normalize.claude)


@query
def codex_usage(v: Views) -> DataFrame:
    return _flat(v, views.CODEX, normalize.codex)


@query
def gemini_usage(v: Views) -> DataFrame:
    return _flat(v, views.GEMINI, normalize.gemini)


@query
def antigravity_usage(v: Views) -> DataFrame:
    return _flat(v, views.ANTIGRAVITY, normalize.antigravity)


@query
def copilot_usage(v: Views) -> DataFrame:
    return _flat(v, views.COPILOT, normalize.copilot, normalize.copilot_ttl_odd(F.col("v")).alias("odd_ttl"))


@query
def cursor_bubble_usage(v: Views) -> DataFrame:
    return _flat(v, views.BUBBLE, normalize.cursor_bubble)


@query
def cursor_hook_usage(v: Views) -> DataFrame:
    both = normalize.Normaliser(normalize.SNAKE, lambda f: F.struct(normalize.cursor_hook.use(f).alias("u"), normalize.hook_trusted.use(f).alias("trusted")))
    rows = both.on(_usage(v, views.HOOK).select(*KEYS, "v"), "v", "found").select(*KEYS, "found.u", "found.trusted")
    return rows.select(*KEYS, F.col("u").isNotNull().alias("valid"), *[F.col(f"u.{c}").alias(c) for c in usage.COUNTERS], "trusted")


@query
def cloud_usage(v: Views) -> DataFrame:
    rows = normalize.with_cloud_api(_usage(v, views.CLOUD).select(*KEYS, "v"), "v", "u")
    return rows.select(*KEYS, F.col("u").isNotNull().alias("valid"), *[F.col(f"u.{c}").alias(c) for c in usage.COUNTERS])


@query
def bridge_usage(v: Views) -> DataFrame:
    return records.usage.on(_usage(v, views.BRIDGE).select(*KEYS, "v"), "v", "u").select(*KEYS, "u.*")


@query
def bridge_payload_tokens(v: Views) -> DataFrame:
    return records.payload_tokens.on(_usage(v, views.PAYLOAD).select(*KEYS, "v"), "v", "u").select(*KEYS, "u.*")


def _chat(v: Views) -> DataFrame:
    return v.records(views.CHAT_SQL, "conversations").withColumn("v", F.try_parse_json("j"))


@query
def bridge_roles(v: Views) -> DataFrame:
    r = F.col("v")
    return _chat(v).select("conv_id", "turn", records.role(r).alias("role"), records.model(r).alias("model"), records.timestamp(r).alias("ts"), records.request_id(r).alias("request_id"), records.record_type(r).isin(records.SKIP_TYPES).alias("skipped"))


@query
def bridge_tool_calls(v: Views) -> DataFrame:
    return _chat(v).withColumn("call", records.tool_call(F.col("v"))).where("call is not null").select("conv_id", "turn", "call.*")


@query
def message_texts(v: Views) -> DataFrame:
    return _chat(v).select("conv_id", "turn", normalize.text_of(normalize.get(F.col("v"), "$.body", "variant")).alias("text"))


@query
def text_functions(v: Views) -> DataFrame:
    """Paths, times, labels and prompts of a page's url and number."""
    p = v.table("pages")
    n, url = F.col("page_id"), F.col("url")
    word = F.regexp_replace(url, "[^A-Za-z0-9]", "")
    tagged = F.when(n % 3 == 0, F.concat(F.lit("x <USER_REQUEST> "), word, F.lit(" </USER_REQUEST> y"))).when(n % 3 == 1, F.concat(F.lit("<USER_REQUEST>  "), word)).otherwise(word)
    return p.select(
        "page_id", text.project_hash(url).alias("project_hash"), text.unquoted(F.when(n % 2 == 0, F.concat(F.lit('"'), word, F.lit('"'))).otherwise(word)).alias("argument"),
        text.antigravity_prompt(tagged).alias("prompt"), text.file_uri_path(F.concat(F.lit("file:///home/a%20b/"), word)).alias("path"),
        text.earliest(F.when(n % 2 == 0, F.lit("")).otherwise(url), F.when(n % 3 == 0, F.lit("")).otherwise(word)).alias("earliest"),
        text.skill_of_path(F.concat(F.when(n % 2 == 0, F.lit("/home/skills/")).otherwise(F.lit("/home/other/")), F.substring(word, 1, 12), F.lit("/SKILL.md"))).alias("skill"),
        text.activity_label(F.when(n % 3 == 0, F.lit("  ")).when(n % 3 == 1, word), F.when(n % 2 == 0, word)).alias("activity"),
        text.bounded(F.when(n % 4 == 0, F.lit("")).otherwise(word), 30).alias("bounded"),
    )


@query
def day_and_millis(v: Views) -> DataFrame:
    e = v.ev_log()
    iso = F.when(F.col("k") % 10 == 0, F.lit(None)).when(F.col("k") % 10 == 1, F.lit("not a time")).otherwise(F.concat(F.translate("iso", " ", "T"), F.lit("Z")))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select("event_id", text.local_day(iso).alias("day"), text.millis_to_iso(ms).alias("iso"))


@query
def sidechain_paths(v: Views) -> DataFrame:
    c = v.table("conversations")
    path = F.concat(F.lit("/logs/p/s"), F.col("conv_id").cast("string"), F.when(F.col("turn") % 2 == 0, F.lit("/Subagents/x/agent-")).otherwise(F.lit("/other/agent-")), F.col("turn").cast("string"), F.lit(".jsonl"))
    return c.select("conv_id", "turn", text.sidechain(path).alias("s")).select("conv_id", "turn", "s.*")


@query
def json_depths(v: Views) -> DataFrame:
    e = v.ev_log()
    raw = F.concat(F.repeat(F.lit("["), (F.col("k") % 40).cast("int")), F.lit('{"a]": "}\\"["}'), F.repeat(F.lit("]"), (F.col("k") % 40).cast("int")))
    return e.select("event_id", text.json_depth(raw).alias("depth"))


@query
def turn_markdown(v: Views) -> DataFrame:
    turns = segments.fold_turns(v.table("conversations"), ["conv_id"], "turn")
    tools = F.when(F.col("turn_index") % 2 == 0, F.array(F.struct(F.lit("read").alias("name"), F.lit("").alias("input"), F.lit("one\ntwo").alias("result")), F.struct(F.lit("").alias("name"), F.lit("x").alias("input"), F.lit("").alias("result"))))
    return turns.select("conv_id", "turn_index", F.md5(text.turn_markdown(F.lit("Claude-Code"), F.lit(""), F.coalesce("prompt", F.lit("")), tools, F.col("assistant"))).alias("digest"))


@query
def price_provider_spellings(v: Views) -> DataFrame:
    forms = ["{}", "openrouter/{}", "us.anthropic.{}", "openrouter/aus.anthropic.{}", "anthropic.{}", "eu1.anthropic.{}", "xx/yy/anthropic.{}", "openai.{}"]
    part = v.table("part").select("p_brand").distinct()
    models = part.select("p_brand", F.explode(F.array(*[F.concat(F.lit(f.split("{}")[0]), "p_brand") for f in forms])).alias("model"))
    return models.join(pricing.rate_table(models, v.prices()), "model", "left").select("model", "key")


# --- agents and index tables --------------------------------------------------------------------------


def _with_agents(v: Views) -> DataFrame:
    """Priced requests of which some belong to subagents, with a segment."""
    rows = v.priced()
    agent = F.when(F.col("output") % 3 == 0, F.concat(F.lit("agent-"), (F.col("output") % 7).cast("string")))
    kind = F.when(agent.isNotNull(), F.concat(F.lit("type"), (F.col("output") % 7 % 3).cast("string")))
    return rows.withColumns({"agent": agent, "agent_type": kind, "segment": F.col("output") % 5})


@query
def agents_by_type(v: Views) -> DataFrame:
    return agents.by_type(_with_agents(v), ["label"]).select("label", "agent_type", "count", "requests", "output", "cost", "partial")


@query
def subagent_cost_by_label(v: Views) -> DataFrame:
    return agents.cost_by_label(_with_agents(v))


@query
def report_order(v: Views) -> DataFrame:
    rows = _with_agents(v).groupBy("project", "model").agg(F.sum(F.when(F.col("model") != "Brand#35", F.col("cost"))).cast("long").alias("cost"), F.sum("output").cast("long").alias("output"), F.min("ord").alias("first"))
    return agents.in_report_order(rows, ["project"], "first").select("project", "model", "rank")


@query
def subagent_stops(v: Views) -> DataFrame:
    e = v.ev_log().where("event_type in ('click', 'view')").withColumns({"generation": F.floor(F.col("event_id") / 50).cast("long"), "agent": F.when(F.col("k") % 5 != 0, (F.col("k") % 5).cast("string"))})
    return agents.first_stops(e, ["session"], "generation", "agent", ["ts", "event_id"]).select("session", "generation", "agent", "event_id")


@query
def index_sessions(v: Views) -> DataFrame:
    found = summary.index_tables(_with_agents(v))["session"]
    return found.withColumn("first_ts", F.date_format("first_ts", "yyyy-MM-dd"))


@query
def index_labels(v: Views) -> DataFrame:
    return summary.index_tables(_with_agents(v))["label"].drop("first_ts")


@query
def index_days(v: Views) -> DataFrame:
    return summary.index_tables(_with_agents(v))["day"].drop("first_ts")


@query
def index_models(v: Views) -> DataFrame:
    return summary.index_tables(_with_agents(v))["model"].drop("first_ts")


@query
def history_from_index(v: Views) -> DataFrame:
    tables = summary.index_tables(_with_agents(v))
    found = [summary.history(tables, by).select(F.lit(by).alias("grain"), F.col("key").cast("string").alias("key"), "calls", "requests", "cost", "partial") for by in ("project", "day", "model", "label")]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query
def top_commands(v: Views) -> DataFrame:
    found = summary.top_commands(summary.index_tables(_with_agents(v))["label"])
    return rollup.top(found, 3).select("rank", "key", "sessions", "calls", "cost", "partial")


@query
def project_baseline(v: Views) -> DataFrame:
    return summary.project_baseline(summary.index_tables(_with_agents(v)))


# --- bridge state -------------------------------------------------------------------------------------


def _generations(v: Views) -> DataFrame:
    """Counters of generations that report more than once, with turn numbers."""
    e = v.ev_log().withColumns({"generation": F.floor(F.col("event_id") / 3).cast("long"), "turn": F.col("event_id") % 17, "flag": F.col("k") % 2 == 0})
    return e.select("session", "generation", "turn", "flag", "event_id", "event_type", F.col("k").alias("input"), (F.col("k") % 13).alias("output"), (F.col("k") % 7 * 9).alias("cache_read"), (F.col("k") % 3).alias("cache_write"))


@query
def generation_max(v: Views) -> DataFrame:
    return bridge.generation_max(_generations(v), ["session"], "generation", "flag")


@query
def turn_usage_sum(v: Views) -> DataFrame:
    return _generations(v).groupBy("session").agg(*[F.sum(c).cast("long").alias(c) for c in bridge.COUNTERS])


@query
def combined_usage(v: Views) -> DataFrame:
    rows = _generations(v)
    covered = rows.where("event_type = 'signup'")
    return bridge.combined_usage(covered, rows.where("event_type <> 'signup'"), covered, ["session"], "turn", "flag")


@query
def distinct_warnings(v: Views) -> DataFrame:
    rows = v.ev_log().withColumn("warning", F.concat(F.lit("w"), (F.col("k") % 9).cast("string")))
    return bridge.distinct_warnings(rows, ["session"], "warning", "event_id").select("session", "warning", "place")


@query
def session_identity(v: Views) -> DataFrame:
    e = v.ev_log()
    rows = e.select("session", "event_id", F.when(F.col("k") % 4 == 0, F.concat(F.lit("m"), F.col("k").cast("string"))).otherwise("").alias("model"), F.when(F.col("k") % 7 == 0, F.concat(F.lit("/d"), F.col("k").cast("string"))).alias("cwd"), F.when(F.col("k") % 5 != 0, F.col("iso")).otherwise("").alias("ts"))
    return bridge.identity(rows, ["session"], "event_id")


@query
def session_start_min(v: Views) -> DataFrame:
    rows = v.ev_log().withColumn("start", F.when(F.col("k") % 5 == 0, F.lit("")).otherwise(F.col("iso")))
    return bridge.session_start(rows, ["session"], "start")


@query
def stale_snapshots(v: Views) -> DataFrame:
    rows = v.ev_log().withColumns({"stage": F.col("k") % 3, "turn": F.floor(F.col("k") / 10)})
    return bridge.not_stale(rows, ["session"], ["ts", "event_id"], ["turn", "stage"]).select("session", "event_id")


@query
def transcript_totals(v: Views) -> DataFrame:
    rows = _generations(v).withColumn("covered", F.floor(F.col("event_id") / 40) + F.col("input") % 3)
    return bridge.guarded_totals(rows, ["session"], ["event_id"], "covered", ["input", "output"])


@query
def outbox_order(v: Views) -> DataFrame:
    rows = v.ev_log().select(F.col("iso").alias("created_at"), F.concat_ws(":", "session", "event_id").alias("source_id"), F.col("event_type").alias("target"))
    found = bridge.outbox_order(rows, "purchase", 50)
    return found.withColumn("n", F.row_number().over(Window.orderBy("created_at", "source_id")).cast("long")).select("source_id", "n")


@query
def turn_segment_usage(v: Views) -> DataFrame:
    rows = v.segments()
    named = rows.where("event_type = 'signup'").select("session", (F.col("k") % 20).alias("turn"), "seg_id")
    bears = rows.where("event_type = 'purchase'").select("session", "event_id", (F.col("k") % 20).alias("turn"), F.col("seg_id").alias("running"))
    return bridge.turn_segments(bears, named, ["session"], "turn", "running", "seg_id").select("session", "event_id", "seg_id")


# --- cloud --------------------------------------------------------------------------------------------


def _cloud(v: Views) -> DataFrame:
    return v.records(views.CLOUD_EVENT_SQL.replace(", 'g')", ")"), "events").withColumn("v", F.try_parse_json("j"))


@query
def cloud_clean_events(v: Views) -> DataFrame:
    found = cloud.clean_events(_cloud(v))
    kept = F.try_parse_json("event")
    return found.select("agent", "ms", normalize.get(kept, "$.type").alias("type"), normalize.get(kept, "$.model").alias("model"), F.col("event").contains("userEmail").alias("leaks"))


@query
def cloud_segments(v: Views) -> DataFrame:
    return cloud.segments(cloud.clean_events(_cloud(v)))


@query
def cloud_known_agents(v: Views) -> DataFrame:
    e = v.ev_log()
    return cloud.known_agents(e.where("event_type = 'click'").select(F.col("session").alias("agent")), e.where("event_type = 'error' and k > 90").select(F.col("session").alias("agent")))


@query
def cloud_sync(v: Views) -> DataFrame:
    e = v.ev_log().select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "k")
    middle, end = 1_705_000_000_000, 1_705_900_000_000
    fresh = e.where((F.col("ms") >= middle) & (F.col("ms") < end) & (F.col("event_id") % 2 == 0)).withColumn("k", F.lit(-1).cast("long"))
    return cloud.sync(e, fresh, middle, end).select("event_id", "k")


# --- disclosure ---------------------------------------------------------------------------------------


@query
def all_unmeasured(v: Views) -> DataFrame:
    """Sessions of which every known level is activity only, and the default level of a runtime that names none."""
    from .disclosure import all_unmeasured as every
    from .disclosure import default_level

    level = F.when(F.col("session") % 5 == 0, "activity_only").when(F.col("event_type") == "purchase", "exact").when(F.col("event_type") == "error", "activity_only")
    runtime = F.when(F.col("session") % 2 == 0, "cursor").otherwise("claude")
    rows = v.ev_log().select("session", default_level(level, runtime).alias("measurement"))
    return every(rows, ["session"])
