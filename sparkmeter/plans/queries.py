"""One query for each operator family, over the stand-in views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import insights, joins, pricing, rollup, segments, usage
from ..session import durable
from . import api
from .bench_views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
MIDDLE = "1995-06-30 00:00:00"
#: A middle with less spend before it than after it.
RISING = "1997-01-01 00:00:00"


def query(f: Callable[[Views], DataFrame]) -> Callable:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
    return f


# --- dedupe and sums ---------------------------------------------------------------------------------


@query
def usage_dedup_max(v: Views) -> DataFrame:
    return v.requests().select("session", "request_id", *usage.BUCKET)


@query
def usage_first_seen_attrs(v: Views) -> DataFrame:
    return v.requests().select("session", "request_id", "label", "model", "day")


@query
def bucket_sums(v: Views) -> DataFrame:
    return usage.sums(["project", "model"], v.requests())


@query
def first_record_per_id(v: Views) -> DataFrame:
    rows = v.req_log().select("session", "request_id", "model", "output", "ord")
    return usage.dedupe_first(rows, ["session"], "request_id", "ord")


@query
def generation_first_usage(v: Views) -> DataFrame:
    e = v.ev_log().withColumn("generation", F.floor(F.col("event_id") / 7).cast("long"))
    bears = F.col("event_type") == "purchase"
    rows = e.select("generation", "event_id", *[F.when(bears, x).alias(c) for c, x in zip(usage.COUNTERS, [F.col("k"), F.col("k") + 1, F.lit(0).cast("long"), F.lit(2).cast("long"), F.lit(0).cast("long")], strict=True)])
    return usage.first_usage_per_generation(rows, [], "generation", "event_id").drop("event_id")


@query
def unmeasured_ids(v: Views) -> DataFrame:
    e = v.ev_log()
    return usage.unmeasured(e.where("event_type = 'error'").select("session"), e.where("event_type = 'purchase' and k > 95").select("session"), ["session"])


# --- pricing -----------------------------------------------------------------------------------------


@query
def price_longest_prefix(v: Views) -> DataFrame:
    return pricing.rate_table(v.table("part").select(F.col("p_brand").alias("model")), v.prices()).select("model", "key", "rate_in", "rate_out")


#: Price layers made from the brands of ``part``: a list with every brand, and one above it for some, of which some rates are no rates.
BUNDLED_SQL = """SELECT p_brand AS key, CAST(min(p_size) * 100 AS BIGINT) AS rate_in, CAST(max(p_size) * 1000 AS BIGINT) AS rate_out, CAST(NULL AS BIGINT) AS rate_read FROM part GROUP BY p_brand"""
OVERLAY_SQL = """SELECT p_brand AS key, CAST(max(p_size) * CASE WHEN p_brand LIKE '%5' THEN -1 ELSE 200 END AS BIGINT) AS rate_in, CAST(count(*) AS BIGINT) AS rate_out,
 CAST(CASE WHEN p_brand LIKE '%3' THEN 0 END AS BIGINT) AS rate_read FROM part WHERE p_brand LIKE '%3' OR p_brand LIKE '%5' GROUP BY p_brand"""


@query
def price_overlay(v: Views) -> DataFrame:
    """Two price layers over all brands; a key of the upper one counts as a whole, and goes if its rates are none."""
    bundled, overlay = (v.sql(text.replace("FROM part", "FROM {part}"), "part") for text in (BUNDLED_SQL, OVERLAY_SQL))
    return pricing.valid_prices(pricing.merged_prices(bundled, overlay))


def _cost_by(v: Views, key: str) -> DataFrame:
    return rollup.history(v.priced(), key)


@query
def cost_by_model(v: Views) -> DataFrame:
    return rollup.history(v.priced(), "model", F.sum("requests"))


@query
def cost_by_project(v: Views) -> DataFrame:
    return _cost_by(v, "project")


@query
def cost_by_label(v: Views) -> DataFrame:
    return _cost_by(v, "label")


@query
def cost_by_day(v: Views) -> DataFrame:
    return _cost_by(v, "day")


@query
def history_ranked(v: Views) -> DataFrame:
    return rollup.in_history_order(_cost_by(v, "label")).select("rank", "key", "cost")


@query
def cost_rollup_total(v: Views) -> DataFrame:
    return rollup.with_total(v.priced(), "project")


@query
def label_model_grouping_sets(v: Views) -> DataFrame:
    return rollup.label_breakdown(v.priced())


@query
def cache_savings(v: Views) -> DataFrame:
    return v.priced().groupBy("label").agg(F.sum(F.round(pricing.savings()).cast("long")).cast("long").alias("saved"))


@query
def cache_ratio_by_label(v: Views) -> DataFrame:
    return usage.sums(["label"], v.requests()).select("label", F.round(rollup.cache_ratio(), 9).alias("ratio"))


@query
def unpriced_models(v: Views) -> DataFrame:
    return pricing.unpriced(v.requests(), v.prices().where("key <> 'Brand'")).select("model")


@query
def charged_override(v: Views) -> DataFrame:
    rows = v.priced().withColumn("charge", F.when(F.col("session") % 7 != 0, F.col("output") * 10))
    return pricing.charged_cost(rows, ["session"])


@query
def partial_flags(v: Views) -> DataFrame:
    rows = pricing.priced(v.requests(), v.prices().where("length(key) = 8"), models=v.models()).withColumn("cost", pricing.nano_cost())
    return rollup.history(rows, "project").select("key", "cost", "partial")


# --- filters, tops, order ----------------------------------------------------------------------------


@query
def history_project_filter(v: Views) -> DataFrame:
    return rollup.history(api.window(v.priced(), project="U"), "project")


@query
def history_since(v: Views) -> DataFrame:
    rows = v.requests().withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))
    return api.window(rows, "1995-02-15").groupBy("session").agg(F.min("ts").alias("first_ts"))


@query
def top_sessions(v: Views) -> DataFrame:
    return rollup.top(rollup.history(v.priced(), "session", F.sum("requests")), 20).select("rank", "key", "calls", "cost", "partial")


@query
def top_labels(v: Views) -> DataFrame:
    return rollup.top(_cost_by(v, "label"), 3).select("rank", "key", "calls", "cost")


@query
def unpriced_cut_count(v: Views) -> DataFrame:
    rows = pricing.priced(v.requests(), v.prices().where("length(key) = 8"), models=v.models()).withColumn("cost", pricing.nano_cost())
    by_model = durable(rollup.history(rows, "model"))  # a row for each model, read twice
    return rollup.cut_rows(by_model, rollup.top(by_model, 8))


@query
def dashboard_top10(v: Views) -> DataFrame:
    return api.dashboard(v.priced()).where("grain <> 'day'").select("grain", "key", "cost", "rank")


@query
def diff_two_sessions(v: Views) -> DataFrame:
    by = v.priced().groupBy("session", "label").agg(F.sum("cost").cast("long").alias("cost"))
    return joins.diff(by.where("session = 1").drop("session"), by.where("session = 2").drop("session"))


# --- medians and rules -------------------------------------------------------------------------------


def _session_costs(v: Views) -> DataFrame:
    return v.priced().groupBy("project", "session").agg(F.sum("cost").cast("long").alias("cost"))


@query
def median_session_cost(v: Views) -> DataFrame:
    return rollup.median(_session_costs(v), ["project"], "cost", "median_cost")


@query
def baseline_by_label(v: Views) -> DataFrame:
    by = v.priced().groupBy("label", "session").agg(F.sum("cost").cast("long").alias("cost"), *[F.sum(c).alias(c) for c in usage.COUNTERS])
    found = rollup.medians(by.withColumn("ratio", rollup.cache_ratio()), ["label"], {"cost": "median_cost", "ratio": "median_ratio"})
    return found.select("label", F.col("n_median_cost").alias("n"), "median_cost", F.round("median_ratio", 9).alias("median_ratio"))


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("value", F.round("value", 6))


@query
def cost_outlier(v: Views) -> DataFrame:
    sessions = durable(_session_costs(v))  # read twice
    base = rollup.median(sessions, ["project"], "cost", "baseline")
    return _rounded(insights.cost_outlier(sessions.join(base, "project")))


@query
def cache_regression(v: Views) -> DataFrame:
    by = v.requests().withColumn("cache_read", F.col("cache_read") * 10).groupBy("label", "request_id").agg(*[F.sum(c).alias(c) for c in usage.COUNTERS]).withColumn("ratio", rollup.cache_ratio())
    base = rollup.median(by, ["label"], "ratio", "baseline_ratio")
    return _rounded(insights.cache_regression(by.join(base, "label").withColumn("label", F.concat_ws("/", "label", "request_id"))))


@query
def adhoc_share(v: Views) -> DataFrame:
    return _rounded(insights.adhoc_share(v.priced(), "1-URGENT"))


@query
def agent_fanout(v: Views) -> DataFrame:
    rows = v.priced().groupBy(F.concat("label", F.lit("/"), "model").alias("label")).agg(F.sum(F.when(F.col("session") % 4 != 0, F.col("cost"))).alias("agent_cost"), F.sum("cost").alias("cost"))
    return _rounded(insights.agent_fanout(rows))


@query
def budget_pace(v: Views) -> DataFrame:
    return _rounded(insights.budget_pace(_session_costs(v), 20_000_000_000))


@query
def spend_trend(v: Views) -> DataFrame:
    halves = rollup.halves(v.priced(), ["model"], F.lit(MIDDLE).cast("timestamp_ntz"))
    return _rounded(insights.spend_trend(halves, "model"))


@query
def top_mover(v: Views) -> DataFrame:
    found = rollup.top_mover(rollup.halves(v.priced(), ["label"], F.lit(RISING).cast("timestamp_ntz")))
    return found.withColumn("share", F.round("share", 9))


@query
def budget_multiple(v: Views) -> DataFrame:
    """Budget multiples newly passed at each day of a project's running cost."""
    by = v.priced().groupBy("project", "day").agg(F.sum("cost").cast("long").alias("cost"))
    window = segments.running(["project"], ["day"])
    multiple = by.withColumn("multiple", F.floor(F.sum("cost").over(window) / F.lit(100_000_000_000)).cast("long"))
    before = F.coalesce(F.lag("multiple").over(Window.partitionBy("project").orderBy("day")), F.lit(0))
    return multiple.withColumn("before", before).where("multiple > before").select("project", "day", "multiple")


# --- sequences ---------------------------------------------------------------------------------------


@query
def sticky_segments(v: Views) -> DataFrame:
    return v.segments().select("event_id", "seg_id")


@query
def skill_first_use(v: Views) -> DataFrame:
    rows = v.ev_log().where("event_type = 'view'").withColumn("use_id", F.col("k") % 10)
    return segments.first_use(rows, ["session"], "use_id", ["ts", "event_id"]).select("session", "use_id", "event_id")


@query
def prompt_backfill(v: Views) -> DataFrame:
    rows = v.table("conversations").where("role = 'user'").withColumn("text", F.when(F.col("turn") % 4 == 0, F.lit("")).otherwise(text.prompt(F.col("text"))))
    return segments.prompt_backfill(rows, ["conv_id"], "text", "turn")


@query
def segment_usage(v: Views) -> DataFrame:
    bought = v.segments().where("event_type = 'purchase'")
    return bought.groupBy("session", "seg_id").agg(F.sum("k").cast("long").alias("output"), F.count("*").cast("long").alias("requests"))


@query
def cumulative_delta(v: Views) -> DataFrame:
    rows = v.ev_log().where("event_type = 'error'")
    return segments.deltas(rows, ["session"], ["ts", "event_id"], ["k"]).select("event_id", F.col("d_k").cast("long").alias("delta"))


@query
def sticky_model(v: Views) -> DataFrame:
    rows = v.ev_log().withColumn("model", F.when(F.col("event_type") == "view", F.concat(F.lit("m"), (F.col("k") % 5).cast("string"))))
    return segments.sticky_value(rows, ["session"], ["ts", "event_id"], "model", "now").select("event_id", "now")


@query
def running_max_remainder(v: Views) -> DataFrame:
    rows = v.ev_log().where("event_type in ('error', 'purchase')")
    captured = F.sum(F.when(F.col("event_type") == "purchase", F.col("k") % 7).otherwise(0)).over(segments.running(["session"], ["ts", "event_id"]))
    shots = rows.withColumn("captured", captured).where("event_type = 'error'")
    return segments.remainders(shots, ["session"], ["ts", "event_id"], "k", "captured").select("event_id", F.col("remainder").cast("long").alias("remainder"))


@query
def turn_folding(v: Views) -> DataFrame:
    return segments.fold_turns(v.table("conversations"), ["conv_id"], "turn")


# --- joins -------------------------------------------------------------------------------------------


def _segment_starts(v: Views) -> DataFrame:
    return v.segments().where("seg_id > 0").groupBy("session", "seg_id").agg(F.min("ts").alias("start_ts"))


def _children(v: Views) -> DataFrame:
    e = v.table("events")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("child_id"), (F.col("ts") - F.make_dt_interval(F.lit(1))).alias("child_ts"))


@query
def asof_child_segment(v: Views) -> DataFrame:
    return joins.asof(_children(v), _segment_starts(v), "session", "child_ts", "child_id", "start_ts", "seg_id").select("session", "child_id", "seg_id")


@query
def last_started_segment(v: Views) -> DataFrame:
    return joins.last_started(_children(v), _segment_starts(v), "session", "child_ts", "child_id", "start_ts", "seg_id")


@query
def orphan_anti(v: Views) -> DataFrame:
    return joins.orphans(v.table("orders"), "o_orderkey", v.table("lineitem"), "l_orderkey").select("o_orderkey")


@query
def coverage_semi(v: Views) -> DataFrame:
    evidence = v.table("lineitem").where("l_quantity > 49").withColumn("named", F.when(F.col("l_linenumber") > 1, F.col("l_orderkey")).otherwise(0))
    return joins.covered(v.table("orders"), "o_orderkey", evidence, "named", "l_suppkey").select("o_orderkey")


@query
def parent_closure(v: Views) -> DataFrame:
    nodes = v.table("orders").select(F.col("o_orderkey").alias("node"))
    step = F.when(F.col("node") % 1000 == 17, F.col("node") + 1).when(F.col("node") % 1000 == 18, F.col("node") - 1)  # cycles of two
    edges = nodes.withColumn("parent", F.coalesce(step, F.floor(F.col("node") / 10).cast("long")))
    known = edges.join(nodes.select(F.col("node").alias("known")), F.col("parent") == F.col("known")).select("node", "parent").where("node <> parent")
    return joins.closure(known, "node", "parent")


@query
def ordered_merge(v: Views) -> DataFrame:
    native = v.table("events").select(F.col("ts"), F.col("event_id").alias("line"))
    ledger = v.table("orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("line"))
    merged = joins.ordered_merge([native, ledger], ["ts", "source_rank", "line"]).withColumn("day", F.to_date("ts"))
    order = Window.partitionBy("day").orderBy("ts", "source_rank", "line")
    return merged.select(F.col("day").cast("string").alias("day"), "source_rank", "line", F.row_number().over(order).cast("long").alias("n"))


@query
def tool_result_match(v: Views) -> DataFrame:
    e = v.ev_log().withColumn("name", (F.col("k") % 3).cast("string"))
    ident = F.when(F.col("k") % 4 == 0, F.col("k"))
    calls, results = e.where("event_type = 'click'").withColumn("id", ident), e.where("event_type = 'view'").withColumn("id", ident)
    columns = ["session", "name", "id", "event_id"]
    return joins.match_results(calls.select(*columns), results.select(*columns), ["session"], "name", "event_id", "id").select("session", "name", "event_id", "result_ord", "synthetic")


@query
def latest_version_wins(v: Views) -> DataFrame:
    rows = v.ev_log().withColumn("stage", F.col("k") % 3)
    return joins.latest_version(rows, ["session"], ["k", "stage", "event_id"], ["event_type"]).select("session", "k", "event_id", "event_type")


@query
def window_replace_merge(v: Views) -> DataFrame:
    e = v.table("events").select("event_id", "ts", "value")
    start, end = F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")
    fresh = e.where((F.col("ts") >= start) & (F.col("ts") < end) & (F.col("event_id") % 3 == 0)).withColumn("value", F.lit(1.0))
    return joins.replace_window(e, fresh, "ts", start, end).select("event_id", "value")


@query
def publish_idempotent(v: Views) -> DataFrame:
    rows = v.ev_log().select("session", "event_type", "k", F.when(F.col("k") % 3 == 0, F.lit("a|b")).when(F.col("k") % 3 == 1, F.lit("")).alias("note"))
    return joins.publish_once(rows.union(rows), ["session"], ["k", "note", "event_type"])


# --- projections and functions -----------------------------------------------------------------------


@query
def json_counters_strict(v: Views) -> DataFrame:
    from ..functions.normalize import counter

    return v.table("events").select("event_id", counter(F.try_parse_json("props"), "$.k").alias("k"))


@query
def measurement_tally(v: Views) -> DataFrame:
    level = F.when(F.col("event_type") == "purchase", "exact").when(F.col("event_type") == "error", "activity_only").otherwise("partial")
    return rollup.measurement_tally(v.ev_log().withColumn("measurement", level), ["session"])


@query
def activity_only_hidden(v: Views) -> DataFrame:
    rows = v.priced().withColumn("measurement", F.when(F.col("session") % 3 == 0, "activity_only").otherwise("exact"))
    return rollup.history(rollup.hide_unmeasured(rows), "project").select("key", "cost", "partial")


@query
def day_split(v: Views) -> DataFrame:
    rows = v.requests().withColumn("day", F.when(F.col("output") % 5 != 0, F.col("day")))
    return rollup.day_split(rows, ["session"])


@query
def export_metrics_long(v: Views) -> DataFrame:
    return rollup.long_metrics(usage.sums(["label"], v.requests()), "label")


@query
def label_regex(v: Views) -> DataFrame:
    lead = F.concat(F.when(F.col("turn") % 2 == 0, F.lit("  /")).otherwise(F.lit("")), F.regexp_replace("text", "[^A-Za-z0-9 ]", ""))
    tagged = F.concat(F.lit("<command-name> "), F.col("role"), F.lit(" </command-name>"))
    return v.table("conversations").select("conv_id", "turn", text.command_label(lead).alias("label"), text.command_tag(tagged).alias("tag"))


@query
def slug(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", text.slug(F.col("url")).alias("slug"), text.safe_id(F.col("url")).alias("safe"))


@query
def clip_text(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.length(text.clip(F.col("text"))).cast("long").alias("n"), F.md5(text.clip(F.col("text"))).alias("digest"))


@query
def repo_from_url(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", text.repo_of_url(F.concat("url", F.lit(".git"))).alias("repo"))


@query
def source_ids(v: Views) -> DataFrame:
    return v.table("conversations").select("conv_id", "turn", text.source_id(F.col("conv_id").cast("string"), F.when(F.col("role") == "assistant", "a1").otherwise(""), F.col("turn")).alias("source_id"))


@query
def surface_map(v: Views) -> DataFrame:
    names = ["Claude", "claude-code", "codex", "other", "", "Grok-Bot", "antigravity", "cloud_agent", None]
    paths = ["/x/a.jsonl", "/home/.Claude/b", "C:\\\\codex\\\\c", "/cloud-agent/d", "/gemini/e", "/grok/f", "/x/claude/g"]
    rows = v.table("conversations").withColumn("runtime", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("turn") % 9 + 1).cast("int")))
    rows = rows.withColumn("path", F.element_at(F.array(*[F.lit(p) for p in paths]), (F.col("conv_id") % 7 + 1).cast("int")))
    runtime, path = F.col("runtime"), F.col("path")
    return rows.select("conv_id", "turn", text.vendor(runtime).alias("vendor"), text.source_type(runtime).alias("source_type"), text.surface(runtime, path).alias("surface"), text.inferred_runtime(path, F.when(F.col("turn") % 2 == 0, runtime)).alias("inferred"))
