"""User-visible queries over requests of any adapter: report, history, top consumers, insights, diff, export, dashboard.

Requests: session, project, label, model, day, ts, the counters and ``requests``. Every function gives a
DataFrame; nothing is collected here.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import insights as rules
from ..operators import joins, pricing, rollup
from ..operators.usage import BUCKET

GRAINS = {"project": "project", "day": "day", "model": "model", "command": "label", "session": "session"}
#: Rates are dollars for a million tokens; costs are carried in billionths of a dollar.
NANO = 1000


class OptionError(ValueError):
    """Options that do not go together, or have no such value."""


def since_cutoff(since: str | None, now: datetime | None = None) -> str | None:
    """``Nd`` (0 to 36500 days before now, UTC) or an ISO date; the cutoff is compared with raw start times as text."""
    if since is None:
        return None
    if match := re.fullmatch(r"(\d+)d", since):
        if int(match[1]) > 36500:
            raise OptionError(f"too many days: {since}")
        return ((now or datetime.now(timezone.utc)) - timedelta(days=int(match[1]))).strftime("%Y-%m-%dT%H:%M:%SZ")
    try:
        datetime.fromisoformat(since.replace("Z", "+00:00"))
    except ValueError as error:
        raise OptionError(f"neither Nd nor an ISO date: {since}") from error
    return since


def window_middle(cutoff: str, now: datetime | None = None) -> str:
    """Middle between a cutoff and now, whole seconds, as text that compares with start times."""
    first = datetime.fromisoformat(cutoff.replace("Z", "+00:00"))
    first = first if first.tzinfo else first.replace(tzinfo=timezone.utc)
    return (first + ((now or datetime.now(timezone.utc)) - first) / 2).strftime("%Y-%m-%dT%H:%M:%SZ")


def with_cost(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Requests with ``cost`` in nano-dollars (exact sums), null without a rate."""
    rated = prices.select("key", *[(F.col(c) * NANO).alias(c) for c in ("rate_in", "rate_out", "rate_read")])
    return pricing.priced(requests, rated).withColumn("cost", F.round(pricing.cost()).cast("long")).drop("key", "rate_in", "rate_out", "rate_read")


def window(requests: DataFrame, cutoff: str | None = None, project: str | None = None, exclude: str | None = None) -> DataFrame:
    """Sessions that began at the cutoff or later (text order; none without a start time), in projects that contain a string."""
    rows = requests
    if project is not None:
        rows = rows.where(F.col("project").contains(project))
    if exclude is not None:
        rows = rows.where(F.col("session") != exclude)
    if cutoff is None:
        return rows
    late = rows.groupBy("session").agg(F.min("ts").alias("_first")).where(F.col("_first") >= F.lit(cutoff)).select("session")
    return rows.join(late, "session", "left_semi")


def dollars(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.col(n) / F.lit(1e9) for n in names or ("cost",)})


def history(priced: DataFrame, by: str, labels: DataFrame | None = None) -> DataFrame:
    """Rows of a grain, the most expensive first (a range sort): calls, bucket sums, cost, partial flag.

    ``labels`` (session, label, invocations) of the sessions in question, where an index has them: a command's calls are its
    invocations, with usage or not.
    """
    if by not in GRAINS:
        raise OptionError(f"no such grain: {by}")
    if by == "command" and labels is not None:
        return _with_invocations(rollup.history(priced, "label").drop("calls"), labels).drop("sessions").orderBy(*rollup.history_order())
    calls: Column | None = F.sum("requests") if by == "model" else F.countDistinct("session", "segment") if by == "command" and "segment" in priced.columns else None
    return rollup.history(priced, GRAINS[by], calls).orderBy(*rollup.history_order())


def _with_invocations(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows by label with invocations as ``calls`` and ``sessions``; a label that never used a token costs nothing."""
    counts = labels.groupBy(F.col("label").alias("_label")).agg(F.sum("invocations").cast("long").alias("calls"), F.countDistinct("session").cast("long").alias("sessions"))
    both = rows.join(counts, F.col("key").eqNullSafe(F.col("_label")), "full_outer")
    used = F.col("requests").isNotNull()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("calls", "sessions", *BUCKET)]
    return both.select(F.coalesce("key", "_label").alias("key"), *zero, F.when(used, F.col("cost")).otherwise(F.lit(0)).cast("long").alias("cost"), F.coalesce("partial", F.lit(False)).alias("partial"))


def report(priced: DataFrame, session: str) -> DataFrame:
    """One session: rows by label, by label and model, and the total."""
    return rollup.label_breakdown(priced.where(F.col("session") == session)).where(F.coalesce(F.col("requests"), F.lit(0)) > 0)


def top_consumers(priced: DataFrame, by: str = "session", n: int = 10, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The n most expensive sessions or commands, and how many rows of unknown cost the cut hides.

    A command's row tells its sessions and, from an index, its invocations as calls; a session's its requests.
    """
    if by not in ("session", "command"):
        raise OptionError(f"no such grain: {by}")
    rows = rollup.history(priced, GRAINS[by], F.sum("requests"))
    if by == "command" and labels is not None:
        rows = _with_invocations(rows.drop("calls"), labels)
    shown = rollup.top(rows, n)
    return shown, rollup.cut_rows(rows, shown)


def diff(priced: DataFrame, old: str, new: str) -> DataFrame:
    """Label by label comparison of two sessions."""
    by = priced.where(F.col("session").isin(old, new)).groupBy("session", "label").agg(F.sum("cost").cast("long").alias("cost"))
    return joins.diff(by.where(F.col("session") == old).drop("session"), by.where(F.col("session") == new).drop("session"))


#: Days that a baseline looks back (fixed value).
BASELINE_DAYS = 30


def session_insights(priced: DataFrame, session: str, budget: float | None = None, now: datetime | None = None) -> DataFrame:
    """Findings about one session against the medians of the other sessions of its project in the last 30 days."""
    mine = priced.where(F.col("session") == session)
    others = priced.join(mine.select("project").distinct(), "project", "left_semi")
    others = window(others, since_cutoff(f"{BASELINE_DAYS}d", now), exclude=session)
    costs = others.groupBy("project", "session").agg(F.sum("cost").cast("long").alias("cost"))
    base = rollup.median(costs, ["project"], "cost", "baseline")
    own = mine.groupBy("project", "session").agg(F.sum("cost").cast("long").alias("cost"))
    ratio = rollup.cache_ratio()
    sums = [F.sum(c).alias(c) for c in BUCKET]
    labels = mine.groupBy("label").agg(*sums).withColumn("ratio", ratio)
    known = others.groupBy("label", "session").agg(*sums, F.sum("cost").alias("cost")).where("cost is not null").withColumn("ratio", ratio)
    known = rollup.median(known, ["label"], "ratio", "baseline_ratio")
    found = [rules.cost_outlier(own.join(base, "project")), rules.cache_regression(labels.join(known, "label")), rules.adhoc_share(mine, "(no command)")]
    found.append(rules.unpriced_models(mine.where(F.col("cost").isNull() & pricing.has_tokens()).select("model").distinct()))
    if "agent" in mine.columns:
        agents = F.sum(F.when(F.col("agent").isNotNull(), F.col("cost")))
        found.append(rules.agent_fanout(mine.groupBy("label").agg(agents.alias("agent_cost"), F.sum("cost").alias("cost"))))
    if budget:
        found.append(rules.budget_pace(own, int(budget * 1e9)))
    return rules.in_order(found)


def baseline_sessions(priced: DataFrame, session: str, now: datetime | None = None) -> int:
    """How many other sessions of its project a session is compared with."""
    mine = priced.where(F.col("session") == session).select("project").distinct()
    others = window(priced.join(mine, "project", "left_semi"), since_cutoff(f"{BASELINE_DAYS}d", now), exclude=session)
    return others.where("cost is not null").select("session").distinct().count()


def window_insights(priced: DataFrame, middle: str) -> DataFrame:
    """Findings about a window: spend of sessions that began before and from its middle on, the label behind a rise, unpriced models."""
    placed = priced.join(priced.groupBy("session").agg(F.min("ts").alias("_first")), "session").where("_first is not null")
    halves = rollup.halves(placed.withColumn("all", F.lit("spend")), ["all"], F.lit(middle), "_first")
    movers = rollup.halves(placed, ["label"], F.lit(middle), "_first")
    missing = priced.where(F.col("cost").isNull() & pricing.has_tokens()).select("model").distinct()
    return rules.in_order([rules.spend_trend(halves, "all"), rules.top_mover(movers), rules.unpriced_models(missing)])


def dashboard(priced: DataFrame) -> DataFrame:
    """Top ten of each grain and all days, in one frame (grain, key, cost, rank)."""
    names = {g: c for g, c in GRAINS.items() if g != "session"}
    cells = priced.groupBy(*names.values()).agg(F.sum("cost").alias("cost"))  # few rows, before they are multiplied by grains
    grains = F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), F.col(c).cast("string").alias("key")) for g, c in names.items()])).alias("g")
    long = cells.select(grains, "cost").select("g.*", "cost").groupBy("grain", "key").agg(F.sum("cost").cast("long").alias("cost"))
    tops = rollup.top_of_each(long.where("grain <> 'day'"), "grain", 10)
    return tops.unionByName(long.where("grain = 'day'").withColumn("rank", F.lit(None).cast("long")))


def export_session(priced: DataFrame, session: str, runtime: str, measurement: str = "exact") -> DataFrame:
    """Export records of one session: a record for each label with requests, by name, then the total."""
    mine = priced.where(F.col("session") == session)
    labels = rollup.history(mine, "label", F.sum("requests")).where("requests > 0").withColumn("total", F.lit(False))
    whole = mine.groupBy().agg(*rollup.aggregates()).select(F.lit(None).cast("string").alias("key"), F.col("requests").alias("calls"), "*", F.lit(True).alias("total"))
    return _records(labels.unionByName(whole.select(*labels.columns)), "session", "command", runtime, measurement)


def export(priced: DataFrame, by: str, runtime: str, measurement: str = "exact") -> DataFrame:
    """Export records, one JSON text in each row: a record for each key, then the total."""
    return _records(rollup.with_total(priced, GRAINS[by]), "history", by, runtime, measurement)


def _records(rows: DataFrame, scope: str, by: str, runtime: str, measurement: str) -> DataFrame:
    names = {"schema": F.lit("sparkmeter.aggregate.v1"), "runtime": F.lit(runtime), "scope": F.lit(scope), "key": F.when(F.col("total"), F.lit("total")).otherwise(F.col("key").cast("string")), "group_by": F.lit(by), "measurement": F.lit(measurement)}
    metrics = F.struct("input", "output", "cache_read", (F.col("cache_5m") + F.col("cache_1h")).alias("cache_write"), "requests", (F.col("cost") / F.lit(1e9)).alias("cost_usd"), "partial")
    record = F.struct(*[c.alias(n) for n, c in names.items()], metrics.alias("metrics"))
    return rows.orderBy("total", "key").select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))
