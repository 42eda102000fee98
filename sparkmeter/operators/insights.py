"""Rules over rollups; each gives finding rows (rule, severity, subject, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the rules (fixed values).
OUTLIER_INFO, OUTLIER_WARN, BASELINE_LEAST, RATIO_DROP = 2.0, 3.0, 5, 0.20
ADHOC_SHARE, FANOUT_SHARE, PACE_FROM, TREND, TREND_WARN, MOVER_SHARE = 0.5, 0.7, 0.75, 0.25, 0.5, 0.3


def _finding(rows: DataFrame, rule: str, severity: Column | str, subject: Column, value: Column, when: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return rows.where(F.coalesce(when, F.lit(False))).select(F.lit(rule).alias("rule"), level.alias("severity"), subject.cast("string").alias("subject"), value.cast("double").alias("value"))


def cost_outlier(sessions: DataFrame) -> DataFrame:
    """Sessions (``session, cost, baseline, n``) that cost twice (warn: three times) the median of five or more others."""
    ratio = F.try_divide(F.col("cost").cast("double"), F.col("baseline").cast("double"))
    return _finding(sessions, "cost-outlier", F.when(ratio >= OUTLIER_WARN, "warn").otherwise("info"), F.col("session"), ratio, (F.col("n") >= BASELINE_LEAST) & (ratio >= OUTLIER_INFO))


def cache_regression(labels: DataFrame) -> DataFrame:
    """Labels (``label, ratio, baseline_ratio, n``) whose cache ratio fell by 0.20 or more."""
    drop = F.col("baseline_ratio") - F.col("ratio")
    return _finding(labels, "cache-regression", "warn", F.col("label"), drop, (F.col("n") >= BASELINE_LEAST) & (drop >= RATIO_DROP))


def adhoc_share(labels: DataFrame, adhoc: str, by: str = "session") -> DataFrame:
    """Scopes in which work without a command makes half of the cost or more."""
    shares = labels.groupBy(by).agg(F.sum(F.when(F.col("label") == adhoc, F.col("cost"))).alias("own"), F.sum("cost").alias("whole"))
    share = F.try_divide(F.col("own").cast("double"), F.col("whole").cast("double"))
    return _finding(shares, "adhoc-dominance", "info", F.col(by), share, share >= ADHOC_SHARE)


def agent_fanout(labels: DataFrame) -> DataFrame:
    """Labels (``label, agent_cost, cost``) with 70 % or more of their cost in subagents."""
    share = F.try_divide(F.col("agent_cost").cast("double"), F.col("cost").cast("double"))
    return _finding(labels, "agent-fanout", "info", F.col("label"), share, share >= FANOUT_SHARE)


def budget_pace(sessions: DataFrame, budget: int) -> DataFrame:
    """Sessions at three quarters of a budget or more, but below it."""
    share = F.col("cost").cast("double") / F.lit(float(budget))
    return _finding(sessions, "budget-pace", "info", F.col("session"), share, (share >= PACE_FROM) & (share < 1))


def spend_trend(halves: DataFrame, subject: str) -> DataFrame:
    """Scopes (``before, after``) whose cost changed by a quarter or more; half or more upwards warns."""
    change = F.try_divide((F.col("after") - F.col("before")).cast("double"), F.col("before").cast("double"))
    return _finding(halves, "spend-trend", F.when(change >= TREND_WARN, "warn").otherwise("info"), F.col(subject), change, (F.col("before") > 0) & (F.abs(change) >= TREND))


def top_mover(halves: DataFrame, label: str = "label") -> DataFrame:
    """The label behind a rise of spend, if it explains three tenths of it or more."""
    from .rollup import top_mover as mover

    found = mover(halves, label)
    return _finding(found, "top-mover", "info", F.col("label"), F.col("share"), F.col("share") >= MOVER_SHARE)


def unpriced_models(models: DataFrame) -> DataFrame:
    """One finding if any model has no rate."""
    found = models.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("model")), ", ").alias("names"))
    return _finding(found, "unpriced-models", "warn", F.col("names"), F.col("n"), F.col("n") > 0)


def in_order(findings: list[DataFrame]) -> DataFrame:
    """All findings, warnings first, then by rule."""
    out = findings[0]
    for more in findings[1:]:
        out = out.unionByName(more)
    return out.orderBy(F.when(F.col("severity") == "warn", 0).otherwise(1), "rule", "subject")
