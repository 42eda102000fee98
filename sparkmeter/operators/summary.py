"""The summary index: four tables that hold all that history, tops, insights and dashboards need.

One row for each session, and for each session with a label, model or day. Sums of these rows are what the
same sums over requests are, so a query reads the index and no request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rollup import aggregates, median
from .usage import BUCKET

GRAINS = ("label", "model", "day")


def _costs() -> list[Column]:
    return [*aggregates(), F.min("ts").alias("first_ts")]


def index_tables(priced: DataFrame) -> dict[str, DataFrame]:
    """``session``, ``label``, ``model`` and ``day`` tables of priced requests (project, session, segment, label, model, day, ts, bucket, cost)."""
    calls = F.countDistinct("segment").cast("long").alias("invocations") if "segment" in priced.columns else F.count("*").cast("long").alias("invocations")
    tables = {"session": priced.groupBy("project", "session").agg(*_costs(), calls)}
    for grain in GRAINS:
        tables[grain] = priced.groupBy("project", "session", grain).agg(*_costs(), *([calls] if grain == "label" else []))
    return tables


def merged(rows: DataFrame, key: str, calls: Column, *more: Column) -> DataFrame:
    """History rows of a grain from its index table: sums of sums, unknown cost stays unknown, any part partial makes the whole partial."""
    return rows.groupBy(F.col(key).alias("key")).agg(
        calls.cast("long").alias("calls"), *[F.sum(c).cast("long").alias(c) for c in BUCKET], F.sum("cost").cast("long").alias("cost"), F.bool_or("partial").alias("partial"), *more
    )


def history(tables: dict[str, DataFrame], by: str) -> DataFrame:
    """The rows of ``history`` by project, session, day, model or label, read from the index."""
    if by in ("project", "session"):
        return merged(tables["session"], by, F.count("*"))
    calls = {"day": F.count("*"), "model": F.sum("requests"), "label": F.sum("invocations")}[by]
    return merged(tables[by], by, calls)


def top_commands(label_table: DataFrame) -> DataFrame:
    """Each command's sessions, invocations, sums, cost and partial flag."""
    return merged(label_table, "label", F.sum("invocations"), F.count("*").cast("long").alias("sessions"))


def project_baseline(tables: dict[str, DataFrame], by: str = "project") -> DataFrame:
    """Median session cost, and how many sessions have one, for each project."""
    return median(tables["session"], [by], "cost", "median_cost").withColumnRenamed("n", "sessions")
