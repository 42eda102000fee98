"""Subagents: by type, by label, and the first stop of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rollup import aggregates


def by_type(rows: DataFrame, scope: list[str], agent: str = "agent", kind: str = "agent_type") -> DataFrame:
    """Agents of each type: how many, bucket sums, cost."""
    own = rows.where(F.col(agent).isNotNull())
    return own.groupBy(*scope, kind).agg(F.countDistinct("session", agent).cast("long").alias("count"), *aggregates())


def cost_by_label(rows: DataFrame, agent: str = "agent") -> DataFrame:
    """Each label's cost, own and of its subagents, and how many these are."""
    whole = F.sum("cost").cast("long")
    agents = F.coalesce(F.sum(F.when(F.col(agent).isNotNull(), F.col("cost"))), F.lit(0)).cast("long")
    return rows.groupBy("label").agg(whole.alias("cost"), agents.alias("agent_cost"), F.countDistinct(F.when(F.col(agent).isNotNull(), F.struct("session", agent))).cast("long").alias("subagents"))


def first_stops(events: DataFrame, scope: list[str], generation: str, agent: str, order: list[str]) -> DataFrame:
    """The first stop of each subagent in its generation; an agent without an id is one agent."""
    named = events.withColumn(agent, F.coalesce(F.col(agent), F.lit("unknown")))
    n = F.row_number().over(Window.partitionBy(*scope, generation, agent).orderBy(*order))
    return named.withColumn("_n", n).where("_n = 1").drop("_n")


def in_report_order(rows: DataFrame, scope: list[str], first: str) -> DataFrame:
    """Rank in a report: cost falling, output in millions where there is none or it is zero, then first appearance."""
    weight = F.coalesce(F.nullif(F.col("cost").cast("double") / 1e9, F.lit(0.0)), F.col("output") / F.lit(1e6))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(weight.desc(), first)).cast("long"))
