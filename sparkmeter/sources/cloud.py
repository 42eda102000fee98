"""Cloud usage events: cleaned, kept as a ledger, merged by time window, and as segments of conversation and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.normalize import get, with_cloud_api
from ..operators.joins import replace_window
from ..operators.usage import COUNTERS

#: Fixed names: fields of an event that are kept (never an e-mail address), the form of an agent's id.
EVENT_FIELDS = ["timestamp", "cloudAgentId", "conversationId", "automationId", "model", "kind", "maxMode", "requestsCosts", "isTokenBasedCall", "isChargeable", "isHeadless", "tokenUsage", "chargedCents", "cursorTokenFee", "product"]
AGENT_ID = r"^bc-[A-Za-z0-9-]{8,80}$"
#: What a sync reads again before the last event, and the label of calls without an automation.
OVERLAP_MS, LABEL = 3 * 3600 * 1000, "(cloud agent)"


def clean_events(events: DataFrame) -> DataFrame:
    """Events (column ``v``) of well-formed agents, with the kept fields only and the type ``usage``; ``agent`` and ``ms`` beside them."""
    v = F.col("v")
    agent = F.transform(F.array(get(v, "$.cloudAgentId", "variant")), lambda x: F.when(F.schema_of_variant(x) == "STRING", get(x, "$")))[0]
    named = events.select(F.inline(F.array(F.struct(agent.alias("agent"), v.alias("v")))))  # a filter on it is not pushed below, where the record would be made and parsed again
    fields = F.map_filter(F.try_variant_get(v, "$", "map<string, variant>"), lambda name, _: name.isin(EVENT_FIELDS))
    kept = F.map_concat(fields, F.create_map(F.lit("type"), F.parse_json(F.lit('"usage"'))))
    return named.where(F.col("agent").rlike(AGENT_ID)).select("agent", millis(v).alias("ms"), F.to_json(kept).alias("event"), "v")


def millis(v: Column) -> Column:
    return _millis(get(v, "$.timestamp", "variant"))


def _millis(at: Column) -> Column:
    return F.transform(F.array(at), lambda x: F.coalesce(get(x, "$", "bigint"), get(x, "$").try_cast("bigint")))[0]


def read_ledger(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Last metadata row of each agent's file, and its usage rows, from one scan (path, ord, v)."""
    kind = get(F.col("v"), "$.type")
    meta = lines.where(kind == "agent").groupBy("path").agg(F.max_by(F.struct(get(F.col("v"), "$.id").alias("agent"), get(F.col("v"), "$.name").alias("name")), "ord").alias("m")).select("path", "m.*")
    return meta, lines.where(kind == "usage")


def known_agents(fetched: DataFrame, ledgers: DataFrame, column: str = "agent") -> DataFrame:
    """Agents that the source names now or that have a ledger already."""
    return fetched.select(column).union(ledgers.select(column)).distinct()


def sync_start(ledger: DataFrame, since_ms: int) -> int:
    """Where a sync begins to read: some hours before the last event it knows, or at ``since_ms``."""
    last = ledger.agg(F.max("ms").alias("m")).first()["m"]
    return since_ms if last is None else max(since_ms, last - OVERLAP_MS)


def sync(ledger: DataFrame, fetched: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """The ledger with what the source now says about a time window; an empty answer erases nothing."""
    return replace_window(ledger, fetched, "ms", F.lit(start_ms), F.lit(end_ms))


def segments(events: DataFrame) -> DataFrame:
    """One row for each conversation, local day and model: label of the segment's first event, counters, charge in dollars, partial flag."""
    fields = "cloudAgentId string, conversationId string, automationId string, model string, timestamp variant, chargedCents variant, tokenUsage variant"
    rows = events.select(get(F.col("v"), "$", f"struct<{fields}>").alias("o"))
    charges = F.array("o.chargedCents", get(F.col("o.tokenUsage"), "$.totalCents", "variant"))
    cents = F.filter(F.transform(charges, lambda x: F.when(F.schema_of_variant(x).rlike("BIGINT|DOUBLE|DECIMAL"), get(x, "$", "double"))), lambda c: c.isNotNull())
    automation = F.nullif("o.automationId", F.lit(""))
    rows = with_cloud_api(rows.withColumn("t", F.col("o.tokenUsage")), "t", "usage").select(
        F.col("o.cloudAgentId").alias("agent"), F.coalesce(F.nullif("o.conversationId", F.lit("")), F.lit("(no conversation)")).alias("conversation"), F.coalesce("o.model", F.lit("unknown")).alias("model"),
        _millis(F.col("o.timestamp")).alias("ms"), F.coalesce(F.concat(F.lit("automation:"), automation), F.lit(LABEL)).alias("label"), "usage", F.get(cents, 0).alias("cents"),
    ).withColumn("iso", text.millis_to_iso(F.col("ms"))).withColumn("day", text.local_day(F.col("iso")))
    segment = ["agent", "conversation", "day"]
    sums = [F.coalesce(F.sum(f"usage.{c}"), F.lit(0)).cast("long").alias(c) for c in COUNTERS]
    charge = F.round(F.sum(F.coalesce("cents", F.lit(0.0))) / 100, 9).alias("charge")
    partial = F.bool_or(F.col("usage").isNull() | F.col("cents").isNull()).alias("partial")
    found = rows.groupBy(*segment, "model").agg(*sums, F.count("*").cast("long").alias("requests"), charge, partial, F.min(F.struct("ms", "label")).alias("first"))
    return found.withColumn("label", F.min("first").over(Window.partitionBy(*segment))["label"]).drop("first")
