"""The additive usage bucket: request dedupe and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ["input", "output", "cache_read", "cache_5m", "cache_1h"]
BUCKET = [*COUNTERS, "requests"]


def dedupe_requests(records: DataFrame, scope: list[str], request: str = "request_id", order: str = "ord", first: list[str] | None = None, dealt: str | None = None) -> DataFrame:
    """One row for each request of a scope: the maximum of every counter, the first record's attributes, requests = 1.

    A streamed request is logged many times with growing counters; summing would count it again and again. A
    record without a request id is a request of its own. Attributes are strings, which Spark aggregates over sorted
    rows: the records are dealt by their key first, so that they are sorted once and not for a partial pass as well.
    ``dealt`` is a column that the request id determines and that the records are dealt by already: they are not dealt again.
    """
    key = F.coalesce(F.col(request), F.concat(F.lit("#"), F.col(order).cast("string")))
    names = first if first is not None else [c for c in ("segment", "label", "model", "day") if c in records.columns and c not in scope]
    keyed = records.withColumn("request_key", key)
    if names and dealt is None:
        keyed = keyed.repartition(*scope, "request_key")
    grouped = keyed.groupBy(*scope, *([dealt] if dealt else []), "request_key")
    first_record = F.min(F.struct(order, *names)).alias("_first")
    found = grouped.agg(*[F.max(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in COUNTERS], first_record)
    return found.select(*scope, "request_key", *COUNTERS, *[F.col(f"_first.{c}").alias(c) for c in [*names, order]], F.lit(1).cast("long").alias("requests"))


def dedupe_first(records: DataFrame, scope: list[str], key: str, order: str) -> DataFrame:
    """The first record of each key in a scope, whole; records without a key all stay."""
    named = [c for c in records.columns if c not in scope and c != key]
    whole = F.min_by(F.struct(*named), order).alias("record")
    kept = records.where(F.col(key).isNotNull()).groupBy(*scope, key).agg(whole).select(*scope, key, *[F.col(f"record.{c}").alias(c) for c in named])
    return kept.unionByName(records.where(F.col(key).isNull()).select(*scope, key, *named))


def sums(by: list[str] | None = None, frame: DataFrame | None = None, more: list[Column] | None = None) -> DataFrame:
    """Bucket sums of ``frame`` for each group."""
    columns = [F.sum(c).cast("long").alias(c) for c in BUCKET if c in frame.columns]
    return frame.groupBy(*(by or [])).agg(*columns, *(more or []))


def first_usage_per_generation(events: DataFrame, scope: list[str], generation: str, order: str) -> DataFrame:
    """The first usage-bearing completion of each generation; one request without counters where none bears usage."""
    bearing = F.greatest(*[F.col(c) for c in COUNTERS]).isNotNull()
    picked = F.min_by(F.struct(*COUNTERS), F.when(bearing, F.col(order))).alias("picked")
    grouped = events.groupBy(*scope, generation).agg(picked, F.min(order).alias(order), F.max(bearing).alias("measured"))
    return grouped.select(*scope, generation, order, "measured", *[F.coalesce(F.col(f"picked.{c}"), F.lit(0)).cast("long").alias(c) for c in COUNTERS], F.lit(1).cast("long").alias("requests"))


def unmeasured(seen: DataFrame, measured: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that were seen without valid counters and never measured: these make a session partial."""
    return seen.select(*keys).distinct().join(measured.select(*keys).distinct(), keys, "left_anti")
