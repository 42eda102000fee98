"""Rates by longest model prefix, cost, savings, vendor charges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .usage import COUNTERS

#: Cache writes cost this much more than input (fixed values): five minutes, one hour; reads are a tenth by default.
WRITE_5M, WRITE_1H, READ_SHARE = 1.25, 2.0, 0.1
#: Price rows up to which they are broadcast; more rows are joined by first character instead.
BROADCAST_ROWS = 10_000


def merged_prices(bundled: DataFrame, overlay: DataFrame) -> DataFrame:
    """Two price layers by key; a key of the overlay replaces the bundled one as a whole."""
    return bundled.join(overlay.select("key"), "key", "left_anti").unionByName(overlay)


def valid_prices(prices: DataFrame) -> DataFrame:
    """Rates that are finite and not negative; zero is allowed; a missing cache-read rate stays missing."""

    def fine(name: str) -> Column:
        value = F.col(name).cast("double")
        return (value >= 0) & ~F.isnan(value) & (value < float("inf"))

    return prices.where(fine("rate_in") & fine("rate_out") & (F.col("rate_read").isNull() | fine("rate_read")))


#: Region and provider before a hosted model's name (fixed pattern).
PROVIDER = r"^(?:[a-z]{2,3}\.)?anthropic\."


def spellings(model: Column) -> Column:
    """Spellings under which a model is looked up: as it is, what follows its last slash, and both without a provider before them."""
    tail = F.substring_index(model, "/", -1)
    return F.array_distinct(F.array(model, tail, F.regexp_replace(model, PROVIDER, ""), F.regexp_replace(tail, PROVIDER, "")))


def rate_table(models: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """One row for each distinct model that has a rate: the longest key that is a prefix of a spelling and ends at a boundary.

    A boundary is the end of the spelling or a character that is no letter or digit. Both sides are tiny beside
    the log: distinct models and price keys; the join condition has the first character as an equality, so it
    is a hash join, never a loop over pairs.
    """
    tried = models.select(model).where(F.col(model).isNotNull()).distinct().select(model, F.explode(spellings(F.col(model))).alias("spelling"))
    tried = tried.withColumn("head", F.substring("spelling", 1, 1))
    keys = prices.withColumn("head", F.substring("key", 1, 1))
    after = F.expr("substring(spelling, length(key) + 1, 1)")
    fits = F.expr("startswith(spelling, key)") & ~after.rlike(r"^[\p{L}\p{N}]")
    matched = tried.join(keys, "head").where(fits)
    best = F.max_by(F.struct("key", "rate_in", "rate_out", "rate_read"), F.struct(F.length("key"), F.col("key"))).alias("best")
    return matched.groupBy(model).agg(best).select(model, "best.*")


def priced(usage: DataFrame, prices: DataFrame, model: str = "model", models: DataFrame | None = None) -> DataFrame:
    """``usage`` with its rates (null where the model has none).

    ``models``: where the distinct models are read from, if a cheaper frame than ``usage`` holds them all (a
    dimension, the raw log); the rates are a row for each of them, which AQE broadcasts by its measured size.
    """
    return usage.join(rate_table(usage if models is None else models, prices, model), model, "left")


def read_rate() -> Column:
    return F.coalesce(F.col("rate_read"), F.col("rate_in") * F.lit(READ_SHARE))


def cost() -> Column:
    """Cost of a row's bucket in the unit of its rates; null, not 0, without a rate."""
    write = F.col("cache_5m") * F.lit(WRITE_5M) + F.col("cache_1h") * F.lit(WRITE_1H)
    return F.col("input") * F.col("rate_in") + F.col("output") * F.col("rate_out") + F.col("cache_read") * read_rate() + write * F.col("rate_in")


def nano_cost() -> Column:
    """``cost`` for integer rates in nano-dollars a token, as an exact long (rates are multiples of 20)."""
    return F.round(cost()).cast("long")


def savings() -> Column:
    """What cached reads saved against the input rate."""
    return F.col("cache_read") * (F.col("rate_in") - read_rate())


def has_tokens() -> Column:
    return F.greatest(*[F.col(c) for c in COUNTERS]) > 0


def unpriced(usage: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Models with tokens, without a rate and without a charge; models that never used a token are no finding."""
    charged = F.col("charge").isNotNull() if "charge" in usage.columns else F.lit(False)
    used = usage.where(has_tokens() & ~charged).select(model).distinct()
    return used.join(rate_table(used, prices, model), model, "left_anti")


def charged_cost(usage: DataFrame, by: list[str], charge: str = "charge", estimate: str = "cost") -> DataFrame:
    """Vendor charges replace the estimate for a group in which every row has one."""
    missing = F.count_if(F.col(charge).isNull())
    return usage.groupBy(*by).agg(
        F.when(missing == 0, F.sum(charge)).otherwise(F.sum(estimate)).cast("long").alias("cost"),
        missing.cast("long").alias("n_missing"),
    )
