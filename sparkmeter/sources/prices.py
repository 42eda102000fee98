"""Price lists: JSON maps of model key to dollar rates for a million tokens, an overlay above the bundled list."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "key string, rate_in double, rate_out double, rate_read double"


def rows_of(content: str) -> list[tuple]:
    """Valid entries of a price map; anything that is no object of finite, non-negative numbers is left out."""

    def rate(x: object) -> float | None:
        fine = isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and x >= 0
        return float(x) if fine else None

    data = json.loads(content)
    out = []
    for key, value in data.items() if isinstance(data, dict) else ():
        if isinstance(value, dict) and rate(value.get("input")) is not None and rate(value.get("output")) is not None:
            if "cache_read" in value and rate(value["cache_read"]) is None:
                continue
            out.append((key, rate(value["input"]), rate(value["output"]), rate(value.get("cache_read"))))
    return out


def price_list(spark: SparkSession, *layers: str) -> DataFrame:
    """One price list from JSON texts; a later layer replaces a key as a whole."""
    merged: dict[str, tuple] = {}
    for layer in layers:
        merged |= {row[0]: row for row in rows_of(layer)}
    return spark.createDataFrame(list(merged.values()), SCHEMA)
