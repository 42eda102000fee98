"""Overlap re-reading: what a source now says about a window of time replaces what a ledger held of it.

The source is read again from some hours before the high-water mark, since it may report late. A fetch replaces the rows of its
window; an empty answer erases nothing. The mark moves only if the fetch joined up with what was fetched before: after a gap
the rows are taken, and the mark stays, so that the next fetch closes the gap.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.cloud import OVERLAP_MS
from .store import Versions

#: A day of events is a partition; a fetch rewrites the days that its window touches.
DAY_MS = 86_400_000
LEDGER = "ms long, event string, day long"


class Mark(NamedTuple):
    """Up to where the source was read without a gap, in milliseconds."""

    high: int


def next_start(mark: Mark | None, since_ms: int) -> int:
    """Where the next fetch begins: before the mark by the overlap, or at ``since_ms``."""
    return since_ms if mark is None else max(since_ms, mark.high - OVERLAP_MS)


def moved(mark: Mark | None, start_ms: int, end_ms: int) -> Mark | None:
    """The mark after a fetch of a window: its end if it joined up with the last mark, else the mark as it was."""
    if mark is None or start_ms <= mark.high:
        return Mark(max(end_ms, mark.high if mark else end_ms))
    return mark


class Ledger:
    """Events (ms, event) of a source under a folder: days as partitions, and a mark that is written after them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _there(self, name: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def events(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(f"{self.folder}/events").where("ms is not null") if self._there("events") else self.spark.createDataFrame([], LEDGER)

    def mark(self) -> Mark | None:
        found = self.spark.read.schema("high long").json(f"{self.folder}/mark").first() if self._there("mark") else None
        return None if found is None else Mark(found["high"])

    def merge(self, fetched: DataFrame, start_ms: int, end_ms: int) -> None:
        """Replace a window (its end left out) by what was fetched (ms, event); only the days that it touches are rewritten."""
        inside = (F.col("ms") >= start_ms) & (F.col("ms") < end_ms)
        fresh = fetched.where(inside).select("ms", "event", F.floor(F.col("ms") / DAY_MS).alias("day"))
        fresh = fresh.dropDuplicates(["ms", "event"])
        if not fresh.isEmpty():
            first, last = start_ms // DAY_MS, (end_ms - 1) // DAY_MS
            kept = self.events().where(F.col("day").between(first, last) & ~inside)
            emptied = self.events().where(F.col("day").between(first, last)).select(F.lit(None).cast("long").alias("ms"), F.lit(None).cast("string").alias("event"), "day").distinct()
            rows = kept.unionByName(fresh).unionByName(emptied)  # a mark keeps the folder of a day that lost all events
            rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.folder}/events")
        after = moved(self.mark(), start_ms, end_ms)
        self.spark.createDataFrame([tuple(after)], "high long").coalesce(1).write.mode("overwrite").json(f"{self.folder}/mark")


_STAGED = "window_start long, window_end long, ms long, event string"


def sync_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: rows of a paged source (window_start, window_end, ms, event) go into the ledger window by window.

    A row without an event tells that its window was read to the end; until then its rows wait beside the ledger. A
    repeated batch changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ledger, staged = Ledger(spark, folder), Versions(spark, f"{folder.rstrip('/')}/staged", _STAGED)
        rows = staged.read(number).unionByName(batch.select(*[c.split()[0] for c in _STAGED.split(", ")])).persist()
        ended = rows.where("event is null").groupBy("window_start").agg(F.max("window_end").alias("window_end"))
        windows = ended.orderBy("window_start").collect()  # no more than pages of a batch, which the reader bounds
        for w in windows:
            ledger.merge(rows.where((F.col("window_start") == w["window_start"]) & F.col("event").isNotNull() & F.col("ms").isNotNull()), w["window_start"], w["window_end"])
        staged.write(rows.join(ended.select("window_start"), "window_start", "left_anti").select(rows.columns), number)
        rows.unpersist()

    return run
