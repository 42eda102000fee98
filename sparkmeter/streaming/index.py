"""A corpus index that is written and read again: only families of files that changed are parsed anew.

Under a folder lie four Parquet tables, partitioned by a bucket of the family: ``sources`` (path, size, time, version and price
fingerprint of what was read), ``cells`` (sums for each session, agent, label, model and day), ``labels`` (how often each
label of a session was invoked, with usage or not) and ``sessions`` (first record, measurement). A refresh compares
the files' sizes and times with ``sources``, reads the families that differ, and overwrites the buckets that
these fall into. A marker names the buckets being written; if it is still there at the start, a run broke off and their
families count as changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pricing
from ..operators.usage import BUCKET
from ..plans import corpus as logs

VERSION, BUCKETS = 2, 32
#: Changed files up to which they are read by name; more are read as the whole root.
MOST_PATHS = 10_000
CELL = ["project", "session", "agent", "agent_type", "label", "model", "day"]
_SOURCES = "family string, path string, size long, mtime timestamp, version int, prices string, unreadable boolean, bucket int"
_SCHEMAS = {
    "sources": _SOURCES,
    "cells": f"family string, {', '.join(f'{c} string' for c in CELL)}, {', '.join(f'{c} long' for c in BUCKET)}, cost long, bucket int",
    "labels": "family string, session string, label string, invocations long, bucket int",
    "sessions": "family string, project string, session string, first_ts string, last_ts string, measurement string, bucket int",
}


def price_fingerprint(layers: Sequence[str]) -> str:
    return hashlib.sha256("\0".join(layers).encode()).hexdigest()


def changed(sources: DataFrame, known: DataFrame, fingerprint: str) -> DataFrame:
    """Sources (path, size, mtime, family) of the families to read: those with a file that no known row of this version and price list matches, or of which a known file is gone."""
    now = known.where((F.col("version") == VERSION) & (F.col("prices") == fingerprint))
    fresh = sources.join(now, ["path", "size", "mtime"], "left_anti").select("family")
    gone = known.join(sources, "path", "left_anti").select("family")
    return sources.join(fresh.union(gone).distinct(), "family", "left_semi")


class Refreshed(NamedTuple):
    """What a refresh did: files that were read, families that they make, all files there are."""

    read: int
    families: int
    files: int


class Index:
    """The index of one host's logs in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, runtime: str):
        self.spark, self.runtime = spark, runtime
        self.folder = f"{folder.rstrip('/')}/{runtime}"

    def table(self, name: str) -> DataFrame:
        """A table's rows; the marks that keep an emptied bucket's folder are left out."""
        path = f"{self.folder}/{name}"
        if not self._exists(path):
            return self.spark.createDataFrame([], _SCHEMAS[name])
        return self.spark.read.schema(_SCHEMAS[name]).parquet(path).where("family is not null")

    def priced(self) -> DataFrame:
        """Cells in the place of requests: any sum over requests is the same sum over cells. ``ts`` is the session's first record."""
        first = self.table("sessions").select("family", "session", F.col("first_ts").alias("ts"))
        return self.table("cells").join(first, ["family", "session"], "left").drop("bucket", "family")

    def refresh(self, root: str, prices: DataFrame, fingerprint: str) -> Refreshed:
        """Read what changed under ``root`` since the last time."""
        listing = logs.files(self.spark, root).withColumn("family", logs.family(self.runtime)).withColumn("bucket", F.pmod(F.xxhash64("family"), F.lit(BUCKETS)).cast("int")).persist()
        try:
            return self._refresh(root, prices, fingerprint, listing)
        finally:
            listing.unpersist()

    def _refresh(self, root: str, prices: DataFrame, fingerprint: str, listing: DataFrame) -> Refreshed:
        whole = listing.count()
        changed = self.changed(listing, fingerprint)
        buckets = sorted(r["bucket"] for r in changed.select("bucket").distinct().collect())  # BUCKETS at most
        if not buckets:
            return Refreshed(0, 0, whole)
        changed = changed.persist()
        wanted = listing.join(changed.select("family"), "family", "left_semi")
        paths = [r["path"] for r in wanted.select("path").orderBy("path").limit(MOST_PATHS + 1).collect()]
        counts = Refreshed(wanted.count(), changed.count(), whole)
        self._mark(buckets)
        fresh = self._tables(root, paths if len(paths) <= MOST_PATHS else None, prices, wanted) if paths else {name: self.spark.createDataFrame([], schema).drop("bucket") for name, schema in _SCHEMAS.items() if name != "sources"}
        unreadable = fresh.pop("unreadable", None)
        for name, rows in fresh.items():
            self._write(name, rows.join(changed.select("family", "bucket"), "family"), changed, buckets)
        seen = wanted.select("family", "path", "size", "mtime", F.lit(VERSION).alias("version"), F.lit(fingerprint).alias("prices"), "bucket")
        bad = unreadable if unreadable is not None else self.spark.createDataFrame([], "path string")
        seen = seen.join(bad.withColumn("unreadable", F.lit(True)), "path", "left").withColumn("unreadable", F.coalesce("unreadable", F.lit(False)))
        self._write("sources", seen, changed, buckets)
        self._unmark()
        changed.unpersist()
        return counts

    def changed(self, listing: DataFrame, fingerprint: str) -> DataFrame:
        """Families (family, bucket) to write anew: those to read, those of which all files are gone, those in a bucket that was left half-written."""
        known = self.table("sources")
        broken = self._marked()
        sound = known.where(~F.col("bucket").isin(broken)) if broken else known
        gone = known.join(listing, "family", "left_anti").select("family", "bucket")
        return changed(listing, sound, fingerprint).select("family", "bucket").union(gone).distinct()

    def _tables(self, root: str, paths: list[str] | None, prices: DataFrame, wanted: DataFrame) -> dict[str, DataFrame]:
        """Rows of the changed families."""
        found = logs.read(self.spark, self.runtime, root, paths)
        rates = prices.select("key", *[(F.col(c) * 1000).alias(c) for c in ("rate_in", "rate_out", "rate_read")])
        requests = pricing.priced(found.requests, rates).withColumn("cost", F.round(pricing.cost()).cast("long"))
        by_cell = requests.groupBy(*CELL).agg(*[F.sum(c).cast("long").alias(c) for c in BUCKET], _charged().alias("cost"), F.min(F.nullif("ts", F.lit(""))).alias("_first"), F.max("ts").alias("_last")).persist()
        labels = found.segments.where("segment is not null").groupBy("session", "label").agg(F.countDistinct("segment").cast("long").alias("invocations"))
        levels = found.partial.select("session").distinct().withColumn("_partial", F.lit(True))
        times = by_cell.groupBy("session").agg(F.max("_last").alias("last_ts"), (F.sum("input") + F.sum("output")).alias("_tokens"))
        sessions = found.starts.groupBy("session").agg(F.min("project").alias("project"), F.min("first_ts").alias("first_ts")).join(times, "session", "full_outer").join(levels, "session", "left")
        lost = F.when((F.col("_tokens") == 0) & F.lit(self.runtime == "cursor"), "activity_only").otherwise("partial")
        sessions = sessions.select("project", "session", "first_ts", "last_ts", F.when(F.col("_partial"), lost).otherwise("exact").alias("measurement"))
        whole = {"cells": by_cell.drop("_first", "_last"), "labels": labels, "sessions": sessions}
        if self.runtime == "claude":  # a family is a session of a project
            named = F.concat_ws("/", "project", "session")
            homes = found.starts.select("session", named.alias("family")).distinct()
            whole = {n: t.withColumn("family", named) if "project" in t.columns else t.join(homes, "session") for n, t in whole.items()}
        else:
            whole = {n: t.withColumn("family", F.lit("all")) for n, t in whole.items()}
        return whole | {"unreadable": found.unreadable}

    def _write(self, name: str, fresh: DataFrame, changed: DataFrame, buckets: list[int]) -> None:
        """Overwrite some buckets with what they held of other families, and fresh rows. A row without a family keeps an emptied bucket's folder."""
        columns = [c.split()[0] for c in _SCHEMAS[name].split(", ")]
        kept = self.table(name).where(F.col("bucket").isin(buckets)).join(changed.select("family"), "family", "left_anti")
        marks = self.spark.createDataFrame([(b,) for b in buckets], "bucket int")
        rows = kept.select(columns).unionByName(fresh.select(columns)).unionByName(marks, allowMissingColumns=True)
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/{name}")

    def _place(self, path: str) -> tuple:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _exists(self, path: str) -> bool:
        system, place = self._place(path)
        return system.exists(place)

    def _mark(self, buckets: list[int]) -> None:
        marks = self.spark.createDataFrame([(b,) for b in sorted({*buckets, *self._marked()})], "bucket int")
        marks.coalesce(1).write.mode("overwrite").json(f"{self.folder}/writing")

    def _marked(self) -> list[int]:
        path = f"{self.folder}/writing"
        return [r["bucket"] for r in self.spark.read.schema("bucket int").json(path).collect()] if self._exists(path) else []

    def _unmark(self) -> None:
        system, place = self._place(f"{self.folder}/writing")
        system.delete(place, True)


def _charged():
    """Cost of a group: the vendor's charges where every row has one, else the estimate; unknown if a row's is."""
    missing, unknown = F.count_if(F.col("charge").isNull()), F.count_if(F.col("cost").isNull())
    return F.when(missing == 0, F.round(F.sum("charge") * 1e9).cast("long")).when(unknown == 0, F.sum("cost"))
