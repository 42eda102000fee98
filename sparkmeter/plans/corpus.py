"""The logs of a host as one corpus: requests, segments, sessions and files in common columns, whatever the host.

``read`` takes all files under a root, or those of some families (files that have to be read together).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import claude, codex, copilot, cursor, families, gemini
from ..operators.usage import BUCKET
from ..sources import cloud, discovery, jsonl

REQUESTS = {"project": "string", "session": "string", "segment": "string", "label": "string", "model": "string", "day": "string", "ts": "string", "agent": "string", "agent_type": "string", "charge": "double"} | dict.fromkeys(BUCKET, "bigint")
SEGMENTS = {"session": "string", "segment": "string", "label": "string", "start_ts": "string"}
#: Names of files that logs are in.
LOG_FILES = r"\.(jsonl?|vscdb)$"


class Corpus(NamedTuple):
    """``requests``; ``segments`` (those without usage too); ``starts`` (project, session, first_ts); ``partial`` (sessions that lost counters); ``unreadable`` (paths)."""

    requests: DataFrame
    segments: DataFrame
    starts: DataFrame
    partial: DataFrame
    unreadable: DataFrame


class Source(NamedTuple):
    """Where a corpus is read from: its root and, if only some families are wanted, their files."""

    root: str
    paths: list[str] | None = None

    def named(self, ending: str) -> list[str]:
        return [p for p in self.paths or [] if p.endswith(ending)]

    def all(self) -> str | list[str]:
        return self.root if self.paths is None else self.paths


def files(spark: SparkSession, root: str) -> DataFrame:
    """Path, path below the root, size and time of all log files under a root, without reading them; hidden folders and packages are passed over."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.substring_index("path", f"{root.rstrip('/')}/", -1)
    rows = found.select("path", below.alias("below"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return rows.where(F.col("path").rlike(LOG_FILES) & ~F.concat(F.lit("/"), "below").rlike(discovery.SKIPPED))


def family(runtime: str) -> Column:
    """Files that are read together: a transcript and its subagents; for other hosts, whose files refer to each other, all of them."""
    if runtime != "claude":
        return F.lit("all")
    return F.regexp_replace(F.concat_ws("/", F.slice(F.split("below", "/"), 1, 2)), r"\.jsonl$", "")


def _columns(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    return rows.select(*[(F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in wanted.items()])


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _corpus(spark: SparkSession, requests: DataFrame, segments: DataFrame, starts: DataFrame | None = None, partial: DataFrame | None = None, unreadable: DataFrame | None = None) -> Corpus:
    requests, segments = _columns(requests, REQUESTS), _columns(segments, SEGMENTS)
    if starts is None:
        times = segments.select("session", F.col("start_ts").alias("ts")).union(requests.select("session", "ts"))
        projects = requests.groupBy("session").agg(F.min("project").alias("project"))
        starts = times.groupBy("session").agg(F.min(F.nullif("ts", F.lit(""))).alias("first_ts")).join(projects, "session", "left").select("project", "session", "first_ts")
    return Corpus(requests, segments, starts, partial if partial is not None else _empty(spark, "session string"), unreadable if unreadable is not None else _empty(spark, "path string"))


def _claude(spark: SparkSession, source: Source) -> Corpus:
    mine = source.root if source.paths is None else [p for p in source.named(".jsonl") if "/subagents/" not in p]
    found = claude.sessions(spark, mine) if mine else claude.sessions(spark, source.named(".jsonl"))
    folders = source.root if source.paths is None else sorted({p.split("/subagents/")[0] for p in source.paths if "/subagents/" in p})
    requests = _columns(found["requests"], REQUESTS)
    if folders:
        requests = requests.unionByName(_columns(claude.subagents(spark, folders, found["segments"]), REQUESTS))
    segments = found["segments"].withColumnRenamed("seg_id", "segment")
    return _corpus(spark, requests, segments, found["starts"], None, found["files"].where("quarantined").select("path"))


def _families(spark: SparkSession, found: dict[str, DataFrame]) -> Corpus:
    requests = families.joined(found) if "parents" in found else found["requests"]
    return _corpus(spark, requests, found["segments"].withColumnRenamed("seg_id", "segment"), None, found["partial"].where("session is not null"))


def _both(spark: SparkSession, one: Corpus, two: Corpus) -> Corpus:
    return Corpus(*[a.unionByName(b) for a, b in zip(one, two, strict=True)])


def _gemini(spark: SparkSession, source: Source) -> Corpus:
    return _both(spark, _families(spark, gemini.sessions(spark, source.all())), _families(spark, gemini.step_sessions(spark, source.all())))


def _cursor(spark: SparkSession, source: Source) -> Corpus:
    ledger = cursor.ledger_requests(spark, source.all()).withColumn("segment", F.col("generation"))
    stores = [r["path"] for r in files(spark, source.root).where(F.col("path").endswith(".vscdb")).select("path").orderBy("path").collect()]  # one for each installation
    requests = _columns(ledger, REQUESTS)
    for path in stores:
        requests = cursor.prefer_ledger(requests, _columns(cursor.desktop(spark, path.removeprefix("file:"))["requests"], REQUESTS))
    exported = cursor.cloud_export(spark, source.root)
    requests = requests.unionByName(_columns(exported["requests"], REQUESTS))
    unmeasured = ledger.where("not coalesce(measured, false)").select("session").distinct()
    segments = requests.groupBy("session", "segment").agg(F.min("label").alias("label"), F.min("ts").alias("start_ts"))
    segments = segments.unionByName(_columns(exported["segments"].withColumnRenamed("seg_id", "segment"), SEGMENTS)).dropDuplicates(["session", "segment"])
    return _corpus(spark, requests, segments, None, unmeasured)


def _cloud(spark: SparkSession, source: Source) -> Corpus:
    """Ledgers of cloud usage: a segment for each conversation and day, with the vendor's charges."""
    lines = jsonl.records(jsonl.scan(spark, source.all(), recursive=True, name_glob="*.jsonl"))
    _, usage = cloud.read_ledger(lines)
    rows = cloud.segments(usage).withColumns({"session": F.col("agent"), "segment": F.concat_ws(" ", "conversation", "day"), "ts": F.col("day")}).drop("agent")
    segments = rows.groupBy("session", "segment").agg(F.min("label").alias("label"), F.min("ts").alias("start_ts"))
    return _corpus(spark, rows, segments, None, rows.where("partial").select("session").distinct())


def _copilot(spark: SparkSession, source: Source) -> Corpus:
    found = copilot.sessions(spark, source.paths or [source.root])
    segments = found["segments"].withColumn("segment", copilot.segment_name())
    return _corpus(spark, found["requests"], segments, None, found["partial"].where("session is not null"))


HOSTS: dict[str, Callable[[SparkSession, Source], Corpus]] = {
    "claude": _claude,
    "codex": lambda spark, source: _families(spark, codex.sessions(spark, source.all())),
    "gemini": _gemini,
    "copilot": _copilot,
    "cursor": _cursor,
    "cursor-cloud": _cloud,
}


def read(spark: SparkSession, runtime: str, root: str, paths: list[str] | None = None) -> Corpus:
    """The corpus of a host's logs under ``root``, or of some of its files."""
    return HOSTS[runtime](spark, Source(root, paths))
