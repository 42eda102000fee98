"""Transcripts of JSON lines with user and assistant records, subagent files beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.normalize import claude as flatten
from ..functions.normalize import get, kind_of, text_of
from ..operators.joins import asof
from ..operators.segments import running, sticky_segments
from ..operators.usage import COUNTERS, dedupe_requests
from ..sources import jsonl

NO_COMMAND = "(no command)"
AGENT_GLOB = "agent-*.jsonl"


BLOCKS = "array<struct<type string, id string, name string, input struct<skill string>>>"
EVENTS = "array<struct<slot int, kind string, name string, use_id string>>"


def _fields(lines: DataFrame) -> DataFrame:
    """What segments and requests need of each record; texts and the parsed record end here, before anything is shuffled."""
    v = F.col("v")
    content, counted = get(v, "$.message.content", "variant"), get(v, "$.message.usage", "variant")
    kind = get(v, "$.type")
    rows = lines.where(kind.isin("user", "assistant")).select(
        "path", "ord", kind.alias("type"), get(v, "$.timestamp").alias("ts"), get(v, "$.requestId").alias("request_id"),
        F.coalesce(get(v, "$.isSidechain", "boolean"), F.lit(False)).alias("side"), F.coalesce(get(v, "$.isMeta", "boolean"), F.lit(False)).alias("meta"),
        get(v, "$.message.model").alias("model"), F.when(kind == "user", text.strip(text_of(content))).alias("text"),
        F.try_variant_get(content, "$", BLOCKS).alias("blocks"), F.when(counted.isNotNull(), flatten(counted)).alias("usage"),
    )
    answers_tool = F.coalesce(F.exists("blocks", lambda b: b["type"] == "tool_result"), F.lit(False))
    human = (F.col("type") == "user") & ~F.col("side") & ~F.col("meta") & (F.length("text") > 0) & ~answers_tool
    skills = F.filter("blocks", lambda b: (b["type"] == "tool_use") & (b["name"] == "Skill") & b["input"]["skill"].isNotNull())
    skills = F.when(F.col("type") == "assistant", F.transform(skills, lambda b: F.struct(F.concat(F.lit("/"), b["input"]["skill"]).alias("name"), b["id"].alias("use_id"))))
    rows = rows.withColumn("human", human).withColumn("skills", skills)
    return rows.select("path", "ord", "type", "ts", "request_id", "model", "usage", "human", "skills", F.when(human, text.command_tag(F.col("text"))).alias("tag"), F.when(human, text.prompt(F.col("text"))).alias("prompt"))


def _slots(rows: DataFrame) -> DataFrame:
    """Rows in order with their skill uses in front of their usage: one row for each event that can open a segment or bears usage."""
    none = F.lit(None).cast("string")

    def event(slot: int, kind: str, name: Column) -> Column:
        return F.array(F.struct(F.lit(slot).alias("slot"), F.lit(kind).alias("kind"), name.alias("name"), none.alias("use_id")))

    used = F.transform(F.coalesce("skills", F.array().cast("array<struct<name string, use_id string>>")), lambda b, i: F.struct(i.alias("slot"), F.lit("skill").alias("kind"), b["name"].alias("name"), b["use_id"].alias("use_id")))
    bears = F.when(F.col("usage").isNotNull(), event(1000, "usage", none)).otherwise(F.array().cast(EVENTS))
    events = F.when(F.col("human"), event(0, "prompt", F.col("tag"))).when(F.col("type") == "assistant", F.concat(used, bears))
    return rows.select("*", F.explode(events).alias("event")).select(*[c for c in rows.columns if c not in ("skills", "human", "tag", "type")], "event.*")


def _first_of_each(events: DataFrame) -> DataFrame:
    """Each request, skill use and prompt of a file once, where it stands first: counters are maxima over the records of a request.

    One aggregation with map-side combine does for requests and skill uses alike what a window would do one by one.
    """
    by_use = F.coalesce("use_id", F.concat_ws(":", "request_id", "name"))
    alone = F.concat(F.lit("#"), F.col("ord").cast("string"))
    key = F.when(F.col("kind") == "skill", by_use).when(F.col("kind") == "usage", F.coalesce("request_id", alone)).otherwise(alone)
    first = F.min(F.struct("ord", "slot", "name", "model", "ts", F.when(F.col("kind") == "prompt", F.col("prompt")).alias("prompt"))).alias("first")
    found = events.groupBy("path", "kind", key.alias("key")).agg(first, *[F.max(F.coalesce(F.col(f"usage.{c}"), F.lit(0))).cast("long").alias(c) for c in COUNTERS])
    return found.select("path", "kind", "key", "first.*", *COUNTERS)


def sessions(spark: SparkSession, root: str | list[str]) -> dict[str, DataFrame]:
    """``requests``, ``segments``, ``starts`` (first record with a time) and ``files`` of all transcripts under ``root`` (``project/session.jsonl``), or of the files of a list."""
    lines = jsonl.scan(spark, f"{root}/*/*.jsonl" if isinstance(root, str) else root)
    rows = _fields(jsonl.records(lines))
    session, project = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("session"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("project")
    events = _first_of_each(_slots(rows))
    marker = (F.col("kind") == "skill") | ((F.col("kind") == "prompt") & F.col("name").isNotNull())
    events = sticky_segments(events, ["path"], ["ord", "slot"], marker, F.lit(True))
    named = F.last(F.when(marker, F.col("name")), ignorenulls=True).over(running(["path"], ["ord", "slot"]))
    events = events.withColumn("label", F.coalesce(named, F.lit(NO_COMMAND)))
    at = F.struct("ord", "slot")
    segments = events.where("seg_id > 0").groupBy("path", "seg_id").agg(
        F.min_by("label", at).alias("label"), F.min_by("ts", at).alias("start_ts"), F.min_by("prompt", F.when((F.col("kind") == "prompt") & (F.col("label") == NO_COMMAND), F.col("ord"))).alias("prompt")
    )
    requests = events.where("kind = 'usage'").select(
        project, session, "path", F.col("key").alias("request_key"), *COUNTERS, F.col("seg_id").alias("segment"), "label", "model", text.local_day(F.col("ts")).alias("day"), "ts", "ord", F.lit(1).cast("long").alias("requests")
    )
    starts = rows.groupBy("path").agg(F.min(F.nullif("ts", F.lit(""))).alias("first_ts"))
    return {
        "requests": requests, "segments": segments.select(project, session, *segments.columns),
        "starts": starts.select(project, session, "first_ts"), "files": jsonl.file_status(lines),
    }


def subagents(spark: SparkSession, root: str | list[str], segments: DataFrame) -> DataFrame:
    """Requests of subagent files, each with the segment that was open when the subagent started (else the last one).

    Ids are deduplicated inside one file only: the same request in a parent and in a child counts twice.
    """
    lines = jsonl.scan(spark, root, recursive=True, name_glob=AGENT_GLOB).where(F.col("path").contains("/subagents/"))
    rows = _fields(jsonl.records(lines)).withColumn("session", F.regexp_extract("path", r"([^/]+)/subagents/", 1)).withColumn("project", F.regexp_extract("path", r"([^/]+)/[^/]+/subagents/", 1)).withColumn("agent", F.regexp_extract("path", r"/(agent-[^/]+)\.jsonl$", 1))
    bearing = rows.where((F.col("type") == "assistant") & F.col("usage").isNotNull()).select(
        "path", "project", "session", "agent", "model", "ts", text.local_day(F.col("ts")).alias("day"), "request_id", "ord", *[F.col(f"usage.{c}").alias(c) for c in COUNTERS]
    )
    requests = dedupe_requests(bearing, ["project", "session", "agent", "path"], first=["model", "day", "ts"])
    meta = agent_files(spark, root)
    starts = rows.groupBy("path", "project", "session", "agent").agg(F.min("ts").alias("own_ts"))
    starts = starts.join(meta, F.regexp_replace("path", r"\.jsonl$", "") == F.col("meta_of"), "left").join(journal_starts(spark, root), F.regexp_extract("path", "^(.*)/", 1) == F.col("journal_in"), "left")
    starts = starts.select("session", "agent", F.coalesce("own_ts", "meta_ts", "journal_ts").alias("agent_ts"), F.coalesce("agent_type", F.lit("agent")).alias("agent_type"), F.coalesce("description", F.lit("")).alias("description"))
    placed = asof(starts, segments.where("start_ts != ''"), "session", "agent_ts", "agent", "start_ts", "seg_id")
    labelled = placed.join(segments.select("session", "seg_id", "label"), ["session", "seg_id"], "left").select("session", "agent", F.coalesce(F.col("seg_id"), F.lit(1)).cast("long").alias("segment"), F.coalesce("label", F.lit(NO_COMMAND)).alias("label"))
    return requests.join(labelled, ["session", "agent"], "left").join(starts.select("session", "agent", "agent_type", "description"), ["session", "agent"], "left")


#: Keys under which an agent's start may be recorded, the first that is filled counts (fixed names).
START_KEYS = ("timestamp", "started_at", "start_ts", "created_at", "start_time", "time", "ts")


def _start(v: Column) -> Column:
    """Start time of a metadata object: text as it is, numbers as seconds or milliseconds since the epoch."""
    found = []
    for key in START_KEYS:
        number, words = get(v, f"$.{key}", "double"), get(v, f"$.{key}")
        is_number = kind_of(v, f"$.{key}").rlike("BIGINT|DOUBLE|DECIMAL")
        iso = F.date_format(text.epoch_to_time(number), "yyyy-MM-dd'T'HH:mm:ssXXX")
        found.append(F.when(is_number, F.when(number != 0, iso)).when(F.length(words) > 0, words))
    return F.coalesce(*found)


def agent_files(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Metadata files beside the transcripts of subagents: path without its ending, type, description, start."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.meta.json").option("wholetext", "true").text(root)
    v = F.try_parse_json(F.make_valid_utf8("value"))
    rows = whole.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.meta\.json$", "").alias("meta_of"), v.alias("v"))
    return rows.select("meta_of", get(F.col("v"), "$.agentType").alias("agent_type"), get(F.col("v"), "$.description").alias("description"), _start(F.col("v")).alias("meta_ts"))


def journal_starts(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """The first start recorded in each folder's journal."""
    lines = jsonl.scan(spark, root, recursive=True, name_glob="journal.jsonl").where("object")
    rows = lines.select(F.regexp_extract("path", "^(.*)/", 1).alias("journal_in"), "ord", _start(F.col("v")).alias("found")).where("found is not null")
    return rows.groupBy("journal_in").agg(F.min_by("found", "ord").alias("journal_ts"))


def all_requests(spark: SparkSession, root: str, with_agents: bool = True) -> DataFrame:
    """Requests of sessions and their subagents in one frame (``agent`` is null for a session's own)."""
    found = sessions(spark, root)
    columns = ["project", "session", "segment", "label", "model", "day", "ts", *COUNTERS, "requests"]
    own = found["requests"].select(*columns, *[F.lit(None).cast("string").alias(c) for c in ("agent", "agent_type")])
    return own.unionByName(subagents(spark, root, found["segments"]).select(*own.columns)) if with_agents else own
