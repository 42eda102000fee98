"""Replay of a hook log: what each generation of a session asked, used and ended, as a table and as a stateful stream.

A hook appends lines to files of a folder. ``hook_stream`` reads the folder as a stream; a line that is no JSON object, a line
that was cut off, or one without a session goes on with ``quarantined`` set and stops nothing. ``replayed`` gives one row for each generation,
``replay_stream`` the same rows from state that grows with each batch: whatever the batches, the last row of a generation
is the row of the table. The order of the log is the order of ``ord``, which must not fall from batch to batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..functions.normalize import cursor_hook, get
from ..operators.usage import COUNTERS, first_usage_per_generation

#: Hooks that end a generation, and the one that ends a subagent (fixed names); subagents without an id are one.
ENDS, AGENT_END, UNKNOWN = ("stop", "afterAgentResponse"), "subagentStop", "unknown"
GENERATION = ["session", "generation", "place", "ts", "model", "label", *COUNTERS, "measured", "ends", "agents"]
_KIND = "session string, generation string, place long, ts string, model string, label string, " + ", ".join(f"{c} long" for c in COUNTERS) + ", measured boolean, ends long, agents long"
_HELD = _KIND.split(", ", 2)[2]
#: State of the stream is kept here: only this provider holds maps and can be read from outside.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def parsed(lines: DataFrame, ord: Column) -> DataFrame:
    """Hook events of lines (column ``value``): session, generation, hook, ts, model, label, agent, counters (null without usage), quarantined."""
    rows = lines.select("*", F.explode(F.array(F.try_parse_json(F.make_valid_utf8("value")))).alias("v"), ord.alias("ord"))
    v = F.col("v")
    used = cursor_hook(get(v, "$.tokens", "variant"))
    session = get(v, "$.conversation_id")
    return rows.select(
        session.alias("session"), get(v, "$.generation_id").alias("generation"), get(v, "$.hook").alias("hook"), get(v, "$.ts").alias("ts"), get(v, "$.model").alias("model"),
        get(v, "$.label").alias("label"), get(v, "$.subagent_id").alias("agent"), *[used[c].alias(c) for c in COUNTERS], "ord", session.isNull().alias("quarantined"),
    )


def hook_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """The closed hook logs of a folder (``hooks.close_log``) as a stream, at most ``files`` files a batch, in order of their times.

    A closed log is small; it is split into numbered lines where it is read.
    """
    whole = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.jsonl").load(folder)
    lines = whole.select("_metadata", F.posexplode(F.split("value", "\n")).alias("line", "value")).where(F.length(F.trim("value")) > 0)
    return parsed(lines, F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("path"), F.col("line")))


def replayed(events: DataFrame) -> DataFrame:
    """One row for each generation: its place in the session, first time, model and label, first usage, how many ends and subagents."""
    rows = events.where(F.col("session").isNotNull() & F.col("generation").isNotNull())
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    ended, agent = F.col("hook").isin(*ENDS), F.when(F.col("hook") == AGENT_END, F.coalesce("agent", F.lit(UNKNOWN)))
    named = rows.groupBy("session", "generation").agg(first("ts"), first("model"), first("label"), F.min("ord").alias("_first"), F.count_if(ended).cast("long").alias("ends"), F.countDistinct(agent).cast("long").alias("agents"))
    used = first_usage_per_generation(rows.where(ended), ["session"], "generation", "ord").select("session", "generation", "measured", *COUNTERS)
    place = F.row_number().over(Window.partitionBy("session").orderBy("_first")).cast("long")
    found = named.withColumn("place", place).join(used, ["session", "generation"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS]
    return found.select("session", "generation", "place", "ts", "model", "label", *zero, F.coalesce("measured", F.lit(False)).alias("measured"), "ends", "agents")


def _place(row: Row) -> Any:
    """The order key of a row; a struct reaches Python as a dict of its fields."""
    return tuple(row["ord"].values()) if isinstance(row["ord"], dict) else row["ord"]


class Replay(StatefulProcessor):
    """State of a session: its generations by name, the subagents that ended in each, and how many generations there are."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.generations = handle.getMapState("generations", "generation string", _HELD)
        self.agents = handle.getMapState("agents", "generation string, agent string", "ts string")
        self.count = handle.getValueState("count", "n long")

    def handleInitialState(self, key: tuple, row: Row, timers: Any) -> None:  # noqa: N802
        """Take a generation of an earlier replay as it is."""
        self.generations.updateValue((row["generation"],), tuple(row[c] for c in GENERATION[2:]))
        for agent in row["agent_names"] or ():
            self.agents.updateValue((row["generation"], agent), (None,))
        self.count.update((max(row["place"], self.count.get()[0] if self.count.exists() else 0),))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: Any) -> Iterator[Row]:  # noqa: N802
        touched: dict[str, dict] = {}
        for row in sorted(rows, key=_place):
            name = row["generation"]
            held = touched.get(name)
            if held is None:
                held = touched[name] = self._generation(name)
            for c in ("ts", "model", "label"):
                held[c] = held[c] if held[c] is not None else row[c]
            if row["hook"] in ENDS:
                held["ends"] += 1
                counters = [row[c] for c in COUNTERS]
                if not held["measured"] and any(c is not None for c in counters):
                    held |= dict(zip(COUNTERS, (c or 0 for c in counters), strict=True)) | {"measured": True}
            agent = UNKNOWN if row["agent"] is None else row["agent"]
            if row["hook"] == AGENT_END and not self.agents.containsKey((name, agent)):
                self.agents.updateValue((name, agent), (row["ts"],))
                held["agents"] += 1
        for name, held in touched.items():
            self.generations.updateValue((name,), tuple(held[c] for c in GENERATION[2:]))
            yield Row(session=key[0], generation=name, **held)

    def _generation(self, name: str) -> dict:
        if self.generations.containsKey((name,)):
            return dict(zip(GENERATION[2:], self.generations.getValue((name,)), strict=True))
        n = (self.count.get()[0] if self.count.exists() else 0) + 1
        self.count.update((n,))
        return {"place": n, "ts": None, "model": None, "label": None} | dict.fromkeys(COUNTERS, 0) | {"measured": False, "ends": 0, "agents": 0}

    def close(self) -> None:
        """Nothing is held outside the state."""


def replay_stream(events: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Rows of the generations that a batch touched, as they are after it. ``initial``: rows of ``replayed`` with ``agent_names``, to go on from."""
    rows = events.where(F.col("session").isNotNull() & F.col("generation").isNotNull())
    return rows.groupBy("session").transformWithState(Replay(), _KIND, "Update", "None", initialState=None if initial is None else initial.groupBy("session"))


def state_of(spark: SparkSession, checkpoint: str, variable: str, batch: int | None = None) -> DataFrame:
    """The state of a stream as it was after one batch (the last one if none is named): all its parts are of that batch."""
    reader = spark.read.format("statestore").option("stateVarName", variable)
    return (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)


class Totals(StatefulProcessor):
    """Totals of a session's transcript; a snapshot that covers fewer turns than the one held is refused, and the revision counts changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("totals", "covered long, input long, output long, revision long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers: Any) -> Iterator[Row]:  # noqa: N802
        held = self.held.get() if self.held.exists() else None
        before = held
        for row in sorted(rows, key=_place):
            found = (row["covered"], row["input"], row["output"])
            if held is None or row["covered"] >= held[0]:
                held = (*found, (held[3] if held else 0) + (held is None or found != tuple(held[:3])))
        if held is not None and held != before:
            self.held.update(tuple(held))
            yield Row(session=key[0], agent=key[1], covered=held[0], input=held[1], output=held[2], revision=held[3])

    def close(self) -> None:
        """Nothing is held outside the state."""


def totals_stream(snapshots: DataFrame) -> DataFrame:
    """Totals that changed, from snapshots of session, agent, ord, covered, input, output. Usage, covered turns and revision are one value of the state."""
    return snapshots.groupBy("session", "agent").transformWithState(Totals(), "session string, agent string, covered long, input long, output long, revision long", "Update", "None")


def totals_at(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """Totals of all sessions after a batch, read from the state: one revision of each, never a part of the next."""
    return state_of(spark, checkpoint, "totals", batch).select("key.session", "key.agent", "value.*")
