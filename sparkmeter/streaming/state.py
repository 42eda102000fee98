"""Keyed state over streams: budget multiples, turn numbers, versions, totals that never shrink.

Each operator is a pure step function on a plain state, used by a streaming query (``applyInPandasWithState``)
and by batch replay alike; replaying the same input changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def budget_step(state: dict, cost: float, limit: float, final: bool) -> int | None:
    """The budget multiple that is newly passed, or none; only final events move the mark."""
    multiple = int(cost // limit)
    if multiple <= state.get("notified", 0):
        return None
    if final:
        state["notified"] = multiple
    return multiple


def turn_step(state: dict, generation: str | None, opens: bool) -> int:
    """Turn number of an event: a generation keeps its number, an open prompt is claimed, else the next number is given."""
    turns = state.setdefault("turns", {})
    if generation is not None and generation in turns:
        return turns[generation]
    if opens:
        state["high"] = state["open"] = state.get("high", 0) + 1
        number = state["open"]
    elif state.get("open"):
        number = state["open"]
    else:
        state["high"] = number = state.get("high", 0) + 1
    if generation is not None:
        turns[generation] = number
        state["open"] = None
    return number


def totals_step(state: dict, covered: int, totals: tuple[int, ...]) -> bool:
    """Take a transcript's totals unless the snapshot covers fewer turns than the one that is held."""
    if covered < state.get("covered", -1):
        return False
    if (covered, totals) != (state.get("covered"), state.get("totals")):
        state["revision"] = state.get("revision", 0) + 1
    state["covered"], state["totals"] = covered, totals
    return True


def version_step(state: dict, version: tuple[int, int, int]) -> bool:
    """Whether a snapshot is newer than (or the same as) what was delivered; older ones are dropped."""
    held = state.get("version")
    if held is not None and version < held:
        return False
    state["version"] = version
    return True


def replay(events: Iterable[dict], key: str, step: Callable[[dict, dict], dict | None]) -> Iterator[dict]:
    """Run a step over events in order, with a state for each key."""
    states: dict[object, dict] = {}
    for event in events:
        found = step(states.setdefault(event[key], {}), event)
        if found is not None:
            yield found


def budget_alerts(costs: DataFrame, limit: float) -> DataFrame:
    """Streaming alerts from (session, cost, final) rows: session and multiple, each multiple once."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {"notified": state.get[0] if state.exists else 0}
        found = []
        for frame in frames:
            for row in frame.itertuples():
                multiple = budget_step(held, row.cost, limit, bool(row.final))
                if multiple is not None:
                    found.append((key[0], multiple))
        state.update((held["notified"],))
        if found:
            yield pd.DataFrame(found, columns=["session", "multiple"])

    return costs.groupBy("session").applyInPandasWithState(run, "session string, multiple long", "notified long", "append", GroupStateTimeout.NoTimeout)


def keyed(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[dict, dict], dict | None], schema: str) -> DataFrame:
    """Run a step over a stream (or a table) with a state for each key, held as JSON in the state store.

    Rows of one batch are taken in ``order``; ``schema`` names the key columns (strings) and what the step gives.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        batch = pd.concat(list(frames)).sort_values(order)
        found = [dict(zip(keys, key, strict=True)) | out for out in (step(held, row) for row in batch.to_dict("records")) if out is not None]
        state.update((json.dumps(held),))
        yield pd.DataFrame(found, columns=names)

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.NoTimeout)


def turn_numbers(events: DataFrame) -> DataFrame:
    """Stable turn numbers of generations: events of session, agent, ord, generation (null: a prompt), opens."""

    def step(state: dict, row: dict) -> dict:
        generation = None if pd.isna(row["generation"]) else str(row["generation"])
        return {"generation": generation, "turn": turn_step(state, generation, bool(row["opens"]))}

    return keyed(events, ["session", "agent"], ["ord"], step, "session string, agent string, generation string, turn long")


def transcript_totals(snapshots: DataFrame) -> DataFrame:
    """Totals that were taken: snapshots of session, agent, ord, covered, input, output; one that covers fewer turns is refused.

    Usage, covered turns and revision are one state, so a reader never sees some of them without the others.
    """

    def step(state: dict, row: dict) -> dict | None:
        totals = (int(row["input"]), int(row["output"]))
        state["totals"] = tuple(state["totals"]) if "totals" in state else None
        if not totals_step(state, int(row["covered"]), totals):
            return None
        return {"covered": state["covered"], "input": totals[0], "output": totals[1], "revision": state["revision"]}

    return keyed(snapshots, ["session", "agent"], ["ord"], step, "session string, agent string, covered long, input long, output long, revision long")


def session_starts(events: DataFrame) -> DataFrame:
    """The start of each session whenever an arrival moves it to an earlier time: events of session, ord, ts."""

    def step(state: dict, row: dict) -> dict | None:
        ts = row["ts"]
        if not ts or ("started" in state and state["started"] <= ts):
            return None
        state["started"] = ts
        return {"started": ts}

    return keyed(events, ["session"], ["ord"], step, "session string, started string")
