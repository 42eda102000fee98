"""What a result says about itself.

Everything worth saying is a fact: a kind, how many it concerns out of how many, and the first few names. Facts come from
frames as rows (``facts_frame``), whatever the size of what they count, and one table of sentences renders them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rollup import LEVELS

#: Hosts whose logs hold no token counts unless they say so.
UNCOUNTED_HOSTS = ("cursor",)
#: Earlier sessions that a comparison needs (fixed value), and names that a fact carries.
BASELINE_LEAST, NAMED = 5, 5


class Fact(NamedTuple):
    """Something to tell: its kind, how many, out of how many, and some names."""

    kind: str
    count: int = 0
    whole: int = 0
    names: tuple[str, ...] = ()


#: One sentence for each kind, in the order in which they are told.
SENTENCES = {
    "no_root": "{names} cannot be listed, so nothing was read.",
    "unreadable": "Skipped {count} log file(s) that could not be read: {names}.",
    "no_rate": "{count} model(s) have no price, and costs are without them: {names}.",
    "partial": "{count} of {whole} session(s) kept only some of their token counts; what is shown is a lower bound.",
    "activity_only": "{count} of {whole} session(s) kept no token counts; their zeros mean not measured.",
    "mixed_cost": "{count} row(s) with * hold usage of models without a price and cost more than shown.",
    "few_sessions": "Only {count} earlier session(s) to compare with, of {whole} that a comparison needs.",
    "quiet_start": "The first half of the window has {count} session(s) and no cost, so there is no trend to tell.",
    "empty_window": "The window holds no session.",
    "clear": "Nothing unusual was found.",
}


def sentences(facts: Iterable[Fact]) -> list[str]:
    """The facts as text, in a fixed order, each kind once; of more names than a fact carries the rest is counted."""
    known: dict[str, Fact] = {}
    for fact in facts:
        known.setdefault(fact.kind, fact)
    out = []
    for kind, sentence in SENTENCES.items():
        if kind in known:
            fact = known[kind]
            more = f" and {fact.count - len(fact.names)} more" if fact.count > len(fact.names) else ""
            out.append(sentence.format(count=fact.count, whole=fact.whole, names=", ".join(fact.names) + more))
    return out


def facts_frame(rows: DataFrame, kind: str, name: str, whole: Column | None = None) -> DataFrame:
    """One row (kind, count, whole, names) about the distinct names of a frame; none if there are none."""
    first = rows.select(F.col(name).cast("string").alias("name")).distinct()
    counted = first.agg(F.count("*").alias("count")).where("count > 0")
    shown = first.orderBy("name").limit(NAMED).agg(F.array_sort(F.collect_list("name")).alias("names"))
    return counted.join(F.broadcast(shown)).select(F.lit(kind).alias("kind"), "count", F.coalesce(whole if whole is not None else F.lit(None), F.col("count")).cast("long").alias("whole"), "names")


def collected(frame: DataFrame) -> list[Fact]:
    """Facts of a frame of facts; it has a row for each kind at most."""
    return [Fact(r["kind"], r["count"], r["whole"], tuple(r["names"] or ())) for r in frame.collect()]


def level_facts(levels: Mapping[str, int]) -> list[Fact]:
    """Facts about sessions by measurement level; exact ones need no word."""
    whole = sum(levels.values())
    return [Fact(level, levels[level], whole) for level in LEVELS if level != "exact" and levels.get(level)]


def comparison_facts(sessions: int) -> list[Fact]:
    """Whether a baseline was too small to compare with."""
    return [Fact("few_sessions", sessions, BASELINE_LEAST)] if sessions < BASELINE_LEAST else []


def window_facts(sessions: int, first_half_sessions: int, first_half_cost: float | None) -> list[Fact]:
    """Whether a window was empty, or its first half without cost."""
    if not sessions:
        return [Fact("empty_window")]
    return [] if first_half_cost else [Fact("quiet_start", first_half_sessions)]


def default_level(level: Column, runtime: Column) -> Column:
    """A session's own level, else what its host can be expected to record."""
    return F.coalesce(level, F.when(runtime.isin(*UNCOUNTED_HOSTS), "activity_only"), F.lit("exact"))


def all_unmeasured(rows: DataFrame, by: Sequence[str] = (), level: str = "measurement") -> DataFrame:
    """Whether a scope has known levels and all of them are activity only; one measured session is enough for its numbers to stay."""
    measured = F.count_if(F.col(level).isNotNull() & (F.col(level) != "activity_only"))
    return rows.groupBy(*by).agg(((F.count(level) > 0) & (measured == 0)).alias("unmeasured"))


def worst(levels: Iterable[str]) -> str:
    """The least certain of some levels; unknown words do not count."""
    return LEVELS[max([0, *[LEVELS.index(x) for x in levels if x in LEVELS]])]


def budget_of(value: str | None) -> float | None:
    """A budget from the environment: a finite number over zero, else none."""
    try:
        found = float(value or "nan")
    except ValueError:
        return None
    return found if math.isfinite(found) and found > 0 else None
