"""Markdown, CSV and HTML of small results (collected at the edge), and atomic file writes."""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterable, Mapping, Sequence
from contextlib import suppress

from pyspark.sql import DataFrame

from ..functions import formats
from ..operators import agents
from .disclosure import SENTENCES, Fact, sentences


def markdown(rows: DataFrame, title: str, key: str = "key") -> str:
    """A table of a history, top or report frame; a partial cost is marked."""
    out = [f"## {title}", "", f"| {key} | calls | output | input | cache read | cost |", "|---|---:|---:|---:|---:|---:|"]
    for r in rows.collect():
        cost = formats.usd(None if r["cost"] is None else r["cost"] / 1e9) + ("*" if r["partial"] and r["cost"] is not None else "")
        out.append(f"| {r[key]} | {r['calls']} | {formats.tokens(r['output'])} | {formats.tokens(r['input'])} | {formats.tokens(r['cache_read'])} | {cost} |")
    return "\n".join(out) + "\n"


def report_markdown(priced: DataFrame, session: str, with_agents: bool = False, with_models: bool = False, facts: Iterable[Fact] = ()) -> str:
    """One session: a row for each label in report order, its agent types and models below it, the total, and what is to be said about it."""
    from . import api

    found = [r.asDict() for r in api.report(priced, session).collect()]
    labels = sorted((r for r in found if r["grain"] == 1), key=lambda r: (-(r["cost"] or r["output"] * 1000), r["label"]))
    below: dict[str, list[str]] = {r["label"]: [] for r in labels}
    if with_agents and "agent" in priced.columns:
        for r in agents.by_type(priced.where(priced["session"] == session), ["label"]).orderBy("label", "agent_type").collect():
            below[r["label"]].append(f"| ↳ {r['agent_type']} × {r['count']} | {_cells(r)} |")
    if with_models:
        for r in sorted((r for r in found if r["grain"] == 0), key=lambda r: (-(r["cost"] or r["output"] * 1000), str(r["model"]))):
            below[r["label"]].append(f"| · {r['model']} | {_cells(r)} |")
    out = [f"## {session}", "", "| activity | requests | output | input | cache read | cost |", "|---|---:|---:|---:|---:|---:|"]
    for r in labels:
        out += [f"| {r['label']} | {_cells(r)} |", *below[r["label"]]]
    out += [f"| **total** | {_cells(r)} |" for r in found if r["grain"] == 3]
    marked = sum(1 for r in labels if r["partial"] and r["cost"] is not None)
    notes = sentences([*facts, *([Fact("mixed_cost", marked, len(labels))] if marked else [])])
    return "\n".join([*out, *[x for note in notes for x in ("", note)]]) + "\n"


def _cells(r: dict) -> str:
    cost = formats.usd(None if r["cost"] is None else r["cost"] / 1e9) + ("*" if r["partial"] and r["cost"] is not None else "")
    return f"{r['requests']} | {formats.tokens(r['output'])} | {formats.tokens(r['input'])} | {formats.tokens(r['cache_read'])} | {cost}"


def to_csv(rows: DataFrame, by: str) -> str:
    """CSV with a cost of four decimals, empty where it is unknown."""
    buffer = io.StringIO()
    writer = csv.writer(buffer, lineterminator="\n")
    writer.writerow([by, "requests" if by == "model" else "calls", "output", "input", "cache_read", "cache_5m", "cache_1h", "cost_usd"])
    for r in rows.collect():
        writer.writerow([r["key"], r["calls"], r["output"], r["input"], r["cache_read"], r["cache_5m"], r["cache_1h"], "" if r["cost"] is None else f"{r['cost'] / 1e9:.4f}"])
    return buffer.getvalue()


def diff_markdown(rows: DataFrame) -> str:
    out = ["| label | old | new | change |", "|---|---:|---:|---:|"]
    for r in rows.orderBy("rank").collect():
        old, new, delta = (None if r[c] is None else r[c] / 1e9 for c in ("old_cost", "new_cost", "delta"))
        out.append(f"| {r['label']} | {formats.usd(old)} | {formats.usd(new)} | {formats.delta(delta)} |")
    return "\n".join(out) + "\n"


def findings_markdown(found: DataFrame) -> str:
    lines = [f"- **{r['severity']}** {r['rule']}: {r['subject']} ({r['value']:.2f})" for r in found.collect()]
    return "\n".join(lines or [f"- {SENTENCES['clear']}"]) + "\n"


#: Width of a day's bar, and of a label below it, in pixels.
BAR, LABEL = 12, 62


def _money(nano: int | None) -> str:
    return formats.usd(None if nano is None else nano / 1e9)


def dashboard_html(rows: DataFrame, title: str = "Usage", levels: Mapping[str, int] | None = None, notes: Sequence[str] = ()) -> str:
    """One page without outside assets: cards, a bar for each day, a table for each grain, notes; all text is escaped.

    Every so many days carry a label below their bar, so that labels never overlap. Where no session recorded tokens,
    cards show no cost.
    """
    data = [r.asDict() for r in rows.collect()]
    days = sorted((r for r in data if r["grain"] == "day"), key=lambda r: str(r["key"]))
    known = [r["cost"] for r in days if r["cost"] is not None]
    most = max(known, default=0) or 1
    stride = -(-LABEL // BAR)
    bars = ""
    for i, r in enumerate(days):
        height = 100 * (r["cost"] or 0) / most
        bars += f'<rect x="{BAR * i}" y="{100 - height:.1f}" width="{BAR - 2}" height="{height:.1f}"><title>{formats.escape(str(r["key"]))}: {_money(r["cost"])}</title></rect>'
        if i % stride == 0:
            bars += f'<text x="{BAR * i}" y="114" font-size="10">{formats.escape(str(r["key"]))}</text>'
    whole, blind = sum((levels or {}).values()), (levels or {}).get("activity_only", 0)
    spent = None if (whole and blind == whole) or not known else sum(known)
    cards = {"cost": _money(spent), "days": str(len(days)), "sessions": str(whole), **{level: f"{n} of {whole}" for level, n in (levels or {}).items() if level != "exact"}}
    shown = "".join(f"<div class=card><strong>{formats.escape(value)}</strong> {formats.escape(name)}</div>" for name, value in cards.items())
    tables = ""
    for grain in sorted({r["grain"] for r in data} - {"day"}):
        body = "".join(f"<tr><td>{formats.escape(str(r['key']))}</td><td>{_money(r['cost'])}</td></tr>" for r in sorted((r for r in data if r["grain"] == grain), key=lambda r: r["rank"]))
        tables += f"<h2>{formats.escape(grain)}</h2><table>{body}</table>"
    told = "".join(f"<p>{formats.escape(note)}</p>" for note in notes)
    return f'<!doctype html><meta charset="utf-8"><title>{formats.escape(title)}</title><h1>{formats.escape(title)}</h1>{shown}<svg width="{BAR * len(days) + LABEL}" height="118">{bars}</svg>{tables}{told}'


def write_atomic(path: str, text: str) -> None:
    """Write beside the file, then replace it; nothing half-written stays."""
    temporary = f"{path}.{os.getpid()}.tmp"
    try:
        with open(temporary, "w", encoding="utf-8") as file:
            file.write(text)
        os.replace(temporary, path)
    except BaseException:
        with suppress(OSError):
            os.remove(temporary)
        raise
