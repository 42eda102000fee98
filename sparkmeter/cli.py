"""Command line: history, top, report, diff, insights, export, dashboard, tools and live over one host's logs.

Every command reads the index of the logs; only what changed since the last command is parsed (``streaming.index``).
"""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import re
import sys
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formats
from .operators import pricing
from .plans import api, corpus, disclosure, render, sync, tools
from .plans.disclosure import Fact
from .session import session as start
from .sources import discovery
from .sources.prices import price_list
from .streaming import hooks
from .streaming.index import Index, price_fingerprint

#: Files that are looked at to tell which host wrote a folder of logs.
PROBED = 200


class Logs:
    """One host's logs, through their index."""

    def __init__(self, spark: SparkSession, options: argparse.Namespace):
        self.spark, self.options = spark, options
        self.runtime = options.runtime or detect(options.root)
        layers = []
        for path in options.prices:
            with open(path, encoding="utf-8") as file:
                layers.append(file.read())
        self.index = Index(spark, options.index or default_index(options.root), self.runtime)
        self.refreshed = self.index.refresh(options.root, price_list(spark, *layers), price_fingerprint(layers))

    def priced(self, since: str | None = None, project: str | None = None) -> DataFrame:
        return api.window(self.index.priced(), api.since_cutoff(since), project)

    def labels(self, priced: DataFrame) -> DataFrame:
        """Invocations of the sessions in question; a session without usage counts unless a window leaves it out."""
        labels = self.index.table("labels")
        if not (self.options.since or self.options.project):
            return labels
        cutoff, wanted = api.since_cutoff(self.options.since), self.index.table("sessions")
        wanted = wanted.where(F.col("first_ts") >= cutoff) if cutoff else wanted
        wanted = wanted.where(F.col("project").contains(self.options.project)) if self.options.project else wanted
        return labels.join(wanted.select("family", "session"), ["family", "session"], "left_semi")

    def sessions(self) -> DataFrame:
        return self.index.table("sessions")

    def session(self, named: str | None) -> str:
        """The session that is meant: a path or an id, else the one that the host's rules find, else the one with the last record."""
        if named and Path(named).is_file():
            return Path(named).stem
        if named:
            return named
        if self.runtime == "claude":
            found, _ = discovery.find_session(Path(self.options.root))
            if found:
                return found.stem
        last = self.sessions().agg(F.max_by("session", F.struct("last_ts", "session")).alias("session")).first()["session"]
        if last is None:
            raise api.OptionError("no session was found")
        return last

    def facts(self, priced: DataFrame, session: str | None = None) -> list[Fact]:
        """What is to be said about a result over some priced cells."""
        wanted = self.sessions() if session is None else self.sessions().where(F.col("session") == session)
        told = disclosure.facts_frame(priced.where(F.col("cost").isNull() & pricing.has_tokens() & F.col("model").isNotNull()), "no_rate", "model")
        if session is None:
            bad = self.index.table("sources").where("unreadable").select(F.substring_index("path", "/", -1).alias("name"))
            told = told.unionByName(disclosure.facts_frame(bad, "unreadable", "name"))
        levels = {r["measurement"]: r["n"] for r in wanted.groupBy("measurement").agg(F.count("*").alias("n")).collect()}
        return [*disclosure.collected(told), *disclosure.level_facts(levels)]


def default_index(root: str) -> str:
    """Where the index of a root is kept if no folder is named."""
    home = os.environ.get("SPARKMETER_INDEX") or str(Path.home() / ".cache" / "sparkmeter")
    return f"{home}/{hashlib.sha256(str(Path(root).resolve()).encode()).hexdigest()[:16]}"


def detect(root: str) -> str:
    """The host that wrote the logs under a root, by the shape of some of its newest files; several are an error."""
    found: list[tuple[float, str]] = []
    for folder, below, names in os.walk(root):
        below[:] = [d for d in below if not d.startswith(".") and d not in ("node_modules", "subagents")]
        found += [(os.stat(path).st_mtime, path) for name in names if re.search(corpus.LOG_FILES, path := f"{folder}/{name}")]
    newest = [path for _, path in sorted(found, reverse=True)[:PROBED]]
    present = {"cursor" if path.endswith(".vscdb") else discovery.runtime_of_file(Path(path)) for path in newest}
    return discovery.one_runtime(dict.fromkeys(present, True))


def rate_note(priced: DataFrame, since: str | None) -> list[str]:
    """Spend a day over a window of days."""
    days = int(since[:-1]) if since and re.fullmatch(r"\d+d", since) else 0
    spent = priced.agg(F.sum("cost").alias("cost")).first()["cost"] if days else None
    pace = formats.burn_rate(None if spent is None else spent / 1e9, days)
    return [f"About {formats.usd(pace[0])} a day over the last {days} days, {formats.usd(pace[1])} a week at this pace."] if pace else []


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkmeter")
    top.add_argument("--runtime", choices=sorted(corpus.HOSTS), help="the host that wrote the logs; found out if left away")
    top.add_argument("--root", required=True, help="folder of the logs")
    top.add_argument("--index", help="folder of the index")
    top.add_argument("--prices", action="append", default=[], help="JSON price map; later ones replace keys of earlier ones")
    top.add_argument("--since", help="Nd or an ISO date")
    top.add_argument("--project", help="only projects that contain this text")
    commands = top.add_subparsers(dest="command", required=True)
    grains = ["project", "day", "model", "command"]
    history = commands.add_parser("history")
    history.add_argument("--by", choices=grains, default="project")
    history.add_argument("--csv", action="store_true")
    best = commands.add_parser("top")
    best.add_argument("--by", choices=["session", "command"], default="session")
    best.add_argument("-n", type=int, default=10)
    for name in ("report", "live"):
        report = commands.add_parser(name)
        report.add_argument("session", nargs="?", help="path or id; the latest if left away")
        report.add_argument("--agents", action="store_true")
        report.add_argument("--models", action="store_true")
        report.add_argument("--interval", type=float, default=2.0)
        report.add_argument("--iterations", type=int)
    diff = commands.add_parser("diff")
    diff.add_argument("old")
    diff.add_argument("new")
    insights = commands.add_parser("insights")
    insights.add_argument("session", nargs="?", help="path or id; with --since a window is looked at instead")
    insights.add_argument("--budget", type=float)
    export = commands.add_parser("export")
    export.add_argument("--scope", choices=["history", "session"], default="history")
    export.add_argument("--by", choices=grains, default="project")
    export.add_argument("--session")
    export.add_argument("--out", help="folder that the records are written to")
    commands.add_parser("dashboard").add_argument("out")
    send = commands.add_parser("sync", help="send the turns of the logs")
    send.add_argument("url")
    send.add_argument("--outbox", required=True, help="folder of what waits and what was delivered")
    tool = commands.add_parser("tool")
    tool.add_argument("name", choices=sorted(tools.TOOLS))
    tool.add_argument("arguments", nargs="?", default="{}", help="JSON object")
    return top


def run(arguments: list[str], spark: SparkSession | None = None) -> str:
    """The text that a command prints."""
    return "".join(parts(arguments, spark))


def parts(arguments: list[str], spark: SparkSession | None = None) -> Iterator[str]:
    """The text that a command prints, piece by piece; a long export is never held as a whole."""
    options = parser().parse_args(arguments)
    if options.command in ("report", "diff", "live", "tool") and options.since:
        raise api.OptionError(f"{options.command} names its sessions: --since does not go with it")
    if options.command == "insights" and options.session and options.since:
        raise api.OptionError("give a session or --since, not both")
    if missing := discovery.unreadable_root(Path(options.root)):
        yield disclosure.sentences([Fact("no_root", 1, 1, (missing,))])[0] + "\n"
        return
    if options.command == "sync":
        left = sync.sync(spark or start(), options.root, options.outbox, sync.poster(options.url))
        yield f"{left} turn(s) wait\n" if left else "all turns were delivered\n"
        return
    logs = Logs(spark or start(), options)
    priced = logs.priced(options.since, options.project)
    yield from COMMANDS[options.command](logs, priced, options)


def _noted(body: str, notes: list[str]) -> str:
    return "\n".join([body, *notes]) + ("\n" if notes else "")


def _history(logs: Logs, priced: DataFrame, options: argparse.Namespace) -> Iterator[str]:
    found = api.history(priced, options.by, logs.labels(priced))
    if options.csv:
        yield render.to_csv(found, options.by)
    else:
        yield _noted(render.markdown(found, f"By {options.by}"), [*rate_note(priced, options.since), *disclosure.sentences(logs.facts(priced))])


def _top(logs: Logs, priced: DataFrame, options: argparse.Namespace) -> Iterator[str]:
    shown, cut = api.top_consumers(priced, options.by, options.n, logs.labels(priced))
    hidden = cut.first()["hidden"]
    notes = [f"{hidden} row(s) of unknown cost are not shown."] if hidden else []
    yield _noted(render.markdown(shown.orderBy("rank"), f"Top {options.by}s"), [*notes, *disclosure.sentences(logs.facts(priced))])


def _report(logs: Logs, priced: DataFrame, options: argparse.Namespace) -> Iterator[str]:
    session = logs.session(options.session)
    yield render.report_markdown(priced, session, options.agents, options.models, logs.facts(priced.where(F.col("session") == session), session))


def _live(logs: Logs, priced: DataFrame, options: argparse.Namespace) -> Iterator[str]:
    out: list[str] = []
    hooks.live(lambda: "".join(_report(Logs(logs.spark, options), priced, options)), out.append, options.interval, options.iterations or 1)
    yield from out


def _diff(logs: Logs, priced: DataFrame, options: argparse.Namespace) -> Iterator[str]:
    old, new = logs.session(options.old), logs.session(options.new)
    known = {r["session"] for r in logs.sessions().where(F.col("session").isin(old, new)).select("session").distinct().collect()}
    if lacking := sorted({old, new} - known):
        raise api.OptionError(f"not a session of {logs.runtime}: {', '.join(lacking)}")
    yield render.diff_markdown(api.diff(priced, old, new))


def _insights(logs: Logs, priced: DataFrame, options: argparse.Namespace) -> Iterator[str]:
    if options.since:
        middle = api.window_middle(api.since_cutoff(options.since))
        early = priced.where(F.col("ts") < middle).agg(F.countDistinct("session").alias("n"), F.sum("cost").alias("cost")).first()
        whole = priced.select("session").distinct().count()
        found, facts = api.window_insights(priced, middle), disclosure.window_facts(whole, early["n"], early["cost"])
    else:
        session = logs.session(options.session)
        budget = options.budget if options.budget is not None else disclosure.budget_of(os.environ.get("SPARKMETER_BUDGET"))
        found, facts = api.session_insights(priced, session, budget), disclosure.comparison_facts(api.baseline_sessions(priced, session))
    yield _noted(render.findings_markdown(found), disclosure.sentences(facts))


def _export(logs: Logs, priced: DataFrame, options: argparse.Namespace) -> Iterator[str]:
    if options.scope == "session":
        session = logs.session(options.session)
        level = logs.sessions().where(F.col("session") == session).agg(F.max("measurement").alias("m")).first()["m"] or "exact"
        records = api.export_session(priced, session, logs.runtime, level)
    else:
        records = api.export(priced, options.by, logs.runtime)
    if options.out:
        records.write.mode("errorifexists").text(options.out)
        yield f"{options.out}\n"
    else:
        yield from (f"{r['value']}\n" for r in records.toLocalIterator())


def _dashboard(logs: Logs, priced: DataFrame, options: argparse.Namespace) -> Iterator[str]:
    levels = {r["measurement"]: r["n"] for r in logs.sessions().groupBy("measurement").agg(F.count("*").alias("n")).collect()}
    render.write_atomic(options.out, render.dashboard_html(api.dashboard(priced), levels=levels, notes=disclosure.sentences(logs.facts(priced))))
    yield f"{options.out}\n"


def _tool(logs: Logs, priced: DataFrame, options: argparse.Namespace) -> Iterator[str]:
    try:
        arguments = json.loads(options.arguments)
    except ValueError as error:
        raise api.OptionError(f"no JSON: {options.arguments}") from error
    yield tools.call(options.name, arguments, logs.priced)


COMMANDS = {"history": _history, "top": _top, "report": _report, "live": _live, "diff": _diff, "insights": _insights, "export": _export, "dashboard": _dashboard, "tool": _tool}


def main() -> None:
    try:
        for part in parts(sys.argv[1:]):
            sys.stdout.write(part)
    except (api.OptionError, discovery.Ambiguous) as error:
        sys.exit(f"sparkmeter: {error}")


if __name__ == "__main__":
    main()
