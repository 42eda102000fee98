"""The queries as tools of an assistant protocol: schemas, strict argument checks, calls."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from . import api, render

KINDS = {"string": str, "boolean": bool, "integer": int, "number": (int, float), "object": dict}
_TEXT = {"type": "string", "minLength": 1}
_GRAIN = {"type": "string", "enum": ["project", "day", "command", "model"]}
_WINDOW = {"since": _TEXT, "project": _TEXT}


def _schema(properties: dict, required: tuple[str, ...] = ()) -> dict:
    return {"type": "object", "properties": properties, "required": list(required), "additionalProperties": False}


TOOLS = {
    "session_cost": ("Cost of one session by command, and by agent type or model.", _schema({"session": _TEXT, "agents": {"type": "boolean"}, "models": {"type": "boolean"}}, ("session",))),
    "history": ("Cost over all sessions by project, day, command or model.", _schema({"by": _GRAIN, **_WINDOW})),
    "insights": ("Findings about a session, or about a window of time.", _schema({"session": _TEXT, **_WINDOW, "budget_usd": {"type": "number", "exclusiveMinimum": 0}})),
    "diff": ("Two sessions, command by command.", _schema({"old": _TEXT, "new": _TEXT}, ("old", "new"))),
    "top_consumers": ("The most expensive sessions or commands of a window.", _schema({"by": {"type": "string", "enum": ["session", "command"]}, **_WINDOW, "limit": {"type": "integer", "minimum": 1}})),
}


def problems(schema: dict, arguments: Any) -> list[str]:
    """All that is wrong with some arguments; nothing where they are fine."""
    if not isinstance(arguments, dict):
        return ["arguments must be an object"]
    known = schema["properties"]
    found = [f"unknown argument {name!r}" for name in arguments if name not in known]
    found += [f"missing required argument {name!r}" for name in schema["required"] if name not in arguments]
    for name, rule in known.items():
        if name in arguments:
            found += _problem(name, arguments[name], rule)
    return found


def _problem(name: str, value: Any, rule: dict) -> list[str]:
    kind = rule["type"]
    numeric = kind in ("integer", "number")
    if not isinstance(value, KINDS[kind]) or (numeric and isinstance(value, bool)):
        return [f"{name} must be {'an' if kind[0] in 'aeiou' else 'a'} {kind}"]
    if numeric and not math.isfinite(value):
        return [f"{name} must be a finite number"]
    checks = {
        f"{name} must be one of {rule.get('enum')}": "enum" not in rule or value in rule["enum"],
        f"{name} must be >= {rule.get('minimum')}": "minimum" not in rule or value >= rule["minimum"],
        f"{name} must be > {rule.get('exclusiveMinimum')}": "exclusiveMinimum" not in rule or value > rule["exclusiveMinimum"],
        f"{name} must be at least {rule.get('minLength')} character(s)": "minLength" not in rule or len(value) >= rule["minLength"],
    }
    return [message for message, fine in checks.items() if not fine]


def call(name: str, arguments: dict, priced: Callable[..., DataFrame], now=None) -> str:
    """The Markdown answer of a tool; ``priced(since, project)`` gives the requests of a window. Wrong arguments raise ``OptionError``."""
    if name not in TOOLS:
        raise api.OptionError(f"no such tool: {name}")
    if wrong := problems(TOOLS[name][1], arguments):
        raise api.OptionError("; ".join(wrong))
    since, project = arguments.get("since"), arguments.get("project")
    api.since_cutoff(since, now)
    if name == "session_cost":
        return render.report_markdown(priced(None, None), arguments["session"], arguments.get("agents", False), arguments.get("models", False))
    if name == "history":
        by = arguments.get("by", "project")
        return render.markdown(api.history(priced(since, project), by), f"By {by}")
    if name == "diff":
        return render.diff_markdown(api.diff(priced(None, None), arguments["old"], arguments["new"]))
    if name == "top_consumers":
        by = arguments.get("by", "session")
        return render.markdown(api.top_consumers(priced(since or "30d", project), by, arguments.get("limit", 10))[0].orderBy("rank"), f"Top {by}s")
    if "session" in arguments and since:
        raise api.OptionError("give a session or since, not both")
    if "session" not in arguments and not since:
        raise api.OptionError("give a session, or since for a window")
    if project and not since:
        raise api.OptionError("project belongs to a window (since)")
    if since:
        cutoff = api.since_cutoff(since, now)
        return render.findings_markdown(api.window_insights(priced(since, project), api.window_middle(cutoff, now)))
    return render.findings_markdown(api.session_insights(priced(None, None), arguments["session"], arguments.get("budget_usd"), now))
