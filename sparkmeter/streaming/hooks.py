"""Hook mode on one machine: event log, session ledger with budget nudges, status line, live view.

A hook must never break the host's session: every entry point returns instead of raising.
"""

from __future__ import annotations

import json
import math
import os
import time
from collections.abc import Callable, Iterable
from contextlib import suppress
from pathlib import Path

from ..functions import formats
from ..plans.render import write_atomic
from .state import budget_step

CLEAR = "\033[2J\033[H"


def append_event(path: Path, event: dict) -> bool:
    """Add one compact line to an event log; a failure loses this event only."""
    try:
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("a", encoding="utf-8") as file:
            file.write(json.dumps(event, ensure_ascii=False, separators=(",", ":")) + "\n")
            file.flush()
            with suppress(OSError):
                os.fsync(file.fileno())
    except (OSError, TypeError, ValueError):
        return False
    return True


#: Bytes from which an event log is closed.
ROLL_BYTES = 8 << 20


def close_log(path: Path, folder: Path, least: int = ROLL_BYTES) -> Path | None:
    """Move an event log of at least so many bytes into a folder of closed logs, which a stream reads; the next event begins a new one."""
    try:
        if path.stat().st_size < least:
            return None
        folder.mkdir(parents=True, exist_ok=True)
        return path.rename(folder / f"{time.time_ns()}-{os.getpid()}.jsonl")
    except OSError:
        return None


def notified_before(ledger: Path) -> int:
    """The budget multiple that a ledger says was announced; older ledgers hold a flag only."""
    try:
        held = json.loads(ledger.read_text(encoding="utf-8", errors="replace"))
    except (OSError, ValueError):
        return 0
    held = held if isinstance(held, dict) else {}
    multiple = held.get("notified_multiple")
    if isinstance(multiple, (int, float)) and not isinstance(multiple, bool):
        return int(multiple) if math.isfinite(multiple) else 0
    return int(bool(held.get("notified")))


def write_ledger(folder: Path, name: str, data: dict, latest: bool) -> None:
    """Replace a session's ledger, and let ``latest.json`` point to it if asked to."""
    folder.mkdir(parents=True, exist_ok=True)
    write_atomic(str(folder / f"{name}.json"), json.dumps(data, indent=1))
    if latest:
        link = folder / f".latest.{os.getpid()}"
        with suppress(OSError):
            link.unlink(missing_ok=True)
            link.symlink_to(folder / f"{name}.json")
            link.replace(folder / "latest.json")


def stop(folder: Path, session: str, runtime: str, labels: Iterable[dict], limit: float | None, subagent: bool = False) -> str | None:
    """Write the ledger of a session that stopped (rows of label, cost, output) and give the message of a newly passed budget multiple.

    Only the end of the session itself advances the multiple, and the message comes even where the ledger
    cannot be written. Only one host's ledgers are the latest ones, so that no other shows up in its status line.
    """
    rows = list(labels)
    known = [r["cost"] for r in rows if r["cost"] is not None]
    cost = sum(known) if known else None
    name = session if runtime == "claude" else f"{runtime}-{session}"
    state = {"notified": notified_before(folder / f"{name}.json")}
    multiple = budget_step(state, cost, limit, not subagent) if limit and cost is not None and math.isfinite(cost) else None
    multiple = None if subagent else multiple
    data = {"session_id": session, "runtime": runtime, "cost": formats.finite(cost), "output": sum(r["output"] for r in rows), "labels": rows, "notified": state["notified"] >= 1, "notified_multiple": state["notified"]}
    with suppress(OSError, TypeError, ValueError):
        write_ledger(folder, name, data, runtime == "claude")
    if multiple is None:
        return None
    top = max(rows, key=lambda r: r["cost"] or 0)["label"]
    passed = f"{multiple}× the ${limit:.2f} budget" if multiple > 1 else f"the ${limit:.2f} budget"
    return json.dumps({"systemMessage": f"Session estimate ${cost:.2f} has passed {passed}; most of it: {top}"})


def status_line(ledger: Path) -> str:
    """Output tokens, cost and the most expensive label of a ledger; empty where there is none."""
    try:
        data = json.loads(ledger.read_text(encoding="utf-8"))
        top = max(data["labels"], key=lambda r: r["cost"] or 0, default={"label": "-"})["label"]
        return f"{formats.tokens(data['output'])} out · {formats.usd(data['cost'])} · {top}"
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return ""


def live(view: Callable[[], str], write: Callable[[str], None], interval: float = 2.0, iterations: int | None = None, terminal: bool = False, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], str] = lambda: time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())) -> int:
    """Show a view again and again; each time it is computed anew, so a new session is found too. How often it was shown."""
    if interval <= 0 or (iterations is not None and iterations <= 0):
        raise ValueError("interval and iterations must be over zero")
    shown = 0
    while iterations is None or shown < iterations:
        if shown:
            sleep(interval)
        lead = "" if not shown else CLEAR if terminal else f"\n--- {clock()} ---\n"
        write(lead + view() + "\n")
        shown += 1
    return shown
