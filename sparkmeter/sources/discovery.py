"""Finding logs: which session is meant, which host wrote a file, whether a root can be read at all.

Paths of one machine are looked at by the driver; corpora are scanned by Spark (``log_lines``, ``workspaces``, ``newest_first``).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.normalize import get
from . import jsonl

#: Folders that hold no logs of their own.
SKIPPED = r"/(\.[^/]+|node_modules)/"


class Ambiguous(ValueError):
    """Several hosts have sessions and none was named."""


def newest(paths: Iterable[Path]) -> Path | None:
    """The file that changed last; of equal ones the last by name."""
    return max(paths, key=lambda p: (p.stat().st_mtime_ns, p.name), default=None)


def slug(path: str | Path) -> str:
    return re.sub(r"[^A-Za-z0-9]", "-", str(path))


def find_session(root: Path, explicit: str | None = None, session_id: str | None = None, environment: Mapping[str, str] = os.environ, project: Path | None = None, here: Path | None = None, other_roots: Iterable[Path] = (), variable: str = "SPARKMETER_SESSION") -> tuple[Path | None, str | None]:
    """The session's file and the rule that found it.

    A path, an id or the environment's path decide alone, found or not; a named project is never replaced by
    another one. Without any of them: the folder of ``here``, then the other roots, then any project.
    """
    for rule, named in (("explicit", explicit), ("env", None if session_id else environment.get(variable))):
        if named:
            return (Path(named) if Path(named).is_file() else None), rule
    if session_id:
        clean = re.sub(r"[^A-Za-z0-9_-]", "", session_id)
        return (newest(root.glob(f"*/{clean}.jsonl")) if clean else None), "session_id"
    own = root / slug((project or here or Path.cwd()).resolve())
    steps: list[tuple[str, Iterator[Path]]] = [("project" if project else "here", own.glob("*.jsonl"))]
    if not project:
        steps += [("other_root", other.glob("*/*.jsonl")) for other in other_roots]
        steps.append(("any_project", root.glob("*/*.jsonl")))
    for rule, paths in steps:
        if found := newest(paths):
            return found, rule
    return None, None


def unreadable_root(root: Path) -> str | None:
    """The root as text where it is no folder that this process can list; an empty scan of it would look like no spend."""
    fine = root.is_dir() and os.access(root, os.R_OK | os.X_OK)
    return None if fine else str(root)


def _first_object(path: Path) -> dict:
    """The first line that is a JSON object, else the whole file as one, else nothing."""
    with path.open(encoding="utf-8", errors="replace") as lines:
        for _, line in zip(range(50), lines, strict=False):
            try:
                found = json.loads(line)
            except (ValueError, RecursionError):
                continue
            if isinstance(found, dict):
                return found
    try:
        whole = json.loads(path.read_text(encoding="utf-8", errors="replace")) if path.suffix == ".json" else None
    except (ValueError, RecursionError):
        whole = None
    return whole if isinstance(whole, dict) else {}


def runtime_of_file(path: Path) -> str:
    """The host that wrote a file, by what its first record looks like."""
    first = _first_object(path)
    kind, data = first.get("type"), first.get("data")
    captured = isinstance(kind, str) and kind.endswith(".capture") and isinstance(data, dict) and "sessionId" in data
    if kind == "session.start" or captured:
        return "copilot"
    if "projectHash" in first or ("step_index" in first and "source" in first):
        return "gemini"
    if first.get("type") == "session_meta" or isinstance(first.get("payload"), dict):
        return "codex"
    if "composerId" in first or "generation_id" in first or ("messages" in first and path.suffix == ".json"):
        return "cursor"
    return "claude"


def one_runtime(present: Mapping[str, bool]) -> str:
    """The one host that has sessions (the first known one where none has); several are an error, not a guess. Cloud ledgers never count."""
    found = [name for name, there in present.items() if there and name != "cursor-cloud"]
    if len(found) > 1:
        raise Ambiguous(f"several hosts have sessions ({', '.join(sorted(found))}): name one")
    return found[0] if found else "claude"


def hook_payload(raw: bytes) -> dict | None:
    """A hook's input: any bytes, an object or nothing."""
    try:
        found = json.loads(raw.decode("utf-8", "replace") or "null")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def env_values(content: str) -> dict[str, str]:
    """Assignments of an environment file: comments, ``export`` and quotes understood, anything else left out."""
    found = {}
    for line in content.splitlines():
        if match := re.match(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$", line):
            name, value = match.groups()
            quoted = re.match(r"""(['"])(.*?)\1""", value)
            found[name] = quoted[2] if quoted else value.split(" #")[0].strip()
    return found


def log_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of all logs under a root but for hidden folders and installed packages."""
    below = F.substring("path", F.instr("path", root.rstrip("/")) + len(root.rstrip("/")), F.length("path"))
    return jsonl.scan(spark, root, recursive=True, name_glob="*.jsonl").where(~below.rlike(SKIPPED))


def workspaces(spark: SparkSession, root: str) -> DataFrame:
    """Workspace id and folder of each ``workspace.json`` under a root."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "workspace.json").option("wholetext", "true").text(root)
    v = F.try_parse_json(F.make_valid_utf8("value"))
    uri = F.coalesce(get(v, "$.folder"), get(v, "$.workspace"))
    return whole.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/workspace\.json$", 1).alias("workspace"), F.coalesce(text.file_uri_path(uri), uri).alias("folder")).where("folder is not null")


def with_folders(composers: DataFrame, folders: DataFrame, workspace: str = "workspace") -> DataFrame:
    """Composers with the folder of their workspace, null where it is unknown."""
    return composers.join(folders, workspace, "left")


def newest_first(files: DataFrame) -> DataFrame:
    """Files (path, mtime) by their time, newest first, equal ones by name; the first of each session is the one that counts."""
    return files.orderBy(F.col("mtime").desc(), F.col("path").desc())
