"""Text, label and path functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters kept of a prompt, and of a long text (with a marker after them).
PROMPT_CHARS, CLIP_CHARS = 120, 20_000
#: Wire values (fixed): vendor of a runtime, its source type and surface where they differ from the vendor.
VENDORS = {"grok": "grok", "grok_bot": "grok", "cursor": "cursor", "cloud_agent": "cursor", "claude": "claude", "claude_code": "claude", "codex": "codex", "gemini": "gemini", "antigravity": "gemini"}
SOURCE_TYPES = {"grok": "grok_bot"}
SURFACES = {"grok": "grok_bot", "codex": "codex", "claude": "claude_code", "gemini": "antigravity"}


def strip(x: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def command_tag(text: Column) -> Column:
    """Name in a command tag, or null."""
    name = strip(F.regexp_extract(text, r"<command-name>([^<]+)", 1))
    return F.when(F.length(name) > 0, name)


def command_label(text: Column) -> Column:
    """A leading ``$name`` or ``/name``, or null."""
    name = F.regexp_extract(text, r"(?U)^\s*([$/][A-Za-z0-9][A-Za-z0-9_:-]*)\b", 1)
    return F.when(F.length(name) > 0, name)


def skill_of_path(path: Column) -> Column:
    name = F.regexp_extract(path, r"[/\\]skills[/\\]([A-Za-z0-9][A-Za-z0-9_:-]*)[/\\]SKILL\.md$", 1)
    return F.when(F.length(name) > 0, name)


def slug(path: Column) -> Column:
    """Every character but ASCII letters and digits becomes a hyphen."""
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")


def safe_id(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9_-]", "")


def repo_of_url(url: Column) -> Column:
    """Path of a repository url without leading slash and ``.git``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "^/+|/+$", ""), r"\.git$", "")


def clip(text: Column, limit: int = CLIP_CHARS, marker: str = "…[truncated]") -> Column:
    """The first ``limit`` characters, with a marker where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def prompt(text: Column) -> Column:
    return F.substring(strip(text), 1, PROMPT_CHARS)


def activity_label(title: Column, text: Column) -> Column:
    """Title, else the start of the prompt, else a fixed name."""

    def filled(x: Column) -> Column:
        return F.when(F.length(strip(x)) > 0, strip(x))

    return F.coalesce(filled(title), F.substring(filled(text), 1, PROMPT_CHARS), F.lit("(no activity)"))


def source_id(session: Column, agent: Column, turn: Column) -> Column:
    """``session[:agent]:turn-n``."""
    agent = F.when(F.length(agent) > 0, F.concat(F.lit(":"), agent)).otherwise("")
    return F.concat(session, F.coalesce(agent, F.lit("")), F.lit(":turn-"), turn.cast("string"))


def _runtime(runtime: Column) -> Column:
    return F.translate(F.lower(F.coalesce(runtime, F.lit(""))), "-", "_")


def _mapped(x: Column, names: dict[str, str], other: Column) -> Column:
    for name, to in names.items():
        other = F.when(x == name, F.lit(to)).otherwise(other)
    return other


def vendor(runtime: Column) -> Column:
    """Vendor of a runtime; an unknown one is its own, none is cursor."""
    name = _runtime(runtime)
    return _mapped(name, VENDORS, F.when(F.length(name) > 0, name).otherwise(F.lit("cursor")))


def source_type(runtime: Column) -> Column:
    return _mapped(vendor(runtime), SOURCE_TYPES, vendor(runtime))


def surface(runtime: Column, path: Column) -> Column:
    """Where a session ran: a cloud agent by its path, else by its runtime."""
    cloud = F.lower(F.translate(path, "\\", "/")).rlike("cloud[-_]agent")
    known = F.when(_runtime(runtime).isin(*VENDORS), vendor(runtime))
    return F.when(F.coalesce(cloud, F.lit(False)), F.lit("cloud_agent")).otherwise(_mapped(F.coalesce(known, F.lit("")), SURFACES, F.lit("ide")))


def inferred_runtime(path: Column, named: Column) -> Column:
    """Vendor by its name where one is given, else by the path."""
    low = F.lower(F.translate(path, "\\", "/"))
    by_path = F.when(low.contains("grok"), "grok").when(low.contains("codex"), "codex").when(low.contains(".claude") | low.contains("/claude/"), "claude")
    by_path = by_path.when(low.contains("gemini") | low.contains("antigravity"), "gemini").otherwise("cursor")
    return F.when(F.length(F.coalesce(named, F.lit(""))) > 0, vendor(named)).otherwise(by_path)


def sidechain(path: Column) -> Column:
    """Parent session and agent of a subagent's file (struct of empty strings for any other path)."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    at = F.array_position(F.transform(parts, F.lower), "subagents").cast("int")
    parent = F.when(at > 1, F.element_at(parts, F.greatest(at - 1, F.lit(1)))).otherwise("")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    return F.struct(F.when(at > 0, parent).otherwise("").alias("parent"), F.when(at > 0, stem).otherwise("").alias("agent"))


def project_hash(path: Column) -> Column:
    return F.sha2(path, 256)


def antigravity_prompt(content: Column) -> Column:
    """Inner text of a closed request tag; content without a tag, or with one that is never closed, stays as it is."""
    start = F.instr(content, "<USER_REQUEST>")
    rest = F.substring(content, start + 14, F.length(content))
    end = F.instr(rest, "</USER_REQUEST>")
    return F.when((start > 0) & (end > 0), F.substring(rest, F.lit(1), end - 1)).otherwise(content)


def json_depth(raw: Column) -> Column:
    """How deep a JSON text nests, strings left out; without a parser, so that no depth can hurt."""
    bare = F.regexp_replace(F.regexp_replace(raw, r'"(?:[^"\\\\]|\\\\.)*"', ""), r"[^\[\]{}]", "")
    steps = F.transform(F.split(bare, ""), lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    level = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["now"] + x).alias("now"), F.greatest(acc["most"], acc["now"] + x).alias("most"))

    return F.aggregate(steps, level, step, lambda acc: acc["most"])


def bounded(argument: Column, limit: int = CLIP_CHARS) -> Column:
    """A tool argument as text: nothing is an empty object, a long one is clipped."""
    return F.when(argument.isNull() | (argument == ""), F.lit("{}")).otherwise(clip(argument, limit))


def turn_markdown(runtime: Column, model: Column, prompt_text: Column, tools: Column, assistant: Column) -> Column:
    """One turn as Markdown; ``tools``: array of structs of name, input and result."""
    def line(call: Column) -> Column:
        head = F.concat(F.lit("- `"), F.coalesce(F.nullif(call["name"], F.lit("")), F.lit("tool")), F.lit("` "), bounded(call["input"]))
        result = F.concat(F.lit("\n  result: "), F.regexp_replace(clip(call["result"]), "\n", "\n  "))
        return F.concat(head, F.when(F.length(call["result"]) > 0, result).otherwise(""))

    listed = F.when(F.size(tools) > 0, F.array_join(F.transform(tools, line), "\n")).otherwise("(none)")
    title = F.concat(F.lit("# Chat turn — "), vendor(runtime), F.lit("/"), F.coalesce(F.nullif(model, F.lit("")), F.lit("unknown")))
    return F.concat_ws("\n", title, F.lit(""), F.lit("## User"), clip(prompt_text), F.lit(""), F.lit("## Tools"), listed, F.lit(""), F.lit("## Assistant"), clip(assistant), F.lit(""))


def local_day(ts: Column) -> Column:
    """Day of an ISO time in the session's zone; a time that cannot be read gives its first ten characters, none ``unknown``."""
    return F.coalesce(F.date_format(F.try_to_timestamp(ts), "yyyy-MM-dd"), F.when(F.length(ts) > 0, F.substring(ts, 1, 10)), F.lit("unknown"))


def millis_to_iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_to_time(x: Column) -> Column:
    """Seconds or (over 1e11) milliseconds since the epoch."""
    return F.timestamp_millis(F.when(x > 1e11, x).otherwise(x * 1000).cast("long"))


def earliest(a: Column, b: Column) -> Column:
    return F.least(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def file_uri_path(uri: Column) -> Column:
    return F.when(uri.startswith("file://"), F.url_decode(F.regexp_replace(F.regexp_replace(uri, r"\+", "%2B"), "^file://[^/]*", "")))


def unquoted(argument: Column) -> Column:
    """A JSON-quoted string argument without its quotes; anything else as it is."""
    inner = F.try_variant_get(F.try_parse_json(argument), "$", "string")
    return F.when(argument.startswith('"'), F.coalesce(inner, argument)).otherwise(argument)
