"""Discovery, disclosure, tools, and hooks: what runs beside Spark."""

import json
import os
from pathlib import Path

import pytest

from sparkmeter.plans import disclosure, tools
from sparkmeter.sources import discovery
from sparkmeter.streaming import hooks


def put(path: Path, text="{}", mtime=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if mtime:
        os.utime(path, (mtime, mtime))
    return path


def test_find_session_stops_at_the_rule_that_was_named(tmp_path):
    root, here = tmp_path / "projects", tmp_path / "work.dir"
    here.mkdir()
    old, new = put(root / "p" / "a.jsonl", mtime=100), put(root / "q" / "a.jsonl", mtime=200)
    find = lambda **k: discovery.find_session(root, environment=k.pop("environment", {}), here=here, **k)
    assert find(explicit=str(old)) == (old, "explicit") and find(explicit="nowhere") == (None, "explicit")
    assert find(session_id="../a") == (new, "session_id") and find(session_id="//") == (None, "session_id")
    assert find(environment={"SPARKMETER_SESSION": str(old)}) == (old, "env") and find(environment={"SPARKMETER_SESSION": "x"}) == (None, "env")
    assert find() == (new, "any_project") and find(project=tmp_path / "none") == (None, None)
    mine = put(root / discovery.slug(here.resolve()) / "b.jsonl", mtime=50)
    assert find() == (mine, "here") and find(project=here) == (mine, "project")
    other = put(tmp_path / "other" / "z" / "c.jsonl")
    mine.unlink()
    assert find(other_roots=[tmp_path / "other"]) == (other, "other_root")


def test_runtime_by_content(tmp_path):
    lines = {
        "copilot": '{"type": "session.start"}', "gemini": 'not json\n{"sessionId": "s", "projectHash": "h"}', "codex": '{"type": "session_meta", "payload": {}}',
        "cursor": '{"generation_id": "g"}', "claude": '{"type": "user", "message": {}}',
    }
    for name, text in lines.items():
        assert discovery.runtime_of_file(put(tmp_path / f"{name}.jsonl", text)) == name
    assert discovery.runtime_of_file(put(tmp_path / "x.json", '{\n"messages": []}')) == "cursor"
    assert discovery.one_runtime({"claude": False, "codex": True, "cursor-cloud": True}) == "codex" and discovery.one_runtime({}) == "claude"
    with pytest.raises(discovery.Ambiguous):
        discovery.one_runtime({"claude": True, "cursor": True})
    assert discovery.unreadable_root(tmp_path) is None and discovery.unreadable_root(tmp_path / "x.json") == str(tmp_path / "x.json")
    assert discovery.hook_payload(b'\xff{"a": 1}') is None and discovery.hook_payload(b'{"a": "\xff"}') == {"a": "�"} and discovery.hook_payload(b"[1]") is None and discovery.hook_payload(b"") is None
    assert discovery.env_values("# c\nexport A = 'x y'\nB=1 # n\nbad line\nC=\"\"") == {"A": "x y", "B": "1", "C": ""}


def test_disclosure(spark):
    Fact = disclosure.Fact
    assert disclosure.worst(["exact", "other", "partial"]) == "partial" and disclosure.worst([]) == "exact"
    told = disclosure.sentences([*disclosure.level_facts({"exact": 2, "partial": 1, "activity_only": 3}), Fact("unreadable", 7, 7, ("a", "b")), Fact("partial", 9, 9)])
    assert told[0].endswith("a, b and 5 more.") and told[1].startswith("1 of 6") and told[2].startswith("3 of 6") and len(told) == 3
    assert disclosure.level_facts({"exact": 4}) == [] and disclosure.sentences([]) == []
    assert disclosure.comparison_facts(3) == [Fact("few_sessions", 3, 5)] and disclosure.comparison_facts(5) == []
    assert disclosure.window_facts(0, 0, None) == [Fact("empty_window")] and disclosure.window_facts(4, 0, 0.0) == [Fact("quiet_start")] and disclosure.window_facts(4, 2, 0.001) == []
    assert [disclosure.budget_of(x) for x in (None, "x", "nan", "0", "-1", "inf", "2.5")] == [None] * 6 + [2.5]
    rows = spark.createDataFrame([(f"m{i % 9}",) for i in range(30)], "model string")
    assert disclosure.collected(disclosure.facts_frame(rows, "no_rate", "model")) == [Fact("no_rate", 9, 9, ("m0", "m1", "m2", "m3", "m4"))]
    assert disclosure.collected(disclosure.facts_frame(rows.where("model = 'x'"), "no_rate", "model")) == []


def test_tool_arguments():
    schema = {name: rule for name, (_, rule) in tools.TOOLS.items()}
    assert tools.problems(schema["diff"], []) == ["arguments must be an object"]
    assert tools.problems(schema["diff"], {"old": "", "x": 1}) == ["unknown argument 'x'", "missing required argument 'new'", "old must be at least 1 character(s)"]
    assert tools.problems(schema["top_consumers"], {"limit": True, "by": "day"}) == ["by must be one of ['session', 'command']", "limit must be an integer"]
    assert tools.problems(schema["insights"], {"budget_usd": float("nan")}) == ["budget_usd must be a finite number"] and tools.problems(schema["insights"], {"budget_usd": 0}) == ["budget_usd must be > 0"]
    for name, arguments in (("insights", {}), ("insights", {"session": "a", "since": "3d"}), ("insights", {"session": "a", "project": "p"}), ("history", {"since": "soon"}), ("nope", {})):
        with pytest.raises(ValueError):
            tools.call(name, arguments, lambda *_: None)


def test_hook_ledger_and_nudge(tmp_path):
    rows = [{"label": "/a", "cost": 4.0, "output": 2_000}, {"label": "/b", "cost": 1.0, "output": 10}, {"label": "/c", "cost": None, "output": 0}]
    stop = lambda **k: hooks.stop(tmp_path, "s", k.pop("runtime", "claude"), rows, **k)
    assert stop(limit=10.0) is None and stop(limit=2.0, subagent=True) is None
    message = json.loads(stop(limit=2.0))["systemMessage"]
    assert "2× the $2.00" in message and message.endswith("/a") and stop(limit=2.0) is None
    assert hooks.status_line(tmp_path / "latest.json") == "2.0k out · $5.00 · /a" and hooks.status_line(tmp_path / "no") == ""
    assert stop(runtime="codex", limit=None) is None and (tmp_path / "codex-s.json").exists() and (tmp_path / "latest.json").resolve().name == "s.json"
    assert hooks.notified_before(put(tmp_path / "old.json", '{"notified": true}')) == 1 and hooks.notified_before(put(tmp_path / "bad.json", "[")) == 0
    blocked = put(tmp_path / "file") / "x"
    assert hooks.stop(blocked, "s", "claude", rows, 2.0) and not hooks.append_event(blocked / "log", {"a": 1})
    log = tmp_path / "events" / "e.jsonl"
    assert hooks.append_event(log, {"a": 1}) and hooks.append_event(log, {"b": "ü"}) and log.read_text(encoding="utf-8") == '{"a":1}\n{"b":"ü"}\n'
    assert hooks.close_log(log, tmp_path / "closed") is None and hooks.close_log(tmp_path / "none", tmp_path / "closed", 0) is None
    assert hooks.close_log(log, tmp_path / "closed", 5).parent == tmp_path / "closed" and not log.exists() and hooks.append_event(log, {"c": 1})


def test_live_view():
    out, waits = [], []
    assert hooks.live(lambda: "v", out.append, 3.0, 3, sleep=waits.append, clock=lambda: "now") == 3
    assert out == ["v\n", "\n--- now ---\nv\n", "\n--- now ---\nv\n"] and waits == [3.0, 3.0]
    with pytest.raises(ValueError):
        hooks.live(lambda: "", out.append, 0)
