"""Adapters on small transcripts with expected integers."""

import json
import sqlite3

import pytest

from sparkmeter.adapters import claude, codex, copilot, cursor, families, gemini
from sparkmeter.operators.usage import COUNTERS


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def user(text, ts="2026-01-05T10:00:00Z", **more):
    return {"type": "user", "timestamp": ts, "message": {"role": "user", "content": text}, **more}


def answer(request, inp, out, read=0, model="m-1", ts="2026-01-05T10:01:00Z", content=None, **usage):
    return {"type": "assistant", "timestamp": ts, "requestId": request, "message": {"role": "assistant", "model": model, "content": content or [], "usage": {"input_tokens": inp, "output_tokens": out, "cache_read_input_tokens": read, **usage}}}


def skill(name, use):
    return [{"type": "tool_use", "id": use, "name": "Skill", "input": {"skill": name}}]


def totals(df):
    from pyspark.sql import functions as F

    return tuple(df.agg(*[F.sum(c) for c in [*COUNTERS, "requests"]]).first())


@pytest.fixture()
def transcripts(tmp_path):
    put(tmp_path / "proj" / "s1.jsonl", [
        user("<command-name>/build</command-name> go"),
        answer("r1", 10, 1), answer("r1", 10, 7), answer("r1", 12, 5),
        user("more please"),
        answer("r2", 5, 5, content=skill("review", "u1"), cache_creation={"ephemeral_5m_input_tokens": 3, "ephemeral_1h_input_tokens": 4}),
        answer("r2", 5, 6, content=skill("review", "u1"), cache_creation={"ephemeral_5m_input_tokens": 3, "ephemeral_1h_input_tokens": 4}),
        answer(None, 1, 1, cache_creation_input_tokens=9), answer(None, 1, 1),
        "not json", user("hidden", isMeta=True),
    ])
    put(tmp_path / "proj" / "s2.jsonl", [user("hello"), answer("q", 2, 3, ts="2026-01-06T00:10:00Z")])
    put(tmp_path / "proj" / "bad.jsonl", ["[1, 2]", json.dumps(answer("x", 100, 100))])
    put(tmp_path / "proj" / "s1" / "subagents" / "agent-a.jsonl", [answer("r1", 50, 60, ts="2026-01-05T10:00:30Z")])
    return tmp_path


def test_claude_dedupe_and_segments(spark, transcripts):
    found = claude.sessions(spark, str(transcripts))
    requests = found["requests"]
    assert totals(requests.where("session = 's1'")) == (12 + 5 + 1 + 1, 7 + 6 + 1 + 1, 0, 3 + 9, 4, 4)
    labels = {(r["session"], r["seg_id"]): r["label"] for r in found["segments"].collect()}
    assert labels == {("s1", 1): "/build", ("s1", 2): "/review", ("s2", 1): "(no command)"}
    by_label = {r["label"]: r["n"] for r in requests.where("session = 's1'").groupBy("label").agg({"requests": "sum"}).toDF("label", "n").collect()}
    assert by_label == {"/build": 1, "/review": 3}
    status = {r["path"].rsplit("/", 1)[-1]: r["quarantined"] for r in found["files"].collect()}
    assert status == {"s1.jsonl": False, "s2.jsonl": False, "bad.jsonl": True}


def test_claude_subagent_is_placed_by_start(spark, transcripts):
    rows = claude.all_requests(spark, str(transcripts)).where("session = 's1'").collect()
    child = [r for r in rows if r["output"] == 60]
    assert len(rows) == 5 and child[0]["label"] == "/build" and child[0]["segment"] == 1


def test_codex_cumulative_and_records(spark, tmp_path):
    def rollout(name, extra):
        put(tmp_path / "sessions" / f"{name}.jsonl", [
            {"type": "session_meta", "timestamp": "2026-01-05T10:00:00Z", "payload": {"id": name}},
            {"type": "turn_context", "timestamp": "2026-01-05T10:00:01Z", "payload": {"model": "g-5", "turn_id": "t1"}},
            {"type": "response_item", "timestamp": "2026-01-05T10:00:02Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "/plan it"}]}},
            *extra,
        ])

    def total(i, c, o):
        return {"type": "event_msg", "timestamp": "2026-01-05T10:00:03Z", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}}}}

    rollout("a", [total(50, 20, 5), total(100, 40, 20), total(100, 40, 20)])
    rollout("b", [{"type": "token_usage_record", "timestamp": "2026-01-05T10:00:04Z", "payload": {"response_id": "x", "usage": {"input_tokens": 100, "cached_input_tokens": 40, "output_tokens": 20}}}, total(900, 0, 900)])
    rollout("c", [total(100, 0, 20), total(10, 0, 2), total(30, 0, 4)])
    found = codex.sessions(spark, str(tmp_path))["requests"]
    assert totals(found.where("session = 'a'"))[:3] == (60, 20, 40)
    assert totals(found.where("session = 'b'")) == (60, 20, 40, 0, 0, 1)
    assert totals(found.where("session = 'c'"))[:2] == (120, 22)
    assert {r["label"] for r in found.collect()} == {"/plan"} and {r["model"] for r in found.collect()} == {"g-5"}


def test_gemini_both_layouts(spark, tmp_path):
    tokens = {"input": 100, "output": 20, "cached": 40, "thoughts": 7, "tool": 3}
    rows = [{"id": "1", "type": "user", "timestamp": "t1", "content": "$go now"}, {"id": "2", "type": "gemini", "timestamp": "t2", "model": "g", "tokens": tokens}, {"id": "2", "type": "gemini", "timestamp": "t2", "model": "g", "tokens": tokens}]
    put(tmp_path / "p" / "chats" / "a.jsonl", [{"sessionId": "A", "projectHash": "h"}, *rows])
    put(tmp_path / "p" / "chats" / "b.json", [{"sessionId": "B", "projectHash": "h", "messages": [*rows, {"id": "3", "type": "gemini", "tokens": {"input": 1, "output": 1, "cached": 5}}]}])
    found = gemini.sessions(spark, str(tmp_path))
    for session in "AB":
        assert totals(found["requests"].where(f"session = '{session}'")) == (63, 27, 40, 0, 0, 1)
    assert [r["session"] for r in found["partial"].collect()] == ["B"]
    assert {r["label"] for r in found["requests"].collect()} == {"$go"}


def test_copilot_shutdown_remainder(spark, tmp_path):
    def call(i, inp, out, **more):
        return {"id": f"c{i}", "type": "assistant.usage", "timestamp": f"2026-01-05T10:0{i}:00Z", "data": {"model": "m", "inputTokens": inp, "outputTokens": out, **more}}

    def stop(i, inp, out, n):
        return {"id": f"s{i}", "type": "session.shutdown", "timestamp": f"2026-01-05T10:0{i}:30Z", "data": {"modelMetrics": {"m": {"usage": {"inputTokens": inp, "outputTokens": out}, "requests": {"count": n}}}}}

    put(tmp_path / "state" / "x" / "events.jsonl", [
        {"id": "0", "type": "session.start", "timestamp": "2026-01-05T09:00:00Z", "data": {"sessionId": "x"}},
        {"id": "u", "type": "user.message", "timestamp": "2026-01-05T09:01:00Z", "data": {"content": "/fix it"}},
        call(1, 10, 1, cacheReadTokens=4), call(1, 99, 99), stop(2, 30, 5, 3), call(3, 5, 5), stop(4, 36, 12, 5),
    ])
    found = copilot.sessions(spark, [str(tmp_path / "state")])["requests"]
    # captured 6 + 5 input and 1 + 5 output; snapshots hold 24, then 25 input and 4, then 6 output beyond the captured
    assert totals(found) == (11 + 25, 6 + 6, 4, 0, 0, 2 + 3)


def test_cursor_ledger_and_store(spark, tmp_path):
    def hook(kind, gen, **more):
        return {"hook": kind, "generation_id": gen, "conversation_id": "c1", "ts": "2026-01-05T10:00:00Z", **more}

    put(tmp_path / "ledger" / "c1.jsonl", [hook("beforeSubmitPrompt", "g1", prompt="do it"), hook("stop", "g1", model="k", tokens={"input_tokens": 50, "output_tokens": 5, "cache_read_tokens": 20}), hook("stop", "g1", tokens={"input_tokens": 9, "output_tokens": 9}), hook("stop", "g2")])
    ledger = cursor.ledger_requests(spark, str(tmp_path / "ledger"))
    assert totals(ledger) == (30, 5, 20, 0, 0, 2)
    path = tmp_path / "store.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE cursorDiskKV (key TEXT PRIMARY KEY, value BLOB)")
        for name in ("c1", "c2"):
            db.execute("INSERT INTO cursorDiskKV VALUES (?, ?)", (f"composerData:{name}", json.dumps({"composerId": name, "name": "T", "modelConfig": {"modelName": "k"}, "fullConversationHeadersOnly": [{"bubbleId": "1", "type": 1}, {"bubbleId": "2", "type": 2}, {"bubbleId": "9", "type": 2}]}).encode()))
            db.execute("INSERT INTO cursorDiskKV VALUES (?, ?)", (f"bubbleId:{name}:1", json.dumps({"type": 1, "text": "hi"}).encode()))
            db.execute("INSERT INTO cursorDiskKV VALUES (?, ?)", (f"bubbleId:{name}:2", json.dumps({"type": 2, "text": "yo", "tokenCount": {"inputTokens": 7, "outputTokens": 8}}).encode()))
    store = cursor.desktop(spark, str(path))
    assert totals(store["requests"]) == (14, 16, 0, 0, 0, 2) and store["missing"].count() == 2
    both = cursor.prefer_ledger(ledger, store["requests"])
    assert totals(both) == (37, 13, 20, 0, 0, 3)
    assert {r["label"] for r in both.collect()} == {"do it", "(no activity)", "T"}


def test_step_logs(spark, tmp_path):
    def step(n, kind, content="", **more):
        return {"step_index": n, "type": kind, "source": "x", "created_at": f"2026-02-03T10:0{n}:00Z", "content": content, **more}

    used = {"input_tokens": 10, "output_tokens": 2, "cache_read_tokens": 3}
    put(tmp_path / "brain" / "s9" / "steps.jsonl", [
        step(1, "USER_INPUT", "x <USER_REQUEST> /plan it </USER_REQUEST> <USER_SETTINGS_CHANGE> The user changed setting `Model Selection` from A to Big Model. ok"),
        step(2, "PLANNER_RESPONSE", **used), step(2, "PLANNER_RESPONSE", **(used | {"output_tokens": 7})),
        step(3, "USER_INPUT", "<CONTEXT_SUMMARY> old"), step(4, "PLANNER_RESPONSE", tool_calls=[{"args": {"p": json.dumps("/a/skills/deploy/SKILL.md")}}], **used),
        step(5, "PLANNER_RESPONSE", input_tokens=True, output_tokens=1), step(6, "GENERIC"),
    ])
    found = gemini.step_sessions(spark, str(tmp_path))
    rows = {r["label"]: (r["model"], r["input"], r["output"], r["cache_read"]) for r in found["requests"].collect()}
    assert rows == {"/plan": ("Big Model", 10, 7, 3), "$deploy": ("Big Model", 10, 2, 3)}
    assert [r["session"] for r in found["partial"].collect()] == ["s9"]
    assert {r["seg_id"]: r["prompt"] for r in found["segments"].collect()}[1] == "/plan it"


def test_codex_children_count_for_their_root(spark, tmp_path):
    def rollout(name, parent, starts):
        meta = {"id": name, "source": {"subagent": {"thread_spawn": {"parent_thread_id": parent}}}} if parent else {"id": name}
        lines = [{"type": "session_meta", "timestamp": starts, "payload": meta}, {"type": "event_msg", "timestamp": starts, "payload": {"type": "task_started", "turn_id": "t"}}]
        lines.append({"type": "token_usage_record", "timestamp": starts, "payload": {"response_id": name, "usage": {"input_tokens": 10, "output_tokens": 1}}})
        put(tmp_path / "sessions" / f"rollout-{name}.jsonl", lines)

    for name, parent, starts in (("a", None, "2026-01-01T10:00:00Z"), ("b", "a", "2026-01-01T11:00:00Z"), ("c", "b", "2026-01-01T12:00:00Z"), ("d", "gone", "2026-01-01T13:00:00Z"), ("e", "f", "x"), ("f", "e", "x")):
        rollout(name, parent, starts)
    rows = {(r["session"], r["agent"]): r["segment"] for r in families.joined(codex.sessions(spark, str(tmp_path))).collect()}
    assert rows == {("a", None): 1, ("a", "b"): 1, ("a", "c"): 1, ("d", None): 1, ("e", None): 1, ("f", None): 1}


def test_copilot_agent_without_a_segment_works_in_the_main_one(spark, tmp_path):
    def event(n, kind, agent=None, **data):
        return {"id": f"e{n}", "type": kind, "timestamp": f"2026-01-01T10:00:{n:02d}Z", **({"agentId": agent} if agent else {}), "data": data}

    use = {"model": "m", "inputTokens": 5, "outputTokens": 1}
    put(tmp_path / "events.jsonl", [
        event(0, "session.start", sessionId="s"), event(1, "user.message", content="/plan x"), event(2, "assistant.usage", "a", **use), event(3, "skill.invoked", "a", name="deep"),
        event(4, "assistant.usage", "a", **use), event(5, "user.message", content="/next"), event(6, "assistant.usage", "b", **use), event(7, "assistant.usage", "b", **(use | {"inputTokens": -1})),
    ])
    found = copilot.sessions(spark, [str(tmp_path)])
    assert sorted((r["ts"][-3:-1], r["label"]) for r in found["requests"].collect()) == [("02", "/plan"), ("04", "deep"), ("06", "/next")]
    assert [r["session"] for r in found["partial"].collect()] == ["s"]


def test_cloud_export(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"id": "c", "title": "Fix it", "model": "m", "messages": [
        {"role": "assistant", "text": "hi"}, {"role": "user", "text": " do\n"}, {"role": "assistant", "content": [{"type": "text", "text": "ok"}], "model": "n", "usage": {"inputTokens": 4, "output_tokens": 2}}, {"role": "tool"},
    ]}))
    found = cursor.cloud_export(spark, str(tmp_path))
    assert sorted((r["segment"], r["label"], r["model"], r["input"], r["output"], r["requests"]) for r in found["requests"].collect()) == [(1, "Fix it", "m", 0, 0, 1), (2, "do", "n", 4, 2, 1)]
