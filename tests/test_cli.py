"""The command line and the index below it on small logs."""

import json
import os
import time

import pytest

from sparkmeter import cli
from sparkmeter.plans import api
from sparkmeter.sources import prices
from sparkmeter.streaming.index import Index


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def prompt(text, ts):
    return {"type": "user", "timestamp": ts, "message": {"role": "user", "content": text}}


def reply(request, tokens, ts, model="m-1"):
    return {"type": "assistant", "timestamp": ts, "requestId": request, "message": {"role": "assistant", "model": model, "usage": {"input_tokens": tokens, "output_tokens": 0}}}


@pytest.fixture()
def place(tmp_path):
    write(tmp_path / "prices.json", [{"m-1": {"input": 3, "output": 15}}])
    return tmp_path


def command(place, spark, *more):
    return cli.run(["--root", str(place / "logs"), "--index", str(place / "index"), "--prices", str(place / "prices.json"), *more], spark)


def test_only_what_changed_is_read_again(spark, place):
    logs = place / "logs"
    for n in range(3):
        write(logs / f"p{n}" / f"s{n}.jsonl", [prompt("<command-name>/build</command-name>", f"2026-01-0{n + 1}T10:00:00Z"), reply("r", 1_000_000, f"2026-01-0{n + 1}T10:01:00Z")])
    write(logs / "p0" / "s0" / "subagents" / "agent-a.jsonl", [reply("q", 2_000_000, "2026-01-01T10:00:30Z")])
    write(logs / "p0" / "node_modules" / "x.jsonl", ["broken"])
    rates, index = prices.price_list(spark, (place / "prices.json").read_text()), Index(spark, str(place / "index"), "claude")
    cost = lambda: {r["session"]: r["cost"] for r in index.priced().groupBy("session").agg({"cost": "sum"}).toDF("session", "cost").collect()}
    assert index.refresh(str(logs), rates, "v1") == (4, 3, 4) and cost() == {"s0": 9_000_000_000, "s1": 3_000_000_000, "s2": 3_000_000_000}
    assert index.refresh(str(logs), rates, "v1") == (0, 0, 4)
    write(logs / "p0" / "s0" / "subagents" / "agent-a.jsonl", [reply("q", 5_000_000, "2026-01-01T10:00:30Z")])
    os.utime(logs / "p0" / "s0" / "subagents" / "agent-a.jsonl", (time.time() + 5,) * 2)
    assert index.refresh(str(logs), rates, "v1") == (2, 1, 4) and cost() == {"s0": 18_000_000_000, "s1": 3_000_000_000, "s2": 3_000_000_000}
    (logs / "p1" / "s1.jsonl").unlink()
    assert index.refresh(str(logs), rates, "v1") == (0, 1, 3) and set(cost()) == {"s0", "s2"}
    assert index.refresh(str(logs), prices.price_list(spark, json.dumps({"m-1": {"input": 1, "output": 1}})), "v2").read == 3 and cost() == {"s0": 6_000_000_000, "s2": 1_000_000_000}
    index._mark([r["bucket"] for r in index.table("sources").where("family = 'p2/s2'").collect()])  # as a run that broke off
    again = index.refresh(str(logs), prices.price_list(spark, json.dumps({"m-1": {"input": 1, "output": 1}})), "v2")
    assert again.families >= 1 and cost() == {"s0": 6_000_000_000, "s2": 1_000_000_000} and index.refresh(str(logs), rates, "v2").read == 0


def test_commands_over_one_index(spark, place):
    logs = place / "logs"
    write(logs / "p" / "old.jsonl", [prompt("<command-name>/build</command-name>", "2026-01-01T10:00:00Z"), reply("r", 1_000_000, "2026-02-01T10:01:00Z"), prompt("<command-name>/idle</command-name>", "2026-02-01T11:00:00Z")])
    write(logs / "p" / "new.jsonl", [prompt("<command-name>/build</command-name>", "2026-03-01T10:00:00Z"), reply("r", 2_000_000, "2026-03-01T10:01:00Z"), reply("x", 5, "2026-03-01T10:02:00Z", "other")])
    write(logs / "p" / "bad.jsonl", ["[1]"])
    os.utime(logs / "p" / "new.jsonl", (time.time() + 9,) * 2)
    began = time.perf_counter()
    first = command(place, spark, "history", "--by", "command", "--csv").splitlines()
    assert first[1].startswith("/build,2,0,3000005") and first[2].startswith("/idle,1,0,0") and first[2].endswith(",0.0000")
    late = command(place, spark, "--since", "2026-01-15", "history", "--by", "command", "--csv").splitlines()
    assert len(late) == 2 and late[1].startswith("/build,1,")  # a session that began before the cutoff is out as a whole
    notes = command(place, spark, "history")
    assert "1 model(s) have no price" in notes and "other" in notes and "bad.jsonl" in notes
    assert "| /build | 2 |" in command(place, spark, "top", "--by", "command")
    assert command(place, spark, "report").startswith("## new") and "lower bound" not in command(place, spark, "report", "old")
    assert time.perf_counter() - began < 120
    with pytest.raises(api.OptionError, match="nowhere"):
        command(place, spark, "diff", "old", "nowhere")
    assert "/build" in command(place, spark, "diff", "old", "new")
    assert "holds no session" in command(place, spark, "--since", "9999-01-01", "insights") and "earlier session(s)" in command(place, spark, "insights", "new")
    lines = [json.loads(x) for x in command(place, spark, "export", "--scope", "session", "--session", "old").splitlines()]
    assert [x["key"] for x in lines] == ["/build", "total"] and lines[0]["metrics"]["cost_usd"] == 3.0
    assert command(place, spark, "export", "--out", str(place / "out")).strip() == str(place / "out") and list((place / "out").glob("part-*"))
    command(place, spark, "dashboard", str(place / "page.html"))
    assert "class=card" in (place / "page.html").read_text() and "2026-02-01" in (place / "page.html").read_text()
    assert "| p |" in command(place, spark, "tool", "history") and command(place, spark, "live", "new", "--iterations", "1").startswith("## new")


def test_calls_of_other_hosts(spark, place):
    write(place / "logs" / "e.jsonl", [
        {"id": "1", "type": "session.start", "timestamp": "2026-01-05T10:00:00Z", "data": {"sessionId": "c"}}, {"id": "2", "type": "user.message", "timestamp": "2026-01-05T10:00:01Z", "data": {"content": "/plan it"}},
        {"id": "3", "type": "assistant.usage", "timestamp": "2026-01-05T10:00:02Z", "data": {"model": "m-1", "inputTokens": 1_000_000, "outputTokens": 0}},
    ])
    assert command(place, spark, "history", "--by", "command", "--csv").splitlines()[1].startswith("/plan,1,")
    write(place / "cursor" / "logs" / "l.jsonl", [
        {"conversation_id": "k", "generation_id": "g", "ts": "2026-01-05T10:00:00Z", "hook": "beforeSubmitPrompt", "prompt": "/plan it", "label": "/plan"},
        {"conversation_id": "k", "generation_id": "g", "ts": "2026-01-05T10:00:05Z", "hook": "stop", "model": "m-1", "tokens": {"input_tokens": 1_000_000, "output_tokens": 0}},
    ])
    write(place / "cursor" / "prices.json", [{"m-1": {"input": 3, "output": 15}}])
    assert command(place / "cursor", spark, "history", "--by", "command", "--csv").splitlines()[1] == "/plan,1,0,1000000,0,0,0,3.0000"
    cloud = place / "cloud"
    write(cloud / "prices.json", [{}])
    write(cloud / "logs" / "a.jsonl", [{"type": "agent", "id": "bc-agent-0001"}, *[{"type": "usage", "timestamp": 1767607320000 + k, "cloudAgentId": "bc-agent-0001", "conversationId": "v", "model": "m", "tokenUsage": {"inputTokens": 5, "outputTokens": 1}, "chargedCents": 150} for k in range(2)]])
    assert command(cloud, spark, "--runtime", "cursor-cloud", "history", "--csv").splitlines()[1].endswith(",3.0000")


def test_commands(spark, tmp_path):
    rows = [
        {"type": "user", "timestamp": "2026-01-05T10:00:00Z", "message": {"role": "user", "content": "<command-name>/build</command-name>"}},
        {"type": "assistant", "timestamp": "2026-01-05T10:01:00Z", "requestId": "r", "message": {"role": "assistant", "model": "m-1", "usage": {"input_tokens": 1_000_000, "output_tokens": 0}}},
    ]
    (tmp_path / "logs" / "proj").mkdir(parents=True)
    (tmp_path / "logs" / "proj" / "s1.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "prices.json").write_text(json.dumps({"m-1": {"input": 3, "output": 15}}))
    base = ["--root", str(tmp_path / "logs"), "--index", str(tmp_path / "index"), "--prices", str(tmp_path / "prices.json")]
    assert cli.run([*base, "history", "--by", "command", "--csv"], spark).splitlines()[1] == "/build,1,0,1000000,0,0,0,3.0000"
    assert "| /build | 1 |" in cli.run([*base, "report", "s1"], spark)
    assert json.loads(cli.run([*base, "export"], spark).splitlines()[-1])["metrics"]["cost_usd"] == 3.0


def test_subagents_count(spark, tmp_path):
    """A session of one million tokens and its subagent of five million at 3 dollars a million."""

    def answer(request, tokens, ts):
        return {"type": "assistant", "timestamp": ts, "requestId": request, "message": {"role": "assistant", "model": "openrouter/us.anthropic.m-1", "usage": {"input_tokens": tokens, "output_tokens": 0}}}

    project = tmp_path / "logs" / "proj"
    (project / "s1" / "subagents").mkdir(parents=True)
    rows = [{"type": "user", "timestamp": "2026-01-05T10:00:00Z", "message": {"role": "user", "content": "<command-name>/build</command-name>"}}, answer("r", 1_000_000, "2026-01-05T10:01:00Z")]
    (project / "s1.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (project / "s1" / "subagents" / "agent-a.jsonl").write_text(json.dumps(answer("q", 5_000_000, None)))
    (project / "s1" / "subagents" / "agent-a.meta.json").write_text(json.dumps({"agentType": "explore", "started_at": 1767607320}))
    (tmp_path / "prices.json").write_text(json.dumps({"m-1": {"input": 3, "output": 15}}))
    base = ["--root", str(tmp_path / "logs"), "--index", str(tmp_path / "index"), "--prices", str(tmp_path / "prices.json")]
    assert cli.run([*base, "history", "--by", "project", "--csv"], spark).splitlines()[1].endswith(",18.0000")
    assert "agent-fanout: /build (0.83)" in cli.run([*base, "insights", "s1"], spark)
