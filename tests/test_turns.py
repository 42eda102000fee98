"""Turns by running values against one record after the other."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkmeter.operators import scan, turns

SCHEMA = "session string, ord long, kind string, ident string, name string, model string, ts string, text string, request string, input long, output long, cache_read long, cache_write long"
NONE = (0, 0, 0, 0)


def by_record(rows):
    """Turns of one session: {number: [prompt, answers, {request: counters}, ident]}."""
    out, now, ident, next_ident, ahead, last = {}, 0, "", "", False, NONE
    spoke = any(r[2] == "answer" for r in rows[: next((i for i, r in enumerate(rows) if r[2] == "prompt"), len(rows))])
    said = False

    def turn(n):
        return out.setdefault(n, [None, [], {}])

    for _, at, kind, name, _, _, _, text, request, *counters in rows:
        if kind == "prompt":
            now, ident, ahead = now + 1, next_ident, False
            turn(now)[0] = text
        elif kind == "answer":
            said = True
            turn(now)[1].append(text)
        elif kind == "context":
            if (now or said) and (not name or name != ident):
                ahead = True
            next_ident = name or next_ident
        else:
            used = tuple(counters)
            if kind == "total":
                before, last = last, used
                if any(a < b for a, b in zip(used, before, strict=True)):
                    continue
                used = tuple(a - b for a, b in zip(used, before, strict=True))
            number = 1 if not now and not spoke else now + ahead
            held = turn(number)[2]
            key = request or f"#{at}"
            held[key] = tuple(map(max, held.get(key, NONE), used))
    found = {}
    for n, (prompt, answers, used) in out.items():
        sums = tuple(sum(u[i] for u in used.values()) for i in range(4))
        if prompt is not None or answers or any(sums):
            found[n] = (prompt, "\n".join(answers), sums)
    return found


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_turns_equal_one_pass(spark, chunk):
    rng = random.Random(chunk)
    rows, want = [], {}
    for s in range(8):
        own, total = [], [0] * 4
        for n in range(60):
            kind = rng.choice(["prompt", "answer", "answer", "context", "usage", "usage", "total"])
            counters = NONE
            if kind == "usage":
                counters = tuple(rng.randrange(9) for _ in range(4))
            if kind == "total":
                total = [0] * 4 if rng.random() < 0.2 else [t + rng.randrange(5) for t in total]
                counters = tuple(total)
            ident = rng.choice(["", "a", "b"]) if kind == "context" else ""
            own.append((f"s{s}", n, kind, ident, None, "", f"t{n:02}", f"{kind} {n}", rng.choice(["", "", f"r{n // 9}"]) if kind == "usage" else "", *counters))
        rows += own
        want |= {(f"s{s}", n): t for n, t in by_record(own).items()}
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, SCHEMA).withColumn("chunk", F.floor(F.col("ord") / chunk).cast("long"))
    found = {(r["session"], r["turn"]): (r["prompt"], r["assistant"], (r["input"], r["output"], r["cache_read"], r["cache_write"])) for r in turns.fold(events, ["session"]).collect()}
    assert found == want


def test_calls_idents_and_models(spark):
    rows = [
        ("s", 1, "context", "t1", None, "m1", "a", "", "", *NONE), ("s", 2, "prompt", "", None, "", "b", "do", "", *NONE), ("s", 3, "call", "c1", "read", "", "c", "", "", *NONE),
        ("s", 4, "result", "c1", "read", "", "d", "done", "", *NONE), ("s", 5, "call", "", "sh", "", "e", "", "", *NONE), ("s", 6, "context", "t1", None, "", "f", "", "", *NONE),
        ("s", 7, "usage", "", None, "", "g", "", "", 3, 1, 0, 0), ("s", 8, "context", "t2", None, "m2", "h", "", "", *NONE), ("s", 9, "usage", "", None, "", "i", "", "", 50, 1, 0, 0),
    ]
    found = turns.fold(spark.createDataFrame(rows, SCHEMA).withColumn("chunk", F.col("ord")), ["session"]).orderBy("turn").collect()
    assert [(r["turn"], r["prompt"], r["model"], r["ident"], r["input"], r["tools"], r["answered"]) for r in found] == [(1, "do", "m1", "t1", 3, 2, 1), (2, None, "", "", 50, 0, 0)]
    assert turns.fold(spark.createDataFrame([], SCHEMA).withColumn("chunk", F.col("ord")), ["session"]).count() == 0


def test_prefix_takes_null_scopes_and_spreads_a_sequence(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 2 == 0, F.lit("x")).alias("s"), "id", F.floor(F.col("id") / 50).alias("chunk"))
    found = scan.prefix(rows, ["s"], ["id"], "chunk", {"n": F.lit(1)}, {"before": F.when(F.col("id") % 10 < 2, F.col("id"))})
    for r in found.collect():
        assert r["n"] == r["id"] // 2 + 1
        want = [i for i in range(r["id"]) if i % 2 == r["id"] % 2 and i % 10 < 2]
        assert r["before"] == (want[-1] if want else None)


def test_sync_sends_each_turn_once(spark, tmp_path):
    from sparkmeter.plans import sync

    logs, box, sent = tmp_path / "logs" / "p", str(tmp_path / "box"), []
    logs.mkdir(parents=True)

    def say(role, content, **more):
        return {"type": role, "timestamp": f"2026-01-05T10:00:{len(rows):02}Z", "message": {"role": role, "content": content, **more}}

    rows: list = []
    rows.append(say("user", "do it"))
    rows.append(say("assistant", [{"type": "text", "text": "one"}, {"type": "tool_use", "id": "c1", "name": "read"}], model="m", usage={"input_tokens": 5, "output_tokens": 1, "cache_read_input_tokens": 2}) | {"requestId": "r"})
    rows.append(say("assistant", [{"type": "text", "text": "two"}], usage={"input_tokens": 9, "output_tokens": 1}) | {"requestId": "r"})
    rows.append(say("user", [{"type": "tool_result", "tool_use_id": "c1", "content": "done"}]))
    item = lambda role, said: {"type": "response_item", "payload": {"type": "message", "role": role, "content": said}}
    usage = lambda n, **more: {"type": "token_usage_record", "payload": {"usage": {"input_tokens": n, "output_tokens": 1, "cached_input_tokens": 4}, **more}}
    context = lambda ident, model: {"type": "turn_context", "payload": {"turn_id": ident, "model": model}}
    other = [
        {"type": "session_meta", "payload": {"id": "me"}}, context("1", "m1"), usage(10), item("user", "first"), item("assistant", "a"), usage(20, response_id="x"), usage(24, response_id="x"), usage(99, thread_id="them"),
        context("2", "m2"), usage(30, thread_id="me"), item("user", "second"), {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 500, "output_tokens": 1}}}},
    ]
    put = lambda: ((logs / "s.jsonl").write_text("\n".join(map(json.dumps, rows)) + '\n{"cut'), (logs / "t.jsonl").write_text("\n".join(map(json.dumps, other))))
    put()
    assert sync.sync(spark, str(tmp_path / "logs"), box, lambda endpoint, body: sent.append(body) or 200) == 0
    found = {(b["session"], b["turn"]): (b["prompt"], b["assistant"], b["usage"]["input"], b["usage"]["cache_read"], b["tools"]["answered"]) for b in sent}
    assert found == {("s", 1): ("do it", "one\ntwo", 9, 2, 1), ("me", 1): ("first", "a", 6 + 20, 8, 0), ("me", 2): ("second", "", 26, 4, 0)}
    assert sync.sync(spark, str(tmp_path / "logs"), box, lambda endpoint, body: sent.append(body) or 200) == 0 and len(sent) == 3
    rows.append(say("user", "and on"))
    put()
    assert sync.sync(spark, str(tmp_path / "logs"), box, lambda endpoint, body: 500) == 1
    assert sync.sync(spark, str(tmp_path / "logs"), box, lambda endpoint, body: sent.append(body) or 409) == 0 and sent[-1]["prompt"] == "and on" and len(sent) == 4
