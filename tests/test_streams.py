"""Keyed state on streams, durable publishing."""

import json
import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sparkmeter.sources import paged
from sparkmeter.streaming import publish, replay, state, sync


def collected(spark, stream, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start()
    query.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()]


def test_turn_numbers_survive_batches_and_replays(spark, tmp_path):
    """Events in three files, one batch each, and the first one again: numbers stay."""
    schema = "session string, agent string, ord long, generation string, opens boolean"
    rows = [[("s", "", 1, None, True), ("s", "", 2, "g1", False), ("t", "", 3, "x", False)], [("s", "", 4, "g2", False), ("s", "", 5, None, True)], [("s", "", 6, "g1", False), ("s", "", 7, "g3", False), ("s", "a", 8, "g1", False)]]
    for i, part in enumerate([*rows, rows[0][1:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / "in" / f"{i}"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    found = collected(spark, state.turn_numbers(events), tmp_path, "turn_numbers")
    by_generation = {}
    for session, agent, generation, turn in found:
        if generation is not None:
            by_generation.setdefault((session, agent, generation), set()).add(turn)
    assert all(len(numbers) == 1 for numbers in by_generation.values()) and set(by_generation) == {("s", "", "g1"), ("s", "", "g2"), ("s", "", "g3"), ("t", "", "x"), ("s", "a", "g1")}
    mine = [by_generation["s", "", g] for g in ("g1", "g2", "g3")]
    assert len(set(map(frozenset, mine))) == 3 and by_generation["s", "a", "g1"] == {1}


def test_totals_never_shrink(spark, tmp_path):
    rows = [("s", "", 1, 3, 10, 1), ("s", "", 2, 2, 99, 9), ("s", "", 3, 3, 10, 1), ("s", "", 4, 5, 20, 2), ("t", "", 1, 0, 0, 0)]
    schema = "session string, agent string, ord long, covered long, input long, output long"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    found = collected(spark, state.transcript_totals(spark.readStream.schema(schema).json(str(tmp_path / "in"))), tmp_path, "totals")
    assert sorted(found) == [("s", "", 3, 10, 1, 1), ("s", "", 3, 10, 1, 1), ("s", "", 5, 20, 2, 2), ("t", "", 0, 0, 0, 1)]
    starts = spark.createDataFrame([("s", 1, "b"), ("s", 2, ""), ("s", 3, "c"), ("s", 4, "a")], "session string, ord long, ts string")
    starts.coalesce(1).write.json(str(tmp_path / "starts"))
    stream = spark.readStream.schema(starts.schema).json(str(tmp_path / "starts"))
    assert collected(spark, state.session_starts(stream), tmp_path, "starts") == [("s", "b"), ("s", "a")]


def test_outbox_survives_a_restart(spark, tmp_path):
    schema = publish._OUTBOX
    sent: list[str] = []
    online = [True, False, False]

    def post(endpoint, body):
        if online and not online.pop(0):
            raise OSError("offline")
        sent.append(f"{endpoint}:{body['n']}")
        return 409 if body["n"] == 3 else 200

    def row(at, source, n, mutable=False, turn=1):
        return (at, source, "end" if mutable else "turn", "s", mutable, turn, 0, 0, json.dumps({"n": n}))

    run = publish.publish_batch(str(tmp_path / "box"), post)
    first = spark.createDataFrame([row("2", "b", 2), row("1", "a", 1), row("3", "c", 3)], schema)
    run(first, 0)
    assert sent == ["turn:1"]
    run = publish.publish_batch(str(tmp_path / "box"), post)  # as after a restart
    run(first, 0)
    assert sent == ["turn:1"]
    run(spark.createDataFrame([row("0", "z", 7, True, 2), row("4", "z", 6, True, 1), row("5", "a", 1)], schema), 1)
    assert sent == ["turn:1", "end:7", "turn:2", "turn:3"]
    run(spark.createDataFrame([row("9", "z", 8, True, 1)], schema), 2)
    assert sent == ["turn:1", "end:7", "turn:2", "turn:3"]
    left = publish.Outbox(spark, str(tmp_path / "box"))
    assert left.line.read().count() == left.line.read().count() and left.delivered().count() == 4


def entry(at, source, session, turn, body, mutable=True, endpoint="turn"):
    return (at, source, endpoint, session, mutable, turn, 0, 0, body)


def test_turns_in_line_are_all_sent(spark, tmp_path):
    """Two turns of a session wait: none holds back the other; key order and white space make no second content."""
    rows = [entry("1", "a", "s", 1, '{"n": 1}'), entry("2", "b", "s", 2, '{"n": 2}'), entry("3", "b", "s", 2, '{ "n":2 }'), entry("4", "c", "s", 3, '{"x": 1, "a": {"q": 2, "b": 1}}'), entry("5", "c", "s", 3, '{"a": {"b": 1, "q": 2}, "x": 1}')]
    outbox, none = spark.createDataFrame(rows, publish._OUTBOX), spark.createDataFrame([], publish._DELIVERED)
    waiting = publish.pending(outbox, none)
    assert sorted(r["source_id"] for r in waiting.collect()) == ["a", "b", "c"]
    done = waiting.where("source_id = 'b'").select(*[F.col(c) for c in ("source_id", "endpoint", "content_hash", "session", "turn", "stage", "revision")], F.lit(0).alias("bucket"))
    assert sorted(r["source_id"] for r in publish.pending(outbox, done).collect()) == ["c"]  # what is older than a delivered one is stale
    fixed = outbox.withColumn("mutable", F.lit(False))
    assert sorted(r["source_id"] for r in publish.pending(fixed, done).collect()) == ["a", "c"]
    newer = outbox.unionByName(spark.createDataFrame([entry("9", "a", "s", 1, '{"n": 9}')], publish._OUTBOX))
    assert [r["body"] for r in publish.pending(newer, none).where("source_id = 'a'").collect()] == ['{"n": 9}']
    sent = []
    publish.publish_batch(str(tmp_path), lambda endpoint, body: sent.append(body) or 200)(outbox, 0)
    assert sent == [{"n": 1}, {"n": 2}, {"a": {"b": 1, "q": 2}, "x": 1}]


def test_a_batch_does_not_read_what_was_sent_long_ago(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(publish, "DELTAS", 3)
    sent = []
    run = publish.publish_batch(str(tmp_path), lambda endpoint, body: sent.append(body["n"]) or 200)
    for n in range(7):
        run(spark.createDataFrame([entry(str(n), f"t{n}", "s", n, json.dumps({"n": n}))], publish._OUTBOX), n)
    assert sent == list(range(7))
    box = publish.Outbox(spark, str(tmp_path))
    assert box.line.numbers() == [5, 6] and box.line.read().count() == 1  # the line holds its own batch only
    folder = next((tmp_path / "delivered").glob("bucket=*"))
    assert len(list(folder.glob("part-*"))) < 3 and box.delivered().count() == 7
    run(spark.createDataFrame([entry("7", "t0", "s", 0, '{"n":0}')], publish._OUTBOX), 7)
    assert len(sent) == 7


# --- hook log ----------------------------------------------------------------------------------------


def hook_lines(rng, n):
    out = []
    for k in range(n):
        hook = rng.choice(["beforeSubmitPrompt", "stop", "afterAgentResponse", "subagentStop"])
        line = {"conversation_id": f"s{rng.randrange(3)}", "generation_id": f"g{rng.randrange(8)}", "hook": hook, "ts": f"t{k:03}"}
        if rng.random() < 0.5:
            line["model"] = rng.choice(["m1", "m2"])
        if hook == "beforeSubmitPrompt":
            line["label"] = f"/l{k}"
        if hook == "subagentStop" and rng.random() < 0.8:
            line["subagent_id"] = rng.choice("ab")
        if hook in replay.ENDS and rng.random() < 0.6:
            line["tokens"] = {"input_tokens": k, "output_tokens": 1}
        out.append(json.dumps(line))
    return out


def test_replay_of_a_stream_is_the_replay_of_the_table(spark, tmp_path):
    """Three files, one a batch, with a restart after the second; a broken line, bad bytes and a line cut off stop nothing."""
    lines = hook_lines(random.Random(4), 90)
    source, whole = tmp_path / "in", []
    source.mkdir()
    last: dict = {}

    def take(batch, _):
        last.update({(r["session"], r["generation"]): tuple(r) for r in batch.collect()})

    def go():
        stream = replay.replay_stream(replay.hook_stream(spark, str(source), 1))
        query = stream.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(180)

    for k in range(3):
        own = lines[30 * k : 30 * k + 30]
        (source / f"{k}.jsonl").write_bytes("\n".join([*own, "no json", '"text"', "[1]"]).encode() + b'\n{"a": "\xff\xfe"}\n{"conversation_id": "s0", "generation_id": "cut')
        os.utime(source / f"{k}.jsonl", (1_700_000_000 + k,) * 2)
        whole += own
        if k:
            go()
    table = spark.createDataFrame([(t, n) for n, t in enumerate(whole)], "value string, n long")
    want = {(r["session"], r["generation"]): tuple(r) for r in replay.replayed(replay.parsed(table, F.col("n"))).collect()}
    assert last == want and len(want) > 15
    held = replay.state_of(spark, str(tmp_path / "check"), "generations")
    assert {(r["s"], r["g"]): r["n"] for r in held.select(F.col("key.session").alias("s"), F.col("user_map_key.generation").alias("g"), F.col("user_map_value.ends").alias("n")).collect()} == {k: v[12] for k, v in want.items()}
    spoilt = replay.parsed(spark.read.text(str(source)), F.monotonically_increasing_id())
    assert spoilt.where("quarantined").count() == 15


def test_replay_goes_on_from_a_table(spark, tmp_path):
    lines = hook_lines(random.Random(5), 60)
    table = spark.createDataFrame([(t, n) for n, t in enumerate(lines)], "value string, n long")
    events = replay.parsed(table, F.col("n"))
    early = events.where("ord < 30")
    names = early.where(F.col("hook") == replay.AGENT_END).groupBy("session", "generation").agg(F.collect_set(F.coalesce("agent", F.lit(replay.UNKNOWN))).alias("agent_names"))
    initial = replay.replayed(early).join(names, ["session", "generation"], "left")
    events.where("ord >= 30").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = replay.replay_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), initial)
    last = {(r[0], r[1]): r for r in collected(spark, stream, tmp_path, "replay_on", "update")}
    want = {(r["session"], r["generation"]): tuple(r) for r in replay.replayed(events).collect()}
    assert last and all(want[k] == r for k, r in last.items())


def test_totals_are_read_as_of_one_batch(spark, tmp_path):
    schema = "session string, agent string, ord long, covered long, input long, output long"
    parts = [[("s", "", 1, 3, 10, 1), ("t", "", 1, 0, 5, 5)], [("s", "", 2, 2, 99, 9), ("s", "", 3, 5, 20, 2)], [("t", "", 2, 1, 7, 7)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / "in" / f"{k}"))
        for file in (tmp_path / "in" / f"{k}").glob("part-*"):
            os.utime(file, (1_700_000_000 + k,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    collected(spark, replay.totals_stream(stream), tmp_path, "totals_state", "update")
    at = lambda batch=None: sorted(tuple(r) for r in replay.totals_at(spark, str(tmp_path / "totals_state-check"), batch).collect())
    assert at(0) == [("s", "", 3, 10, 1, 1), ("t", "", 0, 5, 5, 1)]
    assert at(1) == [("s", "", 5, 20, 2, 2), ("t", "", 0, 5, 5, 1)] and at() == [("s", "", 5, 20, 2, 2), ("t", "", 1, 7, 7, 2)]


# --- paged source and ledger -------------------------------------------------------------------------


DAY = 86_400_000


def test_paged_stream_goes_on_where_it_stopped(spark, tmp_path):
    log, folder = tmp_path / "pages", str(tmp_path / "ledger")

    def pages(query, log=str(log)):
        """2,500 events, one every two hours; each page is noted in a file, for the reader has a process of its own."""
        with open(log, "a", encoding="utf-8") as file:
            file.write(f"{query['startDate']}:{query['page']}\n")
        own = [t for t in range(0, 2500 * 7_200_000, 7_200_000) if query["startDate"] <= t < query["endDate"]]
        at = 100 * (query["page"] - 1)
        return {"usageEvents": [{"timestamp": t, "n": t // 7_200_000} for t in own[at : at + 100]], "pagination": {"hasNextPage": at + 100 < len(own)}}

    spark.dataSource.register(paged.paged_source(pages))
    end = 2500 * 7_200_000

    def go(until):
        stream = spark.readStream.format("paged_events").option("start_ms", 0).option("end_ms", until).option("pages", 3).load()
        query = stream.writeStream.foreachBatch(sync.sync_batch(folder)).option("checkpointLocation", str(tmp_path / "check")).start()
        query.processAllAvailable()
        query.stop()

    go(90 * DAY)
    first = log.read_text().splitlines()
    ledger = sync.Ledger(spark, folder)
    assert ledger.mark() == sync.Mark(90 * DAY) and ledger.events().count() == 90 * 12 and len(set(first)) == len(first)
    go(end)
    asked = log.read_text().splitlines()
    assert len(set(asked)) == len(asked)  # after the restart no page was read twice
    assert ledger.events().select("ms").distinct().count() == ledger.events().count() == 2500 and ledger.mark() == sync.Mark(end)


def test_paged_limits(monkeypatch):
    at = datetime(2026, 1, 1, tzinfo=timezone.utc)
    with pytest.raises(paged.PageLimit, match="twice"):
        list(paged.fetch(lambda q: {"usageEvents": [{"a": 1}], "pagination": {"hasNextPage": True}}, at, at.replace(month=2)))
    reader = paged.PageReader(lambda q: {"usageEvents": [{"n": q["page"]}], "pagination": {"hasNextPage": True}}, 0, DAY, 1000)
    with pytest.raises(paged.PageLimit, match="pages"):
        reader.read(reader.initialOffset())
    monkeypatch.setattr(paged, "MAX_BYTES", 10)
    with pytest.raises(paged.PageLimit, match="bytes"):
        reader.read(reader.initialOffset())
    ticks = iter([0.0, 0.0, 700.0])
    late = paged.PageReader(lambda q: {"usageEvents": [], "pagination": {"hasNextPage": True}}, 0, DAY, 1000, lambda: next(ticks))
    with pytest.raises(paged.PageLimit):
        late.read(late.initialOffset())


def test_ledger_against_a_loop(spark, tmp_path):
    """Late, empty and gapped answers in a random order of windows."""
    rng = random.Random(8)
    ledger, held, high = sync.Ledger(spark, str(tmp_path)), {}, None
    assert sync.next_start(None, 7) == 7 and sync.next_start(sync.Mark(sync.OVERLAP_MS + 5), 0) == 5
    for step in range(7):
        start = sync.next_start(ledger.mark(), 0) + (rng.choice([0, 0, 3 * DAY]) if step else 0)
        end = start + rng.randrange(1, 5) * DAY // 2
        answer = [] if rng.random() < 0.25 else [(rng.randrange(start, end), f"{step}-{k}") for k in range(rng.randrange(1, 9))]
        ledger.merge(spark.createDataFrame([*answer, *([(end + 1, "outside")] if answer else [])], "ms long, event string"), start, end)
        if answer:
            held = {k: m for k, m in held.items() if not start <= m < end} | {e: m for m, e in answer}
        high = end if high is None else max(high, end) if start <= high else high
        assert {r["event"]: r["ms"] for r in ledger.events().collect()} == held and ledger.mark() == sync.Mark(high)
