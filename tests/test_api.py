"""User-visible queries, rendering, prices, streaming state and publishing."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sparkmeter.functions import formats, text
from sparkmeter.operators import joins, pricing, segments, usage
from sparkmeter.plans import api, render
from sparkmeter.sources import paged, prices
from sparkmeter.streaming import index, publish, state

COLUMNS = "session string, project string, segment long, label string, model string, day string, ts string, input long, output long, cache_read long, cache_5m long, cache_1h long, requests long"


@pytest.fixture(scope="module")
def priced(spark):
    rows = [
        ("a", "P", 1, "/x", "m-1", "2026-01-01", "2026-01-01T00:00:00Z", 1_000_000, 0, 0, 0, 0, 1),
        ("a", "P", 2, "/y", "m-1-fast", "2026-01-01", "2026-01-01T01:00:00Z", 0, 1_000_000, 1_000_000, 0, 0, 1),
        ("b", "P", 1, "/x", "m-12", "2026-01-02", "2026-01-02T00:00:00Z", 5, 5, 0, 0, 0, 1),
        ("c", "Q", 1, "/x", "vendor/m-1", "2026-01-03", "2026-01-03T00:00:00Z", 0, 0, 0, 1_000_000, 1_000_000, 1),
    ]
    table = prices.price_list(spark, json.dumps({"m-1": {"input": 1, "output": 5}, "bad": {"input": True, "output": 1}, "nan": {"input": -1, "output": 1}}), json.dumps({"m-1": {"input": 2, "output": 10}}))
    assert table.count() == 1
    return api.with_cost(spark.createDataFrame(rows, COLUMNS), table).cache()


def test_costs_and_boundaries(priced):
    costs = {(r["session"], r["label"]): r["cost"] for r in priced.collect()}
    # m-12 is not m-1; a dash is a boundary; a provider prefix is stripped
    assert costs == {("a", "/x"): 2_000_000_000, ("a", "/y"): 10_200_000_000, ("b", "/x"): None, ("c", "/x"): 2_500_000_000 + 4_000_000_000}


def test_history_top_and_diff(priced):
    rows = {r["key"]: (n, r["cost"], r["partial"]) for n, r in enumerate(api.history(priced, "command").collect(), 1)}
    assert rows == {"/y": (1, 10_200_000_000, False), "/x": (2, 8_500_000_000, True)}
    shown, cut = api.top_consumers(priced, "session", 2)
    assert [r["key"] for r in shown.orderBy("rank").collect()] == ["a", "c"]
    assert tuple(cut.first()) == (1, 1)
    found = {r["label"]: (r["old_cost"], r["new_cost"], r["delta"]) for r in api.diff(priced, "a", "b").collect()}
    assert found == {"/x": (2_000_000_000, None, None), "/y": (10_200_000_000, 0, -10_200_000_000)}
    with pytest.raises(api.OptionError):
        api.history(priced, "nothing")


def test_windows_and_insights(priced):
    assert {r["session"] for r in api.window(priced, cutoff="2026-01-02").collect()} == {"b", "c"}
    assert {r["session"] for r in api.window(priced, project="Q").collect()} == {"c"}
    assert api.since_cutoff("2026-01-02") == "2026-01-02"
    for bad in ("99999d", "soon"):
        with pytest.raises(api.OptionError):
            api.since_cutoff(bad)
    found = {(r["rule"], r["severity"]) for r in api.window_insights(priced, "2026-01-02").collect()}
    assert found == {("spend-trend", "info"), ("unpriced-models", "warn")}
    assert api.session_insights(priced, "a", budget=15.0).where("rule = 'budget-pace'").count() == 1


def test_export_render_and_dashboard(priced, tmp_path):
    lines = [json.loads(r["value"]) for r in api.export(priced, "project", "claude").collect()]
    assert [r["key"] for r in lines] == ["P", "Q", "total"] and lines[-1]["metrics"]["requests"] == 4
    table = render.to_csv(api.history(priced, "model"), "model").splitlines()
    assert table[0].startswith("model,requests,") and table[1].endswith("10.2000") and table[-1].endswith(",")
    page = render.dashboard_html(api.dashboard(priced.withColumn("label", F.lit("<b>"))))
    assert "&lt;b&gt;" in page and "<b>" not in page.replace("<body>", "")
    assert "$10.20" in render.markdown(api.history(priced, "command"), "t") and "$8.50*" in render.markdown(api.history(priced, "command"), "t")
    render.write_atomic(str(tmp_path / "x"), "y")
    assert [p.name for p in tmp_path.iterdir()] == ["x"]


def test_dedupe_is_order_free(spark):
    rng = random.Random(0)
    rows = [("s", rng.choice(["r1", "r2", None]), k, *[rng.randrange(9) for _ in range(5)], f"m{k}") for k in range(40)]
    schema = "session string, request_id string, ord long, input long, output long, cache_read long, cache_5m long, cache_1h long, model string"
    want = None
    for _ in range(3):
        rng.shuffle(rows)
        got = sorted(map(str, usage.dedupe_requests(spark.createDataFrame(rows, schema), ["session"]).collect()))
        assert want is None or got == want
        want = got
    assert len(want) == sum(r[1] is None for r in rows) + 2


def test_sequences_against_loops(spark):
    rng = random.Random(1)
    rows = [(s, k, rng.randrange(50), rng.randrange(20)) for s in range(20) for k in range(15)]
    df = spark.createDataFrame(rows, "s long, k long, total long, seen long")
    want_delta, want_rest = set(), set()
    for s in range(20):
        last, best = None, 0
        for _, k, total, seen in sorted(r for r in rows if r[0] == s):
            if (last is None or total >= last) and total - (last or 0) > 0:
                want_delta.add((s, k, total - (last or 0)))
            last = total
            want_rest.add((s, k, max(best, total - seen) - best))
            best = max(best, total - seen)
    assert {(r["s"], r["k"], r["d_total"]) for r in segments.deltas(df, ["s"], ["k"], ["total"]).collect()} == want_delta
    assert {(r["s"], r["k"], r["remainder"]) for r in segments.remainders(df, ["s"], ["k"], "total", "seen").collect()} == want_rest


def test_asof_against_loop(spark):
    rng = random.Random(2)
    parts = [(s, g, f"{rng.randrange(20):02}") for s in "ab" for g in range(1, 6)]
    events = [(s, e, f"{rng.randrange(20):02}") for s in "abc" for e in range(30)]
    found = joins.asof(spark.createDataFrame(events, "s string, e long, ts string"), spark.createDataFrame(parts, "s string, g long, start string"), "s", "ts", "e", "start", "g")
    for r in found.collect():
        own = [(start, g) for s, g, start in parts if s == r["s"]]
        before = [p for p in own if p[0] <= r["ts"]]
        assert r["g"] == (max(before)[1] if before else max((g for _, g in own), default=None))


def test_functions(spark):
    row = spark.range(1).select(
        text.command_label(F.lit("  /go:now x")).alias("a"), text.command_tag(F.lit("<command-name> hi </command-name>")).alias("b"), text.slug(F.lit("/a b/ü")).alias("c"),
        text.repo_of_url(F.lit("https://h.x/o/r.git")).alias("d"), text.clip(F.lit("abcdef"), 3, "…").alias("e"), text.source_id(F.lit("s"), F.lit(None).cast("string"), F.lit(2)).alias("f"),
        text.local_day(F.lit("garbage-in-time")).alias("g"), text.file_uri_path(F.lit("file:///a%20b")).alias("h"), text.unquoted(F.lit('"x"')).alias("i"), text.skill_of_path(F.lit("/p/skills/k/SKILL.md")).alias("j"),
    ).first()
    assert tuple(row) == ("/go:now", "hi", "-a-b--", "o/r", "abc…", "s:turn-2", "garbage-in", "/a b", "x", "k")
    assert [formats.tokens(n) for n in (950, 1250, 3_400_000)] == ["950", "1.2k", "3.4M"] and formats.usd(None) == "n/a" and formats.delta(-1.5) == "-$1.50"


def test_paged_reads_stop(spark):
    from datetime import datetime

    pages = {1: ([{"i": 1}], True), 2: ([{"i": 2}], False)}
    start, end = datetime(2026, 1, 1), datetime(2026, 1, 20)
    got = list(paged.fetch(lambda q: {"usageEvents": pages[q["page"]][0], "pagination": {"hasNextPage": pages[q["page"]][1]}}, start, end))
    assert got == [{"i": 1}, {"i": 2}]
    with pytest.raises(paged.PageLimit):
        list(paged.fetch(lambda q: {"usageEvents": [{"i": 1}], "pagination": {"hasNextPage": True}}, start, end))


def test_index_rereads_families(spark):
    sources = spark.createDataFrame([("p1", 1, 1, "f"), ("p2", 1, 1, "f"), ("p3", 1, 1, "g"), ("p4", 1, 1, "h")], "path string, size long, mtime long, family string")
    v = index.VERSION
    known = spark.createDataFrame([("p1", 1, 1, v, "x", "f"), ("p2", 1, 9, v, "x", "f"), ("p3", 1, 1, v, "x", "g"), ("p4", 1, 1, v, "x", "h"), ("old", 1, 1, v, "x", "h")], "path string, size long, mtime long, version int, prices string, family string")
    assert {r["path"] for r in index.changed(sources, known, "x").collect()} == {"p1", "p2", "p4"}
    assert index.changed(sources, known, "y").count() == 4


def test_state_steps():
    held: dict = {}
    assert [state.budget_step(held, c, 10, True) for c in (5, 12, 15, 31, 31)] == [None, 1, None, 3, None]
    turns: dict = {}
    assert [state.turn_step(turns, None, True), state.turn_step(turns, "g1", False), state.turn_step(turns, "g2", False), state.turn_step(turns, "g1", False)] == [1, 1, 2, 1]
    totals: dict = {}
    assert [state.totals_step(totals, 2, (5,)), state.totals_step(totals, 1, (9,)), state.totals_step(totals, 2, (5,))] == [True, False, True] and totals["revision"] == 1
    versions: dict = {}
    assert [state.version_step(versions, v) for v in ((1, 0, 0), (1, 1, 0), (1, 0, 5), (2, 0, 0))] == [True, True, False, True]


def test_budget_alert_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "session string, cost double, final boolean"
    stream = state.budget_alerts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)), 10.0)
    for k, cost in enumerate((4.0, 12.0, 13.0, 25.0)):
        (source / f"{k}.json").write_text(json.dumps({"session": "s", "cost": cost, "final": True}))
        os.utime(source / f"{k}.json", (1_700_000_000 + k,) * 2)  # files are taken in order of their times
    query = stream.writeStream.format("memory").queryName("alerts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert sorted(r["multiple"] for r in spark.table("alerts").collect()) == [1, 2]


def test_publisher_is_idempotent():
    sent, up = [], [True]

    def post(endpoint, payload):
        if not up[0]:
            raise ConnectionError
        sent.append((endpoint, payload["v"]))
        return 409 if payload["v"] == 3 else 201

    p = publish.Publisher(post)
    assert p.send("a", "e", {"v": 1}) and p.send("a", "e", {"v": 1}) and sent == [("e", 1)]
    up[0] = False
    assert not p.send("a", "e", {"v": 2}) and not p.send("a", "e", {"v": 3}) and len(p.outbox) == 1
    up[0] = True
    assert p.flush() == 1 and not p.outbox and sent[-1] == ("e", 3)


def test_median_gathers_no_group(spark):
    import statistics

    from sparkmeter.operators import rollup

    rng = random.Random(6)
    rows = [(g, rng.choice([None, -5, 0, 7, 7, 7, rng.randrange(-(10**12), 10**12)])) for g in ("a", "b", None) for _ in range(rng.randrange(1, 400))] + [("none", None), ("one", 3), ("two", 1), ("two", 2)]
    df = spark.createDataFrame(rows, "g string, v long")
    found = rollup.median(df, ["g"], "v", "m")
    want = {}
    for g in {g for g, _ in rows}:
        own = [v for k, v in rows if k == g and v is not None]
        want[g] = (statistics.median(own) if own else None, len(own))
    assert {r["g"]: (r["m"], r["n"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    assert "collect" not in plan and "percentile" not in plan and "median" not in plan
    ratios = spark.createDataFrame([("x", k / 97) for k in range(50)], "g string, v double")
    assert rollup.median(ratios, ["g"], "v", "m").first()["m"] == statistics.median(k / 97 for k in range(50))
