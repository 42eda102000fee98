"""What queries cost: records are read once, and no step grows faster than its input."""

import contextlib
import io
import json

from pyspark.sql import functions as F

from sparkmeter.functions import bridge, normalize
from sparkmeter.operators import joins


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


ODD = [None, True, -5, "12", 1.5, 0, 7, 2**40, [], {}]


def test_fields_bound_once_give_what_expressions_give(spark):
    names = sorted({n for f in (normalize.codex, normalize.gemini, normalize.cursor_bubble, normalize.cursor_hook, bridge.usage) for n in f.names if "." not in n})
    rows = [json.dumps({n: ODD[(i * 7 + k * (i % 9 + 1)) % len(ODD)] for k, n in enumerate(names) if (i + k) % 3}) for i in range(60)]
    rows += [json.dumps({"cache_creation": {"ephemeral_5m_input_tokens": 4}, "tokens": {"input": 9}}), '{"cache_creation": 3, "tokens": []}', "[]", "7", "null", "{", None]
    frame = spark.createDataFrame([(i, j) for i, j in enumerate(rows)], "i long, j string").withColumn("v", F.try_parse_json("j"))
    for f in (normalize.codex, normalize.gemini, normalize.antigravity, normalize.cursor_bubble, normalize.cursor_hook, normalize.hook_trusted, bridge.usage, bridge.payload_tokens):
        bound = f.on(frame, "v", "u")
        assert bound.select("i", "u").collect() == frame.select("i", f(F.col("v")).alias("u")).collect()
        assert plan(bound.select("i", "u.*") if f in (bridge.usage, bridge.payload_tokens) else bound).count("schema_of_variant(") <= 2 * len(f.names)
    again = normalize.with_cloud_api(frame, "v", "u").select("i", "u").collect()
    assert again == frame.select("i", normalize.cloud_api(F.col("v")).alias("u")).collect()


def test_closure_ends_in_few_rounds_beside_cycles(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(joins, "durable", lambda rows, durable=joins.durable: rounds.append(1) or durable(rows))
    parent = {n: n // 3 for n in range(1, 4000)} | {5000 + i: 5000 + (i + 1) % 7 for i in range(7)} | {6000 + i: 5999 + i for i in range(40)} | {6000: 5003, 7000: 7001, 7001: 7000, 100: 7000, 8000: 6020}
    want = {}
    for node in parent:
        at, met = node, set()
        while at in parent and at not in met:
            met.add(at)
            at = parent[at]
        want[node] = None if at in met else at
    found = joins.closure(spark.createDataFrame(list(parent.items()), "child long, parent long"), "child", "parent").collect()
    assert {r["node"]: r["root"] for r in found} == want and len(found) == len(parent) and None in want.values() and 0 in want.values()
    assert len(rounds) <= 9, len(rounds)  # one for each bit of the number of edges would be more


def test_near_copies_are_found_by_fingerprints_without_bands(spark, monkeypatch):
    """The stage of the pipeline finds near copies by SimHash and BK-trees, also where no band of minimum hashes is shared."""
    import random

    from sparkmeter.llm import simhash

    rng = random.Random(3)
    keys = iter(range(1, 1 << 30))
    monkeypatch.setattr(simhash, "sketches", lambda *a, real=simhash.sketches: real(*a).withColumn("bands", F.array(*[F.xxhash64("row", F.lit(b)) for b in range(simhash.BANDS)])))
    base = [[f"w{rng.randrange(900)}" for _ in range(1500)] for _ in range(6)]
    near = [" ".join(words[:-1]) for words in base]
    docs = [(next(keys), " ".join(words)) for words in base] + [(next(keys), text) for text in near]
    prints = [[simhash.fingerprint(simhash.np.unique(simhash.np.array(simhash.shingle_hashes(t.encode(), 5), dtype=simhash.np.uint64))) for t in pair] for pair in zip([" ".join(w) for w in base], near)]
    close = [i for i, (a, b) in enumerate(prints) if (a ^ b).bit_count() <= simhash.RADIUS]
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert close and kept == set(range(1, 13)) - {7 + i for i in close}
