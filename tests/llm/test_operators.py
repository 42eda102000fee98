"""The ten operators against brute force, and on nulls, empty texts, ties, repeats, empty tables and clashing names."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkmeter.llm import bpe, chat, maxent, mtree, packing, quality, simhash, suffixes, tiling, urlfilter
from sparkmeter.llm.catalog import URL_RULES, tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (None, "no id here at all"), (5, "twice the same"), (5, "twice the same"), (6, "one"), (7, "ünï çödé\x1c 中文  and\r\n more" * 3), (8, "long " * 30_000)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def clashing(df):
    """The same table with columns that operators use inside."""
    return df.withColumns({c: F.lit(1) for c in ("id", "fp", "a`b.c", "key", "n", "word", "bucket", "log_weight", "k1", "spans", "path", "rank", "gone_id", "component")})


def prose(rng, n, words=200):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def digest(data):
    return hashlib.sha256(data).hexdigest()


# --- 1 chat ------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    hard = "a<|im_end|>\n<|im_start|>x\\<\\|\\n"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 1, "assistant", None), (2, None, None, "x"), (2, 5, "ro\nle", ""), (None, 0, "assistant", "y" * 50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit(3))
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    turns = {1: [("user", hard), ("assistant", ""), ("assistant", hard)], 2: [("", "x"), ("ro\nle", "")], None: [("assistant", "y" * 50)]}
    assert set(found) == set(turns)
    for conv, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert found[conv]["turns_sha256"] == digest("".join(f"{r}\n{t}\n" for r, t in own).encode())
        assert (found[conv]["n_turns"], found[conv]["loss_chars"], found[conv]["loss_sha256"]) == (len(own), len(loss), digest(loss.encode()))
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_templates_fold_and_refuse(monkeypatch):
    text, spans = chat.render_text("{% if 1 == 1 %}a{{ 'b' + 'c' }}{% else %}z{% endif %}{% for m in ms %}{% generation %}{{ m.t }}{% endgeneration %}{% if not loop.last %},{% endif %}{% endfor %}", {"ms": [{"t": "x"}, {"t": "yy"}]})
    assert text == "abcx,yy" and spans == [[3, 4], [5, 7]]
    assert chat.fold(chat.parse("{% if 'a' != 'a' %}x{% endif %}p{{ 'q' | upper }}")) == [chat.Write(chat.Const("pQ"))]
    for bad in ("{{ a.__class__ }}", "{{ a | nope }}", "{% for x in %}", "{% if a %}", "{{ open( }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    monkeypatch.setattr(chat, "CHUNK_CHARS", 5)
    whole, spans = chat.render_text(chat.CHAT_TEMPLATE, {"messages": [{"role": "assistant", "text": "0123456789" * 3}]})
    assert "".join(whole[a:b] for a, b in spans) == "0123456789" * 3


# --- 2 top-k -----------------------------------------------------------------------------------------


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(400 + i, [0.5] * 8) for i in range(16)]
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")] + [0.0] * 7), (504, []), (505, [9.0]), (None, [1.0] * 8), (None, [0.5] * 8)]
    rows += [(3, [99.0] * 8), (50, [0.25] * 8), (100, rows[100][1]), (450, [0.5] * 8), (450, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(0) for c in ("score", "pid", "shard", "region")})
    whole = []
    for n, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((n, i, np.array([int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (8 - len(v)))))

    def expected(rows):
        out = []
        for n, i, v in rows:
            if i is not None and i % 50 == 0:
                best = sorted((-int(v @ w), j if j is not None else 1 << 63) for m, j, w in rows if m != n)[:5]
                out += [(i, r, j if j < 1 << 63 else None, -s) for r, (s, j) in enumerate(best, 1)]
        return collections.Counter(out)

    for shard_rows, block in ((50, 3), (10_000, 8192)):
        found = mtree.top_k(df, F.col("vec_id") % 50 == 0, 5, shard_rows=shard_rows, query_block=block)
        assert collections.Counter(tuple(r) for r in found.collect()) == expected(whole)
    assert mtree.top_k(df.limit(0), F.lit(True)).count() == 0
    assert len(mtree.top_k(df.where("vec_id in (1, 2)"), F.lit(True)).collect()) == 2
    assert mtree.top_k(df.where("vec_id = 1"), F.lit(True)).count() == 0


def test_tree_skips_by_stored_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (20, 4))
    data = (centres[rng.integers(0, 20, 4000)] + rng.integers(-5, 6, (4000, 4))).astype(np.int64)
    tree = mtree.MTree(data, np.arange(4000), page=32)
    scores = data @ data[7]
    order = sorted(range(4000), key=lambda i: (-scores[i], i))
    assert [place for _, place in tree.search(data[7], 5)] == order[:5]
    assert tree.skipped > 0 and tree.computed < 4000
    assert [place for _, place in tree.search(data[7], 5, int(scores[order[2]]))][:3] == order[:3]
    huge = data * (1 << 19)
    wide = mtree.MTree(huge, np.arange(4000), page=32)
    assert [place for _, place in wide.search(huge[7], 5)] == order[:5]


# --- 3 packing and 10 byte-level BPE -----------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    path, pattern = tokenizer()
    return bpe.TextEncoder(bpe.read_ranks(bpe.vocabulary(path)), pattern)


@pytest.fixture(scope="module")
def reference():
    path, pattern = tokenizer()
    return packing.encoding(bpe.vocabulary(path), pattern)


def test_bpe_equals_merging(codec, reference):
    rng = random.Random(0)
    parts = ["a", "th", "er", " ", "  ", "\n", "\t", "'s", "1", "23", "é", "ß", "中", "\x1c", "\x85", "!", "<|", "²", "́", "😀", "\r\n", "​", "ing", "aaaa", "　", "ǅ"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text)
        assert codec.decode(packed) == text.encode()


def test_bpe_append_and_edit(codec):
    rng = random.Random(1)
    buffer = bpe.Buffer(codec.codec, b"start")
    for _ in range(300):
        if rng.random() < 0.6:
            ids = buffer.append(bytes(rng.choice(b"theringo") for _ in range(rng.randrange(4))))
        else:
            at = rng.randrange(len(buffer.piece) + 1)
            ids = buffer.edit(at, rng.randrange(3), b"xa"[: rng.randrange(3)])
        assert ids == codec.codec.ids(buffer.piece)
        if len(buffer.piece) > 60:
            buffer = bpe.Buffer(codec.codec, b"")


def test_bpe_documents(spark, codec):
    path, pattern = tokenizer()
    found = bpe.digests(bpe.decode_documents(bpe.encode_documents(clashing(docs(spark, ODD)), path, pattern), path, pattern)).collect()
    want = collections.Counter((i, digest(codec.encode(t or "")), digest((t or "").encode())) for i, t in ODD)
    assert collections.Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == want
    assert {r["n_tokens"] for r in found if r["doc_id"] in (1, 2)} == {0}


def test_best_fit_rows():
    rng = random.Random(2)
    for _ in range(50):
        sizes, length = [rng.randint(1, 64) for _ in range(rng.randrange(200))], 64
        rows = packing.best_fit(sizes, length)
        assert sorted(p for r in rows for p in r) == list(range(len(sizes)))
        assert all(sum(sizes[p] for p in r) <= length for r in rows)
        free: list[int] = []
        for size in sorted(sizes, reverse=True):  # best fit by looking at every row
            fits = [k for k, f in enumerate(free) if f >= size]
            if fits:
                free[min(fits, key=lambda k: free[k])] -= size
            else:
                free.append(length - size)
        assert len(rows) == len(free)


def test_packing_is_lossless(spark, reference):
    path, pattern = tokenizer()
    packed = packing.pack(clashing(docs(spark, ODD)), path, pattern, length=32, block_ids=500)
    for row in packed.collect():
        places = np.frombuffer(row["position_ids"], "<u4")[: row["n_ids"]].tolist()
        assert places == [p for a, b in zip(row["cu_seqlens"], row["cu_seqlens"][1:]) for p in range(b - a)]
        assert len(row["input_ids"]) == 128 and row["cu_seqlens"][-1] == row["n_ids"]
    got = collections.defaultdict(dict)
    for r in packing.unpack(packed).where("doc_id is not null and doc_id <> 5").collect():
        got[r["doc_id"]][r["start"]] = bytes(r["ids"])
    for i, t in ODD:
        if i and i != 5:
            assert b"".join(x for _, x in sorted(got[i].items())) == np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()


# --- 4 quality ---------------------------------------------------------------------------------------


def test_quality_rejects_labelled_kinds(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        kind = 2 if i % 6 == 0 else 1 if i % 6 == 1 else 0
        text = prose(rng, 120) if kind == 0 else " ".join(["junk!!"] * 100) if kind == 1 else prose(rng, 80) + " vile" * 5
        rows.append((i, text))
        if i % 3 < 2 or i % 2:
            labels.append((i, 0 if kind == 1 else 1, 1 if kind == 2 else 0))
    table = clashing(docs(spark, [*rows, *[(i, t) for i, t in ODD if i is None or i < 5]]))
    known = spark.createDataFrame([*labels, (labels[0][0], 1, 0), (None, 0, 0), (99_999, None, None)], "doc_id long, quality int, toxic int")
    kept = quality.select(table, known)
    assert kept.columns == table.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    clean = {i for i in range(600) if i % 6 > 1}
    assert len(clean - ids) <= 4 and len(ids & {i for i in range(600) if i % 6 < 2}) <= 4
    drawn = quality.resample(table, known)
    assert {r["doc_id"] for r in drawn.collect()} == ids
    assert quality.select(table, known.limit(0)).count() == table.count()
    assert quality.select(table.limit(0), known).count() == 0


def test_quality_by_documents_and_means(spark):
    """One text's own words are no evidence, and a trace of it does not reject a long text."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 100)) for i in range(400)] + [(i, prose(rng, 60) + " vile" * 6) for i in range(400, 500)]
    rows += [(500, prose(rng, 100) + " often" * 60), (501, prose(rng, 100) + " often" * 60)]
    labels = [(i, 1, int(i >= 400)) for i in range(502) if i != 501]
    rows += [(i, prose(rng, 100) + " often" * 4) for i in range(600, 620)]  # words of one toxic text
    rows += [(i, prose(rng, 6000) + " vile" * 2) for i in range(620, 640)]
    rows += [(i, prose(rng, 900) + " vile" * 90) for i in range(640, 660)]
    drawn = quality.select(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    ids = {r["doc_id"] for r in drawn.collect()}
    assert len(set(range(600, 640)) - ids) <= 1 and len(set(range(400)) - ids) <= 4
    assert len(ids & {*range(400, 500), *range(640, 660)}) <= 4


def test_quality_cut():
    rng = np.random.default_rng(4)
    for _ in range(200):
        good, bad = np.round(rng.normal(0, 1, rng.integers(0, 9)), 1), np.round(rng.normal(-1, 1, rng.integers(0, 9)), 1)
        cut, unit = quality.cut_of(good, bad)
        best = min((good < c).sum() + (bad >= c).sum() for c in [-60.0, *np.arange(-4.95, 0, 0.1)])
        assert cut < 0 < unit and (good < cut).sum() + (bad >= cut).sum() == best


def test_quality_draw_against_brute_force(spark):
    """Mean evidence, log weight, Gumbel key and the draw, from the model's buckets."""
    rng = random.Random(18)
    rows = [(i, prose(rng, 80) + (" vile" * rng.randrange(1, 9) if i % 4 == 0 else "")) for i in range(300)] + [(None, "no id"), (7, prose(rng, 20))]
    table = docs(spark, rows).withColumn("back`tick", F.lit(1))
    known = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 300, 1) if i % 3] + [(3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(table, known)
    ratio = dict(zip(model.buckets.tolist(), model.ratios.tolist(), strict=True))

    def weight(text):
        found = quality.ngrams((text or "").encode()).tolist()
        means = [sum(ratio.get(b, (0, 0))[k] for b in found) / max(len(found), 1) for k in (0, 1)]
        return min((m - c) * u for m, c, u in zip(means, model.cuts, model.units, strict=True))

    noise = {(r["doc_id"], r["text"]): r["key"] for r in quality.with_key(docs(spark, rows).withColumn("w", F.lit(0.0)), "w", "key").collect()}
    keys = sorted(((weight(t) / quality.TEMPERATURE + noise[i, t], i) for i, t in rows), key=lambda p: -p[0])
    k = sum(weight(t) >= 0 for _, t in rows)
    drawn = quality.resample(table, known)
    got = {r["doc_id"]: (r["log_weight"], r["key"]) for r in drawn.collect()}
    assert collections.Counter(r["doc_id"] for r in quality.select(table, known).collect()) == collections.Counter(i for _, i in keys[:k])
    assert 0 < k < len(rows) and len(set(noise.values())) > 290 and got.keys() == {i for _, i in keys[:k]}
    for i, t in rows[:300]:
        if i in got and i != 7:
            assert got[i][0] == pytest.approx(weight(t), abs=1e-4)


def test_kth_largest(spark):
    rng = random.Random(4)
    values = [round(rng.gauss(0, 5), 1) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 37, 499):
        assert quality.kth_largest(df, "x", k, exact_rows=10, bins=4) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "x", 500) == float("-inf") and quality.kth_largest(df, "x", 0) == float("inf")


# --- 5 url filter ------------------------------------------------------------------------------------


def test_url_rules_and_templates(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?q", "http://example.com/en/2#x", "http://a.b.net/es/1", "http://net/fr/", "http://xnet/fr/1", "http://com", "http://com/?a", "http://x.org/a/b/c/d/e/f"]
    urls += [f"http://spam.org/offers/{i}" for i in range(40)] + [f"http://spam.org/news/{i}.html" for i in range(40)]
    pages = spark.createDataFrame([*enumerate(urls), (None, "http://spam.org/offers/77")], "page_id long, url string").withColumn("lex", F.lit(1))
    labels = spark.createDataFrame([(i, 0 if "offers" in (u or "") else 1, 0) for i, u in enumerate(urls) if i >= 12], "doc_id long, quality int, toxic int")
    found = {r["page_id"]: r for r in urlfilter.judge(pages, labels, URL_RULES).collect()}
    assert len(found) == len(urls) + 1
    assert [(found[i]["host"], found[i]["path"], found[i]["rule"]) for i in range(12)] == [
        ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("www.example.com", "/en/1", "www.example.com/en/"), ("example.com", "/en/2", "example.com/en/"),
        ("a.b.net", "/es/1", "net/es/"), ("net", "/fr/", "net/fr/"), ("xnet", "/fr/1", None), ("com", "", None), ("com", "/", "com/"), ("x.org", "/a/b/c/d/e/f", None),
    ]
    verdicts = {(found[i]["template"], found[i]["verdict"]) for i in range(12, len(urls))}
    assert verdicts == {("/offers/*", "block"), ("/news/*", "allow")} or {v for t, v in verdicts if "offers" in t} == {"block"}
    assert found[None]["verdict"] == "block" and found[11]["template"] == "/a/b/c/d/e/f"
    assert urlfilter.judge(pages.limit(0), labels, URL_RULES).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages.where("page_id = 0"), labels.limit(0), URL_RULES).collect()} == {"allow"}


def brute_templates(rows):
    """The tree in plain Python: rows of (host, segments, n, lab, bad) to the template of each."""
    lab, bad = sum(r[3] for r in rows), sum(r[4] for r in rows)
    prior = bad / lab if lab else 0.0
    out = {}

    def node(host, prefix, level, own):
        if len(own) == 1 or not own:
            for r in own:
                out[host, r[1]] = "".join(["", *[f"/{x}" for x in [*prefix, *r[1][level:]]]])
            return
        groups = collections.defaultdict(list)
        for r in own:
            if len(r[1]) <= level:
                out[host, r[1]] = "".join(f"/{x}" for x in prefix)
            else:
                groups[r[1][level]].append(r)
        all_n, all_lab, all_bad = (sum(r[i] for g in groups.values() for r in g) for i in (2, 3, 4))
        share = (all_bad + prior) / (all_lab + 1)
        merged = collections.defaultdict(list)
        for seg, g in groups.items():
            n, lab, bad = (sum(r[i] for r in g) for i in (2, 3, 4))
            error = (share * (1 - share)) ** 0.5
            alike = lab >= urlfilter.TESTED and urlfilter.Z * error <= urlfilter.DELTA * lab**0.5 and abs(bad - share * lab) <= urlfilter.Z * error * lab**0.5
            thin = n < urlfilter.SUPPORT or (len(groups) > urlfilter.MANY and all_n < len(groups) * urlfilter.SUPPORT)
            merged["*" if len(groups) > 1 and (alike or thin) else seg] += g
        for to, g in merged.items():
            node(host, [*prefix, to], level + 1, g)

    for host in {r[0] for r in rows}:
        node(host, [], 0, [r for r in rows if r[0] == host])
    return out


def test_url_templates_against_a_plain_tree(spark):
    rng = random.Random(13)
    urls, labels = [], []
    for i in range(1500):
        host = rng.choice(["a.org", "b.org", "b.org"])
        section = rng.choice(["news", "offers", "blog", "rare" + str(i % 200) if i % 40 == 0 else "docs"])
        parts = [section, *rng.choice([[], ["2024"], ["x", "y", "z", "deep", "er", "still"], [f"user{chr(97 + i % 26)}{chr(97 + i % 23)}", "p"]])]
        urls.append(f"http://{host}/" + "/".join(parts))
        if i % 3:
            labels.append((i, 0 if section == "offers" and rng.random() < 0.9 else 1, 0))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host, path = urlfilter.host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = {(r["host"], tuple(r["lex"])): r["template"] for r in urlfilter.templates(parsed, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    known, rows = dict((i, q == 0) for i, q, _ in labels), collections.defaultdict(lambda: [0, 0, 0])
    for r in parsed.withColumn("lex", urlfilter.lexical(F.col("path"))).collect():
        own = rows[r["host"], tuple(r["lex"])]
        own[0] += 1
        own[1] += r["page_id"] in known
        own[2] += known.get(r["page_id"], False)
    assert found == brute_templates([(h, lex, *own) for (h, lex), own in rows.items()])
    assert {t.split("/")[1] for t in found.values()} >= {"offers", "*"} and any(t.count("/") == 7 for t in found.values())


def test_url_chains_are_passed_in_one_step(spark, monkeypatch):
    """Two paths that share sixty segments: three rounds, not sixty."""
    chain = "/".join(f"d{chr(97 + k % 26)}x" for k in range(60))
    rows = [(1, f"http://h.com/{chain}/left/end"), (2, f"http://h.com/{chain}/right/end"), (3, f"http://h.com/{chain}"), (4, f"http://h.com/{chain}"), (5, "http://i.com/a/b")]
    written = []
    whole = urlfilter.saved
    monkeypatch.setattr(urlfilter, "saved", lambda df: written.append(1) or whole(df))
    found = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"), URL_RULES)
    templates = {r["page_id"]: r["template"] for r in found.collect()}
    assert templates[3] == f"/{chain}" and templates[5] == "/a/b" and len(written) <= 6
    assert all(templates[n].startswith(f"/{chain}/") for n in (1, 2))


# --- 6 suffix arrays ---------------------------------------------------------------------------------


def test_suffix_array_and_prefixes():
    rng = random.Random(5)
    for _ in range(500):
        text = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(30))]
        found = suffixes.suffix_array(text)
        assert found == sorted(range(len(text)), key=lambda i: text[i:])
        shared = suffixes.common_prefixes(text, found)
        for k in range(1, len(found)):
            a, b = text[found[k - 1] :], text[found[k] :]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_strips_hash_like_whole_texts():
    rng = random.Random(11)
    texts = [bytes(rng.randrange(3) + 97 for _ in range(n)) for n in (0, 5, 700, 90, 2500, 40)]

    def anchors(size):
        out = set()
        for own in suffixes.strips(texts, 20, 40, size):
            found = suffixes.Hashed(own)
            at, strip = found.anchors(40, 20)
            local = at - found.starts[strip] + found.offsets[strip]
            out |= set(zip(found.rows[strip].tolist(), local.tolist(), found.of(at, at + 20).tolist(), strict=True))
        return out

    assert anchors(100) == anchors(64) == anchors(1 << 20) and len(anchors(100)) > 50


def brute_repeats(texts, window):
    counts = collections.Counter(hash(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if counts[hash(t[i : i + window])] > 1:
                gone[i : i + window] = b"\x01" * window
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("largest", [4096, 12, 1])
def test_repeats_against_brute_force(spark, largest):
    rng = random.Random(6)
    shared = [prose(rng, 30) for _ in range(4)]
    rows = [(i, " ".join([prose(rng, rng.randrange(30)), *rng.sample(shared, rng.randrange(3)), prose(rng, rng.randrange(20))])) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(8)] + [(200 + i, rows[20][1].replace("w1", f"ü{i}", 2)) for i in range(12)]
    rows += [r for r in ODD if r[0] != 8] + [(300, "ab" * 120), (301, "é" * 90), (302, shared[0] + prose(rng, 70_000, 50_000) + shared[0])]
    found = suffixes.remove_repeats(clashing(docs(spark, rows)), window=40, gram=20, largest=largest)
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found.collect())
    want = brute_repeats([(t or "").encode() for _, t in rows], 40)
    assert got == collections.Counter((i, *w) for (i, _), w in zip(rows, want))
    kept = suffixes.without_repeats(clashing(docs(spark, rows)), window=40, gram=20, largest=largest)
    assert kept.columns == clashing(docs(spark, rows[:1])).columns and kept.count() == len(rows)
    assert kept.where("doc_id = 1 and text is null").count() == 1
    assert suffixes.remove_repeats(docs(spark, []), window=40, gram=20).count() == 0


class Pieces:
    """Pieces of contexts in the place of a frame, so that a stage runs in this process."""

    def __init__(self, rows):
        names = ["width", "core", "before", "after", "k1", "k2", "at", "single"]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        self.rows = pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def select(self, *names):
        self.rows = self.rows.select(list(names))
        return self

    def repartition(self, *names):
        return self

    def sortWithinPartitions(self, *names):
        self.rows = self.rows.sort_by([(n, "ascending") for n in names])
        return self

    def mapInArrow(self, run, schema):
        return [r for b in run(iter(self.rows.to_batches(max_chunksize=64))) for r in zip(*[c.to_pylist() for c in b.columns])]


def test_groups_put_few_symbols_into_suffix_arrays(monkeypatch):
    rng = random.Random(9)
    rows = []
    for core in range(120):
        width = 24 + core % 2
        passage = bytes(rng.randrange(256) for _ in range(2 * width))
        for _ in range(rng.choice([2, 3, 9, 30])):  # pieces that leave a common passage, or pad it with zeros, at any place
            a, b = rng.randrange(width + 1), rng.randrange(width + 1)
            left, right = (bytes(rng.choice([0, 0, 7, 8]) for _ in range(n)) for n in (a, b))
            before, after = (left + passage[a:width])[rng.choice([0, 0, 5]) :], (passage[width : 2 * width - b] + right)[: width - rng.choice([0, 0, 5])]
            for _ in range(rng.choice([1, 1, 1, 2])):
                rows.append((width, core, before, after, len(rows), 1, rng.randrange(1000), rng.random() < 0.9))
    seen = collections.Counter((w, c, before[i:], after[: w - len(before) + i]) for w, c, before, after, *_ in rows for i in range(len(before) + 1) if 0 <= w - len(before) + i <= len(after))
    want = set()
    for w, c, before, after, k1, _, at, single in rows:
        starts = [i for i in range(len(before) + 1) if 0 <= w - len(before) + i <= len(after) and seen[w, c, before[i:], after[: w - len(before) + i]] > 1]
        want |= {(k1, at + i + j) for i in starts for j in range(200)} if single else set()
    symbols = []
    whole = suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda text: symbols.append(len(text)) or whole(text))
    monkeypatch.setattr(suffixes, "BATCH_PIECES", 100, raising=False)
    found = suffixes.by_suffix_array(Pieces(rows), 200)
    assert {(k1, x) for k1, _, first, last in found for x in range(first, last)} == want and len(want) > 10_000
    assert 0 < sum(symbols) < 20 * len(rows)  # as bytes they are some 50 each


# --- 7 SimHash ---------------------------------------------------------------------------------------


def groups_of(links, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_components(spark):
    rng = random.Random(7)
    rows = [(20 + i, prose(rng, 40)) for i in range(40)]
    rows += [(100 + i, rows[i % 5][1] + f" end{i % 3}") for i in range(30)] + [r for r in ODD if r[0] is not None and r[0] != 5]
    table = clashing(docs(spark, [*rows, (None, rows[0][1])]))
    found = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.linked(simhash.fingerprints(table)).collect()}
    prints = {i: simhash.fingerprint(np.array(simhash.shingle_hashes((t or "").encode(), 3), np.uint64)) for i, t in rows}
    want = groups_of([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2], prints)
    assert {i: f for i, f in found.items() if i is not None} == {i: (prints[i], want[i]) for i in prints}
    assert found[None][1] == want[20] and prints[1] == prints[2] == prints[3] == 0
    assert simhash.linked(simhash.fingerprints(table.limit(0))).count() == 0


def test_simhash_links_by_rows_without_an_id(spark):
    prints = spark.createDataFrame([(7, 0), (None, 3), (9, 15), (None, 1 << 40 | 1 << 50 | 1 << 60), (4, -1)], "doc_id long, fp long")
    found = sorted(((r["fp"], r["component_id"]) for r in simhash.linked(prints).collect()))
    assert found == [(-1, 4), (0, 7), (3, 7), (15, 7), (1 << 40 | 1 << 50 | 1 << 60, None)]


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(8)
    values = [rng.getrandbits(64) for _ in range(50)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values for _ in range(4)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:60]:
        assert sorted(p for p, _ in tree.search(v, 4)) == [p for p, w in enumerate(values) if (v ^ w).bit_count() <= 4]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 60, 5000)) for i in range(40)]
    for i in range(80):
        words = rows[i % 12][1].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(9999)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A b")]
    sets = {i: frozenset(simhash.shingle_hashes((t or "").encode(), 5)) for i, t in rows}
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = groups_of(alike, sets)
    table = clashing(docs(spark, [*rows, (None, "kept as it is")]))
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table).collect()} == want
    kept = simhash.one_of_each(table)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {*want.values(), None}


def test_one_of_each_works_on_rows(spark):
    """Clashing ids lose no text, and copies leave one row with or without ids."""
    kept = lambda rows: sorted((str(r["doc_id"]), r["text"]) for r in simhash.one_of_each(clashing(docs(spark, rows))).collect())
    x, alpha = "x y z " + prose(random.Random(1), 30), "alpha " + prose(random.Random(2), 30)
    assert kept([(1, x), (1, alpha), (0, alpha)]) == sorted([("1", x), ("0", alpha)])
    assert kept([(1, "a b c"), (1, "a b c"), (None, "a b c")]) == [("1", "a b c")]
    assert kept([(None, x), (None, x), (None, alpha), (2, None), (2, ""), (None, None)]) in ([("2", t), *sorted([("None", x), ("None", alpha)])] for t in (None, ""))
    assert simhash.one_of_each(docs(spark, [])).collect() == []


@pytest.mark.parametrize("largest", [2, 7])
def test_near_duplicates_in_large_clusters(spark, monkeypatch, largest):
    """A long chain, a base with many edits and look-alikes below the similarity, settled shard by shard."""
    monkeypatch.setattr(simhash, "LARGEST", largest)
    rng = random.Random(largest)
    chain, base = prose(rng, 160, 5000).split(), prose(rng, 100, 5000).split()
    rows = [(i, " ".join(chain[i : i + 100])) for i in range(0, 60, 3)]
    for i in range(40):
        words = list(base)
        for _ in range(1 + i % 7):
            words[rng.randrange(100)] = f"new{rng.randrange(9999)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, " ".join(base)), (201, " ".join(base[:85])), (None, " ".join(base[:60])), (202, prose(rng, 50))]
    rng.shuffle(rows)
    sets = {i: frozenset(simhash.shingle_hashes(t.encode(), 5)) for i, t in rows if i is not None}
    bands = {i: simhash.band_keys(np.array(sorted(s), np.uint64)) for i, s in sets.items()}
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and any(x == y for x, y in zip(bands[a], bands[b], strict=True))]
    want = groups_of(alike, sets)
    assert len(want) / 6 < len(set(want.values())) < len(want) / 2  # links and look-alikes
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows)).collect()} == want


def test_near_duplicates_of_a_base_in_other_chunks(spark, monkeypatch):
    """Edits of one base that are not alike among each other, in a group of many chunks; the base has the largest id."""
    monkeypatch.setattr(simhash, "LARGEST", 8)
    rng = random.Random(11)
    base = prose(rng, 200, 9000).split()
    rows = [(900, " ".join(base))]
    for i in range(60):
        words = list(base)
        for k in range(4):
            words[50 * k + 5 + rng.randrange(40)] = f"new{i}_{k}"
        rows.append((i, " ".join(words)))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert found == dict.fromkeys([i for i, _ in rows], 0)


def test_near_duplicates_with_repeated_lines(spark):
    """Repeats of a line weigh on the fingerprint and not on the set of shingles."""
    rng = random.Random(12)
    rows, far = [], 0
    for i in range(40):
        words, line = prose(rng, 200, 9000).split(), " " + prose(rng, 10, 9000)
        other = [*words[:100], "changed", *words[101:]]
        rows += [(2 * i, " ".join(words) + line * 2), (2 * i + 1, " ".join(other) + line * 40)]
        one, two = (simhash.fingerprint(np.array(simhash.shingle_hashes(t.encode(), 5), np.uint64)) for _, t in rows[-2:])
        far += (one ^ two).bit_count() > 20
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert far and found == {i: i - i % 2 for i, _ in rows}


# --- 8 language model --------------------------------------------------------------------------------


def test_maxent_scores(spark):
    rng = random.Random(10)
    rows = []
    for i in range(300):
        side = rng.choice("xy")
        rows.append((20 + i, " ".join(f"{rng.choice('abcdefgh')}{side}{side}" for _ in range(60))))
    rows += [r for r in ODD if r[0] not in (None, 5, 8)]
    table = clashing(docs(spark, [*rows, (None, "axx only here")]))
    found = collections.defaultdict(list)
    for r in maxent.score(table, bucket_tokens=500).collect():
        found[r["doc_id"]].append(r)
    train = collections.Counter()
    for i, t in [*rows, (None, "axx only here")]:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(maxent.tokens((t or "").encode()))
    whole, kinds = sum(train.values()), len(train)
    for i, t in rows:
        words, row = maxent.tokens((t or "").encode()), found[i][0]
        base = sum(np.log10((train[w] + 0.5) / (whole + 0.5 * (kinds + 1))) for w in words)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(words), sum(train[w] > 0 for w in words), whole)
        assert row["base_score"] == pytest.approx(base) and row["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
    held = [found[i][0] for i in range(20, 320) if found[i][0]["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert maxent.score(table.limit(0)).count() == 0


def brute_model_score(tables, frequent, words):
    """Log10 probability of each token's digits, feature by feature and token by token."""
    codes, mask, mix = [maxent.code_of(w) for w in words], (1 << 64) - 1, int(maxent.MIX)
    bits = len(tables[1]).bit_length() - 1
    row = lambda x: (x * mix & mask) >> (64 - bits)
    known, out = dict(zip(frequent.codes.tolist(), frequent.digits.tolist(), strict=True)), []
    softmax = lambda x, i: float(x[i] - np.log(np.exp(x).sum()))
    for i, code in enumerate(codes):
        one, two = codes[i - 1] if i else 0, codes[i - 2] if i > 1 else 0
        last, leaf = row(one), code & 1023
        first = sum(np.float64(tables[t][r]) for t, r in ((0, 0), (1, last), (2, row(two ^ 0xABCDEF)), (3, row((one * 31 + two) & mask))))
        second = np.float64(tables[4][leaf // 32]) + tables[5][leaf // 32 * maxent.FINE_ROWS + last % maxent.FINE_ROWS]
        third = np.float64(tables[6][leaf]) + tables[7][leaf * maxent.WORD_ROWS + last % maxent.WORD_ROWS]
        out.append((softmax(first, leaf // 32) + softmax(second, leaf % 32) + softmax(third, known.get(code, 0))) / np.log(10))
    return out


def test_maxent_score_against_brute_force():
    rng = np.random.default_rng(15)
    texts = [" ".join(f"w{rng.integers(40)}{'x' * rng.integers(5)}" for _ in range(rng.integers(30))).encode() for _ in range(20)]
    codes, starts = maxent.encoded(texts)
    words = np.unique(codes)[:20]
    frequent = maxent.Frequent(words, rng.integers(1, 32, 20))
    model = maxent.Model(frequent=frequent)
    model.tables = [rng.normal(size=t.shape).astype(np.float32) for t in model.tables]
    got = model.run(codes, starts, False)
    want = [x for t in texts for x in brute_model_score(model.tables, frequent, maxent.tokens(t))]
    assert got == pytest.approx(want, abs=1e-4)


def test_maxent_starts_as_the_unigram_model():
    """Before training, all words and one unknown one have the probabilities of smoothed counts, which sum to one."""
    rng = random.Random(16)
    count = {maxent.code_of(f"v{i}".encode()): rng.randrange(1, 50) for i in range(3000)}
    codes, n = np.array(sorted(count), np.uint64), np.array([count[c] for c in sorted(count)], float)
    leaf = (codes & np.uint64(1023)).astype(int)
    totals = np.bincount(leaf, n, 1024), np.bincount(leaf, minlength=1024).astype(float)
    rank = np.zeros(len(codes), int)
    for x in np.unique(leaf):
        own = np.flatnonzero(leaf == x)
        rank[own[np.argsort(-n[own], kind="stable")]] = np.arange(1, len(own) + 1)
    top = rank < 32
    frequent = maxent.Frequent(codes[top], rank[top])
    model = maxent.Model(maxent.unigram(*totals, codes[top], n[top], frequent, 4096), frequent=frequent)
    found = model.run(codes, np.array([0]), False)
    tail = ~top
    rest = totals[0] - np.bincount(leaf[top], n[top], 1024) + 0.5 * (totals[1] - np.bincount(leaf[top], minlength=1024) + 1)
    found[tail] += np.log10((n[tail] + 0.5) / rest[leaf[tail]])
    mass = totals[0].sum() + 0.5 * (totals[1].sum() + 1024)
    assert 10**found == pytest.approx((n + 0.5) / mass, rel=1e-3)


def test_maxent_codes_of_long_texts(monkeypatch):
    monkeypatch.setattr(maxent, "CHUNK_BYTES", 64)
    rng = random.Random(17)
    texts = [b"", b" a ", "Ünï  X".encode() * 40, b"w" * 500 + b" end", b"\n".join(bytes([97 + rng.randrange(26)]) * rng.randrange(90) for _ in range(50))]
    codes, starts = maxent.encoded(texts)
    want = [[maxent.code_of(w) for w in maxent.tokens(t)] for t in texts]
    assert [c.tolist() for c in np.split(codes, starts[1:])] == want


def test_maxent_pairs_of_words():
    """A word that depends on both words before it together, not on either alone."""
    rng = random.Random(14)
    texts = []
    for _ in range(4000):
        a, b = rng.choice(["red", "sky"]), rng.choice(["red", "sky"])
        texts.append(f"{a} {b} {'same' if a == b else 'otherwise'}".encode())
    codes, starts = maxent.encoded(texts)
    model = maxent.Model()
    for _ in range(60):
        model.run(codes, starts, True)
    assert model.run(codes, starts, False)[starts + 2].mean() > -0.15 and maxent.DIGITS == 32


# --- 9 decontamination -------------------------------------------------------------------------------


def test_tiling_finds_reordered_items(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, 40, 3000)) for i in range(12)] + [(50, "short item"), (51, ""), (52, None)]
    words = items[0][1].split()
    turned = " ".join([*words[20:], "and", "then", *words[:20]])
    rows = [(0, f"before {turned} after"), (1, f"x {items[1][1].upper()}!! y"), (2, prose(rng, 300, 3000)), (3, " ".join(items[2][1].split()[:15])), (4, "a SHORT, item."), *[(i + 10 if i else i, t) for i, t in ODD]]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit(1))
    table = clashing(docs(spark, rows))
    found = {(r["doc_id"], r["item_id"]): r["coverage"] for r in tiling.matches(table, bench).collect()}
    assert found == {(0, 0): 1.0, (1, 1): 1.0, (4, 50): 1.0}
    kept = tiling.decontaminate(table, bench)
    assert kept.columns == table.columns and kept.count() == len(rows) - 3
    assert tiling.decontaminate(table, bench.limit(0)).count() == len(rows) and tiling.matches(table.limit(0), bench).count() == 0
    assert len(list(tiling.blocks(bench, "item_id", "text", limit=300))) > 1


def brute_tiles(item, text, least):
    """Greedy tiling by looking at every pair of places, again after each tile."""
    used_i, used_t, out = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and i + n not in used_i and t + n not in used_t:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = i, t, n
        if best is None:
            return out
        out.append(best)
        used_i |= set(range(best[0], best[0] + best[2]))
        used_t |= set(range(best[1], best[1] + best[2]))


def test_tiles_against_brute_force():
    rng = random.Random(12)
    for _ in range(150):
        item, text = [rng.randrange(1, 4) for _ in range(18)], [rng.randrange(1, 4) for _ in range(30)]
        assert tiling.tiles(item, text, 3) == brute_tiles(item, text, 3)
    assert tiling.tiles([], [1, 2, 3], 3) == tiling.tiles([1, 2, 3], [], 3) == []


def test_repetitive_texts_do_not_multiply():
    import time

    item, text = " ".join(["on", "off"] * 1000), " ".join(["on", "off"] * 10_000)
    matcher = tiling.Matcher([(1, item)], 5, 0.5)
    began = time.perf_counter()
    assert matcher.matches(text.encode())[0][:2] == (0, 1.0)
    assert time.perf_counter() - began < 1
