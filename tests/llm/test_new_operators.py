"""Whitening, substring dedup and tokenizer alignment against brute force, and on odd input."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkmeter.llm import alignment, relz, whitening

DOCS = "doc_id long, text string"
CLASHING = ("size", "x", "n", "component", "chunk", "place", "stripe", "salt", "id", "key", "pos", "row", "spans", "kept", "a`b.c")


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASHING})


# --- 11 whitening ------------------------------------------------------------------------------------


VECTORS = "vec_id long, embedding array<float>"


def whitened_by_hand(rows, k):
    own = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    fitted = np.unique(np.array([x for _, x in own]), axis=0)
    n, sums = len(fitted), fitted.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fitted.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    return {(i, c + 1): (n, int(((n * x - sums) ** 2).sum()), abs(float((x - sums / n) @ axes[:, c]) / np.sqrt(values[c])), values[c] / values.sum()) for i, x in own for c in range(k)}


def test_whitening_by_hand(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(6, 6))
    rows = [(i, (rng.normal(size=6) @ mix + 3).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(50)] + [(2000, None), (2001, []), (2002, [1.0, None] * 3), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6)]
    found = whitening.whiten(clashing(spark.createDataFrame(rows, VECTORS).repartition(5)), 4).collect()
    wanted = whitened_by_hand(rows, 4)
    assert {(r.vec_id, r.component) for r in found} == set(wanted) and len(found) == len(wanted)
    for r in found:
        n, deviation, white, explained = wanted[r.vec_id, r.component]
        assert (r.n, int(r.deviation)) == (n, deviation) and r.identity_error < 1e-9
        assert abs(r.whitened) == pytest.approx(white, rel=1e-6, abs=1e-9) and r.explained == pytest.approx(explained, rel=1e-9)
    for c in range(1, 5):  # one sign for all rows
        model = whitening.fit(spark.createDataFrame(rows, VECTORS))
        signs = {np.sign(r.whitened * ((np.floor(256 * np.array(dict(rows)[r.vec_id], np.float32).astype(float)) - np.array(model.sums) / model.n) @ model.vectors[:, c - 1])) for r in found if r.component == c}
        assert len(signs) == 1


def test_whitening_odd_input(spark):
    empty = whitening.whiten(spark.createDataFrame([], VECTORS))
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (None, [0.5, 0.5])], VECTORS)).collect()
    assert len(flat) == 4 and {(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in flat} == {(1, 0, None, None, None)}
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(4)] + [(9, [1.0])], VECTORS)).collect()
    assert len(line) == 8 and all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in line)
    far = whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 1e9])], VECTORS)).collect()
    assert len(far) == 6 and all(np.isfinite(r.whitened) for r in far if r.whitened is not None)


def test_whitening_packs_exactly():
    x = np.array([[1, -2, 127], [1, -129, 0], [2**40, 0, 1], [-(2**15), 0, 0], [2**31, 0, 0]])
    rows = whitening.packed(x)
    assert [r[0] for r in rows] == [0, 1, 3, 1, 3] and (whitening.unpacked(rows, 3) == x).all()
    big = np.array([[2**62, -(2**62)], [5, 7]])
    assert [int(v) if v is not None else None for v in whitening.deviations(big, 3, [2**40, 1]).to_pylist()] == [sum((3 * v - s) ** 2 for v, s in zip(r, (2**40, 1), strict=True)) if sum((3 * v - s) ** 2 for v, s in zip(r, (2**40, 1), strict=True)) < 10**38 else None for r in big.tolist()]


# --- 12 substring dedup ------------------------------------------------------------------------------


def kept_by_hand(rows, window):
    first = {}
    for i, t in rows:
        words = (t or "").encode().split()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, 1 << 63), (1 << 63) - 1 if i is None else i)
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < ((1 << 63) - 1 if i is None else i):
                gone |= set(range(s, s + window))
        out.append((str(i), len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out)


def relz_checked(spark, rows, window=13, gram=5):
    found = relz.without_repeats(clashing(spark.createDataFrame(rows, DOCS).repartition(4)), window, gram).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found) == kept_by_hand(rows, window)
    return sum(r.n_removed for r in found)


def corpus(rng, n):
    words = [f"w{k}" for k in range(300)] + ["ünï", "x\x1cy", "long" * 90]
    prose = lambda k: [rng.choice(words) for _ in range(k)]
    shared = [prose(k) for k in (9, 12, 13, 14, 40, 90)]
    rows = []
    for i in range(n):
        parts = [prose(rng.randrange(0, 40)) if rng.random() < 0.6 else rng.choice(shared)[rng.randrange(3) :] for _ in range(rng.randrange(1, 6))]
        rows.append((rng.randrange(10 * n), rng.choice([" ", "\n", "  \t", "\x0b"]).join(w for p in parts for w in p)))
    rows += [(10 * n + i, rows[i % 3][1]) for i in range(40)] + [(None, rows[0][1]), (None, rows[5][1]), (rows[0][0], rows[1][1]), rows[2], rows[2]]
    return rows + [(-1, None), (-2, ""), (-3, " \n "), (-4, "a " * 60), (-5, "a " * 40), (-6, "one two")]


@pytest.mark.parametrize("few,largest", [(16, 8192), (2, 8192), (1, 3), (16, 3)])
def test_relz_by_hand(spark, monkeypatch, few, largest):
    monkeypatch.setattr(relz, "FEW", few)
    monkeypatch.setattr(relz, "LARGEST", largest)
    monkeypatch.setattr(relz, "BLOCK_WORDS", 400)
    assert relz_checked(spark, corpus(random.Random(few * largest), 150)) > 1000


def test_relz_blocks_and_strips(spark, monkeypatch):
    assert relz.without_repeats(spark.createDataFrame([], DOCS)).collect() == []
    texts = [b"some words \n and " + b"z" * 300 + b" x", b"", b" ", b"y" * 5000 + b" some words"]
    whole = relz.word_hashes(texts)
    monkeypatch.setattr(relz, "STRIP_BYTES", 64)
    cut = relz.word_hashes(texts)
    assert (whole[0] == cut[0]).all() and whole[1].tolist() == cut[1].tolist() == [5, 0, 0, 3] and whole[0][0] == whole[0][6]
    relz_checked(spark, corpus(random.Random(9), 60), window=6, gram=3)
    a, b, c = (list(x) for x in ([b"p", b"q", b"r", b"s"], [b"x", b"q", b"r", b"s", b"q", b"r"], [b"q", b"r", b"s", b"q"]))
    assert relz.factors([a, b, c], [1, 2, 3], 2) == [[], [(1, 4), (4, 6)], [(0, 3), (2, 4)]]


# --- 13 alignment ------------------------------------------------------------------------------------


FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned_by_hand(texts):
    """Token by token, whole texts, byte by byte."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    symbols = alignment.byte_symbols()
    counts, docs = {}, []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(symbols[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != f" {text}".encode() or b"".join(bytes_b) != f" {text}".encode():
            docs.append(None)
            continue
        owner_a = [k for k, t in enumerate(bytes_a) for _ in t]
        owner_b = [k for k, t in enumerate(bytes_b) for _ in t]
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        groups, last_a, last_b = [], 0, 0
        for at in range(1, len(owner_a) + 1):
            if at == len(owner_a) or (owner_a[at] != owner_a[at - 1] and owner_b[at] != owner_b[at - 1]):
                x, y = owner_a[at - 1] + 1, owner_b[at - 1] + 1
                groups.append(",".join(map(str, ids_a[last_a:x])) + "|" + ",".join(map(str, ids_b[last_b:y])))
                last_a, last_b = x, y
        pairs = [(ids_a[x], ids_b[y]) for x, y in links]
        for p in pairs:
            counts[p] = counts.get(p, 0) + 1
        docs.append((len(ids_a), len(ids_b), groups, pairs))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (d[0], d[1], len(d[2]), len(d[3]), sum(counts[p] == best[p[1]] for p in d[3]), sum(counts[p] for p in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest()) for d in docs]


HARD = ["", None, "  two  spaces ", "line\nbreaks \n and\ttabs x", "<|endoftext|> <s> </s> <unk>", "ünï çödé 中文字符 \U0001f600‍\U0001f600", "a▁b c", "▁", " ", "\n", "x" * 3000, "don't we'll 'tis", "\x1c \x1d a", "é ﬁ", "tail "]


def checked(found, rows):
    own = sorted(tuple("" if v is None else str(v) for v in (r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in found.collect())
    assert own == sorted(tuple("" if v is None else str(v) for v in (i, *w)) for (i, _), w in zip(rows, aligned_by_hand([t for _, t in rows]), strict=True))


def test_alignment_by_hand(spark, monkeypatch):
    rng = random.Random(3)
    words = ["the", "Token", "überall", "naïve", "12345", "foo_bar", "(x)", "it's", "中文", "\n", "…", "re-run,", "supercalifragilistic"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(80)] + list(enumerate(HARD, 200)) + [(None, "the Token"), (5, "the Token"), (5, "the Token")]
    df = clashing(spark.createDataFrame(rows, DOCS).repartition(3))
    checked(alignment.align(df, *FILES), rows)
    monkeypatch.setattr(alignment, "PART_CHARS", 20)
    monkeypatch.setattr(alignment, "CACHE_PIECES", 5)
    aligner = alignment.Aligner(*[open(f, "rb").read() for f in FILES])
    for text in ("the Token it's foo_bar (x) " * 9 + "end", "the Token it's foo_bar ▁ x (x) " * 3 + "y"):
        parts = alignment.parts_of(text)
        assert len(parts) > 1 and " ".join(parts) == text
        one = alignment.Documents(1)
        if not any(aligner.spoilt(alignment.pieces_of(p)) for p in parts):
            for p in parts:
                one.add(aligner, [0], [p])
        wanted = aligned_by_hand([text])[0]
        assert tuple(one.figures[:, 0].tolist()) == wanted[:4] and (one.hashes[0].hexdigest() if one.hashes[0] else "") == wanted[6]


def test_alignment_stripes_and_empty_tables(spark, monkeypatch):
    assert alignment.align(spark.createDataFrame([], DOCS), *FILES).collect() == []
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 16 << 20)  # 804 stripes
    rows = [(i, f"word{i % 3} and some {i} more") for i in range(30)]
    checked(alignment.align(spark.createDataFrame(rows, DOCS).repartition(4), *FILES), rows)
