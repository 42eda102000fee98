"""Each stage of the pipeline against brute force on what the stage before it kept."""

import collections
import hashlib
import random

import pytest

import corpus_pipeline
from sparkmeter.llm import bpe, packing, quality, simhash, tiling
from sparkmeter.llm.catalog import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=4000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    items = [(i, prose(rng, 40)) for i in range(6)]
    shared = prose(rng, 60)
    texts = {i: prose(rng, 80, 300) for i in range(120)}
    texts |= {i: prose(rng, 60, 300) + " vile" * 6 for i in range(200, 240)}
    texts |= {300 + i: texts[i % 4].replace("w1", "x", 1) if i % 2 else texts[i % 4] for i in range(20)}
    texts |= {400 + i: prose(rng, 30) + " " + shared + " " + prose(rng, 30) for i in range(6)}
    texts |= {500 + i: prose(rng, 20) + " " + items[i][1] for i in range(4)}
    rows = [(i, t) for i, t in texts.items()] + [(900, None), (901, ""), (902, "ünï " * 90), (None, "a row without an id"), (903, "long " + prose(rng, 60_000, 50_000))]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(200 <= i < 240)) for i in texts if i % 5], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    kept, frames = {"": rows_of(docs)}, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = frames[name] = spark.read.parquet(str(tmp_path / name))
        if name != names[-1]:
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
            kept[name] = rows_of(docs)
    classified, unique, cut, clean = (kept[n] for n in names[:4])
    drawn = quality.resample(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert collections.Counter(i for i, _ in classified) == collections.Counter(r["doc_id"] for r in drawn.collect())
    assert not {i for i, _ in classified} & set(range(200, 240)) and len({i for i, _ in classified} & set(range(120))) >= 117

    sets = {i: frozenset(simhash.shingle_hashes((t or "").encode(), 5)) for i, t in classified if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert {i for i, _ in unique} == {root(i) for i in sets} | {i for i, _ in classified if i is None}

    counts = collections.Counter(hash(t[i : i + 200]) for t in [(t or "").encode() for _, t in unique] for i in range(len(t) - 199))
    want = {}
    for i, text in unique:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 199):
            if counts[hash(data[at : at + 200])] > 1:
                gone[at : at + 200] = b"\x01" * 200
        want[i] = (bytes(b for b, g in zip(data, gone) if not g), text is None, any(gone))
    assert any(changed for *_, changed in want.values())
    for i, text in cut:
        assert (text is None) == want[i][1] and ((text or "").encode() == want[i][0] or "ü" in (text or ""))

    items = [(r["item_id"], tiling.word_hashes(r["text"].encode()).tolist()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def leaks(text):
        words = tiling.word_hashes((text or "").encode()).tolist()
        return any(item and sum(n for *_, n in tiling.tiles(item, words, tiling.LEAST)) >= tiling.THRESHOLD * len(item) for _, item in items)

    assert {i for i, _ in clean} == {i for i, t in cut if not leaks(t)} and not {i for i, _ in clean} & set(range(500, 504))

    path, pattern = tokenizer()
    merges = packing.encoding(bpe.vocabulary(path), pattern)
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in frames[names[-1]].collect()}
    for i, text in clean:
        ids = merges.encode_ordinary(text or "")
        assert found[i] == (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_run_gives_what_the_stages_give_and_takes_empty_tables(spark, folder, tmp_path):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and found.count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    path, pattern = tokenizer()
    empty = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert packing.pack(empty, path, pattern).count() == 0 and bpe.encode_documents(empty, path, pattern).count() == 0
