"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

A word's class is a leaf of two digits made from its form (length up to four, last three bytes); inside a leaf the
``DIGITS - 1`` words that training texts hold most often have a digit of their own, and all others share one:

    P(word | history) = P(first digit | history) * P(second digit | first digit, history)
                        * P(third digit | leaf, history) [* P(word | leaf, tail) for a word of the shared digit]

The three factors with a history are softmax layers. Features of the first are the last word, the word before it
(a skip feature) and both as a pair, each hashed to a row of a table whose size grows with the training text; of the
second and third the last word under each first digit or leaf. Only the tail of rare words, and the base score, are
smoothed counts over the whole training text, with one place for all unknown words; the layers start from the
same counts, so that training begins at the unigram model.

Training is by distributed gradient updates: in each pass every task takes its training texts through minibatch
steps from the shared weights, and the weights are averaged row by row, by how often a row was used. Every training
text is used in every pass. Words are 54-bit hashes of their bytes beside the ten bits of their leaf, computed for whole
batches in numpy. Counts are joined back without any bound on the vocabulary: each task numbers the distinct
words of some million tokens (a bucket) and writes texts as counts of those numbers; the words meet their counts
in a join, and scoring streams a bucket's texts past its own counts. Texts are never shuffled.

Results for odd input: a null text is the empty text (one end token); a null id counts as training text;
repeated rows are texts of their own; without training text every word is unknown; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, saved, slices, stage, text_bytes

DIGITS = 32
#: Tokens in a gradient step of the first layer, and of the others (which count a batch before they step).
BATCH, WIDE_BATCH = 8_192, 262_144
#: Step of each pass over the training texts, and the count at which half of a row's mean gradient is taken.
STEPS, SHRINK = (3.0, 1.0), 10
#: Rows of a word feature's table in the first layer: one for so many training tokens, from the least to the most.
TOKENS_PER_ROW, LEAST_ROWS, MOST_ROWS = 20_000, 4096, 16_384
#: Rows of the last word under each first digit, and under each leaf.
FINE_ROWS, WORD_ROWS = 256, 16
LEAVES = 1023  # mask of a leaf's bits
#: Tokens after which a task begins another bucket; bytes that are hashed at a time.
BUCKET_TOKENS, CHUNK_BYTES = 2_000_000, 1 << 18
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
MIX, BASE = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


# --- words -------------------------------------------------------------------------------------------


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words and the end."""
    return [*text.lower().split(), b""]


def code_of(word: bytes) -> int:
    """A word's 64-bit code: leaf in the lowest ten bits, hash in the others. The empty word is the end."""
    return int(_codes(np.frombuffer(word + b" ", np.uint8), np.array([0]), np.array([len(word)]), word)[0])


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n and more of the base and of its inverse; n is a chunk's length at most."""
    if n >= len(_POWERS[0]):
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n + 1 + n // 4, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def _codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: bytes) -> np.ndarray:
    """Codes of the words that stand from ``starts`` to before ``ends`` in ``data`` (``raw`` as bytes)."""
    size = ends - starts
    long = np.flatnonzero(size > LONG_WORD)
    if len(long) == len(size) and len(long):
        found = np.zeros(len(size), np.uint64)
    else:
        up, down = _powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= up[: len(data)]
        np.cumsum(terms, out=sums[1:])
        found = (sums[ends] - sums[starts]) * down[starts] + size.astype(np.uint64) * MIX
        found = (found ^ (found >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        found = (found ^ (found >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        found ^= found >> np.uint64(32)
    for i in long.tolist():
        found[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    last = [np.where(size > k, data[np.maximum(ends - 1 - k, 0)], 0).astype(np.uint64) for k in range(3)]
    first = (last[0] << np.uint64(10) | last[1] << np.uint64(2) | np.minimum(size, 3).astype(np.uint64)) * MIX
    form = last[0] << np.uint64(20) | last[1] << np.uint64(12) | last[2] << np.uint64(4) | np.minimum(size, 4).astype(np.uint64)
    second = (form + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    leaf = (first >> np.uint64(59)) << np.uint64(5) | second >> np.uint64(59)
    return found >> np.uint64(10) << np.uint64(10) | leaf


def _chunks(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``CHUNK_BYTES`` bytes that end where a word ends."""
    at = 0
    while len(text) - at > 2 * CHUNK_BYTES:
        stop = _SPACE.search(text, at + CHUNK_BYTES)
        end = stop.start() if stop else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def encoded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all tokens of some texts, and where each text begins."""
    out: list[np.ndarray] = []
    starts: list[int] = []
    total = 0
    end_code = np.array([END_CODE], np.uint64)

    def flush(group: list[bytes]) -> None:
        """Words of some short texts, each with its end."""
        nonlocal total
        raw = b"\n".join(group) + b"\n"
        words, at = _words(raw)
        ends = np.cumsum([len(t) + 1 for t in group])
        owner = np.searchsorted(ends, at, "right")
        codes = np.full(len(words) + len(group), END_CODE, np.uint64)
        codes[np.arange(len(words)) + owner] = words
        counts = np.bincount(owner, minlength=len(group)) + 1
        starts.extend((total + np.cumsum(counts) - counts).tolist())
        total += len(codes)
        out.append(codes)

    group, size = [], 0
    for text in texts:
        text = text.lower()
        if len(text) > 2 * CHUNK_BYTES:
            if group:
                flush(group)
                group, size = [], 0
            starts.append(total)
            for piece in _chunks(text):
                words, _ = _words(piece + b"\n")
                out.append(words)
                total += len(words)
            out.append(end_code)
            total += 1
            continue
        group.append(text)
        size += len(text)
        if size >= CHUNK_BYTES:
            flush(group)
            group, size = [], 0
    if group:
        flush(group)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(starts, np.int64)


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of lower-cased text that ends in a space, and where each begins."""
    data = np.frombuffer(raw, np.uint8)
    space = np.ones(len(data) + 1, bool)
    space[1:] = (data == 32) | ((data >= 9) & (data <= 13))
    turns = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turns[::2], turns[1::2]
    return _codes(data, starts, ends, raw), starts


END_CODE = code_of(b"")


# --- model -------------------------------------------------------------------------------------------


class Frequent(NamedTuple):
    """The words with a digit of their own in their leaf: codes in order, and digits (0 is the tail)."""

    codes: np.ndarray
    digits: np.ndarray

    def digit(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.digits[at], 0)


NO_WORDS = Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64))


def rows_for(train_tokens: int) -> int:
    """Rows of a word feature's table, a power of two."""
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << (max(1, train_tokens // TOKENS_PER_ROW) - 1).bit_length()))


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


class Model:
    """Weights of the three layers: a row of ``DIGITS`` numbers for each hashed feature."""

    def __init__(self, tables: list[np.ndarray] | None = None, rows: int = LEAST_ROWS, frequent: Frequent = NO_WORDS, pace: float = STEPS[0]):
        leaves = DIGITS * DIGITS
        sizes = [1, rows, rows, rows, DIGITS, DIGITS * FINE_ROWS, leaves, leaves * WORD_ROWS]
        self.tables = [t.copy() for t in tables] if tables else [np.zeros((n, DIGITS), np.float32) for n in sizes]
        self.used = [np.zeros(len(t), np.float32) for t in self.tables]
        self.frequent, self.pace = frequent, pace
        self.space = np.zeros((2, BATCH, DIGITS), np.float32)
        self.places = np.arange(BATCH) * DIGITS
        self.shift = np.uint64(64 - (len(self.tables[1]).bit_length() - 1))

    def features(self, codes: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the first layer's features, row of the second's and third's, leaf, and third digit of every token."""
        one = np.empty_like(codes)
        two = np.zeros_like(codes)
        one[:1], one[1:] = 0, codes[:-1]
        two[2:] = codes[:-2]
        one[starts] = two[starts] = 0
        second = starts[starts + 1 < len(codes)] + 1
        two[second] = 0
        rows = [(x * MIX >> self.shift).astype(np.uint16) for x in (one, two ^ np.uint64(0xABCDEF), one * np.uint64(31) + two)]
        return rows, rows[0], (codes & np.uint64(LEAVES)).astype(np.int64), self.frequent.digit(codes)

    def wide(self, rows: list[np.ndarray], target: np.ndarray, learn: bool) -> np.ndarray:
        """The first layer: natural log of the probability of each target digit; a gradient step on the way."""
        n = len(target)
        logits, other = self.space[0][:n], self.space[1][:n]
        np.take(self.tables[1], rows[0], axis=0, out=logits, mode="clip")
        for t, r in zip((2, 3), rows[1:], strict=True):
            np.take(self.tables[t], r, axis=0, out=other, mode="clip")
            logits += other
        logits += self.tables[0] - self.tables[0].max()
        np.minimum(logits, 60, out=logits)  # no weight comes near it; exp must not overflow
        at = self.places[:n] + target
        own = logits.ravel()[at]
        np.exp(logits, out=logits)
        total = logits.sum(axis=1)
        out = own - np.log(total)
        if learn:
            grad = logits
            grad *= (-1 / total)[:, None]
            grad.ravel()[at] += 1
            self.tables[0][0] += self.pace * grad.sum(axis=0) / (n + SHRINK)
            self.used[0][0] += n
            for t, r in zip((1, 2, 3), rows, strict=True):
                order = np.argsort(r, kind="stable")  # 16-bit keys: a radix sort
                ordered = r[order]
                cuts = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
                counts = np.diff(np.append(cuts, n)).astype(np.float32)
                hit = ordered[cuts]
                np.take(grad, order, axis=0, out=other, mode="clip")
                sums = np.add.reduceat(other, cuts, axis=0)
                sums *= (self.pace / (counts + SHRINK))[:, None]
                self.tables[t][hit] += sums
                self.used[t][hit] += counts
        return out

    def narrow(self, low: int, high: int) -> np.ndarray:
        """Log probabilities for each row of table ``high``, whose rows lie in equal parts under those of table ``low``."""
        under = len(self.tables[high]) // len(self.tables[low])
        return _softmax(self.tables[high] + np.repeat(self.tables[low], under, axis=0))

    def step(self, low: int, high: int, rows: np.ndarray, target: np.ndarray) -> None:
        """A gradient step of the second or third layer over the counts of a batch."""
        size = len(self.tables[high])
        counts = np.bincount(rows * DIGITS + target, minlength=size * DIGITS).reshape(size, DIGITS).astype(np.float32)
        n = counts.sum(axis=1)
        grad = counts - n[:, None] * np.exp(self.narrow(low, high))
        for table, g, m in ((high, grad, n), (low, *(x.reshape(len(self.tables[low]), -1, *x.shape[1:]).sum(axis=1) for x in (grad, n)))):
            self.tables[table] += self.pace * g / (m + SHRINK)[:, None]
            self.used[table] += m

    def run(self, codes: np.ndarray, starts: np.ndarray, learn: bool) -> np.ndarray:
        """Log10 probability of each token's three digits."""
        out = np.zeros(len(codes))
        rows, last, leaf, word = self.features(codes, starts)
        last = last.astype(np.int64)
        coarse, fine = leaf // DIGITS, leaf % DIGITS
        fine_row, word_row = coarse * FINE_ROWS + last % FINE_ROWS, leaf * WORD_ROWS + last % WORD_ROWS
        for a in range(0, len(codes), BATCH):
            part = slice(a, a + BATCH)
            out[part] = self.wide([r[part] for r in rows], coarse[part], learn)
        for a in range(0, len(codes) if learn else 0, WIDE_BATCH):
            part = slice(a, a + WIDE_BATCH)
            self.step(4, 5, fine_row[part], fine[part])
            self.step(6, 7, word_row[part], word[part])
        if not learn:
            out += self.narrow(4, 5)[fine_row, fine]
            out += self.narrow(6, 7)[word_row, word]
        return out / np.log(10)


def unigram(leaf_n: np.ndarray, leaf_v: np.ndarray, words: np.ndarray, word_n: np.ndarray, frequent: Frequent, rows: int) -> list[np.ndarray]:
    """Weights at which the model is the smoothed unigram model: counts and kinds of each leaf, and the frequent words' counts."""
    model = Model(rows=rows)
    mass = (leaf_n + 0.5 * (leaf_v + 1)).reshape(DIGITS, DIGITS)
    model.tables[0][0] = np.log(mass.sum(axis=1))
    model.tables[4][:] = np.log(mass)
    inner = np.zeros((DIGITS * DIGITS, DIGITS))
    inner[(words & np.uint64(LEAVES)).astype(np.int64), frequent.digit(words)] = word_n + 0.5
    inner[:, 0] = mass.ravel() - inner[:, 1:].sum(axis=1)
    model.tables[6][:] = np.log(np.maximum(inner, 1e-6))
    return model.tables


# --- the operator ------------------------------------------------------------------------------------


def train(texts: DataFrame, tables: list[np.ndarray], frequent: Frequent = NO_WORDS, steps: tuple[float, ...] = STEPS) -> list[np.ndarray]:
    """Weights from the texts (column ``text``), each of which takes part in every pass."""
    spark = texts.sparkSession
    for pace in steps:
        shared = spark.sparkContext.broadcast((tables, frequent))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, pace=pace) -> Iterator[pa.RecordBatch]:
            model = Model(shared.value[0], frequent=shared.value[1], pace=pace)
            for part in slices(batches, 0, 2 << 20):
                codes, starts = encoded([text_bytes(t) for t in part.column(0).to_pylist()])
                model.run(codes, starts, True)
            names, counts, weights = [], [], []
            for k, (table, used) in enumerate(zip(model.tables, model.used, strict=True)):
                for start in range(0, len(table), 1024):
                    own = used[start : start + 1024]
                    if own.any():
                        names.append(k << 32 | start)
                        counts.append(own.tobytes())
                        weights.append(table[start : start + 1024].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(counts, pa.binary()), pa.array(weights, pa.binary())], names=["block", "used", "weights"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for block, used, weights in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    count = np.frombuffer(used, np.float32)[:, None].astype(np.float64)
                    value = np.frombuffer(weights, np.float16).reshape(-1, DIGITS) * count
                    if block in sums:
                        sums[block][0] += count
                        sums[block][1] += value
                    else:
                        sums[block] = [count.copy(), value]
            blocks = sorted(sums)
            data = [(sums[b][1] / np.maximum(sums[b][0], 1)).astype(np.float32).tobytes() for b in blocks]
            hits = [(sums[b][0] > 0).astype(np.uint8).tobytes() for b in blocks]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(data, pa.binary()), pa.array(hits, pa.binary())], names=["block", "weights", "hit"])

        steps = texts.select("text").mapInArrow(stage(run), "block long, used binary, weights binary")
        means = steps.repartition("block").mapInArrow(stage(average), "block long, weights binary, hit binary").collect()  # the size of the model
        tables = [t.copy() for t in tables]
        for row in means:
            k, start = row["block"] >> 32, row["block"] & 0xFFFFFFFF
            hit = np.frombuffer(row["hit"], np.uint8)[: len(tables[k]) - start].astype(bool)
            fresh = np.frombuffer(row["weights"], np.float32).reshape(-1, DIGITS)
            tables[k][start : start + len(fresh)][hit] = fresh[hit]
        shared.unpersist()
    return tables


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def word_counts(texts: DataFrame) -> DataFrame:
    """``code`` and ``c``, how often all texts (column ``text``) hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

        for part in slices(batches, 0, 2 << 20):
            held.append(encoded([text_bytes(t) for t in part.column(0).to_pylist()])[0])
            size += len(held[-1])
            if size >= BUCKET_TOKENS:
                yield from counted()
                held, size = [], 0
        if held:
            yield from counted()

    return texts.select("text").mapInArrow(stage(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("c"))


_ENTRY = "bucket long, kind int, a long, b long, flag boolean, model double, steps binary, counts binary"
_ENTRY_KINDS = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.binary(), pa.binary()
_ENTRY_NAMES = [c.split()[0] for c in _ENTRY.split(", ")]


def _entries(columns: dict[str, object], n: int) -> pa.RecordBatch:
    arrays = []
    for name, kind in zip(_ENTRY_NAMES, _ENTRY_KINDS, strict=True):
        value = columns.get(name)
        arrays.append(pa.nulls(n, kind) if value is None else value if isinstance(value, pa.Array) else pa.array(value, kind))
    return pa.RecordBatch.from_arrays(arrays, names=_ENTRY_NAMES)


def _packed(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Little-endian unsigned 32-bit numbers as one binary for each of ``n`` owners (in order)."""
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(4 * np.bincount(owner, minlength=n), out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.astype("<u4").tobytes())])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each text."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("held", held_out(F.col("id")))
    learnt = rows.where("not held").select("text")
    counted = saved(word_counts(learnt))
    leaf = F.col("code").bitwiseAND(LEAVES)
    sums = counted.groupBy(leaf.alias("leaf")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # a row for each leaf
    totals = np.zeros((LEAVES + 1, 2))
    for row in sums:
        totals[row["leaf"]] = row["n"], row["v"]
    train_n, kinds = int(totals[:, 0].sum()), int(totals[:, 1].sum())
    place = F.row_number().over(Window.partitionBy("leaf").orderBy(F.col("c").desc(), "code"))
    best = counted.withColumn("leaf", leaf).withColumn("digit", place).where(F.col("digit") < DIGITS).select("code", "digit", "c").collect()  # DIGITS - 1 for each leaf
    best.sort(key=lambda r: r["code"] & (1 << 64) - 1)
    words = np.array([r["code"] for r in best], np.int64).view(np.uint64)
    frequent = Frequent(words, np.array([r["digit"] for r in best], np.int64))
    word_n = np.array([r["c"] for r in best], np.float64)
    weights = unigram(totals[:, 0], totals[:, 1], words, word_n, frequent, rows_for(train_n))
    weights = train(learnt, weights, frequent)
    shared = spark.sparkContext.broadcast((weights, frequent))
    leaf_of = (words & np.uint64(LEAVES)).astype(np.int64)
    tails = totals - np.stack([np.bincount(leaf_of, word_n, LEAVES + 1), np.bincount(leaf_of, minlength=LEAVES + 1)], axis=1)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text as counts of numbered words, with the model's part of its score; then the numbered words."""
        from pyspark import TaskContext

        model, bucket = Model(shared.value[0], frequent=shared.value[1]), TaskContext.get().partitionId() << 20
        held: list[tuple] = []
        size = 0

        def written() -> Iterator[pa.RecordBatch]:
            codes, owner = np.concatenate([h[0] for h in held]), np.repeat(np.arange(sum(len(h[1]) for h in held)), np.concatenate([h[1] for h in held]))
            known, number = np.unique(codes, return_inverse=True)
            del codes
            for start in range(0, len(known), 100_000):
                part = known[start : start + 100_000].view(np.int64)
                yield _entries({"bucket": np.full(len(part), bucket), "kind": np.zeros(len(part), np.int32), "a": np.arange(start, start + len(part)), "b": part}, len(part))
            pairs, times = np.unique(owner << 32 | number, return_counts=True)
            own, number = pairs >> 32, pairs & 0xFFFFFFFF
            first = np.ones(len(own), bool)
            first[1:] = own[1:] != own[:-1]
            steps = np.diff(number, prepend=0)
            steps[first] = number[first]
            at = 0
            for _, sizes, ids, flags, found in held:
                n = len(sizes)
                a, b = np.searchsorted(own, [at, at + n])
                yield _entries({"bucket": np.full(n, bucket), "kind": np.ones(n, np.int32), "a": ids, "b": sizes, "flag": flags, "model": found, "steps": _packed(steps[a:b], own[a:b] - at, n), "counts": _packed(times[a:b], own[a:b] - at, n)}, n)
                at += n

        for part in slices(batches, 1, 2 << 20):
            codes, starts = encoded([text_bytes(t) for t in part.column(1).to_pylist()])
            found = np.add.reduceat(model.run(codes, starts, False), starts)
            held.append((codes, np.diff(np.append(starts, len(codes))), part.column(0), part.column(2), found))
            size += len(codes)
            if size >= bucket_tokens:
                yield from written()
                held, size, bucket = [], 0, bucket + 1
        if held:
            yield from written()

    gathered = saved(rows.select("id", "text", "held").mapInArrow(stage(gather), _ENTRY))
    rest = [F.lit(None).cast(k).alias(c) for c, k in (("flag", "boolean"), ("model", "double"), ("steps", "binary"), ("counts", "binary"))]
    named = gathered.where("kind = 0").select("bucket", "kind", "a", F.col("b").alias("code"))
    entries = named.join(counted, "code", "left").select("bucket", "kind", "a", F.coalesce("c", F.lit(0)).alias("b"), F.col("code").alias("word"), *rest)
    texts = gathered.where("kind = 1").select("bucket", "kind", "a", "b", F.lit(None).cast("long").alias("word"), "flag", "model", "steps", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tables = None, [], None
        own_digit = shared.value[1]
        for part in slices(batches, 7):
            buckets, kinds_ = part.column(0).to_numpy(), part.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(buckets) != 0) | (np.diff(kinds_) != 0)) + 1, [len(buckets)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = part.slice(a, b - a)
                if int(buckets[a]) != now:
                    now, held, tables = int(buckets[a]), [], None
                if kinds_[a] == 0:
                    held.append([own.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)])
                    continue
                if tables is None:
                    place, c, word = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(place)
                    c, word, held = c[order].astype(np.float64), word[order].view(np.uint64), []
                    base = np.log10((c + 0.5) / (train_n + 0.5 * (kinds + 1)))
                    leaf = (word & np.uint64(LEAVES)).astype(np.int64)
                    inner = np.log10((c + 0.5) / (tails[leaf, 0] + 0.5 * (tails[leaf, 1] + 1)))
                    inner[own_digit.digit(word) > 0] = 0  # the third layer has these words
                    tables = base, inner, (c > 0).astype(np.float64)
                steps, counts = own.column(7).to_pylist(), own.column(8).to_pylist()
                sizes = np.array([len(x) // 4 for x in steps])
                starts = np.cumsum(sizes) - sizes
                at = np.cumsum(np.frombuffer(b"".join(steps), "<u4").astype(np.int64))
                at -= np.repeat(np.append(0, at[starts[1:] - 1]), sizes)
                times = np.frombuffer(b"".join(counts), "<u4").astype(np.float64)
                base, inner, known = (np.add.reduceat(t[at] * times, starts) for t in tables)
                model = own.column(6).to_numpy(zero_copy_only=False)
                arrays = [own.column(2), own.column(5), own.column(3), pa.array(np.rint(known).astype(np.int64)), pa.array(np.full(b - a, train_n), pa.int64()), pa.array(base), pa.array(model + inner)]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return entries.union(texts).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(stage(run), schema)
