"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are sequences of normalised words (lower case, outer punctuation dropped).
Seeds of ``least`` words are indexed over all items; a document's windows are looked up in that index, and
for each item whose seeds could cover enough of it, tiles are laid: the longest common stretches found by
running Karp-Rabin hashes are marked first, shorter ones follow, no word of either side is used twice. The length
of the longest is found by halving, and each place of the text is looked at once for each length, so the work
does not grow with the number of equal seed pairs.
Coverage is the share of the item's words under tiles of ``least`` words or more, in any order, so reordered
passages count in full.

The index is broadcast in blocks of bounded size: the benchmark is cut into as many blocks as its measured
size asks for, and each block takes one pass over the documents. Documents are never shuffled.

Results for odd input: a null or empty text matches nothing; an item without words is never found; an item
of fewer than ``least`` words is one seed and has to occur whole; a null id is carried along; repeated rows
each give their own rows; extra columns are ignored by ``matches`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_rows, prepare, slices, stage, text_bytes

LEAST, THRESHOLD = 5, 0.5
#: UTF-8 bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 8 << 20
#: Words whose hashes a worker remembers.
WORDS = 250_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Words(dict):
    """Hash of each raw word after normalising; 0 for a word of punctuation only."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        core = word.decode("utf-8", "replace").lower().encode().strip(PUNCTUATION)
        found = self[word] = (xxhash.xxh64_intdigest(core) or 1) if core else 0
        return found


_WORDS = Words()


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of a text's normalised words, in order."""
    raw = text.split()
    found = np.fromiter(map(_WORDS.__getitem__, raw), dtype=np.uint64, count=len(raw))
    return found[found != 0]


INVERSE = pow(int(FACTOR), -1, 1 << 64)


class Running:
    """Karp-Rabin hashes of all windows of some words: one running sum gives those of every size."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        up, self.down = (np.full(n + 1, x, np.uint64) for x in (FACTOR, INVERSE))
        up[0] = self.down[0] = 1
        up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(self.down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * up[:n], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        """Hash of the window of ``size`` words at each place."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` words."""
    return Running(words).windows(size)


class _Side:
    """One of the two sequences, with the words that tiles have taken."""

    def __init__(self, words: np.ndarray):
        self.words, self.running, self.used = words, Running(words), np.zeros(len(words), bool)

    def free(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows without a taken word, and their hashes."""
        taken = np.concatenate([[0], np.cumsum(self.used)])
        at = np.flatnonzero(taken[size:] == taken[: len(taken) - size]) if size < len(taken) else np.zeros(0, np.int64)
        return at, self.running.windows(size)[at]


def tiles(item: np.ndarray | list[int], text: np.ndarray | list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (start in item, start in text, length), longest first, then by item and text."""
    one, two = (_Side(np.asarray(x, dtype=np.uint64)) for x in (item, text))
    laid: list[tuple[int, int, int]] = []
    top = min(len(one.words), len(two.words))
    while top >= least:
        low, high = least - 1, top  # the longest common window has low words or more, and high at most
        while low < high:
            size = (low + high + 1) // 2
            if np.isin(one.free(size)[1], two.free(size)[1]).any():
                low = size
            else:
                high = size - 1
        if low < least:
            break
        _lay(one, two, low, laid)
        top = low - 1
    return laid


def _lay(one: _Side, two: _Side, size: int, laid: list[tuple[int, int, int]]) -> None:
    """Mark all tiles of this size: each free window of the item takes the first free one of the text that equals it."""
    at, hashes = two.free(size)
    order = np.argsort(hashes, kind="stable")
    at, hashes = at[order], hashes[order]
    own, wanted = one.free(size)
    firsts, lasts = np.searchsorted(hashes, wanted, "left").tolist(), np.searchsorted(hashes, wanted, "right").tolist()
    next_of: dict[int, int] = {}  # marks only grow: a window that is taken once is never looked at again
    end = 0
    for i, first, last in zip(own.tolist(), firsts, lasts, strict=True):
        if i < end or first == last:
            continue
        place = next_of.get(first, first)
        while place < last:
            t = int(at[place])
            if not two.used[t : t + size].any() and np.array_equal(one.words[i : i + size], two.words[t : t + size]):
                break
            place += 1
        next_of[first] = place
        if place < last:
            one.used[i : i + size] = two.used[t : t + size] = True
            laid.append((i, t, size))
            end = i + size


class Matcher:
    """Items of one block with their seed index."""

    def __init__(self, items: list[tuple[int, str]], least: int, threshold: float):
        self.least, self.threshold = least, threshold
        self.items = [(item_id, word_hashes(text_bytes(text))) for item_id, text in items]
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[int]] = {}
        for place, (_, words) in enumerate(self.items):
            if len(words):
                by_size.setdefault(min(least, len(words)), []).append(place)
        for size, places in by_size.items():
            seeds = [windows(self.items[p][1], size) for p in places]
            hashes = np.concatenate(seeds)
            owner = np.repeat(np.array(places), [len(s) for s in seeds])
            start = np.concatenate([np.arange(len(s)) for s in seeds])
            order = np.argsort(hashes, kind="stable")
            quick = np.zeros(1 << 20, dtype=bool)
            quick[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.index[size] = hashes[order], owner[order], start[order], quick

    def matches(self, text: bytes) -> list[tuple[int, float, list[tuple[int, int, int]]]]:
        """Place of each item covered by the threshold or more, its coverage and its tiles."""
        words = word_hashes(text)
        out = []
        for size, (hashes, owner, start, quick) in self.index.items():
            found = windows(words, size)
            at = np.flatnonzero(quick[(found >> np.uint64(44)).astype(np.int64)])
            if not len(at):
                continue
            asked = np.unique(found[at])
            low = np.searchsorted(hashes, asked, "left")
            counts = np.searchsorted(hashes, asked, "right") - low
            if not counts.any():
                continue
            places = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            places = places[np.argsort(owner[places], kind="stable")]  # each seed of an item once, however often the text has it
            item = owner[places]
            for own in np.split(places, np.flatnonzero(np.diff(item)) + 1):
                place = int(owner[own[0]])
                target = self.items[place][1]
                covered = np.zeros(len(target), dtype=bool)
                for i in range(size):
                    covered[start[own] + i] = True
                if covered.sum() < self.threshold * len(target):
                    continue
                seeds = at[np.isin(found[at], hashes[own])]
                mark = np.zeros(len(words) + 1, np.int32)  # words under a seed
                np.add.at(mark, seeds, 1)
                np.add.at(mark, seeds + size, -1)
                near = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                cuts = np.flatnonzero(np.diff(near) > 1) + 1
                apart = np.insert(words[near], cuts, 0)  # 0 is no word: runs that are apart stay apart
                names = np.insert(near, cuts, -1)
                laid = tiles(target, apart, size)
                share = sum(n for _, _, n in laid) / len(target)
                if share >= self.threshold:
                    out.append((place, share, [(i, int(names[t]), n) for i, t, n in laid]))
        return sorted(out)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about ``limit`` bytes, by a hash of the item's id and text."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    count = -(-total // limit)
    for block in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == block)
        yield [(r["item"], r["text"]) for r in part.collect()]


_TILES = "array<struct<item_start:int,doc_start:int,length:int>>"


def matches(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it contains: ids, coverage, tiles (in words)."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    schema = f"`{id_col}` long, `{item_col}` long, coverage double, n_tiles int, tiles {_TILES}"
    kind = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))
    found = None
    for items in blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, least, threshold)
            for part in slices(batches):
                out: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for place, share, laid in matcher.matches(text_bytes(text)):
                        out.append((doc, matcher.items[place][0], share, len(laid), [{"item_start": a, "doc_start": b, "length": n} for a, b, n in laid]))
                columns = list(zip(*out, strict=True)) if out else [()] * 5
                types = pa.int64(), pa.int64(), pa.float64(), pa.int32(), kind
                arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, item_col, "coverage", "n_tiles", "tiles"])
            _WORDS.clear()

        now = rows.mapInArrow(stage(run), schema)
        found = now if found is None else found.union(now)
    return found if found is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text covers no benchmark item by the threshold or more."""
    spark = docs.sparkSession
    prepare(spark)
    at = docs.columns.index(text_col)
    kept = docs
    for items in blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, least, threshold)
            for part in slices(batches, at):
                clean = [not matcher.matches(text_bytes(text)) for text in part.column(at).to_pylist()]
                yield part.filter(pa.array(clean, pa.bool_()))
            _WORDS.clear()

        kept = over_rows(kept, run)
    return kept
