"""Removal of repeated byte strings with suffix arrays built by linear grouping.

``suffix_array`` sorts suffixes in two phases: groups of suffixes that share a Lyndon prefix are processed
in descending order, each splitting the groups of its members' previous-smaller suffixes by how often they
are pointed at; then every group's order is emitted from left to right along the same pointers, without
recursion and without renaming.

``remove_repeats`` finds every byte of a text that is covered by a string of ``window`` bytes which also starts
anywhere else. A suffix array over a corpus cannot be split over tasks, so the texts are cut into places where a
repeat is possible, and suffix arrays are built over those only:

1. Anchors: of the ``gram``-byte hashes inside each window the least is an anchor. Equal windows have the same
   anchor at the same place, so a repeated window has an anchor that occurs again.
2. Anchors that occur once are dropped. The context of an anchor is all bytes that a window around it can
   cover; equal contexts (compared by hash) are repeats as a whole.
3. For the rest, the window places around an anchor are dealt into ``parts`` ranges. The bytes that all
   windows of a range share are its core; contexts of equal core make a group, each written as the bytes left
   of the core, one symbol for the core, and the bytes right of it. Bytes that no two contexts of the group tell
   apart are one symbol, and a context that shares less than a window with any other is left out. Suffix array and
   common prefixes over the group tell which windows occur twice. A group of more than ``largest`` contexts is split
   by its next symbols: its range is cut into narrow ones, whose cores are longer by the bytes next to the old core,
   and their groups go through suffix arrays in turn. Where even these are too large, ranges of one place are left,
   whose cores are whole windows: they are equal, and counting them is all there is to do.

Every count has map-side combine, and joins are on keys that AQE may split. Texts are keyed by a 128-bit
hash, so copies share one key and ids may repeat or be null.

Results for odd input: a null text is an empty one; texts shorter than the window lose nothing; repeated rows
are copies of each other; extra columns are ignored by ``remove_repeats`` and kept by ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, prepare, saved, slices, stage, text_bytes

WINDOW, GRAM, PARTS, LARGEST = 200, 100, 4, 4096
#: Width of the ranges that a large group is cut into, and shares of a context's places that are counted apart.
NARROW, SHARES = 6, 64
#: Pieces in one suffix array, about; a larger group has its own.
BATCH_PIECES = 4096
#: Bytes that are hashed at a time; a longer text is cut into strips that overlap.
STRIP_BYTES = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


# --- suffix arrays -----------------------------------------------------------------------------------


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a sequence of integers (an end marker is implied)."""
    n = len(text) + 1
    if n == 1:
        return []
    low = min(text)
    buckets: list[list[int]] = [[] for _ in range(max(text) - low + 1)]
    for i, symbol in enumerate(text):
        buckets[symbol - low].append(i)
    sa = [n - 1]
    for own in buckets:
        sa += own
    place = [0] * n  # where each suffix stands in sa
    group = [0] * n  # start of its group in sa, which orders the groups
    size = [0] * n  # members of the group that starts here
    size[0] = 1
    start, last = 0, None
    for at in range(1, n):
        i = sa[at]
        place[i] = at
        if text[i] != last:
            start, last = at, text[i]
        group[i] = start
        size[start] += 1
    before = [-1] * n  # previous smaller suffix
    end = n
    while end > 1:
        start = group[sa[end - 1]]
        if end - start == 1:
            i = sa[start]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                # one suffix points at j: it becomes the last of its group, on its own
                head = group[j]
                count = size[head]
                if count > 1:
                    to = head + count - 1
                    other, at = sa[to], place[j]
                    sa[at], place[other] = other, at
                    sa[to], place[j] = j, to
                    size[head] = count - 1
                    size[to] = 1
                    group[j] = to
        else:
            pointed: dict[int, int] = {}
            for i in sorted(sa[start:end]):
                j = i - 1
                while j >= 0 and group[j] >= start:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            by_count: dict[int, list[int]] = {}
            for j, count in pointed.items():
                by_count.setdefault(count, []).append(j)
            for count in sorted(by_count, reverse=True):
                heads: dict[int, list[int]] = {}
                for j in by_count[count]:
                    heads.setdefault(group[j], []).append(j)
                for head, members in heads.items():
                    to = head + size[head]
                    for j in members:  # to the end of the group
                        to -= 1
                        other, at = sa[to], place[j]
                        sa[at], place[other] = other, at
                        sa[to], place[j] = j, to
                    if to > head:
                        size[head] -= len(members)
                        size[to] = len(members)
                        for j in members:
                            group[j] = to
        end = start
    free = list(range(n))  # next free place of each group
    done = bytearray(n)
    done[n - 1] = 1
    sa[0] = n - 1
    for at in range(n):
        j = sa[at] - 1
        while j >= 0 and not done[j]:
            head = group[j]
            sa[free[head]] = j
            free[head] += 1
            done[j] = 1
            j = before[j]
    return sa[1:]


def common_prefixes(text: list[int], sa: list[int]) -> list[int]:
    """Length of the common prefix of each suffix in the array with the one before it."""
    n = len(text)
    rank, out, h = [0] * n, [0] * n, 0
    for at, i in enumerate(sa):
        rank[i] = at
    for i in range(n):
        at = rank[i]
        if at:
            j = sa[at - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[at] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


class Sides(NamedTuple):
    """The distinct bytes on one side of the cores: number of each piece's, and by number (group for group, in order) their sizes and the prefix that each shares with the one before it (-1: another group)."""

    number: np.ndarray
    sizes: np.ndarray
    shared: np.ndarray


def sides(group: np.ndarray, column: pa.Array, back: bool) -> Sides:
    """The bytes of ``column``, read away from the core (``back``: from their end), numbered by group and order."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    sizes = np.diff(ends)
    reach = np.arange(max(8, -(-int(sizes.max()) // 8) * 8))
    inside = reach < sizes[:, None]
    text = np.zeros(inside.shape, np.uint8)
    text[inside] = data[(ends[1:, None] - 1 - reach if back else ends[:-1, None] + reach)[inside]]
    order = np.lexsort((sizes, *text.view(">u8").astype(np.uint64).T[::-1], group))
    text, size, of = text[order], sizes[order], group[order]
    equal = text[1:] == text[:-1]
    common = np.where(equal.all(axis=1), len(reach), equal.argmin(axis=1))
    common = np.where(of[1:] == of[:-1], np.minimum(common, np.minimum(size[1:], size[:-1])), -1)
    new = np.ones(len(order), bool)
    new[1:] = (common < size[1:]) | (size[1:] != size[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return Sides(number, size[new], common[new[1:]])


def branches(side: Sides, count: np.ndarray) -> np.ndarray:
    """A symbol for each side and depth where it parts from others that it shared all bytes with up to there; else -1.

    ``count``: how many sequences have this side. Sides that share a prefix have its symbol in common, and no others.
    """
    n = len(side.sizes)
    deepest = int(side.sizes.max())
    out = np.full((n, deepest), -1, np.int64)
    for depth in range(1, deepest + 2):
        new = np.ones(n, bool)
        new[1:] = side.shared < depth
        first = np.flatnonzero(new)
        own = np.cumsum(new) - 1
        here = np.add.reduceat(count, first)[own]
        here[side.sizes < depth] = 0
        if depth > 1:
            ends = (before > 1) & (here < before)
            out[ends, depth - 2] = symbol[ends]
        if here.max() < 2:
            break
        before, symbol = here, first[own] + depth * n
    return out


def repeated_starts(group: np.ndarray, width: np.ndarray, before: pa.Array, after: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where windows begin that occur twice or more among the pieces of a group, from one suffix array over all of them.

    Pieces are bytes left of a core, the core, and ``width`` bytes at most right of it; a window has the core and ``width``
    bytes. Returns the sequence of each piece (equal pieces are one), and runs of starts: sequence, first, last.
    Bytes that no two sequences of a group tell apart are one symbol: a sequence is written as the places left
    of the core where others part from it, the core, and such places right of it. Common prefixes end at such places only.
    """
    lefts, rights = sides(group, before, True), sides(group, after, False)
    both, one, sequence, times = np.unique(lefts.number * len(rights.sizes) + rights.number, return_index=True, return_inverse=True, return_counts=True)
    left, right = both // len(rights.sizes), both % len(rights.sizes)
    width, size = width[one], lefts.sizes[left]
    slack = size + rights.sizes[right] - width
    whole = np.flatnonzero((times > 1) & (slack >= 0))
    found = [(whole, np.zeros(len(whole), np.int64), slack[whole])]
    marks_l, marks_r = (branches(s, np.bincount(k, minlength=len(s.sizes))) for s, k in ((lefts, left), (rights, right)))
    nl, nr = marks_l.shape[1], marks_r.shape[1]
    most = [((m >= 0) * np.arange(1, m.shape[1] + 1)).max(axis=1, initial=0) for m in (marks_l, marks_r)]
    kept = np.flatnonzero(most[0][left] + most[1][right] >= width)  # the others share less than a window with any
    if len(kept):
        symbols = np.empty((len(kept), nl + nr + 2), np.int64)
        symbols[:, :nl] = marks_l[left[kept], ::-1]
        symbols[:, nl] = group[one[kept]]
        symbols[:, nl + 1 : -1] = marks_r[right[kept]]
        symbols[:, -1] = np.arange(len(kept))  # its own mark, so no common prefix goes beyond a sequence
        own, at = np.nonzero(symbols >= 0)
        kind = (at >= nl).astype(np.int64) + (at > nl) + (at > nl + nr)
        text = np.unique(symbols[own, at] * 4 + kind, return_inverse=True)[1].tolist()
        sa = suffix_array(text)
        shared = np.array([*common_prefixes(text, sa), 0])
        longest = np.zeros(len(text), np.int64)
        longest[sa] = np.maximum(shared[:-1], shared[1:])
        begin = np.flatnonzero((at <= nl) & (longest > 0))
        back, on = nl - at[begin], at[begin + longest[begin] - 1] - nl  # bytes left and right of the core
        sequences = kept[own[begin]]
        ok = (on >= 0) & (back + on >= width[sequences])
        sequences, back, on = sequences[ok], back[ok], on[ok]
        found.append((sequences, size[sequences] - back, size[sequences] - np.maximum(0, width[sequences] - on)))
    of, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((first, of))
    of, first, last = of[order], first[order], last[order]
    far = int(size.max()) + 2
    until = np.maximum.accumulate(last + of * far)
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (first[1:] + of[1:] * far > until[:-1] + 1)
    end = np.append(new[1:], True)[: len(of)]
    return sequence, of[new], first[new], (until - of * far)[end]


# --- anchors -----------------------------------------------------------------------------------------


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n and more of the base and of its inverse, modulo 2 ** 64; n is some strips' length at most."""
    if n >= len(_POWERS[0]):
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(n + 1 + n // 4, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``size`` values, by doubling."""
    have = 1
    while have * 2 <= size:
        values = pick(values[:-have], values[have:])
        have *= 2
    return pick(values[: len(values) - (size - have)], values[size - have :]) if have < size else values


class Strip(NamedTuple):
    """Part of a text: its row, where the part begins in the text, its bytes, and which of its places are its own."""

    row: int
    offset: int
    data: bytes
    first: int
    last: int


def strips(texts: list[bytes], before: int, after: int, size: int = 0) -> Iterator[list[Strip]]:
    """All texts in strips of about ``size`` bytes in all; every place is one strip's own, with ``before`` and ``after`` bytes around it."""
    size = size or STRIP_BYTES
    held: list[Strip] = []
    total = 0
    for row, text in enumerate(texts):
        for at in range(0, len(text), size):
            end = min(len(text), at + size)
            a, b = max(0, at - before), min(len(text), end + after)
            held.append(Strip(row, a, text[a:b], at - a, end - a))
            total += b - a
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


class Hashed:
    """Some strips, one after the other, with hashes of any of their substrings."""

    def __init__(self, own: list[Strip]):
        sizes = np.array([len(s.data) for s in own], np.int64)
        self.bytes = b"".join([s.data for s in own])
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.rows, self.offsets, self.first, self.last = (np.array([s[i] for s in own], np.int64) for i in (0, 1, 3, 4))
        up, _ = powers(len(self.data))
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        terms = self.data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= up[: len(terms)]
        np.cumsum(terms, out=self.sums[1:])

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Hashes of the substrings from ``left`` to before ``right``."""
        return mixed((self.sums[right] - self.sums[left]) * powers(len(self.data))[1][left])

    def anchors(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all anchors that are their strip's own, and the strip of each."""
        n = len(self.data)
        if n < window:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = self.sums[gram:] - self.sums[:-gram]
        grams *= powers(n)[1][: n - gram + 1]
        grams = mixed(grams)
        near = window - gram + 1
        least = sliding(grams, near, np.minimum)  # for each window start
        for end in self.ends.tolist():  # windows over a border
            least[max(0, end - window + 1) : end] = 0
        padded = np.zeros(len(least) + 2 * (near - 1), np.uint64)
        padded[near - 1 : near - 1 + len(least)] = least
        best = sliding(padded, near, np.maximum)  # the highest least of the windows around each gram
        at = np.flatnonzero(best[: len(grams)] == grams)
        strip = np.searchsorted(self.ends, at, "right")
        local = at - self.starts[strip]
        own = (local >= self.first[strip]) & (local < self.last[strip])
        return at[own], strip[own]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with two longs ``k1`` and ``k2``, a hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(7), text)})


def anchors(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Anchors of each row: k1, k2, pos, hashes of gram and context, end of the context (relative to the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 1 << 20):
            for own in strips([text_bytes(t) for t in part.column(2).to_pylist()], window - gram, window):
                found = Hashed(own)
                at, strip = found.anchors(window, gram)
                left = np.maximum(found.starts[strip], at - (window - gram))
                right = np.minimum(found.ends[strip], at + window)
                context = found.of(left, right) + (at - left).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
                k1, k2 = (part.column(i).take(pa.array(found.rows[strip])) for i in (0, 1))
                base = found.starts[strip] - found.offsets[strip]
                arrays = [k1, k2, pa.array(at - base, pa.int32()), _signed(found.of(at, at + gram)), _signed(mixed(context)), pa.array(right - base, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "pos", "anchor", "context", "right"])

    return texts.mapInArrow(stage(run), "k1 long, k2 long, pos int, anchor long, context long, right int")


def ranges(window: int, gram: int, parts: int) -> list[tuple[int, int]]:
    """How far a window can begin before its anchor, in ``parts`` ranges (first, last)."""
    far = window - gram
    edges = [far * k // parts for k in range(parts + 1)]
    return [(edges[k] + (k > 0), edges[k + 1]) for k in range(parts)]


# --- the operator ------------------------------------------------------------------------------------


def repeats(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, parts: int = PARTS, largest: int = LARGEST) -> DataFrame:
    """Byte spans of repeated windows: k1, k2, first, last (end, exclusive); spans of a text may overlap.

    ``texts``: k1, k2, text of every row.
    """
    prepare(texts.sparkSession)
    long = texts.where(F.octet_length("text") >= window)
    found = anchors(long, window, gram)
    again = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi")).where("n > 1")
    again = saved(again.select("anchor", (F.col("lo") == F.col("hi")).alias("alike")))  # both sides of the join are plain shuffles, which AQE may split
    held = saved(found.join(again, "anchor"))
    discard(again)
    span = [F.greatest(F.lit(0), F.col("pos") - (window - gram)).cast("int").alias("first"), F.col("right").alias("last")]
    alike = held.where("alike").select("k1", "k2", *span)
    rest = held.where("not alike")
    member = F.struct("k1", "k2", "pos")
    contexts = saved(rest.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(member).alias("one")))
    # a context that is there very often shows that within each of some shares of its places; only places alone in theirs need the join
    share = Window.partitionBy("anchor", "context", F.pmod(F.xxhash64("k1", "pos"), F.lit(SHARES)))
    shared = rest.withColumn("here", F.count("*").over(share))
    whole = shared.where("here > 1").select("k1", "k2", *span)
    alone = shared.where("here = 1").join(contexts.where("n > 1").select("anchor", "context"), ["anchor", "context"])
    whole = whole.union(alone.select("k1", "k2", *span))
    wanted = contexts.groupBy("one.k1", "one.k2").agg(F.collect_list(F.struct("one.pos", F.col("n").alias("n"))).alias("places"))
    level = saved(cores(long.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "places"), window, gram, parts))
    out = alike.union(whole)
    for width in (NARROW, 0):
        sizes = saved(level.groupBy("core", "width").agg(F.count("*").alias("members"), F.max("single").alias("open")).where("members > 1 and open"))
        grouped = level.join(sizes, ["core", "width"])
        out = out.union(by_suffix_array(grouped.where(F.col("members") <= largest), window))
        large = sizes.where(F.col("members") > largest)
        if large.isEmpty():
            return out
        level = saved(narrowed(level.join(large.select("core", "width"), ["core", "width"]), width))
    twice = level.groupBy("core").agg(F.count("*").alias("members")).where("members > 1").select("core")
    return out.union(level.where("single").join(twice, "core").select("k1", "k2", F.col("at").alias("first"), (F.col("at") + window).cast("int").alias("last")))


def narrowed(pieces: DataFrame, width: int) -> DataFrame:
    """Pieces of the same contexts for ranges of ``width``: bytes next to the core become part of it."""
    starts = F.sequence(F.lit(0), F.col("width"), F.lit(width + 1))
    cut = pieces.withColumn("from", F.explode(starts)).withColumn("to", F.least(F.col("from") + width, F.col("width")))
    size, tail = F.octet_length("before"), F.col("width") - F.col("to")
    cut = cut.where((size >= F.col("from")) & (F.octet_length("after") >= tail))
    core = F.xxhash64("core", "width", "from", F.expr("substring(before, octet_length(before) - `from` + 1, `from`)"), F.expr("substring(after, 1, width - `to`)"))
    keep = F.least(size - F.col("from"), F.col("to") - F.col("from"))
    start = size - F.col("from") - keep
    return cut.select(
        core.alias("core"), (F.col("to") - F.col("from")).alias("width"), F.substring("before", start + 1, keep).alias("before"), F.substring("after", tail + 1, F.col("to") - F.col("from")).alias("after"),
        "k1", "k2", (F.col("at") + start).cast("int").alias("at"), "single",
    )


def cores(rows: DataFrame, window: int, gram: int, parts: int) -> DataFrame:
    """The pieces of each wanted context: core hash, width of the range, bytes left and right of the core, owner, place and whether it is the only one of its context."""
    spans = ranges(window, gram, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for part in slices(batches, 2, 1 << 20):
            keys = np.stack([part.column(i).to_numpy() for i in (0, 1)], axis=1)
            first = np.ones(len(keys), bool)  # copies of a text follow each other: one is enough
            first[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            first[0] = before is None or (keys[0] != before).any()
            before = keys[-1]
            part = part.filter(pa.array(first))
            lists = part.column(3)
            owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            places = lists.flatten()
            all_pos = places.field("pos").to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(owner << 40 | all_pos)
            line = (owner << 40 | all_pos)[order]
            alone = places.field("n").to_numpy(zero_copy_only=False)[order] == 1
            for own in strips([text_bytes(t) for t in part.column(2).to_pylist()], window - gram, window):
                found = Hashed(own)
                key = found.rows << 40 | found.offsets
                lows, highs = np.searchsorted(line, key + found.first), np.searchsorted(line, key + found.last)
                strip = np.repeat(np.arange(len(own)), highs - lows)
                if not len(strip):
                    continue
                at = np.concatenate([np.arange(a, b) for a, b in zip(lows.tolist(), highs.tolist(), strict=True)])
                start, end = found.starts[strip], found.ends[strip]
                pos = (line[at] & ((1 << 40) - 1)) - found.offsets[strip] + start
                single = alone[at]
                for k, (a, b) in enumerate(spans):
                    ok = np.flatnonzero((pos - a >= start) & (pos - b + window <= end))
                    if not len(ok):
                        continue
                    core_l, core_r = pos[ok] - a, pos[ok] - b + window
                    left = np.maximum(start[ok], core_l - (b - a))
                    right = np.minimum(end[ok], core_r + (b - a))
                    key = mixed(found.of(core_l, core_r) + np.uint64(k))
                    lefts = [found.bytes[x:y] for x, y in zip(left.tolist(), core_l.tolist(), strict=True)]
                    rights = [found.bytes[x:y] for x, y in zip(core_r.tolist(), right.tolist(), strict=True)]
                    row = pa.array(found.rows[strip[ok]])
                    place = left - start[ok] + found.offsets[strip[ok]]
                    yield pa.RecordBatch.from_arrays(
                        [_signed(key), pa.array(np.full(len(ok), b - a), pa.int32()), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary()), part.column(0).take(row), part.column(1).take(row), pa.array(place, pa.int32()), pa.array(single[ok], pa.bool_())],
                        names=["core", "width", "before", "after", "k1", "k2", "at", "single"],
                    )

    return rows.mapInArrow(stage(run), "core long, width int, before binary, after binary, k1 long, k2 long, at int, single boolean")


def by_suffix_array(grouped: DataFrame, window: int) -> DataFrame:
    """Spans of repeated windows in groups of equal core, from suffix arrays over batches of whole groups."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        pieces = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        width, core, k1, k2, at, single = (pieces.column(k).to_numpy(zero_copy_only=False) for k in ("width", "core", "k1", "k2", "at", "single"))
        group = np.append(0, np.cumsum((width[1:] != width[:-1]) | (core[1:] != core[:-1])))
        sequence, of, first, last = repeated_starts(group, width.astype(np.int64), pieces.column("before"), pieces.column("after"))
        rows = np.flatnonzero(single)
        low, high = (np.searchsorted(of, sequence[rows], side) for side in ("left", "right"))
        many = high - low
        run = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - low, many)
        rows = np.repeat(rows, many)
        arrays = [pa.array(k1[rows]), pa.array(k2[rows]), pa.array(at[rows] + first[run], pa.int32()), pa.array(at[rows] + last[run] + window, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, before = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in (0, 1)], axis=1)
            new = np.append(bool(held) and (keys[0] != before).any(), (keys[1:] != keys[:-1]).any(axis=1))
            before = keys[-1]
            if size + len(keys) >= BATCH_PIECES and new.any():
                begin = int(np.flatnonzero(new)[-1])
                yield settle([*held, batch.slice(0, begin)])
                held, size, batch = [], 0, batch.slice(begin)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield settle(held)

    dealt = grouped.select("width", "core", "before", "after", "k1", "k2", "at", "single")
    dealt = dealt.repartition("core", "width").sortWithinPartitions("width", "core")
    return dealt.mapInArrow(stage(run), "k1 long, k2 long, first int, last int")


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes went, and in how many maximal runs."""
    kept, at, gone, runs, first = [], 0, 0, 0, -1
    last = -1
    for a, b in sorted(spans):
        if a > last:
            if last > 0:
                gone += last - first
            kept.append(text[at:a])
            runs, first, last = runs + 1, a, b
        else:
            last = max(last, b)
        at = last
    if runs:
        gone += last - first
        kept.append(text[last:])
        return b"".join(kept), gone, runs
    return text, 0, 0


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merged spans shrunk to whole UTF-8 characters."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    out = []
    for a, b in merged:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def _with_spans(docs: DataFrame, text_col: str, **options: int) -> DataFrame:
    """``docs`` with keys and ``spans``, the distinct spans of each text."""
    rows = keyed(docs, text_col)
    texts = rows.select("k1", "k2", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = repeats(texts, **options)
    spans = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return rows.join(spans, ["k1", "k2"], "left")


def _spans(column: pa.Array) -> Iterator[list[tuple[int, int]]]:
    for own in column.to_pylist():
        yield [(s["first"], s["last"]) for s in own] if own else []


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans and ``kept`` (the remaining bytes) for each row."""
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [text_bytes(t) for t in part.column(1).to_pylist()]
            done = [cut(t, s) for t, s in zip(texts, _spans(part.column(2)), strict=True)]
            arrays = [part.column(0), *[pa.array(c, pa.int64()) for c in ([len(t) for t in texts], [d[1] for d in done], [d[2] for d in done])]]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([d[0] for d in done], pa.binary())], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    found = _with_spans(rows, "text", **options).select(id_col, "text", "spans")
    return found.mapInArrow(stage(run), f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, text_col: str = "text", **options: int) -> DataFrame:
    """``docs``, all columns, with repeated strings cut from the text (whole characters only; null stays null)."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    at = names.index(text_col)
    rows = docs.toDF(*inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            out = []
            for text, spans in zip(part.column(at).to_pylist(), _spans(part.column(len(names))), strict=True):
                data = text_bytes(text)
                out.append(cut(data, whole_characters(data, spans))[0].decode("utf-8", "replace") if spans else text)
            columns = part.columns[: len(names)]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=inner)

    found = _with_spans(rows, inner[at], **options).select(*inner, "spans")
    return found.mapInArrow(stage(run), rows.schema).toDF(*names)


