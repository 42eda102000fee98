"""Removal of repeated word windows by relative Lempel-Ziv parsing.

A window is ``window`` consecutive words of one document. A word goes if a window over it also starts in a document with a
smaller id. The reference that documents are parsed against is the corpus itself, far too large for one index, so it is cut into
blocks, and a document's words are sent to exactly those blocks that can hold a repeat of them:

1. Anchors: of the ``gram``-word hashes inside each window the least is an anchor. Equal windows have equal
   anchors at the same place, so a repeated window has an anchor that another row has too. Anchors of one row only are dropped.
2. Contexts: an anchor with all words that a window around it can cover. Contexts of one anchor make a group;
   groups fill blocks. An anchor that is very frequent sends its single windows instead, keyed by
   their own hash, so no group grows with the frequency of a phrase.
3. Parsing: a block is indexed by ranks of its phrases of ``window`` words (prefix doubling over word numbers, compared
   word by word), each with its place in the earliest document. Each context is then factored greedily: a phrase whose earliest place is in
   an earlier document opens a factor, which is prolonged for as long as the words there go on alike. Where a factor
   ends, the windows that lie across its end are looked up on their own. Factors are at least a window long and
   are the duplicate spans. A context that stood before in an earlier document is one factor as a whole.

Rows that stand for others are chosen before each shuffle: a phrase that many rows of a batch hold is sent once for the
batch, and so is a context or window; the others' result is known where they are. Hashes only route: what is
removed was compared word by word.

Results for odd input: a null text is an empty one; a text of fewer words than a window loses nothing; a null id counts as
the largest long, so it is never the smaller one; rows of equal id take nothing from each other; repeated rows each give the same row;
other columns are not carried over; an empty table gives an empty result. Texts of any length are hashed in strips.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, prepare, saved, slices, stage, text_bytes
from .suffixes import mixed, powers, sliding

WINDOW, GRAM = 13, 5
#: Rows of a batch from which an anchor is sent once for all of them, and rows from which an anchor's group is too large.
FEW, LARGEST = 16, 8192
#: Words of a block, about, and bytes that are hashed at a time.
BLOCK_WORDS, STRIP_BYTES = 200_000, 1 << 20
#: Longer words are hashed one by one.
LONG_WORD = 255
SPACE = re.compile(rb"[\x20\x09-\x0D]")
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
FACTOR = np.uint64(0xD6E8FEB86659FD93)


# --- hashes ------------------------------------------------------------------------------------------


def strips(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """All texts, with their numbers, in strips of about ``STRIP_BYTES``; a longer text is cut at white space."""
    held, total = [], 0
    for row, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > STRIP_BYTES:
                found = SPACE.search(text, at + STRIP_BYTES)
                end = found.start() if found else end
            held.append((row, text[at:end]))
            total += end - at
            at = end
            if total >= STRIP_BYTES:
                yield held
                held, total = [], 0
    if held:
        yield held


def strip_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of some bytes."""
    line = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], IS_SPACE[line], [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    if len(data) > 4 * STRIP_BYTES:  # a huge word is in here: only the short ones take prefix sums
        short = ends - starts <= LONG_WORD
        hashes = np.zeros(len(starts), np.uint64)
        words = [data[s:e] for s, e in zip(starts[short].tolist(), ends[short].tolist(), strict=True)]
        hashes[short] = word_hashes([b" ".join(words)])[0]
    else:
        up, down = powers(len(line))
        sums = np.zeros(len(line) + 1, np.uint64)
        np.cumsum((line.astype(np.uint64) + np.uint64(1)) * up[: len(line)], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return hashes, starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after the other, and the number of words of each."""
    found, counts = [], np.zeros(len(texts), np.int64)
    for own in strips(texts):
        hashes, starts = strip_hashes(b"\n".join([data for _, data in own]))
        ends = np.cumsum([len(data) + 1 for _, data in own])
        at = np.searchsorted(ends, starts, "right")
        np.add.at(counts, np.array([row for row, _ in own])[at], 1)
        found.append(hashes)
    return np.concatenate(found) if found else np.zeros(0, np.uint64), counts


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    count = len(words) - size + 1
    out = words[:count].copy()
    for j in range(1, size):
        out *= FACTOR
        out += words[j : j + count]
    return mixed(mixed(out))


def anchors(words: np.ndarray, counts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and word number of all anchors."""
    grams = gram_hashes(words, gram)
    if len(words) < window:
        return grams[:0], counts[:0], counts[:0]
    near = window - gram + 1
    least = sliding(grams, near, np.minimum)
    ends = np.cumsum(counts)
    for end in ends[:-1].tolist():  # windows over a border
        least[max(0, end - window + 1) : end] = 0
    padded = np.zeros(len(least) + 2 * (near - 1), np.uint64)
    padded[near - 1 : near - 1 + len(least)] = least
    at = np.flatnonzero((sliding(padded, near, np.maximum)[: len(grams)] == grams) & (grams > 0))
    row = np.searchsorted(ends, at, "right")
    return grams[at], row, at - (ends - counts)[row]


# --- anchors that several rows have ------------------------------------------------------------------

ALONE, FREQUENT, KNOWN = 0, 1, 2


def voted(keys: np.ndarray, rows: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Anchors of a batch as (key, row, place and kind): those that more than ``FEW`` rows hold send one for all."""
    by = np.lexsort([at, rows, keys])
    keys, rows, at = keys[by], rows[by], at[by]
    if not len(keys):
        return [keys.view(np.int64), rows, at]
    new_key = np.diff(keys, prepend=~keys[0]) != 0
    new_row = new_key | (np.diff(rows, prepend=~rows[0]) != 0)
    starts = np.flatnonzero(new_key)
    sizes = np.diff(np.append(starts, len(keys)))
    often = np.repeat(np.add.reduceat(new_row.astype(np.int64), starts) > FEW, sizes)
    kind = np.where(often, np.where(new_key, FREQUENT, KNOWN), ALONE)
    keys = np.where(kind == KNOWN, mixed(rows.view(np.uint64) + at.astype(np.uint64)), keys)
    return [keys.view(np.int64), rows, at << 2 | kind]


def shared(largest: int):
    """Python stage over (key, row, at) rows in order, frequent ones of a key first: the places whose key several rows have, and whether it is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        flooded = None  # a key whose rows go straight through

        def out(rows: np.ndarray, at: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array((at >> 2) << 1 | hot)], names=["row", "place"])

        def settled(keys: np.ndarray, rows: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.diff(keys, prepend=~keys[0]))
            sizes = np.diff(np.append(starts, len(keys)))
            kind = at[starts] & 3
            hot = (kind != ALONE) | (sizes > largest)
            keep = np.repeat(hot | (np.minimum.reduceat(rows, starts) != np.maximum.reduceat(rows, starts)), sizes)
            return out(rows[keep], at[keep], np.repeat(hot, sizes)[keep])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, rows, at = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True))
            if flooded is not None:
                through = int(np.searchsorted(keys != flooded, True))
                yield out(rows[:through], at[:through], np.ones(through, np.int64))
                keys, rows, at = keys[through:], rows[through:], at[through:]
                if not len(keys):
                    held = [keys, rows, at]
                    continue
                flooded = None
            last = int(np.flatnonzero(np.diff(keys, prepend=~keys[0]))[-1])
            if last:
                yield settled(keys[:last], rows[:last], at[:last])
            if at[last] & 3 != ALONE or len(keys) - last > largest:
                flooded = keys[last]
                yield out(rows[last:], at[last:], np.ones(len(keys) - last, np.int64))
                last = len(keys)
            held = [keys[last:], rows[last:], at[last:]]
        if len(held[0]):
            yield settled(*held)

    return run


def shared_anchors(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``row`` and ``places`` (word number times two, one more if frequent) of the anchors that several rows have. ``texts``: row, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes, counts = word_hashes([text_bytes(t) for t in part.column(1).to_pylist()])
            keys, own, at = anchors(hashes, counts, window, gram)
            arrays = voted(keys, part.column(0).to_numpy()[own], at)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=["key", "row", "at"])

    found = texts.select("row", "text").mapInArrow(stage(run), "key long, row long, at long")
    found = found.repartition("key").sortWithinPartitions("key", F.col("at").bitwiseAND(3).desc())
    found = found.mapInArrow(stage(shared(LARGEST)), "row long, place long")
    return found.groupBy("row").agg(F.collect_set("place").alias("places"))


def packed(texts: DataFrame) -> DataFrame:
    """``texts`` (id, doc, row, text) with the text's bytes packed by zstd: less than half of what a shuffle would write of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for part in slices(batches, 3):
            data = [pack(text_bytes(t)) for t in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(data, pa.binary())], names=["id", "doc", "row", "packed"])

    return texts.select("id", "doc", "row", "text").mapInArrow(stage(run), "id long, doc long, row long, packed binary")


# --- contexts ----------------------------------------------------------------------------------------

_CONTEXTS = "key long, doc long, row long, size int, words binary, places array<int>"
_CONTEXT_KINDS = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32())


def contexts(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """What is sent to the blocks, from doc, row, packed, places: a key, and ``size`` words with the places where they stand in the row; without words the starts and ends of known repeats."""
    far = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for part in slices(batches, 2, SLICE_BYTES // 2):
            doc, row, text, places = (c.to_pylist() for c in part.columns)
            first: dict[tuple[int, bytes], list] = {}
            more, known, done = [], [], set()
            for i in sorted(range(len(doc)), key=lambda i: (doc[i], row[i])):
                if row[i] in done:  # a repeated row
                    continue
                done.add(row[i])
                data = unpack(text[i])
                words, (hashes, _) = data.split(), word_hashes([data])
                runs: list[int] = []
                own = np.array(places[i], np.int64)
                own = own[(own >> 1) <= len(words) - gram]
                single = (own[own & 1 == 1] >> 1)[:, None] - np.arange(far + 1)
                single = np.unique(single[(single >= 0) & (single <= len(words) - window)])
                cold = np.sort(own[own & 1 == 0] >> 1)
                starts = np.concatenate([np.maximum(cold - far, 0), single])
                ends = np.concatenate([np.minimum(cold + window, len(words)), single + window])
                keys = np.concatenate([gram_hashes(hashes, gram)[cold], gram_hashes(hashes, window)[single] if len(single) else hashes[:0]])
                for key, a, b in zip(keys.view(np.int64).tolist(), starts.tolist(), ends.tolist(), strict=True):
                    piece = key, b" ".join(words[a:b])
                    entry = first.get(piece)
                    if entry is None:
                        first[piece] = [key, doc[i], row[i], b - a, piece[1], [a]]
                    elif entry[2] == row[i]:
                        entry[5].append(a)
                    elif entry[1] < doc[i]:
                        runs += [a, b]
                    else:
                        more.append([key, doc[i], row[i], b - a, piece[1], [a]])
                if runs:
                    known.append([row[i], doc[i], row[i], 0, None, runs])
            rows = [*first.values(), *more, *known]
            for start in range(0, len(rows), 10_000):
                columns = zip(*rows[start : start + 10_000], strict=True)
                arrays = [pa.array(_wrapped(c) if k == 0 else c, kind) for k, (c, kind) in enumerate(zip(columns, _CONTEXT_KINDS, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _CONTEXTS.split(", ")])

    return texts.select("doc", "row", "packed", "places").mapInArrow(stage(run), _CONTEXTS)


def _wrapped(values: tuple[int, ...]) -> list[int]:
    return [(v + (1 << 63)) % (1 << 64) - (1 << 63) for v in values]


# --- parsing -----------------------------------------------------------------------------------------


def phrase_ranks(numbers: np.ndarray, size: int) -> np.ndarray:
    """For each place the rank of the ``size`` numbers from there on: equal ranks, equal numbers. By prefix doubling; places too near to the end keep what is there."""
    ranks, have = numbers, 1
    while have < size:
        step = min(have, size - have)
        after = np.concatenate([ranks[step:], np.full(step, -1)])
        ranks = np.unique((ranks + 1) * (len(numbers) + 2) + after + 1, return_inverse=True)[1]
        have += step
    return ranks


def factors(parts: list[list[bytes]], docs: list[int], window: int) -> list[list[tuple[int, int]]]:
    """Parse parts (words) relative to all parts of smaller ``docs``: (start, end) of each part's factors of ``window`` words or more."""
    sizes = np.array([len(p) for p in parts], np.int64)
    known: dict[bytes, int] = {}
    numbers = np.empty(int(sizes.sum()) + len(parts), np.int64)
    at = 0
    for part in parts:
        numbers[at : at + len(part)] = [known.setdefault(w, len(known)) for w in part]
        at += len(part) + 1
    ends = np.cumsum(sizes + 1) - 1
    numbers[ends] = len(known) + np.arange(len(parts))  # a mark of its own after each part
    numbers = np.unique(numbers, return_inverse=True)[1]
    ranks = phrase_ranks(numbers, window)
    part_of = np.repeat(np.arange(len(parts)), sizes + 1)
    place = np.flatnonzero(np.arange(len(numbers)) + window <= ends[part_of])
    owner = np.array(docs, np.int64)[part_of]
    by = place[np.lexsort([place, owner[place], ranks[place]])]
    starts = np.flatnonzero(np.diff(ranks[by], prepend=-1))
    source = np.full(len(numbers), -1)
    source[by] = np.repeat(by[starts], np.diff(np.append(starts, len(by))))
    repeat = (source >= 0) & (owner[source] < owner)
    going = np.zeros(len(numbers), bool)  # the factor that covers the window before goes on
    going[1:] = repeat[1:] & repeat[:-1] & (source[1:] == source[:-1] + 1)
    opened = np.flatnonzero(repeat & ~going)
    closed = np.flatnonzero(repeat & ~np.append(going[1:], False))
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    begins = ends - sizes
    for part, a, b in zip(part_of[opened].tolist(), (opened - begins[part_of[opened]]).tolist(), (closed - begins[part_of[closed]]).tolist(), strict=True):
        out[part].append((a, b + window))
    return out


def parsed(window: int):
    """Python stage over contexts in order of key and document: ``doc``, ``row`` and ``span`` (start in the upper, end in the lower half) of each factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        seen: dict[bytes, int] = {}
        now, total = None, 0
        out: list[tuple[int, int, int]] = []

        def settle() -> None:
            parts = [words.split(b" ") for words, _, _, _ in block]
            for (_, doc, row, places), found in zip(block, factors(parts, [b[1] for b in block], window), strict=True):
                out.extend((doc, row, (p + a) << 32 | (p + b)) for a, b in found for p in places)
            block.clear()

        def pack() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * 3
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "row", "span"])
            out.clear()
            return batch

        for batch in batches:
            for key, doc, row, size, words, places in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != now:
                    if total >= BLOCK_WORDS:
                        settle()
                        total = 0
                    now = key
                    seen = {}
                if words is None:
                    out.extend((doc, row, a << 32 | b) for a, b in zip(places[::2], places[1::2], strict=True))
                elif seen.get(words, doc) < doc:  # as a whole in an earlier document
                    out.extend((doc, row, p << 32 | (p + size)) for p in places)
                else:
                    seen.setdefault(words, doc)
                    block.append((words, doc, row, places))
                    total += size
            yield pack()
        settle()
        yield pack()

    return run


# --- the operator ------------------------------------------------------------------------------------


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))


def repeats(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc``, ``row`` and ``spans`` of the repeated words of each row that has any. ``texts``: id, doc, row (a hash of doc and text), text."""
    long = texts.where(F.octet_length("text") >= 2 * window - 1)
    places = saved(shared_anchors(long, window, gram))
    sent = contexts(packed(long).join(places, "row"), window, gram)
    sent = sent.repartition("key").sortWithinPartitions("key", "doc", "row")
    found = sent.mapInArrow(stage(parsed(window)), "doc long, row long, span long")
    return found.groupBy("doc", "row").agg(F.collect_set("span").alias("spans"))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: ``id_col``, ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by one space)."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), _doc(id_col).alias("doc"), text.alias("text")).withColumn("row", F.xxhash64("doc", "text"))
    spans = saved(repeats(texts, window, gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for part in slices(batches, 1, SLICE_BYTES // 2):
            counts, gone, kept = [], [], []
            for text, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                words = unpack(text).split()
                counts.append(len(words))
                if own:
                    edges = np.zeros(len(words) + 1, np.int64)
                    at = np.array(own, np.int64)
                    np.add.at(edges, at >> 32, 1)
                    np.add.at(edges, at & 0xFFFFFFFF, -1)
                    stays = np.cumsum(edges)[:-1] == 0
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                gone.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    joined = packed(texts).join(spans, ["doc", "row"], "left").select("id", "packed", "spans")
    return joined.mapInArrow(stage(run), f"`{id_col}` long, n_words long, n_removed long, kept string")
