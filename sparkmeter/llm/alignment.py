"""Alignment of two tokenizers over the same text, with corpus-wide counts of the id pairs that meet.

Tokenizer A is a byte-level BPE file of the ``tokenizers`` library and encodes a space and the text; tokenizer B is a
SentencePiece model that adds the space itself. An A and a B token are linked if their byte ranges overlap;
places where tokens of both end cut a text into groups.

1. Neither tokenizer has a token that crosses a single space between two visible characters, so texts are cut
   there and the pieces are encoded once for each batch; a worker keeps what it has met in a bounded cache. Links
   are laid out for all pieces at once by binary search over the byte offsets.
2. Links of a batch of documents are summed for each (document, A id, B id) and dealt into stripes by B id. Each
   stripe row holds its entries, and beside them its pairs without the documents.
3. Counts: partial matrices for each (stripe, salt), filled by ``np.add.at`` into a dense block of B ids by A ids, meet in
   one matrix for each stripe. The block is bounded by the vocabularies, whatever the corpus.
4. Scoring: entries go to the task that holds their stripe's counts, a copy for each salt, which rebuilds the block,
   takes row maxima and gives each document's sums. Sums meet by batch and join the documents' own figures.

Results for odd input: null and empty texts, and texts whose joined token bytes differ from space and text, have no
tokens: zeros, and an empty ``groups_sha256``. A null id stays null; repeated rows each give a row and each count; other
columns are not carried over. An empty table gives an empty result. A text of any length is taken in parts of
``PART_CHARS`` at such cuts; only a text without any is encoded as a whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, saved, slices, stage

#: Stripes at least, and bytes of a dense block at most; more stripes make smaller blocks.
STRIPES, BLOCK_BYTES = 64, 256 << 20
#: Pieces that a worker remembers, and pieces that are encoded in one call.
CACHE_PIECES, CALL_PIECES = 200_000, 10_000
#: Longer texts are taken in parts of about this many characters.
PART_CHARS = 1 << 20
#: Entries of one packed row of counts.
PACK = 1 << 18
CUT = re.compile(r"(?<=\S) (?=\S)")
RARE = frozenset(chr(c) for c in range(0x3001) if chr(c).isspace()) - {" ", "\n"}


def pieces_of(text: str) -> list[str]:
    """A text cut at each single space between two visible characters."""
    if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or not RARE.isdisjoint(text):
        return CUT.split(text)
    return text.split(" ")


def parts_of(text: str) -> list[str]:
    """A text in parts of about ``PART_CHARS`` characters, cut where ``pieces_of`` cuts."""
    out, at = [], 0
    while len(text) - at > PART_CHARS and (found := CUT.search(text, at + PART_CHARS)):
        out.append(text[at : found.start()])
        at = found.end()
    return [*out, text[at:]]


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable bytes are themselves, others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    known = {chr(b): b for b in shown}
    return known | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


class Aligned(NamedTuple):
    """Figures of some pieces: counts for each, links of all one after the other, groups as text; a bad piece has none."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    bad: np.ndarray
    links_a: np.ndarray
    links_b: np.ndarray
    groups: list[str]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return sizes, np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))


class Aligner:
    """Both tokenizers, with a bounded memory of pieces."""

    def __init__(self, json_file: bytes, model_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(json_file)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_file)
        symbols = byte_symbols()
        tokens = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(symbols[c] for c in t) if t and all(c in symbols for c in t) else b"" for t in tokens]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b.id_to_piece(list(range(self.b.vocab_size()))))]
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.shown = [f"{mark}{i}" for count, marks in ((len(tokens), ";,"), (len(self.bytes_b), "|,")) for i in range(count) for mark in marks]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held: list[Aligned] = []
        self.table: Aligned | None = None

    def align(self, units: list[str]) -> Aligned:
        """Encode and align pieces, each on its own."""
        whole = [" " + u for u in units]
        n_a, a = _flat([e.ids for e in self.a.encode_batch_fast(whole, add_special_tokens=False)])
        n_b, b = _flat(self.b.encode(units, num_threads=1))
        data = [w.encode("utf-8", "surrogatepass") for w in whole]
        sizes = np.array([len(d) for d in data], np.int64)
        joined_a, joined_b, all_bytes = (b"".join(x) for x in (map(self.bytes_a.__getitem__, a.tolist()), map(self.bytes_b.__getitem__, b.tolist()), data))
        of_a, of_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        bytes_a, bytes_b = (np.bincount(u, s[i], len(units)).astype(np.int64) for u, s, i in ((of_a, self.size_a, a), (of_b, self.size_b, b)))
        bad = np.zeros(len(units), bool)
        if joined_a != all_bytes or joined_b != all_bytes or (bytes_a != sizes).any() or (bytes_b != sizes).any():
            at_a, at_b = np.cumsum(bytes_a) - bytes_a, np.cumsum(bytes_b) - bytes_b
            for u, own in enumerate(data):
                bad[u] = joined_a[at_a[u] : at_a[u] + bytes_a[u]] != own or joined_b[at_b[u] : at_b[u] + bytes_b[u]] != own
            a, b, of_a, of_b = a[~bad[of_a]], b[~bad[of_b]], of_a[~bad[of_a]], of_b[~bad[of_b]]
            n_a, n_b, sizes = (np.where(bad, 0, x) for x in (n_a, n_b, sizes))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        start_a, start_b = end_a - self.size_a[a], end_b - self.size_b[b]
        borders = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(borders, end_a), np.searchsorted(borders, end_b)
        first = np.searchsorted(end_b, start_a, "right")
        count = np.searchsorted(start_b, end_a, "left") - first
        links = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        n_groups = np.bincount(np.searchsorted(np.cumsum(sizes), borders, "left"), minlength=len(units))
        n_links = np.bincount(of_a, count, len(units)).astype(np.int64)
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=len(borders)))])
        upto_a = np.cumsum(np.bincount(group_a, minlength=len(borders)))
        codes = np.empty(len(a) + len(b), np.int64)  # the order of the text: group by group, A before B
        codes[np.arange(len(a)) + before_b[group_a]] = 2 * a + (np.diff(group_a, prepend=-1) == 0)
        codes[np.arange(len(b)) + upto_a[group_b]] = 2 * (len(self.bytes_a) + b) + (np.diff(group_b, prepend=-1) == 0)
        words = list(map(self.shown.__getitem__, codes.tolist()))
        ends = np.cumsum(n_a + n_b).tolist()
        groups = ["".join(words[s:e])[1:] for s, e in zip([0, *ends], ends, strict=False)]
        return Aligned(n_a, n_b, n_groups, n_links, bad, np.repeat(a, count), b[links], groups)

    def places(self, units: list[str]) -> np.ndarray:
        """The place in ``table`` of each piece; pieces not met yet are aligned first."""
        if len(self.known) > CACHE_PIECES:
            self.forget()
        known = self.known
        new = [u for u in dict.fromkeys(units) if u not in known]
        for start in range(0, len(new), CALL_PIECES):
            self.held.append(self.align(new[start : start + CALL_PIECES]))
        for u in new:
            known[u] = len(known)
        if new:
            parts = [self.table, *self.held] if self.table else self.held
            self.table = Aligned(*[np.concatenate([p[i] for p in parts]) for i in range(7)], list(chain.from_iterable(p.groups for p in parts)))
            self.held = []
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))


    def spoilt(self, units: list[str]) -> bool:
        """Whether a piece has no tokens."""
        places = self.places(units)
        return bool(self.table.bad[places].any())


_ALIGNERS: dict[str, Aligner] = {}


def aligner_of(files: tuple[bytes, bytes]) -> Aligner:
    """The worker's aligner for two files; made once for each Python process."""
    key = hashlib.sha256(files[0] + files[1]).hexdigest()
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(*files)
    return _ALIGNERS[key]


class Documents:
    """Figures of the documents of a batch, added up piece by piece."""

    def __init__(self, count: int):
        self.figures = np.zeros((4, count), np.int64)
        self.hashes = [None] * count
        self.entries: list[np.ndarray] = []  # document, A id, B id, links

    def add(self, aligner: Aligner, owners: list[int], parts: list[str]) -> None:
        """Add parts of documents; a document with a bad piece among them is left as it is."""
        cut = [pieces_of(p) for p in parts]
        places = aligner.places(list(chain.from_iterable(cut)))
        table, sizes = aligner.table, np.array([len(c) for c in cut])
        owner = np.repeat(np.array(owners), sizes)
        spoilt = np.unique(owner[table.bad[places]])
        ends = np.cumsum(sizes).tolist()
        for own, start, end in zip(owners, [0, *ends], ends, strict=False):
            if own not in spoilt:
                text = ";".join([table.groups[p] for p in places[start:end].tolist()])
                if self.hashes[own] is None:
                    self.hashes[own] = hashlib.sha256()
                else:
                    text = ";" + text
                self.hashes[own].update(text.encode())
        fine = ~np.isin(owner, spoilt)
        places, owner = places[fine], owner[fine]
        for i in range(4):
            self.figures[i] += np.bincount(owner, table[i][places], self.figures.shape[1]).astype(np.int64)
        keys, n = np.unique(owner << 40 | places, return_counts=True)  # a piece's links once for each document
        owner, places = keys >> 40, keys & ((1 << 40) - 1)
        count = table.n_links[places]
        starts = np.cumsum(table.n_links) - table.n_links
        at = np.repeat(starts[places] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        self.entries.append(np.stack([np.repeat(owner, count), table.links_a[at], table.links_b[at], np.repeat(n, count)]))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``n`` over each."""
    by = np.argsort(keys)
    keys, n = keys[by], n[by]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(n, starts)


_TABLE = "stripe int, chunk long, place int, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, docs binary, a binary, b binary, n binary, pair_a binary, pair_b binary, pair_n binary"
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.int64()] * 4, pa.string(), *[pa.binary()] * 7]
_NAMES = [c.split()[0] for c in _TABLE.split(", ")]


def _rows(columns: dict[str, list]) -> pa.RecordBatch:
    count = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [None] * count), kind) for name, kind in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)


def aligned(docs: DataFrame, json_path: str, model_path: str, stripes: int, rows: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each document (no stripe), and one for each batch and stripe with the links of the batch; a stripe has ``rows`` B ids and ``width`` A ids."""
    spark = docs.sparkSession
    files = []
    for path in (json_path, model_path):
        with open(path, "rb") as file:
            files.append(file.read())
    shared = spark.sparkContext.broadcast(tuple(files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = aligner_of(shared.value)
        chunk = TaskContext.get().partitionId() << 32
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            found = Documents(len(texts))
            short = [i for i, t in enumerate(texts) if t and len(t) <= PART_CHARS]
            if short:
                found.add(aligner, short, [texts[i] for i in short])
            for i, text in enumerate(texts):
                if text and len(text) > PART_CHARS:
                    own = parts_of(text)
                    if not any(aligner.spoilt(pieces_of(p)) for p in own):
                        for p in own:
                            found.add(aligner, [i], [p])
            figures = dict(zip(("n_a", "n_b", "n_groups", "n_links"), found.figures.tolist(), strict=True))
            shas = [h.hexdigest() if h else "" for h in found.hashes]
            count = len(texts)
            yield _rows({"chunk": [chunk] * count, "place": list(range(count)), "id": part.column(0).to_pylist(), "groups_sha256": shas, **figures})
            if found.entries and found.entries[0].shape[1]:
                doc, a, b, n = np.concatenate(found.entries, axis=1)
                keys, n = _summed((((b % stripes) * rows + b // stripes) * width + a) << 16 | doc, n)
                pairs, n2 = _summed(keys >> 16, n)
                doc, (left, a), (row2, a2) = keys & 0xFFFF, np.divmod(keys >> 16, width), np.divmod(pairs, width)
                lows, lows2 = (np.searchsorted(x, np.arange(stripes + 1) * rows) for x in (left, row2))
                row, row2 = left % rows, row2 % rows
                own = [k for k in range(stripes) if lows[k] < lows[k + 1]]
                cut = lambda x, at, kind: [x[at[k] : at[k + 1]].astype(kind).tobytes() for k in own]
                yield _rows({"stripe": own, "chunk": [chunk] * len(own), "docs": cut(doc, lows, "<u2"), "a": cut(a, lows, "<u4"), "b": cut(row, lows, "<u4"), "n": cut(n, lows, "<i8"), "pair_a": cut(a2, lows2, "<u4"), "pair_b": cut(row2, lows2, "<u4"), "pair_n": cut(n2, lows2, "<i8")})
            chunk += 1
        aligner.forget()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(stage(run), _TABLE)


def _arrays(batch: pa.RecordBatch, first: int, kinds: list[str]) -> Iterator[tuple]:
    """The leading plain columns of each row, then its packed columns as arrays."""
    columns = [c.to_pylist() for c in batch.columns]
    for row in zip(*columns, strict=True):
        yield (*row[:first], *[np.frombuffer(v or b"", k) for v, k in zip(row[first:], kinds, strict=True)])


def added(rows: int, width: int, keep_salt: bool):
    """Python stage over (stripe, salt, a, b, n) rows in order: the sum of each (stripe, salt) as packed counts; without ``keep_salt`` of each stripe."""

    def packs(stripe: int, salt: int, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        flat = block.reshape(-1)
        for start in range(0, len(flat), max(1, (1 << 22) // width) * width):  # a stretch at a time: no index of the whole block
            part = flat[start : start + max(1, (1 << 22) // width) * width]
            at = np.flatnonzero(part)
            for s in range(0, len(at), PACK):
                own = at[s : s + PACK]
                b, a = np.divmod(own + start, width)
                packed = [x.astype(k).tobytes() for x, k in ((a, "<u4"), (b, "<u4"), (part[own], "<i8"))]
                yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([salt], pa.int32()), *[pa.array([p], pa.binary()) for p in packed]], names=["stripe", "salt", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for batch in batches:
            for stripe, salt, a, b, n in _arrays(batch, 2, ["<u4", "<u4", "<i8"]):
                key = (stripe, salt if keep_salt else 0)
                if key != now:
                    if block is not None:
                        yield from packs(*now, block)
                    now, block = key, np.zeros((rows, width), np.int64)
                np.add.at(block, (b, a), n)
        if block is not None:
            yield from packs(*now, block)

    return run


def scored(rows: int, width: int):
    """Python stage over (stripe, salt, chunk, docs, a, b, n) rows in order, those of counts (no chunk) first: each batch's documents with their best links and sums of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, best = None, None, None
        for batch in batches:
            out: list[tuple] = []
            for stripe, salt, chunk, docs, a, b, n in _arrays(batch, 3, ["<u2", "<u4", "<u4", "<i8"]):
                if (stripe, salt) != now:
                    now, block, best = (stripe, salt), np.zeros((rows, width), np.int64), None
                if chunk is None:
                    block[b, a] = n
                    continue
                if best is None:
                    best = block.max(axis=1)
                count = block[b, a]
                own, at = np.unique(docs, return_inverse=True)
                total, top = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                np.add.at(total, at, count * n)
                np.add.at(top, at, np.where(count == best[b], n, 0))
                out.append((chunk, own.tobytes(), top.astype("<u4").tobytes() if top.max() < 1 << 32 else top.astype("<u8").tobytes(), total.astype("<i8").tobytes()))
            if out:
                chunks, *packed = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), *[pa.array(p, pa.binary()) for p in packed]], names=["chunk", "docs", "top", "total"])

    return run


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, docs, top, total) rows in order of chunk: one row for each document."""

    def rows(chunk: int, sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        places = np.flatnonzero(sums["seen"])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(places), chunk)), pa.array(places.astype(np.int32)), pa.array(sums["top"][places]), pa.array(sums["total"][places])], names=["chunk", "place", "n_best", "count_sum"])

    now, sums = None, {}
    for batch in batches:
        for chunk, docs, top, total in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if chunk != now:
                if now is not None:
                    yield rows(now, sums)
                now, sums = chunk, {k: np.zeros(1 << 16, np.int64) for k in ("seen", "top", "total")}
            own = np.frombuffer(docs, "<u2")
            sums["seen"][own] = 1
            sums["top"][own] += np.frombuffer(top, "<u4" if len(top) == 4 * len(own) else "<u8").astype(np.int64)
            sums["total"][own] += np.frombuffer(total, "<i8")
    if now is not None:
        yield rows(now, sums)


def align(docs: DataFrame, json_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair count is the
    highest of their B id), ``count_sum`` (pair counts over the links) and ``groups_sha256``."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    prepare(spark)
    width, height = Tokenizer.from_file(json_path).get_vocab_size(), SentencePieceProcessor(model_file=model_path).vocab_size()
    stripes = max(STRIPES, -(-width * height * 8 // BLOCK_BYTES))
    rows = -(-height // stripes)
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // stripes))
    found = saved(aligned(docs, json_path, model_path, stripes, rows, width, id_col, text_col))
    links = found.where("stripe is not null").withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int"))
    kind = "stripe int, salt int, a binary, b binary, n binary"
    pairs = links.select("stripe", "salt", F.col("pair_a").alias("a"), F.col("pair_b").alias("b"), F.col("pair_n").alias("n"))
    pairs = pairs.repartition("stripe", "salt").sortWithinPartitions("stripe", "salt").mapInArrow(stage(added(rows, width, True)), kind)
    counts = saved(pairs.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(stage(added(rows, width, False)), kind))
    none = F.lit(None)
    copies = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    copies = copies.select("stripe", "salt", none.cast("long").alias("chunk"), none.cast("binary").alias("docs"), "a", "b", "n")
    both = copies.union(links.select("stripe", "salt", "chunk", "docs", "a", "b", "n")).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.asc_nulls_first("chunk"))
    sums = both.mapInArrow(stage(scored(rows, width)), "chunk long, docs binary, top binary, total binary")
    sums = sums.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(stage(gathered), "chunk long, place int, n_best long, count_sum long")
    own = found.where("stripe is null").select("chunk", "place", F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = own.join(sums, ["chunk", "place"], "left")
    return out.select(id_col, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
