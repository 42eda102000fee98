"""Token-id output: documents packed into rows of fixed length.

Token ids of each document are cut into pieces of at most ``length`` ids, nothing is dropped; pieces are
packed by best-fit decreasing: pieces in falling order of length, each into the fullest row that still has
room, found in a segment tree over free capacities. A packed row holds an id matrix row (filled up with
``pad``), cumulative segment lengths and position ids that begin anew with each segment.

Packing is done in each task over blocks of at most ``block_ids`` ids, so memory is bounded and no row is
shuffled; a block is large against a row, so few rows stay unfilled. Every id of every document is in the output
exactly once, in order inside its pieces; ``unpack`` gives the documents back.

Results for odd input: null and empty texts have no pieces and no row; a null id is kept as null; repeated rows
are documents of their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks, vocabulary
from .common import prepare, slices, stage

LENGTH, PAD, BLOCK_IDS = 2048, 50256, 4 << 20


_ENCODERS: dict[tuple[int, str], tiktoken.Encoding] = {}


def encoding(content: bytes, pattern: str) -> tiktoken.Encoding:
    """The worker's tokenizer for a rank file, made once for each process; its ids are those of ``bpe``."""
    key = hash(content), pattern
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(content), special_tokens={})
    return _ENCODERS[key]


class Capacities:
    """Segment tree over free capacities 0 to ``most``: which capacities have rows, and the least one that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        at = self.leaves + capacity
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, capacity: int) -> int:
        """Remove and return a row of exactly this capacity (the one put last)."""
        at = self.leaves + capacity
        while at:
            self.tree[at] -= 1
            at >>= 1
        return self.rows[capacity].pop()

    def least(self, needed: int) -> int | None:
        """Smallest capacity of at least ``needed`` that has a row."""
        at = self.leaves + needed
        if self.tree[at]:
            return needed
        while at > 1:  # up to the first right sibling with rows, then down to its leftmost
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers: best-fit decreasing for pieces of 1 to ``length`` ids."""
    free = Capacities(length)
    rows: list[list[int]] = []
    for piece in sorted(range(len(sizes)), key=lambda p: (-sizes[p], p)):
        need = sizes[piece]
        capacity = free.least(need)
        if capacity is None:
            row, capacity = len(rows), length
            rows.append([])
        else:
            row = free.take(capacity)
        rows[row].append(piece)
        if capacity > need:
            free.put(capacity - need, row)
    return rows


_SCHEMA = "row_id long, n_ids int, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, doc_starts array<long>"
_KINDS = pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())


def pack(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, pad: int = PAD, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows: ``input_ids`` and ``position_ids`` (``length`` little-endian unsigned 32-bit numbers each), ``cu_seqlens``
    (0, then each segment's end), and for each segment the document and the number of its first id in the document.

    ``row_id`` is unique: the task's partition in the upper bits, a counter in the lower ones.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoding(shared.value, pattern).encode_to_numpy
        number = TaskContext.get().partitionId() << 36
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows = best_fit([len(p[2]) for p in pieces], length)
            for start in range(0, len(rows), 256):
                out = []
                for row in rows[start : start + 256]:
                    own = [pieces[p] for p in row]
                    sizes = [len(p[2]) for p in own]
                    used = sum(sizes)
                    ids, places = np.full(length, pad, "<u4"), np.zeros(length, "<u4")
                    ids[:used] = np.concatenate([p[2] for p in own])
                    ends = np.cumsum([0, *sizes])
                    places[:used] = np.arange(used) - np.repeat(ends[:-1], sizes)
                    out.append((number, used, ids.tobytes(), ends.tolist(), places.tobytes(), [p[0] for p in own], [p[1] for p in own]))
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=[c.split()[0] for c in _SCHEMA.split(", ")])
            pieces.clear()

        for part in slices(batches):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = encode(text, disallowed_special=()) if text else ()
                for start in range(0, len(ids), length):
                    pieces.append((doc, start, ids[start : start + length]))
                held += len(ids)
                if held >= block_ids:
                    yield from flush()
                    held = 0
        yield from flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(stage(run), _SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; ``path`` has to be in a store that all executors share."""
    packed.write.mode("errorifexists").parquet(path)


def unpack(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Segments of packed rows: ``id_col``, ``start`` (number of the first id in the document) and ``ids`` (packed)."""
    segment = F.posexplode(F.arrays_zip("doc_ids", "doc_starts")).alias("k", "s")
    rows = packed.select("input_ids", "cu_seqlens", segment)
    first, last = F.element_at("cu_seqlens", F.col("k") + 1), F.element_at("cu_seqlens", F.col("k") + 2)
    return rows.select(F.col("s.doc_ids").alias(id_col), F.col("s.doc_starts").alias("start"), F.substring(F.col("input_ids"), 4 * first + 1, 4 * (last - first)).alias("ids"))
