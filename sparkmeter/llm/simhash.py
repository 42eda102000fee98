"""SimHash near-duplicate detection with BK-trees.

A BK-tree keeps each fingerprint under its parent by their integer Hamming distance; a search follows only
the edges whose distance differs by at most the radius from the distance to the node. A tree over all
fingerprints would grow with the corpus, so the trees are sharded, and each fingerprint is dealt to the
shards that can hold a neighbour of it:

* ``linked`` (radius up to 2, exact): the 64 bits are cut into blocks; two fingerprints within the radius
  agree on all blocks but ``radius`` of them, so a shard is a choice of agreeing blocks with their value.
* ``near_duplicates`` (shingle similarity): candidates are texts whose fingerprints ``linked`` joins; a class of these is a shard, and
  so is a band of minimum shingle hashes, for texts further apart than the radius. Each link is confirmed on whole shingle sets.

Inside a shard a union-find keeps a spanning set of links, never all pairs of a group.

Results for odd input: a null text is an empty text; a null id stays null in the output; repeated rows and rows of equal id are
documents like any other; input columns other than the id and the text are not carried over by
``fingerprints`` and ``near_duplicates`` and kept as they are by ``one_of_each``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, saved, slices, stage, text_bytes
from .components import components

SEED = 42
BITS = 64


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each shingle of lower-cased words (A-Z only); fewer words: of the whole sequence; none: nothing."""
    found = text.lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(joined, SEED)]
    ends, at = [], -1
    for word in found:
        at += len(word) + 1
        ends.append(at)
    starts = [0]
    starts += [end + 1 for end in ends[: len(ends) - words]]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)]


def fingerprint(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id_col`` and ``fp`` (the fingerprint's bits as a signed long); no shuffle."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = []
            for text in part.column(1).to_pylist():
                hashes = np.array(shingle_hashes(text_bytes(text), words), dtype=np.uint64)
                found.append(signed(fingerprint(hashes)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], names=[id_col, "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(stage(run), f"`{id_col}` long, fp long")


#: Bits within which fingerprints are joined before minimum hashes are asked.
RADIUS = 2
#: Minimum-hash bands and hashes in each, members settled in one piece.
BANDS, BAND_SIZE, LARGEST = 12, 3, 4096
_RNG = np.random.default_rng(SEED)
FACTORS = _RNG.integers(1, 1 << 63, BANDS * BAND_SIZE, dtype=np.uint64) | np.uint64(1)
OFFSETS = _RNG.integers(0, 1 << 63, BANDS * BAND_SIZE, dtype=np.uint64)


def band_keys(unique: np.ndarray) -> list[int]:
    """Signed keys of the bands of minimum hashes of a set of shingle hashes."""
    least = np.zeros(BANDS * BAND_SIZE, np.uint64)
    if len(unique):
        for i in range(BANDS * BAND_SIZE):
            least[i] = (unique * FACTORS[i] + OFFSETS[i]).min()
    return [signed(xxhash.xxh64_intdigest(row.tobytes())) for row in least.reshape(BANDS, BAND_SIZE)]


_NO_ID = (1 << 63) - 1


def _row(id_col: str, text_col: str) -> list[Column]:
    """``doc`` (a null id counts as the largest) and ``row``, a hash of id and text that names a row; only equal rows share one."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    return [doc.alias("doc"), F.xxhash64(doc, F.coalesce(F.col(text_col), F.lit(""))).alias("row")]


def _set_names(unique: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set of shingle hashes."""
    data = unique.tobytes()
    return signed(xxhash.xxh64_intdigest(data, 1)), signed(xxhash.xxh64_intdigest(data, 2))


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc, row, a 128-bit hash of the shingle set (s1, s2), its size, its fingerprint, and band keys of each row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            one, two, sizes, prints, bands = [], [], [], [], []
            for text in part.column(2).to_pylist():
                unique = np.unique(np.array(shingle_hashes(text_bytes(text), words), dtype=np.uint64))
                names = _set_names(unique)
                one.append(names[0])
                two.append(names[1])
                sizes.append(len(unique))
                prints.append(signed(fingerprint(unique)))
                bands.append(band_keys(unique))
            arrays = [*part.columns[:2], *[pa.array(c, pa.int64()) for c in (one, two, sizes, prints)], pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "row", "s1", "s2", "size", "fp", "bands"])

    rows = docs.select(*_row(id_col, text_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(stage(run), "doc long, row long, s1 long, s2 long, size long, fp long, bands array<long>")


def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A link from each shard's first value to each other one."""
    now, head = None, None
    for batch in batches:
        left, right = [], []
        for band, key, rep in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (band, key) != now:
                now, head = (band, key), rep
            else:
                left.append(head)
                right.append(rep)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted arrays of distinct hashes have at least this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    if not len(a):
        return not len(b)
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(both) - shared)


def confirmed(similarity: float):
    """Python stage over (cluster, low, high, chunk, band, label, id, bands, shingles) rows in order: spanning links among the pairs that share a
    band and that the shingle sets confirm, within a chunk (low = high) or between two. Rows of one label are known to be linked; with a band
    (not -1) only pairs whose first common band it is are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []
        held = np.zeros((64, 256), np.uint32)  # hashes of each member by their upper byte
        keys = np.zeros((64, BANDS + 1), np.int64)
        label, side = np.zeros(64, np.int64), np.zeros(64, np.int64)
        for batch in batches:
            left, right = [], []
            for cluster, low, high, chunk, band, named, name, bands, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (cluster, low, high) != now:
                    now, ids, sets = (cluster, low, high), [], []
                own, place = np.frombuffer(data, np.uint64), len(ids)
                ids.append(name)
                sets.append(own)
                if place == len(held):
                    held, keys, label, side = (np.concatenate([x, np.zeros_like(x)]) for x in (held, keys, label, side))
                held[place] = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=256)
                keys[place], label[place], side[place] = bands, named, chunk
                same = keys[:place] == keys[place]
                able = same.any(axis=1) if band < 0 else same[:, band] & ~same[:, :band].any(axis=1)
                able &= label[:place] != named
                if low != high:
                    able &= side[:place] != chunk
                near = np.flatnonzero(able)
                if len(near):  # shared hashes are at most the sum of the lower counts: exact, and cheap for many members
                    most = np.minimum(held[near], held[place]).sum(axis=1).astype(np.int64)
                    fits = most >= similarity * (held[near].sum(axis=1).astype(np.int64) + len(own) - most) - 1e-9
                    near = near[fits][np.argsort(-most[fits], kind="stable")]
                for other in near.tolist():
                    if label[other] != label[place] and _alike(own, sets[other], similarity):
                        label[: place + 1][label[: place + 1] == label[place]] = label[other]
                        left.append(ids[other])
                        right.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def starred(similarity: float):
    """Python stage over (leader, salt, member, id, shingles) rows in order, the leader's own first: a link from the leader to each similar member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            left, right = [], []
            for leader, _, member, name, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = np.frombuffer(data, np.uint64)
                if not member:
                    head = own
                elif _alike(head, own, similarity):
                    left.append(leader)
                    right.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _in_chunks(rows: DataFrame, key: str, similarity: float) -> DataFrame:
    """Links among the rows (``key``, n, band, label, id, bands, shingles) of each key; more than ``LARGEST`` rows are settled as pairs of chunks."""
    chunks = F.ceil(F.col("n") / LARGEST)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    rows = rows.select(F.col(key).alias("cluster"), F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "band", "label", "id", "bands", "shingles")
    rows = rows.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "id")
    return rows.mapInArrow(stage(confirmed(similarity)), "a long, b long")


def _values(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and each distinct shingle set (s1, s2) with its first row (doc, row) and its group.

    SimHash comes first: fingerprints of the sets are joined by BK-trees (``linked``), and the class of a value is the first of its bands.
    Candidates share that class or a band of minimum hashes. What bands chain together is a cluster. Clusters of up to ``LARGEST`` values are settled
    at once. In a larger one each band key is a shard of its own: first every member is held against the shard's
    leader, which joins most copies; shards that hold several groups after that are settled pair by pair, only between
    different groups, split by length (a set of similarity s has at least s times the other's size) and cut into chunks where they are still too large.
    """
    found = saved(sketches(docs, words, id_col, text_col))
    values = found.groupBy("s1", "s2").agg(F.min(F.struct("doc", "row")).alias("first"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("bands").alias("bands"))
    values = saved(values.withColumn("id", F.monotonically_increasing_id()))
    classes = linked(values.select("id", "fp"), RADIUS, id_col="id").select("id", F.col("component_id").alias("near"))
    values = saved(values.join(classes, "id").withColumn("bands", F.concat(F.array("near"), "bands")).drop("near", "fp"))
    shards = values.select(F.posexplode("bands").alias("band", "key"), "id")
    many = shards.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    shards = saved(shards.join(many, ["band", "key"]))
    chained = shards.select("band", "key", F.col("id").alias("rep")).repartition("band", "key").sortWithinPartitions("band", "key", "rep")
    clusters = components(chained.mapInArrow(stage(leaders), "a long, b long"), "a", "b")
    clusters = saved(clusters.withColumnRenamed("node", "id").withColumnRenamed("component", "cluster"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    clusters = clusters.join(sizes, "cluster")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 6):
            keep, sets, known = [], [], set()
            for k, (name, one, two, text) in enumerate(zip(*[part.column(i).to_pylist() for i in (2, 4, 5, 6)], strict=True)):
                if name in known:  # the same row again
                    continue
                unique = np.unique(np.array(shingle_hashes(text_bytes(text), words), dtype=np.uint64))
                if _set_names(unique) == (one, two):
                    known.add(name)
                    keep.append(k)
                    sets.append(unique.tobytes())
            part = part.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sets, pa.binary())], names=["cluster", "n", "id", "bands", "shingles"])

    wanted = values.join(clusters, "id").select("cluster", "n", "id", "bands", "s1", "s2", F.col("first.row").alias("row"))
    texts = docs.select(_row(id_col, text_col)[1], F.col(text_col).alias("text"))
    sets = texts.join(wanted, "row").select("cluster", "n", "id", "bands", "s1", "s2", "text")
    sets = sets.mapInArrow(stage(shingled), "cluster long, n long, id long, bands array<long>, shingles binary")
    whole = [F.lit(-1).alias("band"), F.col("id").alias("label"), "id", "bands", "shingles"]
    large = not sizes.where(F.col("n") > LARGEST).isEmpty()
    if not large:
        links = saved(_in_chunks(sets.select("cluster", "n", *whole), "cluster", similarity))
    else:
        sets = saved(sets)
        links = _in_chunks(sets.where(F.col("n") <= LARGEST).select("cluster", "n", *whole), "cluster", similarity)
        links = saved(links.union(_large(sets.where(F.col("n") > LARGEST), shards, values, similarity)))
    groups = components(links, "a", "b").withColumnRenamed("node", "id")
    return found, values.join(groups, "id", "left").select("s1", "s2", "first", F.coalesce("component", "id").alias("component"))


def _large(sets: DataFrame, shards: DataFrame, values: DataFrame, similarity: float) -> DataFrame:
    """Links among the members of large clusters, shard by shard."""
    shards = saved(shards.join(sets.select("id").distinct(), "id").join(values.select("id", "size"), "id"))
    heads = shards.groupBy("band", "key").agg(F.min("id").alias("leader"))
    pairs = saved(shards.join(heads, ["band", "key"]).where("id != leader").select("leader", "id").distinct())
    counts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / LARGEST).alias("salts"))
    single = sets.select("id", "bands", "shingles").dropDuplicates(["id"])
    members = pairs.join(counts, "leader").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))).join(single, "id")
    own = counts.join(single, F.col("leader") == F.col("id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    both = own.select("leader", "salt", F.lit(0).alias("member"), "id", "shingles").union(members.select("leader", "salt", F.lit(1).alias("member"), "id", "shingles"))
    both = both.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "member")
    star = saved(both.mapInArrow(stage(starred(similarity)), "a long, b long"))
    labels = components(star, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("label"))
    shards = saved(shards.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")))
    still = shards.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("band", "key")
    length = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / F.lit(1.000001 * -np.log(similarity)))
    rest = shards.join(still, ["band", "key"]).withColumn("length", F.explode(F.array(length, length + 1)))
    rest = saved(rest.select(F.xxhash64("band", "key", "length").alias("shard"), "band", "label", "id"))
    counts = rest.groupBy("shard").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
    rest = rest.join(counts.select("shard", "n"), "shard").join(single, "id")
    return star.union(_in_chunks(rest.select("shard", "n", "band", "label", "id", "bands", "shingles"), "shard", similarity))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id_col`` and ``component_id`` (the smallest id of its group) for each row with an id.

    Two rows link if the sets of their word shingles have at least the Jaccard similarity. Candidates share a class of
    near fingerprints or a band of minimum hashes (a pair of similarity 0.8 misses all bands once in 5,500); every pair of candidates is
    settled on whole shingle sets, or known to be linked already. Equal sets are one value from the start. Rows of equal id are rows of their own; rows with a null
    id link others, and are left out of the result.
    """
    found, values = _values(docs, words, similarity, id_col, text_col)
    least = values.groupBy("component").agg(F.min("first.doc").alias("component_id"))
    named = values.join(least, "component").select("s1", "s2", "component_id")
    return found.where(F.col("doc") != _NO_ID).join(named, ["s1", "s2"]).select(F.col("doc").alias(id_col), "component_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group, with all columns of ``docs``: the row with the smallest id (a null id is the largest).

    Rows are told apart by id and text, so a text that stands under the id of another group's member stays, and copies leave one
    row whether or not they have ids. Of rows with equal id and text any one stays.
    """
    found, values = _values(docs, words, similarity, id_col, text_col)
    stay = values.groupBy("component").agg(F.min("first").alias("first")).select("first.row")
    twice = found.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row", F.lit(True).alias("twice"))
    stay = saved(stay.distinct().join(twice, "row", "left"))
    name, first, again = (f"{kind} {uuid.uuid4().hex}" for kind in ("row", "first", "again"))
    named = stay.select(F.col("row").alias(first), F.col("twice").alias(again))
    joined = docs.withColumn(name, _row(id_col, text_col)[1]).join(named, F.col(name) == F.col(first))
    alone = joined.where(F.col(again).isNull()).drop(name, first, again)
    if stay.where("twice").isEmpty():
        return alone
    return alone.union(joined.where(F.col(again)).dropDuplicates([name]).drop(name, first, again))


class BKTree:
    """Burkhard-Keller tree over unsigned 64-bit fingerprints."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert a fingerprint (repeats too) and return its place."""
        place = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while place:
            apart = (value ^ self.values[at]).bit_count()
            child = self.children[at].setdefault(apart, place)
            if child == place:
                break
            at = child
        return place

    def search(self, value: int, radius: int) -> list[tuple[int, int]]:
        """Places and distances within the radius."""
        found, stack = [], [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            at = stack.pop()
            apart = (value ^ values[at]).bit_count()
            if apart <= radius:
                found.append((at, apart))
            edges = children[at]
            if edges:
                if len(edges) <= 2 * radius + 1:
                    stack += [child for edge, child in edges.items() if -radius <= edge - apart <= radius]
                else:
                    stack += [edges[edge] for edge in range(apart - radius, apart + radius + 1) if edge in edges]
        return found


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Places of linked values that span every component of the radius graph, from one BK-tree."""
    tree, parent, links = BKTree(), list(range(len(values))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for place, value in enumerate(values):
        for other, _ in tree.search(value, radius):
            a, b = root(place), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((other, place))
        tree.add(value)
    return links


def block_masks(radius: int, blocks: int) -> list[int]:
    """Signed masks, one for each choice of the blocks that agree."""
    from itertools import combinations

    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [signed(sum(chosen)) for chosen in combinations(parts, blocks - radius)]


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Column arrays of each run of rows with equal keys (the first columns), over batch borders; runs of one row are passed over."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(held, columns, strict=True)]
        change = np.zeros(len(columns[0]) - 1, dtype=bool)
        for column in columns[:keys]:
            change |= column[1:] != column[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        sizes = np.diff(starts)
        for start, size in zip(starts[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            yield [c[start : start + size] for c in columns]
        held = [c[starts[-1] :] for c in columns]
    if held is not None and len(held[0]) > 1:
        yield held


def linked(prints: DataFrame, radius: int = 2, blocks: int = 6, id_col: str = "doc_id") -> DataFrame:
    """Columns ``id_col``, ``fp`` and ``component_id`` for each row of ``prints``.

    Fingerprints link if at most ``radius`` bits differ; ``component_id`` is the smallest id reachable (null
    where every reachable row's id is null). Equal fingerprints are collapsed first, by an aggregation with
    map-side combine, so a group of copies is one value here whatever its size. The tree of a shard holds
    distinct values that agree on all but ``radius`` blocks, at most 2 ** (64 * radius / blocks) of them.
    """
    prepare(prints.sparkSession)
    prints = saved(prints)
    values = prints.groupBy("fp").agg(F.min(id_col).alias("rep"))
    masks = block_masks(radius, blocks)
    rows = values.select(
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(mask)) for mask in masks])).alias("band", "key"), "fp"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[int] = []
        right: list[int] = []
        for _, _, prints_ in grouped(batches, 2):
            names = prints_.tolist()
            for a, b in spanning_links(prints_.view(np.uint64).tolist(), radius):
                left.append(names[a])
                right.append(names[b])
            if len(left) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    edges = rows.repartition("band", "key").sortWithinPartitions("band", "key", "fp").mapInArrow(stage(run), "a long, b long")
    nodes = components(edges, "a", "b")
    named = values.join(nodes, values["fp"] == nodes["node"], "left").select(F.col("fp").alias("value"), "rep", "component")
    least = named.where("component is not null").groupBy(F.col("component").alias("of")).agg(F.min("rep").alias("least"))
    named = named.join(least, F.col("component") == F.col("of"), "left")
    named = named.select("value", F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(named, prints["fp"] == named["value"]).select(id_col, "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """16 lower-case hex digits of a signed long's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
