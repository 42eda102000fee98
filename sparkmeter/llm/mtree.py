"""Exact top-k by inner product with M-trees.

Components are turned into integers, so scores are exact. A vector x becomes the point (x, sqrt(M - |x|^2))
with M the largest squared length of all; for a query (q, 0) the squared distance is ``|q|^2 + M - 2 q.x``: the
nearest point has the highest score, and the metric has the triangle inequality. An M-tree keeps points in
pages; an entry of an inner page has a routing point, the covering radius of its subtree and the distance to its
parent's routing point. Search is best-first over pages by their lower bound; entries whose stored parent
distance already puts them out of reach are skipped without computing a distance.

Equal vectors are one point that names its k + 1 smallest ids (a limit that takes effect before the shuffle), which
is all that any query can return of them. The top level of the index is distributed: points go to the nearest
of at most ``PIVOTS`` routing points, and a region of many points is cut into shards of bounded size, each with a
tree of its own. A query vector visits one shard of its nearest region first; the score it finds there bounds the
reach with which it visits those other shards whose region's covering radius comes into it. Where many queries
visit a shard, they do so in blocks, each with a copy of the shard's points.

Results for odd input: vectors that are null, or hold null or non-finite components, take no part, as query or
as candidate; an empty vector is all zeros, and a shorter one is filled up with zeros; every row is a candidate of
its own, rows of one id too, and a query is not its own candidate; a row with a null id is a candidate (after equal
scores with an id) and no query; ties go to the smaller id; with fewer than k candidates all are returned. Scores
are exact while they fit a long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, saved, stage

#: Points in a page and in a shard, query vectors that visit a copy of a shard, regions.
PAGE, SHARD_ROWS, QUERY_BLOCK, PIVOTS = 128, 16_384, 8_192, 1024
#: Stands for a null id; it comes after all others.
NO_ID = (1 << 63) - 1


class Page:
    """A page of the tree: a leaf holds points, an inner page holds routing entries."""

    __slots__ = ("children", "members", "points", "radii", "to_parent")

    def __init__(self, points: np.ndarray, to_parent: np.ndarray, radii: np.ndarray | None, children: list | None, members: np.ndarray | None):
        self.points, self.to_parent, self.radii, self.children, self.members = points, to_parent, radii, children, members


def points_of(vectors: np.ndarray, most: float) -> np.ndarray:
    """The vectors with the coordinate that makes all of them as long as the longest."""
    squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
    return np.hstack([vectors.astype(np.float64), np.sqrt(np.maximum(most - squares, 0.0))[:, None]])


class MTree:
    """M-tree over the rows of an integer matrix with their ids; ``most`` is at least the largest squared length."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, page: int = PAGE, most: float | None = None):
        self.ids, self.page = ids, page
        squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.most = most if most is not None else float(squares.max()) if len(vectors) else 0.0
        small = not len(vectors) or float(squares.max()) < 2.0**50
        self.vectors = vectors.astype(np.float64) if small else vectors  # products of short vectors are exact in doubles
        self.points = points_of(vectors, self.most)
        self.rng = np.random.default_rng(1)
        self.root = self._build(np.arange(len(vectors)), None) if len(vectors) else None
        self.computed = self.skipped = 0

    @staticmethod
    def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.sqrt(((points - to) ** 2).sum(axis=1))

    def _build(self, rows: np.ndarray, parent: np.ndarray | None) -> Page:
        """Bulk load: routing points are drawn, rows go to the nearest, each part becomes a subtree."""
        points = self.points[rows]
        if len(rows) <= self.page:
            away = self._distances(points, parent) if parent is not None else np.zeros(len(rows))
            order = np.argsort(away, kind="stable")
            return Page(points[order], away[order], None, None, rows[order])
        count = min(self.page, -(-len(rows) // self.page))
        routes = points[self.rng.choice(len(rows), count, replace=False)]
        squared = (points**2).sum(1)[:, None] - 2 * points @ routes.T + (routes**2).sum(1)[None]
        owner = squared.argmin(axis=1)
        sizes = np.bincount(owner, minlength=count)
        if sizes.max() == len(rows):  # all alike: cut evenly
            owner = np.arange(len(rows)) * count // len(rows)
            routes = routes[[0] * count]
        used = np.unique(owner)
        children, radii = [], []
        for k in used:
            own = rows[owner == k]
            children.append(self._build(own, routes[k]))
            radii.append(self._distances(self.points[own], routes[k]).max())
        routes = routes[used]
        away = self._distances(routes, parent) if parent is not None else np.zeros(len(routes))
        return Page(routes, away, np.array(radii), children, None)

    def reach_of(self, query: np.ndarray, score: int) -> float:
        """The distance at which a point has this score."""
        return float(np.sqrt(max(float(query.astype(np.float64) @ query) + self.most - 2.0 * score, 0.0)))

    def search(self, query: np.ndarray, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, place), the best first, ties to the smaller id; points that score under ``least`` may be left out."""
        if self.root is None:
            return []
        small = self.vectors.dtype == np.float64 and float((query.astype(np.float64) ** 2).sum()) < 2.0**50
        asked = query.astype(np.float64) if small else query
        target = np.append(query.astype(np.float64), 0.0)
        base = float(target @ target) + self.most
        best: list[tuple[int, int, int]] = []  # heap of (score, -id, place)
        reach = np.inf if least is None else self.reach_of(query, least)
        slack = 1e-6 * (1 + np.sqrt(base + self.most))  # rounding of distances
        heap: list[tuple[float, int, Page, float | None]] = [(0.0, 0, self.root, None)]
        serial = 1
        while heap:
            bound, _, page, parent_away = heapq.heappop(heap)
            if bound > reach + slack:
                break
            if parent_away is None or reach == np.inf:
                near = np.arange(len(page.points))
            else:
                reached = page.radii if page.radii is not None else 0.0
                near = np.flatnonzero(np.abs(parent_away - page.to_parent) - reached <= reach + slack)
                self.skipped += len(page.points) - len(near)
            if not len(near):
                continue
            self.computed += len(near)
            if page.children is None:
                rows = page.members[near]
                scores = (self.vectors[rows] if small else self.vectors[rows].astype(np.int64)) @ asked
                if len(best) == k:
                    keep = scores >= best[0][0]
                    rows, scores = rows[keep], scores[keep]
                if len(rows) > k:
                    order = np.lexsort((self.ids[rows], -scores))[:k]
                    rows, scores = rows[order], scores[order]
                for score, name, row in zip(scores.tolist(), self.ids[rows].tolist(), rows.tolist(), strict=True):
                    if len(best) < k:
                        heapq.heappush(best, (int(score), -name, row))
                    elif (score, -name) > best[0][:2]:
                        heapq.heapreplace(best, (int(score), -name, row))
                if len(best) == k:
                    reach = min(reach, np.sqrt(max(base - 2.0 * best[0][0], 0.0)))
            else:
                away = self._distances(page.points[near], target)
                lows = np.maximum(away - page.radii[near], 0.0)
                for i, low, far in zip(near.tolist(), lows.tolist(), away.tolist(), strict=True):
                    if low <= reach + slack:
                        heapq.heappush(heap, (low, serial, page.children[i], far))
                        serial += 1
        return [(score, row) for score, _, row in sorted(best, key=lambda b: (-b[0], -b[1]))]


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x) of the double x; null for a vector that takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    ints = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return F.when(vector.isNull() | bad, F.lit(None)).otherwise(ints)


def _matrix(vectors: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector[:width]
    return out


class Regions:
    """The top level of the index: routing points, covering radii, and the shards of each region."""

    def __init__(self, pivots: np.ndarray, most: float, width: int):
        self.pivots, self.most, self.width = points_of(pivots, most), most, width
        self.radii = np.zeros(len(pivots))
        self.first = np.zeros(len(pivots), np.int64)
        self.shards = np.zeros(len(pivots), np.int64)

    def away(self, points: np.ndarray) -> np.ndarray:
        """Distances of some points to all routing points."""
        squared = (points**2).sum(1)[:, None] - 2 * points @ self.pivots.T + (self.pivots**2).sum(1)[None]
        return np.sqrt(np.maximum(squared, 0.0))

    def slack(self) -> float:
        return 1e-6 * (1 + np.sqrt(self.most))


def _point_rows(known: DataFrame, regions: Regions) -> DataFrame:
    """pid, region and distance to its routing point of each point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = regions.away(points_of(_matrix(batch.column(1).to_pylist(), regions.width), regions.most))
            region = away.argmin(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            least = away[np.arange(batch.num_rows), region] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(region, pa.int64()), pa.array(least, pa.float64())], names=["pid", "region", "away"])

    return known.select("pid", "v").mapInArrow(stage(run), "pid long, region long, away double")


def _visits(queries: DataFrame, regions: Regions, first: bool) -> DataFrame:
    """Shards that each query vector (pid, v, least: the score to beat or null) visits: one of its nearest region, or all others in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1).to_pylist(), regions.width)
            flat = np.hstack([vectors.astype(np.float64), np.zeros((len(vectors), 1))])
            away = regions.away(flat)
            away[:, regions.shards == 0] = np.inf
            rows, shards = [], []
            for row, (pid, least) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                nearest = int(away[row].argmin())
                own = int(regions.first[nearest] + pid % regions.shards[nearest])
                if first:
                    near = [own]
                else:
                    base = float((flat[row] ** 2).sum()) + regions.most
                    reach = np.inf if least is None else np.sqrt(max(base - 2.0 * least, 0.0)) + 1e-6 * (1 + np.sqrt(base))
                    within = np.flatnonzero((regions.shards > 0) & (away[row] - regions.radii <= reach + regions.slack()))
                    near = [x for r in within.tolist() for x in range(regions.first[r], regions.first[r] + regions.shards[r]) if x != own]
                rows += [row] * len(near)
                shards += near
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), *[batch.column(i).take(at) for i in (0, 1, 2)]], names=["shard", "pid", "v", "least"])

    return queries.select("pid", "v", "least").mapInArrow(stage(run), "shard long, pid long, v array<long>, least long")


def _found(points: DataFrame, visits: DataFrame, k: int, most: float, width: int, query_block: int) -> DataFrame:
    """The k best rows (pid of the query vector, score, id, pid of the candidate's vector) of each visit."""
    visits = saved(visits)
    blocks = saved(visits.groupBy("shard").agg(F.ceil(F.count("*") / query_block).alias("blocks")))
    total = max(1, blocks.agg(F.sum("blocks").alias("n")).first()["n"] or 0)
    none = F.lit(None)
    asks = visits.join(blocks, "shard").select("shard", F.pmod(F.xxhash64("pid"), "blocks").alias("block"), F.lit(1).alias("kind"), "pid", "v", none.cast("array<long>").alias("ids"), "least")
    data = points.join(blocks, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "pid", "v", "ids", none.cast("long").alias("least"))
    names = ["pid", "score", "id", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pids, ids, vectors, tree = None, [], [], [], None
        for batch in batches:
            out: list[tuple] = []
            for shard, block, kind, pid, vector, own, least in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (shard, block) != now:
                    now, pids, ids, vectors, tree = (shard, block), [], [], [], None
                if kind == 0:
                    pids.append(pid)
                    ids.append(own)
                    vectors.append(vector)
                    continue
                if tree is None:
                    tree = MTree(_matrix(vectors, width), np.array([x[0] for x in ids], np.int64), most=most)
                    vectors = []
                best = []
                for score, place in tree.search(_matrix([vector], width)[0], k, least):
                    best += [(-score, name, pids[place]) for name in ids[place]]
                out += [(pid, -score, name, place) for score, name, place in sorted(best)[:k]]
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)

    dealt = data.union(asks).repartitionByRange(total, "shard", "block").sortWithinPartitions("shard", "block", "kind")
    return dealt.mapInArrow(stage(run), "pid long, score long, id long, found long")


def top_k(rows: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), ``id_col`` and score of the k best rows for each row that ``queries`` picks."""
    prepare(rows.sparkSession)
    known = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), whole_numbers(F.col(vector_col), scale).alias("v"), (F.coalesce(queries, F.lit(False)) & F.col(id_col).isNotNull()).alias("asks"))
    known = known.where("v is not null")
    smallest = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    same = known.select("id", "v").withColumn("n", smallest).where(F.col("n") <= k + 1)
    same = same.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # k + 1 of them at most
    points = saved(same.withColumn("pid", F.monotonically_increasing_id()))
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    sizes = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(square).alias("most")).first()
    width, most = sizes["width"] or 0, sizes["most"] or 0.0
    wanted = max(1, min(PIVOTS, -(-sizes["n"] // shard_rows)))
    drawn = points.orderBy(F.xxhash64("v"), "pid").limit(wanted).select("v").collect()  # PIVOTS of them at most
    regions = Regions(_matrix([r["v"] for r in drawn] or [[]], width), most, width)
    placed = saved(_point_rows(points, regions))
    for row in placed.groupBy("region").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():  # a row for each region
        regions.radii[row["region"]], regions.shards[row["region"]] = row["radius"], -(-row["n"] // shard_rows)
    regions.first = np.cumsum(regions.shards) - regions.shards
    numbers = F.array(*[F.struct(F.lit(int(a)).alias("first"), F.lit(int(n)).alias("n")) for a, n in zip(regions.first, regions.shards, strict=True)])
    at = F.element_at(numbers, F.col("region").cast("int") + 1)
    shard = (at["first"] + F.pmod(F.xxhash64("pid"), F.greatest(at["n"], F.lit(1)))).cast("long")
    in_shards = points.join(placed.select("pid", shard.alias("shard")), "pid")
    own = saved(known.where("asks").select(F.col("id").alias("query_id"), "v").join(points.select("pid", "v"), "v").select("query_id", "pid"))
    asking = points.join(own.select("pid").distinct(), "pid", "left_semi").select("pid", "v")
    first = saved(_found(in_shards, _visits(asking.withColumn("least", F.lit(None).cast("long")), regions, True), k + 1, most, width, query_block))
    bound = first.groupBy("pid").agg(F.when(F.count("*") > k, F.min("score")).alias("least"))
    rest = _found(in_shards, _visits(asking.join(bound, "pid", "left"), regions, False), k + 1, most, width, query_block)
    order = Window.partitionBy("pid").orderBy(F.col("score").desc(), "id", "found")
    best = first.union(rest).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    best = best.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("n", "score", "id", "found"))).alias("best"))  # k + 1 of them at most
    mine = F.filter("best", lambda b: (b["id"] == F.col("query_id")) & (b["found"] == F.col("pid")))
    place = F.coalesce(F.try_element_at(mine, F.lit(1))["n"], F.lit(k + 1))  # the query itself, else the last
    others = F.slice(F.filter("best", lambda b: b["n"] != F.when(F.size("best") > k, place).otherwise(F.coalesce(F.try_element_at(mine, F.lit(1))["n"], F.lit(0)))), 1, k)
    ranked = own.join(best, "pid").select("query_id", F.posexplode(others).alias("rank", "b"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.nullif(F.col("b.id"), F.lit(NO_ID)).alias(id_col), F.col("b.score").alias("score"))
