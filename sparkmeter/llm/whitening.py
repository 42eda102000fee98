"""Whitening of embeddings by a two-pass covariance.

Entries are scaled and floored to integers. The fit list holds each distinct integer vector once; from it

1. a first pass takes the count and the exact integer sum of each dimension;
2. a second pass sums the outer products of the centred vectors, one matrix product (GEMM) for each batch;
3. LAPACK's symmetric solver takes the covariance apart on the driver; only numbers of the size of the
   dimension, squared, come there, whatever the number of rows;
4. a third pass measures the covariance of the whitened fit list, so the error that is told is measured;
5. the projection is broadcast (dimension times components) and applied to every row without a shuffle.

Partial sums of the tasks meet in ``treeAggregate``; the fit list is written to the shared checkpoint folder,
so all passes see the same rows and a lost executor costs its tasks only. A group of copies is one vector
after the map side of the distinct aggregation, whatever its size.

Results for odd input: rows whose vector is null or empty, or holds a null, a NaN or an infinity, are left out, and so
are rows whose vector has another length than most of the fit list (ties: the longer). Entries beyond a long
count as the nearest long that a double can hold. A null id stays null, repeated rows each give rows, other columns are not
carried over. Components without variance (copies only, one vector, dependent dimensions) have a null
``whitened``; ``explained`` is null where no dimension varies; ``identity_error`` covers the components with variance and is
null if there are none. An empty table gives an empty result. ``deviation`` is null where it has more than 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, saved, stage

SCALE, COMPONENTS = 256, 4
#: Integer types that a packed vector can have; the first byte of a packed vector is a place in this list.
WIDTHS = [np.dtype("<i1"), np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8")]
MOST = float(2**63 - 1024)


class Whitening(NamedTuple):
    """What a fit gives: size of the fit list, exact sums, eigenvalues and unit eigenvectors (columns), trace, measured error."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None


def quantised(column: pa.ListArray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer matrix of the whole vectors of a batch, for each length that occurs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.array([0 if size is None else size for size in column.value_lengths().to_pylist()], np.int64)
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        found = entries[starts[rows][:, None] + np.arange(size)]
        whole = np.isfinite(found).all(axis=1)
        if whole.any():
            yield rows[whole], np.clip(np.floor(scale * found[whole]), -MOST - 1024, MOST).astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row of a matrix in the narrowest integer type that holds it, so equal vectors are equal bytes."""
    code = np.zeros(len(x), np.int64)
    low, high = x.min(axis=1), x.max(axis=1)
    for width in WIDTHS[:-1]:
        limit = np.iinfo(width)
        code += (low < limit.min) | (high > limit.max)
    out = [b""] * len(x)
    for k in np.unique(code).tolist():
        for row in np.flatnonzero(code == k).tolist():
            out[row] = bytes([k]) + x[row].astype(WIDTHS[k]).tobytes()
    return out


def unpacked(rows: list[bytes], size: int) -> np.ndarray:
    """Integer matrix of packed vectors."""
    x = np.empty((len(rows), size), np.int64)
    for i, row in enumerate(rows):
        x[i] = np.frombuffer(row, WIDTHS[row[0]], offset=1)
    return x


def fit_list(vectors: DataFrame, scale: int = SCALE, vector_col: str = "embedding") -> DataFrame:
    """Each distinct integer vector once: ``size`` and packed ``x``."""
    prepare(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in quantised(batch.column(0), scale):
                own = list(dict.fromkeys(packed(x)))
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(own), pa.int32()), pa.array(own, pa.binary())], names=["size", "x"])

    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(stage(run), "size int, x binary").distinct()


def _plus(a: list, b: list) -> list:
    """Sum of two lists of partial results, entry by entry; an empty list is nothing."""
    return [x + y for x, y in zip(a, b, strict=True)] if a and b else a or b


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, with the whole part of the mean taken off before anything is rounded."""
    if x.size and max(-int(x.min()), int(x.max())) >= 2**62:  # a difference of two such numbers may not fit
        return x.astype(np.float64) - np.array([s / n for s in sums])
    whole, rest = zip(*[divmod(s, n) for s in sums], strict=True)
    return (x - np.array(whole, np.int64)).astype(np.float64) - np.array([r / n for r in rest])


def fit(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, vector_col: str = "embedding") -> Whitening | None:
    """The whitening of a table of vectors; None where no row has a whole vector."""
    listed = saved(fit_list(vectors, scale, vector_col))
    lengths = listed.groupBy("size").agg(F.count("*").alias("n"))
    most = lengths.agg(F.max(F.struct("n", "size")).alias("most")).first()["most"]
    if most is None:
        discard(listed)
        return None
    n, size = int(most["n"]), int(most["size"])
    own = listed.where(F.col("size") == size).select("x")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            if batch.num_rows:
                yield unpacked(batch.column(0).to_pylist(), size)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for x in matrices(batches):  # upper and lower half apart: no sum of a batch can overflow
            upper, lower = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (u << 32) + v for t, u, v in zip(total, upper, lower, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([[str(t) for t in total]], pa.list_(pa.string()))], names=["part"])

    parts = own.mapInArrow(stage(added), "part array<string>").rdd.map(lambda row: [int(t) for t in row["part"]])
    sums = parts.treeAggregate([], _plus, _plus)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for x in matrices(batches):
            z = centred(x, n, sums)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = own.mapInArrow(stage(products), "part binary").rdd.map(lambda row: [np.frombuffer(row["part"])])
    covariance = parts.treeAggregate([], _plus, _plus)[0].reshape(size, size) / n
    covariance = (covariance + covariance.T) / 2
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    none = values <= size * np.finfo(np.float64).eps * max(values[0], 0)
    values = np.where(none, 0, values)[:components]
    axes = axes[:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    model = Whitening(n, sums, values, axes, float(np.trace(covariance)), None)
    scaled = projection(model)
    varied = int((values > 0).sum())

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for x in matrices(batches):
            w = centred(x, n, sums) @ scaled[:, :varied]
            mean = w.mean(axis=0)
            w -= mean
            held = merged(held, (len(w), mean, w.T @ w))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), *[pa.array([m.tobytes()], pa.binary()) for m in held[1:]]], names=["n", "mean", "part"])

    if varied:
        parts = own.mapInArrow(stage(moments), "n long, mean binary, part binary").rdd
        parts = parts.map(lambda row: (row["n"], np.frombuffer(row["mean"]), np.frombuffer(row["part"]).reshape(varied, varied)))
        _, _, whole = parts.treeAggregate(None, merged, merged)
        model = model._replace(identity_error=float(np.abs(whole / n - np.eye(varied)).max()))
    discard(listed)
    return model


def merged(a: tuple | None, b: tuple | None) -> tuple | None:
    """Count, mean and centred products of two parts together."""
    if a is None or b is None:
        return b if a is None else a
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def projection(model: Whitening) -> np.ndarray:
    """Eigenvectors over the root of their eigenvalue; zero where there is no variance."""
    return model.vectors / np.sqrt(np.where(model.values > 0, model.values, np.inf))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over the dimensions of (n * x - sums) ** 2 for each row, exact."""
    whole, rest = zip(*[divmod(s, n) for s in sums], strict=True)
    far = max([abs(int(x.min()) - min(whole)), abs(int(x.max()) - max(whole)), abs(int(x.max()) - min(whole)), abs(int(x.min()) - max(whole))]) + 1
    if len(sums) * (n * far) ** 2 < 2**63:
        y = (x - np.array(whole, np.int64)) * n - np.array(rest, np.int64)
        return pa.array((y * y).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
    found = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return pa.array([Decimal(v) if v < 10**38 else None for v in found], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row with a whole vector and each of the first ``components`` components: ``id_col``, ``component`` (from 1), ``n``,
    ``deviation`` (decimal), ``whitened``, ``explained`` and ``identity_error``."""
    spark = vectors.sparkSession
    prepare(spark)
    kind = f"`{id_col}` long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(vectors, components, scale, vector_col)
    if model is None:
        return spark.createDataFrame([], kind)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Whitening = shared.value
        scaled, count = projection(own), len(own.values)
        explained = [float(v) / own.trace if own.trace > 0 else None for v in own.values]
        for batch in batches:
            for rows, x in quantised(batch.column(1), scale):
                if x.shape[1] != len(own.sums):
                    continue
                w = centred(x, own.n, own.sums) @ scaled
                again = pa.array(np.repeat(np.arange(len(rows)), count))
                flat = len(rows) * count
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)).take(again),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(flat, own.n)),
                        deviations(x, own.n, own.sums).take(again),
                        pa.array(w.reshape(-1), mask=np.tile(own.values <= 0, len(rows))),
                        pa.array(explained * len(rows), pa.float64()),
                        pa.array([own.identity_error] * flat, pa.float64()),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    rows = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(stage(run), kind)
