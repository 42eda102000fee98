"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

#: Bytes of text that one output batch of a Python stage is built from.
SLICE_BYTES = 4 << 20
#: Rows and bytes that Spark hands to a Python stage at a time (its own default of 64 MiB is held twice: in the JVM and in Python).
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Folder of each table written by ``saved``, and all of them that are still there.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_OPEN: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, keep their input batches small, and see to a checkpoint folder.

    ``spark.checkpoint.dir`` of the session wins. A machine-local folder takes its place on a local master only;
    elsewhere executors would not share it, which is an error.
    """
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = context.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        context.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="sparkmeter-checkpoints-")
        context.setCheckpointDir(folder)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared checkpoint folder; what is written there goes when the driver ends."""
    prepare(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    file_system, place = _on_disk(spark, path)
    file_system.mkdirs(place.getParent())
    file_system.deleteOnExit(place)
    return path


def _on_disk(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written to the shared checkpoint folder; it survives lost executors.

    Parquet takes half of the room that the rows of an RDD checkpoint take.
    """
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[found] = path
    _OPEN.add(path)
    return found


def discard(df: DataFrame) -> None:
    """Delete the folder of a table made by ``saved`` that nothing will read again; other frames are left alone."""
    if path := _FOLDERS.pop(df, None):
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the checkpoint folder."""
    file_system, place = _on_disk(spark, path)
    file_system.delete(place, True)
    _OPEN.discard(path)


def open_tables() -> set[str]:
    """Folders of the tables that ``saved`` wrote and that are still there."""
    return set(_OPEN)


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the strings of a column make about ``limit`` bytes in each; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = 0
        while at < batch.num_rows:
            rows, size = 0, 0
            values = batch.column(column)
            step = max(1, min(batch.num_rows - at, 256))
            while at + rows < batch.num_rows and (size < limit or not rows):
                part = values.slice(at + rows, step)
                size += part.nbytes if rows else 0
                if not rows:
                    size = part.nbytes
                    if size > limit and step > 1:
                        step = max(1, step // 4)
                        continue
                rows += len(part)
            yield batch.slice(at, rows)
            at += rows


def tidy() -> None:
    """Give memory that is free back to the system: idle worker processes stay alive beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def stage(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A Python stage that tidies up at the end of each task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return whole


def over_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: list[StructField] | None = None) -> DataFrame:
    """A Python stage over all columns of ``docs``, whatever their names; it gives them back, with ``more`` columns after them."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    fields = [StructField(name, field.dataType) for name, field in zip(names, docs.schema.fields, strict=True)]
    new = [StructField(f"m{i}", field.dataType) for i, field in enumerate(more or [])]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=[*names, *[f.name for f in new]])

    return docs.toDF(*names).mapInArrow(stage(renamed), StructType([*fields, *new])).toDF(*docs.columns, *[f.name for f in more or []])


def text_bytes(value: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return value.encode("utf-8", "surrogatepass") if value else b""
