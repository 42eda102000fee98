"""Session settings that the engine's results depend on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",  # day buckets are local days of this zone
    "spark.sql.variant.allowDuplicateKeys": "true",  # the last of repeated JSON keys wins
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",  # maps in the state, and state beyond memory
    "spark.sql.codegen.hugeMethodLimit": "8000",  # HotSpot does not compile longer methods; Spark then splits the code into shorter ones
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",  # compressed; a task sorts several times as much
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


#: Settings for speed alone, that a session made elsewhere is given too.
PACE = ("spark.sql.codegen.hugeMethodLimit", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
#: Bytes of input files for each partition of a shuffle (before AQE joins small ones), so that a task's sort does not grow with the input.
INPUT_PER_PARTITION = 4 << 20


def prepare(spark: SparkSession, input_bytes: int = 0) -> None:
    """Give a session that was made elsewhere the settings that bound a query's cost, and shuffles partitions by the size of the input."""
    for key in PACE:
        spark.conf.set(key, SETTINGS[key])
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(least, input_bytes // INPUT_PER_PARTITION)))


def session(app: str = "sparkmeter", **more: str) -> SparkSession:
    """A session with the engine's settings; ``more`` overrides them (underscores stand for dots)."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def durable(rows: DataFrame) -> DataFrame:
    """Rows written to the checkpoint folder, so that what is built on them computes them once and a lost executor costs its tasks only.

    The folder is the session's; only on a local master one of this machine takes its place where none is named.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sparkmeter-checkpoints-"))
    return rows.checkpoint()
