"""At-least-once publishing with an outbox, made idempotent by key and content hash."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Versions

#: Answers that count as delivered besides 2xx: the other side has it already.
CONFLICT = 409


def content_hash(payload: dict) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass
class Publisher:
    """Sends (source id, endpoint, payload); failures go to the outbox in order and later sends wait behind them."""

    post: Callable[[str, dict], int]
    delivered: dict[tuple[str, str], str] = field(default_factory=dict)
    outbox: list[tuple[str, str, dict]] = field(default_factory=list)
    offline: bool = False

    def send(self, source: str, endpoint: str, payload: dict) -> bool:
        digest = content_hash(payload)
        if self.delivered.get((source, endpoint)) == digest:
            return True
        if not self.offline and self._try(endpoint, payload):
            self.delivered[source, endpoint] = digest
            return True
        self.offline = True
        self.outbox = [e for e in self.outbox if e[:2] != (source, endpoint)] + [(source, endpoint, payload)]
        return False

    def flush(self) -> int:
        """Try the outbox in order until one fails; how many went."""
        self.offline, sent = False, 0
        while self.outbox:
            source, endpoint, payload = self.outbox[0]
            if not self._try(endpoint, payload):
                self.offline = True
                break
            self.delivered[source, endpoint] = content_hash(payload)
            self.outbox.pop(0)
            sent += 1
        return sent

    def _try(self, endpoint: str, payload: dict) -> bool:
        try:
            status = self.post(endpoint, payload)
        except OSError:
            return False
        return 200 <= status < 300 or status == CONFLICT


_OUTBOX = "created_at string, source_id string, endpoint string, session string, mutable boolean, turn long, stage long, revision long, body string"
_LINE = f"{_OUTBOX}, content_hash string"
_DELIVERED = "source_id string, endpoint string, content_hash string, session string, turn long, stage long, revision long, bucket int"
#: Buckets that what was delivered is dealt into by session, and delta files of a bucket from which they are merged.
BUCKETS, DELTAS = 64, 16


def canonical_hash(body: Column) -> Column:
    """Hash of a JSON text whatever the order of its keys and its white space; a text that is no JSON is hashed as it is."""
    return F.sha2(F.coalesce(F.to_json(F.try_parse_json(body)), body), 256)


def pending(outbox: DataFrame, delivered: DataFrame) -> DataFrame:
    """What is still to be sent.

    No content twice; of one source at one endpoint the newest version only; and of mutable endpoints nothing that is older than what
    was delivered of its session. What waits in line never holds back other turns of its session.
    """
    version = F.struct("turn", "stage", "revision")
    rows = outbox.withColumn("content_hash", canonical_hash(F.col("body")))
    rows = rows.join(delivered.select("source_id", "endpoint", "content_hash").distinct(), ["source_id", "endpoint", "content_hash"], "left_anti")
    named = [c for c in rows.columns if c not in ("source_id", "endpoint")]
    newest = F.max_by(F.struct(*named), F.struct("turn", "stage", "revision", "created_at", "content_hash")).alias("newest")
    rows = rows.groupBy("source_id", "endpoint").agg(newest).select("source_id", "endpoint", "newest.*")
    seen = delivered.groupBy("session", "endpoint").agg(F.max(version).alias("_seen"))
    rows = rows.join(seen, ["session", "endpoint"], "left")
    stale = F.col("mutable") & F.coalesce(version < F.col("_seen"), F.lit(False))
    return rows.where(~stale).select(*outbox.columns, "content_hash")


class Outbox:
    """A durable outbox under a folder that all executors share.

    * ``line/v=N``: what waits after batch N, and nothing else: a batch reads the last of these, whatever was sent before.
    * ``delivered/bucket=B``: what went, by a hash of the session. A batch reads the buckets of its own sessions; the
      small files that batches add to a bucket are merged when there are ``DELTAS`` of them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.line = Versions(spark, f"{self.folder}/line", _LINE)

    def delivered(self, buckets: list[int] | None = None) -> DataFrame:
        """What was delivered, of some buckets or of all."""
        if not self.line.names(f"{self.folder}/delivered"):
            return self.spark.createDataFrame([], _DELIVERED)
        rows = self.spark.read.schema(_DELIVERED).parquet(f"{self.folder}/delivered")
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def put(self, rows: DataFrame, number: int) -> DataFrame:
        """The line after a batch came in; of a batch that is repeated the same."""
        waiting = self.line.read(number).drop("content_hash").unionByName(rows)
        buckets = sorted(r[0] for r in waiting.select(_bucket()).distinct().collect())  # BUCKETS at most
        return self.line.write(pending(waiting, self.delivered(buckets)), number)

    def waiting(self, number: int) -> int:
        """How many entries of a batch's line were not delivered."""
        return self.line.read(number + 1).join(self.delivered(), ["source_id", "endpoint", "content_hash"], "left_anti").count()

    def sent(self, rows: list[tuple]) -> None:
        """Note what was delivered; buckets with many small files are merged."""
        frame = self.spark.createDataFrame(rows, _DELIVERED.replace(", bucket int", "")).withColumn("bucket", _bucket())
        frame.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/delivered")
        touched = sorted(r["bucket"] for r in frame.select("bucket").distinct().collect())
        full = [b for b in touched if sum(n.startswith("part-") for n in self.line.names(f"{self.folder}/delivered/bucket={b}")) >= DELTAS]
        if full:
            merged = self.delivered(full).distinct().repartition("bucket")
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/delivered")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("session"), F.lit(BUCKETS)).cast("int").alias("bucket")


def publish_batch(folder: str, post: Callable[[str, dict], int], limit: int = 1000) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over an ``Outbox``: nothing is lost, and after a restart nothing that was delivered is sent again.

    A batch joins the line before anything is sent, so that a repeated batch changes nothing. Entries go in order of
    time and source, ``limit`` of them at most at once; the first failure ends the batch, the rest waits.
    """

    def run(batch: DataFrame, number: int) -> None:
        outbox = Outbox(batch.sparkSession, folder)
        left = outbox.put(batch, number)
        sent = []
        for row in left.orderBy("created_at", "source_id", "endpoint").limit(limit).collect():  # bounded by the limit
            try:
                status = post(row["endpoint"], json.loads(row["body"]))
            except OSError:
                break
            if not (200 <= status < 300 or status == CONFLICT):
                break
            sent.append(tuple(row[c.split()[0]] for c in _DELIVERED.split(", ")[:-1]))
        if sent:
            outbox.sent(sent)

    return run
