"""Quality selection by importance resampling.

Hashed n-gram generative models (words and word pairs of lower-cased text) are fitted for the target (texts
labelled good) and for each kind of raw text to be avoided (low quality, toxic): the mean rate of each n-gram in a
text, all texts counting alike. An n-gram's evidence is the log ratio of target to raw model where the two are
apart by z or more in a likelihood-ratio test of the texts that hold it or in Welch's test of the rates; other
n-grams, and those of a single text, carry none. Copies of a text are few pieces of evidence: n of them count as 1 + log2 n. A word repeated at once is the same pair for all words. A text's score for a kind is the mean evidence of its
n-grams, so neither its length nor the number of labels moves it. A quarter of the labelled texts (all
copies of a text are on one side) is held out of the models and sets, for each kind, z (one of ``ZS``, as more labels
need more) and the cut: the score under zero that leaves the fewest of them on the wrong side. The log weight is the distance to the cut, with the median rejected held-out text at
``-SPREAD``, and the least of the kinds: a text there is e ** 12 times less likely to be drawn than one at the cut.
Documents are then drawn without replacement by Gumbel top-k: key = log weight / TEMPERATURE + Gumbel noise from a
hash of the id; k is the number of documents whose log weight is at least 0. Texts near the cut are a matter of the
draw, others hardly.

The models are fitted on a bounded sample of labelled rows: the ``FIT_ROWS`` rows of smallest id hash. Scores,
the count k and the k-th key cover all rows; the k-th key comes from histograms, no global sort.

Results for odd input: a null or empty text has no n-grams, score 0, and is a candidate like any other; a
null id has a fixed noise of its own; repeated rows have equal keys and stay or go together (ties at the k-th
key all stay); labels without a document, labels without a value and documents without a label only miss from the fit; repeated labels
count as one, bad if any is; without good or without bad labels every document stays; a kind of too few texts for two
sides is fitted and cut on the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from .common import over_rows, prepare, saved, slices, stage, text_bytes

HASH_BITS, ZS, HELD, SPREAD, TEMPERATURE, FIT_ROWS, SEED = 22, (3.0, 4.0, 5.0, 6.5, 8.0), 4, 12.0, 1.0, 24_000, 17
#: Words whose hashes a worker remembers, and bytes of text that it counts at a time.
WORDS, FIT_BYTES = 250_000, 1 << 20
#: Hash of the pair of any word with itself.
REPEAT = np.uint64(0x9FB21C651E98DF25)
#: A cut under every mean of log ratios.
NEVER = -50.0
KINDS = ("target", "poor", "toxic")


class Model(NamedTuple):
    """Buckets that carry evidence, their log ratios (a column for each kind of raw text), and each kind's cut and unit."""

    buckets: np.ndarray
    ratios: np.ndarray
    cuts: np.ndarray
    units: np.ndarray


NO_MODEL = Model(np.zeros(0, np.int64), np.zeros((0, 2), np.float32), np.full(2, NEVER), np.full(2, SPREAD / -NEVER))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _Hashes()


def ngrams(text: bytes, bits: int = HASH_BITS) -> np.ndarray:
    """Buckets of a text's words and word pairs; the pairs of a word with itself share one."""
    words = text.lower().split()
    one = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    two[one[:-1] == one[1:]] = REPEAT
    return (np.concatenate([one, two]) >> np.uint64(64 - bits)).astype(np.int64)


def cut_of(good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """The score below which a text is rejected, with the fewest good and bad texts on the wrong side, and the unit of distance to it.

    It lies under zero, so that a text without evidence stays; of equally good cuts the one with the widest gap.
    """
    values, place = np.unique(np.concatenate([good, bad]), return_inverse=True)
    change = np.bincount(place[: len(good)], minlength=len(values)) - np.bincount(place[len(good) :], minlength=len(values))
    wrong = len(bad) + np.cumsum(change)  # with the cut above each value
    upper = np.minimum(np.append(values[1:], 0.0), 0.0)
    able = np.flatnonzero((values < 0) & (wrong < len(bad)))
    if not len(able):
        return NEVER, SPREAD / -NEVER
    best = min(able.tolist(), key=lambda i: (wrong[i], values[i] - upper[i]))
    cut = float(values[best] + upper[best]) / 2
    gone = bad[bad < cut]
    return cut, SPREAD / (cut - float(np.median(gone)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> Model:
    """The n-grams that carry evidence, and the cuts set on held-out texts."""
    spark = docs.sparkSession
    prepare(spark)
    kind = F.when(F.max(F.coalesce(F.col("toxic"), F.lit(0))) > 0, 2).when(F.min(F.coalesce(F.col("quality"), F.lit(1))) < 1, 1).otherwise(0)
    known = labels.where(F.col(label_id).isNotNull() & (F.col("toxic").isNotNull() | F.col("quality").isNotNull())).groupBy(F.col(label_id).alias("label_of")).agg(kind.alias("kind"))
    known = known.orderBy(F.xxhash64("label_of", F.lit(SEED)), "label_of").limit(rows)  # bounded: broadcast below
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("id") == F.col("label_of"))
    texts = texts.groupBy("kind", F.xxhash64("text").alias("copy")).agg(F.first("text").alias("text"), (1 + F.log2(F.count("*"))).alias("weight"))
    texts = saved(texts.select("kind", "text", "weight", (F.pmod(F.xxhash64("copy", F.lit(SEED)), F.lit(HELD)) == 0).alias("held")))
    weights = {(r["kind"], r["held"]): r["w"] for r in texts.groupBy("kind", "held").agg(F.sum("weight").alias("w")).collect()}
    lonely = [k for k in range(3) if len([side for side in (True, False) if (k, side) in weights]) == 1]
    texts_of = {name: weights.get((k, False), 0.0) or weights.get((k, True), 0.0) for k, name in enumerate(KINDS)}
    fitted = texts.where(~F.col("held") | F.col("kind").isin(lonely))
    if not texts_of["target"] or not (texts_of["poor"] or texts_of["toxic"]):
        return NO_MODEL
    #: for each kind: the texts that hold a bucket, and the sums of its rates and of their squares
    sums = [f"{k}{part}" for k in KINDS for part in ("", "_x", "_xx")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, FIT_BYTES):
            kinds, weight = (np.array(part.column(i).to_pylist()) for i in (0, 2))
            found = [ngrams(text_bytes(t)) for t in part.column(1).to_pylist()]
            own = [np.unique(f, return_counts=True) for f in found]
            rates = np.concatenate([n / max(len(f), 1) for f, (_, n) in zip(found, own, strict=True)])
            owner, times = (np.repeat(c, [len(u) for u, _ in own]) for c in (kinds, weight))
            buckets, place = np.unique(np.concatenate([u for u, _ in own]), return_inverse=True)
            out = []
            for k in range(3):
                at, n, rate = place[owner == k], times[owner == k], rates[owner == k]
                out += [np.bincount(at, w, len(buckets)).astype(np.float64) for w in (n, n * rate, n * rate * rate)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), *[pa.array(c, pa.float64()) for c in out]], names=["bucket", *sums])
        _HASHES.clear()

    # buckets of a single text prove nothing and count as one for the totals
    schema = ", ".join(["bucket long", *[f"{c} double" for c in sums]])
    each = fitted.select("kind", "text", "weight").mapInArrow(stage(run), schema).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in sums])
    rare = sum(F.col(k) for k in KINDS) <= 1
    counts = saved(each.groupBy(F.when(rare, F.lit(-1).cast("long")).otherwise(F.col("bucket")).alias("bucket")).agg(*[F.sum(c).alias(c) for c in sums]))
    totals = counts.agg(*[F.coalesce(F.sum(k), F.lit(0.0)).alias(k) for k in KINDS]).first()

    def evidence(k: str):
        own, good = F.col(k), F.col("target")
        share = totals[k] / max(totals["target"] + totals[k], 1)
        part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
        held_by = 2 * (part(own, (own + good) * F.lit(share)) + part(good, (own + good) * F.lit(1 - share)))
        n = {c: float(texts_of[c]) for c in ("target", k)}
        mean = {c: F.col(f"{c}_x") / n[c] for c in n}
        variance = sum((F.col(f"{c}_xx") / n[c] - mean[c] * mean[c]) / n[c] for c in n)
        rates = F.when(variance > 0, (mean["target"] - mean[k]) * (mean["target"] - mean[k]) / variance).otherwise(0.0)
        pooled = sum(F.col(f"{c}_x") for c in n) / sum(n.values())
        model = {c: F.log((F.col(f"{c}_x") + 0.5 * pooled) / (n[c] + 0.5)) for c in n}  # half a text of the pooled rate
        counts_ = (pooled > 0) & (own + good > 1)
        return F.when(counts_, F.sqrt(F.greatest(held_by, rates))).otherwise(0.0).alias(f"{k}_z"), F.when(counts_, model["target"] - model[k]).otherwise(0.0).alias(k)

    raw = [k for k in KINDS[1:] if texts_of[k]]
    near = counts.where("bucket >= 0").select("bucket", *[c for k in raw for c in evidence(k)])
    strong = near.where(" or ".join(f"{k}_z >= {ZS[0]}" for k in raw)).toPandas()  # bounded by the fit sample and the number of buckets
    tried = [(i, k, np.where(strong[f"{k}_z"] >= z, strong[k], 0.0)) for i, k in enumerate(KINDS[1:]) if k in raw for z in ZS]
    model = NO_MODEL._replace(buckets=strong["bucket"].to_numpy(np.int64), ratios=np.stack([c for _, _, c in tried], axis=1).astype(np.float32))
    judges = texts.where(F.col("held") | F.col("kind").isin(lonely)).select("kind", "text")
    names = [f"s{j}" for j in range(len(tried))]
    found = _scores(judges, model, 1, lambda means: list(means.T), names).drop("text").toPandas()  # bounded by the fit sample
    ratios, cuts, units = np.zeros((len(strong), 2), np.float32), NO_MODEL.cuts.copy(), NO_MODEL.units.copy()
    least = {}
    for j, (i, k, column) in enumerate(tried):
        good, bad = (found.loc[found["kind"] == side, names[j]].to_numpy() for side in (0, i + 1))
        cut, unit = cut_of(good, bad)
        wrong = int((good < cut).sum() + (bad >= cut).sum())
        if wrong < least.get(k, wrong + 1):
            least[k], ratios[:, i], cuts[i], units[i] = wrong, column, cut, unit
    return Model(model.buckets, ratios, cuts, units)


def _scores(docs: DataFrame, model: Model, at: int, finish: Callable[[np.ndarray], list[np.ndarray]], names: list[str]) -> DataFrame:
    """``docs`` with double columns made by ``finish`` from the mean evidence of each text (a row) for each column of ratios. No shuffle."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast((model.buckets, model.ratios))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, ratios = shared.value
        place = np.zeros(1 << HASH_BITS, np.int32)
        place[buckets] = np.arange(1, len(buckets) + 1)
        table = np.vstack([np.zeros((1, ratios.shape[1])), ratios.astype(np.float64)])
        for part in slices(batches, at, FIT_BYTES):
            means = np.zeros((part.num_rows, table.shape[1]))
            for row, text in enumerate(part.column(at).to_pylist()):
                hit = place[ngrams(text_bytes(text))] if text else ()
                if len(hit):
                    means[row] = table[hit[hit > 0]].sum(axis=0) / len(hit)
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, pa.float64()) for c in finish(means)]], names=[*part.schema.names, *names])
        _HASHES.clear()

    return over_rows(docs, run, [StructField(n, DoubleType()) for n in names])


def scored(docs: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``name``: the log weight of each text. No shuffle."""
    cuts, units = model.cuts, model.units
    return _scores(docs, model, docs.columns.index(text_col), lambda means: [((means - cuts) * units).min(axis=1)], [name])


def with_key(df: DataFrame, weight: str, key: str, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Add the Gumbel key: log weight over the temperature plus noise that depends on the id and the seed only."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return df.withColumn(key, F.col(weight) / F.lit(TEMPERATURE) - F.log(-F.log(unit)))


def kth_largest(values: DataFrame, column: str, k: int, exact_rows: int = 20_000, bins: int = 512) -> float:
    """The k-th largest value of a column by histograms that narrow down; at most ``exact_rows`` values come to the driver."""
    row = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    if not row["n"] or k >= row["n"]:
        return float("-inf")
    if k <= 0:
        return float("inf")
    low, high, rest = row["lo"], row["hi"], k
    while True:
        inside = values.where(F.col(column).between(low, high))
        if low == high:
            return low
        width = (high - low) / bins
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width else F.lit(0)
        found = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(found, reverse=True):
            if found[b][0] >= rest:
                low, high, count = found[b][1], found[b][2], found[b][0]
                break
            rest -= found[b][0]
        if low == high:
            return low
        if count <= exact_rows:
            near = [r[0] for r in values.where(F.col(column).between(low, high)).select(column).collect()]
            return sorted(near, reverse=True)[rest - 1]


def _free(names: list[str], wanted: str) -> str:
    while wanted in names:
        wanted += "_"
    return wanted


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> DataFrame:
    """The documents drawn: ``id_col``, ``log_weight`` and ``key``."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_id=label_id)
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    keys = saved(with_key(scored(rows, model, "log_weight").drop("text"), "log_weight", "key", id_col))
    least = kth_largest(keys, "key", keys.where(F.col("log_weight") >= 0).count())
    return keys.where(F.col("key") >= F.lit(least))


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns; texts are scored again instead of being shuffled."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_id=label_id)
    weight, key = _free(docs.columns, "log_weight"), _free(docs.columns, "gumbel_key")
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    keys = saved(with_key(scored(rows, model, "log_weight").drop("text"), "log_weight", "key", id_col).drop(id_col))
    least = kth_largest(keys, "key", keys.where(F.col("log_weight") >= 0).count())
    kept = with_key(scored(docs, model, weight, text_col), weight, key, id_col).where(F.col(key) >= F.lit(least))
    return kept.drop(weight, key)
