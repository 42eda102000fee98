"""Corpus pipeline: five stages over the documents, each calling one operator of ``sparkmeter.llm``.

Every stage works on the rows that the one before it kept; a stage's result is written as Parquet in the
shared folder and read again. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.llm import bpe, quality, simhash, suffixes, tiling
from sparkmeter.llm.catalog import tokenizer
from sparkmeter.llm.common import open_tables, remove, scratch, table


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling; those that the classifier rejects go."""
    return quality.select(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes or more that also stand elsewhere."""
    found = suffixes.without_repeats(docs, window=200)
    if "n_chars" in found.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return found.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item by half or more of its words."""
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of the ids and of what they decode to."""
    path, pattern = tokenizer()
    return bpe.digests(bpe.decode_documents(bpe.encode_documents(docs, path, pattern), path, pattern))


STAGES = [
    ("quality_classifier", select_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("byte_level_bpe", tokenize),
]

#: SQL has no random models, similarity groups or merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; between them rows go through Parquet in the checkpoint folder.

    Once a stage's result is written, the tables it made on the way and the result before it are deleted.
    """
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        before = open_tables()
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
            for path in open_tables() - before:
                remove(spark, path)
            if number:
                remove(spark, f"{folder}/{number - 1}-{STAGES[number - 1][0]}")
    return docs
