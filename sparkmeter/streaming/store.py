"""A small table with a version for each batch, in a folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """State between batches: batch N reads the last whole version before N and writes version N, so that a repeated batch finds what it found."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _system(self, path: str) -> tuple:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if it is not there."""
        system, place = self._system(path)
        return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []

    def numbers(self) -> list[int]:
        """Numbers of the versions that were written as a whole."""
        found = [int(n[2:]) for n in self.names(self.folder) if n.startswith("v=")]
        return sorted(n for n in found if "_SUCCESS" in self.names(f"{self.folder}/v={n}"))

    def read(self, before: int | None = None) -> DataFrame:
        """The last version, or the last before a number; empty if there is none."""
        known = [n for n in self.numbers() if before is None or n < before]
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v={known[-1]}") if known else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, number: int) -> DataFrame:
        """Write a version, delete those that no repeated batch will ask for, and give back what was written."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/v={number}")
        whole = self.numbers()
        before = [n for n in whole if n < number]
        for old in before[:-1]:
            system, place = self._system(f"{self.folder}/v={old}")
            system.delete(place, True)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v={number}")
