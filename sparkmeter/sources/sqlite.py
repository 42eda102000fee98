"""Read-only key-value tables of SQLite files as a data source, with key filters pushed down."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith


class SqliteKeyValue(DataSource):
    """``spark.read.format("sqlite_kv").option("path", file).option("table", name)``: columns key, value."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_kv"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "cursorDiskKV")
        if not self.table.isidentifier():
            raise ValueError("the table name has to be an identifier")
        self.equal: str | None = None
        self.prefix: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",) and self.equal is None:
                self.equal = f.value
            elif isinstance(f, StringStartsWith) and f.attribute == ("key",) and self.prefix is None:
                self.prefix = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.path.split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        where, args = [], []
        if self.equal is not None:
            where.append("key = ?")
            args.append(self.equal)
        if self.prefix is not None:
            where.append("substr(key, 1, ?) = ?")
            args += [len(self.prefix), self.prefix]
        query = f"SELECT key, value FROM {self.table}" + (f" WHERE {' AND '.join(where)}" if where else "")
        with sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True) as connection:
            for key, value in connection.execute(query, args):
                yield key, value.decode("utf-8", "replace") if isinstance(value, bytes) else value
