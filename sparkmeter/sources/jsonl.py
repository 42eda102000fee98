"""Lenient JSON-lines scan (bronze): one row for each parsed line, whole-file quarantine, unreadable files disclosed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scan(spark: SparkSession, paths: str | list[str], recursive: bool = False, name_glob: str | None = None) -> DataFrame:
    """Lines of text files: path, size, mtime, ord (line order in the file), raw, v (VARIANT or null), object flag.

    Blank lines go. A line that is no JSON has a null ``v``; bytes that are no UTF-8 are replaced and flagged.
    The order key is the split's start and a number that grows inside the split, so no file is read by one task.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    rows = reader.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("ord"),
        F.col("value").alias("raw"),
    )
    rows = rows.where(F.length(F.trim("raw")) > 0).withColumn("bad_bytes", ~F.is_valid_utf8("raw"))
    # a generator keeps the optimizer from writing the parser into each of the many fields that are read from it
    rows = rows.select("*", F.explode(F.array(F.try_parse_json(F.make_valid_utf8("raw")))).alias("v"))
    return rows.withColumn("object", F.col("v").isNotNull() & F.ltrim("raw").startswith("{"))


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with ``n``, the number of the line in its file."""
    return lines.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("ord")).cast("long"))


def file_status(lines: DataFrame) -> DataFrame:
    """For each file: parsed and unparsed lines, and whether it is quarantined.

    A file of which no line parses is unreadable; one JSON line that is no object puts the whole file aside.
    """
    return lines.groupBy("path").agg(
        F.count_if(F.col("v").isNotNull()).cast("long").alias("parsed"),
        F.count_if(F.col("v").isNull()).cast("long").alias("unparsed"),
        F.count_if("bad_bytes").cast("long").alias("bad_lines"),
        F.max(F.struct("size", "mtime")).alias("file"),
        (F.count_if(F.col("v").isNotNull() & ~F.col("object")) > 0).alias("odd"),
    ).select("path", "parsed", "unparsed", "bad_lines", "file.size", "file.mtime", ((F.col("parsed") == 0) | F.col("odd")).alias("quarantined"))


def records(lines: DataFrame) -> DataFrame:
    """Objects of the files that are not quarantined.

    Only a line that does not begin as an object can be JSON and none, so the check parses those few lines and
    the files are parsed once.
    """
    odd = lines.where(~F.ltrim("raw").startswith("{") & F.col("v").isNotNull() & ~F.col("object")).select("path").distinct()
    return lines.where("object").join(odd, "path", "left_anti")
