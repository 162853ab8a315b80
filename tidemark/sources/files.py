"""Files as rows, from folders or from tables of texts, and writing cleaned copies."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """file_id, path, name, length, modificationTime and content of every file below ``path``.

    Filters on length and modificationTime reach the scan, and content is read only where it is used.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return _named((reader.option("pathGlobFilter", pattern) if pattern else reader).load(path))


def _named(files: DataFrame) -> DataFrame:
    return files.select(F.xxhash64("path").alias("file_id"), "path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", "modificationTime", "content")


def arriving(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """As ``scan``, as a stream of files that arrive."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    return _named((reader.option("pathGlobFilter", pattern) if pattern else reader).load(path))


def from_table(table: DataFrame, id_col: str, content: Column, name: Column) -> DataFrame:
    """Rows of a table as files."""
    bytes_ = F.coalesce(content.cast("binary"), F.lit(b""))
    return table.select(F.col(id_col).cast("long").alias("file_id"), name.alias("name"), F.octet_length(bytes_).cast("long").alias("length"), bytes_.alias("content"))


def write_copies(rows: DataFrame, path_col: str = "output", content_col: str = "cleaned") -> None:
    """Write cleaned bytes to the paths in ``path_col``, on a file system that all executors mount; never over an original."""

    def write(part: Iterator[Row]) -> None:
        for row in part:
            if row[content_col] is not None:
                os.makedirs(os.path.dirname(row[path_col]) or ".", exist_ok=True)
                temporary = f"{row[path_col]}.part"
                with open(temporary, "wb") as file:
                    file.write(row[content_col])
                os.replace(temporary, row[path_col])

    rows.select(path_col, content_col).foreachPartition(write)
