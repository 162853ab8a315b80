"""Reports over cleaned files, and the sweep of expired ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import summary, tokens_categories


def file_report(rows: DataFrame) -> DataFrame:
    """file_id, ok, removed_categories, removed_count, text and error from rows of a cleaner (file_id, removed, error)."""
    categories = tokens_categories(F.coalesce("removed", F.array().cast("array<string>")))
    count = F.size(F.coalesce("removed", F.array().cast("array<string>")))
    ok = F.col("error").isNull()
    return rows.select("file_id", ok.alias("ok"), categories.alias("removed_categories"), count.alias("removed_count"), F.when(ok, summary(count, categories)).alias("text"), "error")


def totals(report: DataFrame, *by: str) -> DataFrame:
    """Counts by group and over all of them (rollup); exit_code is 1 if anything failed."""
    return report.rollup(*by).agg(F.count("*").alias("files"), F.count_if("ok").alias("cleaned"), F.count_if(~F.col("ok")).alias("failed"), F.max(F.when(F.col("ok"), 0).otherwise(1)).alias("exit_code"))


def output_path(path: Column, prefix: str = "clean-", folder: str | None = None) -> Column:
    """Where the copy of a file goes: its folder or another, and its name behind the prefix."""
    name, own = F.regexp_extract(path, r"([^/]*)$", 1), F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
    return F.concat(F.lit(folder.rstrip("/") + "/") if folder else own, F.lit(prefix), name)


def expired(files: DataFrame, now: Column, minutes: int = 60, time_col: str = "modificationTime") -> DataFrame:
    """Files last changed more than ``minutes`` before ``now``; reads no content."""
    return files.where(F.col(time_col) < now - F.make_interval(mins=F.lit(minutes)))
