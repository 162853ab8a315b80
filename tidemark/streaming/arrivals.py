"""Files that arrive, cleaned once each: the whole path of a file on a stream, with a checkpoint for exactly one report a content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.formats import extension
from tidemark.plans import hygiene

#: For so long after a file's time the same bytes count as seen.
REMEMBERED = "7 days"


def first_arrivals(files: DataFrame, remembered: str = REMEMBERED) -> DataFrame:
    """Each content of each extension once, by its digest; the state holds digests, and forgets those older than ``remembered``."""
    marked = files.withColumn("digest", F.sha2("content", 256)).withColumn("ending", extension(F.col("name")))
    return marked.withWatermark("modificationTime", remembered).dropDuplicatesWithinWatermark(["digest", "ending"]).drop("digest", "ending")


def clean_stream(files: DataFrame, remembered: str = REMEMBERED) -> DataFrame:
    """The rows of ``hygiene.clean`` for every content that arrives; kinds that can't be cleaned and refused files have their error."""
    return hygiene.clean(first_arrivals(files, remembered))


def start(files: DataFrame, output: str, checkpoint: str, remembered: str = REMEMBERED) -> StreamingQuery:
    """Clean what has arrived and end; run again for what arrives later."""
    return clean_stream(files, remembered).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
