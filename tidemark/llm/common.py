"""What the corpus operators share: reading, the shared folder, and small byte helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship

#: Folders that ``written`` made in this process, in order.
MADE: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table ``documents``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(column: Column | str) -> Column:
    """A text column as UTF-8 bytes; null is empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("binary"), F.lit(b""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``; a local one only where that is unset."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir()
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
            context.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Remove the files of a table made by ``written``; only for tables that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidemark/" in folder:
            remove(df.sparkSession, folder)


def parallelism(df: DataFrame) -> int:
    """Shuffle partitions for data about as large as ``df``: as many as its scan has, or the session's number if larger."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def binary_list(array: pa.Array) -> list[bytes]:
    """A binary Arrow column as Python bytes."""
    return array.to_pylist()


def buffer_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow column as one array, and the offsets of its rows (one more than rows)."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    large = pa.types.is_large_binary(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if len(array) and array.buffers()[2] is not None and array.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(data) else data, offsets - offsets[0]


def sliced(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Slices of a batch whose ``column`` holds about ``most`` bytes each; a longer row stands alone."""
    array = batch.column(column)
    _, offsets = buffer_of(array)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
