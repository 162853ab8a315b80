"""Jaccard similarity of word shingles: names of texts, sets of shingles, and the exact check of pairs of texts.

A text is the set of its shingles of ``SHINGLE_WORDS`` lower-case words (64-bit hashes; a shorter text is one shingle).  Texts
with equal words are one node, named by a 64-bit hash; null and empty texts are one node too.  Pairs come from SimHash; they
meet the sets of their texts here, and only texts in a pair send their sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import sliced, utf8, written

SHINGLE_WORDS = 5
SEED = 42
MAP_BITS = 26
SLICE_BYTES = 2 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def node_of(own: list[bytes]) -> int:
    """The signed name of a text's words."""
    name = xxhash.xxh64_intdigest(b" ".join(own), SEED + 1)
    return name - (1 << 64) if name >> 63 else name


def shingles(own: list[bytes], words: int = SHINGLE_WORDS) -> np.ndarray:
    """The set of a text's shingles, sorted."""
    if not own:
        return np.zeros(0, np.int64)
    digest, joined, n = xxhash.xxh64_digest, b" ".join(own), len(own) - words + 1
    if n < 2:
        hashes = [digest(joined, SEED)]
    else:
        ends = list(itertools.accumulate(map(len, own)))
        hashes = [digest(joined[b + k : e + k + words - 1], SEED) for k, (b, e) in enumerate(zip([0, *ends[: n - 1]], ends[words - 1 :]))]
    return np.unique(np.frombuffer(b"".join(hashes), np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have Jaccard similarity 4/5 or more."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def sets(docs: DataFrame, pairs: DataFrame, words: int = SHINGLE_WORDS, text_col: str = "text") -> DataFrame:
    """A written table (node, own): the sets of shingles of the texts in ``pairs`` (a, b), and of few others."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).select(F.col("node").bitwiseAND(F.lit((1 << MAP_BITS) - 1)).alias("h")).groupBy(F.shiftright("h", 6).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    flags = np.zeros(1 << MAP_BITS - 6, np.int64)  # 8 MB, whatever the corpus; it only spares work
    flags[wanted.column("place").to_numpy()] = wanted.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(flags)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sent.value
        for batch in batches:
            for part in sliced(batch, "bytes", SLICE_BYTES):
                nodes, sets = [], []
                for text in part.column(0).to_pylist():
                    own = words_of(text)
                    node = node_of(own)
                    h = node & (1 << MAP_BITS) - 1
                    if int(seen[h >> 6]) >> (h & 63) & 1:
                        nodes.append(node)
                        sets.append(shingles(own, words).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "own"])

    own = docs.select(utf8(text_col).alias("bytes")).mapInArrow(compute, "node long, own binary")
    return written(own.dropDuplicates(["node"]), "shingle-sets")


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have similarity 4/5 or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def kept(docs: DataFrame, rows: DataFrame, roots: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, all columns, from each component: that with the smallest id (null is the largest).

    rows: id (null as the largest number) and node of every row; roots: node and root of the nodes that have a link.  Where ids
    repeat, rows of a component with the same smallest id are told apart by their columns, and the first stays.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    own = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    chosen = own.groupBy("root").agg(F.min("id").alias("tidemark_key_"))
    if not rows.groupBy("id").count().where("count > 1").limit(1).count():
        return docs.withColumn("tidemark_key_", key).join(chosen.select("tidemark_key_"), "tidemark_key_").select(*docs.columns)
    named = roots.withColumnRenamed("node", "tidemark_node_").withColumnRenamed("root", "tidemark_root_")
    all_ = _with_node(docs, text_col).withColumn("tidemark_key_", key).join(named, "tidemark_node_", "left").withColumn("tidemark_root_", F.coalesce("tidemark_root_", "tidemark_node_"))
    all_ = all_.join(chosen.withColumnRenamed("root", "tidemark_root_"), ["tidemark_root_", "tidemark_key_"])
    order = Window.partitionBy("tidemark_root_", "tidemark_key_").orderBy(F.xxhash64(utf8(text_col)), F.to_json(F.struct(*docs.columns)))
    return all_.withColumn("tidemark_row_", F.row_number().over(order)).where("tidemark_row_ = 1").select(*docs.columns)


def _with_node(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the column tidemark_node_."""
    place, schema = docs.columns.index(text_col), StructType([*docs.schema.fields, StructField("tidemark_node_", LongType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([node_of(words_of(t)) for t in texts], pa.int64())], [*batch.schema.names, "tidemark_node_"])

    return docs.mapInArrow(compute, schema)
