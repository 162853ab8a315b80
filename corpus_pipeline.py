"""From ``documents`` to packed training sequences, stage by stage.

Each stage works on all rows that its predecessor kept; all but the last return the columns of ``documents``.  Stages are
written as Parquet and read again; what a stage wrote for its own use is removed when the next one begins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, packing, simhash, suffixes, toxicity

_LEFT: list[str] = []


def _begin(spark: SparkSession) -> None:
    """Remove the tables of the stage before, whose result has been written."""
    while _LEFT:
        common.remove(spark, _LEFT.pop())
    suffixes.release(spark)


def _stage(work):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _begin(spark)
        made = len(common.MADE)
        result = work(spark, docs, sf_dir)
        _LEFT.extend(common.MADE[made:])
        return result

    return stage


def quiet(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.quiet(docs, machine)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: SimHash links of five-word shingles, kept where the sets have Jaccard similarity 0.8."""
    return simhash.similar_representatives(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 256 bytes and more (about 45 words) that occur elsewhere are taken out of the texts."""
    return suffixes.deduplicated(docs, suffixes.PASSAGE).withColumn("n_chars", F.length("text").cast("long"))


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", _stage(quiet)),
    ("simhash", _stage(distinct)),
    ("suffixes", _stage(unrepeated)),
    ("decontamination", _stage(unleaked)),
    ("packing", _stage(packed)),
]

#: No SQL: models, tokenizer and packing can't be expressed in it; tests hold the operators, not yet the whole run, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, folder = common.documents(spark, sf_dir), f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(result.schema).parquet(f"{folder}/{k}")
    return docs
