import pytest

from tidemark.llm import registry

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, SF)
        path = f"{corpus_pipeline.common.shared_dir(spark)}/test-stages/{k}"
        result.write.mode("overwrite").parquet(path)
        last = docs
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0.5 * before < docs.count() <= before, name
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == last.count()


def test_every_operator_is_registered():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
