import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import sink


def tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) for f in names}


def rows(spark, *pairs):
    return spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in pairs], "name string, cleaned binary").repartition(2)


def test_files_are_written_once_and_again_without_harm(spark, tmp_path):
    given = rows(spark, ("a.png", b"1"), ("sub/b.png", b"22"), ("empty", b""), ("refused.pdf", None))
    for _ in range(2):
        sink.write_files(given.withColumn("content", F.lit("clash")), f"file://{tmp_path}/out")
        assert tree(tmp_path / "out") == {"a.png": b"1", "sub/b.png": b"22", "empty": b"", "_SUCCESS": b""}
    assert os.listdir(tmp_path / "out").count("_SUCCESS") == 1 and not [d for d in os.listdir(tmp_path / "out") if d.startswith("_staging")]
    sink.write_files(rows(spark).limit(0), str(tmp_path / "none"))
    assert tree(tmp_path / "none") == {"_SUCCESS": b""}


def test_an_original_is_never_replaced(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"original")
    with pytest.raises(Exception, match="other bytes are there already"):
        sink.write_files(rows(spark, ("a.png", b"clean")), str(tmp_path))
    assert tree(tmp_path) == {"a.png": b"original"}


@pytest.mark.parametrize("name", ["../up", "/root", "a//b", "", None, "a/./b"])
def test_names_stay_below_the_folder(name):
    with pytest.raises(ValueError, match="not a name below"):
        sink._below(name)


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    made = spark.range(0, 20, 1, 1).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") < 15, F.lit(b"x")).otherwise(F.raise_error(F.lit("lost")).cast("binary")).alias("cleaned"))
    with pytest.raises(Exception, match="lost"):
        sink.write_files(made, str(tmp_path / "out"))
    assert tree(tmp_path / "out") == {}
    assert not [d for d in os.listdir(tmp_path / "out") if d.startswith("_staging")]


def test_overwriting_is_refused(spark, tmp_path):
    spark.dataSource.register(sink.FilesSink)
    with pytest.raises(Exception, match="never replaced"):
        rows(spark, ("a", b"1")).write.format("tidemark_files").mode("overwrite").save(str(tmp_path))


def test_an_attempt_that_begins_after_the_job_has_ended_stages_nothing(spark, tmp_path, monkeypatch):
    class Task:
        partitionId = taskAttemptId = staticmethod(lambda: 0)

    monkeypatch.setattr(sink.TaskContext, "get", staticmethod(Task))
    writer = sink.FilesSink({"path": str(tmp_path / "out")}).writer(sink.StructType.fromDDL("name string, content binary"), False)
    writer.abort([])
    with pytest.raises(OSError):
        writer.write(iter([sink.Row("a", b"1")]))
    assert os.listdir(tmp_path / "out") == []
