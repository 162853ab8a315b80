import datetime
import os

from pyspark.sql import functions as F

from tidemark.operators import reports
from tidemark.operators.packages import stored_package
from tidemark.sources import files
from tidemark.streaming import arrivals

FRAMES = b"\xff\xfb\x90\0" + b"\xaa" * 60


def test_scan_stream_and_copies(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.mp3").write_bytes(b"ID3\3\0\0\0\0\0\0" + FRAMES)
    (folder / "b.txt").write_bytes(b"hi")
    scanned = files.scan(spark, str(folder))
    assert sorted(r.name for r in scanned.select("name").collect()) == ["a.mp3", "b.txt"]
    plan = scanned.where("length > 5").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.partition("ReadSchema")[2] and "length" in plan.partition("PushedFilters")[2]
    arrivals.start(files.arriving(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    first = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.name, bytes(r.cleaned), r.removed) for r in first.collect()) == [("a.mp3", FRAMES, ["id3"]), ("b.txt", b"hi", [])]
    # The same bytes under another name don't come again after a restart; packages and SVG are cleaned too.
    (folder / "again.mp3").write_bytes(b"ID3\3\0\0\0\0\0\0" + FRAMES)
    (folder / "d.svg").write_bytes(b"<svg><script/><g/></svg>")
    (folder / "e.docx").write_bytes(stored_package([("[Content_Types].xml", b"<Types/>"), ("_rels/.rels", b"<Relationships/>"), ("word/document.xml", b"<d/>")]))
    (folder / "c.mp3").write_bytes(FRAMES)
    arrivals.start(files.arriving(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.name, r.ok) for r in rows.collect()) == [("a.mp3", True), ("b.txt", True), ("c.mp3", True), ("d.svg", True), ("e.docx", True)]
    rows = rows.where("name like '%.mp3'")
    files.write_copies(rows.withColumn("output", reports.output_path(F.concat(F.lit("/x/"), "name"), folder=str(tmp_path / "copies"))))
    assert (tmp_path / "copies/clean-a.mp3").read_bytes() == FRAMES and sorted(os.listdir(tmp_path / "copies")) == ["clean-a.mp3", "clean-c.mp3"]


def test_expired_files(spark):
    now = datetime.datetime(2024, 1, 2)
    rows = spark.createDataFrame([("old", now - datetime.timedelta(hours=24)), ("edge", now - datetime.timedelta(minutes=60)), ("new", now)], "name string, modificationTime timestamp")
    assert [r.name for r in reports.expired(rows, F.lit(now)).collect()] == ["old"]


def test_report_totals(spark):
    rows = spark.createDataFrame([(1, ["id3"], None), (2, [], None), (3, None, "bad")], "file_id long, removed array<string>, error string")
    report = reports.file_report(rows)
    assert [r.text for r in report.orderBy("file_id").collect()] == ["1 field (Author & copyright, Comments & description)", "no sensitive fields", None]
    total = reports.totals(report.withColumn("g", F.lit("x")), "g").where("g is null").first()
    assert (total.files, total.cleaned, total.failed, total.exit_code) == (3, 2, 1, 1)
