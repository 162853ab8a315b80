import pytest

from tests.test_packages import docx
from tidemark.functions import table_functions

FRAMES = b"\xff\xfb\x90\0" + b"\xaa" * 60
FILES = [
    (1, "mp3", b"ID3\3\0\0\0\0\0\0" + FRAMES),
    (2, "gif", b"GIF89a\1\0\1\0\0\0\0\x21\xfe\1x\0\x3b"),
    (3, "ooxml", docx()),
    (4, "svg", b"<svg><script/><g/></svg>"),
    (5, "png", b"damaged"),
    (6, "pdf", b"%PDF-1.7"),
    (7, "text", b"hi"),
    (8, "gif", None),
    (9, None, b"x"),
]


@pytest.fixture(scope="module")
def files(spark):
    assert table_functions.register(spark) == ["inspect_metadata", "clean_file", "verify_clean"]
    rows = [(i, k, None if c is None else bytearray(c)) for i, k, c in FILES]
    spark.createDataFrame(rows, "id long, kind string, content binary").createOrReplaceTempView("given_files")


def test_clean_and_verify_from_sql(spark, files):
    rows = {r.id: r for r in spark.sql("SELECT * FROM clean_file(TABLE(given_files))").collect()}
    assert list(rows[1].asDict()) == ["id", "cleaned", "removed", "error_category", "error"] and len(rows) == 9
    assert bytes(rows[1].cleaned) == FRAMES and rows[1].removed == ["id3"] and rows[2].removed == ["comment"] and bytes(rows[7].cleaned) == b"hi"
    assert b"script" not in bytes(rows[4].cleaned)
    assert {i for i, r in rows.items() if r.error} == {5, 6, 8, 9} and all(rows[i].cleaned is None for i in (5, 6, 8, 9))
    before = {r.id: r.problem for r in spark.sql("SELECT * FROM verify_clean(TABLE(given_files))").collect()}
    assert all(before[i] for i in (1, 2, 3, 4, 5, 6, 8, 9)) and before[7] is None
    after = spark.sql("SELECT * FROM verify_clean(TABLE(SELECT g.id, g.kind, c.cleaned AS content FROM given_files g JOIN clean_file(TABLE(given_files)) c ON g.id = c.id WHERE c.cleaned IS NOT NULL))")
    assert {(r.id, r.problem) for r in after.collect()} == {(i, None) for i in (1, 2, 3, 4, 7)}


def test_inspect_from_sql(spark, files):
    rows = spark.sql("SELECT id, pos, key, value, error FROM inspect_metadata(TABLE(given_files)) ORDER BY id, pos").collect()
    assert any(r.id == 2 and r.value == "x" for r in rows) and any(r.id == 3 for r in rows)
    assert [r.key for r in rows if r.id == 5] == [None] and next(r for r in rows if r.id == 5).error
    assert not [r for r in rows if r.id in (7, 9)]
    assert spark.sql("SELECT * FROM inspect_metadata(TABLE(SELECT * FROM given_files WHERE false))").count() == 0


@pytest.mark.parametrize(("table", "why"), [("SELECT id, content FROM given_files", "needs kind string"), ("SELECT *, 1 AS error FROM given_files", "both table and result")])
def test_tables_that_do_not_fit_are_refused(spark, files, table, why):
    with pytest.raises(Exception, match=why):
        spark.sql(f"SELECT * FROM clean_file(TABLE({table}))").collect()
