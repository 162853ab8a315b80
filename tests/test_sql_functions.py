from pyspark.sql import functions as F

from tests.test_packages import docx
from tidemark.functions import rules, sql
from tidemark.plans.catalog import SAMPLE_FIELDS


def test_registered_functions(spark):
    assert set(sql.register(spark)) >= {"segments", "zip_entries", "is_sensitive_key"}
    files = spark.createDataFrame([(1, bytearray(b"GIF89a\1\0\1\0\0\0\0\x21\xfe\1x\0\x3b")), (2, bytearray(b"bad"))], "file_id long, content binary")
    files.createOrReplaceTempView("files")
    rows = spark.sql("SELECT f.file_id, s.segment, s.token FROM files f, LATERAL segments(f.content, 'gif') s WHERE NOT s.keep ORDER BY 1").collect()
    assert [(r.file_id, r.segment) for r in rows] == [(1, "extension fe"), (2, "error")] and rows[0].token == "comment"
    spark.createDataFrame([(bytearray(docx()),)], "content binary").createOrReplaceTempView("packages")
    assert spark.sql("SELECT z.name FROM packages p, LATERAL zip_entries(p.content) z").count() == 5
    fields = spark.createDataFrame(SAMPLE_FIELDS, "key string, value string")
    fields.createOrReplaceTempView("fields")
    want = fields.select("key", "value", rules.is_sensitive(F.col("key"), F.col("value")).alias("s"), rules.key_category(F.col("key")).alias("c"))
    got = spark.sql("SELECT key, value, is_sensitive_key(key, value) AS s, key_category(key) AS c FROM fields")
    assert sorted(got.collect()) == sorted(want.collect())
    assert spark.sql("SELECT looks_like_plain_text(X'0041') AS p, anonymous_identifier('x') AS a").first() == (False, "urn:tidemark:2d711642b726b04401627ca9fbac32f5")
