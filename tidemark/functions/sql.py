"""Functions for SQL text: scalar rules as SQL functions, and entries and segments as table functions for LATERAL.

After ``register(spark)``:

    SELECT f.name, s.* FROM files f, LATERAL segments(f.content, 'gif') s WHERE NOT s.keep
    SELECT key FROM metadata WHERE is_sensitive_key(key, value)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tidemark.functions import formats, rules
from tidemark.operators import packages, segments
from tidemark.session import ship


@udtf(returnType="pos int, segment string, start bigint, length bigint, keep boolean, token string")
class Segments:
    """Segments of one file; a damaged one gives a single row ``error``."""

    def eval(self, content: bytes, kind: str) -> Iterator[tuple]:
        try:
            segments._need(kind in segments.READERS, "unknown kind")
            found = list(segments.READERS[kind](bytes(content or b"")))
        except segments.Damaged as error:
            yield 0, "error", 0, len(content or b""), False, str(error)
            return
        for i, s in enumerate(found):
            yield i, s.kind, s.start, s.end - s.start, s.keep, s.token


@udtf(returnType="pos int, name string, method int, crc bigint, csize bigint, usize bigint, flags int, local_offset bigint, error string")
class ZipEntries:
    """Entries of one package; a refused one gives a single row with its error."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            found = packages.read_entries(bytes(content or b""))
        except segments.Damaged as error:
            yield (0, *[None] * 7, str(error))
            return
        for i, e in enumerate(found):
            yield i, e.name, e.method, e.crc, e.csize, e.usize, e.flags, e.offset, None


def register(spark: SparkSession) -> list[str]:
    """Register all functions in this session; returns their names."""
    ship(spark)
    spark.udtf.register("segments", Segments)
    spark.udtf.register("zip_entries", ZipEntries)
    sensitive = " OR ".join(
        [
            f"k RLIKE {_quoted(f'^{rules.any_of(rules.SKIPPED_GROUPS)}:')}",
            f"k IN ({', '.join(map(_quoted, rules.ALLOWED_KEYS))})",
            f"k RLIKE {_quoted('(?i)^ICC[-_]')}",
            f"k RLIKE {_quoted(rules.ALLOWED_COLOR)}",
            *(f"k RLIKE {_quoted(p)}" for p in rules.STRUCTURAL_PATTERNS),
            *(f"k RLIKE {_quoted(a)} AND v RLIKE {_quoted(b)}" for a, b in ((rules.ZEROABLE, rules.ZERO_DATE), (rules.MUXER_KEY, rules.MUXER_VALUE), (rules.HANDLER_KEY, rules.HANDLER_VALUE))),
        ]
    )
    tag = "element_at(split(k, ':'), -1)"
    cases = " ".join(f"WHEN {tag} RLIKE {_quoted('(?i)' + rules.any_of(w.split()))} THEN '{c}'" for c, w in rules.TAG_WORDS.items())
    scalars = {
        "is_sensitive_key(k STRING, v STRING) RETURNS BOOLEAN": f"coalesce(NOT coalesce({sensitive}, false) AND k RLIKE {_quoted(rules.SENSITIVE_PATTERN)}, false)",
        "key_category(k STRING) RETURNS STRING": f"CASE WHEN k RLIKE '(?i)gps' THEN 'gps' WHEN k RLIKE {_quoted('(?i)' + rules.any_of(rules.AI_WORDS))} THEN 'ai' {cases} ELSE 'metadata' END",
        "looks_like_plain_text(c BINARY) RETURNS BOOLEAN": f"decode(substring(c, 1, {formats.HEAD_BYTES}), 'ISO-8859-1') RLIKE {_quoted(formats.PLAIN_TEXT)}",
        "anonymous_identifier(t STRING) RETURNS STRING": "concat('urn:tidemark:', substring(sha2(t, 256), 1, 32))",
    }
    for signature, body in scalars.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return ["segments", "zip_entries", *(s.partition("(")[0] for s in scalars)]


def _quoted(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
