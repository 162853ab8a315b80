"""All registered queries of the file-hygiene engine, with the SQL that checks them.

Queries over byte cleaners build a file with unwanted parts around each document's whole text, clean it, and return the
hash of the result; the SQL computes the hash of the file as it should be, built without the unwanted parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import formats as fmt
from tidemark.functions import rules
from tidemark.operators import inspection, markup, packages, reports, segments, snapshots, verification
from tidemark.plans import hygiene
from tidemark.session import ship
from tidemark.sources import files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- Detection and validation -------------------------------------------------------------------------------------------


@query("q_batch_report", "SELECT source, count(*) AS files, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes, CAST(sum(CASE WHEN regexp_full_match(coalesce(text, ''), '[^\\x00-\\x08\\x0e-\\x1f\\x7f]*') THEN 1 ELSE 0 END) AS BIGINT) AS plain FROM documents GROUP BY source")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return docs.groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length(text)).cast("long").alias("bytes"), F.count_if(text.rlike(r"\A[^\x00-\x08\x0e-\x1f\x7f]*\z")).alias("plain"))


@query(
    "q_batch_rollup",
    "SELECT source, lang, count(*) AS files, count(*) FILTER (WHERE coalesce(strlen(text), 0) <= 4000) AS cleaned, count(*) FILTER (WHERE coalesce(strlen(text), 0) > 4000) AS failed, CAST(max(CASE WHEN coalesce(strlen(text), 0) <= 4000 THEN 0 ELSE 1 END) AS INTEGER) AS exit_code FROM documents GROUP BY ROLLUP (source, lang)",
)
def batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return reports.totals(docs.select("source", "lang", (F.coalesce(F.octet_length("text"), F.lit(0)) <= 4000).alias("ok")), "source", "lang")


def _documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of several kinds by doc_id: plain, with a NUL, RTF, PDF, ZIP, GIF, and names that don't fit."""
    docs = table(spark, sf_dir, "documents")
    heads = F.array(*(F.lit(h) for h in (b"", b"\0", b"{\\rtf1 ", b"%PDF-1.7 ", b"PK\3\4", b"GIF89a", b"")))
    names = F.array(*(F.lit(n) for n in (".txt", ".md", ".rtf", ".pdf", ".docx", ".png", ".exe")))
    k = F.pmod("doc_id", F.lit(7)).cast("int") + 1
    content = F.concat(F.element_at(heads, k), F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    return files.from_table(docs, "doc_id", content, F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.element_at(names, k)))


_LADDER = """
WITH f AS (SELECT doc_id AS file_id, CAST(doc_id % 7 AS INTEGER) AS k, coalesce(strlen(text), 0) AS n, encode(coalesce(text, ''))[1:4096] AS b FROM documents),
g AS (SELECT *, n + CASE k WHEN 1 THEN 1 WHEN 2 THEN 7 WHEN 3 THEN 9 WHEN 4 THEN 4 WHEN 5 THEN 6 ELSE 0 END AS size,
 regexp_full_match(hex(b), '(0[9A-D]|[2-6].|7[0-9A-E]|[89A-F].)*') AS plain FROM f)
SELECT file_id, size, CASE
 WHEN k = 0 THEN CASE WHEN NOT plain THEN 'unsupported_format' WHEN size > 5000 THEN 'file_too_large' END
 WHEN k = 1 THEN 'unsupported_format'
 WHEN k IN (2, 3) THEN CASE WHEN size > 5000 THEN 'file_too_large' END
 WHEN k IN (4, 5) THEN 'suspicious_file'
 ELSE 'unsupported_format' END AS error_code FROM g
"""


@query("q_validate_ladder", _LADDER)
def validate_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = fmt.validated(_documents_as_files(spark, sf_dir), {"document": 5000})
    return checked.select("file_id", F.col("length").alias("size"), "error_code")


@query("q_sniff_plaintext", "SELECT doc_id, doc_id % 5 <> 0 AND regexp_full_match(hex(encode(coalesce(text, ''))[1:4096]), '(0[9A-D]|[2-6].|7[0-9A-E]|[89A-F].)*') AS plain FROM documents")
def sniff_plaintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = F.concat(F.when(F.col("doc_id") % 5 == 0, F.lit(b"a\0")).otherwise(F.lit(b"")), F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    return docs.select("doc_id", fmt.looks_like_plain_text(content).alias("plain"))


@query(
    "q_sniff_magic",
    "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 3 THEN 'heic' WHEN 4 THEN 'opus' ELSE 'mp3' END AS ext, CASE doc_id % 6 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 5 THEN 'mp3' END AS kind FROM documents",
)
def sniff_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    heads = F.array(*(F.lit(h) for h in (b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n", b"RIFF\1\0\0\0WEBPVP8 ", b"\0\0\0\x18ftypheic", b"OggS\0\2OpusHead", b"ID3\4\0\0")))
    content = F.concat(F.element_at(heads, F.pmod("doc_id", F.lit(6)).cast("int") + 1), F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    return docs.select("doc_id", fmt.detected(content)["ext"].alias("ext"), fmt.browser_kind(F.lit("a.mp3"), content).alias("kind"))


@query("q_sniff_markup", r"SELECT page_id, regexp_matches(left(coalesce(html, ''), 4000), '(?is)^\s*(<!doctype[^>]*>\s*)?<html[\s>]') AS is_html, starts_with(coalesce(html, ''), '%PDF-') AS is_pdf, starts_with(coalesce(html, ''), '{\rtf') AS is_rtf FROM pages")
def sniff_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", F.left(html, F.lit(4000)).rlike(r"(?is)^\s*(<!doctype[^>]*>\s*)?<html[\s>]").alias("is_html"), fmt.looks_like_pdf(html.cast("binary")).alias("is_pdf"), fmt.looks_like_rtf(html.cast("binary")).alias("is_rtf"))


@query("q_filename_valid", r"""SELECT page_id, length(url) BETWEEN 1 AND 255 AND NOT contains(url, '/') AND NOT contains(url, '\') AND NOT contains(url, '..') AS url_ok, length(name) BETWEEN 1 AND 255 AND NOT contains(name, '/') AND NOT contains(name, '\') AND NOT contains(name, '..') AS name_ok FROM (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) || CASE WHEN page_id % 9 = 0 THEN '..' ELSE '.html' END AS name FROM pages)""")
def filename_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    name = F.concat(F.regexp_extract("url", "([^/]*)$", 1), F.when(F.col("page_id") % 9 == 0, "..").otherwise(".html"))
    return pages.select("page_id", fmt.filename_valid(F.col("url")).alias("url_ok"), fmt.filename_valid(name).alias("name_ok"))


_EXT_ROWS = ", ".join(f"({quoted(e)}, {quoted(f)}, {quoted(c)}, {quoted(m[0])})" for f, c, es, m in fmt.FORMATS for e in es)
_EXT_LIST = [e for _, _, es, _ in fmt.FORMATS for e in es] + ["exe", "htm"]


@query(
    "q_ext_lookup",
    f"WITH d(extension, format, category, mime_type) AS (VALUES {_EXT_ROWS}), e AS (SELECT event_id, list_extract([{', '.join(map(quoted, _EXT_LIST))}], CAST(event_id % {len(_EXT_LIST)} AS INTEGER) + 1) AS extension FROM events) SELECT extension, format, category, coalesce(mime_type, 'application/octet-stream') AS mime_type, count(*) AS files FROM e LEFT JOIN d USING (extension) GROUP BY ALL",
)
def ext_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by extension joined to the format table."""
    events = table(spark, sf_dir, "events")
    name = F.concat(F.lit("file."), F.element_at(F.array(*map(F.lit, _EXT_LIST)), F.pmod("event_id", F.lit(len(_EXT_LIST))).cast("int") + 1))
    named = events.select(fmt.extension(F.upper(name)).alias("extension"))
    joined = named.join(F.broadcast(fmt.extensions(spark)), "extension", "left")
    return joined.groupBy("extension", "format", "category", F.coalesce("mime_type", F.lit("application/octet-stream")).alias("mime_type")).agg(F.count("*").alias("files"))


# --- Metadata rules -----------------------------------------------------------------------------------------------------

SAMPLE_FIELDS = [
    ("SourceFile", "a.jpg"), ("System:FileName", "a"), ("Composite:GPSPosition", "1 2"), ("IFD0:Orientation", "6"), ("ICC_Profile:ProfileCreator", "x"), ("ICC-header:ProfileClass", "x"),
    ("EXIF:ColorSpace", "1"), ("PNG:Gamma", "2.2"), ("QuickTime:MajorBrand", "mp42"), ("QuickTime:CreateDate", "0000:00:00 00:00:00"), ("QuickTime:CreateDate", "2024:01:02 03:04:05"), ("Track1:MediaCreateDate", "0000:00:00 00:00:00"),
    ("Track2:HandlerDescription", "SoundHandler"), ("Track2:HandlerDescription", "Bob's phone"), ("Info:MuxingApp", "Lavf60.3.100"), ("Info:MuxingApp", "Lavf60 by Ann"), ("Vorbis:Vendor", "ffmpeg"), ("AAC:Encoder", "Lavc59.1"),
    ("AAC:SampleRate", "44100"), ("ZIP:ZipModifyDate", "1980:01:01 00:00:00"), ("ZIP:ZipModifyDate", "2023:05:05 10:00:00"), ("XMP:Prompt", "a cat"), ("XMP-dc:Creator", "Ann"), ("IPTC:Keywords", "k"), ("GPS:GPSLatitude", "1"),
    ("IFD0:Model", "Phone"), ("IFD0:Make", "Maker"), ("IFD0:Artist", "Ann"), ("PNG:Parameters", "steps"), ("PDF:Author", "Ann"), ("PDF:PageCount", "3"), ("PDF:Producer", "p"), ("XML:AppVersion", "16"), ("XML-dc:Title", "T"),
    ("XML:Company", "C"), ("RIFF:Software", "s"), ("RIFF:SampleRate", "8000"), ("FLAC:BlockSizeMin", "1"), ("ID3v2_3:Title", "t"), ("File:Comment", "hi"), ("File:ImageWidth", "10"), ("Matroska:DocType", "webm"), ("Matroska:Title", "t"),
    ("JFIF:ThumbnailImage", "x"), ("JFIF:XResolution", "72"), ("Custom:Harmless", "x"), ("Photoshop:History", "h"), ("MPEG:AudioBitrate", "128"), ("Ogg:PageCount", "4"), ("AIFF:Name", "n"), ("ExifIFD:UserComment", "c"), ("IFD1:ThumbnailOffset", "9"),
    ("ExifIFD:DateTimeOriginal", "2020:01:01 00:00:00"), ("XML:Template", "Normal"), ("XML:RevisionNumber", "3"), ("QuickTime:WhitePointX", "1"), ("EXIF:LensModel", "L"), ("Keys:Software", "s"), ("XML:Meta", "1980-01-01T00:00:00Z"), ("", ""),
]


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event carries one metadata field."""
    events = table(spark, sf_dir, "events")
    pick = F.pmod("event_id", F.lit(len(SAMPLE_FIELDS))).cast("int") + 1
    return events.select("event_id", "user_id", *(F.element_at(F.array(*(F.lit(f[i]) for f in SAMPLE_FIELDS)), pick).alias(n) for i, n in enumerate(("key", "value"))))


def _sql_fields() -> str:
    lists = (f"list_extract([{', '.join(quoted(f[i]) for f in SAMPLE_FIELDS)}], CAST(event_id % {len(SAMPLE_FIELDS)} AS INTEGER) + 1)" for i in (0, 1))
    return "SELECT event_id, user_id, {} AS key, {} AS value FROM events".format(*lists)


def _sql_sensitive() -> str:
    match = lambda column, pattern: f"regexp_matches({column}, {quoted(pattern)})"
    allowed = [
        match("key", f"^{rules.any_of(rules.SKIPPED_GROUPS)}:"),
        f"key IN ({', '.join(map(quoted, rules.ALLOWED_KEYS))})",
        match("key", "(?i)^ICC[-_]"),
        match("key", rules.ALLOWED_COLOR),
        *(match("key", p) for p in rules.STRUCTURAL_PATTERNS),
        f"({match('key', rules.ZEROABLE)} AND {match('value', rules.ZERO_DATE)})",
        f"({match('key', rules.MUXER_KEY)} AND {match('value', rules.MUXER_VALUE)})",
        f"({match('key', rules.HANDLER_KEY)} AND {match('value', rules.HANDLER_VALUE)})",
    ]
    return f"(NOT ({' OR '.join(allowed)}) AND {match('key', rules.SENSITIVE_PATTERN)})"


def _sql_category() -> str:
    tag = "list_extract(string_split(key, ':'), -1)"
    cases = [f"WHEN regexp_matches(key, '(?i)gps') THEN 'gps' WHEN regexp_matches(key, {quoted('(?i)' + rules.any_of(rules.AI_WORDS))}) THEN 'ai'"]
    cases += [f"WHEN regexp_matches({tag}, {quoted('(?i)' + rules.any_of(w.split()))}) THEN {quoted(c)}" for c, w in rules.TAG_WORDS.items()]
    return f"CASE {' '.join(cases)} ELSE 'metadata' END"


@query("q_sensitive_keys", f"SELECT event_id, key, {_sql_sensitive()} AS sensitive FROM ({_sql_fields()})")
def sensitive_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("event_id", "key", rules.is_sensitive(F.col("key"), F.col("value")).alias("sensitive"))


@query("q_categorize_keys", f"SELECT event_id, {_sql_category()} AS category FROM ({_sql_fields()})")
def categorize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir).select("event_id", rules.key_category(F.col("key")).alias("category"))


_ORDER = "[" + ", ".join(map(quoted, rules.CATEGORIES)) + "]"
_LABELS = "MAP {" + ", ".join(f"{quoted(c)}: {quoted(n)}" for c, n in rules.CATEGORIES.items()) + "}"


@query(
    "q_summary_text",
    f"WITH f AS ({_sql_fields()}), s AS (SELECT user_id, {_sql_sensitive()} AS hit, {_sql_category()} AS category FROM f), u AS (SELECT user_id, count(*) FILTER (WHERE hit) AS n, list(category) FILTER (WHERE hit) AS cs FROM s GROUP BY user_id) "
    f"SELECT user_id, n AS removed, CASE WHEN n = 0 THEN 'no sensitive fields' ELSE n || CASE WHEN n = 1 THEN ' field (' ELSE ' fields (' END || array_to_string(list_transform(list_filter({_ORDER}, lambda c: list_contains(cs, c)), lambda c: {_LABELS}[c]), ', ') || ')' END AS summary FROM u",
)
def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per user: how many sensitive fields, and of which categories; categories are summed before they meet."""
    fields = _fields(spark, sf_dir)
    hit = rules.is_sensitive(F.col("key"), F.col("value"))
    per_user = fields.groupBy("user_id").agg(F.count_if(hit).alias("removed"), F.collect_set(F.when(hit, rules.key_category(F.col("key")))).alias("found"))
    return per_user.select("user_id", "removed", rules.summary(F.col("removed"), rules.in_order(F.col("found"))).alias("summary"))


TOKENS = ["GPS", "Author", "Software", "DateTime", "EXIF", "XMP", "Comment", "JFIF thumbnail", "JFXX/APP0", "tEXt", "tIME", "documentProperties", "epubMetadata", "rtfMetadata", "svgMetadata", "id3", "ape", "vorbisComment", "flacPicture", "APP13", "app:contextual", "lyrics", "iTXt"]
_TOKEN_CASE = """CASE WHEN t = 'gps' THEN ['gps'] WHEN t = 'author' THEN ['author'] WHEN t = 'software' THEN ['software'] WHEN t = 'datetime' THEN ['dates']
 WHEN contains(t, 'exif') THEN ['metadata', 'dates'] WHEN t = 'xmp' THEN ['ai', 'author'] WHEN starts_with(t, 'comment') THEN ['comments']
 WHEN contains(t, 'thumbnail') OR contains(t, 'jfxx') THEN ['thumbnail'] WHEN contains(t, 'text') THEN ['ai', 'comments'] WHEN t = 'time' THEN ['dates']
 WHEN t = 'documentproperties' THEN ['document', 'author', 'software', 'dates'] WHEN t = 'epubmetadata' THEN ['document', 'author', 'dates']
 WHEN t = 'rtfmetadata' THEN ['document', 'author', 'software'] WHEN t = 'svgmetadata' THEN ['svg'] WHEN t IN ('id3', 'ape', 'vorbiscomment', 'flacpicture') THEN ['author', 'comments']
 ELSE ['metadata'] END"""


@query(
    "q_categorize_tokens",
    f"WITH p AS (SELECT event_id, lower(list_extract([{', '.join(map(quoted, TOKENS))}], CAST(event_id % {len(TOKENS)} AS INTEGER) + 1)) AS t FROM events), c AS (SELECT event_id, {_TOKEN_CASE} AS cs FROM p) SELECT event_id, array_to_string(list_filter({_ORDER}, lambda c: list_contains(cs, c)), ',') AS categories FROM c",
)
def categorize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    token = F.element_at(F.array(*map(F.lit, TOKENS)), F.pmod("event_id", F.lit(len(TOKENS))).cast("int") + 1)
    return events.select("event_id", F.array_join(rules.tokens_categories(F.array(token)), ",").alias("categories"))


# --- Relational forms of package and snapshot rules -----------------------------------------------------------------------


@query(
    "q_opc_resolve",
    "WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)?', 1) || '/./x/../docProps//core.xml', '^/', ''), '/') AS steps FROM pages) SELECT page_id, array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(steps, lambda s: [s])), lambda a, s: CASE WHEN s[1] IN ('', '.') THEN a WHEN s[1] = '..' THEN a[1:greatest(len(a) - 1, 0)] ELSE list_concat(a, s) END), '/') AS part FROM p",
)
def opc_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    target = F.concat(F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)?", 1), F.lit("/./x/../docProps//core.xml"))
    return pages.select("page_id", rules.resolve_target(target).alias("part"))


@query("q_identifier_anon", "SELECT doc_id, 'urn:tidemark:' || left(sha256(coalesce(text, '')), 32) AS identifier FROM documents")
def identifier_anon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", rules.anonymous_identifier(F.coalesce("text", F.lit(""))).alias("identifier"))


@query(
    "q_zip_unique_names",
    "WITH d AS (SELECT doc_id, doc_id // 64 AS archive, 'file' || (doc_id % 5) || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '' END AS name FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY archive, name ORDER BY doc_id) - 1 AS k FROM d) SELECT doc_id, CASE WHEN k = 0 THEN name ELSE regexp_replace(name, '\\.txt$', '') || ' (' || k || ')' || CASE WHEN name LIKE '%.txt' THEN '.txt' ELSE '' END END AS unique_name FROM n",
)
def zip_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = docs.select("doc_id", F.floor(F.col("doc_id") / 64).alias("archive"), F.concat(F.lit("file"), (F.col("doc_id") % 5).cast("string"), F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise("")).alias("name"))
    return packages.unique_names(named, order="doc_id").select("doc_id", "unique_name")


@query(
    "q_zip_offsets",
    "SELECT doc_id, CAST(coalesce(sum(30 + strlen('doc_' || doc_id) + coalesce(strlen(text), 0)) OVER (PARTITION BY doc_id // 64 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS local_offset, true AS ok FROM documents",
)
def zip_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed 64 to an archive by the package writer, read again entry by entry."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.floor(F.col("doc_id") / 64).alias("archive"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("content"), F.col("doc_id").alias("pos"))
    entries = packages.with_contiguity(packages.entries(packages.archives(rows), "archive", "data"))
    return entries.select(F.regexp_extract("name", r"(\d+)$", 1).cast("long").alias("doc_id"), "local_offset", "ok")


@query(
    "q_snapshot_diff",
    "WITH a AS (SELECT l_orderkey AS file_id, 'n:' || l_linenumber AS key, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value FROM lineitem), b AS (SELECT file_id, key, CASE WHEN file_id % 7 = 0 THEN value || 'x' ELSE value END AS value FROM a WHERE file_id % 5 <> 0 UNION ALL SELECT o_orderkey, 'n:new', 'v' FROM orders WHERE o_orderkey % 3 = 0) "
    "SELECT CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed' WHEN a.value = b.value THEN 'same' ELSE 'changed' END AS change, count(*) AS fields, count(DISTINCT coalesce(a.file_id, b.file_id)) AS files FROM a FULL OUTER JOIN b ON a.file_id = b.file_id AND a.key = b.key GROUP BY 1",
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.concat(F.lit("n:"), F.col("l_linenumber").cast("string")).alias("key"), F.col("l_quantity").cast("long").cast("string").alias("value"))
    added = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("file_id"), F.lit("n:new").alias("key"), F.lit("v").alias("value"))
    after = items.where("file_id % 5 <> 0").withColumn("value", F.when(F.col("file_id") % 7 == 0, F.concat("value", F.lit("x"))).otherwise(F.col("value"))).unionByName(added)
    return snapshots.metadata_diff(items, after).groupBy("change").agg(F.count("*").alias("fields"), F.count_distinct("file_id").alias("files"))


@query(
    "q_snapshot_verdict",
    "SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 6 = 1 THEN 'image width changed' WHEN o_orderkey % 6 = 2 THEN 'orientation lost' WHEN o_orderkey % 6 = 3 THEN 'BitDepth changed' WHEN o_orderkey % 6 = 4 THEN 'sensitive metadata left' WHEN o_orderkey % 6 = 5 THEN 'colour profile lost' END AS error FROM orders",
)
def snapshot_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, width = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    fields = lambda *pairs: F.filter(F.array(*(F.struct(F.lit(n).alias("key"), v.cast("string").alias("value")) for n, v in pairs)), lambda e: e["value"].isNotNull())
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), "o_orderkey", "o_custkey")
    before = orders.select("file_id", F.inline(fields(("File:ImageWidth", width), ("IFD0:Orientation", F.lit("6")), ("PNG:BitDepth", F.lit("8")), ("ICC_Profile:Version", F.lit("4")), ("XMP:Prompt", F.lit("p")))))
    after = orders.select("file_id", F.inline(fields(("File:ImageWidth", F.when(k == 1, F.concat(width, F.lit("0"))).otherwise(width)), ("IFD0:Orientation", F.when(k != 2, "6")), ("PNG:BitDepth", F.when(k == 3, "16").otherwise("8")), ("ICC_Profile:Version", F.when(k != 5, "4")), ("XMP:Prompt", F.when(k == 4, "p")))))
    return snapshots.snapshot_verdict(before, after)


@query(
    "q_stream_pairing",
    "WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS u FROM conversations GROUP BY conv_id) SELECT conv_id AS file_id, CASE WHEN conv_id % 4 = 1 AND u > 0 THEN 'stream count changed' WHEN conv_id % 4 = 2 AND u > 0 THEN 'stream changed' WHEN conv_id % 4 = 3 AND 2.0 > greatest(1.0, 0.01 * n) THEN 'duration changed' END AS error FROM c",
)
def stream_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as streams: user turns are audio, all others data; the second probe lacks or changes some."""
    turns = table(spark, sf_dir, "conversations").withColumn("width", F.coalesce(F.length("text"), F.lit(0)))
    stream = F.struct(F.col("turn"), F.when(F.col("role") == "user", "audio").otherwise("data").alias("codec_type"), F.col("width"))
    before = turns.groupBy(F.col("conv_id").alias("file_id")).agg(F.count("*").cast("double").alias("duration"), F.array_sort(F.collect_list(stream)).alias("streams"))
    k = F.col("file_id") % 4
    changed = F.transform("streams", lambda s: F.when(k == 2, s.withField("width", s["width"] + 1)).otherwise(s))
    after = before.withColumn("streams", F.filter(changed, lambda s: ~((k == 1) & (s["codec_type"] == "audio")) & (s["codec_type"] != "data"))).withColumn("duration", F.col("duration") + F.when(k == 3, 2.0).otherwise(0.0))
    return snapshots.stream_verdict(before, after)


@query(
    "q_audio_pairing",
    "WITH c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS u, count(*) FILTER (WHERE role <> 'user') AS o FROM conversations GROUP BY conv_id) SELECT conv_id AS file_id, CASE WHEN conv_id % 2 = 1 AND o > 0 THEN 'other streams left' END AS error FROM c",
)
def audio_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as streams of an audio file: odd conversations keep streams that aren't audio."""
    turns = table(spark, sf_dir, "conversations")
    stream = F.struct(F.col("turn"), F.when(F.col("role") == "user", "audio").otherwise("data").alias("codec_type"))
    before = turns.groupBy(F.col("conv_id").alias("file_id")).agg(F.lit(1.0).alias("duration"), F.array_sort(F.collect_list(stream)).alias("streams"))
    after = before.withColumn("streams", F.filter("streams", lambda s: (F.col("file_id") % 2 == 1) | (s["codec_type"] == "audio")))
    return snapshots.stream_verdict(before, after, ["audio"], only=True)


@query("q_document_verdict", "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'text changed' WHEN doc_id % 4 = 3 THEN 'earlier version left' END AS error FROM documents")
def document_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    after = F.when(k == 1, _join(text, b" ")).when(k == 3, _join(b"%PDF-1.7", text, b"%BeginExifToolUpdate")).otherwise(text)
    return docs.select("doc_id", snapshots.document_error(F.when(k < 2, "text").otherwise("pdf"), text, after).alias("error"))


@query("q_ttl_sweep", "SELECT event_type, count(*) AS expired FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE GROUP BY event_type")
def ttl_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    latest = events.agg(F.max("ts").alias("latest"))
    return reports.expired(events.join(F.broadcast(latest), F.lit(True)), F.col("latest"), 60, "ts").groupBy("event_type").agg(F.count("*").alias("expired"))


@query(
    "q_required_parts",
    "SELECT o_orderkey AS file_id, CASE o_orderkey % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'xlsx' ELSE 'epub' END AS format FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 OR o_orderkey % 3 = 1 AND o_orderkey % 5 <> 0 OR o_orderkey % 3 = 2 AND o_orderkey % 7 <> 0",
)
def required_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as packages with entries that depend on their keys; those with all parts of their format remain."""
    orders, k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id")), F.col("file_id")
    typed = orders.withColumn("format", F.when(k % 3 == 0, "docx").when(k % 3 == 1, "xlsx").otherwise("epub"))
    lit = lambda *names: F.array(*map(F.lit, names))
    names = (
        F.when(k % 3 == 0, F.concat(lit("[Content_Types].xml", "_rels/.rels"), F.when(k % 2 == 0, lit("word/document.xml")).otherwise(lit("word/other.xml"))))
        .when(k % 3 == 1, F.concat(lit("[Content_Types].xml", "xl/workbook.xml"), F.when(k % 5 == 0, lit("x")).otherwise(lit("_rels/.rels"))))
        .otherwise(F.concat(lit("mimetype", "META-INF/container.xml"), F.when(k % 7 == 0, lit("other/a.opf")).otherwise(lit("OEBPS/a.opf"))))
    )
    rows = typed.select("file_id", F.posexplode(names).alias("pos", "name")).select("file_id", "pos", "name", F.lit(0).alias("method"), F.when(F.col("name") == "mimetype", F.lit(b"application/epub+zip")).alias("head"))
    return packages.has_required_parts(rows, typed)


@query("q_prune_refs", "SELECT l_orderkey AS file_id, count(*) AS kept FROM lineitem WHERE NOT (l_linenumber % 2 = 1 AND l_orderkey % 2 = 0) GROUP BY l_orderkey")
def prune_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as references to parts, and the odd parts of even orders as removed."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), "l_linenumber")
    references = items.withColumn("target", F.concat(F.lit("./word/../docProps/P"), F.col("l_linenumber").cast("string"), F.lit("%2Exml")))
    removed = items.where("l_linenumber % 2 = 1 and file_id % 2 = 0").select("file_id", F.concat(F.lit("docProps/p"), F.col("l_linenumber").cast("string"), F.lit(".xml")).alias("part")).distinct()
    return packages.pruned_references(references, removed).groupBy("file_id").agg(F.count("*").alias("kept"))


@query(
    "q_svg_unsafe",
    r"""
    WITH parts AS (SELECT page_id, html, lower(html) AS low, regexp_extract_all(html, '<[^<>]*>') AS tags FROM pages),
    named AS (SELECT *, list_transform(tags, lambda t: regexp_replace(lower(regexp_extract(t, '^<([^ \t\r\n/<>]*)', 1)), '^.*:', '')) AS names,
        list_transform(flatten(list_transform(tags, lambda t: regexp_extract_all(t, '[ \t\r\n]([^ \t\r\n=<>/]+)[ \t\r\n]*=', 1))), lambda a: regexp_replace(lower(a), '^.*:', '')) AS attributes,
        list_transform(regexp_extract_all(low, 'attributename[ \t\r\n]*=[ \t\r\n]*["'']([^"'']*)', 1), lambda t: trim(t)) AS targets FROM parts)
    SELECT page_id,
        len(list_filter(names, lambda n: n IN ('script', 'metadata', 'foreignobject', 'handler', 'title', 'desc'))) > 0 OR len(list_filter(attributes, lambda a: starts_with(a, 'on'))) > 0
            OR contains(low, 'javascript:') OR contains(low, '<!doctype') OR contains(low, '<!--') AS unsafe_content,
        len(list_filter(targets, lambda t: t IN ('href', 'xlink:href', 'src', 'style', 'class') OR regexp_matches(t, '^(.*:)?(href|src|style|class|on[^:]*)$'))) > 0 AS unsafe_target,
        CASE WHEN html IS NOT NULL THEN coalesce(starts_with(ltrim(html), tags[1]) AND names[1] = 'svg', false) END AS is_svg
    FROM named""",
)
def svg_unsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = markup.output_facts(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", *(fact.alias(name) for name, fact in facts.items()))


# --- Byte cleaners --------------------------------------------------------------------------------------------------------


def _little(n: Column, width: int = 4) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(h, 2 * k + 1, 2) for k in reversed(range(width)))))


def _big(n: Column, width: int = 4) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))


def _blocks(text: Column) -> Column:
    """Bytes in blocks of at most 255, each behind its length, and an empty one."""
    h, n = F.hex(text), F.octet_length(text)
    full = F.floor(n / 255).cast("int")
    rest = F.substr(h, full * 510 + 1)
    return F.unhex(F.concat(F.regexp_replace(F.substr(h, F.lit(1), full * 510), "(.{510})", "FF$1"), F.when(n % 255 > 0, F.concat(F.lpad(F.hex((n % 255).cast("long")), 2, "0"), rest)).otherwise(""), F.lit("00")))


def _cleaned(spark: SparkSession, sf_dir: str, kind: str, dirty: Callable[[Column], Column]) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", F.lit(kind).alias("kind"), dirty(text).alias("content"))
    return segments.cleaned(rows, ["doc_id"]).select("doc_id", F.sha2("cleaned", 256).alias("sha256"), F.octet_length("cleaned").cast("long").alias("bytes"), F.array_join("removed", ",").alias("removed"))


def _expected(clean: str, removed: str) -> str:
    return f"WITH c AS (SELECT doc_id, encode(coalesce(text, '')) AS t, strlen(coalesce(text, '')) AS n FROM documents), x AS (SELECT doc_id, {clean} AS b FROM c) SELECT doc_id, sha256(b) AS sha256, CAST(octet_length(b) AS BIGINT) AS bytes, {quoted(removed)} AS removed FROM x"


def _join(*parts: Column | bytes) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, bytes) else p for p in parts))


@query("q_clean_mp3", _expected("unhex('FFFB9000') || t", "id3,ape,id3"))
def clean_mp3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (32).to_bytes(4, "little") + bytes(16)
    return _cleaned(spark, sf_dir, "mp3", lambda t: _join(b"ID3\3\0\0\0\0\0\x0aTIT2\0\0\0\0\0\0", b"\xff\xfb\x90\0", t, ape, b"TAG" + b"secret".ljust(125, b"\0")))


@query("q_clean_png", _expected("unhex('89504E470D0A1A0A0000000D4948445200000001000000010806000000DEADBEEF' || printf('%08X', n) || '49444154') || t || unhex('0102030400000000' || '49454E44AE426082')", "tEXt,eXIf"))
def clean_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = bytes.fromhex("89504E470D0A1A0A0000000D4948445200000001000000010806000000DEADBEEF")
    return _cleaned(spark, sf_dir, "png", lambda t: _join(head, b"\0\0\0\6tEXtsecret\1\2\3\4", _big(F.octet_length(t)), b"IDAT", t, b"\1\2\3\4", b"\0\0\0\2eXIfMM\1\2\3\4", bytes.fromhex("0000000049454E44AE426082"), b"after"))


_LE = "substr(printf('%08X', {0}), 7, 2) || substr(printf('%08X', {0}), 5, 2) || substr(printf('%08X', {0}), 3, 2) || substr(printf('%08X', {0}), 1, 2)"


@query("q_clean_webp", _expected(f"unhex('52494646' || {_LE.format('(n + n % 2 + 30)')} || '57454250' || '56503858' || '0A000000' || '20000000000000000000' || '56503820' || {_LE.format('n')}) || t || unhex(CASE WHEN n % 2 = 1 THEN '00' ELSE '' END)", "EXIF,XMP"))
def clean_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    pad = lambda t: F.when(F.octet_length(t) % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b""))
    body = lambda t: _join(b"WEBPVP8X\x0a\0\0\0\x2c\0\0\0\0\0\0\0\0\0VP8 ", _little(F.octet_length(t)), t, pad(t), b"EXIF\4\0\0\0MM\0*XMP \2\0\0\0<x")
    return _cleaned(spark, sf_dir, "webp", lambda t: _join(b"RIFF", _little(F.octet_length(body(t))), body(t)))


_JPEG_HEAD = "FFD8" + "FFE10022457869660000" + "4D4D002A00000008" + "0001" + "011200030000000100060000" + "00000000" + "FFDB0002" + "FFDA0008010100003F00"


@query("q_clean_jpeg", _expected(f"unhex('{_JPEG_HEAD}') || t || unhex('FFD9')", "EXIF,Software,XMP,Comment,Trailing data after EOI"))
def clean_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiff = b"MM\0*\0\0\0\x08\0\2\x01\x12\0\3\0\0\0\1\0\6\0\0\x01\x31\0\2\0\0\0\2a\0\0\0\0\0\0\0"
    exif = b"Exif\0\0" + tiff
    first = b"\xff\xd8\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif + b"\xff\xe1\0\6<x/>\xff\xfe\0\4hi\xff\xdb\0\2\xff\xda\0\x08\1\1\0\0\x3f\0"
    return _cleaned(spark, sf_dir, "jpeg", lambda t: _join(first, t, b"\xff\xd9after"))


@query("q_clean_gif", _expected("unhex('474946383961010001000000002C00000000010001000002' || regexp_replace(substr(hex(t), 1, 510 * (n // 255)), '(.{510})', 'FF\\1', 'g') || CASE WHEN n % 255 > 0 THEN printf('%02X', n % 255) || substr(hex(t), 510 * (n // 255) + 1) ELSE '' END || '003B')", "comment,app:ICCRGBG1012"))
def clean_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, "gif", lambda t: _join(b"GIF89a\1\0\1\0\0\0\0", b"\x21\xfe", _blocks(t), b"\x21\xff\x0bICCRGBG1012\1x\0", b"\x2c\0\0\0\0\1\0\1\0\0\2", _blocks(t), b"\x3bafter"))


@query("q_clean_flac", _expected("unhex('664C614380000022' || repeat('2A', 34)) || t", "id3,vorbisComment,application"))
def clean_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, "flac", lambda t: _join(b"ID3\4\0\0\0\0\0\2xxfLaC\0\0\0\x22" + b"\x2a" * 34 + b"\4", _big(F.octet_length(t), 3), t, b"\2\0\0\4abcd\x81\0\0\2\0\0", t))


@query("q_clean_rtf", _expected("encode('{\\rtf1 ' || replace(replace(replace(decode(t), '\\', '\\\\'), '{', '\\{'), '}', '\\}') || '}')", "rtfMetadata,rtfMetadata"))
def clean_rtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = lambda t: F.replace(F.replace(F.replace(t.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}")).cast("binary")
    return _cleaned(spark, sf_dir, "rtf", lambda t: _join(b"{\\rtf1 ", b"{\\info{\\author Ann \\} Bob}}", escaped(t), b"{\\*\\generator x;}", b"}"))


@query("q_clean_svg", """SELECT doc_id, sha256('<svg xmlns="http://www.w3.org/2000/svg"><text>' || replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</text></svg>') AS sha256 FROM documents""")
def clean_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    content = F.concat(F.lit('<?xml version="1.0"?><svg xmlns="http://www.w3.org/2000/svg" onload="x()"><!-- by Ann --><metadata>m</metadata><text style="background:url(http://x)">'), text, F.lit("</text><script>1</script></svg>"))
    docs = table(spark, sf_dir, "documents").select("doc_id", content.cast("binary").alias("content"))
    return markup.cleaned_svg(docs, ["doc_id"]).select("doc_id", F.sha2("cleaned", 256).alias("sha256"))


_CORE, _APP = (len(packages.PROPERTY_PARTS[k][1]) for k in ("/metadata/core-properties", "/extended-properties"))


@query("q_clean_docx", f"SELECT doc_id, CAST(CASE WHEN name = 'docProps/core.xml' THEN {_CORE} WHEN name = 'docProps/app.xml' THEN {_APP} WHEN name = 'word/document.xml' THEN 7 + strlen(coalesce(text, '')) + 8 END AS BIGINT) AS usize, name FROM documents, (VALUES ('word/document.xml'), ('docProps/core.xml'), ('docProps/app.xml')) AS v(name)")
def clean_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package around each text: its properties are emptied, a private part is gone, the text's part stays."""
    types = b'<Types xmlns="t"><Override PartName="/docProps/meta.xml"/><Override PartName="/word/document.xml"/></Types>'
    rels = b'<Relationships xmlns="r"><Relationship Id="1" Type="http://x/metadata/core-properties" Target="docProps/core.xml"/><Relationship Id="2" Type="http://x/officeDocument" Target="word/document.xml"/></Relationships>'
    parts = [("[Content_Types].xml", types), ("_rels/.rels", rels), ("word/document.xml", None), ("docProps/core.xml", b"<a>Ann</a>"), ("docProps/app.xml", b"<b/>"), ("docProps/meta.xml", b"<m/>")]
    docs = table(spark, sf_dir, "documents")
    body = F.concat(F.lit(b"<w:doc>"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")), F.lit(b"</w:doc>"))
    rows = docs.select("doc_id", F.inline(F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), (F.lit(d) if d is not None else body).alias("content")) for i, (n, d) in enumerate(parts)))))
    built = packages.archives(rows.withColumnRenamed("doc_id", "archive")).withColumn("kind", F.lit("ooxml"))
    entries = packages.entries(packages.cleaned(built, ["archive"], content_col="data"), "archive", "cleaned")
    return entries.where("name like 'docProps/%' or name like 'word/%'").select(F.col("file_id").alias("doc_id"), "usize", "name")


@query("q_segments", "SELECT 'header' AS segment, true AS keep, count(*) AS n FROM documents UNION ALL SELECT 'extension fe', false, count(*) FROM documents UNION ALL SELECT 'image', true, count(*) FROM documents UNION ALL SELECT 'trailer', true, count(*) FROM documents")
def all_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").alias("file_id"), F.lit("gif").alias("kind"), _join(b"GIF89a\1\0\1\0\0\0\0\x21\xfe", _blocks(text), b"\x2c\0\0\0\0\1\0\1\0\0\2", _blocks(text), b"\x3b").alias("content"))
    return segments.segments(rows).groupBy("segment", "keep").agg(F.count("*").alias("n"))


@query("q_file_report", "SELECT doc_id AS file_id, true AS ok, '2 fields (Author & copyright, Comments & description)' AS text FROM documents")
def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", F.lit("mp3").alias("kind"), _join(b"ID3\3\0\0\0\0\0\0", b"\xff\xfb\x90\0", text, b"TAG" + bytes(125)).alias("content"))
    return reports.file_report(segments.cleaned(rows, ["doc_id"]).withColumnRenamed("doc_id", "file_id")).select("file_id", "ok", "text")


@query("q_inspect_fields", "SELECT doc_id AS file_id, key, CASE WHEN key = 'PNG:Comment' THEN sha256(coalesce(text, '')) ELSE v END AS value, key IN ('PNG:Comment', 'PNG:Software') AS sensitive FROM documents, (VALUES ('PNG:ImageWidth', sha256('2')), ('PNG:ImageHeight', sha256('3')), ('PNG:BitDepth', sha256('8')), ('PNG:ColorType', sha256('6')), ('PNG:Comment', ''), ('PNG:Software', sha256('x'))) AS f(key, v)")
def inspect_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as the comment of an image, found again with the image's facts."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    content = _join(b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR\0\0\0\2\0\0\0\3\x08\6\0\0\0crc!", _big(F.octet_length(text) + 8), b"tEXtComment\0", text, b"crc!\0\0\0\x0atEXtSoftware\0xcrc!\0\0\0\0IENDcrc!")
    found = inspection.inspect(docs.select(F.col("doc_id").alias("file_id"), F.lit("png").alias("kind"), content.alias("content")))
    return found.select("file_id", "key", F.sha2("value", 256).alias("value"), "sensitive")


@query(
    "q_hygiene",
    "SELECT doc_id AS file_id, doc_id % 4 <> 2 AS ok, CASE doc_id % 4 WHEN 0 THEN 'copy' WHEN 1 THEN 'byte-surgery' WHEN 3 THEN 'svg-sanitize' END AS strategy, CASE doc_id % 4 WHEN 0 THEN 'no sensitive fields' WHEN 1 THEN '1 field (Author & copyright, Comments & description)' WHEN 3 THEN '1 field (Scripts & unsafe SVG content)' END AS summary FROM documents",
)
def whole_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as plain files, as MP3 data behind a tag, as damaged images and inside SVG, through the whole path."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    escaped = F.replace(F.replace(F.replace(text.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")).cast("binary")
    k = F.col("doc_id") % 4
    content = F.when(k == 0, _join(b"text ", text)).when(k == 1, _join(b"ID3\3\0\0\0\0\0\0\xff\xfb\x90\0", text)).when(k == 2, _join(b"\x89PNG\r\n\x1a\n", text)).otherwise(_join(b"<svg xmlns='s'><text>", escaped, b"</text></svg>"))
    name = F.when(k == 0, "a.txt").when(k == 1, "a.mp3").when(k == 2, "a.png").otherwise("a.svg")
    done = hygiene.clean(files.from_table(docs, "doc_id", content, name))
    return done.select("file_id", "ok", "strategy", "summary")


@query(
    "q_hygiene_refusals",
    "SELECT doc_id AS file_id, doc_id % 6 = 0 AS ok, CASE doc_id % 6 WHEN 1 THEN 'suspicious_file' WHEN 2 THEN 'invalid_filename' WHEN 3 THEN 'unsupported_format' WHEN 4 THEN 'suspicious_file' WHEN 5 THEN 'unsupported_format' END AS error, CASE WHEN doc_id % 6 IN (1, 4) THEN 'The content does not match the file''s name.' WHEN doc_id % 6 = 2 THEN 'The file name is not valid.' WHEN doc_id % 6 IN (3, 5) THEN 'The format is not supported.' END AS message FROM documents",
)
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a whole package, one without its main part, and files whose names or contents don't fit, through the whole path."""
    docs = table(spark, sf_dir, "documents")
    k, text = F.col("doc_id") % 6, F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    main = F.when(k == 0, "word/document.xml").otherwise("word/other.xml")
    parts = [(F.lit("[Content_Types].xml"), F.lit(b"<Types/>")), (F.lit("_rels/.rels"), F.lit(b"<Relationships/>")), (main, _join(b"<w:doc>", text, b"</w:doc>"))]
    rows = docs.where(k <= 1).select(F.col("doc_id").alias("archive"), F.inline(F.array(*(F.struct(F.lit(i).alias("pos"), n.alias("name"), c.alias("content")) for i, (n, c) in enumerate(parts)))))
    built = packages.archives(rows).select(F.col("archive").cast("long").alias("file_id"), F.lit("a.docx").alias("name"), F.col("data").alias("content"))
    name = F.when(k == 2, "a..txt").when(k == 3, "a.png").when(k == 4, "a.jpg").otherwise("a.xyz")
    content = F.when(k == 4, _join(b"\x89PNG\r\n\x1a\n", text)).otherwise(_join(b"text ", text))
    others = docs.where(k > 1).select(F.col("doc_id").alias("file_id"), name.alias("name"), content.alias("content"))
    return hygiene.clean(built.unionByName(others)).select("file_id", "ok", "error", "message")


@query("q_verify_packages", "SELECT doc_id, doc_id % 3 = 0 AS accepted FROM documents")
def verify_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages around every text: cleaned ones are accepted, dirty ones and those with bytes behind their end are not."""
    docs = table(spark, sf_dir, "documents")
    body = F.concat(F.lit(b"<w:doc>"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")), F.lit(b"</w:doc>"))
    parts = [("[Content_Types].xml", F.lit(b"<Types/>")), ("_rels/.rels", F.lit(b"<Relationships/>")), ("word/document.xml", body), ("docProps/core.xml", F.lit(b"<cp>Ann</cp>"))]
    rows = docs.select(F.col("doc_id").alias("archive"), F.inline(F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), c.alias("content")) for i, (n, c) in enumerate(parts)))))
    built = packages.archives(rows).select(F.col("archive").cast("long").alias("doc_id"), F.lit("ooxml").alias("kind"), "data")
    k = F.col("doc_id") % 3
    clean = packages.cleaned(built.where(k != 1), ["doc_id", "kind"], content_col="data").select("doc_id", "kind", F.when(k == 2, F.concat("cleaned", F.lit(b"tail"))).otherwise(F.col("cleaned")).alias("cleaned"))
    checked = verification.verified(clean.unionByName(built.where(k == 1).withColumnRenamed("data", "cleaned")), ["doc_id"])
    return checked.select("doc_id", F.col("problem").isNull().alias("accepted"))


@query("q_verify_rtf", "SELECT doc_id, doc_id % 4 = 0 AS clean FROM documents")
def verify_rtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    heads = F.array(*(F.lit(h) for h in (b"{\\rtf1 ", b"{\\rtf1 {\\*\\generator x}", b"{\\rtf1 \\bin3 abc", b"plain ")))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\\\\{}]", " ").cast("binary")
    return docs.select("doc_id", verification.rtf_is_clean(_join(F.element_at(heads, (F.col("doc_id") % 4).cast("int") + 1), text, b"}")).alias("clean"))


def queries() -> dict[str, Query]:
    from tidemark.plans import container_queries  # noqa: F401  (registers its own)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
