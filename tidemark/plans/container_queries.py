"""Queries over container formats, with their SQL: a file is built around each document's whole text, and the SQL builds it clean."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import containers, isomedia, ogg, streams
from tidemark.plans import hygiene
from tidemark.plans.catalog import _big, _expected, _join, _little, query, table
from tidemark.sources import uploads

MARK = b"\xde\xad\xbe\xef"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("binary"), F.lit(b""))


def _digest(rows: DataFrame, kind: str) -> DataFrame:
    done = containers.cleaned(rows, ["doc_id"], kind)
    return done.select("doc_id", F.sha2("cleaned", 256).alias("sha256"), F.octet_length("cleaned").cast("long").alias("bytes"), F.array_join("removed", ",").alias("removed"))


# --- PDF ------------------------------------------------------------------------------------------------------------------

_BODIES = {1: b"<</Type/Catalog/Pages 2 0 R/Metadata 6 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1>>", 3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>"}
_EXTRA = {4: b"<</Length 3>>stream\nold\nendstream", 6: b"<</Type/Metadata/Length 3>>stream\nAnn\nendstream", 8: b"<</Author(Ann)/Producer(Acme)>>"}


def _first_revision() -> tuple[bytes, int]:
    """A whole PDF with information, metadata and another content stream; and where its table is."""
    out, places = b"%PDF-1.4\n", {}
    for num, body in sorted((_BODIES | _EXTRA).items()):
        places[num] = len(out)
        out += b"%d 0 obj\n" % num + body + b"\nendobj\n"
    table = b"".join(b"%d 1\n%010d 00000 n \n" % (n, at) for n, at in places.items())
    return out + b"xref\n" + table + b"trailer\n<</Size 9/Root 1 0 R/Info 8 0 R>>\nstartxref\n%d\n%%%%EOF\n" % len(out), len(out)


def pdf_of(text: Column) -> Column:
    """The text as the content stream of a PDF's second revision."""
    first, at = _first_revision()
    own = _join(b"4 0 obj\n<</Length ", F.octet_length(text).cast("string").cast("binary"), b">>stream\n", text, b"\nendstream\nendobj\n")
    place = (F.octet_length(own) + len(first)).cast("string").cast("binary")
    return _join(first, own, b"xref\n4 1\n%010d 00000 n \ntrailer\n<</Size 9/Root 1 0 R/Info 8 0 R/Prev %d>>\nstartxref\n" % (len(first), at), place, b"\n%%EOF\n")


def _clean_pdf() -> str:
    head, places = b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n", [0]
    for num, body in _BODIES.items():
        places.append(len(head))
        head += b"%d 0 obj\n" % num + body.replace(b"/Metadata 6 0 R", b"") + b"\nendobj\n"
    places.append(len(head))
    rows = b"xref\n0 5\n" + b"0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % p for p in places[1:])
    hexed = lambda b: f"unhex('{b.hex()}')"
    body = f"({hexed(head + b'4 0 obj' + bytes([10]) + b'<</Length ')} || encode(n::VARCHAR) || {hexed(b'>>stream' + bytes([10]))} || t || {hexed(bytes([10]) + b'endstream' + bytes([10]) + b'endobj' + bytes([10]))})"
    tail = f"{hexed(rows)} || encode('trailer' || chr(10) || '<</Size 5/Root 1 0 R/ID[<' || md5(p) || '><' || md5(p) || '>]>>' || chr(10) || 'startxref' || chr(10) || octet_length(p)::VARCHAR || chr(10) || '%%EOF' || chr(10))"
    return f"WITH c AS (SELECT doc_id, encode(coalesce(text, '')) AS t, strlen(coalesce(text, '')) AS n FROM documents), y AS (SELECT doc_id, {body} AS p FROM c), x AS (SELECT doc_id, p || {tail} AS b FROM y) SELECT doc_id, sha256(b) AS sha256, CAST(octet_length(b) AS BIGINT) AS bytes, 'pdfInfo,pdfMetadata,pdfRevision' AS removed FROM x"


@query("q_clean_pdf", _clean_pdf())
def clean_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information, metadata stream and the earlier revision go; objects stay and get a new table."""
    return _digest(table(spark, sf_dir, "documents").select("doc_id", pdf_of(_text()).alias("content")), "pdf")


# --- ISO media ------------------------------------------------------------------------------------------------------------


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def _movie(private: bool, wide: bool) -> list[bytes]:
    """A movie's bytes before and between the three places of the text: its size (marked) in the sample table, and of the media box."""
    times = struct.pack(">II", 77, 78) if private else bytes(8)
    name = b"Ann's camera\0" if private else bytes(13)
    udta = _box(b"udta", _box(b"meta", bytes(4), b"Ann")) if private else b""
    ftyp = _box(b"ftyp", b"isom\0\0\0\0")
    uuid = _box(b"uuid", bytes(16) + b"<xmp>Ann") if private else b""

    def moov(at: int) -> bytes:
        place = _box(b"co64", bytes(4), struct.pack(">IQ", 1, at)) if wide else _box(b"stco", bytes(4), struct.pack(">II", 1, at))
        entry = _box(b"mp4a", bytes(6) + b"\0\1" + bytes(8) + struct.pack(">HHHHI", 2, 16, 0, 0, 48000 << 16))
        tables = _box(b"stbl", _box(b"stsd", bytes(4) + struct.pack(">I", 1), entry), _box(b"stsc", bytes(4) + struct.pack(">IIII", 1, 1, 1, 1)), _box(b"stsz", bytes(4) + struct.pack(">II", 0, 1) + MARK), place)
        mdia = _box(b"mdia", _box(b"mdhd", bytes(4) + times + struct.pack(">II", 1000, 5000) + bytes(4)), _box(b"hdlr", bytes(8) + b"soun" + bytes(12) + name), _box(b"minf", tables))
        trak = _box(b"trak", _box(b"tkhd", bytes(4) + times + struct.pack(">I", 1) + bytes(64)), udta, mdia)
        return _box(b"moov", _box(b"mvhd", bytes(4) + times + bytes(88)), trak, udta)

    size = len(ftyp + uuid + moov(0)) + 8
    before, after = (ftyp + uuid + moov(size)).split(MARK)
    return [before, after]


def movie_of(text: Column, wide: bool = False) -> Column:
    """The text as the one sample of a sound track, with user data, times and names around it and a stray passage behind it."""
    before, after = _movie(True, wide)
    size = F.octet_length(text)
    return _join(before, _big(size), after, _big(size + 8 + 5), b"mdat", text, b"stray")


def _clean_movie() -> str:
    forms = []
    for wide in (False, True):
        before, after = _movie(False, wide)
        forms.append(f"unhex('{before.hex()}' || printf('%08X', n) || '{after.hex()}' || printf('%08X', n + 13) || hex('mdat')) || t || unhex('0000000000')")
    return _expected(f"CASE WHEN doc_id % 2 = 0 THEN {forms[0]} ELSE {forms[1]} END", "uuid,udta,time")


@query("q_clean_mp4", _clean_movie())
def clean_mp4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User data, extension box, times, names and unreferenced media bytes go; chunk offsets of either width follow the sample."""
    content = F.when(F.col("doc_id") % 2 == 0, movie_of(_text())).otherwise(movie_of(_text(), True))
    return _digest(table(spark, sf_dir, "documents").select("doc_id", content.alias("content")), "isomedia")


def _box_sums() -> str:
    before, after = _movie(True, False)
    whole = before + MARK + after
    rows = []
    for box in isomedia._boxes(whole):
        keep = not any(b["kind"] in ("udta", "uuid") for b in isomedia._boxes(whole) if b["begin"] <= box["begin"] and box["end"] <= b["end"])
        rows.append((box["path"], box["begin"], box["end"] - box["begin"], keep))
    lost = [(b, n) for p, b, n, k in rows if not k]
    values = ", ".join(f"({p!r}, {b}, {n}, {k}, {sum(m for x, m in lost if x < b)})" for p, b, n, k in rows)
    return f"WITH s(path, pos, size, keep, shift) AS (VALUES {values}) SELECT doc_id AS file_id, path, pos::BIGINT AS begin, size::BIGINT AS size, keep, shift::BIGINT AS shift FROM documents, s UNION ALL SELECT doc_id, '/mdat', {len(whole)}, strlen(coalesce(text, '')) + 13, true, {sum(n for _, n in lost)} FROM documents"


@query("q_box_shifts", _box_sums())
def box_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every box of the same movies: where it is, whether it stays, and the running sum of the bytes removed before it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), movie_of(_text()).alias("content"))
    return isomedia.boxes(docs).select("file_id", "path", "begin", (F.col("end") - F.col("begin")).alias("size"), "keep", "shift")


# --- TIFF -----------------------------------------------------------------------------------------------------------------


def tiff_of(text: Column, big: bool, private: bool = True) -> Column:
    """The text as the only strip, behind a name that goes, before a directory whose place depends on its length."""
    order, number = (">", _big) if big else ("<", _little)
    size, name = F.octet_length(text), b"Ann's dog\0\0\0" if private else b""
    pad = F.when(size % 2 == 1, F.lit(b"\0")).otherwise(F.lit(b""))
    entry = lambda tag, kind, count, value: struct.pack(order + "HHII", tag, kind, count, value)
    fields = [entry(274, 4, 1, 6), *([entry(315, 2, 10, 8)] if private else []), entry(273, 4, 1, 8 + len(name))]
    fields.sort(key=lambda e: struct.unpack(order + "H", e[:2]))
    head = struct.pack(order + "2sH", b"MM" if big else b"II", 42)
    last = struct.pack(order + "HHI", 279, 4, 1)
    return _join(head, number(size + size % 2 + 8 + len(name)), name, text, pad, struct.pack(order + "H", len(fields) + 1), *sorted(fields[:2]), *([last, number(size), fields[2]] if private else [last, number(size)]), bytes(4))


def _clean_tiff() -> str:
    little = "substr(printf('%08X', {0}), 7, 2) || substr(printf('%08X', {0}), 5, 2) || substr(printf('%08X', {0}), 3, 2) || substr(printf('%08X', {0}), 1, 2)"
    forms = []
    for order, number in (("<", little), (">", "printf('%08X', {0})")):
        head, size = struct.pack(order + "2sH", b"MM" if order == ">" else b"II", 42).hex(), number.format("n")
        table_ = (struct.pack(order + "H", 3) + struct.pack(order + "HHII", 273, 4, 1, 8) + struct.pack(order + "HHII", 274, 4, 1, 6) + struct.pack(order + "HHI", 279, 4, 1)).hex()
        forms.append(f"unhex('{head}' || {number.format('(n + n % 2 + 8)')}) || t || unhex(CASE WHEN n % 2 = 1 THEN '00' ELSE '' END || '{table_}' || {size} || '00000000')")
    return _expected(f"CASE WHEN doc_id % 2 = 0 THEN {forms[0]} ELSE {forms[1]} END", "Author")


@query("q_clean_tiff", _clean_tiff())
def clean_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The author goes with the bytes of its name; strip and directory move up, in both byte orders."""
    content = F.when(F.col("doc_id") % 2 == 0, tiff_of(_text(), False)).otherwise(tiff_of(_text(), True))
    return _digest(table(spark, sf_dir, "documents").select("doc_id", content.alias("content")), "tiff")


# --- The whole path -------------------------------------------------------------------------------------------------------


@query(
    "q_hygiene_containers",
    """SELECT doc_id AS file_id, doc_id % 6 < 3 AS ok, CASE doc_id % 6 WHEN 0 THEN 'pdf-rewrite' WHEN 1 THEN 'container-rewrite' WHEN 2 THEN 'directory-rewrite' END AS strategy,
 CASE doc_id % 6 WHEN 3 THEN 'encrypted PDF' WHEN 4 THEN 'XML nested too deeply' WHEN 5 THEN 'a box longer than the one around it' END AS error,
 CASE doc_id % 6 WHEN 0 THEN 'PDF:Author,PDF:Producer,XMP:XMP' WHEN 1 THEN 'QuickTime:CreateDate,QuickTime:ModifyDate,Track1:HandlerDescription,UserData:udta,XMP:XMP' WHEN 2 THEN 'IFD0:Artist' ELSE '' END AS sensitive FROM documents""",
)
def hygiene_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDFs, movies and TIFFs, an encrypted PDF, a deeply nested SVG and a movie cut short, through the whole path; no file fails the job."""
    k, text = F.col("doc_id") % 6, _text()
    deep = b"<svg xmlns='s'>" + b"<g>" * 2000 + b"</g>" * 2000 + b"</svg>"
    locked = _join(b"%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<<>>\nendobj\ntrailer\n<</Root 1 0 R/Encrypt 9 0 R>>\n%", text)
    content = F.when(k == 0, pdf_of(text)).when(k == 1, movie_of(text)).when(k == 2, tiff_of(text, False)).when(k == 3, locked).when(k == 4, F.lit(deep)).otherwise(_join(movie_of(text), b"\0\0\0\x20cuts"))
    name = F.when(k.isin(0, 3), "a.pdf").when(k.isin(1, 5), "a.m4a").when(k == 2, "a.tif").otherwise("a.svg")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), name.alias("name"), content.alias("content"))
    return hygiene.clean(docs).select("file_id", "ok", "strategy", "error", F.array_join("sensitive", ",").alias("sensitive"))


@query(
    "q_stream_facts",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 5.0 ELSE strlen(coalesce(text, '')) / 44100.0 END AS duration, CASE WHEN doc_id % 2 = 0 THEN 'mp4a' ELSE 'flac' END AS codec, CASE WHEN doc_id % 2 = 0 THEN 48000 ELSE 44100 END::BIGINT AS sample_rate, 2::BIGINT AS channels FROM documents",
)
def stream_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration, codec, rate and channels of movies and of FLAC files whose number of samples is the length of the text."""
    even, text = F.col("doc_id") % 2 == 0, _text()
    facts = F.concat(F.lit("0AC442F"), F.lpad(F.hex(F.octet_length(text).cast("long")), 9, "0"))
    flac = _join(b"fLaC\x80\0\0\x22" + bytes(10), F.unhex(facts), bytes(16), b"\xff\xf8", text)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(even, "isomedia").otherwise("flac").alias("kind"), F.when(even, movie_of(text)).otherwise(flac).alias("content"))
    found = docs.select("doc_id", streams.probe(F.col("content"), F.col("kind")).alias("p"))
    stream = F.col("p.streams")[0]
    return found.select("doc_id", "p.duration", stream["codec_name"].alias("codec"), stream["sample_rate"].alias("sample_rate"), stream["channels"].alias("channels"))


# --- Ogg ------------------------------------------------------------------------------------------------------------------

PACKET = 60_000


def ogg_maker() -> Callable[[bytes], bytes]:
    """What makes of a text an Opus stream whose audio packets, one a page, are the text in pieces, with a comment that fills several pages."""
    head, fields = b"OpusHead\1\2" + bytes(9), [b"ARTIST=Ann", b"COMMENT=" + b"secret " * 12_000]
    tags = b"OpusTags" + (4).to_bytes(4, "little") + b"Lavf" + len(fields).to_bytes(4, "little") + b"".join(len(f).to_bytes(4, "little") + f for f in fields)
    headers = [ogg.page(2, bytes(8), 7, 0, ogg.laced([head]), head), *ogg.paged([tags], 7, 1)]

    def made(text: bytes) -> bytes:
        pages = list(headers)
        for at in range(0, max(1, len(text)), PACKET):
            pages.append(ogg.page(0, bytes(8), 7, len(pages), ogg.laced([text[at : at + PACKET]]), text[at : at + PACKET]))
        return b"".join(pages)

    return made


@query(
    "q_clean_ogg",
    f"""WITH c AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
 p AS (SELECT doc_id, n, greatest(1, (n + {PACKET - 1}) // {PACKET}) AS k, list_transform(range(greatest(1, (n + {PACKET - 1}) // {PACKET})), lambda i: '000000000000000000' || repeat('FF', least({PACKET}, n - i * {PACKET}) // 255) || printf('%02X', least({PACKET}, n - i * {PACKET}) % 255) || substr(h, {2 * PACKET} * i + 1, {2 * PACKET})) AS pages FROM c)
 SELECT doc_id, sha256(unhex(array_to_string(pages, ''))) AS digest, 'opus' AS codec, CAST(k + 2 AS BIGINT) AS pages, CAST(k + 1 AS BIGINT) AS last FROM p""",
)
def clean_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments over several pages give way to one page; audio pages keep bodies, lacing and positions, and count on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _text().alias("content"))
    found = ogg.streams_read(containers.cleaned(docs, ["doc_id"], "ogg", made=ogg_maker(), again=True), "doc_id")
    return found.select(F.col("file_id").alias("doc_id"), "codec", "digest", "pages", "last")


# --- Uploaded packages ----------------------------------------------------------------------------------------------------


def package_of(text: Column, header: Column, second: Column) -> Column:
    """A package of one stored entry ``a.bin`` that holds the text, with central records at ``header`` and ``second`` (null: none)."""
    size = F.octet_length(text)
    local = _join(b"PK\3\4\x14\0\0\0\0\0\0\0\0\0", _little(F.crc32(text)), _little(size), _little(size), b"\5\0\0\0a.bin", text)
    central = lambda at: _join(b"PK\1\2\x14\0\x14\0\0\0\0\0\0\0\0\0", _little(F.crc32(text)), _little(size), _little(size), b"\5" + bytes(13), _little(at), b"a.bin")
    count = F.when(second.isNull(), F.lit(b"\1\0\1\0")).otherwise(F.lit(b"\2\0\2\0"))
    records = F.concat(central(header), F.coalesce(central(second), F.lit(b"")))
    return F.concat(local, records, F.lit(b"PK\5\6\0\0\0\0"), count, _little(F.octet_length(records)), _little(F.octet_length(local)), F.lit(b"\0\0"))


@query(
    "q_upload_faults",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 2 THEN 'bad directory' WHEN 2 * strlen(coalesce(text, '')) > strlen(coalesce(text, '')) + 35 + 2 * 51 + 22 THEN 'entries larger than the archive' ELSE 'entries overlap' END AS fault,
 CASE WHEN doc_id % 3 = 2 THEN 0 ELSE 1 + (doc_id % 3 = 1)::INT END::INT AS entries, CASE WHEN doc_id % 3 < 2 THEN strlen(coalesce(text, '')) END AS size FROM documents""",
)
def upload_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages around every text: whole ones, ones whose two records name the same bytes, and ones whose record points beside its entry."""
    k = F.col("doc_id") % 3
    zero = F.lit(0).cast("long")
    content = package_of(_text(), F.when(k == 2, F.lit(9).cast("long")).otherwise(zero), F.when(k == 1, zero))
    rows = table(spark, sf_dir, "documents").select("doc_id", content.alias("content")).withColumn("l", uploads.listing(F.col("content")))
    return rows.select("doc_id", uploads.fault(F.col("l")).alias("fault"), F.size("l.entries").alias("entries"), F.get(F.col("l.entries"), F.lit(0))["csize"].alias("size"))
