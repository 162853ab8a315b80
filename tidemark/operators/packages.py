"""ZIP packages (OOXML, ODF, EPUB): entries as rows, structural rules as aggregates and joins, cleaning, canonical rebuild, verification.

``entries`` is the query surface: one row per entry, from a small reader of central directories.  Limits, required parts and
offsets are then grouped aggregates, semi joins and windows.  ``cleaned`` rewrites each package in the task that read it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_
from typing import NamedTuple
from xml.dom import minidom
from xml.parsers.expat import ExpatError

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import resolve_target
from tidemark.operators.segments import FAULTS, Damaged, _need
from tidemark.session import ship

# Limits of an upload, and of an entry that is inflated.
MOST_ENTRIES = 2000
MOST_BYTES = 200 << 20
MOST_RATIO = 100
INFLATE_BYTES = 16 << 20
DOS_DATE = 0x21  # 1980-01-01

# Parts that a package of each format must have; a trailing slash stands for any entry below.
REQUIRED = {
    "docx": ["[Content_Types].xml", "_rels/.rels", "word/document.xml"],
    "xlsx": ["[Content_Types].xml", "_rels/.rels", "xl/workbook.xml"],
    "pptx": ["[Content_Types].xml", "_rels/.rels", "ppt/presentation.xml"],
    "odt": ["META-INF/manifest.xml", "content.xml"],
    "ods": ["META-INF/manifest.xml", "content.xml"],
    "odp": ["META-INF/manifest.xml", "content.xml"],
    "epub": ["META-INF/container.xml"],
}
MIMETYPES = {
    "odt": "application/vnd.oasis.opendocument.text",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "odp": "application/vnd.oasis.opendocument.presentation",
    "epub": "application/epub+zip",
}

# Fixed value: folders of which an EPUB must have one.
BOOK = "^(OEBPS|OPS|EPUB)/"

# Empty property parts, by the end of their relationship's type.
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\r\n'
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/"
PROPERTY_PARTS = {
    "/metadata/core-properties": ("docProps/core.xml", f'{_XML}<cp:coreProperties xmlns:cp="{_PACKAGE}" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:dcmitype="http://purl.org/dc/dcmitype/" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"/>'),
    "/extended-properties": ("docProps/app.xml", f'{_XML}<Properties xmlns="{_OFFICE}extended-properties" xmlns:vt="{_OFFICE}docPropsVTypes"/>'),
    "/custom-properties": ("docProps/custom.xml", f'{_XML}<Properties xmlns="{_OFFICE}custom-properties" xmlns:vt="{_OFFICE}docPropsVTypes"/>'),
}
_ODF = "urn:oasis:names:tc:opendocument:xmlns:"
ODF_META = f'<?xml version="1.0" encoding="UTF-8"?>\n<office:document-meta xmlns:office="{_ODF}office:1.0" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:meta="{_ODF}meta:1.0" office:version="1.2"><office:meta/></office:document-meta>'
MAX_DEPTH = 256  # levels of XML elements
EPUB_DROPPED = "creator contributor publisher date description rights source coverage relation".split()
EPUB_META = re.compile(r"^(rendition:|media:|schema:access|ibooks:)")
EPUB_MODIFIED = "1980-01-01T00:00:00Z"


class Entry(NamedTuple):
    name: str
    raw_name: bytes
    method: int
    crc: int
    csize: int
    usize: int
    flags: int
    offset: int
    data: bytes


def read_entries(b: bytes) -> list[Entry]:
    """Entries in the order of the central directory; anything unusual is refused."""
    at = b.rfind(b"PK\5\6", max(0, len(b) - 65_557))
    _need(at >= 0 and at + 22 <= len(b), "no end of central directory")
    disk, first_disk, here, total, size, start, comment = struct.unpack("<HHHHIIH", b[at + 4 : at + 22])
    _need(not disk and not first_disk and here == total and 0xFFFF not in (here, total) and 0xFFFFFFFF not in (size, start), "several disks or ZIP64")
    _need(start + size == at and at + 22 + comment == len(b), "central directory out of place")
    out, p, seen, stored = [], start, set(), 0
    for _ in range(total):
        _need(b[p : p + 4] == b"PK\1\2" and p + 46 <= at, "bad central record")
        flags, method, _, _, crc, csize, usize, n, x, c = struct.unpack("<HHHHIIIHHH", b[p + 8 : p + 34])
        (offset,) = struct.unpack("<I", b[p + 42 : p + 46])
        raw = b[p + 46 : p + 46 + n]
        name = raw.decode("utf-8", "replace")
        _need(not flags & 1 and method in (0, 8) and 0xFFFFFFFF not in (csize, usize, offset), "encrypted, ZIP64 or unknown method")
        _need(bool(name) and not re.search(r"\x00|\\|^/|(^|/)\.\.(/|$)", name) and name.lower() not in seen, "bad or repeated name")
        _need(b[offset : offset + 4] == b"PK\3\4", "bad local record")
        n2, x2 = struct.unpack("<HH", b[offset + 26 : offset + 30])
        begin = offset + 30 + n2 + x2
        stored += csize
        _need(begin + csize <= start and stored <= len(b), "data out of bounds")
        seen.add(name.lower())
        out.append(Entry(name, raw, method, crc, csize, usize, flags, offset, b[begin : begin + csize]))
        p += 46 + n + x + c
    _need(p == at, "central directory of wrong size")
    return out


def content_of(entry: Entry) -> bytes:
    """An entry's bytes, of bounded size."""
    if entry.method == 0:
        _need(entry.csize <= INFLATE_BYTES, "entry too large")
        return entry.data
    try:
        out = zlib.decompressobj(-15).decompress(entry.data, INFLATE_BYTES + 1)
    except zlib.error as error:
        raise Damaged("bad deflate data") from error
    _need(len(out) <= INFLATE_BYTES, "entry too large")
    return out


def write_package(rows: list[tuple[str, int, bytes, int, int]]) -> bytes:
    """The canonical package of (name, method, stored bytes, crc, size): no times, extras, comments or attributes."""
    body, directory = [], []
    offset = 0
    for name, method, data, crc, size in rows:
        raw = name.encode()
        flags = 0x0800 if not raw.isascii() else 0
        common = struct.pack("<HHHHHIIIHH", 20, flags, method, 0, DOS_DATE, crc, len(data), size, len(raw), 0)
        body.append(b"PK\3\4" + common + raw + data)
        directory.append(b"PK\1\2" + struct.pack("<H", 20) + common + struct.pack("<HHHII", 0, 0, 0, 0, offset) + raw)
        offset += len(body[-1])
    size = sum(map(len, directory))
    return b"".join([*body, *directory, b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(rows), len(rows), size, offset, 0)])


def rebuilt(entries: list[Entry], replace: dict[str, bytes], remove: set[str]) -> bytes:
    """The package with some entries replaced and some gone; the others keep their method and stored bytes."""
    rows = []
    for e in entries:
        if e.name in remove:
            continue
        if e.name in replace:
            new = replace[e.name]
            if e.method:
                deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
                rows.append((e.name, 8, deflate.compress(new) + deflate.flush(), zlib.crc32(new), len(new)))
            else:
                rows.append((e.name, 0, new, zlib.crc32(new), len(new)))
        else:
            rows.append((e.name, e.method, e.data, e.crc, e.usize))
    return write_package(rows)


def stored_package(files: list[tuple[str, bytes]]) -> bytes:
    """A package of uncompressed files."""
    return write_package([(n, 0, d, zlib.crc32(d), len(d)) for n, d in files])


def parse(content: bytes) -> minidom.Document:
    _need(b"<!doctype" not in content[:65536].lower(), "document type declarations aren't allowed")
    try:
        document = minidom.parseString(content)
    except (ExpatError, ValueError) as error:
        raise Damaged("not well-formed XML") from error
    level, depth = document.childNodes, 0
    while level:
        depth += 1
        _need(depth <= MAX_DEPTH, "XML nested too deeply")
        level = [child for node in level for child in node.childNodes]
    return document


def local(node) -> str:
    return (node.localName or node.tagName).lower()


def elements(node) -> list:
    return [n for n in node.getElementsByTagName("*")]


def part_name(target: str) -> str:
    """A relationship target as a part name."""
    from urllib.parse import unquote

    out: list[str] = []
    try:
        target = unquote(target.strip(), errors="strict")
    except UnicodeDecodeError:
        target = target.strip()
    for step in target.removeprefix("/").split("/"):
        if step == "..":
            out = out[:-1]
        elif step not in ("", "."):
            out.append(step)
    return "/".join(out)


def _pruned(content: bytes, tag: str, gone) -> bytes | None:
    """XML without the elements called ``tag`` for which ``gone(element)``; None if none is."""
    document = parse(content)
    found = [e for e in elements(document) if local(e) == tag and gone(e)]
    for e in found:
        e.parentNode.removeChild(e)
    return document.documentElement.toxml().encode() if found else None


def clean_ooxml(entries: list[Entry]) -> tuple[dict[str, bytes], set[str]]:
    by_name = {e.name: e for e in entries}
    _need("[Content_Types].xml" in by_name and "_rels/.rels" in by_name, "not an OOXML package")
    lower = {e.name.lower(): e.name for e in entries}
    replace = {name: xml.encode() for name, xml in PROPERTY_PARTS.values() if name in by_name}
    remove: set[str] = set()
    metadata, other = {}, set()
    for r in elements(parse(content_of(by_name["_rels/.rels"]))):
        if local(r) != "relationship" or r.getAttribute("TargetMode").lower() == "external":
            continue
        part, kind = lower.get(part_name(r.getAttribute("Target")).lower()), r.getAttribute("Type").lower()
        if part is None:
            continue
        xml = next((x for end, (_, x) in PROPERTY_PARTS.items() if kind.endswith(end)), None)
        if xml or kind.endswith("/metadata/thumbnail"):
            metadata[part] = xml
        else:
            other.add(part)
    _need(not other & set(metadata), "a part is both content and metadata")
    for part, xml in metadata.items():
        if xml:
            replace[part] = xml.encode()
        else:
            remove.add(part)
    standard = {name for name, _ in PROPERTY_PARTS.values()}
    remove |= {e.name for e in entries if e.name.lower().startswith("docprops/") and e.name not in standard and e.name not in metadata}
    gone = {n.lower() for n in remove}
    if gone:
        for name, tag, attribute in (("_rels/.rels", "relationship", "Target"), ("[Content_Types].xml", "override", "PartName")):
            new = _pruned(content_of(by_name[name]), tag, lambda e, a=attribute: part_name(e.getAttribute(a)).lower() in gone)
            if new is not None:
                replace[name] = new
    return {n: x for n, x in replace.items() if n not in remove}, remove


def clean_odf(entries: list[Entry]) -> tuple[dict[str, bytes], set[str]]:
    names = {e.name: e for e in entries}
    remove = {n for n in names if n.lower().startswith("thumbnails/") and not n.endswith("/")}
    replace = {"meta.xml": ODF_META.encode()} if "meta.xml" in names else {}
    if remove and "META-INF/manifest.xml" in names:
        new = _pruned(content_of(names["META-INF/manifest.xml"]), "file-entry", lambda e: (e.getAttribute("manifest:full-path") or e.getAttribute("full-path")) in remove)
        if new is not None:
            replace["META-INF/manifest.xml"] = new
    return replace, remove


def clean_opf(content: bytes, product: str) -> bytes:
    """A package document without the people, places and dates behind it."""
    document = parse(content)
    for block in [e for e in elements(document) if local(e) in ("metadata", "dc-metadata", "x-metadata")]:
        for e in [c for c in block.childNodes if c.nodeType == c.ELEMENT_NODE]:
            name, text = local(e), "".join(n.data for n in e.childNodes if n.nodeType in (n.TEXT_NODE, n.CDATA_SECTION_NODE))
            new = None
            if name == "identifier":
                new = f"urn:{product}:{hashlib.sha256(text.strip().encode()).hexdigest()[:32]}"
            elif name == "meta" and e.getAttribute("property").lower() == "dcterms:modified":
                new = EPUB_MODIFIED
            elif name in EPUB_DROPPED or name == "meta" and not EPUB_META.match(e.getAttribute("property").lower()) and e.getAttribute("name").lower() != "cover":
                block.removeChild(e)
            if new is not None:
                for child in list(e.childNodes):
                    e.removeChild(child)
                e.appendChild(document.createTextNode(new))
    return document.documentElement.toxml().encode()


def clean_epub(entries: list[Entry], product: str = "tidemark") -> tuple[dict[str, bytes], set[str]]:
    names = {e.name: e for e in entries}
    _need("META-INF/container.xml" in names, "no container")
    paths = list(dict.fromkeys(e.getAttribute("full-path").removeprefix("/") for e in elements(parse(content_of(names["META-INF/container.xml"]))) if local(e) == "rootfile"))
    _need(bool(paths) and all(p in names for p in paths), "a package document is missing")
    return {p: clean_opf(content_of(names[p]), product) for p in paths}, set()


def clean_package(b: bytes, kind: str) -> tuple[bytes, list[str]]:
    """(bytes, tokens) of a package of kind ooxml, odf or epub."""
    entries = read_entries(b)
    replace, remove = {"ooxml": clean_ooxml, "odf": clean_odf, "epub": clean_epub}[kind](entries)
    tokens = ["epubMetadata"] if kind == "epub" else []
    touched = {n.lower() for n in [*replace, *remove]}
    if any(t.startswith("thumbnails/") or "thumbnail" in t for t in touched):
        tokens.append("thumbnail")
    if any(t.startswith("docprops/") or t == "meta.xml" for t in touched):
        tokens.append("documentProperties")
    out = rebuilt(entries, replace, remove)
    verify_canonical(out)
    return out, tokens


def verify_canonical(b: bytes) -> int:
    """Every byte of a package is where the canonical form has it; returns the number of entries.  Shares no code with the reader."""
    _need(len(b) >= 22 and b[-22:-18] == b"PK\5\6" and b[-2:] == b"\0\0", "not canonical: end")
    n, size, start = int.from_bytes(b[-12:-10], "little"), int.from_bytes(b[-10:-6], "little"), int.from_bytes(b[-6:-2], "little")
    _need(b[-18:-10] == bytes(4) + b[-12:-10] * 2 and start + size + 22 == len(b), "not canonical: counts")
    at, local_at, names = start, 0, set()
    for _ in range(n):
        _need(b[at : at + 6] == b"PK\1\2\x14\0", "not canonical: central record")
        shared = b[at + 6 : at + 32]
        width, stored = int.from_bytes(shared[22:24], "little"), int.from_bytes(shared[14:18], "little")
        name = b[at + 46 : at + 46 + width]
        _need(shared[:2] == b"\x14\0" and shared[2:4] in (b"\0\0", b"\0\x08") and shared[4:6] in (b"\0\0", b"\x08\0") and shared[6:10] == b"\0\0\x21\0" and shared[24:26] == b"\0\0", "not canonical: fields")
        _need(b[at + 32 : at + 42] == bytes(10) and int.from_bytes(b[at + 42 : at + 46], "little") == local_at, "not canonical: offset")
        _need(b[local_at : local_at + 30 + width] == b"PK\3\4" + shared + name, "not canonical: local record")
        _need(name.lower() not in names, "not canonical: repeated name")
        names.add(name.lower())
        at, local_at = at + 46 + width, local_at + 30 + width + stored
    _need(local_at == start and at == len(b) - 22, "not canonical: gaps")
    return n


# --- Spark --------------------------------------------------------------------------------------------------------------

ENTRY_SCHEMA = "file_id long, pos int, name string, method int, crc long, csize long, usize long, flags int, local_offset long, head binary, error string"


def entries(files: DataFrame, id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """One row per entry (head: the bytes of a small stored one); a refused package gives one row with ``error``."""
    ship(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.binary(), pa.string())
        for batch in batches:
            out = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    for i, e in enumerate(read_entries(content)):
                        out.append((file, i, e.name, e.method, e.crc, e.csize, e.usize, e.flags, e.offset, e.data if e.method == 0 and e.csize <= 256 else None, None))
                except FAULTS as error:
                    out.append((file, 0, *[None] * 8, str(error)))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return files.select(F.col(id_col).cast("long").alias("file_id"), F.coalesce(F.col(content_col), F.lit(b"")).alias("content")).mapInArrow(read, ENTRY_SCHEMA)


def _fits(entries: Column, usize: Column, csize: Column, bad: Column) -> Column:
    ok = ~bad & entries.between(1, MOST_ENTRIES) & (usize <= MOST_BYTES) & (usize <= MOST_RATIO * F.greatest(csize, F.lit(1)))
    return F.coalesce(ok, F.lit(False))


def _complete(format: Column, has: Callable[[str], Column], mime: Column, book: Column) -> Column:
    """Whether a package has the parts of its format; ``has`` tells whether it holds a name."""
    out = F.lit(False)
    for name, parts in REQUIRED.items():
        good = reduce(and_, map(has, parts))
        if name in MIMETYPES:
            good = good & mime.eqNullSafe(F.lit(MIMETYPES[name]))
        out = F.when(format == name, good & book if name == "epub" else good).otherwise(out)
    return F.coalesce(out, F.lit(False))


def within_limits(rows: DataFrame) -> DataFrame:
    """file_id, entries, usize, csize and ok: the limits of an upload, over rows of ``entries``."""
    found = rows.groupBy("file_id").agg(F.count("name").alias("entries"), F.sum("usize").alias("usize"), F.sum("csize").alias("csize"), F.bool_or(F.col("error").isNotNull() | ((F.col("csize") == 0) & (F.col("usize") > 0))).alias("bad"))
    return found.select("file_id", "entries", "usize", "csize", _fits(F.col("entries"), F.col("usize"), F.col("csize"), F.col("bad")).alias("ok"))


def has_required_parts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of ``files`` (file_id, format) whose package has all parts of its format: one aggregate over its entries, one join."""
    parts = sorted({p for own in REQUIRED.values() for p in own})
    found = rows.groupBy("file_id").agg(
        *(F.bool_or(F.col("name") == p).alias(f"part_{i}_") for i, p in enumerate(parts)),
        F.max(F.when((F.col("name") == "mimetype") & (F.col("method") == 0), F.decode("head", "ISO-8859-1"))).alias("mime_"),
        F.bool_or(F.col("name").rlike(BOOK)).alias("book_"),
    )
    complete = _complete(F.col("format"), lambda p: F.col(f"part_{parts.index(p)}_"), F.col("mime_"), F.col("book_"))
    return files.join(found, "file_id").where(complete).select(*files.columns)


def directory(content: Column) -> Column:
    """The entries of a package as an array (head: the text of a small stored one); null for what can't be read."""

    @F.arrow_udf("array<struct<name:string,method:int,csize:bigint,usize:bigint,head:string>>")
    def read(content: pa.Array) -> pa.Array:
        entry = pa.struct([("name", pa.string()), ("method", pa.int32()), ("csize", pa.int64()), ("usize", pa.int64()), ("head", pa.string())])
        out = []
        for b in content.to_pylist():
            try:
                out.append(None if b is None else [(e.name, e.method, e.csize, e.usize, e.data.decode("latin-1") if e.method == 0 and e.csize <= 256 else None) for e in read_entries(b)])
            except FAULTS:
                out.append(None)
        return pa.array(out, pa.list_(entry))

    return read(content)


def is_acceptable(format: Column, listing: Column) -> Column:
    """Whether a package with this ``directory`` keeps the limits of an upload and has the parts of its format; no shuffle."""
    total = lambda field: F.aggregate(listing, F.lit(0).cast("long"), lambda n, e: n + e[field])
    limits = _fits(F.size(listing), total("usize"), total("csize"), F.exists(listing, lambda e: (e["csize"] == 0) & (e["usize"] > 0)))
    mime = F.get(F.filter(listing, lambda e: (e["name"] == "mimetype") & (e["method"] == 0)), F.lit(0))["head"]
    return limits & _complete(format, lambda p: F.exists(listing, lambda e: e["name"] == p), mime, F.exists(listing, lambda e: e["name"].rlike(BOOK)))


def with_contiguity(rows: DataFrame, header_bytes: int = 30) -> DataFrame:
    """``rows`` with ok: whether each entry of the package begins where the ones before it end; one shuffle."""
    package = Window.partitionBy("file_id")
    before = package.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    expected = F.coalesce(F.sum(F.lit(header_bytes) + F.octet_length("name") + F.col("csize")).over(before), F.lit(0))
    return rows.withColumn("fits_", expected == F.col("local_offset")).withColumn("ok", F.bool_and("fits_").over(package)).drop("fits_")


def contiguous(rows: DataFrame, header_bytes: int = 30) -> DataFrame:
    """file_id and ok: each entry begins where the ones before it end (a running sum)."""
    return with_contiguity(rows, header_bytes).groupBy("file_id").agg(F.bool_and("ok").alias("ok"))


def unique_names(rows: DataFrame, archive: str = "archive", name: str = "name", order: str = "pos") -> DataFrame:
    """``rows`` with unique_name: the n-th repeat of a name in an archive gets (n - 1) before its extension."""
    nth = F.row_number().over(Window.partitionBy(archive, name).orderBy(order)) - 1
    base, ext = F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 2)
    return rows.withColumn("unique_name", F.when(nth == 0, F.col(name)).otherwise(F.concat(base, F.format_string(" (%d)", nth), ext)))


def pruned_references(references: DataFrame, removed: DataFrame) -> DataFrame:
    """``references`` (file_id, target) without those that resolve to a ``removed`` part (file_id, part): an anti join."""
    resolved = references.withColumn("part_", F.lower(resolve_target(F.col("target"))))
    return resolved.join(removed.select("file_id", F.lower("part").alias("part_")), ["file_id", "part_"], "left_anti").drop("part_")


def cleaned(files: DataFrame, keep: list[str], kind_col: str = "kind", content_col: str = "content") -> DataFrame:
    """keep, cleaned (null if refused), removed and error of every package; no shuffle."""
    ship(files.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, content in zip(batch.column("kind_").to_pylist(), batch.column("content_").to_pylist()):
                try:
                    out.append((*clean_package(content, kind), None))
                except FAULTS as error:
                    out.append((None, [], str(error)))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.list_(pa.string())), pa.array(columns[2], pa.string())], [*keep, "cleaned", "removed", "error"])

    kinds = "".join(f"{c} {files.schema[c].dataType.simpleString()}, " for c in keep)
    return files.select(*keep, F.col(kind_col).alias("kind_"), F.coalesce(F.col(content_col), F.lit(b"")).alias("content_")).mapInArrow(work, f"{kinds}cleaned binary, removed array<string>, error string")


def archives(files: DataFrame, archive: str = "archive", name: str = "name", content: str = "content", order: str = "pos") -> DataFrame:
    """One stored package per archive: archive and data; an archive is what one download holds, so its files fit in a task."""
    ship(files.sparkSession)

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["pos_"])
        return pa.table({"archive": pa.array([rows[0]["archive_"]], pa.string()), "data": pa.array([stored_package([(r["unique_name"], r["content_"]) for r in rows])], pa.binary())})

    named = unique_names(files, archive, name, order)
    return named.select(F.col(archive).cast("string").alias("archive_"), F.col(order).alias("pos_"), "unique_name", F.col(content).alias("content_")).groupBy("archive_").applyInArrow(build, "archive string, data binary")
