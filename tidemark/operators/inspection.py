"""Embedded metadata as rows (file_id, key, value), keys as ``Group:Tag``: what the sensitivity rules and snapshots work on."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import is_sensitive, key_category
from tidemark.operators import isomedia, ogg, packages, pdf, segments, tiff
from tidemark.operators.segments import FAULTS
from tidemark.session import ship

# Names of directory tags, text frames, FLAC stream facts and RTF groups.
IFD_TAGS = {0x0100: "ImageWidth", 0x0101: "ImageHeight", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "ModifyDate", 0x013B: "Artist", 0x8298: "Copyright", 0x8769: "ExifOffset", 0x8825: "GPSInfo"}
ID3_FRAMES = {"TIT2": "Title", "TPE1": "Artist", "TALB": "Album", "TYER": "Year", "TDRC": "RecordingTime", "TENC": "EncodedBy", "TSSE": "EncoderSettings", "TCOM": "Composer", "TCOP": "Copyright", "COMM": "Comment", "APIC": "Picture", "PRIV": "Private"}
RTF_TAGS = ["author", "operator", "title", "subject", "company", "manager", "category", "keywords", "comment", "doccomm"]


def _exif(tiff: bytes) -> Iterator[tuple[str, str]]:
    order = "little" if tiff[:2] == b"II" else "big"
    for tag, (kind, raw) in segments._ifd0(tiff).items():
        value = int.from_bytes(raw, "big")
        if kind == 2:  # text of up to four bytes is in place, longer text elsewhere
            at = tiff.find(raw, 8)
            text = raw if order == "big" and not value >> 24 or value > len(tiff) else tiff[value : tiff.find(b"\0", value)] if value > 8 else raw
            yield f"IFD0:{IFD_TAGS.get(tag, f'0x{tag:04x}')}", text.split(b"\0")[0].decode("latin-1") if at or text else ""
        else:
            yield f"IFD0:{IFD_TAGS.get(tag, f'0x{tag:04x}')}", str(value)


def _jpeg(b: bytes) -> Iterator[tuple[str, str]]:
    for s in segments.jpeg(b):
        body = b[s.start + 4 : s.end]
        if s.kind == "e1" and body[:6] == b"Exif\0\0":
            yield from _exif(body[6:])
        elif s.kind == "e1":
            yield "XMP:XMP", body.split(b"\0", 1)[-1].decode("utf-8", "replace")
        elif s.kind == "fe":
            yield "File:Comment", body.decode("utf-8", "replace")
        elif s.kind == "e0" and body[:5] == b"JFIF\0":
            yield "JFIF:JFIFVersion", f"{body[5]}.{body[6]:02d}"
            if len(body) > 14:
                yield "JFIF:ThumbnailImage", str(len(body) - 14)
        elif s.kind == "e2" and body[:12] == b"ICC_PROFILE\0":
            yield "ICC_Profile:ProfileSize", str(len(body) - 14)
        elif s.kind == "ed":
            yield "Photoshop:IPTC", str(len(body))
        elif re.fullmatch("c[0-35-79-bd-f]", s.kind) and len(body) >= 6:
            yield "File:ImageHeight", str(int.from_bytes(body[1:3], "big"))
            yield "File:ImageWidth", str(int.from_bytes(body[3:5], "big"))
            yield "File:BitsPerSample", str(body[0])


def _png(b: bytes) -> Iterator[tuple[str, str]]:
    for s in segments.png(b):
        body = b[s.start + 8 : s.end - 4]
        if s.kind == "IHDR" and len(body) >= 10:
            yield "PNG:ImageWidth", str(int.from_bytes(body[:4], "big"))
            yield "PNG:ImageHeight", str(int.from_bytes(body[4:8], "big"))
            yield "PNG:BitDepth", str(body[8])
            yield "PNG:ColorType", str(body[9])
        elif s.kind in ("tEXt", "zTXt", "iTXt"):
            name, _, value = body.partition(b"\0")
            if s.kind == "zTXt":
                try:
                    value = zlib.decompressobj().decompress(value[1:], packages.INFLATE_BYTES)
                except zlib.error:
                    value = b""
            elif s.kind == "iTXt":
                value = value[2:].split(b"\0", 2)[-1]
            yield f"PNG:{name.decode('latin-1').replace(' ', '')}", value.decode("utf-8", "replace")
        elif s.kind == "eXIf":
            yield from _exif(body)
        elif s.kind == "tIME":
            yield "PNG:ModifyDate", body.hex()
        elif s.kind == "iCCP":
            yield "ICC_Profile:ProfileSize", str(len(body))


def _webp(b: bytes) -> Iterator[tuple[str, str]]:
    for s in segments.webp(b):
        body = b[s.start + 8 : s.end]
        if s.kind == "EXIF":
            yield from _exif(body.removeprefix(b"Exif\0\0"))
        elif s.kind == "XMP ":
            yield "XMP:XMP", body.decode("utf-8", "replace")
        elif s.kind == "ICCP":
            yield "ICC_Profile:ProfileSize", str(len(body))


def _gif(b: bytes) -> Iterator[tuple[str, str]]:
    yield "File:ImageWidth", str(int.from_bytes(b[6:8], "little"))
    yield "File:ImageHeight", str(int.from_bytes(b[8:10], "little"))
    for s in segments.gif(b):
        if s.token == "comment":
            yield "GIF:Comment", "".join(b[s.start + 3 : s.end - 1].decode("utf-8", "replace"))
        elif s.token == "xmp":
            yield "XMP:XMP", str(s.end - s.start)


def _id3(b: bytes) -> Iterator[tuple[str, str]]:
    major, at = b[3], 10
    while at + 10 <= len(b) and b[at]:
        name, raw = b[at : at + 4].decode("latin-1"), b[at + 4 : at + 8]
        size = int.from_bytes(raw, "big") if major < 4 else sum((x & 0x7F) << s for x, s in zip(raw, (21, 14, 7, 0)))
        value = b[at + 11 : at + 10 + size].decode("utf-16" if b[at + 10 : at + 11] == b"\1" else "latin-1", "replace").strip("\0")
        yield f"ID3v2_{major}:{ID3_FRAMES.get(name, name)}", value if name[0] == "T" else str(size)
        at += 10 + size


def _tagged(b: bytes, kind: str) -> Iterator[tuple[str, str]]:
    for s in segments.READERS[kind](b):
        if s.kind == "id3v2":
            yield from _id3(b[s.start : s.end])
        elif s.kind == "tag":
            yield {"id3": "ID3v1:Title", "ape": "APE:Title", "lyrics": "Lyrics3:Comment"}[s.token or "id3"], b[s.start + 3 : min(s.end, s.start + 33)].rstrip(b"\0 ").decode("latin-1")
        elif kind == "flac" and s.kind == "0":
            rate = int.from_bytes(b[s.start + 14 : s.start + 18], "big")
            yield "FLAC:SampleRate", str(rate >> 12)
            yield "FLAC:Channels", str((rate >> 9 & 7) + 1)
        elif kind == "flac" and s.kind == "4":
            body = b[s.start + 4 : s.end]
            size = int.from_bytes(body[:4], "little")
            yield "Vorbis:Vendor", body[4 : 4 + size].decode("utf-8", "replace")
            at = 8 + size
            while at + 4 <= len(body):
                n = int.from_bytes(body[at : at + 4], "little")
                name, _, value = body[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
                yield f"Vorbis:{name.title()}", value
                at += 4 + n
        elif kind == "flac" and s.kind == "6":
            yield "FLAC:Picture", str(s.end - s.start)


def _package(b: bytes, kind: str) -> Iterator[tuple[str, str]]:
    found = {e.name: e for e in packages.read_entries(b)}
    for name, e in found.items():
        lower = name.lower()
        if lower.startswith("docprops/") and lower.endswith(".xml") or name == "meta.xml":
            root = packages.parse(packages.content_of(e)).documentElement
            for child in packages.elements(root):
                text = "".join(n.data for n in child.childNodes if n.nodeType == n.TEXT_NODE).strip()
                if text:
                    tail = child.tagName.rpartition(":")[2]
                    yield f"XML:{tail[:1].upper()}{tail[1:]}", text
        elif "thumbnail" in lower:
            yield "ZIP:PreviewImage", str(e.usize)
        elif kind == "epub" and lower.endswith(".opf"):
            for child in packages.elements(packages.parse(packages.content_of(e))):
                text = "".join(n.data for n in child.childNodes if n.nodeType == n.TEXT_NODE).strip()
                if child.tagName.startswith("dc:") and text:
                    yield f"XML-dc:{child.tagName[3:].title()}", text


def _rtf(b: bytes) -> Iterator[tuple[str, str]]:
    for m in re.finditer(rb"\{\\(" + "|".join(RTF_TAGS).encode() + rb") ([^{}]*)\}", b):
        yield f"RTF:{m[1].decode().title()}", m[2].decode("latin-1")
    for m in re.finditer(rb"\{\\\*\\generator ([^{};]*)", b):
        yield "RTF:Generator", m[1].decode("latin-1")


def _pdf_text(value) -> str:
    if not isinstance(value, bytes):
        return str(value)
    raw = bytes.fromhex(re.sub(r"\s", "", value[1:-1].decode("latin-1")).ljust(2, "0")) if value[:1] == b"<" and len(value) % 2 == 0 else value[1:-1] if value[:1] == b"(" else value
    return raw.decode("utf-16" if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else "latin-1", "replace")


def _pdf(b: bytes) -> Iterator[tuple[str, str]]:
    file = pdf._File(b)
    info = pdf._get(file.trailer, b"Info")
    own = file.object(info.num) if isinstance(info, pdf.Ref) else None
    for key, (value, _, _) in (own.value if own and isinstance(own.value, dict) else {}).items():
        yield f"PDF:{key.decode('latin-1')}", _pdf_text(value)
    for node in pdf.graph(b):
        if node["type"] == "Metadata":
            yield "XMP:XMP", str(node["end"] - node["begin"])


def _iso(b: bytes) -> Iterator[tuple[str, str]]:
    zero = "0000:00:00 00:00:00"
    number = 0
    for box in isomedia.tree(b):
        if box["path"] == "/moov/trak":
            number += 1
        if box["kind"] == "mvhd" and len(box["facts"]) == 3:
            yield "QuickTime:CreateDate", zero if box["facts"][1] == "0" else box["facts"][1]
            yield "QuickTime:ModifyDate", zero if box["facts"][2] == "0" else box["facts"][2]
        elif box["kind"] == "hdlr" and box["facts"] and box["facts"][0]:
            yield f"Track{number}:HandlerDescription", box["facts"][0]
        elif box["kind"] == "uuid":
            yield "XMP:XMP", str(box["end"] - box["body"])
        elif box["kind"] in ("udta", "meta"):
            yield f"UserData:{box['kind']}", str(box["end"] - box["body"])


def _ogg(b: bytes) -> Iterator[tuple[str, str]]:
    for stream in ogg.tree(b)[1]:
        yield from ogg.comments(stream["comment"], stream["codec"])


def _tiff(b: bytes) -> Iterator[tuple[str, str]]:
    order, _, entries = tiff.graph(b)
    for e in entries:
        group, name = ("IFD0" if not e["ifd"] else "IFD1"), IFD_TAGS.get(e["tag"], f"0x{e['tag']:04x}")
        raw = b[e["begin"] : e["end"]]
        if e["tag"] == tiff.PROFILE:
            yield "ICC_Profile:ProfileSize", str(len(raw))
        elif e["tag"] == 700:
            yield "XMP:XMP", raw.decode("utf-8", "replace")
        else:
            yield f"{group}:{name}", raw.split(b"\0")[0].decode("latin-1") if e["type"] == 2 else str(int.from_bytes(raw[: tiff.TYPE_BYTES.get(e["type"], 1)], order))


def fields_of(content: bytes, kind: str) -> list[tuple[str, str]]:
    """Metadata of one file, in file order; a kind without embedded metadata has none."""
    if kind in ("mp3", "flac"):
        return list(_tagged(content, kind))
    if kind in ("ooxml", "odf", "epub"):
        return list(_package(content, kind))
    reader = {"jpeg": _jpeg, "png": _png, "webp": _webp, "gif": _gif, "rtf": _rtf, "pdf": _pdf, "isomedia": _iso, "tiff": _tiff, "ogg": _ogg}.get(kind)
    return list(reader(content)) if reader else []


def inspect(files: DataFrame, kind_col: str = "kind", id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """file_id, key, value, sensitive and category of every embedded field; files that can't be read give the key ``Error``."""
    ship(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, kind, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    out += [(file, k, v) for k, v in fields_of(content, kind)]
                except FAULTS as error:
                    out.append((file, "Error", str(error)))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], ["file_id", "key", "value"])

    rows = files.select(F.col(id_col).cast("long").alias("file_id"), F.col(kind_col).alias("kind"), F.coalesce(F.col(content_col), F.lit(b"")).alias("content")).mapInArrow(read, "file_id long, key string, value string")
    return rows.withColumn("sensitive", is_sensitive(F.col("key"), F.col("value"))).withColumn("category", F.when(F.col("sensitive"), key_category(F.col("key"))))
