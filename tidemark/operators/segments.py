"""Segments of image and audio files: where they are, which stay, and the cleaned bytes.

Each format has a small reader that walks a file's bytes and yields ``Segment``s in order.  ``segments`` turns them into rows,
the query surface; ``cleaned`` joins the kept ones of a file again in the same task, so no bytes are shuffled.  A file that
breaks its format's rules gets an error in its row and no output; it never fails the job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

PROFILE_BYTES = 512 << 10  # of a colour profile that is kept


class Damaged(ValueError):
    """The bytes break the rules of their format."""


#: What a reader of damaged bytes may raise; it becomes an error in the file's row.
FAULTS = (Damaged, ValueError, LookupError, TypeError, OverflowError, RecursionError, struct.error, zlib.error)


class Segment(NamedTuple):
    """``token`` names what a dropped segment held (None: not reported); ``data`` replaces a kept segment's bytes."""

    kind: str
    start: int
    end: int
    keep: bool
    token: str | None = None
    data: bytes | None = None


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise Damaged(what)


# --- PNG and WebP: typed chunks ---------------------------------------------------------------------------------------

# Chunks that take part in rendering.
PNG_KEPT = "IHDR PLTE IDAT IEND tRNS gAMA cHRM sRGB sBIT pHYs bKGD acTL fcTL fdAT iCCP".split()
WEBP_KEPT = ["VP8 ", "VP8L", "VP8X", "ALPH", "ANIM", "ANMF", "ICCP"]


def png(b: bytes) -> Iterator[Segment]:
    _need(b[:8] == b"\x89PNG\r\n\x1a\n", "not a PNG")
    yield Segment("signature", 0, 8, True)
    at, kind = 8, ""
    while kind != "IEND":
        _need(at + 12 <= len(b), "PNG ends before IEND")
        size, kind = int.from_bytes(b[at : at + 4], "big"), b[at + 4 : at + 8].decode("latin-1")
        _need(kind.isascii() and kind.isalpha() and at + 12 + size <= len(b), "bad PNG chunk")
        keep = kind in PNG_KEPT and not (kind == "iCCP" and size > PROFILE_BYTES)
        yield Segment(kind, at, at + 12 + size, keep, None if keep else kind)
        at += 12 + size


def webp(b: bytes) -> Iterator[Segment]:
    _need(len(b) >= 12 and b[:4] == b"RIFF" and b[8:12] == b"WEBP", "not a WebP")
    end = min(len(b), 8 + int.from_bytes(b[4:8], "little"))
    chunks, at = [], 12
    while at < end:
        _need(at + 8 <= end, "truncated WebP chunk")
        kind, size = b[at : at + 4].decode("latin-1"), int.from_bytes(b[at + 4 : at + 8], "little")
        stop = at + 8 + size + size % 2
        _need(at + 8 + size <= end, "truncated WebP chunk")
        keep = kind in WEBP_KEPT and not (kind == "ICCP" and size > PROFILE_BYTES)
        data = None
        if kind == "VP8X" and size:
            data = b[at : at + 8] + bytes([b[at + 8] & ~0x0C]) + b[at + 9 : stop]
        chunks.append(Segment(kind, at, min(stop, end), keep, None if keep else kind.strip(), data))
        at = stop
    size = 4 + sum(len(c.data) if c.data else c.end - c.start for c in chunks if c.keep)
    yield Segment("RIFF", 0, 12, True, None, b"RIFF" + size.to_bytes(4, "little") + b"WEBP")
    yield from chunks


# --- JPEG -------------------------------------------------------------------------------------------------------------


def _ifd0(tiff: bytes) -> dict[int, tuple[int, bytes]]:
    """Tags of the first directory of an Exif block: type and the four value bytes in big-endian order."""
    order = {b"II*\0": "little", b"MM\0*": "big"}.get(tiff[:4])
    if order is None:
        return {}
    at = int.from_bytes(tiff[4:8], order)
    out = {}
    for k in range(int.from_bytes(tiff[at : at + 2], order)):
        e = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(e) < 12:
            break
        value = int.from_bytes(e[8:10], order) if int.from_bytes(e[2:4], order) == 3 else int.from_bytes(e[8:12], order)
        out[int.from_bytes(e[:2], order)] = int.from_bytes(e[2:4], order), value.to_bytes(4, "big")
    return out


# Identifying tags of the first directory.
EXIF_TOKENS = {0x8825: "GPS", 0x013B: "Author", 0x8298: "Author", 0x0131: "Software", 0x010F: "Software", 0x0110: "Software", 0x0132: "DateTime"}


def exif_tokens(tiff: bytes) -> list[str]:
    """What the first directory identifies."""
    return list(dict.fromkeys(EXIF_TOKENS[t] for t in _ifd0(tiff) if t in EXIF_TOKENS))


def exif_orientation(tiff: bytes) -> int | None:
    kind, value = _ifd0(tiff).get(0x0112, (0, b""))
    n = int.from_bytes(value, "big")
    return n if kind == 3 and 1 <= n <= 8 else None


def orientation_segment(orientation: int) -> bytes:
    """An Exif segment with the orientation alone."""
    tiff = b"MM\0*\0\0\0\x08\0\1" + b"\x01\x12\0\3\0\0\0\1" + orientation.to_bytes(2, "big") + b"\0\0" + b"\0\0\0\0"
    body = b"Exif\0\0" + tiff
    return b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body


def _application(marker: int, body: bytes, whole: bytes) -> tuple[bool, list[str], bytes | None]:
    """(keep, tokens, replacement) of an application or comment segment."""
    if marker == 0xFE:
        return False, ["Comment"], None
    if marker == 0xE0 and body[:5] == b"JFIF\0" and len(body) >= 14:
        return True, ["JFIF thumbnail"] * (len(body) > 14), b"\xff\xe0\0\x10" + body[:12] + b"\0\0"
    if marker == 0xE0:
        return False, ["APP0" if body[:5] == b"JFIF\0" else "JFXX/APP0"], None
    if marker == 0xE1:
        return False, ["EXIF", *exif_tokens(body[6:])] if body[:6] == b"Exif\0\0" else ["XMP"], None
    if marker == 0xE2 and body[:12] == b"ICC_PROFILE\0" and len(whole) <= PROFILE_BYTES or marker == 0xEE and body[:5] == b"Adobe":
        return True, [], None
    return False, [f"APP{marker - 0xE0}"], None


def jpeg(b: bytes) -> Iterator[Segment]:
    _need(b[:2] == b"\xff\xd8", "not a JPEG")
    out, at, orientation, ended = [], 2, None, False
    while not ended:
        _need(at + 2 <= len(b) and b[at] == 0xFF, "JPEG marker expected")
        while at + 2 < len(b) and b[at + 1] == 0xFF:
            at += 1
        marker = b[at + 1]
        if marker == 0xD9:
            out.append(Segment("EOI", at, at + 2, True))
            at += 2
            ended = True
            continue
        _need(marker not in (0x00, 0xD8) and not 0xD0 <= marker <= 0xD7, "marker outside a scan")
        size = int.from_bytes(b[at + 2 : at + 4], "big")
        stop = at + 2 + size
        _need(size >= 2 and stop <= len(b), "bad JPEG segment length")
        body = b[at + 4 : stop]
        if 0xE0 <= marker <= 0xEF or marker == 0xFE:
            keep, tokens, data = _application(marker, body, b[at:stop])
            if marker == 0xE1 and body[:6] == b"Exif\0\0":
                orientation = exif_orientation(body[6:])
            out.append(Segment(f"{marker:02x}", at, stop, keep, tokens[0] if tokens else None, data))
            out += [Segment("tag", stop, stop, False, t) for t in tokens[1:]]
        elif marker == 0xDA:
            while True:
                stop = b.find(b"\xff", stop)
                _need(0 <= stop < len(b) - 1, "JPEG scan without an end")
                if b[stop + 1] in (0x00, 0xFF) or 0xD0 <= b[stop + 1] <= 0xD7:
                    stop += 1 if b[stop + 1] == 0xFF else 2
                    continue
                break
            out.append(Segment("scan", at, stop, True))
        else:
            out.append(Segment(f"{marker:02x}", at, stop, True))
        at = stop
    yield Segment("SOI", 0, 2, True)
    if orientation and orientation > 1:
        yield Segment("orientation", 2, 2, True, None, orientation_segment(orientation))
    yield from out
    if at < len(b):
        yield Segment("trailer", at, len(b), False, "Trailing data after EOI")


# --- GIF --------------------------------------------------------------------------------------------------------------


def gif(b: bytes) -> Iterator[Segment]:
    _need(b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 13, "not a GIF")

    def table(flags: int) -> int:
        return 3 << (flags & 7) + 1 if flags & 0x80 else 0

    def blocks(at: int) -> int:
        while True:
            _need(at < len(b), "truncated GIF blocks")
            size = b[at]
            at += 1 + size
            if not size:
                return at

    at = 13 + table(b[10])
    _need(at <= len(b), "truncated GIF colour table")
    yield Segment("header", 0, at, True)
    while True:
        _need(at < len(b), "GIF without a trailer")
        if b[at] == 0x3B:
            yield Segment("trailer", at, at + 1, True)
            return
        if b[at] == 0x2C:
            _need(at + 11 <= len(b), "truncated GIF image")
            stop = blocks(at + 10 + table(b[at + 9]) + 1)
            yield Segment("image", at, stop, True)
        else:
            _need(b[at] == 0x21 and at + 2 < len(b), "unknown GIF block")
            label, stop = b[at + 1], blocks(at + 2)
            name = b[at + 3 : at + 14].decode("latin-1") if label == 0xFF and b[at + 2] >= 11 else ""
            keep = label == 0xF9 or name in ("NETSCAPE2.0", "ANIMEXTS1.0")
            token = "comment" if label == 0xFE else ("xmp" if "XMP" in name else f"app:{name}") if label == 0xFF else f"ext:0x{label:02x}"
            yield Segment(f"extension {label:02x}", at, stop, keep, None if keep else token)
        at = stop


# --- MP3 and FLAC -----------------------------------------------------------------------------------------------------


def _synchsafe(b: bytes) -> int:
    _need(len(b) == 4 and max(b) < 0x80, "bad tag size")
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _leading_tags(b: bytes) -> Iterator[Segment]:
    at = 0
    while b[at : at + 3] == b"ID3" and at + 10 <= len(b):
        stop = at + 10 + _synchsafe(b[at + 6 : at + 10]) + (10 if b[at + 5] & 0x10 else 0)
        _need(stop <= len(b), "tag longer than the file")
        yield Segment("id3v2", at, stop, False, "id3")
        at = stop


def _trailing_tag(b: bytes, begin: int, end: int) -> tuple[int, str] | None:
    """Where the last tag before ``end`` begins, and its name."""
    size = end - begin
    if size >= 128 and b[end - 128 : end - 125] == b"TAG":
        plus = size >= 355 and b[end - 355 : end - 351] == b"TAG+"
        return end - (355 if plus else 128), "id3"
    if size >= 32 and b[end - 32 : end - 24] == b"APETAGEX":
        n = int.from_bytes(b[end - 20 : end - 16], "little", signed=True)
        header = 32 if int.from_bytes(b[end - 12 : end - 8], "little") & 0x80000000 else 0
        _need(0 < n and n + header <= size, "bad APE tag size")
        return end - n - header, "ape"
    if size >= 20 and b[end - 10 : end - 7] == b"3DI":
        n = _synchsafe(b[end - 4 : end]) + 20
        _need(n <= size, "bad appended tag size")
        return end - n, "id3"
    if size >= 15 and b[end - 9 : end] == b"LYRICS200":
        digits = b[end - 15 : end - 9]
        _need(digits.isdigit() and int(digits) + 15 <= size, "bad lyrics size")
        return end - int(digits) - 15, "lyrics"
    return None


def mp3(b: bytes) -> Iterator[Segment]:
    first = list(_leading_tags(b))
    begin, end, last = first[-1].end if first else 0, len(b), []
    while found := _trailing_tag(b, begin, end):
        last.append(Segment("tag", found[0], end, False, found[1]))
        end = found[0]
    _need(end - begin >= 2 and b[begin] == 0xFF and b[begin + 1] & 0xE0 == 0xE0, "no MPEG frame")
    yield from first
    yield Segment("frames", begin, end, True)
    yield from reversed(last)


# Sizes of cue sheet records, and their fields that tell something as (offset, length, bits that stay).
# The last byte of a header or track says how many records follow below it.
CUE_HEADER = (396, [(0, 128, 0x00), (136, 1, 0x80), (137, 258, 0x00)])
CUE_TRACK = (36, [(9, 12, 0x00), (21, 1, 0xC0), (22, 13, 0x00)])
CUE_INDEX = (12, [(9, 3, 0x00)])


def clean_cuesheet(body: bytes) -> bytes:
    """A cue sheet without catalogue number, ISRCs and reserved bytes."""
    done: list[bytes] = []

    def record(size: int, fields: list[tuple[int, int, int]]) -> int:
        at = sum(map(len, done))
        own = bytearray(body[at : at + size])
        _need(len(own) == size, "short cue sheet")
        for offset, length, stays in fields:
            own[offset : offset + length] = bytes(b & stays for b in own[offset : offset + length])
        done.append(bytes(own))
        return own[-1]

    for _ in range(record(*CUE_HEADER)):
        for _ in range(record(*CUE_TRACK)):
            record(*CUE_INDEX)
    out = b"".join(done)
    _need(len(out) == len(body), "cue sheet of wrong length")
    return out


# FLAC block types.
FLAC_TOKENS = {2: "application", 4: "vorbisComment", 6: "flacPicture"}


def flac(b: bytes) -> Iterator[Segment]:
    tags = list(_leading_tags(b))
    at = tags[-1].end if tags else 0
    _need(b[at : at + 4] == b"fLaC", "not a FLAC")
    yield from tags
    yield Segment("marker", at, at + 4, True)
    at += 4
    found, last = [], False
    while not last:
        _need(at + 4 <= len(b), "truncated FLAC block")
        last, kind, size = bool(b[at] & 0x80), b[at] & 0x7F, int.from_bytes(b[at + 1 : at + 4], "big")
        stop = at + 4 + size
        _need(stop <= len(b) and kind <= 6, "bad FLAC block")
        body = b[at + 4 : stop]
        if kind in (0, 3, 5):
            body = clean_cuesheet(body) if kind == 5 else body
            found.append((Segment(str(kind), at, stop, True, "cuesheetMetadata" if kind == 5 else None), kind, body))
        else:
            found.append((Segment(str(kind), at, stop, False, FLAC_TOKENS.get(kind)), kind, body))
        at = stop
    kept = [i for i, (s, _, _) in enumerate(found) if s.keep]
    _need(bool(kept) and found[kept[0]][1] == 0, "FLAC without stream information")
    for i, (segment, kind, body) in enumerate(found):
        head = bytes([kind | (0x80 if i == kept[-1] else 0)]) + len(body).to_bytes(3, "big")
        yield segment._replace(data=head + body) if segment.keep else segment
    yield Segment("frames", at, len(b), True)


# --- RTF --------------------------------------------------------------------------------------------------------------

# Destinations that hold metadata.
RTF_GROUPS = ["info", "generator", "userprops", "passwordhash", "docvar"]


def _rtf_pass(b: bytes) -> list[Segment]:
    import re

    opener = re.compile(rb"\{\s*(?:\\\*\s*)?\\(?:" + "|".join(RTF_GROUPS).encode() + rb")(?![A-Za-z])")
    _need(not re.search(rb"\\bin-?[0-9]", b), "RTF with binary data")
    depth, dropped_at, begin, kept_from, out = 0, 0, 0, 0, []
    for m in re.finditer(rb"\\.|[{}]", b, re.DOTALL):
        if m[0] == b"{":
            depth += 1
            if not dropped_at and opener.match(b, m.start()):
                dropped_at, begin = depth, m.start()
                out.append(Segment("text", kept_from, begin, True))
        elif m[0] == b"}":
            if dropped_at == depth and dropped_at:
                out.append(Segment("group", begin, m.end(), False, "rtfMetadata"))
                dropped_at, kept_from = 0, m.end()
            depth -= 1
            _need(depth >= 0, "unbalanced RTF")
    _need(depth == 0, "unbalanced RTF")
    out.append(Segment("text", kept_from, len(b), True))
    return out


def rtf(b: bytes) -> Iterator[Segment]:
    """Groups are dropped until none is left; the segments are those of the first pass, with what later passes leave."""
    _need(b[:5] == b"{\\rtf", "not an RTF")
    found, text = _rtf_pass(b), b
    again = found
    while not all(s.keep for s in again):
        text = b"".join(text[s.start : s.end] for s in again if s.keep)
        again = _rtf_pass(text)
    _need(text[:5] == b"{\\rtf", "nothing of the RTF is left")
    once = b"".join(b[s.start : s.end] for s in found if s.keep)
    if text == once:
        yield from found
    else:
        yield Segment("text", 0, len(b), True, "rtfMetadata", text)


READERS: dict[str, Callable[[bytes], Iterator[Segment]]] = {"png": png, "webp": webp, "jpeg": jpeg, "gif": gif, "mp3": mp3, "flac": flac, "rtf": rtf}
#: Tokens that a cleaned file may still give: the part stays in a harmless form.
HARMLESS = {"cuesheetMetadata", "EXIF"}


def clean_bytes(content: bytes, kind: str) -> tuple[bytes, list[str]]:
    """Cleaned bytes and tokens of what went; a second pass must find nothing more."""
    def once(b: bytes) -> tuple[bytes, list[str]]:
        parts = list(READERS[kind](b))
        return b"".join(s.data if s.data is not None else b[s.start : s.end] for s in parts if s.keep), [s.token for s in parts if s.token]

    out, tokens = once(content)
    again, left = once(out)
    _need(again == out and set(left) <= HARMLESS, "cleaning isn't complete")
    return out, tokens


def segments(files: DataFrame, kind_col: str = "kind", id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """file_id, pos, segment, start, length, keep, token of every segment; a damaged file gives one row of segment ``error``."""
    ship(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, kind, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if kind not in READERS:
                    continue
                try:
                    out += [(file, i, s.kind, s.start, s.end - s.start, s.keep, s.token) for i, s in enumerate(list(READERS[kind](content)))]
                except FAULTS as error:
                    out.append((file, 0, "error", 0, len(content), False, str(error)))
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["file_id", "pos", "segment", "start", "length", "keep", "token"])

    rows = files.select(F.col(id_col).cast("long").alias("file_id"), F.col(kind_col).alias("kind"), F.coalesce(F.col(content_col), F.lit(b"")).alias("content"))
    return rows.mapInArrow(read, "file_id long, pos int, segment string, start long, length long, keep boolean, token string")


def cleaned(files: DataFrame, keep: list[str], kind_col: str = "kind", content_col: str = "content") -> DataFrame:
    """keep, cleaned (null if it failed), removed (tokens) and error of every file; no shuffle."""
    ship(files.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, content in zip(batch.column("kind_").to_pylist(), batch.column("content_").to_pylist()):
                if kind not in READERS:
                    out.append((None, [], "unsupported_without_tool"))
                    continue
                try:
                    out.append((*clean_bytes(content, kind), None))
                except FAULTS as error:
                    out.append((None, [], str(error)))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.list_(pa.string())), pa.array(columns[2], pa.string())], [*keep, "cleaned", "removed", "error"])

    kinds = "".join(f"{c} {files.schema[c].dataType.simpleString()}, " for c in keep)
    rows = files.select(*keep, F.col(kind_col).alias("kind_"), F.coalesce(F.col(content_col), F.lit(b"")).alias("content_"))
    return rows.mapInArrow(work, f"{kinds}cleaned binary, removed array<string>, error string")
