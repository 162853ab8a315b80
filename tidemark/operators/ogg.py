"""Ogg: pages as rows, header packets across pages, comments emptied, streams paged and numbered anew, every checksum computed.

``nodes`` walks the pages of all logical streams, checks their sums, and finds each stream's header packets (Vorbis and Opus;
others are refused) through the lacing of segments.  Column rules choose which pages stay and number them: the pages that hold
a stream's further headers give way to as many as the emptied comment and what follows it need, and later pages count on from
there.  The bodies of audio pages aren't touched; a digest over bodies, lacing, flags and positions must be the same afterwards.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.segments import FAULTS, Damaged, _need
from tidemark.operators.splice import reading, values
from tidemark.session import ship

# First bytes of each codec's identification and comment packets, number of header packets, an empty comment.
CODECS = {"vorbis": (b"\x01vorbis", b"\x03vorbis", 3), "opus": (b"OpusHead", b"OpusTags", 2)}
EMPTY = {"vorbis": b"\x03vorbis" + bytes(8) + b"\x01", "opus": b"OpusTags" + bytes(8)}
MAX_PAGES, SEGMENTS = 2_000_000, 255

_TURNED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def checksum(page: bytes) -> int:
    """The format's CRC (not reflected, from zero) of a page whose own sum is zero."""
    raw = zlib.crc32(page.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{raw:032b}"[::-1], 2)


def page(flags: int, position: bytes, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    """A page with its checksum."""
    head = b"OggS\0" + bytes([flags]) + position + serial.to_bytes(4, "little") + sequence.to_bytes(4, "little")
    tail = bytes([len(lacing)]) + lacing + body
    return head + checksum(head + bytes(4) + tail).to_bytes(4, "little") + tail


def laced(packets: list[bytes]) -> bytes:
    """Segment sizes of whole packets."""
    return b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)


def paged(packets: list[bytes], serial: int, sequence: int) -> list[bytes]:
    """Header pages of whole packets; a page in which no packet ends has no position."""
    lacing, body, out, at = laced(packets), b"".join(packets), [], 0
    for k in range(0, len(lacing), SEGMENTS):
        own = lacing[k : k + SEGMENTS]
        size = sum(own)
        goes_on = k > 0 and lacing[k - 1] == 255
        ends = any(x < 255 for x in own)
        out.append(page(int(goes_on), bytes(8) if ends else b"\xff" * 8, serial, sequence + len(out), own, body[at : at + size]))
        at += size
    return out


def tree(b: bytes) -> tuple[list[dict], list[dict]]:
    """Pages in the order of the file, and logical streams."""
    pages, streams, at = [], {}, 0
    while at < len(b):
        _need(b[at : at + 5] == b"OggS\0" and at + 27 <= len(b) and len(pages) < MAX_PAGES, "bad Ogg page")
        count = b[at + 26]
        body = at + 27 + count
        lacing = b[at + 27 : body]
        end = body + sum(lacing)
        _need(len(lacing) == count and end <= len(b), "truncated Ogg page")
        whole = b[at:end]
        _need(checksum(whole[:22] + bytes(4) + whole[26:]) == int.from_bytes(whole[22:26], "little"), "Ogg checksum")
        flags, serial, sequence = b[at + 5], int.from_bytes(b[at + 14 : at + 18], "little"), int.from_bytes(b[at + 18 : at + 22], "little")
        own = streams.get(serial)
        if flags & 2:
            _need(own is None and count > 0, "an Ogg stream begins twice")
            codec = next((c for c, (first, _, _) in CODECS.items() if b[body:end].startswith(first)), None)
            _need(codec is not None and lacing[-1] < 255, "unknown Ogg stream")
            own = streams[serial] = {"serial": serial, "codec": codec, "packets": [b[body:end]], "open": [], "sum": hashlib.sha256(), "rate": 0, "channels": 0, "last": 0}
            own["channels"] = b[body + (11 if codec == "vorbis" else 9)] if end - body > 12 else 0
            own["rate"] = int.from_bytes(b[body + 12 : body + 16], "little") if codec == "vorbis" else 48000
            header = True
        else:
            _need(own is not None, "an Ogg page of no stream")
            wanted = CODECS[own["codec"]][2]
            header = len(own["packets"]) < wanted
            if header:
                p = begun = body
                for size in lacing:
                    _need(len(own["packets"]) < wanted, "audio on a header page")
                    p += size
                    if size < 255:
                        own["packets"].append(b"".join([*own["open"], b[begun:p]]))
                        own["open"], begun = [], p
                own["open"].append(b[begun:p])
            else:
                own["sum"].update(bytes([flags]) + b[at + 6 : at + 14] + lacing + b[body:end])
                position = int.from_bytes(b[at + 6 : at + 14], "little", signed=True)
                own["last"] = max(own["last"], position)
        pages.append({"begin": at, "body": body, "end": end, "serial": serial, "sequence": sequence, "first": bool(flags & 2), "header": header})
        at = end
    _need(bool(streams), "empty Ogg file")
    out = []
    for own in streams.values():
        first, comment, wanted = CODECS[own["codec"]]
        _need(len(own["packets"]) == wanted and own["packets"][1].startswith(comment), "Ogg stream without headers")
        tags = own["packets"][1]
        out.append({"serial": own["serial"], "codec": own["codec"], "comment": tags, "setup": b"".join(own["packets"][2:]), "dirty": tags != EMPTY[own["codec"]], "digest": own["sum"].hexdigest(), "rate": own["rate"], "channels": own["channels"], "last": own["last"]})
    return pages, out


def comments(packet: bytes, codec: str) -> list[tuple[str, str]]:
    """Vendor and fields of a comment packet, as far as they can be read."""
    out, at = [], 7 if codec == "vorbis" else 8
    number = lambda p: int.from_bytes(packet[p : p + 4], "little")
    size = number(at)
    if size:
        out.append(("Vorbis:Vendor", packet[at + 4 : at + 4 + size].decode("utf-8", "replace")))
    at += 4 + size
    left, at = number(at), at + 4
    while left and at + 4 <= len(packet):
        size = number(at)
        name, _, value = packet[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        out.append((f"Vorbis:{name.title()}", value))
        at, left = at + 4 + size, left - 1
    return out


_PAGE = pa.struct([("begin", pa.int64()), ("body", pa.int64()), ("end", pa.int64()), ("serial", pa.int64()), ("sequence", pa.int64()), ("first", pa.bool_()), ("header", pa.bool_())])
_STREAM = pa.struct([("serial", pa.int64()), ("codec", pa.string()), ("setup", pa.binary()), ("dirty", pa.bool_()), ("digest", pa.string()), ("rate", pa.int64()), ("channels", pa.int64()), ("last", pa.int64())])
GRAPH = "struct<pages:array<struct<begin:bigint,body:bigint,end:bigint,serial:bigint,sequence:bigint,first:boolean,header:boolean>>,streams:array<struct<serial:bigint,codec:string,setup:binary,dirty:boolean,digest:string,rate:bigint,channels:bigint,last:bigint>>,error:string>"


def read(contents: Iterable[bytes | None]) -> pa.Array:
    """(pages, streams, error) of each file's bytes; null for null.  Comments, which can be long, aren't among them."""
    out = []
    for b in contents:
        try:
            pages, streams = tree(b) if b is not None else ([], [])
            streams = [{k: v for k, v in s.items() if k != "comment"} for s in streams]
            out.append(None if b is None else {"pages": pages, "streams": streams, "error": None})
        except (Damaged, ValueError, IndexError, OverflowError) as error:
            out.append({"pages": [], "streams": [], "error": str(error) if isinstance(error, Damaged) else "damaged Ogg file"})
    return pa.array(out, pa.struct([("pages", pa.list_(_PAGE)), ("streams", pa.list_(_STREAM)), ("error", pa.string())]))


def nodes(content: Column, made: Callable[[bytes], bytes] | None = None) -> Column:
    """What ``read`` gives, of a column.  ``made``: see ``splice.values``."""
    return reading(read, GRAPH, content, made)


def streams(files: DataFrame, id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """file_id, serial, codec, digest (of audio), pages, last (the last page's number) of every logical stream; a damaged file gives one row of codec ``error``."""
    ship(files.sparkSession)
    schema = "file_id long, serial long, codec string, digest string, pages long, last long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, content in zip(batch.column(0).to_pylist(), values(batch.column(1))):
                try:
                    pages, found = tree(content)
                    for s in found:
                        own = [p["sequence"] for p in pages if p["serial"] == s["serial"]]
                        out.append((file, s["serial"], s["codec"], s["digest"], len(own), own[-1]))
                except FAULTS:
                    out.append((file, None, "error", None, 0, None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in schema.split(", ")])

    return files.select(F.col(id_col).cast("long").alias("file_id"), F.coalesce(F.col(content_col), F.lit(b"")).alias("content")).mapInArrow(read, schema)


def streams_read(files: DataFrame, id_col: str = "file_id", nodes_col: str = "nodes") -> DataFrame:
    """As ``streams``, of files that are read already: ``nodes_col`` is what ``nodes`` gave of them, null of a damaged file."""
    g = F.col(nodes_col)
    kind = "array<struct<serial:bigint,codec:string,digest:string,pages:bigint,last:bigint>>"

    def row(s: Column) -> Column:
        own = F.filter(g["pages"], lambda p: p["serial"] == s["serial"])
        return F.struct(s["serial"], s["codec"], s["digest"], F.size(own), F.element_at(own, -1)["sequence"])

    found = F.when(g.isNotNull() & g["error"].isNull(), F.transform(g["streams"], row).cast(kind))
    error = F.array(F.struct(F.lit(None), F.lit("error"), F.lit(None), F.lit(0), F.lit(None))).cast(kind)
    return files.select(F.col(id_col).cast("long").alias("file_id"), F.inline(F.coalesce(found, error)))


def plan(g: Column) -> Column:
    """Pages that stay with their new numbers, the streams' headers with the number of pages they take, and the tokens."""
    length = lambda s: F.when(s["codec"] == "vorbis", len(EMPTY["vorbis"])).otherwise(len(EMPTY["opus"]))
    lacing = lambda n: F.floor(n / 255) + 1
    needed = lambda s: F.ceil((lacing(length(s)) + F.when(F.octet_length(s["setup"]) > 0, lacing(F.octet_length(s["setup"]))).otherwise(0)) / SEGMENTS).cast("long")
    old = lambda s: F.size(F.filter(g["pages"], lambda p: (p["serial"] == s["serial"]) & p["header"] & ~p["first"])).cast("long")
    streams = F.transform(g["streams"], lambda s: F.struct(s["serial"].alias("serial"), s["codec"].alias("codec"), s["setup"].alias("setup"), (needed(s) - old(s)).alias("more")))
    stay = F.filter(g["pages"], lambda p: p["first"] | ~p["header"])
    moved = lambda p: F.when(p["first"], p["sequence"]).otherwise(p["sequence"] + F.filter(streams, lambda s: s["serial"] == p["serial"])[0]["more"])
    pages = F.transform(stay, lambda p: F.struct(p["begin"].alias("begin"), p["body"].alias("body"), p["end"].alias("end"), p["serial"].alias("serial"), p["first"].alias("first"), moved(p).alias("sequence")))
    tokens = F.when(F.exists(g["streams"], lambda s: s["dirty"]), F.array(F.lit("vorbisComment"))).otherwise(F.array().cast("array<string>"))
    return F.struct(pages.alias("pages"), streams.alias("streams"), tokens.alias("tokens"))


def apply(b: bytes, plan: dict) -> bytes:
    """The pages of the plan; a stream's further headers stand before the first page that isn't a first one."""
    out, waiting = [], {s["serial"]: s for s in plan["streams"]}
    begun = []

    def headers() -> None:
        for serial, sequence in begun:
            s = waiting.pop(serial)
            out.extend(paged([EMPTY[s["codec"]], *([s["setup"]] if s["setup"] else [])], serial, sequence + 1))
        begun.clear()

    for p in plan["pages"]:
        if not p["first"]:
            headers()
        at, body = p["begin"], p["body"]
        out.append(page(b[at + 5], b[at + 6 : at + 14], p["serial"], p["sequence"], b[at + 27 : body], b[body : p["end"]]))
        if p["first"]:
            begun.append((p["serial"], p["sequence"]))
    headers()
    return b"".join(out)


def problem(before: Column, after: Column, result: Column) -> Column:
    """What is wrong with a result, by its own pages; null if nothing."""
    digests = lambda g: F.array_sort(F.transform(g["streams"], lambda s: F.struct(s["serial"].alias("serial"), s["digest"].alias("digest"))))
    numbered = lambda g: F.forall(g["streams"], lambda s: F.transform(F.filter(g["pages"], lambda p: p["serial"] == s["serial"]), lambda p, i: p["sequence"] - i) == F.array_repeat(F.filter(g["pages"], lambda p: p["serial"] == s["serial"])[0]["sequence"], F.size(F.filter(g["pages"], lambda p: p["serial"] == s["serial"]))))
    return F.coalesce(after["error"], F.when(~digests(before).eqNullSafe(digests(after)), "audio changed"), F.when(F.exists(after["streams"], lambda s: s["dirty"]), "metadata left"), F.when(numbered(before) & ~numbered(after), "pages out of order"))
