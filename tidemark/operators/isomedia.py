"""ISO base media and QuickTime files: the box tree as rows, rules over the rows, chunk offsets moved by sums of removed bytes.

``nodes`` reads a file's boxes into one array: parent, ancestors, range, and of sample tables the chunks with their sizes.
Column rules choose the boxes that go (``removed``), the numbers that change (``patches``: sizes of boxes around removed ones,
chunk offsets less the bytes removed before them, times and names set to zero), and the bytes of media data that no playing
track refers to, which become zero.  Fragmented files, whose fragments count on their place, keep their geometry: there a
dropped box becomes an empty one of the same size.

Video, sound and subtitle tracks stay; chapters and data tracks go (in fragmented files they are refused).  The result is read
again: every playing track must yield the same sample bytes, by digest, or the file is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.segments import Damaged, _need
from tidemark.operators.splice import let, reading, spliced
from tidemark.session import ship

# Boxes that hold boxes, boxes that hold metadata or padding, and handlers of tracks that play.
CONTAINERS = "moov trak mdia minf stbl moof traf mvex edts tref".split()
DROPPED = "udta meta uuid free skip wide mfra".split()
DROPPED_REFERENCES = ["chap", "cdsc"]
HANDLERS = {"vide": "video", "soun": "audio", "sbtl": "subtitle", "subt": "subtitle", "clcp": "subtitle", "subp": "subtitle", "text": "subtitle"}
TIMED = ["mvhd", "tkhd", "mdhd"]
MAX_BOXES, MAX_LEVELS = 200_000, 12


def _boxes(b: bytes) -> list[dict]:
    """Boxes in the order of the file; containers before what they hold."""
    out, todo = [], [(0, len(b), -1, [], "")]
    while todo:
        at, end, parent, above, path = todo.pop()
        inner = []
        while at < end:
            _need(at + 8 <= end and len(out) < MAX_BOXES, "bad box")
            size, kind = int.from_bytes(b[at : at + 4], "big"), b[at + 4 : at + 8].decode("latin-1")
            body = at + 8
            if size == 1:
                _need(at + 16 <= end, "bad box")
                size, body = int.from_bytes(b[at + 8 : at + 16], "big"), at + 16
            elif size == 0:
                _need(parent < 0, "a box without end inside another")
                size = end - at
            elif size < 8 and parent >= 0 and end - at == 4 and not any(b[at:end]):
                break  # the closing zero of a QuickTime list
            _need(size >= body - at and at + size <= end, "a box longer than the one around it")
            own = {"id": len(out), "parent": parent, "within": above, "kind": kind, "path": path + "/" + kind, "begin": at, "body": body, "end": at + size, "handler": None, "offsets": [], "sizes": [], "digest": None, "facts": []}
            out.append(own)
            if kind in CONTAINERS:
                _need(len(above) < MAX_LEVELS, "boxes nested too deeply")
                inner.append((body, at + size, own["id"], [*above, own["id"]], own["path"]))
            at += size
            if at < end and end - at < 8 and parent >= 0 and not any(b[at:end]):
                break
        todo += inner[::-1]
    return out


def _number(b: bytes, box: dict, at: int, size: int) -> int:
    at += box["body"]
    _need(at + size <= box["end"], "truncated box")
    return int.from_bytes(b[at : at + size], "big")


def _table(b: bytes, box: dict, at: int, count: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    _need(box["body"] + at + count * width <= box["end"], "truncated table")
    return np.frombuffer(b, kind, count, box["body"] + at).astype(np.int64)


def _chunks(b: bytes, of: dict[str, dict]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sizes of a track's chunks, from its sample tables."""
    place = of.get("stco") or of.get("co64")
    if place is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = _table(b, place, 8, _number(b, place, 4, 4), ">u4" if place["kind"] == "stco" else ">u8")
    if not len(offsets):
        return offsets, offsets
    _need({"stsc"} <= set(of) and ("stsz" in of or "stz2" in of), "a track without sample sizes")
    runs = _table(b, of["stsc"], 8, 3 * _number(b, of["stsc"], 4, 4), ">u4").reshape(-1, 3)
    _need(len(runs) > 0 and runs[0, 0] == 1 and (np.diff(runs[:, 0]) > 0).all() and runs[-1, 0] <= len(offsets), "bad sample-to-chunk table")
    each = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(offsets) + 1)))
    last = np.cumsum(each)
    if "stsz" in of:
        fixed, count = _number(b, of["stsz"], 4, 4), _number(b, of["stsz"], 8, 4)
        sizes = None if fixed else _table(b, of["stsz"], 12, count, ">u4")
    else:
        width, count, fixed = _number(b, of["stz2"], 7, 1), _number(b, of["stz2"], 8, 4), 0
        _need(width in (8, 16), "bad sample sizes")
        sizes = _table(b, of["stz2"], 12, count, f">u{width // 8}")
    _need(last[-1] == count, "sample tables disagree")
    total = last * fixed if sizes is None else np.concatenate([[0], np.cumsum(sizes)])[last]
    lengths = np.diff(total, prepend=0)
    _need(bool((offsets + lengths <= len(b)).all() and (offsets >= 0).all()), "chunks beyond the file")
    return offsets, lengths


def tree(b: bytes) -> list[dict]:
    """All boxes; tracks know their handler and a digest of their sample bytes, tables their chunks."""
    out = _boxes(b)
    _need(bool(out) and any(x["path"] == "/moov" for x in out) and out[0]["kind"] in ("ftyp", "wide", "moov", "mdat", "free", "skip", "pnot"), "not an ISO media file")
    of: dict[int, dict[str, dict]] = {}
    for x in out:
        for track in x["within"][1:2]:
            of.setdefault(track, {}).setdefault(x["kind"], x)
    chapters = set()
    for x in out:
        if x["path"] == "/moov/trak/tref/chap":
            chapters |= set(_table(b, x, 0, (x["end"] - x["body"]) // 4, ">u4").tolist())
    for x in out:
        if x["path"] != "/moov/trak":
            continue
        own = of.get(x["id"], {})
        _need({"tkhd", "mdhd", "hdlr"} <= set(own), "a track without headers")
        number = _number(b, own["tkhd"], 20 if _number(b, own["tkhd"], 0, 1) else 12, 4)
        x["handler"] = "chap" if number in chapters else b[own["hdlr"]["body"] + 8 : own["hdlr"]["body"] + 12].decode("latin-1")
        offsets, sizes = _chunks(b, own)
        digest = hashlib.sha256()
        for at, size in zip(offsets.tolist(), sizes.tolist()):
            digest.update(b[at : at + size])
        x["digest"] = digest.hexdigest()
        x["facts"] = _facts(b, own, x["handler"])
        place = own.get("stco") or own.get("co64")
        if place:
            place["offsets"], place["sizes"] = offsets.tolist(), sizes.tolist()
    for x in out:
        if x["path"].startswith("/moov") and x["kind"] in TIMED:
            long = _number(b, x, 0, 1) == 1
            x["facts"] = [str(16 if long else 8), str(_number(b, x, 4, 8 if long else 4)), str(_number(b, x, 12 if long else 8, 8 if long else 4))]
        elif x["kind"] == "hdlr":
            x["facts"] = [b[x["body"] + 24 : x["end"]].strip(b"\0").decode("utf-8", "replace")]
    return out


def _facts(b: bytes, of: dict[str, dict], handler: str) -> list[str]:
    """Of a track: codec, width, height, sample rate, channels, duration in seconds; empty where unknown."""
    entry, header = of.get("stsd"), of["mdhd"]
    codec = b[entry["body"] + 12 : entry["body"] + 16].decode("latin-1").strip() if entry and entry["end"] - entry["body"] >= 16 else ""
    width = height = rate = channels = ""
    if entry and HANDLERS.get(handler) == "video" and entry["end"] - entry["body"] >= 44:
        width, height = str(_number(b, entry, 40, 2)), str(_number(b, entry, 42, 2))
    elif entry and HANDLERS.get(handler) == "audio" and entry["end"] - entry["body"] >= 44:
        channels, rate = str(_number(b, entry, 32, 2)), str(_number(b, entry, 40, 4) >> 16)
    long = _number(b, header, 0, 1) == 1
    scale, ticks = _number(b, header, 20 if long else 12, 4), _number(b, header, 24 if long else 16, 8 if long else 4)
    return [codec, width, height, rate, channels, str(ticks / scale) if scale else ""]


NODE = "struct<id:int,parent:int,within:array<int>,kind:string,path:string,begin:bigint,body:bigint,end:bigint,handler:string,offsets:array<bigint>,sizes:array<bigint>,digest:string,facts:array<string>>"
_LONGS, _TEXTS = pa.list_(pa.int64()), pa.list_(pa.string())
_NODE = pa.struct([("id", pa.int32()), ("parent", pa.int32()), ("within", pa.list_(pa.int32())), ("kind", pa.string()), ("path", pa.string()), ("begin", pa.int64()), ("body", pa.int64()), ("end", pa.int64()), ("handler", pa.string()), ("offsets", _LONGS), ("sizes", _LONGS), ("digest", pa.string()), ("facts", _TEXTS)])


def read(contents: Iterable[bytes | None]) -> pa.Array:
    """(nodes, error) of each file's bytes; null for null."""
    out = []
    for b in contents:
        try:
            out.append(None if b is None else {"nodes": tree(b), "error": None})
        except (Damaged, ValueError, OverflowError) as error:
            out.append({"nodes": [], "error": str(error) if isinstance(error, Damaged) else "damaged media file"})
    return pa.array(out, pa.struct([("nodes", pa.list_(_NODE)), ("error", pa.string())]))


def nodes(content: Column, made: Callable[[bytes], bytes] | None = None) -> Column:
    """What ``read`` gives, of a column.  ``made``: see ``splice.values``."""
    return reading(read, f"struct<nodes:array<{NODE}>,error:string>", content, made)


def is_fragmented(nodes: Column) -> Column:
    return F.exists(nodes, lambda n: n["kind"].isin("moof", "sidx"))


def _goes(n: Column) -> Column:
    data = (n["path"] == "/moov/trak") & ~n["handler"].isin(list(HANDLERS))
    return n["kind"].isin(DROPPED) | data | n["path"].startswith("/moov/trak/tref/") & n["kind"].isin(DROPPED_REFERENCES)


def dropped(nodes: Column) -> Column:
    """The boxes that go, each only as a whole: begin, end, kind."""
    chosen = F.transform(F.filter(nodes, _goes), lambda n: n["id"])
    whole = let(chosen, lambda ids: F.filter(nodes, lambda n: F.array_contains(ids, n["id"]) & ~F.arrays_overlap(n["within"], ids)))
    return F.transform(whole, lambda n: F.struct(n["begin"].alias("begin"), n["end"].alias("end"), n["kind"].alias("kind")))


def _before(gone: Column, offset: Column) -> Column:
    """Removed bytes before ``offset``."""
    return F.aggregate(gone, F.lit(0).cast("long"), lambda total, r: total + F.when(r["end"] <= offset, r["end"] - r["begin"]).otherwise(F.lit(0).cast("long")))


def _staying(nodes: Column, gone: Column) -> Column:
    return F.filter(nodes, lambda n: ~F.exists(gone, lambda r: (r["begin"] <= n["begin"]) & (n["end"] <= r["end"])))


def _patch(at: Column, width, values: Column) -> Column:
    return F.struct(at.cast("long").alias("at"), (F.lit(width) if isinstance(width, int) else width).cast("int").alias("width"), values.cast("array<bigint>").alias("values"))


def _zeros(at: Column, size: Column) -> Column:
    return _patch(at, 1, F.array_repeat(F.lit(0).cast("long"), size.cast("int")))


def _private(stay: Column) -> Column:
    """Patches that set times, names of handlers and names of compressors to zero."""
    times = F.transform(F.filter(stay, lambda n: n["kind"].isin(TIMED) & (F.size(n["facts"]) == 3)), lambda n: _zeros(n["body"] + 4, n["facts"][0].cast("int")))
    names = F.transform(F.filter(stay, lambda n: (n["kind"] == "hdlr") & (n["end"] - n["body"] > 24)), lambda n: _zeros(n["body"] + 24, n["end"] - n["body"] - 24))
    seen = F.transform(F.filter(stay, lambda n: (n["path"] == "/moov/trak") & (n["handler"] == "vide")), lambda n: n["id"])
    entries = F.filter(stay, lambda n: (n["kind"] == "stsd") & F.arrays_overlap(n["within"], seen) & (n["end"] - n["body"] >= 8 + 86))
    return F.concat(times, names, F.transform(entries, lambda n: _zeros(n["body"] + 8 + 50, F.lit(32))))


def patches(stay: Column, gone: Column, fragmented: Column) -> Column:
    """Numbers that change when ``gone`` boxes are removed; or, in fragmented files, the headers of the boxes put in their place."""
    inside = lambda n: F.aggregate(gone, F.lit(0).cast("long"), lambda t, r: t + F.when((r["begin"] >= n["begin"]) & (r["end"] <= n["end"]), r["end"] - r["begin"]).otherwise(F.lit(0).cast("long")))
    around = F.filter(stay, lambda n: n["kind"].isin(CONTAINERS) & (inside(n) > 0))
    sizes = F.transform(around, lambda n: _patch(F.when(n["body"] - n["begin"] == 16, n["begin"] + 8).otherwise(n["begin"]), F.when(n["body"] - n["begin"] == 16, 8).otherwise(4), F.array(n["end"] - n["begin"] - inside(n))))
    tables = F.filter(stay, lambda n: F.size(n["offsets"]) > 0)
    offsets = F.transform(tables, lambda n: _patch(n["body"] + 8, F.when(n["kind"] == "stco", 4).otherwise(8), F.transform(n["offsets"], lambda o: o - _before(gone, o))))
    free = F.lit(int.from_bytes(b"free", "big"))
    emptied = F.flatten(F.transform(gone, lambda r: F.array(_patch(r["begin"], 4, F.array(r["end"] - r["begin"])), _patch(r["begin"] + 4, 4, F.array(free)), _zeros(r["begin"] + 8, r["end"] - r["begin"] - 8))))
    return F.concat(_private(stay), F.when(fragmented, emptied).otherwise(F.concat(sizes, offsets)))


def _tokens(nodes: Column, gone: Column) -> Column:
    dated = F.exists(nodes, lambda n: n["kind"].isin(TIMED) & (F.size(n["facts"]) == 3) & ((n["facts"][1] != "0") | (n["facts"][2] != "0")))
    kinds = F.transform(F.filter(gone, lambda r: ~r["kind"].isin("free", "skip", "wide", "mfra", *DROPPED_REFERENCES)), lambda r: F.when(r["kind"] == "trak", "dataTrack").otherwise(r["kind"]))
    return F.array_distinct(F.concat(kinds, F.filter(F.array(F.when(dated, "time")), lambda t: t.isNotNull())))


def plan(g: Column) -> Column:
    """What ``splice.spliced`` needs, the tokens, and the error of files that can't be handled."""
    nodes = g["nodes"]
    data_track = F.exists(nodes, lambda n: (n["path"] == "/moov/trak") & ~n["handler"].isin(list(HANDLERS)))
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")

    def made(fragmented: Column, gone: Column, stay: Column) -> Column:
        areas = F.transform(F.filter(stay, lambda n: n["kind"] == "mdat"), lambda n: F.struct(n["body"].alias("begin"), n["end"].alias("end")))
        chunks = F.flatten(F.transform(F.filter(stay, lambda n: F.size(n["offsets"]) > 0), lambda n: F.zip_with(n["offsets"], n["sizes"], lambda o, s: F.struct(o.alias("begin"), (o + s).alias("end")))))
        ranges = F.transform(gone, lambda r: F.struct(r["begin"].alias("begin"), r["end"].alias("end")))
        return F.struct(
            F.when(fragmented, none).otherwise(ranges).alias("removed"),
            patches(stay, gone, fragmented).alias("patches"),
            F.when(fragmented, none).otherwise(areas).alias("blanked"),
            chunks.alias("spared"),
            _tokens(nodes, gone).alias("tokens"),
            F.when(fragmented & data_track, "data track in a fragmented file").alias("error"),
        )

    return let(is_fragmented(nodes), lambda f: let(dropped(nodes), lambda gone: let(_staying(nodes, gone), lambda stay: made(f, gone, stay))))


def digests(nodes: Column) -> Column:
    """Digests of the playing tracks' samples, in order."""
    return F.transform(F.filter(nodes, lambda n: (n["path"] == "/moov/trak") & n["handler"].isin(list(HANDLERS))), lambda n: n["digest"])


def boxes(files: DataFrame, id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """file_id, id, parent, kind, path, begin, end, keep and shift (bytes removed before it: a running sum) of every box; one shuffle."""
    ship(files.sparkSession)
    rows = files.select(F.col(id_col).alias("file_id"), nodes(F.coalesce(F.col(content_col), F.lit(b"")))["nodes"].alias("n")).withColumn("gone", dropped(F.col("n")))
    rows = rows.select("file_id", "gone", F.explode("n").alias("n"))
    inside = F.exists("gone", lambda r: (r["begin"] <= F.col("n.begin")) & (F.col("n.end") <= r["end"]))
    top = F.exists("gone", lambda r: (r["begin"] == F.col("n.begin")) & (r["end"] == F.col("n.end")))
    rows = rows.select("file_id", "n.id", "n.parent", "n.kind", "n.path", "n.begin", "n.end", (~inside).alias("keep"), F.when(top, F.col("n.end") - F.col("n.begin")).otherwise(F.lit(0)).alias("lost"))
    earlier = Window.partitionBy("file_id").orderBy("begin", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("shift", F.coalesce(F.sum("lost").over(earlier), F.lit(0))).drop("lost")


def problem(before: Column, after: Column, result: Column) -> Column:
    """What is wrong with a result, by its own boxes; null if nothing."""
    return F.coalesce(after["error"], F.when(~digests(after["nodes"]).eqNullSafe(digests(before["nodes"])), "samples moved"), F.when(F.size(_tokens(after["nodes"], dropped(after["nodes"]))) > 0, "metadata left"))


def apply(b: bytes, plan: dict) -> bytes:
    _need(plan["error"] is None, plan["error"])
    return spliced(b, plan["removed"], plan["patches"], plan["blanked"], plan["spared"])
