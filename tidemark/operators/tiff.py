"""TIFF: directories and entries as rows, rules over the rows, and pointers moved by sums of removed bytes, in both byte orders.

``nodes`` reads the graph of directories (pages and reduced images) with their entries, and of each directory the ranges and a
digest of its strips, tiles or embedded JPEG data.  Column rules keep the entries that rendering needs; a directory shrinks in
its place, every byte that no kept entry refers to is removed, in even amounts so that alignment stays, and all pointers move by
what was removed before them.  The result is read again: the image data must be the same bytes, and no other entry may be left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.segments import PROFILE_BYTES, Damaged, _need
from tidemark.operators.splice import let, reading, spliced
from tidemark.session import ship

# Bytes of each field type; tags that rendering needs; pairs of tags that hold offsets and sizes of image data.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
KEPT_TAGS = [
    *range(254, 260), 262, 263, 264, 265, 266, 273, 274, *range(277, 285), *range(290, 294), 296, 297, 301, *range(317, 326), 327, 328,
    330, 332, 334, 336, 338, 339, 340, 341, 342, 347, *range(512, 516), 517, *range(518, 522), *range(529, 533), 34675,
]
DATA_TAGS = {273: 279, 324: 325, 513: 514}
DIRECTORIES, PROFILE = 330, 34675
NAMED = {34665: "EXIF", 34853: "GPS", 700: "XMP", 315: "Author", 33432: "Author", 305: "Software", 271: "Software", 272: "Software", 306: "DateTime"}
MAX_DIRECTORIES, MAX_VALUES = 1000, 10_000_000


def graph(b: bytes) -> tuple[str, list[dict], list[dict]]:
    """Byte order, directories (in the order they are reached) and their entries."""
    order = {b"II*\0": "little", b"MM\0*": "big"}.get(b[:4])
    _need(order is not None and len(b) >= 8, "not a TIFF")

    def number(at: int, size: int) -> int:
        _need(at + size <= len(b), "truncated TIFF")
        return int.from_bytes(b[at : at + size], order)

    first = number(4, 4)
    todo, places, entries, directories = [first], {}, [], []
    while todo:
        at = todo.pop(0)
        if not at or at in places:
            continue
        _need(len(places) < MAX_DIRECTORIES and at >= 8, "bad TIFF directory")
        places[at], count, own = len(directories), number(at, 2), {}
        for k in range(count):
            p = at + 2 + 12 * k
            tag, kind, n = number(p, 2), number(p + 2, 2), number(p + 4, 4)
            size = TYPE_BYTES.get(kind, 1) * n
            begin = p + 8 if size <= 4 else number(p + 8, 4)
            _need(begin + size <= len(b), "a TIFF value beyond the file")
            own[tag] = {"ifd": places[at], "at": p, "tag": tag, "type": kind, "count": n, "begin": begin, "end": begin + size, "inline": size <= 4, "raw": list(b[p + 8 : p + 12]), "offsets": [], "sizes": []}
            if tag in (DIRECTORIES, *DATA_TAGS, *DATA_TAGS.values()):
                _need(kind in (3, 4, 13) and n <= MAX_VALUES, "bad TIFF offsets")
                own[tag]["offsets"] = [number(begin + i * TYPE_BYTES[kind], TYPE_BYTES[kind]) for i in range(n)]
        digest = hashlib.sha256()
        for places_tag, sizes_tag in DATA_TAGS.items():
            if places_tag in own:
                _need(sizes_tag in own and own[sizes_tag]["count"] == own[places_tag]["count"], "TIFF data without sizes")
                own[places_tag]["sizes"] = own[sizes_tag]["offsets"]
                for o, s in zip(own[places_tag]["offsets"], own[places_tag]["sizes"]):
                    _need(o + s <= len(b), "TIFF data beyond the file")
                    digest.update(b[o : o + s])
        for tag in DATA_TAGS.values():
            if tag in own:
                own[tag]["offsets"] = []
        following = number(at + 2 + 12 * count, 4)
        directories.append({"ifd": places[at], "begin": at, "count": count, "following": following, "digest": digest.hexdigest()})
        entries += own.values()
        todo += [*(own[DIRECTORIES]["offsets"] if DIRECTORIES in own else []), following]
    _need(bool(directories), "TIFF without directory")
    return order, directories, entries


_LONGS = pa.list_(pa.int64())
_DIRECTORY = pa.struct([("ifd", pa.int32()), ("begin", pa.int64()), ("count", pa.int32()), ("following", pa.int64()), ("digest", pa.string())])
_ENTRY = pa.struct([("ifd", pa.int32()), ("at", pa.int64()), ("tag", pa.int32()), ("type", pa.int32()), ("count", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("inline", pa.bool_()), ("raw", _LONGS), ("offsets", _LONGS), ("sizes", _LONGS)])
_GRAPH = pa.struct([("sign", pa.int32()), ("size", pa.int64()), ("directories", pa.list_(_DIRECTORY)), ("entries", pa.list_(_ENTRY)), ("error", pa.string())])
GRAPH = "struct<sign:int,size:bigint,directories:array<struct<ifd:int,begin:bigint,count:int,following:bigint,digest:string>>,entries:array<struct<ifd:int,at:bigint,tag:int,type:int,count:bigint,begin:bigint,end:bigint,inline:boolean,raw:array<bigint>,offsets:array<bigint>,sizes:array<bigint>>>,error:string>"


def read(contents: Iterable[bytes | None]) -> pa.Array:
    """sign (1 big-endian, -1 little-endian), size, directories, entries and error of each file's bytes; null for null."""
    out = []
    for b in contents:
        try:
            order, directories, entries = graph(b) if b is not None else ("big", [], [])
            out.append(None if b is None else {"sign": 1 if order == "big" else -1, "size": len(b), "directories": directories, "entries": entries, "error": None})
        except (Damaged, ValueError, OverflowError) as error:
            out.append({"sign": 1, "size": len(b), "directories": [], "entries": [], "error": str(error) if isinstance(error, Damaged) else "damaged TIFF"})
    return pa.array(out, _GRAPH)


def nodes(content: Column, made: Callable[[bytes], bytes] | None = None) -> Column:
    """What ``read`` gives, of a column.  ``made``: see ``splice.values``."""
    return reading(read, GRAPH, content, made)


def _stays(e: Column) -> Column:
    return e["tag"].isin(KEPT_TAGS) & ~((e["tag"] == PROFILE) & (e["end"] - e["begin"] > PROFILE_BYTES)) & e["type"].isin(list(TYPE_BYTES))


def kept(g: Column) -> Column:
    return F.filter(g["entries"], _stays)


def tokens(g: Column) -> Column:
    """Names of what goes, each once."""
    names = F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair))
    return F.array_distinct(F.transform(F.filter(g["entries"], lambda e: ~_stays(e)), lambda e: F.coalesce(F.element_at(names, e["tag"]), F.lit("tag"))))


def _range(begin: Column, end: Column) -> Column:
    return F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end"))


def plan(g: Column) -> Column:
    """What ``splice.spliced`` needs: removed ranges, patches, the ranges whose bytes stay; and the tokens."""
    return let(kept(g), lambda stay: let(_spared(g, stay), lambda spared: let(_gaps(g, spared), lambda gaps: F.struct(
        gaps.alias("removed"), _patches(g, stay, gaps).alias("patches"), spared.alias("spared"), F.array(_range(F.lit(0), g["size"])).alias("blanked"), tokens(g).alias("tokens")
    ))))


def _spared(g: Column, stay: Column) -> Column:
    """The header, shrunk directories, values and image data, in order."""
    tables = F.transform(g["directories"], lambda d: _range(d["begin"], d["begin"] + 6 + 12 * F.size(F.filter(stay, lambda e: e["ifd"] == d["ifd"]))))
    values = F.transform(F.filter(stay, lambda e: ~e["inline"]), lambda e: _range(e["begin"], e["end"]))
    data = F.flatten(F.transform(F.filter(stay, lambda e: F.size(e["sizes"]) > 0), lambda e: F.zip_with(e["offsets"], e["sizes"], lambda o, s: _range(o, o + s))))
    return F.array_sort(F.concat(F.array(_range(F.lit(0), F.lit(8))), tables, values, data))


def _gaps(g: Column, spared: Column) -> Column:
    """Gaps between the spared ranges, in even amounts from even places."""
    up, down = (lambda c: c + F.pmod(c, F.lit(2))), (lambda c: c - F.pmod(c, F.lit(2)))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("gaps"))

    def step(acc: Column, r: Column) -> Column:
        gap = _range(up(acc["end"]), down(r["begin"]))
        return F.struct(F.greatest(acc["end"], r["end"]).alias("end"), F.when(gap["begin"] < gap["end"], F.concat(acc["gaps"], F.array(gap))).otherwise(acc["gaps"]).alias("gaps"))

    return F.aggregate(F.concat(spared, F.array(_range(g["size"], g["size"]))), start, step, lambda acc: acc["gaps"])


def _patches(g: Column, stay: Column, gaps: Column) -> Column:
    """Shrunk directories and moved pointers, in the coordinates before removal."""
    sign = g["sign"]

    def moved(p: Column) -> Column:
        return p - F.aggregate(gaps, F.lit(0).cast("long"), lambda t, r: t + F.when(r["end"] <= p, r["end"] - r["begin"]).otherwise(F.lit(0).cast("long")))

    def patch(at: Column, width, values: Column) -> Column:
        return F.struct(at.cast("long").alias("at"), (width * sign).cast("int").alias("width"), values.cast("array<bigint>").alias("values"))

    def width(e: Column) -> Column:
        return F.when(e["type"] == 3, 2).otherwise(4)

    def directory(d: Column) -> Column:
        own = F.filter(stay, lambda e: e["ifd"] == d["ifd"])
        n = F.size(own)

        def entry(e: Column, k: Column) -> Column:
            at = d["begin"] + 2 + 12 * k
            pointer = patch(at + 8, F.lit(4), F.array(moved(e["begin"])))
            plain = F.struct((at + 8).cast("long").alias("at"), F.lit(1).alias("width"), e["raw"].alias("values"))
            own_offsets = patch(at + 8, width(e), F.transform(e["offsets"], moved))
            value = F.when(~e["inline"], F.array(pointer)).when(F.size(e["offsets"]) > 0, F.array(plain, own_offsets)).otherwise(F.array(plain))
            return F.concat(F.array(patch(at, F.lit(2), F.array(e["tag"].cast("long"), e["type"].cast("long"))), patch(at + 4, F.lit(4), F.array(e["count"]))), value)

        following = patch(d["begin"] + 2 + 12 * n, F.lit(4), F.array(moved(d["following"])))
        return F.concat(F.array(patch(d["begin"], F.lit(2), F.array(n.cast("long"))), following), F.flatten(F.transform(own, entry)))

    lists = F.transform(F.filter(stay, lambda e: ~e["inline"] & (F.size(e["offsets"]) > 0)), lambda e: patch(e["begin"], width(e), F.transform(e["offsets"], moved)))
    head = patch(F.lit(4), F.lit(4), F.array(moved(g["directories"][0]["begin"])))
    return F.concat(F.array(head), lists, F.flatten(F.transform(g["directories"], directory)))


def digests(g: Column) -> Column:
    return F.transform(g["directories"], lambda d: d["digest"])


def entries(files: DataFrame, id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """file_id, ifd, tag, type, count, begin, end, keep of every entry."""
    ship(files.sparkSession)
    rows = files.select(F.col(id_col).alias("file_id"), F.explode(nodes(F.coalesce(F.col(content_col), F.lit(b"")))["entries"]).alias("e"))
    return rows.select("file_id", "e.ifd", "e.tag", "e.type", "e.count", "e.begin", "e.end", _stays(F.col("e")).alias("keep"))


def problem(before: Column, after: Column, result: Column) -> Column:
    """What is wrong with a result, by its own entries; null if nothing."""
    return F.coalesce(after["error"], F.when(~digests(after).eqNullSafe(digests(before)), "image data moved"), F.when(F.size(tokens(after)) > 0, "metadata left"))


def apply(b: bytes, plan: dict) -> bytes:
    return spliced(b, plan["removed"], plan["patches"], plan["blanked"], plan["spared"])
