"""PDF: the object graph of the newest revision as rows, rules over the rows, and a rewrite with a table of its own.

``nodes`` reads a file's cross-reference tables and streams, newest first, follows references from the catalogue, and gives one
node for each object: where its bytes are, what it is, whether it is reached, and which ranges of it hold a dropped key.  What
stays is decided by Column rules over the nodes (``kept``, ``tokens``); ``rewritten`` copies the ranges that stay, writes one
plain table and a trailer with the catalogue and a digest of the content as identifier.  So no information dictionary, no
metadata stream, no earlier revision and no unreferenced object is left.

A table that can't be read is replaced by a walk over all objects, the last of each number winning.  Encrypted files, filters
other than deflate on the structure's own streams, and deeper nesting than ``MAX_DEPTH`` are refused.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.segments import Damaged, _need
from tidemark.operators.splice import reading
from tidemark.session import ship

#: Keys that are dropped from every dictionary, and types of objects that aren't copied.
DROPPED_KEYS = {b"Metadata", b"PieceInfo", b"LastModified"}
DROPPED_TYPES = ["Metadata", "XRef", "ObjStm"]
MAX_DEPTH = 100
INFLATE_BYTES = 64 << 20

_SPACE = rb"(?:[\0\t\n\f\r ]|%[^\r\n]*[\r\n]?)*"
_TOKEN = re.compile(_SPACE + rb"(<<|>>|\[|\]|\(|/[^\0\t\n\f\r ()<>\[\]{}/%]*|<[0-9A-Fa-f\0\t\n\f\r ]*>|(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![A-Za-z])|[^\0\t\n\f\r ()<>\[\]{}/%]+|[{}])")
_HEAD = re.compile(_SPACE + rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj")
_ANY_HEAD = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj(?![a-z])")
_STREAM = re.compile(_SPACE + rb"stream\r?\n")
_ENDS = re.compile(rb"[\0\t\n\f\r ]*endstream")
_PARENS = re.compile(rb"\\.|[()]", re.DOTALL)


class Ref(NamedTuple):
    num: int
    gen: int


class Obj(NamedTuple):
    """An object's value, and the range of its bytes in ``data`` (the file, or an inflated object stream)."""

    num: int
    gen: int
    value: object
    begin: int
    end: int
    stream: tuple[int, int] | None
    data: bytes


def _value(b: bytes, at: int, depth: int = 0):
    """The value at ``at``, where it begins and where it ends.  Dictionaries: name to (value, begin of name, end of value)."""
    _need(depth < MAX_DEPTH, "PDF nested too deeply")
    m = _TOKEN.match(b, at)
    _need(m is not None, "bad PDF syntax")
    token, begin, at = m[1], m.start(1), m.end()
    if token == b"<<":
        out: dict = {}
        while True:
            m = _TOKEN.match(b, at)
            _need(m is not None and (m[1] == b">>" or m[1][:1] == b"/"), "bad PDF dictionary")
            if m[1] == b">>":
                return out, begin, m.end()
            value, _, at = _value(b, m.end(), depth + 1)
            out[re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[1][1:])] = value, m.start(1), at
    if token == b"[":
        items: list = []
        while True:
            m = _TOKEN.match(b, at)
            _need(m is not None, "bad PDF array")
            if m[1] == b"]":
                return items, begin, m.end()
            value, _, at = _value(b, at, depth + 1)
            items.append(value)
    if token == b"(":
        level = 1
        for p in _PARENS.finditer(b, at):
            level += {b"(": 1, b")": -1}.get(p[0], 0)
            if not level:
                return b[begin : p.end()], begin, p.end()
        raise Damaged("PDF string without end")
    _need(token not in (b">>", b"]", b"{", b"}"), "bad PDF syntax")
    if m[2]:
        return Ref(int(m[2]), int(m[3])), begin, at
    return (int(token) if token.isdigit() else token), begin, at


def _get(value, key: bytes):
    return value[key][0] if isinstance(value, dict) and key in value else None


class _File:
    """Reads objects by number; ``places``: number to (offset, None) or (object stream, index)."""

    def __init__(self, b: bytes):
        self.b, self.places, self.trailer, self.extra, self.unreadable = b, {}, {}, set(), set()
        self.streams: dict[int, dict[int, Obj]] = {}
        try:
            self._tables(int(re.findall(rb"startxref[\0\t\n\f\r ]+(\d{1,15})", b)[-1]))
            _need(isinstance(_get(self.object(_get(self.trailer, b"Root").num).value, b"Pages"), Ref), "no catalogue")
        except (Damaged, IndexError, KeyError, AttributeError, TypeError, ValueError):
            self._walk()
        _need(b"Encrypt" not in self.trailer, "encrypted PDF")

    def _tables(self, at: int) -> None:
        todo, seen = [at], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            m = re.compile(rb"[\0\t\n\f\r ]*xref").match(self.b, at)
            if m:
                trailer, at = self._classic(m.end())
                todo += [v for k in (b"XRefStm", b"Prev") if isinstance(v := _get(trailer, k), int)]
            else:
                trailer = self._compressed(at)
                todo += [v] if isinstance(v := _get(trailer, b"Prev"), int) else []
            self.trailer = {**trailer, **self.trailer}

    def _place(self, num: int, place) -> None:
        if num in self.places:
            self.extra.add(num)
        else:
            self.places[num] = place

    def _classic(self, at: int):
        section = re.compile(_SPACE + rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+(?=\d)")
        entry = re.compile(rb"[\0\t\n\f\r ]*(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+([nf])")
        while not (m := re.compile(_SPACE + rb"trailer").match(self.b, at)):
            m = section.match(self.b, at)
            _need(m is not None, "bad PDF table")
            at = m.end()
            for k in range(int(m[2])):
                e = entry.match(self.b, at)
                _need(e is not None, "bad PDF table")
                self._place(int(m[1]) + k, (int(e[1]), None) if e[3] == b"n" else None)
                at = e.end()
        value, _, at = _value(self.b, m.end())
        return value, at

    def _compressed(self, at: int) -> dict:
        own = self._at(at)
        widths, size = [w for w in _get(own.value, b"W")], _get(own.value, b"Size")
        data, step = self.inflated(own), sum(widths)
        index = _get(own.value, b"Index") or [0, size]
        _need(len(widths) == 3 and step > 0, "bad PDF table")
        at = 0
        for first, count in zip(index[::2], index[1::2]):
            for k in range(count):
                row = data[at : at + step]
                _need(len(row) == step, "bad PDF table")
                kind = int.from_bytes(row[: widths[0]], "big") if widths[0] else 1
                a, b = int.from_bytes(row[widths[0] : widths[0] + widths[1]], "big"), int.from_bytes(row[widths[0] + widths[1] :], "big")
                self._place(first + k, (a, None) if kind == 1 else (a, b) if kind == 2 else None)
                at += step
        return own.value

    def _walk(self) -> None:
        """Every object in the order of the file; later ones replace earlier ones."""
        self.places, self.trailer, self.streams, at, packed = {}, {}, {}, 0, []
        while m := _ANY_HEAD.search(self.b, at):
            try:
                own = self._at(m.start())
            except (Damaged, TypeError, ValueError):
                at = m.end()
                self.unreadable.add(int(m[1]))
                continue
            if own.num in self.places:
                self.extra.add(own.num)
            self.places[own.num] = m.start(), None
            at = own.end
            if _get(own.value, b"Type") == b"/ObjStm":
                packed.append(own)
            elif _get(own.value, b"Type") == b"/XRef":
                self.trailer = {**self.trailer, **own.value}
        for own in packed:
            for k, num in enumerate(self._packed(own)):
                self.places.setdefault(num, (own.num, k))
        for m in re.finditer(rb"trailer" + _SPACE + rb"(?=<<)", self.b):
            self.trailer = {**self.trailer, **_value(self.b, m.end())[0]}

    def _at(self, at: int) -> Obj:
        m = _HEAD.match(self.b, at)
        _need(m is not None, "no object where the PDF's table says")
        value, begin, end = _value(self.b, m.end())
        s = _STREAM.match(self.b, end) if isinstance(value, dict) else None
        if not s:
            return Obj(int(m[1]), int(m[2]), value, begin, end, None, self.b)
        length = _get(value, b"Length")
        if isinstance(length, Ref):
            place = self.places.get(length.num)
            target = _HEAD.match(self.b, place[0]) if place and place[1] is None else None
            length = _value(self.b, target.end())[0] if target else None
        e = _ENDS.match(self.b, s.end() + length) if isinstance(length, int) else None
        if not e:
            found = self.b.find(b"endstream", s.end())
            _need(found >= 0, "PDF stream without end")
            length, e = found - s.end(), _ENDS.match(self.b, found)
        return Obj(int(m[1]), int(m[2]), value, begin, e.end(), (s.end(), s.end() + length), self.b)

    def inflated(self, own: Obj) -> bytes:
        _need(own.stream is not None, "a PDF structure without stream")
        data, filters, parms = own.data[slice(*own.stream)], _get(own.value, b"Filter"), _get(own.value, b"DecodeParms")
        filters, parms = (x[0] if isinstance(x, list) and len(x) == 1 else x for x in (filters, parms))
        if filters in (None, []):
            return data
        _need(filters in (b"/FlateDecode", b"/Fl"), "unknown filter on a PDF structure")
        try:
            out = zlib.decompressobj().decompress(data, INFLATE_BYTES)
        except zlib.error as error:
            raise Damaged("bad deflate data") from error
        predictor, step = _get(parms, b"Predictor") or 1, (_get(parms, b"Columns") or 1) + 1
        if predictor == 1:
            return out
        _need(predictor >= 10, "unknown predictor")
        rows, before = [], bytes(step - 1)
        for at in range(0, len(out) - step + 1, step):
            row = bytearray(out[at + 1 : at + step])
            _need(out[at] in (0, 1, 2), "unknown predictor")
            for i in range(len(row)):
                row[i] = row[i] + (before[i] if out[at] == 2 else row[i - 1] if out[at] == 1 and i else 0) & 0xFF
            rows.append(before := bytes(row))
        return b"".join(rows)

    def _packed(self, home: Obj) -> dict[int, Obj]:
        """The objects of an object stream, by number."""
        if home.num not in self.streams:
            data, first = self.inflated(home), _get(home.value, b"First")
            _need(isinstance(first, int), "bad object stream")
            heads = [int(x) for x in data[:first].split()]
            out = {}
            for num, at in zip(heads[::2], heads[1::2]):
                value, begin, end = _value(data, first + at)
                out[num] = Obj(num, 0, value, begin, end, None, data)
            self.streams[home.num] = out
        return self.streams[home.num]

    def object(self, num: int) -> Obj | None:
        place = self.places.get(num)
        if place is None:
            return None
        if place[1] is None:
            own = self._at(place[0])
            _need(own.num == num, "another object where the PDF's table says")
            return own
        _need(self.places.get(place[0], (0, 0))[1] is None, "object stream inside an object stream")
        return self._packed(self._at(self.places[place[0]][0])).get(num)


def _references(value) -> tuple[list[int], list[int]]:
    """Numbers that a value refers to, outside dropped keys; and the ranges of these keys, begin and end in turn."""
    refs, cuts, todo = [], [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, Ref):
            refs.append(v.num)
        elif isinstance(v, list):
            todo += v
        elif isinstance(v, dict):
            for name, (item, begin, end) in v.items():
                if name in DROPPED_KEYS:
                    cuts.append((begin, end))
                else:
                    todo.append(item)
    return refs, [x for pair in sorted(cuts) for x in pair]


def graph(b: bytes) -> list[dict]:
    """A node for the trailer (id 0) and for every object of the newest revision."""
    _need(b[:5] == b"%PDF-", "not a PDF")
    file = _File(b)
    root = _get(file.trailer, b"Root")
    _need(isinstance(root, Ref), "PDF without catalogue")
    found, todo = {}, [root.num]
    while todo:
        num = todo.pop()
        if num not in found:
            own = file.object(num)
            _need(own is not None or num not in file.unreadable, "damaged PDF object")
            refs, cuts = _references(own.value) if own else ([], [])
            found[num] = own, cuts
            todo += refs
    _need(found[root.num][0] is not None and _get(found[root.num][0].value, b"Pages") is not None, "PDF without catalogue")
    info = getattr(_get(file.trailer, b"Info"), "num", None)
    facts = ["Info"] * (b"Info" in file.trailer) + ["revision"] * (bool(file.extra) or len(re.findall(rb"%%EOF", b)) > 1)
    out = [{"id": 0, "home": None, "gen": root.gen, "type": "trailer", "begin": root.num, "end": 0, "reached": True, "cuts": [], "facts": facts}]
    for num in sorted(file.places):
        own, cuts = found.get(num, (None, []))
        reached = own is not None
        try:
            own = own or file.object(num)
        except (Damaged, TypeError, ValueError):  # what nothing refers to needn't be readable
            own = None
        if own:
            place, kind = file.places[num], _get(own.value, b"Type")
            out.append({"id": num, "home": place[0] if place[1] is not None else None, "gen": own.gen, "type": kind[1:].decode("latin-1") if isinstance(kind, bytes) else "", "begin": own.begin, "end": own.end, "reached": reached, "cuts": cuts, "facts": ["Info"] if num == info else []})
    return out


NODE = "struct<id:bigint,home:bigint,gen:int,type:string,begin:bigint,end:bigint,reached:boolean,cuts:array<bigint>,facts:array<string>>"
_NODE = pa.struct([("id", pa.int64()), ("home", pa.int64()), ("gen", pa.int32()), ("type", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("reached", pa.bool_()), ("cuts", pa.list_(pa.int64())), ("facts", pa.list_(pa.string()))])
_RESULT = pa.struct([("nodes", pa.list_(_NODE)), ("error", pa.string())])


def read(contents: Iterable[bytes | None]) -> pa.Array:
    """(nodes, error) of each PDF's bytes; null for null."""
    out = []
    for b in contents:
        try:
            out.append(None if b is None else {"nodes": graph(b), "error": None})
        except (Damaged, TypeError, ValueError, RecursionError) as error:
            out.append({"nodes": [], "error": str(error) if isinstance(error, Damaged) else "damaged PDF"})
    return pa.array(out, _RESULT)


def nodes(content: Column, made: Callable[[bytes], bytes] | None = None) -> Column:
    """What ``read`` gives, of a column.  ``made``: see ``splice.values``."""
    return reading(read, f"struct<nodes:array<{NODE}>,error:string>", content, made)


def kept(nodes: Column) -> Column:
    """The nodes that are copied: reached from the catalogue, and no carrier of metadata or of the old structure."""
    return F.filter(nodes, lambda n: n["reached"] & ((n["id"] == 0) | ~n["type"].isin(DROPPED_TYPES)))


def tokens(nodes: Column) -> Column:
    """What goes, by name, in a fixed order."""
    has = lambda test: F.exists(nodes, test)
    rules = [
        ("pdfInfo", has(lambda n: F.array_contains(n["facts"], "Info"))),
        ("pdfMetadata", has(lambda n: (n["type"] == "Metadata") | (n["reached"] & (F.size(n["cuts"]) > 0)))),
        ("pdfRevision", has(lambda n: F.array_contains(n["facts"], "revision"))),
        ("pdfUnreferenced", has(lambda n: ~n["reached"] & ~n["type"].isin(DROPPED_TYPES) & (F.size(n["facts"]) == 0))),
    ]
    return F.filter(F.array(*(F.when(test, name) for name, test in rules)), lambda t: t.isNotNull())


def rewritten(b: bytes, parts: list[dict]) -> bytes:
    """The kept objects of ``b`` behind a plain header, with one table; numbers stay."""
    file = _File(b)
    root = next(p for p in parts if not p["id"])
    out = [b"%PDF-" + re.match(rb"%PDF-(\d\.\d)?", b)[0][5:] + b"\n%\xe2\xe3\xcf\xd3\n"]
    at, entries = len(out[0]), {0: (0, 65535, b"f")}
    for p in parts:
        if not p["id"]:
            continue
        data = b if p["home"] is None else file.object(p["id"]).data
        bounds = [p["begin"], *p["cuts"], p["end"]]
        body = b"%d %d obj\n" % (p["id"], p["gen"]) + b"".join(data[x:y] for x, y in zip(bounds[::2], bounds[1::2])) + b"\nendobj\n"
        entries[p["id"]] = at, p["gen"], b"n"
        out.append(body)
        at += len(body)
    digest = hashlib.md5(b"".join(out)).hexdigest().encode()
    out.append(b"xref\n")
    numbers = sorted(entries)
    starts = [n for n in numbers if n - 1 not in entries]
    for first, stop in zip(starts, [*starts[1:], numbers[-1] + 1]):
        run = [n for n in range(first, stop) if n in entries] if stop - first < 1 << 20 else [n for n in numbers if first <= n < stop]
        out.append(b"%d %d\n" % (first, len(run)) + b"".join(b"%010d %05d %s \n" % entries[n] for n in run))
    out.append(b"trailer\n<</Size %d/Root %d %d R/ID[<%s><%s>]>>\nstartxref\n%d\n%%%%EOF\n" % (numbers[-1] + 1, root["begin"], root["gen"], digest, digest, at))
    return b"".join(out)


def is_clean(content: Column) -> Column:
    """Written by one revision, whose trailer names neither information nor an earlier table, with nothing behind it."""
    text = F.decode(content, "ISO-8859-1")
    tail = F.substring_index(text, "trailer", -1)
    return F.coalesce(F.startswith(text, F.lit("%PDF-")) & ~tail.rlike(r"/(Info|Prev|Encrypt|XRefStm)\b") & tail.rlike(r"(?s)startxref\s+\d+\s+%%EOF\s*$"), F.lit(False))


def objects(files: DataFrame, id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """file_id, id, home, gen, type, begin, end, reached, keep of every object; a file that can't be read gives one row of type ``error``."""
    ship(files.sparkSession)
    rows = files.select(F.col(id_col).alias("file_id"), nodes(F.coalesce(F.col(content_col), F.lit(b""))).alias("g"))
    rows = rows.withColumn("kept", F.transform(kept(F.col("g.nodes")), lambda n: n["id"]))
    damaged = F.struct(*(F.lit(None).cast(t).alias(n) for n, t in (("id", "long"), ("home", "long"), ("gen", "int"))), F.lit("error").alias("type"), F.lit(0).cast("long").alias("begin"), F.lit(0).cast("long").alias("end"), F.lit(False).alias("reached"), F.array().cast("array<bigint>").alias("cuts"), F.array().cast("array<string>").alias("facts"))
    rows = rows.select("file_id", "kept", F.explode(F.when(F.col("g.error").isNull(), F.col("g.nodes")).otherwise(F.array(damaged))).alias("n"))
    return rows.select("file_id", "n.id", "n.home", "n.gen", "n.type", "n.begin", "n.end", "n.reached", F.coalesce(F.array_contains("kept", F.col("n.id")), F.lit(False)).alias("keep"))


def problem(before: Column, after: Column, result: Column) -> Column:
    """What is wrong with a result, by its own nodes and bytes; null if nothing."""
    count = lambda g: F.size(kept(g["nodes"]))
    return F.coalesce(after["error"], F.when(count(before) != count(after), "objects lost"), F.when(~is_clean(result) | (F.size(tokens(after["nodes"])) > 0), "metadata left"))


def plan(g: Column) -> Column:
    return F.struct(kept(g["nodes"]).alias("parts"), tokens(g["nodes"]).alias("tokens"))


def apply(b: bytes, plan: dict) -> bytes:
    return rewritten(b, plan["parts"])
