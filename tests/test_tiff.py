"""TIFFs in both byte orders: entries that go, pointers that move, image data that stays."""

from __future__ import annotations

import random
import struct

import pytest

from tidemark.operators import containers, tiff
from tidemark.operators.segments import Damaged

STRIPS = [b"first strip", b"second", b"x"]


def built(order="<", private=True, pages=2, gap=b"LEFT OVER", shorts=False):
    """Pages of three strips, with values out of line, a colour profile, and private entries between them."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4

    def put(data):
        if len(out) % 2:
            out.extend(b"\0")
        out.extend(data)
        return len(out) - len(data)

    for page in range(pages):
        if private:
            put(gap)
        strips = [put(s + bytes([page])) for s in STRIPS]
        kind = "H" if shorts else "I"
        fields = {
            256: (3, 1, struct.pack(order + "HH", 11, 0)),
            258: (3, 3, put(struct.pack(order + "HHH", 8, 8, 8))),
            273: (3 if shorts else 4, 3, put(struct.pack(order + "3" + kind, *strips))),
            274: (3, 1, struct.pack(order + "HH", 6, 0)),
            279: (3, 3, put(struct.pack(order + "HHH", *(len(s) + 1 for s in STRIPS)))),
            282: (5, 1, put(struct.pack(order + "II", 300, 1))),
            34675: (7, 20, put(b"colour profile bytes")),
        }
        if private:
            fields |= {270: (2, 10, put(b"Ann's dog\0")), 305: (2, 4, b"Gim\0"), 315: (2, 4, b"Ann\0"), 700: (1, 9, put(b"<xmp>Ann>")), 34853: (4, 1, put(struct.pack(order + "HHHI4sI", 1, 1, 2, 2, b"N\0\0\0", 0)))}
        at = put(struct.pack(order + "H", len(fields)))
        for tag in sorted(fields):
            kind_, count, value = fields[tag]
            out.extend(struct.pack(order + "HHI", tag, kind_, count) + (value if isinstance(value, bytes) else struct.pack(order + "I", value)))
        out.extend(bytes(4))
        out[link : link + 4] = struct.pack(order + "I", at)
        link = len(out) - 4
    return bytes(out) + (b"tail Ann" if private else b"")


def clean(spark, *files):
    frame = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(files)], "file_id long, content binary")
    rows = {r.file_id: r for r in containers.cleaned(frame, ["file_id"], "tiff").collect()}
    return [rows[i] for i in range(len(files))]


def strips(b):
    return [[b[o : o + s] for o, s in zip(e["offsets"], e["sizes"])] for e in tiff.graph(b)[2] if e["tag"] == 273]


def values(b):
    return [(e["ifd"], e["tag"], e["type"], e["count"], bytes(b[e["begin"] : e["end"]])) for e in tiff.graph(b)[2] if e["tag"] not in (273, 330)]


def test_private_entries_go_and_images_stay(spark):
    forms = [{"order": o, "shorts": s, "gap": g, "pages": p} for o in "<>" for s in (True, False) for g in (b"", b"odd", b"even") for p in (1, 3)]
    for form, row in zip(forms, clean(spark, *[built(**form) for form in forms])):
        assert row.error is None, (form, row.error)
        out, pages = bytes(row.cleaned), form["pages"]
        assert strips(out) == [[s + bytes([p]) for s in STRIPS] for p in range(pages)], form
        assert values(out) == values(built(**form | {"private": False})), form
        assert b"Ann" not in out and b"odd" not in out and b"even" not in out and len(out) <= len(built(**form | {"private": False})) + 2 * pages
        assert set(row.removed) == {"tag", "Software", "Author", "XMP", "GPS"}
        assert all(d["begin"] % 2 == 0 for d in tiff.graph(out)[1])


def test_clean_files_stay_as_they_are(spark):
    for order in "<>":
        (once,) = clean(spark, built(order))
        (twice,) = clean(spark, once.cleaned)
        assert bytes(twice.cleaned) == bytes(once.cleaned) and twice.removed == []


def test_reduced_images_are_followed(spark):
    """A directory that an entry points to keeps its data, and the entry follows it."""
    main = built(">", pages=1)
    sub = len(main) + len(main) % 2
    b = bytearray(main + bytes(len(main) % 2))
    inner = struct.pack(">HHHII", 2, 273, 4, 1, sub + 30) + struct.pack(">HHII", 279, 4, 1, 5) + bytes(4) + b"small" + b"Ann"
    at = struct.unpack(">I", main[4:8])[0]
    entry = main.index(struct.pack(">HHI", 270, 2, 10))
    b[entry : entry + 12] = struct.pack(">HHII", 330, 4, 1, sub)
    (row,) = clean(spark, bytes(b) + inner)
    assert row.error is None and at > 0
    assert strips(bytes(row.cleaned)) == [[s + b"\0" for s in STRIPS], [b"small"]] and b"Ann" not in row.cleaned


@pytest.mark.parametrize("bad", [b"", b"II*\0", built()[:60], b"II+\0" + built()[4:], built().replace(struct.pack("<H", 279), struct.pack("<H", 278))])
def test_refused(spark, bad):
    (row,) = clean(spark, bad)
    assert row.cleaned is None and row.error


def test_entry_rows(spark):
    rows = tiff.entries(spark.createDataFrame([(1, bytearray(built(pages=1)))], "file_id long, content binary")).collect()
    assert {r.tag for r in rows if not r.keep} == {270, 305, 315, 700, 34853} and {r.tag for r in rows if r.keep} == {256, 258, 273, 274, 279, 282, 34675}


def test_any_damage_is_an_error_not_a_crash():
    pick = random.Random(7)
    for _ in range(5000):
        b = bytearray(built(pick.choice("<>")))
        for _ in range(pick.randint(1, 3)):
            b[pick.randrange(len(b))] = pick.randrange(256)
        try:
            tiff.graph(bytes(b))
        except (Damaged, ValueError, OverflowError):
            pass
