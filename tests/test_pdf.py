"""PDFs built by hand: plain and compressed tables, revisions, damage; what is left after cleaning, object by object."""

from __future__ import annotations

import re
import zlib

import pytest

from tidemark.operators import containers, pdf
from tidemark.operators.segments import Damaged

PAGE = b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Metadata 7 0 R/PieceInfo<</App<</Private(secret)>>>>/LastModified(D:2020)/MediaBox[0 0 9 9]>>"
OBJECTS = {
    1: b"<</Type/Catalog/Pages 2 0 R/Metadata 6 0 R/Lang(en)>>",
    2: b"<</Type/Pages/Kids[3 0 R]/Count 1>>",
    3: PAGE,
    4: b"<</Length 5 0 R>>stream\nBT (endobj 9 0 obj) Tj ET\nendstream",
    5: b"25",
    6: b"<</Type/Metadata/Subtype/XML/Length 7>>stream\n<x>Ann>\nendstream",
    7: b"<</Type/Metadata/Length 3>>stream\nAnn\nendstream",
    8: b"<</Author(Ann)/Producer(Acme \\) x)>>",
}


def built(objects, trailer=b"/Info 8 0 R", before=b"", prev=None, head=b"%PDF-1.4\n"):
    out, places = before or head, {}
    for num, body in objects.items():
        places[num] = len(out)
        out += b"%d 0 obj\n" % num + body + b"\nendobj\n"
    at, table = len(out), b"xref\n"
    for num in sorted(places):
        table += b"%d 1\n%010d 00000 n \n" % (num, places[num])
    link = b"/Prev %d" % prev if prev else b""
    return out + table + b"trailer\n<</Size 20/Root 1 0 R" + trailer + link + b">>\nstartxref\n%d\n%%%%EOF\n" % at


def compressed(objects, predictor):
    """The same objects in an object stream, with a cross-reference stream; streams stay outside."""
    inside = {n: b for n, b in objects.items() if b"stream" not in b}
    heads, bodies = b"", b""
    for n, b in inside.items():
        heads += b"%d %d " % (n, len(bodies))
        bodies += b + b" "
    packed = zlib.compress(heads + bodies)
    out, places = b"%PDF-1.5\n", {}
    for n, b in [*((n, b) for n, b in objects.items() if n not in inside), (12, b"<</Type/ObjStm/N %d/First %d/Filter/FlateDecode/Length %d>>stream\n" % (len(inside), len(heads), len(packed)) + packed + b"\nendstream")]:
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + b + b"\nendobj\n"
    at = len(out)
    places[13] = at
    rows = []
    for n in range(14):
        rows.append(b"\1" + places[n].to_bytes(3, "big") + b"\0" if n in places else b"\2" + (12).to_bytes(3, "big") + bytes([list(inside).index(n)]) if n in inside else bytes(5))
    if predictor:
        table, last = b"", bytes(5)
        for r in rows:
            table += b"\2" + bytes((x - y) & 255 for x, y in zip(r, last))
            last = r
        parms = b"/DecodeParms<</Predictor 12/Columns 5>>"
    else:
        table, parms = b"".join(rows), b""
    table = zlib.compress(table)
    return out + b"13 0 obj\n<</Type/XRef/W[1 3 1]/Size 14/Root 1 0 R/Info 8 0 R/Filter/FlateDecode" + parms + b"/Length %d>>stream\n" % len(table) + table + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % at


def clean(spark, *files):
    frame = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(files)], "file_id long, content binary")
    rows = {r.file_id: r for r in containers.cleaned(frame, ["file_id"], "pdf").collect()}
    return [rows[i] for i in range(len(files))]


def values(b):
    """Objects reached from the catalogue, as text without dropped keys."""
    file = pdf._File(b)
    return {n["id"]: (file.object(n["id"]).value if n["id"] != 4 else b[slice(*file.object(4).stream)]) for n in pdf.graph(b) if n["id"] and n["reached"]}


PLAIN = built(OBJECTS)
REVISED = built({4: b"<</Length 7>>stream\n(newer)\nendstream", 8: b"<</Author(Bea)>>"}, before=PLAIN, prev=int(re.findall(rb"startxref\n(\d+)", PLAIN)[0]))


@pytest.mark.parametrize("source", [PLAIN, compressed(OBJECTS, False), compressed(OBJECTS, True), PLAIN.replace(b"startxref\n", b"startxref\n9"), PLAIN[:-60]], ids=["plain", "compressed", "predicted", "wrong-offset", "cut-short"])
def test_metadata_goes_and_pages_stay(spark, source):
    if source == PLAIN[:-60]:
        source += b"\ntrailer\n<</Root 1 0 R/Info 8 0 R>>"
    (row,) = clean(spark, source)
    out = bytes(row.cleaned)
    assert {"pdfInfo", "pdfMetadata"} <= set(row.removed)
    for word in (b"Ann", b"Acme", b"secret", b"LastModified", b"PieceInfo", b"/Metadata", b"D:2020", b"ObjStm", b"/XRef"):
        assert word not in out
    got = values(out)
    assert sorted(got) == [1, 2, 3, 4, 5] and got[4] == b"BT (endobj 9 0 obj) Tj ET" and got[5] == 25
    assert list(got[3]) == [b"Type", b"Parent", b"Contents", b"MediaBox"] and pdf._get(got[1], b"Lang") == b"(en)"
    (again,) = clean(spark, out)
    assert bytes(again.cleaned) == out and again.removed == []


def test_earlier_revisions_go(spark):
    (row,) = clean(spark, REVISED)
    out = bytes(row.cleaned)
    assert values(out)[4] == b"(newer)" and b"endobj 9" not in out and b"Bea" not in out and "pdfRevision" in row.removed
    assert out.count(b"%%EOF") == out.count(b"startxref") == 1


def test_unreferenced_objects_go(spark):
    row, other = clean(spark, built(OBJECTS | {9: b"(orphan)"}), built(OBJECTS | {3: PAGE.replace(b"/MediaBox", b"/Thumb 9 0 R/MediaBox"), 9: b"(orphan)"}))
    assert b"orphan" not in row.cleaned and "pdfUnreferenced" in row.removed and b"orphan" in other.cleaned


def test_refused(spark):
    deep = b"[" * 500 + b"]" * 500
    bad = [built(OBJECTS, b"/Encrypt 9 0 R"), b"%PDF-1.4\n", b"", b"%PDF-1.4\ntrailer <</Root 1 0 R>>", built(OBJECTS | {2: deep})]
    rows = clean(spark, *bad)
    assert [r.cleaned for r in rows[:4]] == [None] * 4 and all(r.error for r in rows)
    assert rows[0].error == "encrypted PDF"


def test_object_rows_and_verification(spark):
    frame = spark.createDataFrame([(1, bytearray(REVISED)), (2, bytearray(b"junk"))], "file_id long, content binary")
    rows = pdf.objects(frame).collect()
    assert {r.id: r.keep for r in rows if r.file_id == 1} == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False, 8: False}
    assert [r.type for r in rows if r.file_id == 2] == ["error"]
    checked = spark.createDataFrame([(1, bytearray(REVISED)), (2, clean(spark, REVISED)[0].cleaned), (3, bytearray(PLAIN))], "file_id long, content binary")
    assert {r.file_id: r.c for r in checked.select("file_id", pdf.is_clean(checked.content).alias("c")).collect()} == {1: False, 2: True, 3: False}


def test_any_damage_is_an_error_not_a_crash():
    import random

    pick = random.Random(5)
    sources = [PLAIN, REVISED, compressed(OBJECTS, True)]
    for _ in range(3000):
        b = bytearray(pick.choice(sources))
        for _ in range(pick.randint(1, 3)):
            b[pick.randrange(len(b))] = pick.randrange(256)
        try:
            parts = [n for n in pdf.graph(bytes(b)) if n["reached"]]
            pdf.rewritten(bytes(b), parts)
        except (Damaged, TypeError, ValueError):
            pass
