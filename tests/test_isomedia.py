"""Movies built box by box: metadata goes, chunk offsets move, samples stay."""

from __future__ import annotations

import random
import struct

import pytest

from tidemark.operators import containers, isomedia
from tidemark.operators.segments import Damaged

VIDEO = [b"frame-one", b"two", b"frame-three-long"]
SOUND = [b"aaaa", b"bb"]
SECRET = [b"GPS 52.1 4.3", b"GPS 52.2"]


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def full(kind, *parts, version=0):
    return box(kind, bytes([version, 0, 0, 0]), *parts)


def entry(handler):
    if handler == b"vide":
        return box(b"avc1", bytes(6) + b"\0\1" + bytes(16) + struct.pack(">HH", 640, 360) + bytes(14) + b"\x0aLavc libx" + bytes(22) + b"\0\x18\xff\xff")
    if handler == b"soun":
        return box(b"mp4a", bytes(6) + b"\0\1" + bytes(8) + struct.pack(">HHHHI", 2, 16, 0, 0, 48000 << 16))
    return box(b"gpmd", bytes(6) + b"\0\1")


def trak(number, handler, samples, offsets, wide=False, extra=b"", long=False):
    """Each sample is a chunk; two of a size are written with a fixed sample size."""
    times = struct.pack(">QQ", 77, 78) if long else struct.pack(">II", 77, 78)
    tkhd = full(b"tkhd", times + struct.pack(">I", number) + bytes(64), version=int(long))
    mdhd = full(b"mdhd", times, struct.pack(">IQ" if long else ">II", 1000, 5000), bytes(4), version=int(long))
    hdlr = full(b"hdlr", bytes(4) + handler + bytes(12) + b"Ann's camera\0")
    sizes = full(b"stsz", struct.pack(">II", 0, len(samples)), *(struct.pack(">I", len(s)) for s in samples))
    place = full(b"co64", struct.pack(">I", len(offsets)), *(struct.pack(">Q", o) for o in offsets)) if wide else full(b"stco", struct.pack(">I", len(offsets)), *(struct.pack(">I", o) for o in offsets))
    table = box(b"stbl", full(b"stsd", struct.pack(">I", 1), entry(handler)), full(b"stsc", struct.pack(">IIII", 1, 1, 1, 1)), sizes, place)
    return box(b"trak", tkhd, extra, box(b"mdia", mdhd, hdlr, box(b"minf", table)))


def movie(first=True, wide=False, private=True, data=True, long=False, chapters=False, blank=False):
    """``private=False``: the same movie as it should be after cleaning."""
    junk = b"JUNK between"
    media = b"".join(VIDEO[:1]) + (junk if private or blank else b"") + b"".join(SOUND) + b"".join(VIDEO[1:]) + (b"".join(SECRET) if data else b"")

    def built(base):
        places, at = {}, base
        order = [("v", 0, VIDEO[0]), ("j", 0, junk), ("s", 0, SOUND[0]), ("s", 1, SOUND[1]), ("v", 1, VIDEO[1]), ("v", 2, VIDEO[2]), ("d", 0, SECRET[0]), ("d", 1, SECRET[1])]
        for kind, k, piece in order:
            places[kind, k] = at
            at += len(piece)
        udta = box(b"udta", box(b"meta", b"\0\0\0\0", box(b"ilst", b"Ann"))) if private else b""
        refs = box(b"tref", box(b"chap", struct.pack(">I", 3))) if chapters else b""
        tracks = [trak(1, b"vide", VIDEO, [places["v", i] for i in range(3)], wide, refs + udta, long), trak(2, b"soun", SOUND, [places["s", i] for i in range(2)], wide, b"", long)]
        if data:
            tracks.append(trak(3, b"text" if chapters else b"meta", SECRET, [places["d", i] for i in range(2)], wide))
        times = struct.pack(">QQ", 5, 6) if long else struct.pack(">II", 5, 6)
        return box(b"moov", full(b"mvhd", times, bytes(88), version=int(long)), *tracks, udta)

    ftyp, uuid = box(b"ftyp", b"isom\0\0\0\0"), box(b"uuid", bytes(16) + b"<xmp>Ann</xmp>") if private else b""
    mdat = box(b"mdat", media)
    if first:
        size = len(ftyp + uuid + built(0)) + 8
        return ftyp + uuid + built(size) + mdat
    return ftyp + uuid + mdat + built(len(ftyp + uuid) + 8) + (box(b"free", b"Ann") if private else b"")


def clean(spark, *files):
    frame = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(files)], "file_id long, content binary")
    rows = {r.file_id: r for r in containers.cleaned(frame, ["file_id"], "isomedia").collect()}
    return [rows[i] for i in range(len(files))]


def samples(b):
    out = []
    nodes = isomedia.tree(b)
    for t in (n for n in nodes if n["path"] == "/moov/trak"):
        place = next(n for n in nodes if n["offsets"] and t["id"] in n["within"])
        out.append([b[o : o + s] for o, s in zip(place["offsets"], place["sizes"])])
    return out


def test_offsets_follow_and_private_data_goes(spark):
    forms = [{"first": f, "wide": w, "long": g, "chapters": c} for f in (True, False) for w in (True, False) for g in (True, False) for c in (True, False)]
    for form, row in zip(forms, clean(spark, *[movie(**form) for form in forms])):
        assert row.error is None, (form, row.error)
        out = bytes(row.cleaned)
        assert samples(out) == [VIDEO, SOUND], form
        for word in (b"Ann", b"GPS", b"JUNK", b"Lavc", b"udta", b"uuid", b"free", b"chap"):
            assert word not in out, (form, word)
        nodes = {n["path"]: n for n in isomedia.tree(out)}
        assert nodes["/moov/mvhd"]["facts"][1:] == ["0", "0"] and nodes["/moov/trak"]["facts"][0] in ("avc1", "mp4a")
        assert set(row.removed) == {"uuid", "udta", "dataTrack", "time"} and sum(n["kind"] == "trak" for n in isomedia.tree(out)) == 2


def test_clean_files_stay_as_they_are(spark):
    (once,) = clean(spark, movie())
    (twice,) = clean(spark, once.cleaned)
    assert bytes(twice.cleaned) == bytes(once.cleaned) and twice.removed == []


def test_fragmented_files_keep_their_geometry(spark):
    head = box(b"ftyp", b"iso5\0\0\0\0") + box(b"moov", full(b"mvhd", struct.pack(">II", 5, 6), bytes(88)), trak(1, b"vide", [], []), box(b"mvex", full(b"trex", bytes(20))), box(b"udta", b"Ann"))
    tail = box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", full(b"tfhd", struct.pack(">IQ", 1, len(head) + 99)))) + box(b"mdat", b"frame") + box(b"uuid", bytes(16) + b"Ann")
    row, other = clean(spark, head + tail, head.replace(b"vide", b"meta") + tail)
    out = bytes(row.cleaned)
    assert len(out) == len(head + tail) and b"Ann" not in out and out.index(b"mdatframe") == (head + tail).index(b"mdatframe") and set(row.removed) == {"udta", "uuid", "time"}
    assert other.cleaned is None and other.error == "data track in a fragmented file"


def test_box_rows_hold_the_running_sum_of_removed_bytes(spark):
    rows = isomedia.boxes(spark.createDataFrame([(1, bytearray(movie())), (2, bytearray(b"junk"))], "file_id long, content binary")).collect()
    assert {r.file_id for r in rows} == {1}
    lost = [(r.begin, r.end) for r in rows if not r.keep and not any(o.begin <= r.begin and r.end <= o.end and o.id != r.id and not o.keep for o in rows)]
    for r in rows:
        assert r["shift"] == sum(e - b for b, e in lost if e <= r.begin or b < r.begin) and (r.keep or r.kind in (*isomedia.DROPPED, "trak") or any(b <= r.begin and r.end <= e for b, e in lost))


@pytest.mark.parametrize("bad", [b"", b"junk", movie()[:200], movie().replace(b"stsz", b"stsx"), movie().replace(b"mdhd", b"mdhx")])
def test_refused(spark, bad):
    (row,) = clean(spark, bad)
    assert row.cleaned is None and row.error and row.removed == []


def test_any_damage_is_an_error_not_a_crash():
    pick = random.Random(6)
    for _ in range(3000):
        b = bytearray(movie(pick.random() < 0.5, pick.random() < 0.5))
        for _ in range(pick.randint(1, 3)):
            b[pick.randrange(len(b))] = pick.randrange(256)
        try:
            isomedia.tree(bytes(b))
        except (Damaged, ValueError, OverflowError):
            pass
