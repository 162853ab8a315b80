"""Ogg files built packet by packet: comments go, setup and audio stay, pages count on, checksums hold."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
import pytest

from tidemark.operators import containers, inspection, ogg
from tidemark.operators.segments import Damaged
from tidemark.operators.splice import values
from tidemark.plans import container_queries

HEAD = {"vorbis": b"\x01vorbis" + bytes(4) + b"\2" + (44100).to_bytes(4, "little") + bytes(13) + b"\1", "opus": b"OpusHead\1\2" + bytes(9)}
AUDIO = [bytes([k]) * (k * 37 % 700) for k in range(30)]


def tags(codec, fields):
    body = (4).to_bytes(4, "little") + b"Lavf" + len(fields).to_bytes(4, "little") + b"".join(len(f).to_bytes(4, "little") + f for f in fields)
    return b"\3vorbis" + body + b"\1" if codec == "vorbis" else b"OpusTags" + body


def stream(codec, serial=7, fields=(b"ARTIST=Ann",), setup=b"\5vorbis" + b"s" * 3000):
    headers = [tags(codec, list(fields)), *([setup] if codec == "vorbis" else [])]
    out = [ogg.page(2, bytes(8), serial, 0, ogg.laced([HEAD[codec]]), HEAD[codec])]
    out += ogg.paged(headers, serial, 1)
    for k in range(0, len(AUDIO), 3):
        part = AUDIO[k : k + 3]
        out.append(ogg.page(4 if k + 3 >= len(AUDIO) else 0, (k * 1000).to_bytes(8, "little"), serial, len(out), ogg.laced(part), b"".join(part)))
    return out


def clean(spark, *files):
    frame = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(files)], "file_id long, content binary")
    rows = {r.file_id: r for r in containers.cleaned(frame, ["file_id"], "ogg").collect()}
    return [rows[i] for i in range(len(files))]


def audio(b):
    pages, _ = ogg.tree(b)
    return b"".join(b[p["body"] : p["end"]] for p in pages if not p["header"])


def test_checksum_of_the_format():
    def slow(data):
        crc = 0
        for x in data:
            crc ^= x << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
        return crc

    for data in (b"", b"a", b"OggS" + bytes(range(256))):
        assert ogg.checksum(data) == slow(data)


def test_comments_go_and_pages_count_on(spark):
    picture = b"METADATA_BLOCK_PICTURE=" + b"Ann" * 40_000  # over several pages
    mixed = [p for pair in zip(stream("vorbis", 7), stream("opus", 9)) for p in pair]
    mixed += stream("vorbis", 7)[len(stream("opus", 9)) :]
    files = [b"".join(stream("vorbis")), b"".join(stream("opus")), b"".join(stream("vorbis", fields=[b"A=b", picture])), b"".join(mixed), b"".join(stream("opus", fields=[]))]
    for source, row in zip(files, clean(spark, *files)):
        assert row.error is None and row.removed == ["vorbisComment"], row.error
        out = bytes(row.cleaned)
        assert b"Ann" not in out and b"Lavf" not in out and audio(out) == audio(source)
        pages, streams = ogg.tree(out)
        for s in streams:
            assert [p["sequence"] for p in pages if p["serial"] == s["serial"]] == list(range(sum(p["serial"] == s["serial"] for p in pages)))
            assert s["setup"] == (b"\5vorbis" + b"s" * 3000 if s["codec"] == "vorbis" else b"")
        (again,) = clean(spark, out)
        assert bytes(again.cleaned) == out and again.removed == []


@pytest.mark.parametrize("bad", [b"", b"OggS", b"".join(stream("vorbis"))[:-1], b"".join(stream("vorbis")).replace(b"Ann", b"Bob"), b"".join(stream("opus")[1:]), b"".join(stream("opus")[:1])])
def test_refused(spark, bad):
    (row,) = clean(spark, bad)
    assert row.cleaned is None and row.error


def test_inspection():
    assert inspection.fields_of(b"".join(stream("vorbis")), "ogg") == [("Vorbis:Vendor", "Lavf"), ("Vorbis:Artist", "Ann")]


def test_any_damage_is_an_error_not_a_crash():
    pick = random.Random(8)
    for _ in range(1500):
        b = bytearray(b"".join(stream(pick.choice(["vorbis", "opus"]))))
        for _ in range(pick.randint(1, 3)):
            b[pick.randrange(len(b))] = pick.randrange(256)
        try:
            ogg.tree(bytes(b))
        except (Damaged, ValueError, IndexError):
            pass


def test_files_are_made_one_at_a_time_where_they_are_read():
    texts, made = pa.array([b"%d" % k for k in range(1000)]), container_queries.ogg_maker()
    tracemalloc.start()
    nodes = ogg.read(values(texts, made))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(nodes) == 1000 and nodes.nbytes < 2e6 and peak < 20e6  # the files have 85 MB
    assert len(made(b"")) > 84_000


@pytest.mark.parametrize("portion", [containers.PORTION, 100])
def test_files_of_a_column_and_files_made_of_it_give_the_same(spark, monkeypatch, portion):
    monkeypatch.setattr(containers, "PORTION", portion)
    made = container_queries.ogg_maker()
    rows = [(k, bytearray(t)) for k, t in enumerate([b"", b"a", b"b" * 60_000, b"c" * 130_000, b"\0\r\n"])]
    texts = spark.createDataFrame(rows, "file_id long, content binary").coalesce(1)
    files = spark.createDataFrame([(k, bytearray(made(bytes(t)))) for k, t in rows], "file_id long, content binary").coalesce(1)
    got, wanted = (sorted(df.collect()) for df in (containers.cleaned(texts, ["file_id"], "ogg", made=made), containers.cleaned(files, ["file_id"], "ogg")))
    assert got == wanted and [(r.file_id, r.error, r.removed) for r in got] == [(k, None, ["vorbisComment"]) for k in range(5)]
    assert [audio(bytes(r.cleaned)) for r in got] == [bytes(t) for _, t in rows]


def test_streams_of_files_and_of_what_was_read_of_them(spark):
    mixed = b"".join([p for pair in zip(stream("vorbis", 7), stream("opus", 9)) for p in pair] + stream("vorbis", 7)[len(stream("opus", 9)) :])
    rows = [(1, bytearray(b"".join(stream("opus")))), (2, bytearray(mixed)), (3, bytearray(b"OggS")), (4, None)]
    frame = spark.createDataFrame(rows, "file_id long, content binary")
    done = containers.cleaned(frame, ["file_id"], "ogg", again=True)
    got, again = (sorted(map(tuple, df.collect()), key=str) for df in (ogg.streams(done, content_col="cleaned"), ogg.streams_read(done)))
    assert got == again and [r[:3] for r in got if r[2] == "error"] == [(3, None, "error"), (4, None, "error")]
    pages, found = ogg.tree(b"".join(stream("opus")))
    before = {r.serial: r for r in ogg.streams(frame.where("file_id = 1")).collect()}
    assert {s: (r.codec, r.digest, r.pages, r.last) for s, r in before.items()} == {7: ("opus", found[0]["digest"], len(pages), pages[-1]["sequence"])}
    assert len([r for r in got if r[0] == 2]) == 2 and {r[4] - r[5] for r in got if r[2] != "error"} == {1}
