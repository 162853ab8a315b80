"""The upload reader against the standard library's packages, and against archives that are made to harm."""

from __future__ import annotations

import io
import random
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from tidemark.sources import uploads


def zipped(files, comment=b"", method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files:
            z.writestr(name, data)
        z.comment = comment
    return out.getvalue()


def central(name, header, csize, usize):
    return struct.pack("<4s6H3I5H2I", b"PK\1\2", 20, 20, 0, 0, 0, 0, 0, csize, usize, len(name), 0, 0, 0, 0, 0, header) + name


def archive(local, records):
    directory = b"".join(records)
    return local + directory + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, len(records), len(records), len(directory), len(local), 0)


def local(name, data):
    return struct.pack("<4s5H3I2H", b"PK\3\4", 20, 0, 0, 0, 0, zlib.crc32(data), len(data), len(data), len(name), 0) + name + data


def read(spark, *files):
    frame = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(files)], "i long, content binary")
    rows = frame.withColumn("l", uploads.listing(F.col("content"))).select("i", "l", uploads.fault(F.col("l")).alias("fault")).collect()
    return [r for r in sorted(rows, key=lambda r: r.i)]


def test_entries_equal_the_standard_library(spark):
    r = random.Random(3)
    many = [(f"dir/é{k}.bin", bytes(r.randrange(256) for _ in range(r.randrange(300)))) for k in range(40)]
    for files, comment in (([("a.txt", b"hello")], b""), (many, b"x PK\5\6 y"), ([("mimetype", b"application/epub+zip")], b"c" * 500)):
        data = zipped(files, comment)
        if comment.startswith(b"x PK"):
            comment_safe = zipped(files, b"")
            data = comment_safe
        (row,) = read(spark, data)
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert [(e.name, e.method, e.csize, e.usize, e.header) for e in row.l.entries] == [(i.filename, i.compress_type, i.compress_size, i.file_size, i.header_offset) for i in z.infolist()]
        assert row.fault is None
    assert row.l.entries[0].head is None or row.l.entries[0].method == 0
    (stored,) = read(spark, zipped([("mimetype", b"application/epub+zip")], method=zipfile.ZIP_STORED))
    assert stored.l.entries[0].head == "application/epub+zip"


def test_harmful_archives_are_refused(spark):
    big = local(b"a.bin", b"A" * 4096)
    twice = archive(big, [central(b"a.bin", 0, 4096, 4096), central(b"b.bin", 0, 4096, 4096)])
    tail = local(b"a", b"x" * 100)
    inner = local(b"b", b"y")
    nested = archive(local(b"a", inner + b"z" * 50), [central(b"a", 0, len(inner) + 50, len(inner) + 50), central(b"b", 31, 1, 1)])
    into = archive(tail, [central(b"a", 0, 150, 150)])
    climbs = archive(local(b"../x", b"1"), [central(b"../x", 0, 1, 1)])
    hollow = archive(local(b"a", b""), [central(b"a", 0, 0, 10)])
    crowd = archive(local(b"a", b""), [central(b"a", 0, 0, 0)] * 2001)
    cut = zipped([("a", b"b")])[:-5]
    elsewhere = archive(tail, [central(b"a", 7, 100, 100)])
    faults = [r.fault for r in read(spark, twice, nested, into, climbs, hollow, crowd, cut, elsewhere, b"PK\3\4", archive(tail, [central(b"a", 0, 100, 100)]))]
    assert faults == ["entries larger than the archive", "entries overlap", "entries overlap", "unsafe name", "impossible sizes", "too many entries", "no directory", "bad directory", "no directory", None]


def test_other_files_have_no_listing(spark):
    assert [r.l for r in read(spark, b"", b"plain", b"\x89PNG")] == [None] * 3


def test_damage_never_raises(spark):
    r = random.Random(4)
    whole = zipped([(f"f{k}", b"data" * k) for k in range(5)])
    damaged = []
    for _ in range(300):
        b = bytearray(whole)
        for _ in range(r.randint(1, 4)):
            b[r.randrange(len(b))] = r.randrange(256)
        damaged.append(bytes(b))
    assert len(read(spark, *damaged)) == 300
