import struct

import pytest

from tidemark.operators import segments
from tidemark.operators.segments import Damaged, clean_bytes


def png(*chunks):
    return b"\x89PNG\r\n\x1a\n" + b"".join(len(d).to_bytes(4, "big") + k + d + b"crc!" for k, d in chunks)


def exif(orientation, order="big", *more):
    mark = b"MM" if order == "big" else b"II"
    number = lambda n, size: n.to_bytes(size, order)
    tags = [(0x0112, 3, 1, number(orientation, 2) + b"\0\0"), *more]
    body = mark + number(42, 2) + number(8, 4) + number(len(tags), 2) + b"".join(number(t, 2) + number(k, 2) + number(n, 4) + v for t, k, n, v in tags) + bytes(4)
    return b"Exif\0\0" + body


def jpeg(*parts):
    out = b"\xff\xd8"
    for marker, body in parts:
        out += bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    return out + b"\xff\xda\0\2" + b"\x11\xff\0\x22\xff\xd3\x33" + b"\xff\xd9"


def test_png_keeps_rendering_chunks_and_drops_the_rest():
    dirty = png((b"IHDR", b"x" * 13), (b"tEXt", b"Prompt\0cat"), (b"iCCP", b"p"), (b"IDAT", b"data"), (b"IEND", b"")) + b"after"
    clean, tokens = clean_bytes(dirty, "png")
    assert clean == png((b"IHDR", b"x" * 13), (b"iCCP", b"p"), (b"IDAT", b"data"), (b"IEND", b"")) and tokens == ["tEXt"]
    assert clean_bytes(clean, "png") == (clean, [])


@pytest.mark.parametrize("bad", [b"", b"\x89PNG\r\n\x1a\n", png((b"IHDR", b"x")), png((b"I1DR", b"x"), (b"IEND", b""))])
def test_damaged_png(bad):
    with pytest.raises(Damaged):
        clean_bytes(bad, "png")


@pytest.mark.parametrize("order", ["big", "little"])
def test_jpeg_keeps_orientation_alone(order):
    dirty = jpeg((0xE0, b"JFIF\0\1\2\1\0H\0H\1\1\xff\xff\xff"), (0xE1, exif(6, order, (0x8825, 4, 1, bytes(4)), (0x013B, 2, 2, b"a\0\0\0"))), (0xE2, b"ICC_PROFILE\0\1\1p"), (0xE2, b"MPF\0"), (0xEE, b"Adobe\0"), (0xED, b"Photoshop"), (0xFE, b"hi"), (0xDB, b"t"))
    clean, tokens = clean_bytes(dirty + b"tail", "jpeg")
    assert tokens == ["JFIF thumbnail", "EXIF", "GPS", "Author", "APP2", "APP13", "Comment", "Trailing data after EOI"]
    assert clean == jpeg((0xE1, exif(6)), (0xE0, b"JFIF\0\1\2\1\0H\0H\0\0"), (0xE2, b"ICC_PROFILE\0\1\1p"), (0xEE, b"Adobe\0"), (0xDB, b"t"))
    assert segments.exif_orientation(exif(9)[6:]) is None
    plain, _ = clean_bytes(jpeg((0xE1, exif(1))), "jpeg")
    assert b"Exif" not in plain


@pytest.mark.parametrize("bad", [b"\xff\xd8", b"\xff\xd8\xff\xd0\0\2\xff\xd9", b"\xff\xd8\xff\xe1\0\1", b"\xff\xd8\xff\xda\0\2\x11", b"\xff\xd8abc"])
def test_damaged_jpeg(bad):
    with pytest.raises(Damaged):
        clean_bytes(bad, "jpeg")


def test_webp_rewrites_size_and_flags():
    chunks = [(b"VP8X", b"\x2c" + bytes(9)), (b"VP8 ", b"abc"), (b"EXIF", b"MM"), (b"XMP ", b"<x>")]
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for k, d in chunks)
    clean, tokens = clean_bytes(b"RIFF" + struct.pack("<I", len(body)) + body + b"tail", "webp")
    assert tokens == ["EXIF", "XMP"] and clean[20] == 0x20 and struct.unpack("<I", clean[4:8])[0] == len(clean) - 8


def test_gif_extensions():
    head, image = b"GIF89a\1\0\1\0\0\0\0", b"\x2c\0\0\0\0\1\0\1\0\0\2\1x\0"
    loop = b"\x21\xff\x0bNETSCAPE2.0\3\1\0\0\0"
    dirty = head + loop + b"\x21\xfe\2hi\0\x21\xff\x0bXMP DataXMP\1x\0\x21\xf9\4\0\0\0\0\0" + image + b"\x21\x01\1x\0\x3bafter"
    clean, tokens = clean_bytes(dirty, "gif")
    assert tokens == ["comment", "xmp", "ext:0x01"] and clean == head + loop + b"\x21\xf9\4\0\0\0\0\0" + image + b"\x3b"
    for bad in (head, head + b"\x99", head + b"\x2c", b"GIF88a"):
        with pytest.raises(Damaged):
            clean_bytes(bad, "gif")


FRAMES = b"\xff\xfb\x90\0" + b"\xaa" * 60


def test_mp3_tags_at_both_ends_in_any_order():
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (40).to_bytes(4, "little") + bytes(4) + (0).to_bytes(4, "little") + bytes(8)
    lyrics = b"LYRICSBEGIN" + b"x" * 9 + b"000020LYRICS200"
    appended = b"ID3\4\0\x10\0\0\0\2zz3DI\4\0\x10\0\0\0\2"
    dirty = b"ID3\3\0\0\0\0\0\4abcd" * 2 + FRAMES + appended + lyrics + b"12345678" + ape + b"TAG" + bytes(125)
    clean, tokens = clean_bytes(dirty, "mp3")
    assert clean == FRAMES and sorted(tokens) == ["ape", "id3", "id3", "id3", "id3", "lyrics"]
    for bad in (b"", b"ID3\3\0\0\0\0\0\x7f", b"plain", FRAMES + ape[:12] + b"\xff\xff\xff\xff" + ape[16:]):
        with pytest.raises(Damaged):
            clean_bytes(bad, "mp3")


def block(kind, body, last=False):
    return bytes([kind | 0x80 * last]) + len(body).to_bytes(3, "big") + body


def test_flac_blocks_and_cue_sheet():
    cue = bytearray(396 + 36 + 12)
    cue[:5] = b"12345"
    cue[136] = 0xFF
    cue[395] = 1
    cue[396 + 9 : 396 + 21] = b"ISRC00000000"
    cue[396 + 35] = 1
    clean, tokens = clean_bytes(b"fLaC" + block(0, bytes(34)) + block(4, b"v") + block(5, bytes(cue)) + block(6, b"p") + block(1, bytes(9), True) + b"frames", "flac")
    assert tokens == ["vorbisComment", "cuesheetMetadata", "flacPicture"]
    assert b"ISRC" not in clean and b"12345" not in clean and clean.startswith(b"fLaC" + block(0, bytes(34))) and clean.endswith(b"frames")
    assert clean_bytes(clean, "flac")[0] == clean
    for bad in (b"fLaC", b"fLaC" + block(4, b"v", True), b"fLaC" + block(0, bytes(34)) + block(9, b"", True), b"fLaC" + block(0, bytes(34)) + block(5, b"short", True)):
        with pytest.raises(Damaged):
            clean_bytes(bad, "flac")


def test_rtf_groups_to_a_fixpoint():
    clean, tokens = clean_bytes(rb"{\rtf1 {\info {\author A \} B}}text {\*\generator G;}{\information kept}}", "rtf")
    assert clean == rb"{\rtf1 text {\information kept}}" and tokens == ["rtfMetadata"] * 2
    spliced, _ = clean_bytes(rb"{\rtf1 {{\*\generator x}\info secret}}", "rtf")
    assert b"secret" not in spliced
    many, _ = clean_bytes(b"{\\rtf1 " + rb"{\info x}" * 50_000 + b"}", "rtf")
    assert many == b"{\\rtf1 }"
    for bad in (rb"{\rtf1 {\info x}", rb"{\rtf1 \bin3 abc}", b"plain"):
        with pytest.raises(Damaged):
            clean_bytes(bad, "rtf")


def test_rows_carry_errors_instead_of_failing(spark):
    rows = spark.createDataFrame([(1, "png", bytearray(b"bad")), (2, "gif", None), (3, "pdf", bytearray(b"%PDF-")), (4, "mp3", bytearray(FRAMES))], "file_id long, kind string, content binary")
    got = {r.file_id: r for r in segments.cleaned(rows, ["file_id"]).collect()}
    assert got[1].error and got[2].error and got[3].error == "unsupported_without_tool" and bytes(got[4].cleaned) == FRAMES
    assert {r.segment for r in segments.segments(rows).where("file_id = 1").collect()} == {"error"}
    assert segments.cleaned(rows.limit(0), ["file_id"]).count() == 0
