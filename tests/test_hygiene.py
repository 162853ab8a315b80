import pytest

from tests.test_packages import docx
from tests.test_segments import FRAMES, block, exif, jpeg, png
from tidemark import __main__ as cli
from tidemark.operators import inspection, packages, verification
from tidemark.plans import hygiene


def test_inspection_reads_what_cleaners_remove():
    found = dict(inspection.fields_of(jpeg((0xE1, exif(6, "big", (0x010F, 2, 4, b"Acm\0"))), (0xFE, b"hi"), (0xC0, b"\x08\0\3\0\2\1")), "jpeg"))
    assert found == {"IFD0:Orientation": "6", "IFD0:Make": "Acm", "File:Comment": "hi", "File:ImageHeight": "3", "File:ImageWidth": "2", "File:BitsPerSample": "8"}
    assert ("PNG:Prompt", "cat") in inspection.fields_of(png((b"IHDR", bytes(13)), (b"tEXt", b"Prompt\0cat"), (b"IEND", b"")), "png")
    tag = b"TIT2\0\0\0\4\0\0\0abc"
    assert inspection.fields_of(b"ID3\3\0\0\0\0\0" + bytes([len(tag)]) + tag + FRAMES, "mp3") == [("ID3v2_3:Title", "abc")]
    comments = b"\4\0\0\0Lavf\1\0\0\0\x0a\0\0\0ARTIST=Ann"
    assert ("Vorbis:Artist", "Ann") in inspection.fields_of(b"fLaC" + block(0, bytes(34)) + block(4, comments, True), "flac")
    assert ("XML:Creator", "Ann") in inspection.fields_of(docx(("docProps/custom.xml", b"<p xmlns:dc='d'><dc:creator>Ann</dc:creator></p>")), "ooxml")
    assert inspection.fields_of(rb"{\rtf1 {\info {\author Ann}}{\*\generator G;}}", "rtf") == [("RTF:Author", "Ann"), ("RTF:Generator", "G")]


def test_verification_accepts_cleaned_and_refuses_tampered_packages():
    clean = packages.clean_package(docx(), "ooxml")[0]
    assert verification.problem(clean, "ooxml") is None and verification.problem(docx(), "ooxml")
    for name, data in (("docProps/meta.xml", b"<m/>"), ("docProps/core.xml", b"<coreProperties>Ann</coreProperties>"), ("docProps/app.xml", b"<Properties a='b'/>")):
        rows = [(e.name, packages.content_of(e)) for e in packages.read_entries(clean) if e.name != name]
        assert verification.problem(packages.stored_package([*rows, (name, data)]), "ooxml")
    assert verification.problem(b"junk", "ooxml") and verification.problem(clean, "other")


def test_whole_path(spark):
    rows = [(1, "a.mp3", bytearray(b"ID3\3\0\0\0\0\0\0" + FRAMES)), (2, "a.docx", bytearray(docx())), (3, "a.pdf", bytearray(b"%PDF-1.7")), (4, "a.bmp", bytearray(b"BMxx")), (5, "a.svg", bytearray(b"<svg><script/><g/></svg>")), (6, "a.txt", bytearray(b"hi")), (7, "a.png", bytearray(b"\x89PNG\r\n\x1a\n")), (8, None, None)]
    got = {r.file_id: r for r in hygiene.clean(spark.createDataFrame(rows, "file_id long, name string, content binary")).collect()}
    assert [got[i].strategy for i in range(1, 9)] == ["byte-surgery", "package-rewrite", None, "copy", "svg-sanitize", "copy", None, None]
    assert got[3].error == "PDF without catalogue" and got[7].error_category == "metadata_tool" and got[7].message and bytes(got[6].cleaned) == b"hi"


def test_refused_files_are_not_cleaned(spark):
    from tests.test_packages import stored_package

    crowded = docx(*((f"word/media/{i}.png", b"x") for i in range(2_100)))
    loose = stored_package([("[Content_Types].xml", b"<Types/>"), ("word/document.xml", b"<d/>")])
    rows = [(1, "a.docx", bytearray(docx())), (2, "a.docx", bytearray(crowded)), (3, "a.docx", bytearray(loose)), (4, "a.xlsx", bytearray(docx())), (5, "a.docx", bytearray(b"PK\3\4junk")), (6, "a.png", bytearray(b"GIF89a\1\0\1\0\0\0\0\x3b")), (7, "../a.txt", bytearray(b"hi")), (8, "a.txt", bytearray(b"hello there")), (9, "", None)]
    files = spark.createDataFrame(rows, "file_id long, name string, content binary")
    got = {r.file_id: r for r in hygiene.clean(files, {"document": 10}).collect()}
    assert {i: r.error for i, r in got.items()} == {1: "file_too_large", **dict.fromkeys((2, 3, 4, 5, 6), "suspicious_file"), 7: "invalid_filename", 8: "file_too_large", 9: "invalid_filename"}
    assert all(r.cleaned is None and r.error_category == "validation" and r.message for r in got.values())
    assert {r.file_id for r in hygiene.clean(files).where("ok").collect()} == {1, 8}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    (tmp_path / "a.mp3").write_bytes(b"ID3\3\0\0\0\0\0\0" + FRAMES)
    assert cli.main(["clean", str(tmp_path), "-o", str(tmp_path / "out")]) == 0
    assert (tmp_path / "out/clean-a.mp3").read_bytes() == FRAMES and "1 field" in capsys.readouterr().out
    (tmp_path / "b.pdf").write_bytes(b"%PDF-")
    assert cli.main(["clean", str(tmp_path / "b.pdf"), "--json"]) == 1
    assert cli.main(["inspect", str(tmp_path)]) == 0 and cli.main(["clean"]) == 2
    assert cli.main(["doctor"]) in (0, 2)


@pytest.mark.parametrize("kind", ["png", "jpeg", "gif", "webp", "mp3", "flac", "rtf", "ooxml", "odf", "epub", "svg"])
def test_random_bytes_never_raise(kind):
    import random

    r = random.Random(kind)
    good = {"png": png((b"IHDR", bytes(13)), (b"IEND", b"")), "jpeg": jpeg((0xE1, exif(6))), "mp3": FRAMES, "flac": b"fLaC" + block(0, bytes(34), True), "rtf": b"{\\rtf1 a}", "ooxml": docx(), "svg": b"<svg/>"}.get(kind, b"GIF89a\1\0\1\0\0\0\0\x3b")
    for _ in range(150):
        b = bytearray(good)
        for _ in range(r.randint(0, 4)):
            b[r.randrange(len(b))] = r.randrange(256)
        out, _, _, error = hygiene.clean_one(bytes(b[: r.randint(0, len(b))]), kind)
        assert (out is None) != (error is None)
