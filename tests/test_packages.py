import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import formats
from tidemark.operators import markup, packages
from tidemark.operators.packages import content_of, read_entries, stored_package
from tidemark.operators.segments import Damaged
from tidemark.plans import catalog

TYPES = b'<Types xmlns="t"><Override PartName="/docProps/thumbnail.jpeg"/><Override PartName="/word/document.xml"/></Types>'


def rels(*pairs):
    return b"<Relationships>" + b"".join(b'<Relationship Type="http://x%s" Target="%s"/>' % p for p in pairs) + b"</Relationships>"


def docx(*more, links=((b"/metadata/core-properties", b"docProps/core.xml"), (b"/officeDocument", b"word/document.xml"), (b"/metadata/thumbnail", b"docProps/thumbnail.jpeg"))):
    return stored_package([("[Content_Types].xml", TYPES), ("_rels/.rels", rels(*links)), ("word/document.xml", b"<d>text</d>"), ("docProps/core.xml", b"<c>Ann</c>"), ("docProps/thumbnail.jpeg", b"jpg"), *more])


def contents(b):
    return {e.name: content_of(e) for e in read_entries(b)}


def test_ooxml_properties_are_emptied_and_private_parts_go():
    clean, tokens = packages.clean_package(docx(("docProps/meta.xml", b"<m/>"), ("DocProps/evil.xml", b"<m/>"), ("docProps/app.xml", b"<a>x</a>")), "ooxml")
    got = contents(clean)
    assert list(got) == ["[Content_Types].xml", "_rels/.rels", "word/document.xml", "docProps/core.xml", "docProps/app.xml"]
    assert got["word/document.xml"] == b"<d>text</d>" and b"Ann" not in clean and b"thumbnail" not in got["_rels/.rels"] + got["[Content_Types].xml"]
    assert set(tokens) == {"thumbnail", "documentProperties"}
    assert packages.clean_package(clean, "ooxml")[0] == clean


@pytest.mark.parametrize("target", [b"./props/x.xml", b"props%2Fx.xml", b"/a/../props/x.xml"])
def test_properties_are_found_by_relationship(target):
    clean, _ = packages.clean_package(docx(("props/x.xml", b"<p>Ann</p>"), links=((b"/extended-properties", target),)), "ooxml")
    assert b"Ann" not in clean


def test_a_part_that_is_content_and_metadata_is_refused():
    with pytest.raises(Damaged):
        packages.clean_package(docx(links=((b"/officeDocument", b"word/document.xml"), (b"/metadata/thumbnail", b"word/document.xml"))), "ooxml")


def test_odf():
    odt = stored_package([("mimetype", b"application/vnd.oasis.opendocument.text"), ("content.xml", b"<c/>"), ("meta.xml", b"<m>Ann</m>"), ("Thumbnails/thumbnail.png", b"png"), ("META-INF/manifest.xml", b'<m:manifest xmlns:m="m"><m:file-entry full-path="Thumbnails/thumbnail.png"/><m:file-entry full-path="content.xml"/></m:manifest>')])
    got = contents(packages.clean_package(odt, "odf")[0])
    assert list(got) == ["mimetype", "content.xml", "meta.xml", "META-INF/manifest.xml"] and got["meta.xml"] == packages.ODF_META.encode()
    assert b"Thumbnails" not in got["META-INF/manifest.xml"]


def test_epub_with_two_renditions():
    opf = b'<package><metadata xmlns:dc="d"><dc:title>T</dc:title><dc:creator>Ann</dc:creator><dc:identifier>id1</dc:identifier><meta property="dcterms:modified">2024</meta><meta name="cover" content="c"/><meta name="by" content="Ann"/></metadata></package>'
    container = b'<container><rootfiles><rootfile full-path="OEBPS/a.opf"/><rootfile full-path="/OPS/b.opf"/></rootfiles></container>'
    clean, tokens = packages.clean_package(stored_package([("mimetype", b"application/epub+zip"), ("META-INF/container.xml", container), ("OEBPS/a.opf", opf), ("OPS/b.opf", opf)]), "epub")
    assert tokens == ["epubMetadata"] and b"Ann" not in clean and b"id1" not in clean
    got = contents(clean)
    assert got["OEBPS/a.opf"] == got["OPS/b.opf"] and b"urn:tidemark:" in got["OEBPS/a.opf"] and b"1980-01-01T00:00:00Z" in got["OEBPS/a.opf"] and b'name="cover"' in got["OEBPS/a.opf"]


def test_canonical_check_sees_every_change():
    good = packages.clean_package(docx(), "ooxml")[0]
    assert packages.verify_canonical(good) == 4
    for k in (10, 14, len(good) - 5, len(good) - 60):
        with pytest.raises(Damaged):
            packages.verify_canonical(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :])
    for bad in (good + b"x", b"x" + good, good[:-1]):
        with pytest.raises(Damaged):
            packages.verify_canonical(bad)


def test_reader_refuses_what_is_unusual():
    twice = stored_package([("a.txt", b"x"), ("A.TXT", b"y")])
    for bad in (b"", b"PK", twice, stored_package([("../evil", b"")]), stored_package([("/abs", b"")]), stored_package([("", b"")]), stored_package([("a\\b", b"")])):
        with pytest.raises(Damaged):
            read_entries(bad)
    bomb = zlib.compressobj(9, zlib.DEFLATED, -15)
    data = bomb.compress(bytes(20 << 20)) + bomb.flush()
    with pytest.raises(Damaged):
        content_of(read_entries(packages.write_package([("z", 8, data, 0, 1024)]))[0])


def test_document_types_are_refused():
    with pytest.raises(Damaged):
        packages.parse(b'<!DOCTYPE x [<!ENTITY a "b">]><x/>')


def test_entries_limits_parts_and_offsets(spark):
    good = docx()
    files_ = spark.createDataFrame([(1, "docx", bytearray(good)), (2, "docx", bytearray(stored_package([("a", b"x")]))), (3, "docx", bytearray(b"junk")), (4, "epub", None)], "file_id long, format string, content binary")
    rows = packages.entries(files_)
    assert {r.file_id: r.ok for r in packages.within_limits(rows).collect()} == {1: True, 2: True, 3: False, 4: False}
    assert [r.file_id for r in packages.has_required_parts(rows.where("error is null"), files_.select("file_id", "format")).collect()] == [1]
    assert {r.file_id: r.ok for r in packages.contiguous(rows.where("error is null")).collect()} == {1: True, 2: True}
    got = {r.file_id: r for r in packages.cleaned(files_.withColumn("kind", packages.F.lit("ooxml")), ["file_id"]).collect()}
    assert got[1].error is None and got[2].error and got[3].error


def test_validation_of_packages(spark):
    rows = [(1, "a.docx", bytearray(docx()), True, None), (2, "a.docx", bytearray(docx()), False, None), (3, "a.txt", bytearray(b"hi"), None, "text/plain"), (4, "a.txt", bytearray(b"hi"), None, "image/png"), (5, "a/b.txt", bytearray(b"hi"), None, None), (6, "a.xyz", bytearray(b"hi"), None, ""), (7, "a.png", bytearray(b"\xff\xd8\xff"), None, None), (8, None, None, None, None)]
    files_ = spark.createDataFrame(rows, "file_id long, name string, content binary, packaged boolean, mime string")
    got = {r.file_id: r.error_code for r in formats.validated(files_).collect()}
    assert got == {1: None, 2: "suspicious_file", 3: None, 4: "suspicious_file", 5: "invalid_filename", 6: "unsupported_format", 7: "suspicious_file", 8: "invalid_filename"}


SVG = b'<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink">%s</svg>'


@pytest.mark.parametrize(
    ("inside", "left"),
    [
        (b"<script>x</script><rect/>", "<rect/>"),
        (b'<rect onclick="x()" width="1"/>', '<rect width="1"/>'),
        (b'<use xlink:href="#a"/><use xlink:href="http://x"/>', '<use xlink:href="#a"/><use/>'),
        (b'<animate attributeName="href" to="x"/><animate attributeName="opacity"/>', '<animate attributeName="opacity"/>'),
        (b"<g style=''/>", "<g/>"),
        (b"<style>a{fill:red}</style><style>@import url(x)</style>", "<style>a{fill:red}</style>"),
        (b"<!-- c --><title>t</title><desc>d</desc><metadata/>", ""),
        (b'<g xmlns:i="i" i:label="secret"><path d="M0"/></g>', '<g><path d="M0"/></g>'),
        (b'<rect style="fill:url(#a)"/><rect style="fill:url(http://x)"/>', '<rect style="fill:url(#a)"/><rect/>'),
    ],
)
def test_svg(inside, left):
    out = markup.clean_svg(SVG % inside).decode()
    body = out[out.index(">") + 1 : out.rindex("<")] if "</svg>" in out else ""
    assert body == left


def test_output_facts_and_the_second_reading_agree(spark):
    texts = {
        "<svg><g/></svg>": (True, False, False),
        " <x:svg xmlns:x='u'><x:script/></x:svg>": (True, True, False),
        '<svg><a xml:onclick = "x"/></svg>': (True, True, False),
        "<svg><text>on top = 3; title</text></svg>": (True, False, False),
        "<svg><animate attributeName=' xlink:Href '/></svg>": (True, False, True),
        "<svg><animate attributeName='onload'/></svg>": (True, False, True),
        "<svg><animate attributeName='x'/></svg>": (True, False, False),
        "<svg><a v='JavaScript:1'/></svg>": (True, True, False),
        "<svg><!-- c --></svg>": (True, True, False),
        "<g><svg/></g>": (False, False, False),
    }
    rows = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string")
    got = {r[0]: tuple(r)[1:] for r in rows.select("t", *markup.output_facts(F.col("t")).values()).collect()}
    assert got == texts | {"": (False, False, False), None: (None, None, None)}
    for text, (is_svg, content, target) in texts.items():
        assert (markup.output_problem(text.strip()) is None) == (is_svg and not content and not target)


def test_svg_that_is_refused():
    for bad in (b"<!DOCTYPE svg><svg/>", b"<html/>", b"<svg><g></svg>", b"", SVG % b"<text>javascript:x</text>"):
        with pytest.raises(Damaged):
            markup.clean_svg(bad)


@pytest.mark.parametrize(
    ("inside", "left"),
    [
        ("<text></text><g/><g ></g ><text\r\n/>", "<text></text><g/><g></g><text/>"),
        ("<text>/></text><g><script/></g><g><!-- /> --></g>", "<text>/&gt;</text><g></g><g></g>"),
        ("<text>a\rb\r\nc\n\r</text>\r", "<text>a\rb\r\nc\n\r</text>\r"),
        ("<text>a&#13;b\r&#10;c</text>", "<text>a&#13;b\n\nc</text>"),  # a reference stays one; CR and LF aren't one line end
        ("\r<script>\r</script>\n<text x='1\r\n2'><![CDATA[\r\n]]></text>", '\n\n<text x="1 2"><![CDATA[\r\n]]></text>'),
        ("<style>a{b:expression\r(1)}</style>", ""),
    ],
)
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16"])
def test_svg_stays_as_it_was_written(inside, left, encoding):
    out = markup.clean_svg(f"<svg>{inside}</svg>".encode(encoding))
    assert out.decode() == f"<svg>{left}</svg>" and markup.clean_svg(out) == out


def test_svg_query_of_odd_texts_equals_its_sql(spark, tmp_path):
    texts = [None, "", " ", "\r", "a\rb\r\nc\n", "\r\n" * 5_000, "&#13;<g/>", '"]]>']
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalog.queries()["q_clean_svg"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert got == set(duck.execute(catalog.oracle_sql()["q_clean_svg"]).fetchall())
