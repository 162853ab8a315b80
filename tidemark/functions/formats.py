"""Formats: the dimension table of known formats, and detection and validation as Column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Format, category, extensions (the first is the usual one for output unless given), MIME types.
FORMATS_TEXT = """
jpeg image jpg,jpeg image/jpeg
png image png image/png
webp image webp image/webp
avif image avif image/avif
heic image heic image/heic,image/heif,image/heic-sequence,image/heif-sequence
heif image heif image/heif,image/heic
tiff image tif,tiff image/tiff
gif image gif image/gif
bmp image bmp image/bmp,image/x-ms-bmp
svg svg svg image/svg+xml,text/xml,application/xml
mp4 video mp4 video/mp4,application/mp4
m4v video m4v video/mp4,video/x-m4v
mov video mov,qt video/quicktime
webm video webm video/webm
mkv video mkv video/x-matroska,video/matroska
avi video avi video/x-msvideo,video/avi
mpeg video mpeg video/mpeg
mpg video mpg video/mpeg
3gp video 3gp,3gpp video/3gpp,audio/3gpp
mp3 audio mp3 audio/mpeg,audio/mp3
m4a audio m4a audio/mp4,audio/x-m4a,video/mp4
aac audio aac audio/aac,audio/aacp
flac audio flac audio/flac,audio/x-flac
wav audio wav audio/wav,audio/x-wav,audio/vnd.wave
aiff audio aif,aiff,aifc audio/aiff,audio/x-aiff
ogg audio ogg,oga audio/ogg,application/ogg
opus audio opus audio/ogg,audio/opus
pdf document pdf application/pdf
docx document docx application/vnd.openxmlformats-officedocument.wordprocessingml.document,application/zip
xlsx document xlsx application/vnd.openxmlformats-officedocument.spreadsheetml.sheet,application/zip
pptx document pptx application/vnd.openxmlformats-officedocument.presentationml.presentation,application/zip
odt document odt application/vnd.oasis.opendocument.text,application/zip
ods document ods application/vnd.oasis.opendocument.spreadsheet,application/zip
odp document odp application/vnd.oasis.opendocument.presentation,application/zip
txt document txt text/plain
md document md,markdown text/markdown,text/x-markdown,text/plain
csv document csv text/csv,application/csv,application/vnd.ms-excel,text/plain
rtf document rtf application/rtf,text/rtf
epub document epub application/epub+zip,application/zip
"""

FORMATS = [(f, c, e.split(","), m.split(",")) for f, c, e, m in (line.split() for line in FORMATS_TEXT.strip().splitlines())]
#: Formats whose output extension isn't the first listed.
OUTPUT_EXTENSIONS = {f: "aiff" if f == "aiff" else e[0] for f, _, e, _ in FORMATS}
ZIP_FORMATS = ["docx", "xlsx", "pptx", "odt", "ods", "odp", "epub"]
TEXT_FORMATS = ["txt", "md", "csv"]
HEAD_BYTES = 4096

SVG_HEAD = r"(?is)^\s*(?:<\?xml.*?\?>\s*)?(?:<!doctype.*?>\s*)?<svg[\s>]"
PLAIN_TEXT = r"^[\x09-\x0d\x20-\x7e\x80-\xff]*$"


def formats(spark: SparkSession) -> DataFrame:
    """One row per format; fixed size, so safe to broadcast."""
    rows = [(f, c, e, m, OUTPUT_EXTENSIONS[f]) for f, c, e, m in FORMATS]
    return spark.createDataFrame(rows, "format string, category string, extensions array<string>, mime_types array<string>, output_extension string")


def extensions(spark: SparkSession) -> DataFrame:
    """One row per extension: extension, format, category, mime_type (the format's first)."""
    return formats(spark).select(F.explode("extensions").alias("extension"), "format", "category", F.col("mime_types")[0].alias("mime_type"))


def filename_valid(name: Column) -> Column:
    """1 to 255 characters, no NUL, no slash of either kind, no two dots in a row."""
    units = F.length(F.regexp_replace(name, "[\\x{10000}-\\x{10FFFF}]", "  "))
    return F.coalesce((units >= 1) & (units <= 255) & ~name.rlike(r"[\x00/\\]") & ~F.contains(name, F.lit("..")), F.lit(False))


def extension(name: Column) -> Column:
    """Lower-case text behind the last dot, unless the dot is the first character."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1))


def head(content: Column) -> Column:
    return F.substring(content, 1, HEAD_BYTES)


def starts_with(content: Column, prefix: bytes, at: int = 0) -> Column:
    """Whether the bytes at offset ``at`` are ``prefix``; false beyond the end."""
    return F.coalesce(F.substring(content, at + 1, len(prefix)) == F.lit(prefix), F.lit(False))


def looks_like_plain_text(content: Column) -> Column:
    """No control bytes but 9 to 13 in the first 4096; bytes from 128 on pass."""
    return F.decode(head(content), "ISO-8859-1").rlike(PLAIN_TEXT)


def looks_like_svg(content: Column) -> Column:
    text = F.decode(head(content), "ISO-8859-1")
    return ~F.contains(text, F.lit("\0")) & text.rlike(SVG_HEAD)


def looks_like_rtf(content: Column) -> Column:
    return starts_with(content, b"{\\rtf")


def looks_like_pdf(content: Column) -> Column:
    return starts_with(content, b"%PDF-")


def looks_like_zip(content: Column) -> Column:
    return starts_with(content, b"PK\3\4") | starts_with(content, b"PK\5\6") | starts_with(content, b"PK\7\b")


def unsafe_zip_path(name: Column) -> Column:
    """Empty, with a NUL, absolute, with a drive letter, or climbing."""
    return (name == "") | name.rlike(r"\x00|^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")


def detected(content: Column) -> Column:
    """(ext, mime) by magic bytes, from the public format specifications; null if unknown."""
    def hit(ext: str, mime: str) -> Column:
        return F.struct(F.lit(ext).alias("ext"), F.lit(mime).alias("mime"))

    brand = F.decode(F.substring(content, 9, 4), "ISO-8859-1")
    ftyp = starts_with(content, b"ftyp", 4)
    riff, kind = starts_with(content, b"RIFF"), F.decode(F.substring(content, 9, 4), "ISO-8859-1")
    early = F.decode(F.substring(content, 1, 64), "ISO-8859-1")
    sync = F.conv(F.hex(F.substring(content, 1, 2)), 16, 10).cast("int")
    rules = [
        (starts_with(content, b"\xff\xd8\xff"), "jpg", "image/jpeg"),
        (starts_with(content, b"\x89PNG\r\n\x1a\n"), "png", "image/png"),
        (riff & (kind == "WEBP"), "webp", "image/webp"),
        (riff & (kind == "AVI "), "avi", "video/vnd.avi"),
        (riff & (kind == "WAVE"), "wav", "audio/wav"),
        (starts_with(content, b"GIF8"), "gif", "image/gif"),
        (starts_with(content, b"BM"), "bmp", "image/bmp"),
        (starts_with(content, b"II*\0") | starts_with(content, b"MM\0*"), "tif", "image/tiff"),
        (ftyp & brand.rlike("^avi[fs]"), "avif", "image/avif"),
        (ftyp & brand.rlike("^hei[cxms]|^hev[cx]"), "heic", "image/heic"),
        (ftyp & brand.rlike("^mif1|^msf1"), "heic", "image/heif"),
        (ftyp & brand.rlike("^qt  "), "mov", "video/quicktime"),
        (ftyp & brand.rlike("^M4V"), "m4v", "video/x-m4v"),
        (ftyp & brand.rlike("^M4A|^M4B"), "m4a", "audio/x-m4a"),
        (ftyp & brand.rlike("^3g"), "3gp", "video/3gpp"),
        (ftyp, "mp4", "video/mp4"),
        (starts_with(content, b"\x1a\x45\xdf\xa3") & F.contains(early, F.lit("webm")), "webm", "video/webm"),
        (starts_with(content, b"\x1a\x45\xdf\xa3"), "mkv", "video/matroska"),
        (starts_with(content, b"\0\0\1\xba"), "mpg", "video/mpeg"),
        (starts_with(content, b"fLaC"), "flac", "audio/flac"),
        (starts_with(content, b"ID3"), "mp3", "audio/mpeg"),
        (starts_with(content, b"FORM") & kind.isin("AIFF", "AIFC"), "aif", "audio/aiff"),
        (starts_with(content, b"OggS") & F.contains(early, F.lit("OpusHead")), "opus", "audio/ogg"),
        (starts_with(content, b"OggS"), "ogg", "audio/ogg"),
        (looks_like_pdf(content), "pdf", "application/pdf"),
        (looks_like_rtf(content), "rtf", "application/rtf"),
        (looks_like_zip(content), "zip", "application/zip"),
        (sync.bitwiseAND(F.lit(0xFFF6)) == 0xFFF0, "aac", "audio/aac"),
        (sync.bitwiseAND(F.lit(0xFFE0)) == 0xFFE0, "mp3", "audio/mpeg"),
    ]
    out = F.when(rules[0][0], hit(*rules[0][1:]))
    for test, ext, mime in rules[1:]:
        out = out.when(test, hit(ext, mime))
    return out


def browser_kind(name: Column, content: Column) -> Column:
    """The kind of cleaner for a file: by content for images, by extension and content for the rest; null if none."""
    ext = extension(F.concat(F.lit("x"), name))
    sync = (F.conv(F.hex(F.substring(content, 1, 2)), 16, 10).cast("int").bitwiseAND(F.lit(0xFFE0)) == 0xFFE0)
    return (
        F.when(starts_with(content, b"\xff\xd8\xff"), "jpeg")
        .when(starts_with(content, b"\x89PNG\r\n\x1a\n"), "png")
        .when(starts_with(content, b"RIFF") & starts_with(content, b"WEBP", 8), "webp")
        .when((ext == "gif") & (starts_with(content, b"GIF87a") | starts_with(content, b"GIF89a")), "gif")
        .when((ext == "flac") & (starts_with(content, b"fLaC") | starts_with(content, b"ID3")), "flac")
        .when((ext == "mp3") & (starts_with(content, b"ID3") | F.coalesce(sync, F.lit(False))), "mp3")
        .when(ext.isin("docx", "xlsx", "pptx") & starts_with(content, b"PK\3\4"), "ooxml")
        .when(ext.isin("odt", "ods", "odp") & starts_with(content, b"PK\3\4"), "odf")
        .when((ext == "epub") & starts_with(content, b"PK\3\4"), "epub")
        .when((ext == "rtf") & looks_like_rtf(content), "rtf")
        .when((ext == "svg") & looks_like_svg(content), "svg")
        .when(ext.isin("txt", "md", "markdown", "csv") & (F.octet_length(content) > 0) & looks_like_plain_text(content), "text")
    )


def refusal_message(code: Column) -> Column:
    return (
        F.when(code == "invalid_filename", "The file name is not valid.")
        .when(code == "suspicious_file", "The content does not match the file's name.")
        .when(code == "unsupported_format", "The format is not supported.")
        .when(code == "file_too_large", "The file is too large.")
    )


def validated(files: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """The validation ladder over ``files`` (file_id, name, content, and optionally mime and packaged).

    Adds ``upload`` (null if refused), ``error_code`` (null if accepted) and ``error_message``; the first rule that fails
    decides.  ``packaged`` says that a package has the parts its extension needs (see ``operators.packages``); ``caps`` are
    byte limits by category.  Joins with the format table are broadcast joins of a table of fixed size.
    """
    spark = files.sparkSession
    for column, kind in (("mime", "string"), ("packaged", "boolean")):
        if column not in files.columns:
            files = files.withColumn(column, F.lit(None).cast(kind))
    dim = formats(spark).select(F.explode("extensions").alias("ext_"), "format", "category", "extensions", "mime_types")
    out = files.withColumn("ext_", extension(F.col("name"))).join(F.broadcast(dim), "ext_", "left")
    magic = detected(F.col("content"))
    out = out.withColumn("magic_", magic)
    in_set = F.array_contains("extensions", F.col("magic_.ext")) | F.array_contains("mime_types", F.col("magic_.mime"))
    textual = (
        F.when(F.col("format") == "svg", looks_like_svg(F.col("content")))
        .when(F.col("format") == "rtf", looks_like_rtf(F.col("content")))
        .when(F.col("format") == "pdf", looks_like_pdf(F.col("content")))
        .when(F.col("format").isin(TEXT_FORMATS), looks_like_plain_text(F.col("content")))
        .otherwise(False)
    )
    fits = (
        F.when(F.col("format").isNull(), False)
        .when(F.col("format").isin(ZIP_FORMATS), looks_like_zip(F.col("content")) & F.coalesce("packaged", F.lit(False)))
        .when(F.coalesce(in_set, F.lit(False)), True)
        .when(F.col("magic_").isNull(), textual)
        .otherwise(False)
    )
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    cap = F.lit(None).cast("long")
    for category, limit in (caps or {}).items():
        cap = F.when(F.col("category") == category, F.lit(limit).cast("long")).otherwise(cap)
    known_mime = ~F.coalesce(F.col("mime"), F.lit("")).isin("", "application/octet-stream")
    code = (
        F.when(~filename_valid(F.col("name")), "invalid_filename")
        .when(~fits & F.col("format").isNotNull() & (F.col("magic_").isNotNull() | F.col("format").isin(ZIP_FORMATS) & looks_like_zip(F.col("content"))), "suspicious_file")
        .when(~fits, "unsupported_format")
        .when(size > cap, "file_too_large")
        .when(known_mime & ~F.array_contains("mime_types", F.lower("mime")), "suspicious_file")
    )
    upload = F.struct("category", "format", F.col("ext_").alias("extension"), F.col("ext_").alias("output_extension"), F.col("mime_types")[0].alias("mime_type"), size.alias("size"))
    out = out.withColumn("error_code", code).withColumn("error_message", refusal_message(F.col("error_code")))
    return out.withColumn("upload", F.when(F.col("error_code").isNull(), upload)).drop("ext_", "magic_", "format", "category", "extensions", "mime_types")
