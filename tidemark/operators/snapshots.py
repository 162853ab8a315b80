"""Comparing what files held before and after cleaning: metadata snapshots by a full outer join, streams by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import is_sensitive

# Facts that must be equal where both sides have them, and stream fields likewise.
FACTS = "BitDepth BitsPerSample ColorType ColorComponents FrameCount PageCount".split()
STREAM_FIELDS = "codec_name width height avg_frame_rate sample_rate channels pix_fmt color_range color_space color_transfer color_primaries display_aspect_ratio".split()
PLAYED = "video audio subtitle".split()
COLOR_TAG = "(?i)(colorspace|icc|whitepoint|chromaticit|gamma|primar|profile)"


def metadata_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """file_id, key, old, new, change (added, removed, changed or same) of long-form metadata (file_id, key, value)."""
    a, b = before.select("file_id", "key", F.col("value").alias("old")), after.select("file_id", "key", F.col("value").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return a.join(b, ["file_id", "key"], "full_outer").withColumn("change", change)


def map_error(before: Column, after: Column) -> Column:
    """The first rule that a cleaned file's metadata breaks (null: none), from both maps of one row: no shuffle."""

    def first(tags: list[str], side: Column) -> Column:
        own = lambda t: F.array_max(F.transform(F.filter(F.map_entries(side), lambda e: F.element_at(F.split(e["key"], ":"), -1) == t), lambda e: e["value"]))
        return F.coalesce(*map(own, tags))

    kind = lambda side: F.regexp_replace(F.lower(first(["FileTypeExtension", "FileType"], side)), "^jpeg$", "jpg")
    moved = lambda tag: first([tag], before) != first([tag], after)
    profile = lambda side: F.exists(F.map_keys(side), lambda k: k.rlike("^ICC[-_]"))
    colours = lambda side: F.exists(F.map_keys(side), lambda k: F.element_at(F.split(k, ":"), -1).rlike(COLOR_TAG))
    turn = lambda side: first(["Orientation"], side)
    # Keys of both sides with whether their values differ, and whether what the result holds is sensitive.
    left = F.map_zip_with(before, after, lambda k, old, new: F.coalesce(new.isNotNull() & is_sensitive(k, new), F.lit(False)))
    rules = [
        (kind(before) != kind(after), "file type changed"),
        (moved("ImageWidth"), "image width changed"),
        (moved("ImageHeight"), "image height changed"),
        (profile(before) & ~profile(after), "colour profile lost"),
        (turn(before).isNotNull() & ~turn(before).eqNullSafe(turn(after)), "orientation lost"),
        (colours(before) & ~colours(after), "colour space lost"),
        *((moved(f), f"{f} changed") for f in FACTS),
        (F.exists(F.map_values(left), lambda x: x), "sensitive metadata left"),
    ]
    return F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), text) for test, text in rules))


def as_map(fields: Column) -> Column:
    """An array of (key, value) as a map; the first value of a key counts, null values are left out."""
    whole = F.filter(fields, lambda f: f["key"].isNotNull() & f["value"].isNotNull())
    keys = F.array_distinct(F.transform(whole, lambda f: f["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(whole, lambda f: f["key"] == k)[0]["value"]))


def snapshot_verdict(before: DataFrame, after: DataFrame) -> DataFrame:
    """file_id and error (null: accepted) of long-form metadata (file_id, key, value): one shuffle, without rows that no rule reads."""
    sides = before.select("file_id", "key", "value", F.lit(False).alias("new")).unionByName(after.select("file_id", "key", "value", F.lit(True).alias("new")))
    read = F.element_at(F.split("key", ":"), -1).rlike(f"^({'|'.join(['FileTypeExtension', 'FileType', 'ImageWidth', 'ImageHeight', 'Orientation', *FACTS])})$|{COLOR_TAG}") | F.col("key").rlike("^ICC[-_]") | F.col("new") & is_sensitive(F.col("key"), F.col("value"))
    # Rows that no rule reads keep their file in the result, as one null.
    field = F.when(read, F.struct("key", "value", "new"))
    rows = sides.select("file_id", field.alias("f")).groupBy("file_id").agg(F.collect_list("f").alias("f"))
    side = lambda new: as_map(F.filter("f", lambda f: f["new"] == F.lit(new)))
    return rows.select("file_id", side(False).alias("old"), side(True).alias("new")).select("file_id", map_error(F.col("old"), F.col("new")).alias("error"))


def streams_error(before: Column, after: Column, fields: list[str], played: list[str] = PLAYED, only: bool = False) -> Column:
    """What changed between two probes of one row, (duration, streams) each: streams of each type are compared in order; no shuffle.

    Data and attachment streams may vanish.  Fields and durations count where both sides have them.  For audio files,
    ``played`` is audio alone and ``only`` asks that no other stream is left.
    """
    of = lambda probe, kind: F.filter(F.coalesce(probe["streams"], F.filter(F.coalesce(before["streams"], after["streams"]), lambda s: F.lit(False))), lambda s: s["codec_type"] == kind)
    differs = lambda a, b: F.coalesce(*(F.when(a[f] != b[f], True) for f in fields), F.lit(False))
    counts, changed = F.lit(False), F.lit(False)
    for kind in played:
        a, b = of(before, kind), of(after, kind)
        counts = counts | (F.size(a) != F.size(b))
        changed = changed | F.exists(F.zip_with(a, b, differs), lambda x: x)
    others = F.coalesce(F.exists(after["streams"], lambda s: ~s["codec_type"].isin(played)), F.lit(False)) if only else F.lit(False)
    d1, d2 = before["duration"].cast("double"), after["duration"].cast("double")
    return F.when(others, "other streams left").when(counts, "stream count changed").when(changed, "stream changed").when(F.abs(d1 - d2) > F.greatest(F.lit(1.0), 0.01 * d1), "duration changed")


def stream_verdict(before: DataFrame, after: DataFrame, played: list[str] = PLAYED, only: bool = False) -> DataFrame:
    """file_id and error of probes (file_id, duration, streams array<struct>) of two tables: one join by file."""
    side = lambda df, name: df.select("file_id", F.struct("duration", "streams").alias(name))
    fields = [f for f in STREAM_FIELDS if f in before.schema["streams"].dataType.elementType.fieldNames()]
    both = side(before, "old").join(side(after, "new"), "file_id", "full_outer")
    return both.select("file_id", streams_error(F.col("old"), F.col("new"), fields, played, only).alias("error"))


def document_error(kind: Column, before: Column, after: Column) -> Column:
    """What is wrong with a cleaned text or PDF: texts must be the same bytes, PDFs must not keep an incremental update."""
    return F.when((kind == "text") & ~before.eqNullSafe(after), "text changed").when((kind == "pdf") & F.contains(after, F.lit(b"%BeginExifToolUpdate")), "earlier version left")
