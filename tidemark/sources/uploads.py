"""The entries of uploaded packages, read by Column expressions alone: no Python sees the bytes, and no code of the cleaners is used.

``listing`` walks a ZIP's central directory; ``fault`` checks the entries as intervals of the archive: each local record must
begin with its signature and end before the next one and before the directory, stored sizes must add up to no more than the
archive, and names must stay inside.  So entries that share bytes, which make a small archive large, are refused before
anything is inflated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.formats import looks_like_zip, unsafe_zip_path
from tidemark.operators.splice import let

# Fixed values of the format: sizes of records, signatures, the largest comment; and the limit of entries.
END_BYTES, CENTRAL_BYTES, LOCAL_BYTES, COMMENT_BYTES = 22, 46, 30, 65_535
MOST_ENTRIES = 2000
ENTRY = "struct<name:string,method:int,csize:bigint,usize:bigint,header:bigint,begin:bigint,end:bigint,head:string>"


def _bytes(content: Column, at: Column, size: Column) -> Column:
    """Bytes from offset ``at``, which may lie beyond the end."""
    return F.substr(content, F.least(at + 1, F.lit((1 << 31) - 1)).cast("int"), F.least(size, F.lit(COMMENT_BYTES)).cast("int"))


def number(content: Column, at: Column, size: int) -> Column:
    """The little-endian number of ``size`` bytes at offset ``at``; null beyond the end."""
    digits = F.hex(_bytes(content, at, F.lit(size)))
    turned = F.concat(*(F.substr(digits, F.lit(2 * k + 1), F.lit(2)) for k in reversed(range(size))))
    return F.when(F.length(digits) == 2 * size, F.conv(turned, 16, 10).cast("long"))


def signed(content: Column, at: Column, signature: bytes) -> Column:
    return _bytes(content, at, F.lit(len(signature))) == F.lit(signature)


def listing(content: Column) -> Column:
    """(entries, directory, size, error) of a package; null for what doesn't start as one.  directory: where the central records begin."""
    size = F.octet_length(content).cast("long")
    begin = F.greatest(F.lit(0).cast("long"), size - END_BYTES - COMMENT_BYTES)
    tail = F.decode(F.substr(content, (begin + 1).cast("int"), F.greatest(F.lit(0), (size - begin - END_BYTES + 4).cast("int"))), "ISO-8859-1")
    place = let(tail, lambda t: let(F.instr(F.reverse(t), "\x06\x05KP"), lambda back: F.when(back > 0, begin + F.length(t) - back - 3)))

    def header(end: Column) -> Column:
        disks = (number(content, end + 4, 2) == 0) & (number(content, end + 6, 2) == 0) & (number(content, end + 8, 2) == number(content, end + 10, 2))
        return F.struct(end.alias("end"), disks.alias("disks"), number(content, end + 10, 2).alias("count"), number(content, end + 12, 4).alias("length"), number(content, end + 16, 4).alias("start"))

    def entry(at: Column, h: Column) -> Column:
        csize, method = number(content, at + 20, 4), number(content, at + 10, 2)
        name = F.make_valid_utf8(_bytes(content, at + CENTRAL_BYTES, h["name"]).cast("string"))
        data = h["header"] + LOCAL_BYTES + number(content, h["header"] + 26, 2) + number(content, h["header"] + 28, 2)
        own = F.struct(name.alias("name"), method.cast("int").alias("method"), csize.alias("csize"), number(content, at + 24, 4).alias("usize"), h["header"].alias("header"), data.alias("begin"))
        head = lambda e: F.when((e["method"] == 0) & (e["csize"] <= 256), F.decode(_bytes(content, e["begin"], e["csize"]), "ISO-8859-1"))
        return let(own, lambda e: F.struct(e["name"].alias("name"), e["method"].alias("method"), e["csize"].alias("csize"), e["usize"].alias("usize"), e["header"].alias("header"), e["begin"].alias("begin"), (e["begin"] + e["csize"]).alias("end"), head(e).alias("head")).cast(ENTRY))

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        sizes = F.struct(number(content, at + 28, 2).alias("name"), number(content, at + 30, 2).alias("extra"), number(content, at + 32, 2).alias("comment"), number(content, at + 42, 4).alias("header"))

        def further(h: Column) -> Column:
            signs = signed(content, at, b"PK\1\2") & signed(content, h["header"], b"PK\3\4")
            added = let(entry(at, h), lambda e: F.struct(e.alias("entry"), F.coalesce(signs & e["end"].isNotNull(), F.lit(False)).alias("good")))
            return let(added, lambda x: F.struct((at + CENTRAL_BYTES + h["name"] + h["extra"] + h["comment"]).alias("at"), (~x["good"]).alias("bad"), F.when(x["good"], F.concat(acc["entries"], F.array(x["entry"]))).otherwise(acc["entries"]).alias("entries")))

        return F.when(acc["bad"], acc).otherwise(let(sizes, further))

    def walked(h: Column) -> Column:
        whole = F.coalesce(h["disks"] & (h["count"] > 0) & (h["start"] + h["length"] <= h["end"]), F.lit(False))
        first = F.struct(h["start"].alias("at"), F.lit(False).alias("bad"), F.array().cast(f"array<{ENTRY}>").alias("entries"))
        found = F.aggregate(F.sequence(F.lit(1), F.when(whole & (h["count"] <= MOST_ENTRIES), h["count"].cast("int")).otherwise(1)), first, step)

        def listed(w: Column) -> Column:
            error = F.when(~whole, "no directory").when(h["count"] > MOST_ENTRIES, "too many entries").when(w["bad"] | ~F.coalesce(w["at"] == h["start"] + h["length"], F.lit(False)), "bad directory")
            return F.struct(F.when(error.isNull(), w["entries"]).otherwise(F.array().cast(f"array<{ENTRY}>")).alias("entries"), h["start"].alias("directory"), size.alias("size"), error.alias("error"))

        return let(found, listed)

    return F.when(F.coalesce(looks_like_zip(content), F.lit(False)), let(place, lambda end: let(header(end), walked)))


def fault(listed: Column) -> Column:
    """What is wrong with a listing (null: nothing): records that overlap or leave the archive, sizes that don't fit, unsafe names."""
    return let(listed, _fault)


def _fault(listed: Column) -> Column:
    entries = listed["entries"]
    total = F.aggregate(entries, F.lit(0).cast("long"), lambda n, e: n + e["csize"])
    spans = F.array_sort(F.transform(entries, lambda e: F.struct(e["header"].alias("begin"), e["end"].alias("end"))))
    # Each record against the one that begins next.
    following = F.concat(F.slice(spans, 2, F.greatest(F.size(spans), F.lit(1))), F.array(F.struct(listed["directory"].alias("begin"), listed["directory"].alias("end"))))
    overlap = F.exists(F.zip_with(spans, following, lambda a, b: a["end"] > b["begin"]), lambda x: x)
    return F.coalesce(
        listed["error"],
        F.when(total > listed["size"], "entries larger than the archive"),
        F.when(overlap, "entries overlap"),
        F.when(F.exists(entries, lambda e: unsafe_zip_path(e["name"])), "unsafe name"),
        F.when(F.exists(entries, lambda e: (e["csize"] == 0) & (e["usize"] > 0)), "impossible sizes"),
    )
