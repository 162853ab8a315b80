"""The one helper of the container formats that touches bytes: it leaves out ranges and writes numbers, as a plan says."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


_BUILT: dict[tuple[str, str], Column] = {}


def remembered(spark: SparkSession, key: str, build: Callable[[], Column]) -> Column:
    """The Column of ``build``, made once for each application: plans of many nested functions take a second to put together."""
    whole = spark.sparkContext.applicationId, key
    if whole not in _BUILT:
        _BUILT[whole] = build()
    return _BUILT[whole]


def values(column: pa.Array, made: Callable[[bytes], bytes] | None = None) -> Iterator[bytes | None]:
    """A column's values one after another, so that one is held beside it at a time; ``made``: what makes a file's bytes of a value (null stays null)."""
    for value in column:
        b = value.as_py()
        yield b if b is None or made is None else made(b)


def reading(read: Callable[[Iterable[bytes | None]], pa.Array], schema: str, content: Column, made: Callable[[bytes], bytes] | None = None) -> Column:
    """``read`` of a column's values, as a Column."""

    @F.arrow_udf(schema)
    def nodes(content: pa.Array) -> pa.Array:
        return read(values(content, made))

    return nodes(content)


def spliced(b: bytes, removed: list[dict], patches: list[dict], blanked: list[dict] = (), spared: list[dict] = ()) -> bytes:
    """``b`` with patches (numbers of ``width`` bytes at ``at``, little-endian if negative), without ``removed`` ranges; in ``blanked`` ranges all bytes outside ``spared`` ones become zero."""
    out = bytearray(b)
    for area in blanked:
        begin, end = area["begin"], area["end"]
        out[begin:end] = bytes(end - begin)
        for r in spared:
            x, y = max(begin, r["begin"]), min(end, r["end"])
            if x < y:
                out[x:y] = b[x:y]
    for p in patches:
        width = p["width"]
        kind = f"{'<' if width < 0 else '>'}u{abs(width)}"
        data = np.array(p["values"], np.int64).astype(kind).tobytes()
        out[p["at"] : p["at"] + len(data)] = data
    parts, at = [], 0
    for r in sorted(removed, key=lambda r: r["begin"]):
        parts.append(out[at : r["begin"]])
        at = r["end"]
    return b"".join([*parts, out[at:]])
