"""Stream facts of media files without decoding: duration, and of each stream its type, codec, size, rate and channels.

ISO media give them by boxes, FLAC by its stream block, MP3 by walking its frame headers, Ogg by its headers and positions.  ``probe`` makes them a column, which
``snapshots.streams_error`` compares before and after cleaning.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators import isomedia, ogg, segments
from tidemark.operators.segments import FAULTS

FIELDS = ["codec_name", "width", "height", "sample_rate", "channels"]
PROBED = ["isomedia", "flac", "mp3", "ogg"]

# Bit rates (kbit/s) of layer III by version 1 and 2, and sample rates of version 1.
MP3_RATES = [[0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0], [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0]]
MP3_HERTZ = [44100, 48000, 32000]


def _stream(kind: str, codec: str, width=None, height=None, rate=None, channels=None) -> dict:
    return {"codec_type": kind, "codec_name": codec, "width": width, "height": height, "sample_rate": rate, "channels": channels}


def _iso(b: bytes) -> dict:
    found, longest = [], None
    for box in isomedia.tree(b):
        if box["path"] == "/moov/trak":
            codec, width, height, rate, channels, seconds = box["facts"]
            kind = isomedia.HANDLERS.get(box["handler"], "data")
            found.append(_stream(kind, codec, *(int(x) if x else None for x in (width, height, rate, channels))))
            if kind != "data" and seconds:
                longest = max(longest or 0.0, float(seconds))
    return {"duration": longest, "streams": found}


def _flac(b: bytes) -> dict:
    info = next((s for s in segments.flac(b) if s.kind == "0"), None)
    if info is None:
        return {"duration": None, "streams": []}
    word = int.from_bytes(b[info.start + 14 : info.start + 22], "big")
    rate = word >> 44
    return {"duration": (word & (1 << 36) - 1) / rate if rate else None, "streams": [_stream("audio", "flac", rate=rate, channels=(word >> 41 & 7) + 1)]}


def _mp3(b: bytes) -> dict:
    """Frames are followed from header to header over the file's frame data; what doesn't continue ends the count."""
    seconds, first = 0.0, None
    for s in segments.mp3(b):
        at = s.start
        while s.keep and at + 4 <= s.end:
            version, layer, rate, hertz, padded = b[at + 1] >> 3 & 3, b[at + 1] >> 1 & 3, b[at + 2] >> 4, b[at + 2] >> 2 & 3, b[at + 2] >> 1 & 1
            if b[at] != 0xFF or b[at + 1] < 0xE0 or layer != 1 or version == 1 or hertz == 3 or not MP3_RATES[version != 3][rate]:
                break
            per_second = MP3_HERTZ[hertz] >> (0 if version == 3 else 1 if version == 2 else 2)
            samples = 1152 if version == 3 else 576
            first = first or (per_second, 1 if b[at + 3] >> 6 == 3 else 2)
            seconds += samples / per_second
            at += samples // 8 * MP3_RATES[version != 3][rate] * 1000 // per_second + padded
    return {"duration": seconds if first else None, "streams": [_stream("audio", "mp3", rate=first[0], channels=first[1])] if first else []}


def _ogg(b: bytes) -> dict:
    """Positions count samples; of several streams the longest gives the duration."""
    found = ogg.tree(b)[1]
    seconds = [s["last"] / s["rate"] for s in found if s["rate"]]
    return {"duration": max(seconds, default=None), "streams": [_stream("audio", s["codec"], rate=s["rate"], channels=s["channels"]) for s in found]}


_STREAM = pa.struct([("codec_type", pa.string()), ("codec_name", pa.string()), *((c, pa.int64()) for c in ("width", "height", "sample_rate", "channels"))])
_PROBE = pa.struct([("duration", pa.float64()), ("streams", pa.list_(_STREAM))])
PROBE = "struct<duration:double,streams:array<struct<codec_type:string,codec_name:string,width:bigint,height:bigint,sample_rate:bigint,channels:bigint>>>"


def probe_of(content: bytes | None, kind: str | None) -> dict | None:
    """Facts of one file; null if it is of another kind or can't be read."""
    if content is None or kind not in PROBED:
        return None
    try:
        return {"isomedia": _iso, "flac": _flac, "mp3": _mp3, "ogg": _ogg}[kind](content)
    except FAULTS:
        return None


def probe(content: Column, kind: Column) -> Column:
    """(duration, streams) of files."""

    @F.arrow_udf(PROBE)
    def read(content: pa.Array, kind: pa.Array) -> pa.Array:
        return pa.array([probe_of(c, k) for c, k in zip(content.to_pylist(), kind.to_pylist())], _PROBE)

    return read(content, kind)
