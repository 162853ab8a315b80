"""Media columns: MPEG audio.

``wrap`` stores bytes losslessly in a variable-bitrate MPEG-1 layer III stream: an ID3v2 tag with the payload's length, a Xing
frame (frames, bytes, 100-entry table of contents), CRC-protected mono frames with empty side information whose data bytes
are the payload, and an ID3v1 tag.  ``parse`` reads any such stream without trusting it: tags at both ends, Xing, Info and
VBRI tables, header by header through the stream; where a header is wrong it searches for the next place from which two
headers in a row fit (resynchronisation), and verifies each protected frame's checksum.  It returns exact duration (samples
over rate), frame offsets, and the data bytes of the frames in order.

In ``media``: null content is empty.  A column of any bytes can be parsed; bytes without a frame give zero frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, sliced, utf8, written

# Fixed values of the MPEG audio header (ISO/IEC 11172-3 and 13818-3).
BITRATES = {  # kbit/s by (MPEG-1, layer)
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}  # Hz by version bits

SIDE_BYTES = 17  # MPEG-1 layer III, mono
OVERHEAD = 4 + 2 + SIDE_BYTES
ALIGN = 64
SEEK_FRAMES = 16


def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x8005, starting from all ones, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1
        crc &= 0xFFFF
    return crc


@lru_cache(4096)
def _cached_crc(data: bytes) -> int:
    return crc16(data)


@dataclass(frozen=True)
class Header:
    mpeg1: bool
    layer: int
    protected: bool
    kbps: int
    rate: int
    size: int
    samples: int
    mono: bool

    @property
    def side(self) -> int:
        return 0 if self.layer != 3 else (17 if self.mono else 32) if self.mpeg1 else (9 if self.mono else 17)


@lru_cache(65536)
def header(word: bytes) -> Header | None:
    """The header in four bytes; None if they aren't one, or of free format."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    rate_at, bit_at = word[2] >> 2 & 3, word[2] >> 4
    if version == 1 or layer == 4 or rate_at == 3 or bit_at in (0, 15):
        return None
    mpeg1, rate = version == 3, RATES[version][rate_at]
    kbps, pad = BITRATES[mpeg1, layer][bit_at], word[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or mpeg1 else 576
    size = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples * 125 * kbps // rate + pad
    return Header(mpeg1, layer, not word[1] & 1, kbps, rate, size, samples, word[3] >> 6 == 3)


def _mono(bit_at: int) -> bytes:
    return bytes([0xFF, 0xFA, bit_at << 4 | 1 << 2, 0xC0])  # MPEG-1 layer III, protected, 48 kHz, mono


_SIZES = [header(_mono(b)).size for b in range(1, 15)]


def _frame_start(bit_at: int) -> bytes:
    word = _mono(bit_at)
    side = bytes(SIDE_BYTES)
    return word + crc16(word[2:] + side).to_bytes(2, "big") + side


_STARTS = [_frame_start(b) for b in range(1, 15)]


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def wrap(payload: bytes) -> bytes:
    """The payload in a stream of frames; see above."""
    large, start = _SIZES[-1], _STARTS[-1]
    room = large - OVERHEAD
    full, rest = divmod(len(payload), room)
    body = np.zeros((full, large), np.uint8)
    body[:, :OVERHEAD] = np.frombuffer(start, np.uint8)
    body[:, OVERHEAD:] = np.frombuffer(payload[: full * room], np.uint8).reshape(full, room)
    last = b""
    if rest:
        k = next(i for i, s in enumerate(_SIZES) if s - OVERHEAD >= rest)
        last = (_STARTS[k] + payload[full * room :]).ljust(_SIZES[k], b"\0")
    first = next(i for i, s in enumerate(_SIZES) if s - OVERHEAD >= 120)
    frames, size = full + bool(rest), _SIZES[first] + body.size + len(last)
    toc = bytes(min(255, (_SIZES[first] + min(i * frames // 100, full) * large) * 256 // size) for i in range(100))
    info = (_STARTS[first] + b"Xing" + struct.pack(">III", 7, frames, size) + toc).ljust(_SIZES[first], b"\0")
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    return b"ID3\3\0\0" + _synchsafe(len(tag)) + tag + info + body.tobytes() + last + (b"TAG" + b"payload").ljust(127, b"\0") + b"\xff"


@dataclass
class Stream:
    """What ``parse`` finds."""

    frames: int = 0
    samples: int = 0
    rate: int = 0
    crc_ok: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    vbr_frames: int = -1
    vbr_bytes: int = -1
    toc: bytes = b""
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    kbps: set[int] = field(default_factory=set)
    data: bytes = b""

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.rate if self.rate else 0


def _id3v2(media: bytes, at: int, found: Stream) -> int:
    """The end of the ID3v2 tag at ``at``; its text frames go to ``found.tags``."""
    size = 0
    for b in media[at + 6 : at + 10]:
        size = size << 7 | b & 0x7F
    end = at + 10 + size + (10 if media[at + 5] & 0x10 else 0)
    p, major = at + 10, media[at + 3]
    while major in (3, 4) and p + 10 <= min(end, len(media)) and media[p] != 0:
        raw = media[p + 4 : p + 8]
        n = int.from_bytes(raw, "big") if major == 3 else (raw[0] & 0x7F) << 21 | (raw[1] & 0x7F) << 14 | (raw[2] & 0x7F) << 7 | raw[3] & 0x7F
        value = media[p + 10 : min(p + 10 + n, end)]
        if media[p : p + 1] == b"T" and value[:1] in (b"\0", b"\3"):
            words = value[1:].decode("latin-1" if value[0] == 0 else "utf-8", "replace").rstrip("\0").split("\0", 1)
            key = media[p : p + 4].decode("latin-1")
            if key == "TXXX" and len(words) == 2:
                found.tags[f"TXXX:{words[0]}"] = words[1]
            else:
                found.tags[key] = words[0]
        p += 10 + n
    return end


def parse(media: bytes, offsets: bool = True) -> Stream:
    """Read a stream from its bytes."""
    found, at, end = Stream(), 0, len(media)
    while media[at : at + 3] == b"ID3" and at + 10 <= end:
        at = _id3v2(media, at, found)
    if end - at >= 128 and media[end - 128 : end - 125] == b"TAG":
        end -= 128
        found.tags["ID3v1"] = media[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    data: list[bytes] = []
    synced, first = False, True
    while at + 4 <= end:
        h = header(media[at : at + 4])
        fits = h is not None and h.size > 4 and at + h.size <= end
        if fits and not synced:
            following = at + h.size
            fits = following + 4 > end or header(media[following : following + 4]) is not None
        if not fits:
            found.resyncs += synced
            synced = False
            at = media.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        synced = True
        begin = at + 4 + 2 * h.protected + h.side
        if h.protected and h.layer == 3:
            good = _cached_crc(media[at + 2 : at + 4] + media[at + 6 : at + 6 + h.side]) == int.from_bytes(media[at + 4 : at + 6], "big")
            found.crc_ok += good
            found.crc_bad += not good
        if first:
            first = False
            plain = begin - 2 * h.protected  # Some writers leave the checksum out of account.
            for p in (begin, plain):
                if media[p : p + 4] in (b"Xing", b"Info"):
                    (flags,) = struct.unpack(">I", media[p + 4 : p + 8])
                    q = p + 8
                    if flags & 1:
                        found.vbr_frames, q = int.from_bytes(media[q : q + 4], "big"), q + 4
                    if flags & 2:
                        found.vbr_bytes, q = int.from_bytes(media[q : q + 4], "big"), q + 4
                    if flags & 4:
                        found.toc = media[q : q + 100]
                    break
            if found.vbr_frames < 0 and media[at + 36 : at + 40] == b"VBRI":
                found.vbr_bytes, found.vbr_frames = struct.unpack(">II", media[at + 46 : at + 54])
            if found.vbr_frames >= 0:
                at += h.size
                continue
        found.frames += 1
        found.samples += h.samples
        found.rate = found.rate or h.rate
        found.kbps.add(h.kbps)
        if offsets:
            found.offsets.append(at)
        data.append(media[begin : at + h.size])
        at += h.size
    found.data = b"".join(data)
    return found


def unwrap(media: bytes) -> tuple[bytes, Stream]:
    """The payload that ``wrap`` stored, and the stream."""
    found = parse(media)
    n = int(found.tags.get("TXXX:payload_bytes", len(found.data)))
    if n > len(found.data) or found.crc_bad:
        raise ValueError("the stream is damaged: its payload can't be read back whole")
    return found.data[:n], found


def padded(text: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return text.ljust(max(ALIGN, -(-len(text) // ALIGN) * ALIGN), b"\0")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media of every row; no shuffle."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "bytes"):
                texts = part.column("bytes").to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([wrap(padded(t)) for t in texts], pa.binary())], ["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("bytes")).mapInArrow(make, "id long, n_bytes long, media binary")


def media(rows: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """What the streams hold: keep, frames, samples, rate, duration_us, crc_ok, crc_bad, resyncs, vbr_frames, vbr_bytes, seek_offsets, tags and payload."""
    names = ["frames", "samples", "rate", "duration_us", "crc_ok", "crc_bad", "resyncs", "vbr_frames", "vbr_bytes"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "media_bytes_"):
                streams = [parse(m) for m in part.column("media_bytes_").to_pylist()]
                columns = [pa.array([getattr(s, n) for s in streams], pa.int64()) for n in names]
                seeks = pa.array([s.offsets[::SEEK_FRAMES] for s in streams], pa.list_(pa.int64()))
                tags = pa.array([list(s.tags.items()) for s in streams], pa.map_(pa.string(), pa.string()))
                payload = pa.array([s.data[: int(s.tags.get("TXXX:payload_bytes", len(s.data)))] for s in streams], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns, seeks, tags, payload], [*keep, *names, "seek_offsets", "tags", "payload"])

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep) + "".join(f"{n} long, " for n in names)
    return rows.select(*keep, F.coalesce(F.col(media_col), F.lit(b"")).alias("media_bytes_")).mapInArrow(read, f"{kinds}seek_offsets array<long>, tags map<string,string>, payload binary")


def digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from stored streams (id, n_bytes, media)."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "media"):
                out = []
                for stored in part.column("media").to_pylist():
                    payload, s = unwrap(stored)
                    seeks = zlib.crc32(np.array(s.offsets, "<i8").tobytes())
                    feature = f"frames={s.frames};duration_us={s.duration_us};rate={s.rate};kbps={min(s.kbps)}-{max(s.kbps)};crc={s.crc_ok}/{s.crc_ok + s.crc_bad};resyncs={s.resyncs};vbr={s.vbr_frames}/{s.vbr_bytes};toc={zlib.crc32(s.toc):08x};seek={','.join(map(str, s.offsets[::SEEK_FRAMES]))};seek_crc={seeks:08x}"
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
                columns = list(zip(*out)) or [()] * 6
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return rows.select("id", "n_bytes", "media").mapInArrow(read, f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every text stored as MPEG audio in a shared table, read back and described."""
    return digests(written(store(documents(spark, sf_dir)), "mpeg"))
