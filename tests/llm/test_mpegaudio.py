import hashlib
import os
import zlib

import pytest

from tests.llm.helpers import AWKWARD, documents
from tidemark.llm import mpegaudio


@pytest.mark.parametrize("n", [0, 1, 64, 936, 937, 938, 937 * 3, 50_000])
def test_payload_round_trip(n):
    payload = mpegaudio.padded(os.urandom(n))
    back, stream = mpegaudio.unwrap(mpegaudio.wrap(payload))
    assert back == payload and len(payload) % 64 == 0 and payload
    assert stream.frames == stream.vbr_frames and stream.resyncs == stream.crc_bad == 0
    assert stream.duration_us == stream.frames * 24_000 and len(stream.toc) == 100


def test_resynchronises_after_garbage_and_reports_damage():
    media = mpegaudio.wrap(os.urandom(20_000))
    whole = mpegaudio.parse(media)
    cut = whole.offsets[3]
    torn = mpegaudio.parse(media[:cut] + b"\xff junk \xff\xfb\x00" + media[cut:])
    assert (torn.frames, torn.resyncs, torn.data) == (whole.frames, 1, whole.data)
    bad = bytearray(media)
    bad[whole.offsets[2] + 4] ^= 1
    assert mpegaudio.parse(bytes(bad)).crc_bad == 1
    with pytest.raises(ValueError):
        mpegaudio.unwrap(bytes(bad))


def test_headers_of_other_versions_and_layers():
    assert mpegaudio.header(bytes([0xFF, 0xFB, 0x90, 0x00])).size == 417  # MPEG-1 layer III, 128 kbit/s, 44.1 kHz
    assert mpegaudio.header(bytes([0xFF, 0xFB, 0x92, 0x00])).size == 418
    assert mpegaudio.header(bytes([0xFF, 0xF3, 0x40, 0xC0])).size == 104  # MPEG-2 layer III, 32 kbit/s, 22.05 kHz
    assert mpegaudio.header(bytes([0xFF, 0xFF, 0x10, 0x00])).samples == 384  # layer I
    assert mpegaudio.header(b"\xff\xe8\x90\x00") is None and mpegaudio.header(b"abcd") is None
    assert mpegaudio.parse(b"").frames == mpegaudio.parse(b"no frames here").frames == 0


def test_digests(spark):
    got = sorted(mpegaudio.digests(mpegaudio.store(documents(spark, AWKWARD))).collect())
    for row, text in zip(got, AWKWARD):
        payload = mpegaudio.padded((text or "").encode())
        assert (row.n_bytes, row.payload_bytes) == (len((text or "").encode()), len(payload))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest() and row.tail_crc32 == zlib.crc32(payload[-64:])
        assert row.media_sha256 == hashlib.sha256(mpegaudio.wrap(payload)).hexdigest()
    assert got[7][1:] == got[8][1:]


def test_media_column(spark):
    rows = mpegaudio.store(documents(spark, AWKWARD)).select("id", "media")
    got = sorted(mpegaudio.media(rows, ["id"]).select("id", "frames", "vbr_frames", "payload", "tags").collect())
    assert all(r.frames == r.vbr_frames and r.tags["TXXX:payload_bytes"] == str(len(r.payload)) for r in got)
    assert bytes(got[4].payload).rstrip(b"\0") == b"One  two"
