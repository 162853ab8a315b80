"""Token counts: overlap resynchronisation.

A text longer than a chunk is cut into chunks that overlap.  Each chunk is encoded with offsets.  Two neighbours are
spliced at a proven stable boundary: a place in their overlap that follows ASCII white space, where both encodings start a
unit, and after which both give the same units and offsets up to the last white space of the overlap.  No piece crosses
white space, so what comes before and after such a place doesn't depend on each other, and the spliced units equal those of
the whole text.  Where the overlap has no such place, it is widened twofold, then the chunk itself, up to the whole text.

Units are tokens, or, of a tokenizer whose words can be encoded alone (see ``words``), the words of a chunk with their ids:
the chunks of a column are then encoded together, and each new word once.

Null text counts as empty: 0 bytes, 0 tokens.  Repeated rows are counted each on its own; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, sliced, utf8
from tidemark.llm.words import WordIds, word_ids

TOKENIZER = "word_bpe_49k.json"
CHUNK = 4096  # bytes of UTF-8
OVERLAP = 256
LIMIT_TOKENS = 2048
_SPACE = b" \t\n\r\x0b\x0c"


def stable_boundary(text: bytes, left: tuple, right: tuple, start: int, end: int) -> tuple[int, int] | None:
    """Where to splice: the index of the first unit of ``right`` to keep, and how many of ``left`` stay; None if unproven.

    left and right: (units, offsets of their first bytes in the whole text), as lists or arrays; the overlap is text[start:end].
    """
    last = max(text.rfind(_SPACE[k : k + 1], start, end) for k in range(len(_SPACE)))
    if last < start:
        return None
    (left_units, left_at), (right_units, right_at) = left, right
    i, j = bisect.bisect_right(left_at, start), bisect.bisect_right(right_at, start)
    i_end, j_end = bisect.bisect_right(left_at, last), bisect.bisect_right(right_at, last)
    while j < j_end:
        at = right_at[j]
        i = bisect.bisect_left(left_at, at, i, i_end)
        if i < i_end and left_at[i] == at and at > start and text[at - 1] in _SPACE:
            if np.array_equal(left_units[i:i_end], right_units[j:j_end]) and np.array_equal(left_at[i:i_end], right_at[j:j_end]):
                return j, i
            return None
        j += 1
    # A boundary at the end of the overlap's last white space, with no whole unit of the overlap after it.
    return None


def _char_start(text: bytes, at: int) -> int:
    """The first place from ``at`` on where a character begins."""
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunk_spans(text: bytes, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """The chunks (begin, end) with which ``spliced`` begins."""
    ends = [0, *(_char_start(text, at) for at in range(chunk, len(text), chunk)), len(text)]
    return [(_char_start(text, max(0, b - overlap)) if b else 0, e) for b, e in zip(ends, ends[1:]) if e > b or not b]


def spliced(encode, text: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> list:
    """Units of a whole text, as parts one after the other.  encode(begin, end) -> (units, offsets of the first bytes in the text)."""
    out: list = []
    spans = chunk_spans(text, chunk, overlap)
    begin, end = spans[0]
    left = encode(begin, end)
    for k in range(1, len(spans)):
        if spans[k][1] <= end:
            continue  # a chunk that was made longer has it
        wide, cut = overlap, None
        while cut is None and wide < end - begin:
            start, stop = _char_start(text, end - wide), spans[k][1]
            right = encode(start, stop)
            cut = stable_boundary(text, left, right, start, end)
            wide *= 2
        if cut is None:
            # Nothing in this chunk is proven stable: make it longer and encode it again.
            end = spans[min(len(spans) - 1, k + max(1, (end - begin) // chunk) - 1)][1]
            left = encode(begin, end)
            continue
        j, kept = cut
        out.append(left[0][:kept])
        left = (right[0][j:], right[1][j:])
        begin, end = int(left[1][0]) if len(left[1]) else start, stop
    return [*out, left[0]]


def token_encode(ids: WordIds, text: bytes):
    """Chunks of any tokenizer: tokens with the offsets of their first bytes."""

    def encode(begin: int, end: int) -> tuple[list[int], list[int]]:
        own = text[begin:end].decode()
        found = ids.tokenizer.encode(own, add_special_tokens=False)
        if own.isascii():
            return found.ids, [begin + s for s, _ in found.offsets]
        places = np.concatenate([[0], np.cumsum([len(c.encode()) for c in own])])
        return found.ids, [begin + int(places[s]) for s, _ in found.offsets]

    return encode


def spliced_ids(ids: WordIds, text: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The token ids of a whole text, from the library's encodings of its chunks."""
    return [x for part in spliced(token_encode(ids, text), text, chunk, overlap) for x in part]


def word_starts(text: bytes) -> np.ndarray:
    """Where the words of a text begin."""
    data = np.frombuffer(text, np.uint8)
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    return np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))


def _of_slice(memo: WordIds, texts: list[bytes], chunk: int, overlap: int) -> list[int]:
    """Tokens of each text, by chunks whose units are words."""
    spans = [chunk_spans(t, chunk, overlap) for t in texts]
    number, ends, _, last = memo.words(pa.array([t[b:e] for t, own in zip(texts, spans) for b, e in own], pa.binary()))
    size = np.diff(last, prepend=0)
    full = size[number]  # tokens of each word; an empty word, which stands for white space at an edge, has none
    total = np.concatenate([[0], np.cumsum(full)])
    ends = np.concatenate([[0], ends])
    counts, at = [], 0
    for text, own in zip(texts, spans):
        if len(own) == 1:
            counts.append(int(total[ends[at + 1]] - total[ends[at]]))
        else:
            known = {span: at + k for k, span in enumerate(own)}

            def encode(begin: int, end: int, text=text, known=known) -> tuple[np.ndarray, np.ndarray]:
                starts = begin + word_starts(text[begin:end])
                k = known.get((begin, end))
                if k is not None:
                    units = full[ends[k] : ends[k + 1]]
                else:
                    found, _, _, last_ = memo.words(pa.array([text[begin:end]], pa.binary()))
                    units = np.diff(last_, prepend=0)[found]
                if len(units) != len(starts):  # empty words at the edges
                    units = units[int(text[begin : begin + 1] in _EDGE) : len(units) - int(text[end - 1 : end] in _EDGE)]
                return units, starts

            counts.append(int(sum(part.sum() for part in spliced(encode, text, chunk, overlap))))
        at += len(own)
    return counts


_EDGE = {_SPACE[k : k + 1] for k in range(len(_SPACE))}


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row of ``docs``; no shuffle, and one document's tokens in memory at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_ids(tokenizer)
        for batch in batches:
            for part in sliced(batch, "bytes"):
                texts = part.column("bytes").to_pylist()
                n = _of_slice(memo, texts, chunk, overlap) if memo.by_word else [len(spliced_ids(memo, t, chunk, overlap)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    found = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("bytes")).mapInArrow(count, "id long, n_bytes long, n_tokens long")
    return found.withColumnRenamed("id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: token counts of all documents."""
    return token_counts(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > LIMIT_TOKENS)
