"""Best-fit packing by length-histogram planning.

1. Each document becomes ids plus an end id; one longer than a sequence is cut into whole-sequence pieces and a rest.
2. Only the histogram of piece lengths goes to the driver: at most ``limit`` rows, whatever the corpus.
3. Best-fit decreasing runs over counts: all pieces of one length go, at once, into the open sequences with the least room
   that still holds them; many sequences with one history are one group.  The plan is a list of runs: the pieces of one
   length with ranks in a range take slots that follow from the rank by arithmetic.
4. Pieces get their rank within their length in a distributed way (count by length and hash bucket, prefix sums of the
   counts, row numbers within a bucket), so no task holds all pieces of a length, and look up their run.

The plan's size has a bound that doesn't depend on the number of pieces: a length opens at most two groups and splits at
most one group, so there are at most 3 x limit histories, and a sequence holds at most sqrt(2 x limit) different lengths, so
there are at most 3 x limit x sqrt(2 x limit) runs: 1.1 million for 4096, 45 MB.  It is checked before the plan is sent.

Null text is empty: one piece with the end id only.  Rows that repeat, doc_id included, are packed each on its own.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, parallelism, sliced, utf8, written
from tidemark.llm.words import word_ids

TOKENIZER = "word_bpe_49k.json"
MAX_TOKENS = 4096
END_ID = 1


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32; no shuffle."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_ids(tokenizer)
        for batch in batches:
            for part in sliced(batch, "bytes"):
                flat, ends = memo.encoded(part.column("bytes"))
                # Each document's end id goes in behind its ids.
                data, ends = np.insert(flat, ends, end_id).astype("<u4").tobytes(), ends + np.arange(1, len(ends) + 1)
                size = np.diff(ends, prepend=0)
                n = -(-size // limit)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start, begin = piece * limit, (ends - size)[doc] + piece * limit
                length = np.minimum(limit, size[doc] - start)
                crc = [zlib.crc32(data[4 * b : 4 * e]) for b, e in zip(begin.tolist(), (begin + length).tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("bytes")).mapInArrow(cut, "id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], limit: int = MAX_TOKENS) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts.

    Returns runs (length, first rank, sequences, first sequence, offset) sorted by length and first rank, and the number of
    sequences.  In a run, rank r is the (r - first rank) // sequences-th copy in sequence first + (r - first rank) % sequences.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of sequences (first, how many)
    rooms: list[int] = []  # sorted keys of groups
    opened = 0

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            own = groups[room]
            if own and own[-1][0] + own[-1][1] == first:
                own[-1] = (own[-1][0], own[-1][1] + n)
            else:
                own.append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(k)
            else:
                room, first = limit, opened
                n = -(-left // (limit // length))
                opened += n
            copies = room // length
            full = min(n, left // copies)
            if full:
                runs.append((length, rank, full, first, limit - room))
                rank, left = rank + full * copies, left - full * copies
                add(room - copies * length, first, full)
            if full < n:
                some = min(left, copies)
                if some:
                    runs.append((length, rank, 1, first + full, limit - room))
                    rank, left = rank + some, left - some
                    add(room - some * length, first + full, 1)
                add(room, first + full + bool(some), n - full - bool(some))
    table = np.array(runs, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))], opened


def ranked(rows: DataFrame, buckets: int) -> DataFrame:
    """Adds ``rank`` (from 0) within ``length`` without bringing the rows of a length together."""
    # Not by id alone: rows whose id is null or repeats are dealt by what they hold.
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = rows.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32")
    return rows.withColumn("row", F.row_number().over(own)).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("row") - 1).drop("bucket", "base", "row")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = MAX_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their sequence and offset."""
    rows = written(pieces(docs, tokenizer, limit, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``limit`` rows
    table, _ = plan(histogram, limit)
    if len(table) > 3 * limit * math.isqrt(2 * limit) + 3 * limit:
        raise AssertionError(f"the plan has {len(table)} runs, more than its bound")
    sent = rows.sparkSession.sparkContext.broadcast(table)
    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = sent.value
        wide = int(runs[:, 1].max()) + 1 if len(runs) else 1
        keys = runs[:, 0] * wide + runs[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            run = runs[np.searchsorted(keys, length * wide + np.minimum(rank, wide - 1), "right") - 1]
            copy, place_ = np.divmod(rank - run[:, 1], run[:, 2])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), pa.array(run[:, 3] + place_), pa.array(run[:, 4] + copy * length)], names)

    buckets = max(64, 4 * parallelism(docs))
    placed = ranked(rows, buckets).select(*names[:5], F.col("rank").cast("long").alias("rank")).mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents packed into sequences of at most 4096 tokens."""
    return pack(documents(spark, sf_dir))
