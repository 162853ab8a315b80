"""Token-id output: canonical length-limited Huffman coding with independent blocks.

1. Documents are tokenized once; ids wait in a shared table.
2. Counts of all ids (at most the vocabulary) give code lengths by package-merge, at most ``MAX_BITS`` bits, and from the
   lengths alone the canonical code.  The file keeps the lengths, not the codes.
3. Each document's ids are coded; then documents are range-partitioned and sorted by doc_id and packed into blocks of about
   ``BLOCK_IDS`` ids.  A block row holds its documents, their numbers of ids and the bit offset of a checkpoint at every
   document's start and every ``CHECKPOINT_IDS`` ids within one, so any block, and any run between checkpoints, decodes alone.
4. Decoding reads one table entry per id for thousands of runs at a time.

The file is a Parquet table of blocks beside a Parquet table of code lengths.  Null text is empty: the end id only.
Repeated doc_ids stay apart, in the order of their number of ids and a hash of their code; null doc_ids come first.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import MADE, buffer_of, documents, forget, parallelism, shared_dir, sliced, utf8, written
from tidemark.llm.words import word_ids

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
MAX_BITS = 18
BLOCK_IDS = 1 << 16
CHECKPOINT_IDS = 512
CODE_BYTES = 1 << 18  # ids coded at a time: their arrays stay in a core's cache
BLOCK_SCHEMA = "part int, block int, ids_n long, docs array<long>, counts array<long>, doc_bits array<long>, point_bits array<long>, code binary"


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits for the symbols with a count, by package-merge; others get 0."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(symbols) < 2:
        lengths[symbols] = 1
        return lengths
    if len(symbols) > 1 << most:
        raise ValueError(f"{len(symbols)} symbols don't fit in codes of {most} bits")
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    leaf = counts[order].astype(np.float64)
    n = len(leaf)
    weights, levels = leaf, []
    for _ in range(most - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank >= n)
        weights = both[rank]
    # Walk back: the first 2n-2 items of the last level are taken; each package taken takes two of the level before.
    taken, bits = 2 * n - 2, np.zeros(n, np.int64)
    for package in reversed(levels):
        chosen = package[:taken]
        packages = int(chosen.sum())
        bits[: taken - packages] += 1
        taken = 2 * packages
    bits[:taken] += 1
    lengths[order] = bits
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    own = lengths[order].astype(np.int64)
    for size in np.unique(own):
        code <<= int(size) - last
        last = int(size)
        same = order[own == size]
        codes[same] = np.arange(code, code + len(same), dtype=np.uint64)
        code += len(same)
    return codes


def decode_table(lengths: np.ndarray, bits: int) -> np.ndarray:
    """For every ``bits``-bit prefix: symbol << 5 | code length."""
    codes, table = canonical(lengths), np.zeros(1 << bits, np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    first = (codes[order] << (np.uint64(bits) - lengths[order].astype(np.uint64))).astype(np.int64)
    spans = np.int64(1) << (bits - lengths[order].astype(np.int64))
    filled = np.repeat((order.astype(np.uint32) << np.uint32(5)) | lengths[order], spans)  # ids below 2**27
    table[first[0] if len(first) else 0 :][: len(filled)] = filled
    return table


def encode_bits(ids: np.ndarray, ends: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Codes of many documents, each from a byte of its own.

    ends: where each document's ids end.  Returns the bytes, the bit position of each id, and the first byte of each document (and the end).
    """
    size = lengths[ids].astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    own = np.diff(total[np.concatenate([[0], ends])])
    places = np.concatenate([[0], np.cumsum((own + 7) // 8)])
    begin = np.concatenate([[0], ends])[:-1]
    start = total[:-1] + np.repeat(8 * places[:-1] - total[begin], ends - begin)
    code, word, last = codes[ids], start >> 6, (start & 63) + size
    over = last > 64
    high = np.where(over, code >> np.maximum(last - 64, 0).astype(np.uint64), code << np.maximum(64 - last, 0).astype(np.uint64))
    out = np.zeros(int(places[-1]) // 8 + 2, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(high, first)
        spill = np.flatnonzero(over)
        out[word[spill] + 1] |= code[spill] << (128 - last[spill]).astype(np.uint64)
    return out.byteswap().tobytes()[: int(places[-1])], start, places


def decode_runs(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Ids of runs that start at the given bits and have the given numbers of ids, run after run."""
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    window = (padded[:-3] << np.uint32(24)) | (padded[1:-2] << np.uint32(16)) | (padded[2:-1] << np.uint32(8)) | padded[3:]
    order = np.argsort(-counts, kind="stable")
    at, live = starts[order].copy(), np.searchsorted(-counts[order], -np.arange(1, int(counts.max(initial=0)) + 1), "right")
    out = np.zeros(int(counts.sum()), np.uint32)
    place = np.concatenate([[0], np.cumsum(counts)])[:-1][order]
    mask, shift = np.uint32((1 << bits) - 1), 32 - bits
    for step, n in enumerate(live):
        own = at[:n]
        entry = table[(window[own >> 3] >> (shift - (own & 7)).astype(np.uint32)) & mask]
        out[place[:n] + step] = entry >> np.uint32(5)
        own += entry & np.uint32(31)
    return out


def tokenized(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n and ids (little-endian unsigned 16-bit if all of a slice's ids fit, else 32-bit: n tells them apart), end id included."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_ids(tokenizer)
        for batch in batches:
            for part in sliced(batch, "bytes"):
                flat, ends = memo.encoded(part.column("bytes"))
                flat, ends = np.insert(flat, ends, end_id), ends + np.arange(1, len(ends) + 1)
                kind = np.dtype("<u2" if flat.max(initial=0) < 1 << 16 else "<u4")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends, prepend=0)), _binary(flat.astype(kind).view(np.uint8), kind.itemsize * ends)], ["id", "n", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("bytes")).mapInArrow(encode, "id long, n long, ids binary")


def flat_ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of ``tokenized`` rows, and how many each row has."""
    data, offsets = buffer_of(batch.column("ids"))
    n = np.asarray(batch.column("n"))
    wide = np.diff(offsets) == 4 * n
    if not wide.any() or not len(data):
        return data.view("<u2"), n
    if wide.all():
        return data.view("<u4"), n
    return np.concatenate([data[b:e].view("<u4" if w else "<u2") for b, e, w in zip(offsets, offsets[1:], wide)]), n


def _binary(data: np.ndarray | bytes, ends: np.ndarray) -> pa.Array:
    """A binary Arrow column of consecutive slices of ``data``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(bytes(data) if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes())])


def id_counts(ids: DataFrame) -> np.ndarray:
    """Counts of all ids; at most one row per id of the vocabulary goes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            own = np.bincount(flat_ids(batch)[0])
            if len(own) > len(total):
                total = np.pad(total, (0, len(own) - len(total)))
            total[: len(own)] += own
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["token", "n"])

    rows = ids.select("n", "ids").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["token"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["token"]] = r["n"]
    return counts


def write_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents in ascending order of ``id_col`` to ``path``: tables ``blocks`` and ``code``."""
    spark = docs.sparkSession
    ids = written(tokenized(docs, tokenizer, end_id, id_col, text_col), "ids")
    lengths = code_lengths(id_counts(ids))
    codes = canonical(lengths)
    found = np.flatnonzero(lengths)
    spark.createDataFrame([(int(t), int(lengths[t])) for t in found], "token int, bits int").coalesce(1).write.parquet(f"{path}/code")
    sent = spark.sparkContext.broadcast((codes, lengths))  # as many entries as the vocabulary

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = sent.value
        for batch in batches:
            for part in sliced(batch, "ids", CODE_BYTES):
                flat, n = flat_ids(part)
                ends = np.cumsum(n)
                coded, start, places = encode_bits(flat, ends, codes, lengths)
                begin = ends - n
                # Checkpoints inside a document: bits from its first byte, at every CHECKPOINT_IDS ids.
                inner = (n - 1) // CHECKPOINT_IDS
                doc = np.repeat(np.arange(len(n)), inner)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(inner) - inner, inner) + 1
                bits = start[begin[doc] + k * CHECKPOINT_IDS] - 8 * places[doc]
                points = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(inner)]).astype(np.int32)), pa.array(bits))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), points, _binary(coded, places[1:])], ["id", "n", "points", "code"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            docs_, n, places, points = [h[0] for h in held], [h[1] for h in held], [], []
            at = 0
            for _, _, own, coded in held:
                places.append(8 * at)
                points += [8 * at + p for p in own]
                at += len(coded)
            row = {"part": part, "block": number, "ids_n": sum(n), "docs": docs_, "counts": n, "doc_bits": places, "point_bits": points, "code": b"".join(h[3] for h in held)}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "points", "code"))):
                held.append(row)
                size += row[1]
                if size >= BLOCK_IDS:
                    yield out()
                    held, size, number = [], 0, number + 1
        if held:
            yield out()

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("ids_n", pa.int64()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("doc_bits", pa.list_(pa.int64())), ("point_bits", pa.list_(pa.int64())), ("code", pa.binary())])
    # Coded rows wait in a table of their own, so that finding the ranges reads no more than numbers.  Rows that share an id
    # are dealt by what follows it, so a repeated id doesn't fill one task.
    coded = ids.mapInArrow(code, "id long, n long, points array<long>, code binary").withColumn("h", F.xxhash64("code"))
    parts, coded = parallelism(ids), written(coded, "coded", "none")
    forget(ids)
    ordered = coded.repartitionByRange(parts, "id", "n", "h").sortWithinPartitions("id", "n", "h", "code").drop("h")
    blocks = ordered.mapInArrow(block, BLOCK_SCHEMA)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Decode a file made by ``write_ids``: id, start, n_tokens and ids (array<int>), or ids_crc32 instead of ids."""
    rows = spark.read.schema("token int, bits int").parquet(f"{path}/code").collect()  # at most one row per id of the vocabulary
    lengths = np.zeros(max((r["token"] for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["token"]] = r["bits"]
    bits = max(1, int(lengths.max()))
    sent = spark.sparkContext.broadcast(lengths)
    kind = "ids_crc32 long" if digest else "ids array<int>"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(sent.value, bits)
        for batch in batches:
            for part in sliced(batch, "code", 2 << 20):
                data, offsets = buffer_of(part.column("code"))
                where, n, starts, inner = (part.column(c) for c in ("docs", "counts", "doc_bits", "point_bits"))
                per_block = np.diff(np.asarray(where.offsets))
                ids, n, starts = where.flatten(), np.asarray(n.flatten()), np.asarray(starts.flatten())  # ids stay in Arrow: some may be null
                starts = starts + np.repeat(8 * offsets[:-1], per_block)
                points = np.asarray(inner.flatten()) + np.repeat(8 * offsets[:-1], np.diff(np.asarray(inner.offsets)))
                runs = (n - 1) // CHECKPOINT_IDS + 1
                first = np.cumsum(runs) - runs
                is_first = np.zeros(int(runs.sum()), bool)
                is_first[first] = True
                at, count = np.zeros(len(is_first), np.int64), np.full(len(is_first), CHECKPOINT_IDS, np.int64)
                at[is_first], at[~is_first] = starts, points
                count[first + runs - 1] = n - (runs - 1) * CHECKPOINT_IDS
                flat = decode_runs(data, at, count, table, bits)
                ends = np.cumsum(n)
                start = np.concatenate([b + np.cumsum(x) - x for b, x in zip(part.column("before").to_pylist(), np.split(n, np.cumsum(per_block)[:-1]))]) if len(n) else n
                if digest:
                    raw = flat.astype("<u4").tobytes()
                    out = pa.array([zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())], pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(start), pa.array(n), out], ["id", "start", "n_tokens", kind.split()[0]])

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # Ids before each block: sums by part (as many rows as parts), then running sums within a part.
    totals = blocks.groupBy("part").agg(F.sum("ids_n").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    index = blocks.select("part", "block", F.coalesce(F.sum("ids_n").over(inside), F.lit(0)).alias("own")).join(before, "part").select("part", "block", (F.col("base") + F.col("own")).cast("long").alias("before"))
    return blocks.join(index, ["part", "block"]).select("docs", "counts", "doc_bits", "point_bits", "code", "before").mapInArrow(decode, f"id long, start long, n_tokens long, {kind}")


def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: write all documents' ids, read the files back."""
    path = f"{shared_dir(spark)}/tidemark/huffman-{uuid.uuid4().hex}"
    MADE.append(path)
    write_ids(documents(spark, sf_dir), path)
    return read_ids(spark, path, digest=True).withColumnRenamed("id", "doc_id")
