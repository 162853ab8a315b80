"""SimHash near-duplicates: segment-popcount embedding, grid join under Manhattan distance, exact verification.

A fingerprint's 32 segments of 2 bits become their popcounts, written in unary (0, 1, 2 as 00, 01, 11), so that the
Manhattan distance of two popcount vectors is the number of differing bits of their unary forms.  It never exceeds the
Hamming distance of the fingerprints.  The grid has ``groups`` coordinates, each the exact popcounts of a run of segments.
Two fingerprints within distance 4 differ in at most 4 coordinates, so they agree on some choice of ``groups - 4`` of them:
they meet in that cell.  Within a cell, pairs are compared by Manhattan distance and then by Hamming distance, and a cell
gives a spanning forest of its links, not all its pairs.  A cell of more than ``CELL_LIMIT`` fingerprints is too large for
one task: its members are linked exactly by shared midpoints instead (two fingerprints are within 4 bits iff some word is
within 2 bits of both), which takes 2081 rows a member and no pairs.

Equal fingerprints are one node, so copies cost nothing.  Null and empty texts have fingerprint zero and are linked like any
other.  Repeated rows and doc_ids are in the class of their text.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm import bands, jaccard, prefixes
from tidemark.llm import words as words_module
from tidemark.llm.common import documents, parallelism, sliced, utf8, written
from tidemark.llm.components import components

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
CELL_LIMIT = 8192
_EVEN = 0x5555555555555555


def shingle_hashes(texts: list[bytes], words: int = SHINGLE_WORDS, seed: int = SEED) -> tuple[bytes, np.ndarray, list[int]]:
    """Big-endian XXH64 of all shingles of all texts, how many each text has, and which texts have any."""
    digest, hashes, counts, which = xxhash.xxh64_digest, [], [], []
    for i, text in enumerate(texts):
        own = text.lower().split()
        if not own:
            continue
        joined = b" ".join(own)
        n = len(own) - words + 1
        if n < 2:
            hashes.append(digest(joined, seed))
            n = 1
        else:
            ends = list(itertools.accumulate(map(len, own)))
            hashes += [digest(joined[b + k : e + k + words - 1], seed) for k, (b, e) in enumerate(zip([0, *ends[: n - 1]], ends[words - 1 :]))]
        counts.append(n)
        which.append(i)
    return b"".join(hashes), np.array(counts, np.int64), which


def _majorities(hashes: bytes, n: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel()


def fingerprint_texts(texts: list[bytes], words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """Unsigned fingerprints of whole texts."""
    out = np.zeros(len(texts), np.uint64)
    hashes, n, which = shingle_hashes(texts, words, seed)
    if which:
        out[which] = _majorities(hashes, n)
    return out


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint as a signed long); no shuffle."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "bytes", 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprint_texts(part.column(1).to_pylist(), words).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("bytes")).mapInArrow(compute, "id long, fp long")


def unary_popcounts(fp: Column) -> Column:
    """The segment-popcount embedding of a fingerprint, in unary."""
    half = F.shiftrightunsigned(fp, 1)
    either, both = fp.bitwiseOR(half).bitwiseAND(F.lit(_EVEN)), fp.bitwiseAND(half).bitwiseAND(F.lit(_EVEN))
    return either.bitwiseOR(F.shiftleft(both, 1))


def grid_masks(groups: int, bits: int = MAX_BITS) -> list[int]:
    """Bit masks (signed) of every choice of ``groups - bits`` of the grid's coordinates."""
    edges = [round(32 * k / groups) for k in range(groups + 1)]
    own = [sum(3 << 2 * s for s in range(a, b)) for a, b in itertools.pairwise(edges)]
    masks = [sum(chosen) for chosen in itertools.combinations(own, groups - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def grid_groups(n: int) -> int:
    """Coordinates for ``n`` fingerprints: so many that a cell holds a few of them by chance."""
    return 6 if n < 4_000_000 else 7 if n < 100_000_000 else 8 if n < 2_000_000_000 else 9


def forest(x: np.ndarray, t: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Edges (indices) that connect what lies within ``bits`` of each other, one for each member but the first of a component."""
    rest, a, b = np.arange(len(x)), [], []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            v = todo.pop()
            near = np.bitwise_count(t[rest] ^ t[v]) <= bits
            if near.any():
                near[near] = np.bitwise_count(x[rest[near]] ^ x[v]) <= bits
                found = rest[near].tolist()
                rest = rest[~near]
                a += [v] * len(found)
                b += found
                todo += found
    return a, b


def links(distinct: DataFrame, groups: int, bits: int = MAX_BITS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Edges (a, b) among distinct fingerprints (column fp) that keep the components of all links within ``bits``."""
    parts = parallelism(distinct)
    masks = grid_masks(groups, bits)
    rows = distinct.select("fp", unary_popcounts(F.col("fp")).alias("t"))
    cells = rows.select("fp", "t", F.posexplode(F.array(*[F.col("t").bitwiseAND(F.lit(m)) for m in masks])).alias("k", "own")).select(F.xxhash64("k", "own").alias("cell"), "fp", "t")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        large: int | None = None

        def solve(cell: np.ndarray, x: np.ndarray, t: np.ndarray) -> Iterator[pa.RecordBatch]:
            x, t = x.view(np.uint64), t.view(np.uint64)  # counts of bits are those of magnitudes for signed numbers
            first = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1])
            size = np.diff(np.append(first, len(cell)))
            a, b = [], []
            few = np.repeat(size <= 8, size)
            fc, fx, ft = cell[few], x[few], t[few]
            for step in range(1, 8):
                near = np.flatnonzero((fc[step:] == fc[:-step]) & (np.bitwise_count(ft[step:] ^ ft[:-step]) <= bits))
                near = near[np.bitwise_count(fx[near + step] ^ fx[near]) <= bits]
                a.append(fx[near])
                b.append(fx[near + step])
            for f, n in zip(first[size > 8].tolist(), size[size > 8].tolist()):
                own = x[f : f + n]
                p, q = forest(own, t[f : f + n], bits)
                a.append(own[p])
                b.append(own[q])
            yield out(np.concatenate(a), np.concatenate(b), False)

        def out(a: np.ndarray, b: np.ndarray, spilled: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), spilled))], ["a", "b", "spilled"])

        for batch in batches:
            new = [np.asarray(batch.column(c)) for c in ("cell", "fp", "t")]
            held = [np.concatenate(p) for p in zip(held, new)]
            if large is not None:  # the rest of a cell that is too large for one task
                own = held[0] == large
                if own.any():
                    yield out(held[1][own], held[1][own], True)
                held = [h[~own] for h in held]
                if not len(held[0]):
                    continue
                large = None
            last = np.searchsorted(held[0], held[0][-1])
            if last:
                yield from solve(*(h[:last] for h in held))
                held = [h[last:] for h in held]
            if len(held[0]) > cell_limit:
                large = held[0][0]
                yield out(held[1], held[1], True)
                held = [h[:0] for h in held]
        if len(held[0]):
            yield from solve(*held)

    found = cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(link, "a long, b long, spilled boolean")
    found = written(found, "links")
    edges = found.where("not spilled").select("a", "b")
    spilled = found.where("spilled").select(F.col("a").alias("fp")).distinct()
    return edges.unionByName(midpoint_links(spilled, bits)).distinct()


def midpoint_links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Edges that connect fingerprints within ``bits``: each to the smallest that shares a word within ``bits / 2`` of both."""
    ones = [1 << k for k in range(64)]
    flips = [0, *(sum(c) for r in range(1, (bits + 1) // 2 + 1) for c in itertools.combinations(ones, r))]
    signed = [f - (1 << 64) if f >> 63 else f for f in flips]
    middles = fps.select("fp", F.explode(F.lit(signed)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    least = middles.groupBy("middle").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    return middles.join(least, "middle").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def classes(rows: DataFrame, bits: int = MAX_BITS, groups: int | None = None, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """fp and root, the smallest fingerprint of its component, of all fingerprints in ``rows`` (id, fp)."""
    nodes = written(rows.select("fp").distinct(), "distinct-fingerprints")
    edges = links(nodes, groups or grid_groups(nodes.count()), bits, cell_limit)
    roots = written(components(edges), "roots")
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = MAX_BITS, groups: int | None = None, cell_limit: int = CELL_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 lowercase hex digits) and component_id (the smallest id of the component) for every row."""
    rows = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    linked = classes(rows, bits, groups, cell_limit).join(rows.groupBy("fp").agg(F.min("id").alias("least")), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, all columns, from each component: that with the smallest id (null is the largest).

    Where ids repeat, rows of a component with the same smallest id are told apart by their columns, and the first stays.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    rows = written(fingerprints(docs.select(key.alias("tidemark_key_"), F.col(text_col).alias("tidemark_text_")), words, "tidemark_key_", "tidemark_text_"), "fingerprints")
    chosen = rows.join(classes(rows, bits), "fp").groupBy("root").agg(F.min("id").alias("tidemark_key_"))
    if not rows.groupBy("id").count().where("count > 1").limit(1).count():
        return docs.withColumn("tidemark_key_", key).join(chosen.select("tidemark_key_"), "tidemark_key_").select(*docs.columns)
    roots = classes(rows, bits).withColumnRenamed("fp", "tidemark_fp_").withColumnRenamed("root", "tidemark_root_")
    kept = _with_fingerprint(docs, words, text_col).withColumn("tidemark_key_", key).join(roots, "tidemark_fp_").join(chosen.withColumnRenamed("root", "tidemark_root_"), ["tidemark_root_", "tidemark_key_"])
    order = Window.partitionBy("tidemark_root_", "tidemark_key_").orderBy(F.xxhash64(utf8(text_col)), F.to_json(F.struct(*docs.columns)))
    return kept.withColumn("tidemark_row_", F.row_number().over(order)).where("tidemark_row_ = 1").select(*docs.columns)


def named(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id (null as the largest number), node (the text's words), fp, bands (keys; none of a text without words), n (shingles of the set), first (its prefix) and marks of every row."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    own = docs.select(key.alias("id"), utf8(text_col).alias("bytes"))
    sent = docs.sparkSession.sparkContext.broadcast(prefixes.order_of(docs, words, text_col))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_module.release()  # another run's packing may have left its memo
        order = sent.value
        for batch in batches:
            for part in sliced(batch, "bytes", 2 << 20):
                texts = part.column(1).to_pylist()
                nodes = [jaccard.node_of(jaccard.words_of(t)) for t in texts]
                hashes, n, which = shingle_hashes(texts, words)
                prints, sizes, keys = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
                count, first, marks = np.zeros(len(texts), np.int64), [b""] * len(texts), [b""] * len(texts)
                if which:
                    prints[which], sizes[which] = _majorities(hashes, n), bands.BANDS
                    keys = bands.keys_of(np.frombuffer(hashes, ">u8").astype(np.uint64), n).ravel().view(np.int64)
                    for i, own in zip(which, np.split(np.frombuffer(hashes, np.int64), np.cumsum(n)[:-1])):
                        own = np.unique(own)
                        count[i], first[i], marks[i] = len(own), order.first(own).tobytes(), prefixes.marks_of(own)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys))
                columns = [part.column(0), pa.array(nodes, pa.int64()), pa.array(prints.view(np.int64)), lists, pa.array(count), pa.array(first, pa.binary()), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "node", "fp", "bands", "n", "first", "marks"])

    return own.mapInArrow(compute, "id long, node long, fp long, bands array<long>, n long, first binary, marks binary")


def near_pairs(nodes: DataFrame, bits: int = MAX_BITS, groups: int | None = None, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) that the grid finds within ``bits``: least nodes of linked fingerprints, and equal ones with their least."""
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    edges = links(prints.select("fp"), groups or grid_groups(prints.count()), bits, cell_limit)
    same = nodes.join(prints.where("n > 1"), "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    for side in ("a", "b"):
        edges = edges.join(prints.select(F.col("fp").alias(side), F.col("least").alias(f"least_{side}")), side)
    return same.unionByName(edges.select(F.col("least_a").alias("a"), F.col("least_b").alias("b")))


def similar_links(docs: DataFrame, rows: DataFrame, words: int = jaccard.SHINGLE_WORDS, bits: int = MAX_BITS, text_col: str = "text", groups: int | None = None, cell_limit: int = CELL_LIMIT, block: int = prefixes.BLOCK) -> DataFrame:
    """Links (a, b) between nodes of ``rows`` (written by ``named``) that keep the components of all pairs of similarity 0.8.

    Candidates from the grid and from bands are checked exactly and join most of what belongs together.  All other pairs of
    similarity 0.8 lie between the components so found; the prefix filter puts both texts of each in one neighbourhood, and
    within those all sets are compared.
    """
    nodes = written(rows.select("node", "fp", "bands", "marks").dropDuplicates(["node"]), "nodes")
    proposed = bands.to_leaders(bands.entries(nodes)).select(F.col("node").alias("a"), F.col("other").alias("b"))
    pairs = written(_ordered(near_pairs(nodes.select("node", "fp"), bits, groups, cell_limit).unionByName(proposed)), "pairs")
    good = written(jaccard.checked(pairs, jaccard.sets(docs, pairs, words, text_col)), "good-pairs")
    roots = written(components(good), "roots")
    firsts = rows.select("node", "n", "first").dropDuplicates(["node"]).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = written(prefixes.neighbours(firsts, nodes, parallelism(docs), block), "rest-pairs")
    groups = written(components(rest), "neighbourhoods")
    return good.unionByName(prefixes.links(groups, roots, jaccard.sets(docs, rest, words, text_col), parallelism(docs), block))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_representatives(docs: DataFrame, words: int = jaccard.SHINGLE_WORDS, bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, all columns, from each group of texts linked by sets of shingles with Jaccard similarity 0.8.

    No radius of a 64-bit fingerprint that the grid can search is sure to hold all pairs of similarity 0.8, so bands of minima
    propose pairs beside it, fingerprints sift them (module ``bands``), and an exact search finds the rest (module ``prefixes``).
    """
    rows = written(named(docs, words, id_col, text_col), "fingerprints")
    edges = written(similar_links(docs, rows, words, bits, text_col), "similar-links")
    return jaccard.kept(docs, rows.select("id", "node"), written(components(edges), "roots"), id_col, text_col)


def _with_fingerprint(docs: DataFrame, words: int, text_col: str) -> DataFrame:
    """``docs`` with the column tidemark_fp_."""
    place, schema = docs.columns.index(text_col), StructType([*docs.schema.fields, StructField("tidemark_fp_", LongType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fingerprint_texts(texts, words).view(np.int64))], [*batch.schema.names, "tidemark_fp_"])

    return docs.mapInArrow(compute, schema)


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fingerprints and components of all documents."""
    return near_duplicates(documents(spark, sf_dir))
