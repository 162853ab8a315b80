"""Links for all pairs of texts whose sets of shingles have Jaccard similarity 0.8 and that aren't linked yet: prefix filter, bounds, no pair missed.

1. All sets are put into one order.  Sets of n shingles with similarity 4/5 share one at least of their first
   n - ceil(4n/5) + 1, so they meet in that shingle's cell.  Shingles that are frequent in a sample come last in the order,
   so that they seldom make a cell; the sample decides about the work only, as any order is right.
2. Of two sets of a cell, sizes and places of the common shingle bound the overlap; a pair that can't reach
   9 * overlap >= 4 * (n + m), which is similarity 4/5, is left out.
3. Texts of one component of the links known before are never compared, so a cluster of near copies costs no pairs.  A cell
   of over ``BLOCK`` texts is dealt over tasks in pairs of blocks; each pair of its texts is compared in one of them.
4. Only cells that hold texts of several components go on, and only their texts send their marks: the parity of their
   shingles in each of about as many buckets as the set has shingles.  The bits in which two marks differ are at most the
   shingles in which the sets differ, which are (n + m) / 9 at most at similarity 4/5, so a pair whose marks differ in more
   is left out.
5. What is left isn't written pair by pair: a cell gives each text that has such a partner one row, which names the least text
   that its pairs reach there.  So rows grow with texts and never with pairs.  Both texts of every pair of similarity 4/5
   are in one component of these rows, a neighbourhood.
6. Each text of a neighbourhood sends its set once (to one task; a neighbourhood of over ``BLOCK`` texts or ``BLOCK_SHINGLES``
   shingles is dealt in pairs of blocks).  The task compares sets exactly, and only those whose components aren't linked yet,
   so what it gives is fewer links than it has texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import jaccard
from tidemark.llm.common import sliced, utf8, written

SAMPLE_TEXTS = 10_000  # for the order of shingles
MOST_FREQUENT = 1 << 18  # shingles that are moved to the order's end
FLAG_BITS = 22
SLICE_BYTES = 2 << 20
BLOCK = 4096
BLOCK_SHINGLES = 1 << 21  # 16 MB of sets
HELD_PAIRS = 1 << 16
LEAST_MARK, MOST_MARK = 6, 13  # bits as powers of two; marks of sets over 18,000 shingles leave out little


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1 if n else 0


class Order:
    """The order of shingles: by number, those of ``late`` behind all others."""

    def __init__(self, late: np.ndarray):
        by = np.argsort(late)
        self.hashes, self.ranks = late[by], by + 1
        self.flags = np.zeros(1 << FLAG_BITS, bool)
        self.flags[late & (1 << FLAG_BITS) - 1] = True

    def first(self, found: np.ndarray) -> np.ndarray:
        """The prefix of a set (sorted shingles)."""
        some = np.flatnonzero(self.flags[found & (1 << FLAG_BITS) - 1])
        if len(some):
            own = found[some]
            at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            rank = np.zeros(len(found), np.int64)
            rank[some] = np.where(self.hashes[at] == own, self.ranks[at], 0)
            found = found[np.argsort(rank, kind="stable")]
        return found[: prefix_length(len(found))]


def marks_of(found: np.ndarray) -> bytes:
    """The parity of a set's shingles in each of its buckets; half of a longer mark, added to the other, is the shorter one."""
    n = len(found)
    if not n:
        return b""
    bits = 1 << min(max(round(math.log2(n)), LEAST_MARK), MOST_MARK)
    return np.packbits((np.bincount(found & (bits - 1), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


class Marks:
    """The marks of rows, by width, and which pairs of rows they leave."""

    def __init__(self, marks: list[bytes]):
        self.width = np.fromiter(map(len, marks), np.int64, len(marks))
        self.place, self.rows = np.zeros(len(marks), np.int64), {}
        for width in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == width)
            self.place[own] = np.arange(len(own))
            self.rows[width] = np.frombuffer(b"".join([marks[i] for i in own.tolist()]), np.uint64).reshape(len(own), width // 8)

    def near(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether rows i and j may have similarity 4/5; their numbers of shingles differ by a quarter at most."""
        apart = np.zeros(len(i), np.int64)
        wide, narrow = np.maximum(self.width[i], self.width[j]), np.minimum(self.width[i], self.width[j])
        for width in np.unique(wide).tolist():
            for other in (width, width // 2):
                chosen = np.flatnonzero((wide == width) & (narrow == other))
                if not len(chosen):
                    continue
                a, b = (np.where(self.width[x[chosen]] == w, x[chosen], y[chosen]) for w, x, y in ((width, i, j), (other, j, i)))
                first, second = self.rows[width][self.place[a]], self.rows[other][self.place[b]]
                if other != width:
                    first = first[:, : other // 8] ^ first[:, other // 8 :]
                apart[chosen] = np.bitwise_count(first ^ second).sum(axis=1, dtype=np.int64)
        return 9 * apart <= (size[i] >> 32) + (size[j] >> 32)


def order_of(docs: DataFrame, words: int, text_col: str) -> Order:
    """The order that puts shingles in several texts of a sample last, the most frequent at the end."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "bytes", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([jaccard.shingles(jaccard.words_of(t), words) for t in part.column(0).to_pylist()]))], ["shingle"])

    share = min(1.0, SAMPLE_TEXTS / max(docs.count(), 1))
    sample = docs.select(utf8(text_col).alias("bytes")).where(F.pmod(F.xxhash64("bytes"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = sample.mapInArrow(compute, "shingle long").groupBy("shingle").count().where("count > 2")
    most = found.orderBy(F.desc("count"), "shingle").limit(MOST_FREQUENT).toArrow()  # 4 MB at most
    return Order(most.column("shingle").to_numpy()[::-1].copy())


def cells_of(rows: DataFrame) -> DataFrame:
    """cell, node, size (n in the upper half, the shingle's place in the lower) and root for each shingle of a prefix."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "first", SLICE_BYTES):
                count = np.array([len(f) >> 3 for f in part.column("first").to_pylist()], np.int64)
                cell = np.frombuffer(b"".join(part.column("first").to_pylist()), np.int64)
                place = np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
                columns = [cell, np.repeat(np.asarray(part.column("node")), count), np.repeat(np.asarray(part.column("n")) << 32, count) + place, np.repeat(np.asarray(part.column("root")), count)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cell", "node", "size", "root"])

    return rows.select("node", "n", "first", "root").mapInArrow(spread, "cell long, node long, size long, root long")


def possible(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes with a common shingle at these places may have similarity 4/5."""
    n, m, i, j = s >> 32, t >> 32, s & 0xFFFFFFFF, t & 0xFFFFFFFF
    return 9 * (np.minimum(i, j) + np.minimum(n - i, m - j)) >= 4 * (n + m)


def _whole_cells(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, so cut that no cell (the first column) is in two pieces."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        new = [np.asarray(batch.column(c)) for c in names]
        if not len(new[0]):
            continue
        last = int(np.searchsorted(new[0], new[0][-1]))
        if held and (last or held[-1][0][-1] != new[0][0]):
            yield [np.concatenate([*(h[c] for h in held), new[c][:last]]) for c in range(len(names))]
            held = []
        elif last:
            yield [c[:last] for c in new]
        held.append([c[last:] for c in new])
    if held:
        yield [np.concatenate([h[c] for h in held]) for c in range(len(names))]


MEMBERS = "cell long, node long, size long, root long, large boolean"
LINKS = "a long, b long"


def _across(size: np.ndarray, root: np.ndarray, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Possible pairs (places) of a cell's texts (sorted by size) of different components; of different sides only, where given."""
    a, b, held = [], [], 0
    n = size >> 32
    ends = np.searchsorted(n, 5 * n // 4, "right")  # no larger set can reach 4/5
    for k, end in enumerate(ends.tolist()):
        other = slice(k + 1, end)
        near = (root[other] != root[k]) & possible(size[other], size[k])
        if side is not None:
            near &= side[other] != side[k]
        near = np.flatnonzero(near) + k + 1
        if len(near):
            a.append(np.full(len(near), k))
            b.append(near)
            held += len(near)
        if held > HELD_PAIRS:
            yield np.concatenate(a), np.concatenate(b)
            a, b, held = [], [], 0
    if held:
        yield np.concatenate(a), np.concatenate(b)


def _beside(cell: np.ndarray, size: np.ndarray, root: np.ndarray, few: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Possible pairs (places) of different components in cells of at most eight texts (flag ``few``)."""
    for step in range(1, 8):
        near = np.flatnonzero(few[step:] & (cell[step:] == cell[:-step]) & (root[step:] != root[:-step]))
        near = near[possible(size[near + step], size[near])]
        if len(near):
            yield near, near + step


def _cells(cell: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where cells begin, how many texts they have, and whether of several components."""
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    return first, np.diff(np.append(first, len(cell))), np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)


def members(rows: DataFrame, parts: int, block: int = BLOCK) -> DataFrame:
    """(cell, node, size, root, large): texts of cells that hold several components; in small cells only those with a possible partner."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, node, size, root in _whole_cells(batches, ["cell", "node", "size", "root"]):
            _, count, mixed = _cells(cell, root)
            stays = np.repeat(mixed & (count > 8), count)
            for a, b in _beside(cell, size, root, np.repeat(mixed & (count <= 8), count)):
                stays[a] = stays[b] = True
            columns = [cell[stays], node[stays], size[stays], root[stays], np.repeat(count > block, count)[stays]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "node", "size", "root", "large"])

    return cells_of(rows).repartition(parts, "cell").sortWithinPartitions("cell", "size", "node").mapInArrow(meet, MEMBERS)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all places that pairs (a, b) connect the least label among them; ``label`` names places and is changed."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def _dealt(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """``rows`` (with a number of blocks) as task, mine, lone and columns: each text once for each block that its own one meets."""
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    task = F.xxhash64(key, F.least("mine", "with"), F.greatest("mine", "with"))
    return rows.select(task.alias("task"), *columns, "mine", (F.col("mine") == F.col("with")).cast("long").alias("lone"))


def neighbours(rows: DataFrame, marks: DataFrame, parts: int, block: int = BLOCK) -> DataFrame:
    """Rows (a, b) from rows (node, n, first, root) and marks (node, marks), one a node each: every pair of similarity 4/5 and different roots is in one component of them."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, node, size, root, mine, lone, marks in _whole_cells(batches, ["task", "node", "size", "root", "mine", "lone", "marks"]):
            known, least = Marks(marks.tolist()), np.arange(len(task))

            def reach(label: np.ndarray, f: int, a: np.ndarray, b: np.ndarray) -> None:
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                near = known.near(a + f, b + f, size)
                _merge(label, a[near], b[near])

            first, count, _ = _cells(task, root)
            alone = lone[first] == 1
            for a, b in _beside(task, size, root, np.repeat(alone & (count <= 8), count)):
                reach(least, 0, a, b)
            rest = ~alone | (count > 8)
            for f, n in zip(first[rest].tolist(), count[rest].tolist()):
                own, label = slice(f, f + n), np.arange(n)
                for a, b in _across(size[own], root[own], None if lone[f] else mine[own]):
                    reach(label, f, a, b)
                least[own] = label + f
            found = np.flatnonzero(least != np.arange(len(least)))
            yield pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(node[least[found]])], ["a", "b"])

    found = written(members(rows, parts, block), "met")
    small, large = found.where("not large"), found.where("large")
    zero = F.lit(0).cast("long")
    dealt = small.select(F.col("cell").alias("task"), "node", "size", "root", zero.alias("mine"), (zero + 1).alias("lone"))
    if large.limit(1).count():
        large = large.join(large.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("blocks")), "cell")
        dealt = dealt.unionByName(_dealt(large, "cell", "node", "size", "root"))
    dealt = dealt.join(marks.select("node", "marks"), "node").select("task", "node", "size", "root", "mine", "lone", "marks")
    return dealt.repartition(parts, "task").sortWithinPartitions("task", "size", "node").mapInArrow(compare, LINKS).distinct()


def _linked(size: np.ndarray, root: np.ndarray, own: list[bytes], side: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Pairs (places) of similarity 4/5 that connect the components of texts (sorted by size) as all such pairs do; of different sides only, where given."""
    n, label, a, b = size >> 32, root.copy(), [], []
    if (label == label[0]).all():
        return a, b
    known, bounds = Marks([marks_of(np.frombuffer(x, np.int64)) for x in own]), np.append(0, np.cumsum(n))
    names, shingle = np.unique(np.frombuffer(b"".join(own), np.int64), return_inverse=True)
    held = np.zeros(len(names), bool)
    ends = np.searchsorted(n, 5 * n // 4, "right")  # no larger set can reach 4/5
    for k, end in enumerate(ends.tolist()):
        fits = label[k + 1 : end] != label[k]
        if side is not None:
            fits &= side[k + 1 : end] != side[k]
        other = np.flatnonzero(fits) + k + 1
        other = other[known.near(np.full(len(other), k), other, size)]
        if not len(other):
            continue
        mine = shingle[bounds[k] : bounds[k + 1]]
        held[mine] = True
        if bounds[end] - bounds[k + 1] < 2000 * len(other):
            both = np.add.reduceat(held[shingle[bounds[k + 1] : bounds[end]]], bounds[k + 1 : end] - bounds[k + 1], dtype=np.int64)[other - k - 1]
        else:
            both = np.array([np.count_nonzero(held[shingle[bounds[c] : bounds[c + 1]]]) for c in other.tolist()])
        held[mine] = False
        good = other[9 * both >= 4 * (n[k] + n[other])]
        if len(good):
            met, at = np.unique(label[good], return_index=True)
            a += [k] * len(at)
            b += good[at].tolist()
            label[np.isin(label, met)] = label[k]
    return a, b


def links(groups: DataFrame, roots: DataFrame, sets: DataFrame, parts: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of similarity 4/5 that connect different roots (node, root) as all such pairs within neighbourhoods do.

    groups: node and root, here the name of its neighbourhood; sets: node and own, its shingles.  Nodes without a root are their own.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, node, size, root, own, mine, lone in _whole_cells(batches, ["task", "node", "size", "root", "own", "mine", "lone"]):
            first, count, mixed = _cells(task, root)
            for f, n in zip(first[mixed].tolist(), count[mixed].tolist()):
                part = slice(f, f + n)
                a, b = _linked(size[part], root[part], own[part].tolist(), None if lone[f] else mine[part])
                yield pa.RecordBatch.from_arrays([pa.array(node[f + np.array(x, np.int64)]) for x in (a, b)], ["a", "b"])

    rows = groups.withColumnRenamed("root", "group").join(sets, "node").join(roots, "node", "left")
    rows = rows.select("group", "node", F.shiftleft((F.length("own") / 8).cast("long"), 32).alias("size"), F.coalesce("root", "node").alias("root"), "own")
    n = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.shiftright("size", 32)) / BLOCK_SHINGLES))
    rows = _dealt(rows.join(rows.groupBy("group").agg(n.alias("blocks")), "group"), "group", "node", "size", "root", "own")
    return rows.repartition(parts, "task").sortWithinPartitions("task", "size", "node").mapInArrow(link, LINKS)
