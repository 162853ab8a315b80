"""Suffix-array dedup: common-prefix-aware distributed merge sort of sampled suffixes.

Removes every byte covered by a ``window``-byte string (400) that starts anywhere else too, documents and positions alike.

Sampling.  Each window has an anchor: the place, among those from which half a window still lies inside, whose 8-byte hash is
least (the first such).  It depends on the window's bytes alone, so equal windows have equal anchors at equal depths.  The
starts that share an anchor are an interval, and their windows lie in one stretch of text around it.  Only suffixes at
anchors are sorted, about one in 100, and nothing is lost: two equal windows meet at their anchors.

Filter.  Spark counts stretches by the hash of their anchor's half window; one whose half window occurs once can't repeat and
goes first, before anything wide is shuffled.  A stretch that has company in its own slice of text is known to repeat and
skips that join, so a passage that a third of all texts share is no hot key of it.  Of equal stretches (by a second hash, of
the content) one stands for all, with their number, so copies, however many, are one string.

Sort.  Each task cuts its stretches, sorts the suffixes from the anchor on into runs, and sends them front-coded (length of
the common prefix with the one before, and the rest) to the task of their range.  There a loser tree merges the runs: it
keeps for every contender its common prefix with the last winner, so bytes known to be equal are never compared again, and
yields the merged order with the common prefixes of neighbours.  Ranges are cut at half windows, so those that share an
anchor's half window stay together.

Match.  Suffixes with a common half window form a group.  A start l bytes before the anchor repeats iff another member has
the same l bytes to the left and the same rest to the right: the right side comes from the common prefixes of the merge, the
left from comparing reversed left contexts.  An anchor with more than ``HOT`` different stretches is not brought to one task:
its windows are compared by their 128-bit digests, summed before they meet.

Two lengths.  ``removals`` looks for windows of ``PASSAGE`` bytes first, which gives the passages that repeat (n_repeated), and
then for the longer windows, whose bytes it removes, in passages that are as long as those: a long window that repeats lies in
one.

Null text is empty.  Texts shorter than a window lose nothing.  Repeated rows are copies of each other.  Rows are told apart
by doc_id (null is a value) and the hash of their text.
"""

from __future__ import annotations

import bisect
import gc
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import buffer_of, documents, forget, parallelism, sliced, utf8, written

WINDOW = 400
PASSAGE = 256  # bytes: 50 words of English and the like have about 300
HOT = 4096
PIECE = 2 << 20
RUN_BYTES = 48 << 20
SPLITTER_ROWS = 2000  # texts at least, and SPLITTER_PART for each range, from which the sort's ranges are guessed
SPLITTER_PART = 4
SPLITTER_BYTES = 48  # of a string that cuts two ranges
_ODD = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and their inverses."""
    inverse = pow(_ODD, -1, 1 << 64)
    up, down = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, x, _U)])) for x in (_ODD, inverse))
    return up, down


_TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * _U(2) + _U(1)
_KEPT: list[tuple[np.ndarray, np.ndarray]] = []


def stretches(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Of texts side by side: text number, position (see ``_pack``), hash of the anchor's half window, hash of the stretch."""
    half, span = window // 2, window - window // 2 + 1
    n = len(data)
    first, last = offsets[:-1], offsets[1:] - window
    number = np.maximum(last - first + 1, 0)
    none = np.zeros(0, np.int64)
    if not number.sum():
        return none, none, none, none
    if not _KEPT or len(_KEPT[0][0]) <= n:
        _KEPT[:] = [_powers(max(n, PIECE + WINDOW))]
    up, down = _KEPT[0]
    padded = np.concatenate([data, np.zeros(8 + span, np.uint8)])
    eight = np.ndarray((n,), "<u8", padded.tobytes(), strides=(1,))
    blocks = -(-n // span) + 1
    value = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    value[:n] = (eight * _U(_ODD)) & _U(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
    grid = value.reshape(-1, span)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.repeat(first - (np.cumsum(number) - number), number) + np.arange(number.sum())
    anchor = (np.minimum(after[starts], before[starts + span - 1]) & _U(0xFFFFFFFF)).astype(np.int64)
    begin = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    end = np.append(begin[1:], len(anchor)) - 1
    a, s1, s2 = anchor[begin], starts[begin], starts[end]
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_TABLE[data] * up[:n])])
    key = (sums[a + half] - sums[a]) * down[a]
    whole = (sums[s2 + window] - sums[s1]) * down[s1]
    text = np.searchsorted(offsets, s1, "right") - 1
    whole = (whole ^ (whole >> _U(29))) * _U(0xBF58476D1CE4E5B9) + ((a - s1) * 1024 + s2 - s1).astype(np.uint64) * _U(0x94D049BB133111EB)
    return text, _pack(s1 - offsets[text], a - s1, s2 - s1), (key ^ (key >> _U(31))).view(np.int64), (whole ^ (whole >> _U(27))).view(np.int64)


def _pack(s1, depth, more):
    """First start of a stretch, depth of its anchor there, and how many starts follow, in one number."""
    return (s1 << 20) | (depth << 10) | more


def _unpack(pos):
    return pos >> 20, (pos >> 10) & 1023, pos & 1023


def _pieces(offsets: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, int, int, int]]:
    """Texts of a batch as (offsets, first text, its first byte, base): a longer text in overlapping pieces of its own."""
    if len(offsets) == 2 and offsets[1] > PIECE + window:
        for at in range(0, int(offsets[1]) - window + 1, PIECE):
            end = min(int(offsets[1]), at + PIECE + window - 1)
            yield np.array([0, end - at]), 0, at, at
    else:
        yield offsets, 0, 0, 0


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """did, th and bytes: what tells rows apart, and the text."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("did"), utf8(text_col).alias("bytes"))
    return rows.select("did", F.xxhash64("bytes").alias("th"), "bytes")


def anchored(rows: DataFrame, window: int) -> DataFrame:
    """key, fp, did, th, pos of every stretch, and whether its key is known to occur twice."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "bytes", PIECE):
                data, offsets = buffer_of(part.column("bytes"))
                did, th = np.asarray(part.column("did")), np.asarray(part.column("th"))
                for own, _, at, base in _pieces(offsets, window):
                    text, pos, key, fp = stretches(data[at : at + int(own[-1])], own, window)
                    _, which, n = np.unique(key, return_inverse=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, fp, did[text], th[text], pos + (base << 20), n[which] > 1)], ["key", "fp", "did", "th", "pos", "known"])

    return rows.mapInArrow(find, "key long, fp long, did long, th long, pos long, known boolean")


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are known to be equal."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of (string, common prefix with the one before in its run) without comparing known prefixes again.

    Every contender carries the length of its common prefix with the last winner.  Of two, the one that shares more with the
    last winner comes first, without a look at the strings; at equal lengths comparison starts behind them.
    """

    def __init__(self, runs: list[list[tuple[bytes, int]]]):
        self.runs = runs
        k = 1
        while k < max(1, len(runs)):
            k *= 2
        self.k = k
        self.place = [0] * k
        self.text: list[bytes | None] = [runs[r][0][0] if r < len(runs) and runs[r] else None for r in range(k)]
        self.shared = [0] * k
        self.tree = [0] * k
        win = list(range(k))
        level = k
        nodes = [*([0] * k), *win]
        while level > 1:
            for node in range(level // 2, level):
                nodes[node], self.tree[node] = self._play(nodes[2 * node], nodes[2 * node + 1])
            level //= 2
        self.top = nodes[1] if k > 1 else 0

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's common prefix becomes that with the winner."""
        x, y = self.text[a], self.text[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = self.shared[a], self.shared[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        p = common_prefix(x, y, p)
        if len(x) == p or (len(y) > p and x[p] < y[p]):
            self.shared[b] = p
            return a, b
        self.shared[a] = p
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(run, place in it, common prefix with the string before) in merged order."""
        text, shared, place, tree, play = self.text, self.shared, self.place, self.tree, self._play
        while text[self.top] is not None:
            r = self.top
            yield r, place[r], shared[r]
            place[r] += 1
            if place[r] < len(self.runs[r]):
                text[r], shared[r] = self.runs[r][place[r]]
            else:
                text[r] = None
            node, winner = (self.k + r) // 2, r
            while node:
                winner, tree[node] = play(winner, tree[node])
                node //= 2
            self.top = winner


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Common prefixes with the string before, and the rests."""
    shared = np.zeros(len(strings), np.uint16)
    rests = list(strings[:1])
    for i, (a, b) in enumerate(itertools.pairwise(strings), 1):
        p = len(b) if a == b else common_prefix(a, b)
        shared[i] = p
        rests.append(b[p:])
    return shared, rests


def repeated(rights: list[bytes], shared: list[int], lefts: list[bytes], many: list[bool], window: int) -> list[list[tuple[int, int]]]:
    """Of a group in merged order: for each member the depths (first, last) at which its windows repeat.

    rights: from the anchor on; shared: common prefix with the member before; lefts: reversed, from the anchor back.
    """
    n = len(rights)
    found: list[list[tuple[int, int]]] = [[(window - len(r), len(f))] if m else [] for r, f, m in zip(rights, lefts, many)]
    if n <= 48:
        for i in range(n - 1):
            right = window
            for j in range(i + 1, n):
                right = min(right, shared[j])
                left = common_prefix(lefts[i], lefts[j])
                if window - right <= left:
                    found[i].append((window - right, left))
                    found[j].append((window - right, left))
        return found
    order = sorted(range(n), key=lefts.__getitem__)
    by_left = np.array([0, *(common_prefix(lefts[a], lefts[b]) for a, b in itertools.pairwise(order))])
    ordered, right = np.array(order), np.array(shared)
    low, high = np.array([window - len(r) for r in rights]), np.array([len(f) for f in lefts])
    hit = np.zeros((n, int(high.max()) + 2), bool)
    class_of = np.zeros(n, np.int64)
    for depth in range(int(low.min()), int(high.max()) + 1):
        class_of[ordered] = np.cumsum(by_left < depth)
        own = np.flatnonzero((low <= depth) & (depth <= high))
        both = np.cumsum(right < window - depth)[own] * (n + 1) + class_of[own]
        _, which, count = np.unique(both, return_inverse=True, return_counts=True)
        hit[own[count[which] > 1], depth] = True
    edges = np.diff(hit.astype(np.int8), axis=1, prepend=0)
    for i, depth in zip(*np.nonzero(edges == 1)):
        stop = depth + int(np.argmin(hit[i, depth:])) - 1
        found[i].append((int(depth), stop))
    return found


def _cut(column: bytes, pos: int, window: int) -> tuple[bytes, bytes]:
    """Right side from the anchor on, and reversed left side, of a stretch."""
    s1, depth, more = _unpack(pos)
    a = s1 + depth
    return column[a : s1 + more + window], column[s1:a][::-1]


def splitters(rows: DataFrame, parts: int, window: int) -> list[bytes]:
    """Half windows that cut the sort's strings into ``parts`` ranges of like size."""
    # A few texts for each range, by hash, without a sort; equal texts share a hash, so a limit bounds what copies can add.
    most = max(SPLITTER_ROWS, SPLITTER_PART * parts)
    every = max(1, rows.count() // most)
    sample = rows.where(F.octet_length("bytes").between(window, PIECE) & (F.pmod(F.xxhash64("did", "th"), F.lit(every)) == 0)).select("bytes").limit(4 * most)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "bytes", PIECE):
                data, offsets = buffer_of(part.column("bytes"))
                text, pos, _, _ = stretches(data, offsets, window)
                s1, depth, _ = _unpack(pos)
                at = (offsets[text] + s1 + depth)[::16].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([data[a : a + min(SPLITTER_BYTES, window // 2)].tobytes() for a in at], pa.binary())], ["first"])

    found = sorted(bytes(r["first"]) for r in sample.mapInArrow(firsts, "first binary").collect())
    return sorted({found[len(found) * k // parts] for k in range(1, parts)}) if found else []


def sorted_runs(items: DataFrame, cuts: list[bytes], window: int) -> DataFrame:
    """Front-coded slices of sorted runs, by range.  items: bytes and an array of (key, fp, n, pos) of each text."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run = TaskContext.get().partitionId() << 20
        held: list[tuple] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: x[:2])
            heads = [h[0][: window // 2] for h in held]
            edges = [0, *(bisect.bisect_left(heads, c) for c in cuts), len(held)]
            for target, (b, e) in enumerate(itertools.pairwise(edges)):
                if b == e:
                    continue
                shared, rests = front_coded([h[0] for h in held[b:e]])
                columns = [
                    [target], [run], [shared.tobytes()], [np.array([len(r) for r in rests], np.uint16).tobytes()], [b"".join(rests)],
                    [np.array([len(h[1]) for h in held[b:e]], np.uint16).tobytes()], [b"".join(h[1] for h in held[b:e])],
                    [np.array([h[2:5] for h in held[b:e]], np.int64).tobytes()],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        for batch in batches:
            for text, own in zip(batch.column("bytes").to_pylist(), batch.column("own").to_pylist()):
                for x in own:
                    right, left = _cut(text, x["pos"], window)
                    held.append((right, left, x["key"], x["fp"], x["n"]))
                    size += len(right) + len(left) + 200
                if size > RUN_BYTES:
                    yield from out()
                    held, size, run = [], 0, run + 1
        yield from out()

    names = ["target", "run", "shared", "rest_n", "rests", "left_n", "lefts", "numbers"]
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 6)
    return items.mapInArrow(runs, "target int, run long, shared binary, rest_n binary, rests binary, left_n binary, lefts binary, numbers binary")


def merged(slices: DataFrame, parts: int, window: int) -> DataFrame:
    """key, fp and the depths (low, high) at which a stretch's windows repeat."""

    def decode(row: dict) -> tuple[list[tuple[bytes, int]], list[bytes], np.ndarray]:
        shared, n, left_n = (np.frombuffer(row[c], np.uint16).tolist() for c in ("shared", "rest_n", "left_n"))
        strings, last, at, lefts, to = [], b"", 0, [], 0
        for p, k, f in zip(shared, n, left_n):
            last = last[:p] + row["rests"][at : at + k]
            strings.append((last, p))
            at += k
            lefts.append(row["lefts"][to : to + f])
            to += f
        return strings, lefts, np.frombuffer(row["numbers"], np.int64).reshape(-1, 3)

    def solve(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r["run"])
        runs, lefts, numbers = zip(*map(decode, rows))
        out: list[tuple[int, int, list[int], list[int]]] = []
        group: list[tuple[int, int, int]] = []

        def close() -> None:
            if len(group) == 1 and numbers[group[0][0]][group[0][1]][2] < 2:
                return
            many = [bool(numbers[r][i][2] > 1) for r, i, _ in group]
            found = repeated([runs[r][i][0] for r, i, _ in group], [p for _, _, p in group], [lefts[r][i] for r, i, _ in group], many, window)
            for (r, i, _), spans in zip(group, found):
                if spans:
                    key, fp, _ = numbers[r][i].tolist()
                    low, high = zip(*sorted(set(spans)))
                    out.append((key, fp, list(low), list(high)))

        for r, i, p in LoserTree(list(runs)):
            if p < window // 2 and group:
                close()
                group = []
            group.append((r, i, p))
        if group:
            close()
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))], ["key", "fp", "low", "high"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["target"] != row["target"]:
                    yield from solve(held)
                    held = []
                held.append(row)
        if held:
            yield from solve(held)

    return slices.repartition(parts, "target").sortWithinPartitions("target").mapInArrow(merge, "key long, fp long, low array<int>, high array<int>")


def hot_matches(items: DataFrame, window: int) -> DataFrame:
    """As ``merged``, for stretches whose anchor has too many different ones: windows compared by digest."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, own in zip(batch.column("bytes").to_pylist(), batch.column("own").to_pylist()):
                for x in own:
                    s1, depth, more = _unpack(x["pos"])
                    raw = b"".join(xxhash.xxh3_128_digest(text[s : s + window]) for s in range(s1, s1 + more + 1))
                    h = np.frombuffer(raw, np.int64).reshape(-1, 2)
                    n = more + 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array([x["key"]] * n, pa.int64()), pa.array([x["fp"]] * n, pa.int64()), pa.array(range(depth, depth - n, -1), pa.int32()), pa.array([x["n"]] * n, pa.int64())], ["h1", "h2", "key", "fp", "depth", "n"])

    rows = written(items.mapInArrow(digests, "h1 long, h2 long, key long, fp long, depth int, n long"), "hot-windows")
    twice = rows.groupBy("h1", "h2").agg(F.sum("n").alias("all")).where("all > 1").select("h1", "h2")
    depths = rows.join(twice, ["h1", "h2"]).groupBy("key", "fp").agg(F.array_sort(F.collect_set("depth")).alias("low"))
    return depths.select("key", "fp", "low", F.col("low").alias("high"))


def spans(docs: DataFrame, window: int = WINDOW, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """did, th and own, the byte ranges (low, high) covered by repeated windows, of every text that has one."""
    spark, parts = docs.sparkSession, parallelism(docs)
    rows = keyed(docs, id_col, text_col)
    found = written(anchored(rows, window), "stretches")
    twice = found.groupBy("key").count().where("count > 1").select("key")
    repeats = written(found.where("known").unionByName(found.where("not known").join(twice, "key").select(*found.columns)).drop("known"), "repeats")
    forget(found)
    z = F.xxhash64("did", "th", "pos")
    distinct = written(repeats.groupBy("key", "fp").agg(F.count("*").alias("n"), *(F.min_by(c, z).alias(c) for c in ("did", "th", "pos"))), "distinct-stretches")
    candidates = written(distinct.join(distinct.groupBy("key").agg(F.count("*").alias("kinds")), "key"), "candidates")
    forget(distinct)
    texts = lambda c: rows.join(c.groupBy("did", "th").agg(F.collect_list(F.struct("key", "fp", "n", "pos")).alias("own")), ["did", "th"]).select("bytes", "own")
    cuts = splitters(rows, parts, window)
    matches = written(merged(sorted_runs(texts(candidates.where(F.col("kinds") <= hot)), cuts, window), parts, window), "matches")
    hot_ones = candidates.where(F.col("kinds") > hot)
    if hot_ones.limit(1).count():
        matches = matches.unionByName(hot_matches(texts(hot_ones), window))
    at = F.shiftright("pos", 20) + F.shiftright("pos", 10).bitwiseAND(F.lit(1023))
    ranges = repeats.join(matches, ["key", "fp"]).select("did", "th", at.alias("a"), "low", "high")
    result = written(ranges.groupBy("did", "th").agg(F.collect_list(F.struct("a", "low", "high")).alias("own")), "spans")
    for table in (repeats, candidates):
        forget(table)
    release(spark)
    return result


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of tables that are no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def covered(own: list[dict] | None, length: int, window: int) -> list[tuple[int, int]]:
    """Maximal removed runs (begin, end) of a text."""
    if not own:
        return []
    ranges = sorted((x["a"] - h, x["a"] - l + window) for x in own for l, h in zip(x["low"], x["high"]))
    out = [list(ranges[0])]
    for b, e in ranges:
        if b > out[-1][1]:
            out.append([b, e])
        elif e > out[-1][1]:
            out[-1][1] = e
    return [(b, min(e, length)) for b, e in out]


def kept_bytes(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for pair in gone for x in pair), len(text)]
    return b"".join(text[b:e] for b, e in zip(edges[::2], edges[1::2]))


def _with_spans(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    keys = {"did": "tidemark_did_", "th": "tidemark_th_", "own": "tidemark_own_"}
    plain = docs.withColumns({keys["did"]: F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), keys["th"]: F.xxhash64(utf8(text_col))})
    return plain.join(found.withColumnsRenamed(keys), [keys["did"], keys["th"]], "left").drop(keys["did"], keys["th"])


def outlines(docs: DataFrame, found: DataFrame, short: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """id, did, th, n_bytes, n_repeated, text and the begins and ends of its passages of ``window`` bytes and more.

    A text without such a passage loses nothing: it comes as null, with its digest.
    """

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                out = []
                for text, own in zip(part.column("text").to_pylist(), part.column("own").to_pylist()):
                    gone = covered(own, len(text), short)
                    long = [(b, e) for b, e in gone if e - b >= window]
                    out.append((len(text), sum(e - b for b, e in gone), text if long else None, None if long else hashlib.sha256(text).hexdigest(), [b for b, _ in long], [e for _, e in long]))
                columns = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "did", "th")), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    names = ["id", "did", "th", "n_bytes", "n_repeated", "text", "whole", "begins", "ends"]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    joined = plain.withColumns({"did": F.coalesce("id", F.lit(-(1 << 63))), "th": F.xxhash64("text")}).join(found, ["did", "th"], "left")
    schema = "id long, did long, th long, n_bytes long, n_repeated long, text binary, whole string, begins array<long>, ends array<long>"
    return joined.select("id", "did", "th", "text", "own").mapInArrow(outline, schema)


def removals(docs: DataFrame, window: int = WINDOW, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", short: int = PASSAGE) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and n_repeated (bytes in repeated strings of ``short`` bytes) of every row."""
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                out = []
                for text, own in zip(part.column("text").to_pylist(), part.column("own").to_pylist()):
                    gone = covered(own, len(text), window)
                    out.append((sum(e - b for b, e in gone), len(gone), hashlib.sha256(kept_bytes(text, gone)).hexdigest()))
                columns = list(zip(*out)) or [()] * 3
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))), part.column(2)], names)

    short = min(short, window)
    outline = written(outlines(docs, spans(docs, short, hot, id_col, text_col), short, window, id_col, text_col), "outlines")
    whole = outline.where("text is null").select(F.col("id").alias(id_col), "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("whole").alias("kept_sha256"), "n_repeated")
    long = outline.where("text is not null")
    passages = long.select("did", "th", "text", F.explode(F.arrays_zip("begins", "ends")).alias("p")).select("did", "th", F.col("p.begins").alias("begin"), F.expr("substring(text, cast(p.begins as int) + 1, cast(p.ends - p.begins as int))").alias("part"))
    passages = written(passages.withColumns({"passage": F.xxhash64("did", "th", "begin"), "part_hash": F.xxhash64("part")}), "passages")
    found = spans(passages, window, hot, "passage", "part").select(F.col("did").alias("passage"), F.col("th").alias("part_hash"), F.explode("own").alias("x"))
    moved = passages.select("passage", "part_hash", "did", "th", "begin").distinct().join(found, ["passage", "part_hash"])
    own = moved.groupBy("did", "th").agg(F.collect_list(F.struct((F.col("x.a") + F.col("begin")).alias("a"), F.col("x.low").alias("low"), F.col("x.high").alias("high"))).alias("own"))
    cut = long.join(own, ["did", "th"], "left").select("id", "n_bytes", "n_repeated", "text", "own")
    return whole.unionByName(cut.mapInArrow(digest, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long"))


def deduplicated(docs: DataFrame, window: int = WINDOW, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated windows taken out of the text; a character that loses some of its bytes goes whole."""
    joined = _with_spans(docs, spans(docs, window, hot, id_col, text_col), id_col, text_col)
    columns = [c for c in docs.columns if c != text_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, own in zip(batch.column("tidemark_text_").to_pylist(), batch.column("tidemark_own_").to_pylist()):
                gone = covered(own, len(text or b""), window)
                texts.append(text.decode() if text is not None and not gone else None if text is None else kept_bytes(text, gone).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string())], [*columns, text_col])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + f", `{text_col}` string"
    return joined.select(*columns, F.col(text_col).cast("binary").alias("tidemark_text_"), "tidemark_own_").mapInArrow(cut, kinds).select(*docs.columns)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: what repeated 400-byte strings take from all documents; n_repeated counts shorter passages too."""
    return removals(documents(spark, sf_dir))
