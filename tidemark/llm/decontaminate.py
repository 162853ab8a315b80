"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are compared as lower-case words without punctuation, joined by single spaces, in bytes.

1. Windows.  A window is a place in a text and an item: it has the item's length and begins where the item would, judged by
   short strings of ``GRAM`` bytes that both hold.  A first pass counts the items' strings over all documents; one of
   frequency p is worth -log2 p bits.  An item's seeds are its strings of ``SEED_BITS`` bits or more, and its ``LEAST_SEEDS`` rarest
   in any case.  Seeds that agree on the item's place, up to the shift that edits cause, make a window if together they are
   worth ``SHARE_BITS`` of all that the item's strings are worth, and ``LEAST_BITS``; what overlaps or repeats counts once.  Of 10^8 places, each of
   which would need its own walk, about one in 10^4 is left.
2. Embedding.  The CGK walk reads a window from its start; at step j it writes the byte it stands on and moves on or stays, as
   a random bit for (j, byte) says.  Strings within few edits get walks that meet again and again, so edit distance becomes
   Hamming distance.
3. Bit sampling.  Each of ``WALKS`` x ``KEYS`` keys takes all bits of ``SAMPLED`` random positions of a walk.  A window goes on
   if one key equals the item's.  With half of all positions differing a key agrees with probability 0.06; that all of 288 fail
   has probability 1e-8; with two thirds differing, 0.012 and 3 %.
4. Verification.  The item's least edit distance to any part of the window and its margins, bit-parallel; a hit has
   1 - distance / item length of ``SIMILARITY`` at least.

Items of fewer than ``MIN_WORDS`` words that have under ``SHORT_BYTES`` bytes must occur as they are, as whole words; null items and
those without a word match nothing; null texts hold nothing.  Equal items of different ids are found each on its own;
repeated rows give a row each.  Items go to executors in blocks of ``BLOCK_BYTES`` of text, each against all documents.

Memory: walks are made of windows sorted by length, ``EMBED_BYTES`` at a time (a single longer window: twelve times its bytes), and their
random bits repeat after ``PERIOD`` steps.  Places of seeds are expanded by the items that hold them in runs of ``POSTINGS``: texts are
halved, then items.  One text and one item with more than that (a string that both repeat) are compared by edit distance at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, sliced, utf8
from tidemark.llm.toxicity import _CLEAN

SIMILARITY = 0.8
MIN_WORDS = 5
SHORT_BYTES = 64
GRAM = 6
SEED_BITS = 14
LEAST_SEEDS = 8
SHARE_BITS = 0.23
LEAST_BITS = 15.0
TABLE_BITS = 22
SLICE_BYTES = 2 << 20
WALKS = 6
KEYS = 48
SAMPLED = 4
PERIOD = 1 << 14
EMBED_BYTES = 32 << 20
EMBED_ROWS = 4096
POSTINGS = 1 << 21
BLOCK_BYTES = 16 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_CLEAN).split()


def edit_distance_in(pattern: bytes, text: bytes) -> int:
    """The least edit distance of ``pattern`` to any part of ``text``, by Myers' bit vectors."""
    n = len(pattern)
    where: dict[int, int] = defaultdict(int)
    for i, b in enumerate(pattern):
        where[b] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, n
    for b in text:
        eq = where.get(b, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
    return best


def normalized(text: bytes) -> bytes:
    """A text's words, with one space around each."""
    own = words_of(text)
    return b" %b " % b" ".join(own) if own else b""


def grams(data: bytes, size: int = GRAM) -> np.ndarray:
    """The ``size`` bytes (8 at most) from each place on as a number."""
    eight = np.ndarray((len(data),), "<u8", data + b"\0" * 8, strides=(1,))
    return eight & np.uint64((1 << 8 * size) - 1)


class Grams:
    """A set of short strings, looked up at every place of a buffer."""

    def __init__(self, values: np.ndarray, size: int = GRAM):
        self.keys, self.size = np.unique(values), size
        self.seen = np.zeros(1 << TABLE_BITS, bool)
        self.seen[self._hash(self.keys)] = True

    @staticmethod
    def _hash(values: np.ndarray) -> np.ndarray:
        return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)

    def places(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places where a string begins, and its number."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        value = grams(data, self.size)
        at = np.flatnonzero(self.seen[self._hash(value)])
        own = value[at]
        which = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        same = self.keys[which] == own
        return at[same], which[same]


class Items:
    """A block of benchmark items with their seeds and sampled walks."""

    def __init__(self, items: list[tuple[int, bytes]], bits: Callable[[Grams], np.ndarray] = lambda g: np.full(len(g.keys), SEED_BITS + 2.0), seed: int = 11):
        own = [(i, normalized(t)) for i, t in items]
        short = [(i, t) for i, t in own if t and t.count(b" ") <= MIN_WORDS and len(t) < SHORT_BYTES + 2]
        fuzzy = [(i, t) for i, t in own if t and not (t.count(b" ") <= MIN_WORDS and len(t) < SHORT_BYTES + 2)]
        self.ids = np.array([i for i, _ in fuzzy + short], np.int64)
        self.texts = [t.strip() for _, t in fuzzy]
        # Short items by their first bytes, with the space before and, if they are very short, after.
        self.exact: dict[int, tuple[Grams, dict[int, list[tuple[int, bytes]]]]] = {}
        for k, (_, t) in enumerate(short, len(fuzzy)):
            size = min(8, len(t))
            value = int.from_bytes(t[:size], "little")
            _, texts = self.exact.setdefault(size, (None, {}))
            texts.setdefault(value, []).append((k, t))
        self.exact = {size: (Grams(np.array(sorted(texts), np.uint64), size), texts) for size, (_, texts) in self.exact.items()}
        found = [grams(t)[: len(t) - GRAM + 1] for t in self.texts]
        seeds = Grams(np.concatenate([*found, np.zeros(0, np.uint64)]))
        worth = bits(seeds)
        chosen = []
        for k, own_ in enumerate(found):
            which = np.searchsorted(seeds.keys, own_)
            rarest = np.unique(which)[np.argsort(-worth[np.unique(which)], kind="stable")[:LEAST_SEEDS]]
            at = np.flatnonzero((worth[which] >= SEED_BITS) | np.isin(which, rarest))
            chosen.append(np.stack([which[at], np.full(len(at), k), at], axis=1))
        flat = np.concatenate([*chosen, np.zeros((0, 3), np.int64)])
        flat = flat[np.lexsort((flat[:, 2], flat[:, 1], flat[:, 0]))]
        used, n = np.unique(flat[:, 0], return_counts=True)
        self.seeds, self.bits = Grams(seeds.keys[used]), worth[used]
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.item, self.at = flat[:, 1].copy(), flat[:, 2].copy()
        self.seed_item = np.repeat(np.arange(len(used)), n) * np.int64(len(found)) + self.item
        whole = np.array([worth[np.searchsorted(seeds.keys, g)].sum() / GRAM for g in found])
        self.need = np.maximum(SHARE_BITS * whole, LEAST_BITS)
        random = np.random.default_rng(seed)
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.longest = int(self.length.max(initial=1))
        # A row for each step: the moves of all walks, 256 each.
        moves = random.integers(0, 2, (WALKS, min(2 * self.longest, PERIOD), 256), np.uint8)
        self.moves = np.ascontiguousarray(moves.transpose(1, 0, 2)).reshape(-1, WALKS * 256)
        # Positions to sample as shares of a walk of twice the length, the same for all items.
        self.places = random.random((WALKS, KEYS * SAMPLED))
        data = b"".join(self.texts)
        start = np.cumsum(self.length) - self.length
        self.keys = self.embed(np.frombuffer(data, np.uint8), start, start + self.length, np.arange(len(self.texts)))

    def embed(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Keys of windows of the given items: a window's walk has twice the item's length in steps; past the end it writes zeros."""
        out = np.zeros((len(start), WALKS * KEYS), np.uint32)
        data, steps = np.append(data, np.uint8(0)), 2 * self.length[item]
        order = np.argsort(-steps, kind="stable")
        k = 0
        while k < len(order):
            longest = int(steps[order[k]])
            part = order[k : k + max(1, min(EMBED_ROWS, EMBED_BYTES // (WALKS * longest)))]
            out[part] = self._keys(data, start[part], end[part], steps[part])
            k += len(part)
        return out

    def _keys(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, steps: np.ndarray) -> np.ndarray:
        past, rows = len(data) - 1, np.arange(len(start))[:, None]
        walk = np.zeros((int(steps.max()), WALKS, len(start)), np.uint8)  # all walks of a step together
        at = np.repeat(start.astype(np.int32)[None, :], WALKS, axis=0)
        own_moves = (np.arange(WALKS, dtype=np.int16) * 256)[:, None]
        for j, own in enumerate(walk):
            np.take(data, np.where(at < end, at, past), out=own)
            at += self.moves[j % PERIOD].take(own + own_moves)
        out = np.zeros((len(start), WALKS * KEYS), np.uint32)
        for w in range(WALKS):
            wanted = (self.places[w] * steps[:, None]).astype(np.int64)
            bytes_ = walk[wanted, w, rows].reshape(-1, KEYS, SAMPLED)
            out[:, w * KEYS : (w + 1) * KEYS] = np.ascontiguousarray(bytes_).view("<u4")[:, :, 0]
        return out

    def windows(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """(text, item, begin in ``data``) of every window, and pairs of text and item to compare as wholes."""
        place, seed = self.seeds.places(data)
        doc = np.searchsorted(starts, place, "right") - 1
        found, whole = [np.zeros((0, 3), np.int64)], []
        todo = [(place, seed, doc, self.first[seed], self.first[seed + 1])] if len(place) else []
        while todo:
            place, seed, doc, low, high = todo.pop()
            if (high - low).sum() <= POSTINGS:
                found.append(self._chained(place, seed, doc, low, high))
            elif doc[0] != doc[-1]:
                cut = np.searchsorted(doc, (doc[0] + doc[-1]) // 2, "right")
                todo += [tuple(x[half] for x in (place, seed, doc, low, high)) for half in (slice(cut, None), slice(cut))]
            else:
                # Items of a seed are in order: all places get the same cut between two items.
                own = np.unique(np.concatenate([self.item[a:b] for a, b in set(zip(low.tolist(), high.tolist()))]))
                if len(own) == 1:
                    whole.append((int(doc[0]), int(own[0])))
                    continue
                key = seed * np.int64(len(self.length)) + own[len(own) // 2]
                middle = np.clip(np.searchsorted(self.seed_item, key), low, high)
                for a, b in ((middle, high), (low, middle)):
                    some = b > a
                    todo.append((place[some], seed[some], doc[some], a[some], b[some]))
        return np.concatenate(found), whole

    def _chained(self, place: np.ndarray, seed: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Windows from seeds at ``place``, each with its items ``low`` to ``high``."""
        n = high - low
        post = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place, worth, doc, item = np.repeat(place, n), np.repeat(self.bits[seed], n), np.repeat(doc, n), self.item[post]
        begin = place - self.at[post]
        order = np.argsort((item << 32) + begin + self.longest, kind="stable")
        place, worth, item, begin, doc = (x[order] for x in (place, worth, item, begin, doc))
        # Chains of neighbours that agree on a window's place within the slack.
        near = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (begin[1:] - begin[:-1] <= 8 + self.length[item[1:]] // 16)
        chain = np.concatenate([[0], np.cumsum(~near)]) if len(item) else np.zeros(0, np.int64)
        # Within a chain, in order of place in the item, a seed counts for the bytes that the one before doesn't have.
        at = place - begin
        order = np.argsort((chain << 32) + at, kind="stable")
        step = np.diff(at[order], prepend=-GRAM)
        step[np.diff(chain[order], prepend=-1) != 0] = GRAM
        total = np.bincount(chain[order], worth[order] * np.minimum(step, GRAM) / GRAM, minlength=int(chain[-1]) + 1 if len(chain) else 0)
        chosen = total[chain] >= self.need[item]
        rows = np.stack([doc, item, begin], axis=1)[chosen]
        if not len(rows):
            return rows
        # Begins that are close to each other, by the item's length, make one window.
        step = rows[:, 2] // np.maximum(8, self.length[rows[:, 1]] // 32)
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1) | (step[1:] != step[:-1])
        return rows[new]

    def find(self, texts: list[bytes]) -> list[tuple[int, int, float]]:
        """(text, item, similarity) of all hits."""
        own = [normalized(t) for t in texts]
        data = b"\n".join(own) + b"\n"  # no item holds a line's end
        starts = np.cumsum([0, *(len(t) + 1 for t in own)])[:-1]
        ends = starts + np.array([len(t) for t in own], np.int64)
        out: dict[tuple[int, int], float] = {}
        for seeds, items in self.exact.values():
            for p, which in zip(*(x.tolist() for x in seeds.places(data))):
                for k, t in items[int(seeds.keys[which])]:
                    if data.startswith(t, p):
                        out[int(np.searchsorted(starts, p, "right")) - 1, k] = 1.0
        rows, whole = self.windows(data, starts)
        for d, m in whole:
            similarity = 1 - edit_distance_in(self.texts[m], own[d]) / int(self.length[m])
            if similarity >= SIMILARITY:
                out[d, m] = similarity
        array = np.frombuffer(data, np.uint8)
        for k in range(0, len(rows), 4096):
            part = rows[k : k + 4096]
            low, high = starts[part[:, 0]], ends[part[:, 0]]
            begin = np.clip(part[:, 2], low, high)
            same = (self.embed(array, begin, np.minimum(begin + self.length[part[:, 1]], high), part[:, 1]) == self.keys[part[:, 1]]).any(axis=1)
            for i in np.flatnonzero(same).tolist():
                d, m, _ = part[i].tolist()
                n = int(self.length[m])
                margin = n // 5 + 8
                if out.get((d, m), 0) == 1.0:
                    continue
                window = data[max(int(low[i]), int(begin[i]) - margin) : min(int(high[i]), int(begin[i]) + n + margin)]
                similarity = 1.0 if self.texts[m] in window else 1 - edit_distance_in(self.texts[m], window) / n
                if similarity >= SIMILARITY:
                    out[d, m] = max(out.get((d, m), 0), similarity)
        return [(d, m, s) for (d, m), s in sorted(out.items())]


def gram_bits(docs: DataFrame, seeds: Grams, text_col: str = "text") -> np.ndarray:
    """-log2 of the frequency of each string over all places of all rows; as many numbers as strings go to the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(seeds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        total = np.zeros(len(own.keys) + 1, np.int64)
        for batch in batches:
            for part in sliced(batch, "bytes", SLICE_BYTES):
                data = b"\n".join([normalized(t) for t in part.column(0).to_pylist()])
                total[-1] += len(data)
                total[:-1] += np.bincount(own.places(data)[1], minlength=len(own.keys))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["gram", "n"])

    n = np.zeros(len(seeds.keys) + 1)
    rows = docs.select(utf8(text_col).alias("bytes")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return np.log2((n[-1] + 2) / (n[:-1] + 1))


def item_blocks(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", docs_text_col: str = "text") -> Iterator[Items]:
    """The items in blocks of about ``BLOCK_BYTES``."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("bytes")).where(F.col("id").isNotNull())
    total = rows.agg(F.sum(F.octet_length("bytes") + 64)).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("id", "bytes"), F.lit(blocks)) == k).distinct().orderBy("id", "bytes").collect()
        items = [(r["id"], bytes(r["bytes"])) for r in own]
        yield Items(items, lambda seeds: gram_bits(docs, seeds, docs_text_col))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """id, item_id, similarity: one row for each row of ``docs`` and item that it holds; no shuffle."""
    spark, found = docs.sparkSession, None

    def search(sent):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                for part in sliced(batch, "bytes", SLICE_BYTES):
                    hits = items.find(part.column("bytes").to_pylist())
                    if hits:
                        rows, which, similarity = zip(*hits)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(items.ids[list(which)]), pa.array(similarity, pa.float64())], ["id", "item", "similarity"])

        return find

    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("bytes"))
    for items in item_blocks(docs, benchmark, item_col, docs_text_col=text_col):
        own = rows.mapInArrow(search(spark.sparkContext.broadcast(items)), "id long, item long, similarity double")
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = spark.createDataFrame([], "id long, item long, similarity double")
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    spark, schema = docs.sparkSession, docs.schema
    place = docs.columns.index(text_col)

    def keep(sent):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                bytes_ = pa.record_batch([batch.column(place).cast(pa.binary()).fill_null(b"")], ["bytes"])
                at = 0
                for part in sliced(bytes_, "bytes", SLICE_BYTES):
                    good = np.ones(part.num_rows, bool)
                    good[[d for d, _, _ in items.find(part.column(0).to_pylist())]] = False
                    yield batch.slice(at, part.num_rows).filter(pa.array(good))
                    at += part.num_rows

        return find

    for items in item_blocks(docs, benchmark, item_col, docs_text_col=text_col):
        docs = docs.mapInArrow(keep(spark.sparkContext.broadcast(items)), schema)
    return docs


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
