"""LM scoring: Brown class-based bigrams.

1. Spark counts all words of the training texts into a shared table (it grows with the corpus and never leaves it whole).
2. The ``CLUSTERED`` most frequent words are clustered by exchange: each word in turn moves to the class that gives the class
   bigram model the most likelihood, until nothing moves.  Their bigram counts are a matrix of fixed size, summed over all
   training texts; every other word stands in it by its ending (a hash of its last two bytes, as words of a language and form
   share endings), and the end of a text is a class of its own.  Then all words of ``MIN_COUNT`` or more, as far as
   the table of frequent words goes, are exchanged ``PARALLEL_ROUNDS`` times (once: a round costs two passes over the texts): Spark sums each word's neighbours by class, and tasks
   move every word to its best class against the class bigrams of the round.  Words below that keep the class of their ending.
3. P(w | v) = P(class(w) | class(v)) P(w | class(w)).  Transitions are smoothed towards the class frequencies, emissions by
   ``DELTA`` for each known word and one unknown word of the class.
4. In scoring, counts of the ``FREQUENT`` most frequent words (a table of fixed size) are in every task's memory; all other
   words of a text get theirs by a join with the counts table, so no vocabulary of unbounded size is sent anywhere, and a
   word in that join is too rare to be a hot key.

Null text is empty: one token, the end.  A row whose doc_id is null is held out.  Repeated rows are learned from and scored
each on its own.  Without training texts all counts are 0.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, sliced, utf8, written

END = b"\n"  # no word holds white space
CLUSTERED = 511
CLASSES = 32
ENDINGS = 32
FREQUENT = 1 << 17
LEVELS = 64  # of frequency, for each doubling
DELTA = 0.5
PRIOR = 5.0
ROUNDS = 12
HELD_WORDS = 600_000
MIN_COUNT = 12
PARALLEL_ROUNDS = 1
HELD_CELLS = 1 << 21
SENT_ROWS = 1 << 16
SLICE_BYTES = 2 << 20


class Sums:
    """Counts by key of many parts, in bounded memory: ``add`` and ``rest`` give back (keys, counts) of ``SENT_ROWS`` at most."""

    def __init__(self, most: int = HELD_CELLS):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > self.most:
            self._merge()
            if self.size > self.most // 2:
                yield from self.rest()

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self._merge()
        key, n = self.parts.pop()
        self.size = 0
        for at in range(0, len(key), SENT_ROWS):
            yield key[at : at + SENT_ROWS], n[at : at + SENT_ROWS]

    def _merge(self) -> None:
        key = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in self.parts)])
        n = np.concatenate([np.zeros(0, np.int64), *(n for _, n in self.parts)])
        self.parts = []
        order = np.argsort(key)
        key, n = key[order], n[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.parts = [(key[first], np.add.reduceat(n, first) if len(key) else n)]
        self.size = len(first)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (UTF-8 bytes), n: all tokens of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            own = iter(held.items())
            while part := list(itertools.islice(own, SENT_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])

        for batch in batches:
            for part in sliced(batch, "bytes", SLICE_BYTES):
                for text in part.column(0).to_pylist():
                    held.update(text.lower().split())
                held[END] += part.num_rows
                if len(held) > HELD_WORDS:
                    yield from out()
                    held.clear()
        yield from out()

    return docs.select(utf8(text_col).alias("bytes")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ending_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


class Symbols:
    """Symbols of words: 0 is the end, 1 to CLUSTERED the clustered words, then the endings."""

    def __init__(self, frequent: list[bytes]):
        words = [w for w in frequent if w != END]
        self.index = {END: 0} | {w: i + 1 for i, w in enumerate(words)}
        self.clustered = min(CLUSTERED, len(words))
        self.endings: dict[bytes, int] = {}
        self.symbol = np.zeros(len(words) + 1, np.int64)
        self.symbol[1 : self.clustered + 1] = np.arange(1, self.clustered + 1)
        self.symbol[self.clustered + 1 :] = [self.of_ending(w) for w in words[self.clustered :]]

    def of_ending(self, word: bytes) -> int:
        tail = word[-2:]
        if tail not in self.endings:
            self.endings[tail] = 1 + CLUSTERED + ending_class(tail)
        return self.endings[tail]

    def single(self, of: np.ndarray) -> np.ndarray:
        """Give each frequent word a symbol of its own, behind the others; returns the class of every symbol."""
        own = of[self.symbol]
        self.symbol = WIDTH + np.arange(len(self.symbol))
        return np.concatenate([of, own])

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Of all texts, each with its end: indices among the frequent words (-1: none), symbols, the other words, their places, and where texts end."""
        words: list[bytes] = []
        ends = []
        for text in texts:
            words += text.lower().split()
            words.append(END)
            ends.append(len(words))
        index = np.fromiter(map(self.index.get, words, itertools.repeat(-1)), np.int64, len(words))
        places = np.flatnonzero(index < 0)
        rare = [words[i] for i in places.tolist()]
        symbol = self.symbol[index]
        symbol[places] = [self.of_ending(w) for w in rare]
        return index, symbol, rare, places, np.array(ends, np.int64)


WIDTH = 1 + CLUSTERED + ENDINGS


def bigrams(docs: DataFrame, symbols: Symbols, text_col: str = "text") -> np.ndarray:
    """Counts of pairs of symbols over all rows, a matrix of ``WIDTH`` squared; a text's first word follows an end."""
    sent = docs.sparkSession.sparkContext.broadcast(symbols)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDTH * WIDTH, np.int64)
        for batch in batches:
            for part in sliced(batch, "bytes", SLICE_BYTES):
                symbol = sent.value.read(part.column(0).to_pylist())[1]
                total += np.bincount(np.concatenate([[0], symbol[:-1]]) * WIDTH + symbol, minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["pair", "n"])

    rows = docs.select(utf8(text_col).alias("bytes")).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(WIDTH * WIDTH)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(WIDTH, WIDTH)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(n: np.ndarray, after: np.ndarray, before: np.ndarray, twice: float, own: np.ndarray) -> np.ndarray:
    """What the log-likelihood gains when a word joins each of the classes ``own``.

    n: class bigrams without the word; after, before: its followers and predecessors by class, without itself; twice: its
    bigrams with itself.
    """
    rows, columns = n[own], n[:, own].T
    gain = (_f(rows + after) - _f(rows)).sum(axis=1) + (_f(columns + before) - _f(columns)).sum(axis=1)
    d = n[own, own]
    gain += _f(d + after[own] + before[own] + twice) - _f(d) - (_f(d + after[own]) - _f(d)) - (_f(d + before[own]) - _f(d))
    sums = n.sum(axis=1)[own], n.sum(axis=0)[own]
    return gain - (_f(sums[0] + after.sum() + twice) - _f(sums[0]) + _f(sums[1] + before.sum() + twice) - _f(sums[1]))


def exchange(pairs: np.ndarray, clustered: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each symbol: 0 for the end, 1 to ``classes`` for the clustered words, then the endings.

    Words begin in classes by rank of frequency, in turn.  The likelihood of the class bigrams is the sum of N log N over
    class pairs less that over the classes as left and as right context.
    """
    count = 1 + classes + ENDINGS
    of = np.zeros(len(pairs), np.int64)
    of[1 : CLUSTERED + 1] = 1 + np.arange(CLUSTERED) % classes
    of[CLUSTERED + 1 :] = 1 + classes + np.arange(ENDINGS)
    member = np.zeros((len(pairs), count))
    member[np.arange(len(pairs)), of] = 1
    right, left = pairs @ member, pairs.T @ member  # of each symbol: followers and predecessors by class
    n = member.T @ right
    own = np.arange(1, classes + 1)
    for _ in range(rounds):
        moved = 0
        for w in range(1, clustered + 1):
            after, before, twice, old = right[w].copy(), left[w].copy(), pairs[w, w], of[w]
            after[old] -= twice
            before[old] -= twice
            # Without the word.
            n[old] -= after
            n[:, old] -= before
            n[old, old] -= twice
            gain = gains(n, after, before, twice, own)
            new = int(own[np.argmax(gain)])
            if gain[new - 1] <= gain[old - 1] + 1e-9:
                new = int(old)
            n[new] += after
            n[:, new] += before
            n[new, new] += twice
            if new != old:
                moved += 1
                of[w] = new
                right[:, old] -= pairs[:, w]
                right[:, new] += pairs[:, w]
                left[:, old] -= pairs[w]
                left[:, new] += pairs[w]
        if not moved:
            break
    return of


def class_bigrams(docs: DataFrame, symbols: Symbols, of: np.ndarray, classes: int, text_col: str = "text") -> np.ndarray:
    """Counts of pairs of classes over all rows."""
    sent = docs.sparkSession.sparkContext.broadcast((symbols, of))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, of = sent.value
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for part in sliced(batch, "bytes", SLICE_BYTES):
                own = of[symbols.read(part.column(0).to_pylist())[1]]
                total += np.bincount(np.concatenate([[0], own[:-1]]) * classes + own, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["pair", "n"])

    rows = docs.select(utf8(text_col).alias("bytes")).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes * classes)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(classes, classes)


def neighbours(docs: DataFrame, symbols: Symbols, of: np.ndarray, movable: int, classes: int, text_col: str = "text") -> DataFrame:
    """word (its index), cell, n: how often each class follows (cell = class) and precedes (classes + class) each of the first ``movable`` words; cell -1: itself follows."""
    sent, width = docs.sparkSession.sparkContext.broadcast((symbols, of)), 2 * classes + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, of = sent.value
        held = Sums()

        def out(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key // width), pa.array((key % width - 1).astype(np.int32)), pa.array(n)], ["word", "cell", "n"])

        for batch in batches:
            for part in sliced(batch, "bytes", SLICE_BYTES):
                index, symbol, *_ = symbols.read(part.column(0).to_pylist())
                own, before = of[symbol], np.concatenate([[0], index[:-1]])
                last = np.concatenate([[0], own[:-1]])
                mine, other, twice = (index > 0) & (index < movable), (before > 0) & (before < movable), index == before
                keys = [index[mine & ~twice] * width + 1 + classes + last[mine & ~twice], before[other & ~twice] * width + 1 + own[other & ~twice], index[mine & twice] * width]
                for key, n in held.add(np.concatenate(keys)):
                    yield out(key, n)
        for key, n in held.rest():
            yield out(key, n)

    rows = docs.select(utf8(text_col).alias("bytes")).mapInArrow(count, "word long, cell int, n long")
    return rows.groupBy("word", "cell").agg(F.sum("n").alias("n"))


def moved(cells: DataFrame, of_word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best of the clustered classes for each word against the class bigrams ``n``, from its neighbours; one number for each word goes to the driver."""
    classes = len(n)
    sent = cells.sparkSession.sparkContext.broadcast((of_word, n))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n = sent.value[0], sent.value[1].copy()
        # Only the clustered classes: in a class that is nearly empty any word alone fits best, and all would go there at once.
        own = np.arange(1, classes - ENDINGS)
        for batch in batches:
            new = []
            words = batch.column("word").to_pylist()
            for word, pairs in zip(words, batch.column("pairs").to_pylist()):
                after, before, twice, old = np.zeros(classes), np.zeros(classes), 0.0, int(of[word])
                for p in pairs:
                    cell, k = p["cell"], p["n"]
                    if cell < 0:
                        twice = k
                    elif cell < classes:
                        after[cell] = k
                    else:
                        before[cell - classes] = k
                n[old] -= after
                n[:, old] -= before
                n[old, old] -= twice
                gain = gains(n, after, before, twice, own)
                choice = int(own[np.argmax(gain)])
                new.append(old if old < classes - ENDINGS and gain[choice - 1] <= gain[old - 1] + 1e-9 else choice)
                n[old] += after
                n[:, old] += before
                n[old, old] += twice
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(new, pa.int32())], ["word", "class"])

    grouped = cells.groupBy("word").agg(F.collect_list(F.struct("cell", "n")).alias("pairs"))  # 2 x classes + 1 cells at most
    rows = grouped.mapInArrow(best, "word long, class int").toArrow()
    out = of_word.copy()
    out[rows.column("word").to_numpy()] = rows.column("class").to_numpy()
    return out


@dataclass
class Model:
    """What a task needs to score: all of fixed size."""

    symbols: Symbols
    counts: np.ndarray  # of the frequent words
    of: np.ndarray
    transition: np.ndarray  # log10 by class pair
    mass: np.ndarray  # log10 of a class's smoothed total
    tokens: int
    types: int


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The most frequent words, ``most`` at most: all from one frequency on, found from a histogram of fixed size."""
    level = F.floor(F.log2(F.col("n").cast("double")) * LEVELS)
    rows = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True)
    fits = [r["level"] for r, total in zip(rows, itertools.accumulate(r["words"] for r in rows)) if total <= most]
    return counts.where(level >= min(fits)) if fits else counts.limit(0)


def learn(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of all rows of ``docs``, and the shared table of word counts."""
    counts = written(word_counts(docs, text_col), "words")
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = sorted(frequent_words(counts).collect(), key=lambda r: (-r["n"], bytes(r["word"])))
    number = {bytes(r["word"]): r["n"] for r in top}
    symbols = Symbols([bytes(r["word"]) for r in top])
    frequent = np.array([number.get(w, 0) for w in symbols.index], np.float64)
    pairs = bigrams(docs, symbols, text_col)
    of = exchange(pairs, symbols.clustered)
    classes = int(of.max()) + 1
    member = np.zeros((WIDTH, classes))
    member[np.arange(WIDTH), of] = 1
    n = member.T @ pairs @ member
    movable = int(np.searchsorted(-frequent[1:], -MIN_COUNT, "right")) + 1  # frequent words come in order of their counts
    of = symbols.single(of)
    for _ in range(PARALLEL_ROUNDS if movable > symbols.clustered + 1 else 0):
        cells = written(neighbours(docs, symbols, of, movable, classes, text_col), "neighbours")
        of = np.concatenate([of[:WIDTH], moved(cells, of[symbols.symbol], n)])
        n = class_bigrams(docs, symbols, of, classes, text_col)
    share = (n.sum(axis=0) + 1) / (n.sum() + classes)
    transition = np.log10((n + PRIOR * share) / (n.sum(axis=1, keepdims=True) + PRIOR))
    sent = docs.sparkSession.sparkContext.broadcast((symbols, of))

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, of = sent.value
        total = np.zeros(classes, np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            index = np.fromiter(map(symbols.index.get, words, itertools.repeat(-1)), np.int64, len(words))
            symbol = symbols.symbol[index]
            rare = np.flatnonzero(index < 0)
            symbol[rare] = [symbols.of_ending(words[i]) for i in rare.tolist()]
            total += np.bincount(of[symbol], minlength=classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(total)], ["class", "n"])

    members = np.zeros(classes)
    for r in counts.select("word").mapInArrow(kinds, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        members[r["class"]] = r["n"]
    mass = np.log10(n.sum(axis=0) + DELTA * (members + 1))
    return Model(symbols, frequent, of, transition, mass, int(tokens), int(types)), counts


def scores(docs: DataFrame, model: Model, counts: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, n_tokens, n_known, base_sum (log10 of all c + 1) and score for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = sent.value
        plain, emit = np.log10(own.counts + 1), np.log10(own.counts + DELTA)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in sliced(batch, "bytes", SLICE_BYTES):
                index, symbol, rare, places, ends = own.symbols.read(part.column("bytes").to_pylist())
                begin = np.concatenate([[0], ends[:-1]])
                cls = own.of[symbol]
                known = index >= 0
                score = own.transition[np.concatenate([[0], cls[:-1]]), cls] - own.mass[cls] + np.where(known, emit[index], 0)
                base = np.where(known, plain[index], 0)
                seen = known & (own.counts[index] > 0)
                total = [np.add.reduceat(x, begin) for x in (score, base, seen.astype(np.int64))]
                words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.searchsorted(places, ends)]).astype(np.int32)), pa.array(rare, pa.binary()))
                ids = np.arange(row, row + part.num_rows)
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(ids), pa.array(ends - begin), *map(pa.array, total), words], names)

    names = [*keep, "row", "n_tokens", "score_", "base_", "known_", "rare"]
    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    # Written once: the rows' numbers must be the same on both sides of the join.
    rows = written(docs.select(*keep, utf8(text_col).alias("bytes")).mapInArrow(read, f"{kinds}row long, n_tokens long, score_ double, base_ double, known_ long, rare array<binary>"), "scored")
    words = rows.select("row", F.explode("rare").alias("word"))
    found = words.join(counts, "word", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))
    rest = found.groupBy("row").agg(F.sum(F.log10(F.col("n") + DELTA)).alias("score_rare"), F.sum(F.log10(F.col("n") + 1)).alias("base_rare"), F.count_if(F.col("n") > 0).alias("known_rare"))
    whole = rows.drop("rare").join(rest, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return whole.select(*keep, "n_tokens", (F.col("known_") + zero("known_rare")).alias("n_known"), (F.col("base_") + zero("base_rare")).alias("base_sum"), (F.col("score_") + zero("score_rare")).alias("score"))


def op8_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: log10 probabilities of all documents under the base and the class model."""
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True)))
    model, counts = learn(docs.where("not held_out"))
    found = scores(docs, model, counts, ["doc_id", "held_out"])
    base = F.col("base_sum") - F.col("n_tokens") * F.log10(F.lit(float(model.tokens + model.types + 1)))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
