"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays.

Texts become sequences of lower-case letters with single spaces for everything else.  Letters are folded to 12 bits (code
points below 768 as they are, others by a hash), so an n-gram of ``ORDER`` letters is one number.  Spark sums the counts of
the longest n-grams per language, and the numbers of ones and twos of every order; continuation counts of the shorter
n-grams, discounts and back-off weights follow from them.  No n-gram is left out.

Models are cut into blocks of at most ``BLOCK_NGRAMS`` n-grams where they are larger: a language's n-grams are parted by their last
letter but one, with which every longer n-gram and context that a letter's probability needs goes too, so a text's
log-probability is the exact sum of its blocks'.  Each block is sent to executors in its own pass; usually there is one.
A text goes to the language with the least cross-entropy per letter.

The score is the probability of that language under a softmax of the total log-probabilities with a temperature fitted on
all learned texts.  ``rejected`` marks texts whose cross-entropy exceeds by ``REJECT_MARGIN`` what ``REJECT_QUANTILE`` of all
learned texts have in their own language at most: such texts are in none of the learned languages.  Losses are summed as whole
numbers and the quantile is found by counting, so neither depends on the order of rows.

Null texts and texts without a letter: ``und``, score 0, rejected.  Null languages and held-out rows are not learned; a null
doc_id counts as held out; a language without any letter is not learned.  With no learnable row every text is ``und``.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, sliced, utf8, written
from tidemark.llm.toxicity import held_out

ORDER = 4
BLOCK_NGRAMS = 1 << 22  # about 150 MB
REJECT_QUANTILE = 0.999
REJECT_MARGIN = 0.25
SLOPES = np.geomspace(1e-3, 1, 31)
LOSS_UNIT = 1 << 16
_BITS = 12


@cache
def _symbols() -> np.ndarray:
    """The 12-bit symbol of each code point; 0 for what isn't a letter."""
    out = np.zeros(0x110000, np.uint16)
    points = [c for c in range(0x323B0) if unicodedata.category(chr(c))[0] == "L"]
    folded = np.array(points, np.uint64)
    far = 768 + (folded * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64((1 << _BITS) - 768)
    out[points] = np.where(folded < 768, folded, far).astype(np.uint16)
    return out


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each with ``ORDER - 1`` spaces before and one after; and where each text ends.  Without a letter: nothing."""
    pad = " " * (ORDER - 1)
    lower = [f"{pad}{t.decode().lower()} " for t in texts]
    flat = _symbols()[np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([len(t) for t in lower])
    begin = ends - [len(t) for t in lower]
    letter = flat > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of spaces
    before = (begin[:, None] + np.arange(ORDER - 1)).ravel()
    total = np.concatenate([[0], np.cumsum(letter)])
    some = total[ends] > total[begin]
    keep[before] = np.repeat(some, ORDER - 1)
    # White space that a text begins with is the padding's.
    kept = np.concatenate([[0], np.cumsum(keep)])
    return flat[keep], kept[ends]


def grams(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol but the padding, and how many of them each text has."""
    sizes = np.diff(np.concatenate([[0], ends]))
    code = np.zeros(max(0, len(flat) - ORDER + 1), np.int64)
    for k in range(ORDER):
        code = (code << _BITS) | flat[k : k + len(code)]
    own = np.maximum(sizes - (ORDER - 1), 0)
    first = ends - sizes
    places = np.repeat(first - (np.cumsum(own) - own), own) + np.arange(own.sum())
    return code[places], own


def compact(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, and each n-gram's index among them."""
    alphabet = np.flatnonzero(np.bincount((code & ((1 << _BITS) - 1)).astype(np.int64), minlength=1 << _BITS) > 0)
    alphabet = np.union1d(alphabet, [0])
    if len(alphabet) ** ORDER > 1 << 24:
        return np.unique(code, return_inverse=True)
    dense = np.zeros(1 << _BITS, np.int64)
    dense[alphabet] = np.arange(len(alphabet))
    # The symbols of an n-gram all occur as last symbols too, or are spaces.
    small = np.zeros(len(code), np.int64)
    for k in reversed(range(ORDER)):
        small = small * len(alphabet) + dense[(code >> (k * _BITS)) & ((1 << _BITS) - 1)]
    seen = np.zeros(len(alphabet) ** ORDER, bool)
    seen[small] = True
    distinct = np.flatnonzero(seen)
    index = np.zeros(len(seen), np.int32)
    index[distinct] = np.arange(len(distinct))
    full = np.zeros(len(distinct), np.int64)
    rest = distinct.copy()
    for k in range(ORDER):
        full |= alphabet[rest % len(alphabet)] << (k * _BITS)
        rest //= len(alphabet)
    return full, index[small]


def _mix(code: np.ndarray) -> np.ndarray:
    """A hash of n-grams without collisions: multiplication by an odd number."""
    return code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def discount_of(ones: int, twos: int) -> float:
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


class KneserNey:
    """A language's model or a part of it: for each order, sorted hashes with discounted probabilities, and with back-off weights.

    A part holds the n-grams whose last letter but one is in ``letters`` (first, last); discounts by order and the counts of
    the order 1 come from the whole model then.
    """

    def __init__(self, code: np.ndarray, count: np.ndarray, discounts: list[float] | None = None, single: tuple[np.ndarray, np.ndarray] | None = None, letters: tuple[int, int] = (0, 1 << _BITS)):
        mask = lambda n: (1 << (_BITS * n)) - 1
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.letters = letters
        own, n = code, count.astype(np.float64)
        for order in range(ORDER, 0, -1):
            if order == 1 and single is not None:
                own, n = single[0], single[1].astype(np.float64)
            discount = discounts[order - 1] if discounts else discount_of((n == 1).sum(), (n == 2).sum())
            context, which = np.unique(own >> _BITS, return_inverse=True)
            total, kinds = np.bincount(which, n), np.bincount(which)
            p = np.maximum(n - discount, 0) / total[which]
            weight = discount * kinds / total
            h, g = _mix(own), _mix(context)
            a, b = np.argsort(h), np.argsort(g)
            self.levels.append((h[a], p[a].astype(np.float32), g[b], weight[b].astype(np.float32)))
            own, n = np.unique(own & mask(order - 1), return_counts=True)
            n = n.astype(np.float64)
        self.floor = 1.0 / (len(self.levels[-1][0]) + 1)

    def log_prob(self, code: np.ndarray) -> np.ndarray:
        """Of each n-gram's last letter; zero where the n-gram is another part's."""
        low, high = self.letters
        if (low, high) != (0, 1 << _BITS):
            out, letter = np.zeros(len(code)), (code >> _BITS) & ((1 << _BITS) - 1)
            mine = (letter >= low) & (letter <= high)
            out[mine] = self._log_prob(code[mine])
            return out
        return self._log_prob(code)

    def _log_prob(self, code: np.ndarray) -> np.ndarray:
        p = np.full(len(code), self.floor, np.float64)
        for order, (h, q, g, weight) in zip(range(1, ORDER + 1), reversed(self.levels)):
            own = code & ((1 << (_BITS * order)) - 1)
            p = _find(h, q, _mix(own), 0.0) + _find(g, weight, _mix(own >> _BITS), 1.0) * p
        return np.log(p)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default) if len(keys) else np.full(len(wanted), default)


def ngram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, code, n: counts of the longest n-grams of all rows; each task sums its own before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                code, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(which, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)], ["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for part in sliced(batch, "bytes"):
                flat, ends = symbols(part.column("bytes").to_pylist())
                code, own = grams(flat, ends)
                if not len(code):
                    continue
                distinct, index = compact(code)
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in sorted(set(langs)):
                    mine = index[np.repeat(langs == lang, own)]
                    n = np.bincount(mine, minlength=len(distinct))
                    held.setdefault(lang, []).append((distinct[n > 0], n[n > 0]))
                    size += int((n > 0).sum())
            if size > 8_000_000:
                yield from out()
                size = 0
        yield from out()

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), utf8(text_col).alias("bytes"))
    return rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass
class Identifier:
    """The languages, their models in blocks (broadcast), the temperature and the limit of rejection."""

    langs: list[str]
    blocks: list
    slope: float = 1.0
    limit: float = np.inf

    def decide(self, total: np.ndarray, own: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of texts with these log-probabilities and numbers of letters."""
        if not self.langs:
            return ["und"] * len(own), np.zeros(len(own)), np.ones(len(own), bool)
        best = total.argmax(axis=1)
        entropy = -total.max(axis=1) / np.maximum(own, 1)
        odds = np.exp(np.clip(self.slope * (total - total.max(axis=1, keepdims=True)), -700, 0))
        some = own > 0
        score = np.where(some, 1 / odds.sum(axis=1), 0.0)
        return [self.langs[b] if s else "und" for b, s in zip(best, some)], score, ~some | (entropy > self.limit)


def totals_of(block: list[tuple[int, KneserNey]], languages: int, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A block's share of the log-probability of each text in each language, and the letters and spaces that each has."""
    code, own = grams(*symbols(texts))
    out = np.zeros((len(texts), languages))
    if len(code) and languages:
        distinct, index = compact(code)
        table = np.zeros((len(distinct), languages), np.float32)
        for lang, part in block:
            table[:, lang] += part.log_prob(distinct)
        full = own > 0
        at = (np.cumsum(own) - own)[full]
        out[full] = np.add.reduceat(table[index], at, axis=0, dtype=np.float64)
    return out, own


def block_plan(sizes: list[tuple[str, int, int]], most: int) -> list[list[tuple[str, int, int]]]:
    """Blocks of (language, first letter, last letter) from sorted (language, letter, n-grams); a block holds ``most`` n-grams, or one letter."""
    out, held = [], 0
    for lang, letter, n in sizes:
        if not out or held + n > most:
            out.append([])
            held = 0
        own = out[-1]
        if own and own[-1][0] == lang:
            own[-1] = (lang, own[-1][1], letter)
        else:
            own.append((lang, letter, letter))
        held += n
    # Letters that no n-gram has belong to a part too: the parts of a language cover all.
    parts = [(k, i) for k, own in enumerate(out) for i in range(len(own))]
    for (k, i), after in zip(parts, [*parts[1:], None]):
        lang, low, _ = out[k][i]
        same = after is not None and out[after[0]][after[1]][0] == lang
        before = k > 0 and i == 0 and out[k - 1][-1][0] == lang
        out[k][i] = lang, low if before else 0, out[after[0]][after[1]][1] - 1 if same else (1 << _BITS) - 1
    return out


def models(docs: DataFrame, block_ngrams: int = BLOCK_NGRAMS, lang_col: str = "lang", text_col: str = "text") -> Identifier:
    """Learn from all rows of ``docs`` that have a language; what the driver holds at a time is a block."""
    spark, mask = docs.sparkSession, (1 << _BITS) - 1
    counts = written(ngram_counts(docs, lang_col, text_col), "ngrams")
    level, ones = counts, {}
    for order in range(ORDER, 0, -1):
        for r in level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect():
            ones.setdefault(r["lang"], [0.5] * ORDER)[order - 1] = discount_of(r["ones"], r["twos"])
        if order > 1:
            level = level.select("lang", F.col("code").bitwiseAND(F.lit((1 << _BITS * (order - 1)) - 1)).alias("code")).groupBy("lang", "code").agg(F.count("*").alias("n"))
    langs = sorted(ones)
    single: dict[str, list] = {lang: [] for lang in langs}
    for r in level.collect():  # at most 4096 letters of a language
        single[r["lang"]].append((r["code"], r["n"]))
    letter = F.shiftright("code", _BITS).bitwiseAND(F.lit(mask))
    sizes = sorted(tuple(r) for r in counts.groupBy("lang", letter.alias("letter")).count().collect())
    plan, blocks = block_plan(sizes, block_ngrams), []
    for own in plan:
        part = counts
        if len(plan) > 1:
            wanted = [(F.col("lang") == lang) & letter.between(low, high) for lang, low, high in own]
            part = counts.where(functools.reduce(lambda a, b: a | b, wanted))
        table = part.toArrow()
        lang_of, code, n = table.column("lang").combine_chunks(), table.column("code").to_numpy(), table.column("n").to_numpy()
        block = []
        for lang, low, high in own:
            mine = np.asarray(pc.equal(lang_of, lang))
            first = np.array(sorted(single[lang]), np.int64)
            block.append((langs.index(lang), KneserNey(code[mine], n[mine], ones[lang], (first[:, 0], first[:, 1]), (low, high) if len(plan) > 1 else (0, 1 << _BITS))))
        blocks.append(spark.sparkContext.broadcast(block))
    return Identifier(langs, blocks)


def totals(docs: DataFrame, found: Identifier, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, total (log-probability by language) and letters of every row.

    One block: no shuffle.  More: each in a pass of its own over numbered rows, and a join of the sums.
    """

    def share(sent, names: list[str]):
        languages = len(found.langs)

        def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = sent.value if sent else []
            for batch in batches:
                for part in sliced(batch, "bytes"):
                    total, own = totals_of(block, languages, part.column("bytes").to_pylist())
                    sums = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * languages), pa.array(total.ravel()))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), sums, pa.array(own)], [*names, "total", "letters"])

        return compute

    rows = docs.select(*keep, utf8(text_col).alias("bytes"))
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    if len(found.blocks) < 2:
        return rows.mapInArrow(share(found.blocks[0] if found.blocks else None, keep), f"{kinds}total array<double>, letters long")
    rows = written(rows.withColumn("tidemark_row_", F.monotonically_increasing_id()), "numbered")
    out = rows.mapInArrow(share(found.blocks[0], [*keep, "tidemark_row_"]), f"{kinds}tidemark_row_ long, total array<double>, letters long")
    for sent in found.blocks[1:]:
        more = written(rows.mapInArrow(share(sent, ["tidemark_row_"]), "tidemark_row_ long, more array<double>, letters long").drop("letters"), "totals")
        out = written(out.join(more, "tidemark_row_").withColumn("total", F.zip_with("total", "more", lambda a, b: a + b)).drop("more"), "totals")
    return out.select(*keep, "total", "letters")


def ranked(bits: DataFrame, k: int) -> int:
    """The number at place ``k`` (from 0) of the column ``bits`` (not negative), in order: its leading bits are counted first, then the next ones."""
    for shift in (44, 30, 15, 0):
        before = 0
        for r in sorted(bits.groupBy(F.shiftright("bits", shift).alias("own")).count().collect()):
            if before + r["count"] > k:
                break
            before += r["count"]
        bits, k = bits.where(F.shiftright("bits", shift) == r["own"]), k - before
    return r["own"]


def calibrated(found: Identifier, scored: DataFrame, lang_col: str = "lang") -> Identifier:
    """``found`` with temperature and limit from all rows of ``scored`` (language, total, letters) that have a language and a letter."""
    langs = found.langs

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column("letters"))
            total = np.asarray(batch.column("total").flatten()).reshape(len(own), -1)
            truth = np.array([langs.index(x) for x in batch.column("lang").to_pylist()], np.int64)
            true = total[np.arange(len(own)), truth]
            gap, best = total - total.max(axis=1, keepdims=True), true - total.max(axis=1)
            loss = [np.floor((np.log(np.exp(np.clip(s * gap, -700, 0)).sum(axis=1)) - s * best) * LOSS_UNIT).astype(np.int64) for s in SLOPES]
            losses = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(SLOPES)), pa.array(np.stack(loss, axis=1).ravel()))
            # The bits of positive doubles have the order of the numbers.
            yield pa.RecordBatch.from_arrays([pa.array((-true / own).view(np.int64)), losses], ["bits", "losses"])

    rows = scored.select(F.col(lang_col).alias("lang"), "total", "letters").where(F.col("lang").isin(langs) & (F.col("letters") > 0))
    rows = written(rows.mapInArrow(compute, "bits long, losses array<long>"), "calibration")
    sums = [F.sum(F.col("losses")[k].cast("decimal(38,0)")) for k in range(len(SLOPES))]
    n, *loss = rows.agg(F.count("*"), *sums).first()
    if n:
        found.slope = float(SLOPES[loss.index(min(loss))])
        found.limit = float(np.int64(ranked(rows.select("bits"), max(1, math.ceil(REJECT_QUANTILE * n)) - 1)).view(np.float64)) + REJECT_MARGIN
    return found


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", block_ngrams: int = BLOCK_NGRAMS) -> Identifier:
    """Learn from all rows of ``docs`` that have a language; temperature and limit come from all of them too."""
    found = models(docs, block_ngrams, lang_col, text_col)
    return calibrated(found, totals(docs, found, [lang_col], text_col), lang_col) if found.langs else found


def identify(docs: DataFrame, found: Identifier, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred, score and rejected for every row."""
    return decided(totals(docs, found, keep, text_col), found, keep)


def decided(scored: DataFrame, found: Identifier, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred, score and rejected for every row of ``scored`` (total and letters beside them)."""
    decide = Identifier(found.langs, [], found.slope, found.limit).decide

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column("letters"))
            lang, score, rejected = decide(np.asarray(batch.column("total").flatten()).reshape(len(own), -1), own)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*keep, "lang_pred", "score", "rejected"])

    kinds = "".join(f"`{c}` {scored.schema[c].dataType.simpleString()}, " for c in keep)
    return scored.select(*keep, "total", "letters").mapInArrow(compute, f"{kinds}lang_pred string, score double, rejected boolean")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the language of all documents, learned outside the held-out fold."""
    docs = documents(spark, sf_dir).withColumn("held_out", held_out())
    found = models(docs.where("not held_out"))
    scored = written(totals(docs, found, ["doc_id", "held_out", "lang"]), "totals")  # learned texts are scored once for both uses
    if found.langs:
        found = calibrated(found, scored.where("not held_out"))
    return decided(scored, found, ["doc_id", "held_out"])
