"""Phrase collocation mining after Toivonen: a sample proposes, full passes count exactly, until nothing can be missing.

A phrase is frequent if it occurs ``MIN_COUNT`` times in its language; then so do all its contiguous parts.

1. A ``SAMPLE`` share of the documents, chosen by a hash of their ids, is mined for words and pairs at the lowered threshold
   ``SAMPLE_COUNT``.  They are the proposal S.
2. A full pass counts S and its negative border, that is every occurring phrase whose proper parts all lie in S (every word,
   every pair of proposed words, every triple of proposed pairs), exactly.
3. A frequent word or pair outside S is a border failure: phrases that hold it weren't counted.  Then the frequent phrases
   known so far become S, and another pass counts those phrases that only now have all their parts in S.  The passes end when
   the border holds no frequent phrase.  There are as many as phrases have words, at most, besides the last.

S is asked through a bit table of its hashes, sized by its number of phrases up to ``MAX_BITS``, which is broadcast.  What it
lets through by chance is counted too and falls below the threshold or is frequent indeed: counts never depend on the table.
A phrase counted by an earlier pass is left out by asking the earlier tables, so nothing is counted twice.

In a task, texts are bytes: words get numbers from Arrow's dictionary of the batch's distinct words, phrases are pairs of
numbers, and only distinct phrases of a slice of about ``SLICE`` bytes leave it, with their counts; Spark adds these up before
and after the shuffle.  Scores come from joins of frequent phrases with themselves; all parts of one are there.

Null text is empty; null language is ``und``, together with the language of that name.  Ids serve the sample alone: null and
repeated ones do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, forget, parallelism, sliced, utf8, written

MIN_COUNT, MAX_WORDS = 10, 3
#: One document in so many is sampled; a phrase is proposed from this count on.
SAMPLE, SAMPLE_COUNT = 4, 2
#: Share of its occurrences, in percent, that a longer phrase takes to replace a shorter one.
ABSORBED = 50
TOP = 2000
#: Bits of the table for each phrase of S; the largest table holds 2**MAX_BITS.
BITS_EACH, MIN_BITS, MAX_BITS = 16, 16, 28
SLICE = 8 << 20
#: A language's candidates are ranked in so many groups before they meet.
GROUPS = 16

#: 0: part of a word, 1: between words, 2: between pieces.  Letters A-Z fold to lower case.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = pa.scalar(" ", pa.large_string())
_TAB = pa.scalar("\t", pa.large_string())


class Table:
    """Bit tables of words and of pairs, by hash: ``True`` for every member of S, and for few others."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray):
        self.bits = words, pairs

    def holds(self, level: int, hashes: np.ndarray) -> np.ndarray:
        bits = self.bits[level - 1]
        at = hashes >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
        return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first ^ (second << np.uint64(1) | second >> np.uint64(63))


def table_of(proposed: DataFrame) -> Table:
    """The bit tables of proposed words and pairs (columns lang, words, phrase)."""
    first, second = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    hashed = [F.xxhash64("lang", c) for c in (first, second)]
    turned = F.shiftleft(hashed[1], 1).bitwiseOR(F.shiftrightunsigned(hashed[1], 63))
    rows = proposed.where(F.col("words") < MAX_WORDS).select("words", F.when(F.col("words") == 1, hashed[0]).otherwise(hashed[0].bitwiseXOR(turned)).alias("h"))
    sizes = {r.words: r["count"] for r in rows.groupBy("words").count().collect()}
    found = []
    for level in range(1, MAX_WORDS):
        bits = min(MAX_BITS, max(MIN_BITS, (BITS_EACH * sizes.get(level, 0)).bit_length()))
        at = F.shiftrightunsigned("h", 64 - bits)
        words = rows.where(F.col("words") == level).groupBy(F.shiftright(at, 6).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))).alias("w")).toArrow()
        table = np.zeros(1 << bits - 6, np.int64)
        table[words.column("i").to_numpy()] = words.column("w").to_numpy()
        found.append(table.astype("<i8").view(np.uint8))
    return Table(*found)


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of a binary column of texts: its distinct words, the words' numbers in order, and the piece that each stands in."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    kind = _KIND[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind == 0
    texts = np.zeros(len(data) + 1, bool)
    texts[offsets - offsets[0]] = True
    begins = np.flatnonzero(inside[1:-1] & (~inside[:-2] | texts[:-1]))
    stops = np.flatnonzero(inside[1:-1] & (~inside[2:] | texts[1:]))
    piece = np.searchsorted(np.flatnonzero(kind == 2), begins) + np.searchsorted(offsets - offsets[0], begins, "right")
    letters = _FOLD[data[inside[1:-1]]]
    ends = np.concatenate([[0], np.cumsum(stops - begins + 1)])
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices).astype(np.int64), piece


def _tallied(lang: str, column: pa.Array, levels: int, tables: list[Table]) -> Iterator[pa.RecordBatch]:
    """Counts of the slice's phrases of at most ``levels`` words that the last table admits and no earlier one did."""
    words, ids, piece = words_of(column)
    if not len(ids):
        return
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, seed) for w in words.to_pylist()), np.uint64, len(words))
    names = words.cast(pa.large_string())
    keyed = pc.binary_join_element_wise(pa.scalar(lang, pa.large_string()), names, _TAB)

    def batch(keys, counts):
        return pa.record_batch([keys.cast(pa.string()), pa.array(counts)], ["key", "a"])

    if len(tables) <= 1:  # the first pass over these texts counts every word
        yield batch(pa.array([f"{lang}\t"]), np.array([len(ids)]))
        yield batch(keyed, np.bincount(ids, minlength=len(words)))
    if levels < 2 or not tables:
        return
    known = [t.holds(1, hashes) for t in tables]
    near = np.flatnonzero(piece[:-1] == piece[1:])
    near = near[known[-1][ids[near]] & known[-1][ids[near + 1]]]
    # Pairs that the newest table admits; those that an earlier table admitted are counted already, but triples need them.
    keys, at, counts = np.unique(ids[near] << 32 | ids[near + 1], return_inverse=True, return_counts=True)
    left, right = keys >> 32, keys & 0xFFFFFFFF
    fresh = ~np.logical_or.reduce([k[left] & k[right] for k in known[:-1]]) if len(known) > 1 else np.ones(len(keys), bool)
    if fresh.any():
        yield batch(pc.binary_join_element_wise(keyed.take(pa.array(left[fresh])), names.take(pa.array(right[fresh])), _SPACE), counts[fresh])
    if levels < 3 or not len(keys):
        return
    mixed = pair_hash(hashes[left], hashes[right])
    linked = [t.holds(2, mixed) & k[left] & k[right] for t, k in zip(tables, known)]
    follows = np.flatnonzero((near[:-1] + 1 == near[1:]) & linked[-1][at[:-1]] & linked[-1][at[1:]])
    triples, counts = np.unique(at[follows] << 32 | at[follows + 1], return_counts=True)
    first, second = triples >> 32, triples & 0xFFFFFFFF
    if len(linked) > 1:
        fresh = ~np.logical_or.reduce([p[first] & p[second] for p in linked[:-1]])
        first, second, counts = first[fresh], second[fresh], counts[fresh]
    if len(counts):
        yield batch(pc.binary_join_element_wise(keyed.take(pa.array(left[first])), names.take(pa.array(right[first])), names.take(pa.array(right[second])), _SPACE), counts)


def tally(texts: DataFrame, levels: int, tables: list, least: int) -> DataFrame:
    """Exact counts from ``least`` on, by language, of the phrases that the newest of the broadcast ``tables`` admits: lang, words (0: all words), phrase, a."""

    def work(batches):
        held = [t.value for t in tables]
        for batch in batches:
            for part in sliced(batch, "text", SLICE):
                langs = part.column("lang").dictionary_encode()
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    yield from _tallied(lang, part.column("text").filter(pc.equal(langs.indices, k)), levels, held)

    # One short key, as nearly all rows of the shuffle are phrases that occur once: a phrase holds no tab, so the last one ends the language.
    counted = texts.mapInArrow(work, "key string, a long").groupBy("key").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | F.endswith("key", F.lit("\t")))
    phrase = F.substring_index("key", "\t", -1)
    words = F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1)
    return counted.select(F.expr("substr(key, 1, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang"), words.cast("int").alias("words"), phrase.alias("phrase"), "a")


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", min_count: int = MIN_COUNT) -> tuple[DataFrame, int]:
    """All phrases of up to three words with ``min_count`` occurrences in their language, each language's number of words (words = 0), and the passes."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), utf8(text).alias("text"))
    sample = docs.where(F.pmod(F.xxhash64(doc_id), F.lit(SAMPLE)) == 0).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), utf8(text).alias("text"))
    share = spark.sparkContext.broadcast

    single = written(tally(sample, 1, [], SAMPLE_COUNT).where("words = 1"), "sample-words")
    guess = share(table_of(single))
    double = written(tally(sample, 2, [guess], SAMPLE_COUNT).where("words = 2"), "sample-pairs")
    proposal = single.unionByName(double)
    tables = [share(table_of(proposal))]
    known, made = None, [single, double]
    while True:
        counted = written(tally(texts, MAX_WORDS, tables, min_count), "phrases")
        made.append(counted)
        known = counted if known is None else known.unionByName(counted)
        failures = known.where(F.col("words").between(1, MAX_WORDS - 1)).join(proposal, ["lang", "words", "phrase"], "left_anti")
        if failures.isEmpty():
            break
        proposal = known.where(F.col("words").between(1, MAX_WORDS - 1))
        tables.append(share(table_of(proposal)))
    guess.destroy()
    for t in tables:
        t.destroy()
    for t in made[:2]:
        forget(t)
    return known, len(tables)


def collocations(known: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Candidates among frequent phrases, with their lowest-scoring cut, less those that a longer one absorbs: lang, phrase, a, l, r, score."""
    phrases = known.where(F.col("words") >= 1).select("lang", "words", "phrase", "a")
    candidates = phrases.where((F.col("words") >= 2) & (F.col("a") >= min_count))
    counts = phrases.where(F.col("words") < MAX_WORDS)
    first, last = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    front, back = F.substring_index("phrase", " ", 2), F.expr("substr(phrase, length(substring_index(phrase, ' ', 1)) + 2)")

    def part(key: str, value: str) -> DataFrame:
        return counts.select("lang", F.col("phrase").alias(key), F.col("a").alias(value))

    def score(left: str, right: str):
        wide = [F.col(c).cast("decimal(15,0)") for c in ("a", left, right)]
        return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide[0] * wide[0], wide[1] * wide[2])

    one = candidates.withColumns({"x": first, "y": back}).join(part("x", "l"), ["lang", "x"]).join(part("y", "r"), ["lang", "y"]).withColumn("score", score("l", "r")).drop("x", "y")
    threes = one.where(F.col("words") == MAX_WORDS).withColumns({"x": front, "y": last})
    two = threes.join(part("x", "l2"), ["lang", "x"]).join(part("y", "r2"), ["lang", "y"]).withColumn("score2", score("l2", "r2"))
    lower = F.col("score2") < F.col("score")
    triples = two.select("lang", "words", "phrase", "a", *[F.when(lower, F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in ("l", "r", "score")])
    inside = candidates.where(F.col("words") == MAX_WORDS).select("lang", F.explode(F.array(front, back)).alias("phrase"), F.col("a").alias("longer"))
    longest = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    pairs = one.where(F.col("words") == 2).join(longest, ["lang", "phrase"], "left")
    pairs = pairs.where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < ABSORBED * F.col("a").cast("decimal(20,0)")))
    return pairs.select("lang", "phrase", "a", "l", "r", "score").unionByName(triples.select("lang", "phrase", "a", "l", "r", "score"))


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top``: in ``GROUPS`` groups by hash, each cut to its first ``top``, then together."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    grouped = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS)))
    some = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest collocations of each language of ``documents``."""
    known, _ = frequent(documents(spark, sf_dir))
    total = known.where(F.col("words") == 0).groupBy("lang").agg(F.max("a").alias("n"))
    return ranked(collocations(known)).join(F.broadcast(total) if total.limit(1001).count() <= 1000 else total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The letters that are folded.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM docs),
lists AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
grams AS (
  SELECT lang, 1 AS k, w[i] AS phrase FROM places
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM places WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM places WHERE i + 2 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= {MIN_COUNT}),
cuts AS (
  SELECT lang, k, phrase, a, 1 AS cut, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM c
  UNION ALL SELECT lang, k, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
scored AS (
  SELECT cuts.*, fx.a AS l, fy.a AS r, (1000000::HUGEINT * cuts.a * cuts.a) // (fx.a::HUGEINT * fy.a) AS score
  FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, p, max(a) AS longer FROM (
  SELECT lang, a, w[1] || ' ' || w[2] AS p FROM c WHERE k = 3 UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND best.k = 2 AND inside.p = best.phrase WHERE longer IS NULL OR 100 * longer < {ABSORBED} * best.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM r JOIN totals USING (lang) WHERE rank <= {TOP}
"""
