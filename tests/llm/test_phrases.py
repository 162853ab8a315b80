"""Collocations against a plain count of all phrases, over several passes and awkward texts."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers
from tidemark.llm import phrases


def counts(rows):
    found = defaultdict(Counter)
    for lang, text in rows:
        own = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", own):
            words = re.findall(rb"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    found[lang or "und"][b" ".join(words[i : i + k])] += 1
    return found


def expected(rows, top=phrases.TOP, least=phrases.MIN_COUNT):
    out = set()
    for lang, f in counts(rows).items():
        n = sum(c for p, c in f.items() if b" " not in p)
        kept = []
        for p, a in f.items():
            words = p.split(b" ")
            if len(words) < 2 or a < least:
                continue
            cuts = [(10**6 * a * a // (f[b" ".join(words[:k])] * f[b" ".join(words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            longer = [c for q, c in f.items() if c >= least and q.count(b" ") == 2 and len(words) == 2 and (q.split(b" ")[:2] == words or q.split(b" ")[1:] == words)]
            if not any(100 * c >= 50 * a for c in longer):
                kept.append((-score, -a, p, f[b" ".join(words[:k])], f[b" ".join(words[k:])]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n, -score))
    return out


def table(spark, rows, ids=None, parts=3):
    rows = [(i if ids is None else ids[i], t, lang, "s", 1, 2, 3) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, words int, a long, phrase int").repartition(parts)


def got(docs, **more):
    known, passes = phrases.frequent(docs, **more)
    total = known.where("words = 0").select("lang", F.col("a").alias("n"))
    found = phrases.ranked(phrases.collocations(known)).join(total, "lang")
    return {tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}, passes


def corpus(seed, docs=160, words=40):
    pick = random.Random(seed)
    known = ["New York City", "a", "b", "the", "é ü", "machine  learning", "x\ty", "in the", "no, end"] + [f"w{i}" for i in range(30)]
    return [(pick.choice(["en", "en", "fr", None, "und"]), " ".join(pick.choice(known) + pick.choice([" ", " ", ". ", "\n", "; "]) for _ in range(words))) for _ in range(docs)]


def test_equals_plain_counts(spark):
    rows = corpus(1) + [("en", t) for t in helpers.AWKWARD] + [("en", "a a a a " * 30), ("en", "."), (None, None), ("zz", "")]
    found, _ = got(table(spark, rows))
    assert found == expected(rows)


def test_border_failures_are_expanded(spark):
    """What the sample can't show, as all its documents lack it, is found by further passes."""
    ids = list(range(400))
    sampled = {r.i for r in spark.createDataFrame([(i,) for i in ids], "i long").where(F.pmod(F.xxhash64("i"), F.lit(phrases.SAMPLE)) == 0).collect()}
    rows = [("en", "plain words in here" if i in sampled else f"red herring soup {i % 3} plain red herring") for i in ids]
    found, passes = got(table(spark, rows, ids))
    assert found == expected(rows) and passes == 3
    assert any(p == "red herring soup" for _, _, p, *_ in found)


def test_long_texts_slices_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 500)
    rows = corpus(2, 60) + [("en", "one two three. " * 5000)]
    found, _ = got(table(spark, rows, [None] * 30 + [7] * 31))
    assert found == expected(rows)


def test_full_tables_change_nothing(spark, monkeypatch):
    """A saturated bit table lets everything through, and the counts stay exact."""
    monkeypatch.setattr(phrases, "MIN_BITS", 6)
    monkeypatch.setattr(phrases, "MAX_BITS", 6)
    rows = corpus(3, 60)
    assert got(table(spark, rows))[0] == expected(rows)


def test_empty_table(spark):
    assert got(table(spark, [])) == (set(), 1)


@pytest.mark.parametrize("scale", ["sf0.001"])
def test_query_equals_sql(spark, scale):
    folder = f"/root/testdata/{scale}"
    found = {tuple(r) for r in phrases.op11_phrase_collocations(spark, folder).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    con.execute("CREATE TABLE own AS " + phrases.ORACLE_SQL)
    assert found == set(con.execute("SELECT lang, rank, phrase, a, l, r, n, score FROM own").fetchall()) and len(found) > 100
