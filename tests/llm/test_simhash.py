import random

import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, documents, linked, simhash
from tidemark.llm import simhash as module
from tidemark.llm.components import components


def _texts():
    r = random.Random(4)
    base = [" ".join("".join(r.choice("abcdefg") for _ in range(r.randint(1, 6))) for _ in range(60)) for _ in range(12)]
    texts = []
    for _ in range(90):
        words = r.choice(base).split()
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = "zz"
        texts.append(" ".join(words))
    return texts + AWKWARD


def test_fingerprints_and_components_equal_brute_force(spark):
    texts = _texts()
    prints = [simhash(t) for t in texts]
    got = sorted(module.near_duplicates(documents(spark, texts)).collect())
    assert [g.fingerprint for g in got] == [f"{p:016x}" for p in prints]
    assert [g.component_id for g in got] == linked(prints, list(range(len(texts))))


def test_one_row_of_each_component_stays(spark):
    texts = _texts()
    docs = documents(spark, texts)
    want = sorted(set(linked([simhash(t) for t in texts], list(range(len(texts))))))
    kept = module.representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want
    twice = module.representatives(docs.unionByName(docs))
    assert sorted(r.doc_id for r in twice.collect()) == want


@pytest.mark.parametrize(("groups", "limit"), [(6, 8192), (8, 8192), (6, 3)])
def test_links_of_dense_clusters(spark, groups, limit):
    r, prints = np.random.default_rng(0), set()
    for base in r.integers(0, 2**63, 4):
        for _ in range(40):
            x = int(base)
            for k in r.integers(0, 64, r.integers(0, 5)):
                x ^= 1 << int(k)
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = module.links(spark.createDataFrame([(s,) for s in signed], "fp long"), groups, 4, limit)
    root = {r.node: r.root for r in components(edges).collect()}
    want, seen = linked(prints, list(range(len(prints)))), {}
    assert all(seen.setdefault(w, root.get(s, s)) == root.get(s, s) for w, s in zip(want, signed))
    assert len(set(seen.values())) == len(set(want))


def test_manhattan_distance_is_a_lower_bound(spark):
    r = random.Random(2)
    rows = [(r.getrandbits(63), r.getrandbits(63)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", module.unary_popcounts(module.F.col("a")).alias("x"), module.unary_popcounts(module.F.col("b")).alias("y"))
    for a, b, x, y in df.collect():
        want = sum(abs((a >> 2 * s & 3).bit_count() - (b >> 2 * s & 3).bit_count()) for s in range(32))
        assert ((x ^ y) & ((1 << 64) - 1)).bit_count() == want <= (a ^ b).bit_count()


def test_empty_table(spark):
    assert module.near_duplicates(documents(spark, ["a"]).limit(0)).count() == 0


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 3)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100}
