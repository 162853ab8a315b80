import random

import pytest

from tests.llm.helpers import AWKWARD, documents, removed
from tidemark.llm import suffixes


def _texts(seed):
    r = random.Random(seed)
    some = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    base, texts = [some(r.randint(30, 200)) for _ in range(12)], []
    for _ in range(90):
        s = ""
        for _ in range(r.randint(0, 6)):
            b = r.choice(base)
            i = r.randrange(len(b))
            s += b[i : r.randint(i, len(b))] if r.random() < 0.8 else some(r.randint(0, 60))
        texts.append(s)
    return texts + [t if t is None else t[:2000] for t in AWKWARD] + texts[3:5]


@pytest.mark.parametrize(("window", "hot"), [(40, 4096), (40, 2), (24, 4096)])
def test_removals_equal_brute_force(spark, window, hot):
    texts = _texts(window)
    got = sorted(suffixes.removals(documents(spark, texts, 5), window, hot, short=16).collect())
    own = [(t or "").encode() for t in texts]
    assert [tuple(g)[1:5] for g in got] == removed(own, window)
    assert [g.n_repeated for g in got] == [r[1] for r in removed(own, 16)]
    if hot > 2:
        alone = sorted(suffixes.removals(documents(spark, texts, 5), window, hot, short=window).collect())
        assert [tuple(g)[:5] for g in alone] == [tuple(g)[:5] for g in got] and all(g.n_removed == g.n_repeated for g in alone)


def test_repeated_rows_and_null_ids_are_copies_of_each_other(spark):
    text = "".join(random.Random(4).choice("abcdefgh") for _ in range(120))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "z" + text), (None, "alone in here"), (2, None)], "doc_id long, text string")
    got = suffixes.removals(docs, 40, short=20).collect()
    assert sorted((g.n_bytes, g.n_removed, g.n_repeated) for g in got) == [(0, 0, 0), (13, 0, 0), (120, 120, 120), (120, 120, 120), (121, 120, 120)]


def test_text_column_loses_what_repeats_and_keeps_the_rest(spark):
    shared = "".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    docs = documents(spark, ["head " + shared, shared + " tail", "alone", None])
    got = {r.doc_id: r.text for r in suffixes.deduplicated(docs).collect()}
    assert got == {0: "head ", 1: " tail", 2: "alone", 3: None}
    assert suffixes.deduplicated(docs).columns == docs.columns


def test_empty_table(spark):
    assert suffixes.removals(documents(spark, ["a"]).limit(0)).count() == 0


def test_loser_tree_merges_with_common_prefixes():
    r = random.Random(3)
    runs = []
    for _ in range(5):
        own = sorted("".join(r.choice("ab") for _ in range(r.randint(0, 9))).encode() for _ in range(r.randint(0, 30)))
        shared, _ = suffixes.front_coded(own)
        runs.append(list(zip(own, shared.tolist())))
    out = [(runs[i][j][0], p) for i, j, p in suffixes.LoserTree(runs)]
    assert [s for s, _ in out] == sorted(s for run in runs for s, _ in run)
    assert all(p == suffixes.common_prefix(a[0], b) for a, (b, p) in zip(out, out[1:]))


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 300)
    r = random.Random(8)
    long = "".join(r.choice("abcd") for _ in range(3000))
    texts = [long, "x" + long[500:1500], long[2000:2100]]
    import numpy as np

    data = texts[0].encode()
    whole = suffixes.stretches(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 40)
    starts = set()
    for own, _, at, base in suffixes._pieces(np.array([0, len(data)]), 40):
        _, pos, _, _ = suffixes.stretches(np.frombuffer(data[at : at + int(own[-1])], np.uint8), own, 40)
        s1, _, more = suffixes._unpack(pos)
        starts |= {base + s + k for s, m in zip(s1.tolist(), more.tolist()) for k in range(m + 1)}
    assert starts == set(range(len(data) - 39)) and len(whole[0])
