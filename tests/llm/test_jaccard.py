import random

import pytest

from tests.llm.helpers import AWKWARD, documents
from tidemark.llm import common
from tidemark.llm import simhash as module


def _set(text, words=5):
    own = (text or "").lower().split()
    return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def _similar(a, b):
    both, either = len(_set(a) & _set(b)), len(_set(a) | _set(b))
    return 5 * both >= 4 * either


def _texts(seed=5):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = list(AWKWARD)
    for n in (12, 40, 120, 300):
        for _ in range(8):
            base = [r.choice(vocabulary) for _ in range(n)]
            texts.append(" ".join(base))
            for edits in (1, 2, 3, 5):
                own = list(base)
                for at in r.sample(range(n), min(edits, n)):
                    own[at] = r.choice(vocabulary)
                texts.append(" ".join(own))
    frame = [r.choice(vocabulary) for _ in range(200)]  # a cluster of near copies, and texts that share half of it
    texts += [" ".join([*frame, f"n{k}"]) for k in range(40)]
    texts += [" ".join([*frame[:100], *(r.choice(vocabulary) for _ in range(100))]) for _ in range(20)]
    r.shuffle(texts)
    return texts


def _components(texts):
    """Least index of each component of all pairs of similarity 0.8, by brute force."""
    sets, root = [_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


def test_representatives_equal_brute_force(spark):
    texts = _texts()
    root = _components(texts)
    kept = {r.doc_id for r in module.similar_representatives(documents(spark, texts)).select("doc_id").collect()}
    assert set(root) <= kept and len(kept - set(root)) <= 3 and len(set(root)) < len(texts) - 40


def test_repeated_lines_hide_no_pairs(spark):
    """Texts of different pairs may have equal fingerprints, from a line that fills most of each."""
    r = random.Random(8)
    line = "the same line comes again and again "
    texts = []
    for k in range(20):
        own = [f"w{r.randrange(10**6)}" for _ in range(60)]
        texts += [line * 60 + " ".join(own), line * 60 + " ".join([*own, f"z{k}"])]
    kept = {r.doc_id for r in module.similar_representatives(documents(spark, texts)).select("doc_id").collect()}
    assert kept == set(range(0, 40, 2))


def test_recall_by_similarity(spark):
    """Single pairs, with no cluster to help: at least 0.9 of those at similarity 0.8, and 0.97 of those from 0.85 on, are found."""
    r = random.Random(9)
    texts, level = [], []
    for share in (0.81, 0.85, 0.9, 0.95):
        for words in (60, 300):
            for _ in range(100):
                own = [f"w{r.randrange(10**6)}" for _ in range(words)]
                shingles = words - 4
                lost = int(shingles * (1 - 2 * share / (1 + share)))  # shingles that one run of new words at the end costs
                texts += [" ".join(own), " ".join([*own[: words - lost], *(f"x{r.randrange(10**6)}" for _ in range(lost))])]
                level.append(share)
    similar = [_similar(texts[2 * k], texts[2 * k + 1]) for k in range(len(level))]
    kept = {r.doc_id for r in module.similar_representatives(documents(spark, texts)).select("doc_id").collect()}
    assert all(2 * k in kept for k in range(len(level)))
    for share, least in ((0.81, 0.9), (0.85, 0.97), (0.9, 0.97), (0.95, 0.97)):
        own = [k for k in range(len(level)) if level[k] == share and similar[k]]
        assert len(own) > 100 and sum(2 * k + 1 not in kept for k in own) >= least * len(own)
    assert not [k for k in range(len(level)) if not similar[k] and 2 * k + 1 not in kept]


def test_large_group_of_copies_gives_few_pairs(spark):
    r = random.Random(10)
    own = [f"w{k}" for k in range(200)]
    texts = [" ".join([*own[:at], f"n{k}", *own[at + 1 :]]) for k in range(1500) for at in [r.randrange(200)]]
    docs = documents(spark, texts)
    rows = module.named(docs, 5, "doc_id", "text")
    found = module.bands.to_leaders(module.bands.entries(rows.select("node", "fp", "bands")))
    assert found.select("node", "other").distinct().count() < 30 * len(texts)
    assert module.similar_representatives(docs).count() == 1


def test_links_are_similar(spark):
    docs = documents(spark, _texts())
    rows = module.named(docs, 5, "doc_id", "text")
    text = {module.jaccard.node_of((t or "").encode().lower().split()): t for t in _texts()}
    links = module.similar_links(docs, rows).collect()
    assert len(links) > 40 and all(_similar(text[x.a], text[x.b]) for x in links)


def test_repeated_and_null_ids(spark):
    docs = documents(spark, ["a b c d e f g", "A B  c d e f g", "other words are in this one", None, ""])
    doubled = docs.unionByName(docs)
    kept = module.similar_representatives(doubled)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    assert module.similar_representatives(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [16, 4096])
def test_every_pair_of_similarity_four_fifths_counts(spark, block):
    """No pair is left to chance: near the limit bands miss some, and members of a key that share only their leader's frame."""
    r = random.Random(12)
    texts = _texts()
    for words in (30, 60, 300):
        for _ in range(150):
            own = [f"w{r.randrange(10**6)}" for _ in range(words)]
            lost = int((words - 4) / 9)  # shingles that new words at the end cost, for a similarity of 0.8
            texts += [" ".join(own), " ".join([*own[: words - lost], *(f"x{r.randrange(10**6)}" for _ in range(lost))])]
    # Pairs that share three quarters with all others of their group, so that one leader stands for all.
    for words in (100, 200):
        frame = [f"v{r.randrange(10**6)}" for _ in range(words)]
        for _ in range(40):
            tail = [f"y{r.randrange(10**6)}" for _ in range(words // 3)]
            texts += [" ".join([*frame, *tail]), " ".join([*frame, *tail[: len(tail) // 2], *(f"z{r.randrange(10**6)}" for _ in range(len(tail) // 3))])]
    docs = documents(spark, texts)
    rows = module.written(module.named(docs, 5, "doc_id", "text"), "fingerprints")
    links = module.written(module.similar_links(docs, rows, block=block), "links")
    kept = {x.doc_id for x in module.jaccard.kept(docs, rows.select("id", "node"), module.components(links)).select("doc_id").collect()}
    assert kept == set(_components(texts))


def test_a_common_passage_gives_no_row_for_every_two_texts(spark, monkeypatch):
    """Unlike texts that share a passage which the sample for the order doesn't show: rows grow with the texts, not with their square."""
    monkeypatch.setattr(module.prefixes, "SAMPLE_TEXTS", 0)
    r = random.Random(13)
    frame = [f"v{r.randrange(10**6)}" for _ in range(100)]
    texts = [" ".join([*frame, *(f"w{r.randrange(10**6)}" for _ in range(35))]) for _ in range(300)]
    texts += [texts[7] + " end"]
    docs = documents(spark, texts)
    rows = module.written(module.named(docs, 5, "doc_id", "text"), "fingerprints")
    made = len(common.MADE)
    module.similar_links(docs, rows).count()
    count = {p.rsplit("/", 1)[1].rsplit("-", 1)[0]: spark.read.parquet(p).count() for p in common.MADE[made:] if "/met-" in p or "/rest-pairs-" in p}
    assert count["met"] <= 40 * len(texts) and count["rest-pairs"] <= len(texts)


def test_marks_never_leave_out_a_similar_pair():
    """Pairs of similarity 4/5 just so, of sizes that give marks of equal and of different widths; unlike ones mostly go."""
    import numpy as np

    r, kept, unlike = np.random.default_rng(14), 0, 0
    for n in (1, 4, 9, 45, 90, 92, 181, 300, 724, 3000, 30_000):
        for cut in (0, n // 9, n // 5):  # what the other set lacks; it gains as many as similarity 4/5 allows
            a = np.unique(r.integers(-(1 << 63), 1 << 63, n, dtype=np.int64))
            more = 5 * (n - cut) // 4 - n
            b = np.unique(np.concatenate([a[: n - cut], r.integers(-(1 << 63), 1 << 63, max(more, 0), dtype=np.int64)]))
            c = np.unique(r.integers(-(1 << 63), 1 << 63, n, dtype=np.int64))
            assert module.jaccard.similar(a, b)
            marks = module.prefixes.Marks([module.prefixes.marks_of(x) for x in (a, b, c)])
            size = np.array([len(x) << 32 for x in (a, b, c)])
            near = marks.near(np.array([0, 1, 0]), np.array([1, 0, 2]), size)
            assert near[0] and near[1]
            kept, unlike = kept + near[2], unlike + 1
    assert kept <= unlike // 8


def test_a_large_group_just_below_four_fifths_gives_few_rows(spark, monkeypatch):
    """Every two of 300 texts have similarity 0.78: too near for marks, too far for links.  Rows grow with the texts, and links are found among them."""
    monkeypatch.setattr(module.prefixes, "SAMPLE_TEXTS", 0)
    r = random.Random(15)
    frame = [f"v{r.randrange(10**6)}" for _ in range(176)]
    tails = [[f"w{r.randrange(10**6)}" for _ in range(24)] for _ in range(300)]
    texts = [" ".join([*frame, *tail]) for tail in tails]
    texts += [" ".join([*frame, *tail[: 4 * k], *(f"x{r.randrange(10**6)}" for _ in range(24 - 4 * k))]) for k in (1, 2, 3, 4) for tail in tails[10 * k : 10 * k + 5]]
    docs = documents(spark, texts)
    rows = module.written(module.named(docs, 5, "doc_id", "text"), "fingerprints")
    made = len(common.MADE)
    links = module.written(module.similar_links(docs, rows), "links")
    rest = [spark.read.parquet(p).count() for p in common.MADE[made:] if "/rest-pairs-" in p]
    kept = {x.doc_id for x in module.jaccard.kept(docs, rows.select("id", "node"), module.components(links)).select("doc_id").collect()}
    assert kept == set(_components(texts)) and len(kept) < len(texts)
    assert len(rest) == 1 and rest[0] <= 10 * len(texts) and links.count() <= 10 * len(texts)
