import itertools
import math
import random
import tracemalloc
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, documents
from tidemark.llm import brown, decontaminate, langid, toxicity

SF = "/root/testdata/sf0.01"


def test_symbols_equal_brute_force():
    r = random.Random(2)
    for _ in range(200):
        texts = ["".join(r.choice("aB É日1. \n") for _ in range(r.randint(0, 8))) for _ in range(4)]
        flat, ends = langid.symbols([t.encode() for t in texts])
        at = 0
        for t, end in zip(texts, ends):
            low = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in t.lower())
            want = [0, 0, 0, *(int(langid._symbols()[ord(c)]) for c in " ".join(low.split())), 0] if low.strip() else []
            assert flat[at:end].tolist() == want
            at = end


def test_kneser_ney_is_a_distribution():
    flat, ends = langid.symbols([b"abra cadabra abraca", b"cad abra"])
    code, _ = langid.grams(flat, ends)
    distinct, index = langid.compact(code)
    model = langid.KneserNey(distinct, np.bincount(index))
    seen = np.unique(code & 0xFFF)
    for context in np.unique(code >> 12)[:5]:
        total = np.exp(model.log_prob((context << 12) | seen)).sum()
        assert 0.95 < total < 1  # the rest is for letters never seen


def _kneser_ney(texts, order=4):
    """log p(letter | letters before) of interpolated Kneser-Ney with one discount for each order, from dictionaries."""
    pad = [0] * (order - 1)
    seqs = []
    for t in texts:
        flat, ends = langid.symbols([t.encode()])
        seqs.append(flat.tolist())
    counts = [None] * (order + 1)
    counts[order] = Counter(tuple(s[i - order + 1 : i + 1]) for s in seqs for i in range(order - 1, len(s)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount = [0] * (order + 1)
    for k in range(1, order + 1):
        discount[k] = langid.discount_of(sum(n == 1 for n in counts[k].values()), sum(n == 2 for n in counts[k].values()))

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        own = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        return max(own.get(gram, 0) - discount[k], 0) / total + discount[k] * len(own) / total * p(gram[1:])

    return lambda text: sum(math.log(p(tuple(s[i - order + 1 : i + 1]))) for s in [langid.symbols([text.encode()])[0].tolist()] for i in range(order - 1, len(s)))


def test_totals_and_predictions_equal_brute_force_in_one_block_and_in_many(spark):
    own = {"aa": ["abra cadabra", "cad abra bar", "abac 12"], "bb": ["zyx wvu xyz", "ABRA zy", "xyzzy vwx"]}
    rows = [(i, lang, t) for i, (lang, t) in enumerate((lang, t) for lang, ts in own.items() for t in ts)]
    docs = spark.createDataFrame([*rows, (90, "cc", "123"), (91, "dd", None), (92, None, "abra"), (93, "aa", "")], "doc_id long, lang string, text string").repartition(3)
    new = ["abra", "xyz", "kqj", "cad zyx"]
    asked = spark.createDataFrame(list(enumerate(new)), "doc_id long, text string")
    truth = [_kneser_ney(own[k]) for k in ("aa", "bb")]
    for block in (1 << 22, 7):
        found = langid.learn(docs, block_ngrams=block)
        assert found.langs == ["aa", "bb"] and (len(found.blocks) > 2) == (block == 7)
        got = {r.doc_id: r.total for r in langid.totals(asked, found, ["doc_id"]).collect()}
        predicted = {r.doc_id: r.lang_pred for r in langid.identify(asked, found, ["doc_id"]).collect()}
        for i, t in enumerate(new):
            want = [f(t) for f in truth]
            assert np.allclose(got[i], want, rtol=1e-4)
            assert predicted[i] == ("aa", "bb")[int(np.argmax(want))]


def test_languages_of_held_out_texts(spark):
    rows = langid.op5_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_texts_have_a_defined_language(spark):
    docs = documents(spark, AWKWARD)
    got = {r.doc_id: r for r in langid.identify(docs, langid.learn(docs), ["doc_id"]).collect()}
    assert [got[i].lang_pred for i, t in enumerate(AWKWARD) if not any(c.isalpha() for c in t or "")] == ["und"] * 4
    nothing = docs.limit(0)
    assert langid.identify(docs, langid.learn(nothing), ["doc_id"]).where("lang_pred <> 'und' or score <> 0").count() == 0


def _accuracy(machine, rows, labels):
    score = machine.score(np.concatenate(rows), np.array([len(x) for x in rows]))
    return ((score >= 0.5) == np.array(labels)).mean()


def _linear_accuracy(rows, labels, terms):
    """Of the best rule that adds up weights of the given terms: by trying all signs of their sums."""
    seen = np.array([[t in set(r.tolist()) for t in terms] for r in rows], float)
    best = 0.0
    for weights in itertools.product((-1, 0, 1), repeat=len(terms)):
        for cut in (-1.5, -0.5, 0.5, 1.5):
            best = max(best, ((seen @ np.array(weights) > cut) == np.array(labels)).mean())
    return best


def _rows(r, n, rule, terms=(1, 2), share=0.5, noise=60, pool=3000):
    rows, labels = [], []
    for _ in range(n):
        own = [r.random() < share for _ in terms]
        rows.append(np.unique(np.concatenate([r.integers(1000, 1000 + pool, noise), [t for t, o in zip(terms, own) if o]])).astype(np.int64))
        labels.append(float(rule(*own)))
    return rows, labels


def test_factorization_machine_learns_exclusive_or_of_terms_that_tell_nothing_alone():
    r = np.random.default_rng(3)
    rows, labels = _rows(r, 6000, lambda a, b: a != b)
    new, truth = _rows(r, 2000, lambda a, b: a != b)
    machine = toxicity.fit(rows, np.array(labels))
    assert _accuracy(machine, new, truth) > 0.95
    assert _linear_accuracy(new, truth, (1, 2)) < 0.8  # by a rule that knows the terms; one of three cases is always wrong
    machine.factors[:] = 0
    assert _accuracy(machine, new, truth) < 0.8


def test_factorization_machine_learns_insult_with_group_mention():
    """Toxic iff an insult and a group are both named; each is mostly harmless alone."""
    r = np.random.default_rng(4)
    terms = (1, 2, 3, 4)
    rule = lambda a, b, c, d: (a or b) and (c or d)
    rows, labels = _rows(r, 6000, rule, terms, 0.15)
    new, truth = _rows(r, 3000, rule, terms, 0.15)
    machine = toxicity.fit(rows, np.array(labels))
    score = machine.score(np.concatenate(new), np.array([len(x) for x in new]))
    found, truth = score >= 0.5, np.array(truth) > 0
    assert (found & truth).sum() / truth.sum() > 0.95 and (found & truth).sum() / found.sum() > 0.95


def test_score_equals_the_sum_over_all_pairs():
    r = np.random.default_rng(5)
    size = 1 << toxicity.HASH_BITS
    machine = toxicity.Machine(0.3, r.normal(0, 1, size), r.normal(0, 0.3, (size, toxicity.FACTORS)), 1.2, -0.1, np.array([1.0, -1.0, 1.0, -1.0]))
    texts = ["you bad person of that group", "", "one"]
    own = [toxicity.terms(t.encode()).astype(np.int64) for t in texts]
    got = machine.score(np.concatenate(own), np.array([len(o) for o in own]))
    for ids, g in zip(own, got):
        raw = 0.3 + sum(machine.weights[i] for i in ids) + sum((machine.signs * machine.factors[i]) @ machine.factors[j] for i, j in itertools.combinations(ids, 2))
        assert math.isclose(g, 1 / (1 + math.exp(-(1.2 * raw - 0.1))), rel_tol=1e-9)


def test_toxicity_of_held_out_rows(spark):
    rows = toxicity.op7_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null"), "doc_id").where("held_out").collect()
    hit, said, true = (sum(f(r) for r in rows) for f in (lambda r: r.predicted and r.toxic, lambda r: r.predicted, lambda r: r.toxic))
    assert hit >= 0.6 * true and hit >= 0.8 * said


def test_toxicity_catches_marked_texts_and_leaves_others(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(["mild", "day", "sun", "tree", "road"]) for _ in range(30)) + (" nastyword" if i % 9 == 0 else "") for i in range(900)]
    docs = documents(spark, texts + AWKWARD)
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(900)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.scores(docs, machine, ["doc_id"]).collect()}
    assert all((got[i] >= 0.5) == (i % 9 == 0) for i in range(900)) and len(got) == 900 + len(AWKWARD)
    kept = toxicity.quiet(docs, machine)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}
    empty = toxicity.train(docs, labels.limit(0))
    assert toxicity.quiet(docs, empty).count() == docs.count()


def test_base_scores_and_counts_equal_brute_force(spark):
    texts = AWKWARD + ["The cat sat", "the cat ran off", "a dog, the dog"] * 5
    docs = documents(spark, texts)
    train = docs.where("doc_id % 3 <> 0")
    model, counts = brown.learn(train)
    counts_, own = Counter(), {}
    for i, t in enumerate(texts):
        own[i] = [*(t or "").encode().lower().split(), brown.END]
        if i % 3:
            counts_.update(own[i])
    assert (model.tokens, model.types) == (sum(counts_.values()), len(counts_))
    for r in brown.scores(docs, model, counts, ["doc_id"]).collect():
        words = own[r.doc_id]
        assert r.n_tokens == len(words) and r.n_known == sum(counts_[w] > 0 for w in words)
        assert math.isclose(r.base_sum, sum(math.log10(counts_[w] + 1) for w in words), rel_tol=1e-9, abs_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_rare_words_by_join_score_as_frequent_ones(spark):
    docs = documents(spark, ["alpha beta gamma delta", "beta gamma", "gamma epsilon zeta"] * 4)
    model, counts = brown.learn(docs)
    want = {r.doc_id: (r.base_sum, r.n_known) for r in brown.scores(docs, model, counts, ["doc_id"]).collect()}
    model.symbols.index = {brown.END: 0}
    model.symbols.symbol = model.symbols.symbol[:1]
    model.counts = model.counts[:1]
    got = {r.doc_id: (r.base_sum, r.n_known) for r in brown.scores(docs, model, counts, ["doc_id"]).collect()}
    assert all(math.isclose(got[d][0], want[d][0]) and got[d][1] == want[d][1] for d in want)


def test_classes_beat_the_base_on_held_out_texts(spark):
    rows = brown.op8_brown_scores(spark, SF).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_parallel_exchange_puts_frequent_words_with_their_like(spark):
    """Words beyond the clustered ones go by their neighbours, whatever their ending."""
    r = random.Random(3)
    nouns, verbs = [f"n{k}" for k in range(400)], [f"v{k}" for k in range(400)]
    weight = [1 / (k + 50) for k in range(400)]
    texts = [" ".join(f"{r.choices(nouns, weight)[0]} {r.choices(verbs, weight)[0]}" for _ in range(60)) for _ in range(300)]
    model, _ = brown.learn(documents(spark, texts))
    known = [(w.decode()[0], int(model.of[model.symbols.symbol[i]])) for w, i in model.symbols.index.items() if i > brown.CLUSTERED and model.counts[i] >= brown.MIN_COUNT]
    kinds = {c: Counter(k for k, d in known if d == c) for _, c in known}
    apart = sum(max(k.values()) for k in kinds.values())
    assert len(known) > 200 and apart >= 0.95 * len(known)  # by their endings alone, half of them would be with the other kind


def test_scores_equal_brute_force(spark):
    """The score from dictionaries: transitions and emissions of the classes that were learned."""
    texts = ["The cat sat on a mat", "the dog sat on a mat", "a cat ran to the dog", "the end of it"] * 6 + ["a rare word", None]
    docs = documents(spark, texts)
    train = docs.where("doc_id % 5 <> 1")
    model, counts = brown.learn(train)
    number = Counter(w for i, t in enumerate(texts) if i % 5 != 1 for w in [*(t or "").encode().lower().split(), brown.END])

    def cls(word):
        i = model.symbols.index.get(word)
        return int(model.of[model.symbols.symbol[i] if i is not None else model.symbols.of_ending(word)])

    pairs, members = Counter(), Counter(cls(w) for w in number)
    last = 0
    for i, t in enumerate(texts):
        if i % 5 != 1:
            for w in [*(t or "").encode().lower().split(), brown.END]:
                pairs[last, cls(w)] += 1
                last = cls(w)
            last = 0
    k = int(model.of.max()) + 1
    total = [sum(pairs[a, b] for b in range(k)) for a in range(k)]
    into = [sum(pairs[a, b] for a in range(k)) for b in range(k)]
    all_ = sum(into)
    for r in brown.scores(docs, model, counts, ["doc_id"]).collect():
        want, last = 0.0, 0
        for w in [*(texts[r.doc_id] or "").encode().lower().split(), brown.END]:
            c = cls(w)
            share = (into[c] + 1) / (all_ + k)
            want += math.log10((pairs[last, c] + brown.PRIOR * share) / (total[last] + brown.PRIOR))
            want += math.log10((number[w] + brown.DELTA) / (into[c] + brown.DELTA * (members[c] + 1)))
            last = c
        assert math.isclose(r.score, want, rel_tol=1e-9, abs_tol=1e-9)


def test_exchange_finds_classes():
    pairs = np.zeros((brown.WIDTH, brown.WIDTH))
    for a in range(1, 41):
        for b in range(1, 41):
            pairs[a, b] = 20 if (a % 2) != (b % 2) else 0
    of = brown.exchange(pairs, 40, classes=2)
    assert len({int(of[i]) for i in range(1, 41, 2)}) == 1 and len({int(of[i]) for i in range(1, 41)}) == 2


def test_edit_distance_equals_brute_force():
    r = random.Random(3)
    for _ in range(200):
        p, t = (bytes(r.choice(b"abc") for _ in range(r.randint(low, 25))) for low in (1, 0))
        last = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            now = [i]
            for j, b in enumerate(t, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (a != b)))
            last = now
        assert decontaminate.edit_distance_in(p, t) == min(last)


def test_planted_items_are_found_with_edits_and_clean_texts_are_not(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))
    items = [" ".join(word() for _ in range(40)) for _ in range(30)]
    texts, truth = [], set()
    for i in range(120):
        body = [word() for _ in range(200)]
        if i % 2:
            chars = list(items[i % 30])
            for _ in range(len(chars) * (i % 5) // 40):
                chars[r.randrange(len(chars))] = r.choice("qrstuv")
            body[100:100] = "".join(chars).upper().split()
            truth.add((i, i % 30))
        texts.append(" ".join(body))
    benchmark = spark.createDataFrame([*enumerate(items), (97, None), (98, ""), (99, "too short"), (None, items[0])], "item_id long, text string")
    docs = documents(spark, texts + AWKWARD)
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, benchmark).collect()}
    assert got <= truth and len(got) >= 0.98 * len(truth)
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == set(range(len(texts) + len(AWKWARD))) - {d for d, _ in got}
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


def _edited(r, text, edits):
    chars = list(text)
    for _ in range(edits):
        at, what = r.randrange(len(chars)), r.random()
        if what < 0.6:
            chars[at] = r.choice("abcdefghijklmnopqrstuvwxyz")
        elif what < 0.8:
            del chars[at]
        else:
            chars.insert(at, r.choice("abcdefghijklmnopqrstuvwxyz"))
    return "".join(chars)


@pytest.mark.parametrize("words", [5, 8, 20, 40])
def test_recall_at_every_edit_rate_that_the_threshold_admits(words):
    """Substitutions, deletions and insertions anywhere; what brute force finds to be 0.8 similar counts."""
    r = random.Random(words)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "en", "to", "it", "st", "io", "le"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    items = [" ".join(word() for _ in range(words)) for _ in range(40)]
    texts = [" ".join(word() for _ in range(150)) for _ in range(200)]
    whole = b" ".join(t.encode() for t in texts)
    bits = lambda g: np.log2((len(whole) + 2) / (np.bincount(g.places(whole)[1], minlength=len(g.keys)) + 1))
    block = decontaminate.Items([(i, t.encode()) for i, t in enumerate(items)], bits)
    for rate in (0.0, 0.06, 0.12, 0.15, 0.18, 0.2):
        planted = []
        for i, t in enumerate(items):
            for _ in range(3):
                own = r.choice(texts).split()
                own[70:70] = _edited(r, t, int(rate * len(t))).split()
                planted.append((i, " ".join(own).encode()))
        true = {k for k, (i, t) in enumerate(planted) if 1 - decontaminate.edit_distance_in(items[i].encode(), b" ".join(t.split())) / len(items[i]) >= decontaminate.SIMILARITY}
        found = {d for d, m, _ in block.find([t for _, t in planted]) if block.ids[m] == planted[d][0]}
        assert len(true & found) >= 0.9 * len(true), (rate, len(true & found), len(true))
    assert not block.find([t.encode() for t in texts]) or max(s for *_, s in block.find([t.encode() for t in texts])) < 0.9


def _random_words(r, n, pool):
    return " ".join(r.choice(pool) for _ in range(n))


def test_one_very_long_item_among_many_takes_bounded_memory():
    r = random.Random(8)
    pool = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(20_000)]
    long = _random_words(r, 4_000, pool).encode()
    short = [_random_words(r, 15, pool).encode() for _ in range(4_000)]
    tracemalloc.start()
    try:
        block = decontaminate.Items(list(enumerate([long, *short])))
        assert tracemalloc.get_traced_memory()[1] < 160 << 20  # walks of all items as long as the longest: 1.3 GB
    finally:
        tracemalloc.stop()
    cut = long[:9_000] + b" other words here " + long[9_200:]
    hits = block.find([b"before " + long + b" after", b"nothing of it", short[7] + b" and more"])
    assert [(d, int(block.ids[m]), s) for d, m, s in hits] == [(0, 0, 1.0), (2, 8, 1.0)]
    (hit,) = block.find([cut])
    assert hit[:2] == (0, 0) and 0.98 < hit[2] < 1


@pytest.mark.parametrize("postings", [50, 2_000])
def test_items_with_one_opening_are_found_alike_in_runs_of_any_size(monkeypatch, postings):
    r = random.Random(9)
    pool = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(5_000)]
    opening = "which of the following statements about this best describes "
    items = [(k, (opening + _random_words(r, 8, pool)).encode()) for k in range(60)] + [(60, b"na na na na na na na na hey hey hey hey goodbye " * 4)]
    texts = [(opening + _random_words(r, 40, pool)).encode() for _ in range(20)]
    texts += [b"a b c " + items[k][1] + b" d e f" for k in (0, 7, 59)] + [b"oh " + items[60][1] * 2, b""]
    block = decontaminate.Items(items)
    want = block.find(texts)
    assert {(d, m) for d, m, _ in want} == {(20, 0), (21, 7), (22, 59), (23, 60)}
    monkeypatch.setattr(decontaminate, "POSTINGS", postings)
    assert {(d, m) for d, m, _ in block.find(texts)} == {(d, m) for d, m, _ in want}


def test_items_of_few_words_must_occur_as_they_are(spark):
    items = [(1, "ab"), (2, "Too short!"), (3, "not in here"), (4, "..."), (5, "one two three four"), (6, "検" * 90), (7, "日本")]
    texts = ["this is too, short.", "tab ab", "tab abc", "it is tooshort", "so one two three four five", "前 " + "検" * 88 + "別" * 2 + " 後", "日本 人", "日本人", None]
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, 2), (1, 1), (4, 5), (5, 6), (6, 7)}


def test_held_out_fold_matches_crc32(spark):
    rows = documents(spark, ["x"] * 50).select("doc_id", toxicity.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_temperature_and_limit_come_from_all_learned_texts(spark):
    """Over the 4,000 rows that a sample once held; brute force over every row."""
    r = np.random.default_rng(3)
    letters = ["abcd", "cdef"]
    texts = [(k, "ab"[k % 2], "".join(r.choice(list(letters[k % 2] + " "), int(r.integers(1, 12)))) + "c") for k in range(9000)]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    found = langid.learn(docs)
    rows = langid.totals(docs, found, ["lang"]).where("letters > 0").collect()
    total, own = np.array([x.total for x in rows]), np.array([x.letters for x in rows])
    true = total[np.arange(len(rows)), [found.langs.index(x.lang) for x in rows]]
    entropy = np.sort(-true / own)
    assert len(rows) == 9000 and found.limit == entropy[math.ceil(langid.REJECT_QUANTILE * len(rows)) - 1] + langid.REJECT_MARGIN
    loss = [np.mean(np.log(np.exp(s * total).sum(axis=1)) - s * true) for s in langid.SLOPES]
    assert found.slope == langid.SLOPES[int(np.argmin(loss))]


def test_neighbour_counts_are_held_in_bounded_memory():
    """Ten million distinct cells leave in small batches; few cells that come again and again are kept and summed."""
    r = np.random.default_rng(4)
    held, seen, largest = brown.Sums(), 0, 0
    tracemalloc.start()
    for _ in range(100):
        for key, n in held.add(r.integers(0, 1 << 62, 100_000)):
            seen, largest = seen + int(n.sum()), max(largest, len(key))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert largest <= brown.SENT_ROWS and peak < 150_000_000
    assert seen + sum(int(n.sum()) for _, n in held.rest()) == 10_000_000 and not list(held.rest())
    few, keys = brown.Sums(300), [r.integers(0, 100, 500) for _ in range(20)]
    assert not [x for k in keys for x in few.add(k)]
    ((key, n),) = few.rest()
    assert dict(zip(key.tolist(), n.tolist())) == Counter(np.concatenate(keys).tolist())
