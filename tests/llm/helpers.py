"""Brute-force versions that the corpus operators are held against."""

from __future__ import annotations

import hashlib
from collections import Counter

import xxhash

AWKWARD = [None, "", " ", "one", "One  two", "\n\t", "é", "a" * 900, "a" * 900, "ab " * 500, "x" * 40_000]


def documents(spark, texts, parts=3):
    """doc_id, text and columns whose names an operator might use itself."""
    rows = [(i, t, "en", "src", len(t or ""), i, "x", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, bytes string, score double").repartition(parts)


def removed(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(bool(gone[i]) and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(t, gone) if not y)).hexdigest()))
    return out


def simhash(text, words=4):
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    shingles = [b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, ids, bits=4):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, doc in enumerate(ids):
        r = root(i)
        least[r] = min(least.get(r, doc), doc)
    return [least[root(i)] for i in range(len(prints))]
