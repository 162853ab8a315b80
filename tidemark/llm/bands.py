"""Candidate pairs of texts whose sets of shingles have Jaccard similarity 0.8, from bands of minima, sifted by SimHash.

A text has ``BANDS`` keys, each a hash of ``ROWS`` minima of its shingles under different hash functions.  A pair of similarity
s shares a key with probability 1 - (1 - s**ROWS)**BANDS: 0.98 at 0.8, 0.999 at 0.86.  Texts of a key meet in one task, which
walks them in order of their names and keeps only leaders: a text goes with the nearest leader by SimHash if that is within
``SIFT`` bits (a pair of similarity 0.8 differs by about 10 of 64 bits, standard deviation 3), else it leads.  So a group of any
size gives one pair a text, and memory grows with the leaders alone.

Pairs are checked exactly elsewhere.  What no key proposes, or a leader stands in for, is found by the exact search of module
``prefixes`` between the components that these pairs make.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import parallelism

BANDS, ROWS = 24, 8
SIFT = 20

_RANDOM = np.random.default_rng(11)
_ODD = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_FLIP = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def keys_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Texts x ``BANDS`` keys, from the texts' shingle hashes one after the other; every count is positive."""
    begins, out = np.cumsum(counts) - counts, np.zeros((len(counts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(counts), band, np.uint64)
        for row in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat((hashes ^ _FLIP[row]) * _ODD[row], begins)
            key = (key ^ (least >> np.uint64(20))) * _MIX
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out


def entries(nodes: DataFrame) -> DataFrame:
    """(key, node, fp) for every key of nodes (node, fp, bands)."""
    return nodes.select(F.explode("bands").alias("key"), "node", "fp")


def _runs(batches: Iterator[pa.RecordBatch]):
    """(key, nodes, fps) of runs of equal keys within batches; a run may go on in the next batch."""
    for batch in batches:
        key, node, fp = (np.asarray(batch.column(c)) for c in ("key", "node", "fp"))
        if len(key):
            edges = np.flatnonzero(np.diff(key, prepend=key[0] ^ 1, append=key[-1] ^ 1))
            yield [(int(key[b]), node[b:e], fp[b:e].view(np.uint64)) for b, e in zip(edges.tolist(), edges[1:].tolist())]


def to_leaders(found: DataFrame, sift: int = SIFT) -> DataFrame:
    """(key, node, fp, other): each text that isn't a leader of its key, with the nearest leader; one shuffle."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n = None, 0
        lead_fp, lead_node = np.zeros(16, np.uint64), np.zeros(16, np.int64)
        for runs in _runs(batches):
            out = []
            for key, nodes, fps in runs:
                if key != current:
                    current, n = key, 0
                for node, fp in zip(nodes.tolist(), fps):
                    if n:
                        apart = np.bitwise_count(lead_fp[:n] ^ fp)
                        best = int(apart.argmin())
                        if apart[best] <= sift:
                            if lead_node[best] != node:
                                out.append((key, node, int(fp.view(np.int64)), int(lead_node[best])))
                            continue
                    if n == len(lead_fp):
                        lead_fp, lead_node = np.resize(lead_fp, 2 * n), np.resize(lead_node, 2 * n)
                    lead_fp[n], lead_node[n] = fp, node
                    n += 1
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "node", "fp", "other"])

    return _gathered(found).mapInArrow(propose, "key long, node long, fp long, other long")


def _gathered(found: DataFrame) -> DataFrame:
    return found.repartition(parallelism(found), "key").sortWithinPartitions("key", "node")
