"""Toxicity: a factorization machine over hashed terms.

Terms are the lower-case words of a text, without punctuation, and their beginnings of four and five bytes; each is hashed into
``2 ** HASH_BITS`` columns and counts once per text.  The score is the logistic function of a bias, a weight for each term
and the sum over all pairs of terms of the product of their factor vectors, in linear time by the square of the sum; each
coordinate of the vectors has a sign, so that terms which exclude each other need no more coordinates than those that fit.  The
machine is fitted on a bounded sample of labelled rows (``TRAIN_ROWS``, chosen by hash of doc_id); every sixth row of it is
kept back to set the slope and the cut, so that 0.5 is the best cut there.

1. Weights.  Columns that deviate between the labels (``MIN_DEVIATION`` standard errors at least) get weights by adaptive gradient
   steps.
2. Factors.  All columns in ``MIN_SHARE`` of the sample's texts take part, whether they tell anything alone or not.  What the
   machine leaves unexplained, summed over the texts that hold both of two terms, is a matrix; a truncated power
   iteration finds the ``SUPPORT`` columns of its leading direction, without forming pairs, and these become the next factor.  A
   group mention that is harmless alone and an insult, or two terms of which only one may occur, show there.
3. Both are then fitted together.  How much the pairs count is set on the rows kept back, so pairs found by chance go.

Null and empty texts have no terms: their score is that of the bias.  Rows whose label is null are not learned from; a row
whose doc_id is null is held out (its remainder isn't known).  Repeated rows are scored each on its own.  With no labelled
row, or with one label only, every score is the share of the label toxic, pulled to one quarter.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import buffer_of, documents, sliced, utf8, written

HASH_BITS = 18
FACTORS = 4
TRAIN_ROWS = 24_000
MIN_DOCS = 3
MIN_SHARE = 1 / 200
MIN_DEVIATION = 4.0
SUPPORT = 48
LEAST_PART = 0.2  # of a direction's largest part
POWER_STEPS = 12
CHUNK_ROWS = 2048
EPOCHS = 6
BATCH = 256
FOLDS = 5
SLICE_BYTES = 4 << 20  # of text that a task scores at once
_CLEAN = bytes(b if chr(b).isalnum() or b >= 0x80 or b == 0x27 else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> np.ndarray:
    """Hashed columns of a text's distinct terms, sorted."""
    words = set(text.lower().translate(_CLEAN).split())
    words |= {w[:5] + b"*" for w in words if len(w) > 5} | {w[:4] + b"*" for w in words if len(w) > 4}
    crc = zlib.crc32
    return np.unique(np.fromiter(map(crc, words), np.uint32, len(words)) & np.uint32((1 << HASH_BITS) - 1))


@dataclass
class Machine:
    """A fitted machine: slope and shift turn its raw score into a logit."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    signs: np.ndarray = field(default_factory=lambda: np.ones(FACTORS))

    def raw(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Raw scores of texts whose columns are concatenated in ``ids``."""
        full = counts > 0
        out = np.full(len(counts), self.bias)
        if len(ids):
            at = (np.cumsum(counts) - counts)[full]
            v = self.factors[ids]
            total = np.add.reduceat(v, at, axis=0)
            pairs = 0.5 * (total**2 - np.add.reduceat(v * v, at, axis=0)) @ self.signs
            out[full] += np.add.reduceat(self.weights[ids], at) + pairs
        return out

    def score(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(ids, counts) + self.shift, -40, 40)))


def telling(docs: np.ndarray, marked: np.ndarray, share: float) -> np.ndarray:
    """Which columns get weights, from the texts and the marked texts of each, and the share of marked texts."""
    expected = docs * share
    return (docs >= MIN_DOCS) & (np.abs(marked - expected) >= MIN_DEVIATION * np.sqrt(expected * (1 - share) + 1e-9))


def frequent(docs: np.ndarray, texts: int) -> np.ndarray:
    """Which columns may get factors."""
    return docs >= max(MIN_DOCS, MIN_SHARE * texts)


def _flat(rows: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = [rows[i] for i in which]
    return np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int64), np.array([len(r) for r in own], np.int64)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of the given sizes; of an empty group, zero."""
    out = np.zeros((len(counts), *values.shape[1:]))
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0)
    return out


def leading_pairs(rows: list[np.ndarray], left: np.ndarray, scale: np.ndarray, candidates: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float]:
    """Columns, their parts and the sign of the sparse leading direction of the matrix of what is left for pairs of columns.

    left: what each text's label lacks; scale: of each column.  The matrix is never formed: a step costs one pass over the rows.
    """

    def times(u: np.ndarray) -> np.ndarray:
        out, own = np.zeros(len(u)), np.zeros(len(u))
        for k in range(0, len(rows), CHUNK_ROWS):
            ids, counts = _flat(rows, np.arange(k, min(len(rows), k + CHUNK_ROWS)))
            z = left[k : k + len(counts)]
            out += np.bincount(ids, np.repeat(z * _sums(u[ids], counts), counts), minlength=len(u))
            own += np.bincount(ids, np.repeat(z, counts), minlength=len(u))
        return out - own * u  # without a column's pair with itself

    begin = np.zeros(len(scale))
    begin[candidates] = random.normal(0, 1, len(candidates))
    best = 0.0, 1.0, begin
    for sign in (1.0, -1.0):
        u, size = begin / np.linalg.norm(begin), len(candidates)
        for step in range(POWER_STEPS):
            new = scale * times(scale * u)
            norm = np.linalg.norm(new)
            if norm == 0:
                break
            new += sign * 0.7 * norm * u  # so that of two directions of like size and unlike sign one leads
            size = max(SUPPORT, size // 3) if step > 2 else size
            if len(candidates) > size:
                new[np.abs(new) < np.partition(np.abs(new), -size)[-size]] = 0
            u = new / np.linalg.norm(new)
        u[np.abs(u) <= LEAST_PART * np.abs(u).max()] = 0
        value = float(u @ (scale * times(scale * u))) / max(float(u @ u), 1e-12)
        if abs(value) > abs(best[0]):
            best = value, float(np.sign(value)), u
    value, sign, u = best
    columns = np.flatnonzero(u) if value else np.zeros(0, np.int64)
    return columns, u[columns] * scale[columns], sign


def fit(rows: list[np.ndarray], labels: np.ndarray, held: np.ndarray | None = None, seed: int = 7) -> Machine:
    """Fit on the logistic loss; deterministic for the same rows in the same order."""
    size = 1 << HASH_BITS
    share = (labels.sum() + 0.5) / (len(labels) + 2)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, FACTORS)))
    if len(set(labels.tolist())) < 2:
        return machine
    held = np.arange(len(rows)) % 6 == 5 if held is None else held
    train, kept = np.flatnonzero(~held), np.flatnonzero(held)
    docs, marked = np.zeros(size), np.zeros(size)
    for k in range(0, len(train), CHUNK_ROWS):
        own = train[k : k + CHUNK_ROWS]
        ids, counts = _flat(rows, own)
        docs += np.bincount(ids, minlength=size)
        marked += np.bincount(ids, np.repeat(labels[own], counts), minlength=size)
    random = np.random.default_rng(seed)
    known = telling(docs, marked, float(labels[train].mean()))
    alone = [r[known[r]] for r in rows]
    _descend(machine, alone, labels, train, random, EPOCHS, False)
    candidates = np.flatnonzero(frequent(docs, len(train)))
    common = frequent(docs, len(train))
    fitted = [rows[i][common[rows[i]]] for i in train]
    scale = np.zeros(size)
    scale[candidates] = 1 / np.sqrt(docs[candidates] + 0.02 * len(train))
    for k in range(FACTORS):
        if not len(candidates):
            break
        raw = _raw(machine, rows, train)
        left = labels[train] - 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
        columns, part, machine.signs[k] = leading_pairs(fitted, left, scale, candidates, random)
        if not len(columns):
            break
        machine.factors[columns, k] = part
        pair = _raw(machine, rows, train) - raw
        machine.factors[:, k] *= np.sqrt(_amount(pair, raw, labels[train]))
        if not machine.factors[:, k].any():
            continue
        some = (machine.factors != 0).any(axis=1) | known
        _descend(machine, [r[some[r]] for r in rows], labels, train, random, 1, True)
    some = (machine.factors != 0).any(axis=1) | known
    _descend(machine, [r[some[r]] for r in rows], labels, train, random, 2 * EPOCHS, True)
    if len(kept) and 0 < labels[kept].sum() < len(kept):
        factors = machine.factors
        machine.factors = np.zeros_like(factors)
        linear = _raw(machine, rows, kept)
        machine.factors = factors
        machine.factors = factors * np.sqrt(_amount(_raw(machine, rows, kept) - linear, linear, labels[kept], 3.0))
        machine.slope, machine.shift = calibrate(_raw(machine, rows, kept), labels[kept])
    return machine


def _raw(machine: Machine, rows: list[np.ndarray], which: np.ndarray) -> np.ndarray:
    parts = [machine.raw(*_flat(rows, which[k : k + BATCH])) for k in range(0, len(which), BATCH)]
    return np.concatenate([*parts, np.zeros(0)])


def _amount(pair: np.ndarray, raw: np.ndarray, labels: np.ndarray, least: float = 0.0) -> float:
    """How much of ``pair`` to add to ``raw``: the best of a grid under the logistic loss; none if it gains less than ``least``."""
    grid = np.array([0, *np.geomspace(0.01, 3000, 60)]) / max(float(np.abs(pair).max(initial=0)), 1e-12)
    grid = np.unique(np.append(grid[grid * np.abs(pair).max(initial=0) <= 30], 1.0))
    loss = np.array([np.logaddexp(0, np.where(labels > 0, -1, 1) * (raw + g * pair)).sum() for g in grid])
    best = int(np.argmin(loss))
    return float(grid[best]) if loss[0] - loss[best] > least else 0.0


def _descend(machine: Machine, rows: list[np.ndarray], labels: np.ndarray, train: np.ndarray, random: np.random.Generator, epochs: int, pairs: bool) -> None:
    """AdaGrad over minibatches; with ``pairs``, factor vectors that aren't zero move too."""
    size = len(machine.weights)
    gw, gv, gb = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        order = random.permutation(train)
        for start in range(0, len(order), BATCH):
            own = order[start : start + BATCH]
            ids, counts = _flat(rows, own)
            doc = np.repeat(np.arange(len(own)), counts)
            error = 1 / (1 + np.exp(-np.clip(machine.raw(ids, counts), -40, 40))) - labels[own]
            step = error.mean()
            gb += step**2
            machine.bias -= 0.05 * step / np.sqrt(gb)
            if not len(ids):
                continue
            by = np.argsort(ids, kind="stable")
            columns, first = np.unique(ids[by], return_index=True)
            slope_w = np.add.reduceat(error[doc][by], first) + 1e-3 * machine.weights[columns]
            if pairs:
                v = machine.factors[ids]
                slope_v = np.add.reduceat((error[doc][:, None] * (_sums(v, counts)[doc] - v) * machine.signs)[by], first, axis=0) + 1e-2 * machine.factors[columns]
                slope_v[machine.factors[columns] == 0] = 0
                gv[columns] += slope_v**2
                machine.factors[columns] -= 0.1 * slope_v / np.sqrt(gv[columns])
            gw[columns] += slope_w**2
            machine.weights[columns] -= 0.1 * slope_w / np.sqrt(gw[columns])


def calibrate(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve on ``raw``, moved so that one half is the cut with the best F1 there."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        d, w = p - labels, np.maximum(p * (1 - p), 1e-6)
        hessian = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(hessian, [(d * raw).sum() + (a - 1), d.sum()])
        a, b = max(0.1, a - move[0]), b - move[1]
    order = np.argsort(-raw, kind="stable")
    hits, n = np.cumsum(labels[order]), np.arange(1, len(raw) + 1)
    f1 = 2 * hits / (n + labels.sum())
    f1[:-1][np.diff(raw[order]) == 0] = -1
    best = int(np.argmax(f1))
    cut = (raw[order][best] + raw[order][min(best + 1, len(raw) - 1)]) / 2
    return float(a), float(-a * cut)


def _columns(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep`` and the hashed columns of each text as little-endian 32-bit integers."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "bytes", SLICE_BYTES):
                found = [terms(t).tobytes() for t in part.column("bytes").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found, pa.binary())], [*keep, "columns"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, utf8(text_col).alias("bytes")).mapInArrow(compute, f"{kinds}, columns binary")


def held_out(id_col: str = "doc_id", folds: int = FOLDS):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fit on at most ``rows`` labelled rows outside the held-out fold."""
    marks = labels.select(F.col(id_col).alias("mark_id"), F.col(label_col).cast("int").alias("mark")).where("mark is not null").groupBy("mark_id").agg(F.max("mark").alias("mark"))
    ranked = marks.where(~held_out("mark_id")).withColumn("rank", F.xxhash64("mark_id"))
    n = ranked.count()
    if n > rows:
        # By hash, without a sort; a few standard deviations below the bound, so that the limit cuts nothing.
        ranked = ranked.where(F.pmod("rank", F.lit(1 << 30)) < int((rows - 4 * rows**0.5) / n * (1 << 30)))
    chosen = ranked.limit(rows)
    texts = docs.select(F.col(id_col).alias("mark_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "mark_id")  # at most ``rows`` rows of three numbers
    sample = written(_columns(texts, ["mark_id", "rank", "mark"], "text"), "toxicity-sample")
    held = F.pmod("rank", F.lit(6)) == 5
    train_rows, share = sample.where(~held).agg(F.count("*"), F.coalesce(F.avg("mark"), F.lit(0.0))).first()
    if not train_rows or share in (0.0, 1.0):
        return fit([np.zeros(0, np.int64)] * train_rows, np.full(train_rows, share))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << HASH_BITS), np.int64)
        for batch in batches:
            for mark, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[:, np.frombuffer(own, np.uint32)] += np.array([[1], [mark]])
        found = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[0, found]), pa.array(total[1, found])], ["column", "docs", "marked"])

    counts = sample.where(~held).select("mark", "columns").mapInArrow(count, "column long, docs long, marked long").groupBy("column").agg(F.sum("docs").alias("docs"), F.sum("marked").alias("marked")).toArrow()
    docs_, marked = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)  # one row per column at most
    docs_[counts.column("column").to_numpy()], marked[counts.column("column").to_numpy()] = counts.column("docs").to_numpy(), counts.column("marked").to_numpy()
    known = telling(docs_, marked, float(share)) | frequent(docs_, train_rows)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(c, np.uint32) for c in batch.column(3).to_pylist()]
            own = [c[known[c]].tobytes() for c in own]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.binary()), pa.array(map(zlib.crc32, own), pa.int64())], names)

    names = ["mark_id", "rank", "mark", "columns", "crc"]
    kept = sample.mapInArrow(only, f"mark_id {sample.schema['mark_id'].dataType.simpleString()}, rank long, mark int, columns binary, crc long").toArrow()  # at most ``rows`` rows of the columns that may take part
    kept = kept.sort_by([("rank", "ascending"), ("mark_id", "ascending"), ("crc", "ascending")]).combine_chunks()
    data, at = buffer_of(kept.column("columns"))
    flat, at = data.view(np.uint32), at // 4
    columns = [flat[b:e] for b, e in zip(at, at[1:])]  # slices of one buffer
    return fit(columns, kept.column("mark").to_numpy().astype(np.float64), kept.column("rank").to_numpy() % 6 == 5)


def scores(docs: DataFrame, machine: Machine, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``score`` for every row; no shuffle."""
    weights, factors = machine.weights.astype(np.float32), machine.factors.astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast(Machine(machine.bias, weights, factors, machine.slope, machine.shift, machine.signs))  # 5 MB, whatever the corpus

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in sliced(batch, "bytes", SLICE_BYTES):
                found = [terms(t) for t in part.column("bytes").to_pylist()]
                score = own.score(np.concatenate(found).astype(np.int64), np.array([len(f) for f in found])) if found else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(score)], [*keep, "score"])

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, utf8(text_col).alias("bytes")).mapInArrow(compute, f"{kinds}score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: toxicity of all documents, learned outside the held-out fold."""
    docs = documents(spark, sf_dir)
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores(docs.withColumn("held_out", held_out()), machine, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quiet(docs: DataFrame, machine: Machine, cut: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``cut``."""
    keep = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(Machine(machine.bias, machine.weights.astype(np.float32), machine.factors.astype(np.float32), machine.slope, machine.shift, machine.signs))
    place = keep.index(text_col)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            bytes_ = pa.record_batch([batch.column(place).cast(pa.binary()).fill_null(b"")], ["bytes"])
            for at, part in zip(itertools.accumulate((p.num_rows for p in sliced(bytes_, "bytes", SLICE_BYTES)), initial=0), sliced(bytes_, "bytes", SLICE_BYTES)):
                found = [terms(t) for t in part.column(0).to_pylist()]
                score = own.score(np.concatenate(found).astype(np.int64), np.array([len(f) for f in found]))
                yield batch.slice(at, part.num_rows).filter(pa.array(score < cut))

    return docs.mapInArrow(compute, docs.schema)
