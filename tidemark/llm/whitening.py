"""Embedding whitening: leading principal components by Chebyshev-filtered subspace iteration.

1. Vectors become integers, a coordinate c as ``floor(SCALE * c) + SHIFT``, so that sums and distances are exact.  They are
   written once as blocks of ``BLOCK_ROWS`` rows, each a little-endian matrix, and every later pass reads these blocks.
2. One pass is the product V Q of the covariance V with a thin matrix Q: each task adds up ``Xc' (Xc Q)`` over its centred
   blocks, Spark adds the tasks' sums by ``FAN_IN``, and so many matrices of dimension x columns at most reach the driver.
3. A filter is the three-term recurrence of the Chebyshev polynomial on the unwanted part of the spectrum, one pass a degree;
   its degree follows from the gap found by the round before.  QR and a Rayleigh-Ritz step follow, and their residuals
   ``V u - e u`` decide: below ``TOLERANCE`` of the largest eigenvalue, or as low as rounding lets them fall, they certify.
   Certified leading pairs are locked and taken out of V.
4. A last pass writes each row's whitened coordinates.

Dropped: null vectors and vectors with a null or non-finite entry.  Kept: repeated rows, repeated and null ids.  Vectors of
different lengths, and coordinates beyond ``MOST``, raise ValueError.  Components whose eigenvalue is zero to working
precision don't exist: fewer vectors than dimensions give fewer components, one vector or none gives no rows.  A deviation
beyond 64 bits is null.  Equal eigenvalues may take any basis of their space; it is the same for all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import buffer_of, written
from tidemark.session import ship

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Columns iterated beyond those wanted: the gap behind them sets the speed.
GUARD = 24
#: Partial sums that one task, or the driver, adds up.
FAN_IN = 64
BLOCK_ROWS = 4096
#: Coordinates above this lose exactness in doubles.
MOST = float(1 << 40)
TOLERANCE, ACCEPTED, AIM = 2e-14, 1e-11, 2e-15
MAX_DEGREE, MAX_ROUNDS = 40, 100
#: A filter may raise the largest eigenvalue so much above the last wanted one; more would drown the latter in rounding.
SPREAD = 1e8
#: Eigenvalues below this share of the largest are zero.
RANK = 1e-12


def blocks(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Integer matrices of the usable rows: ids array, x binary (little-endian, a row after the other), n, d."""
    usable = F.col(embedding).isNotNull() & F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).where(usable)

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                ids, lists = batch.column(0).slice(at, BLOCK_ROWS), batch.column(1).slice(at, BLOCK_ROWS)
                sizes = np.diff(np.asarray(lists.offsets))
                if not len(sizes):
                    continue
                if sizes.min() != sizes.max():
                    raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} entries")
                own = np.floor(SCALE * np.asarray(lists.flatten(), np.float64))
                if len(own) and np.abs(own).max() > MOST:
                    raise ValueError("coordinates too large for exact sums")
                x = own.astype(np.int64) + SHIFT
                yield pa.record_batch([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([x.astype("<i8").tobytes()]), pa.array([len(sizes)], pa.int64()), pa.array([int(sizes[0])], pa.int32())], ["ids", "x", "n", "d"])

    return rows.mapInArrow(work, "ids array<long>, x binary, n long, d int")


def matrices(batch: pa.RecordBatch):
    """The integer matrices of a batch of blocks."""
    data, at = buffer_of(batch.column("x"))
    for begin, end, d in zip(at, at[1:], batch.column("d").to_pylist()):
        yield np.frombuffer(data[begin:end].tobytes(), "<i8").reshape(-1, d) if d else np.zeros((0, 0), np.int64)


@dataclass
class Fit:
    """Facts of the fit list: rows, exact sums, and after ``components`` the eigenvectors (columns), eigenvalues and trace of V."""

    n: int
    sums: list[int]
    vectors: np.ndarray | None = None
    values: np.ndarray | None = None
    trace: float = 0.0
    tasks: int = 1
    passes: int = 0
    residual: float = 0.0

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """S/n as whole numbers and the fractions left, so that x - S/n loses nothing to its size."""
        parts = [divmod(s, self.n) for s in self.sums]
        return np.array([p[0] for p in parts], np.int64), np.array([p[1] / self.n for p in parts])

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.centre
        return (x - whole) - rest


def summed(table: DataFrame, of, rows: int, columns: int, tasks: int) -> np.ndarray:
    """Sum over all blocks of the matrix ``of(block)``, rows x columns: within each task, then by ``FAN_IN`` tasks on Spark until so few are left."""

    def added(found):
        total = None
        for part in found:
            total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([np.ascontiguousarray(total, np.float64).tobytes()])], ["m"])

    def read(data):
        return np.frombuffer(data, np.float64).reshape(rows, columns)

    parts = table.mapInArrow(lambda batches: added(of(x) for batch in batches for x in matrices(batch)), "m binary")
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.repartition(tasks).mapInArrow(lambda batches: added(read(m) for batch in batches for m in batch.column(0).to_pylist()), "m binary")
    return sum((read(r.m) for r in parts.collect()), np.zeros((rows, columns)))


def counted(table: DataFrame) -> Fit | None:
    """Number of vectors and exact sums; None if there is no vector or no dimension."""

    def work(batches):
        for batch in batches:
            for x in matrices(batch):
                yield pa.record_batch([pa.array(np.arange(x.shape[1]), pa.int32()), pa.array(x.sum(axis=0)), pa.array(np.full(x.shape[1], x.shape[0]))], ["i", "s", "n"])

    exact = F.sum(F.col("s").cast("decimal(20,0)"))
    found = table.mapInArrow(work, "i int, s long, n long").groupBy("i").agg(exact.alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    if not found:
        return None
    if len({r.n for r in found}) > 1:
        raise ValueError("vectors of different lengths")
    return Fit(int(found[0].n), [int(r.s) for r in found], tasks=table.rdd.getNumPartitions())


def product(table: DataFrame, fit: Fit, q: np.ndarray) -> np.ndarray:
    """V Q by one pass over the blocks."""
    whole, rest = fit.centre
    fit.passes += 1

    def of(x):
        own = (x - whole) - rest
        return own.T @ (own @ q)

    return summed(table, of, *q.shape, fit.tasks) / fit.n


def filtered(times, q: np.ndarray, vq: np.ndarray, degree: int, bound: float, top: float) -> np.ndarray:
    """Chebyshev polynomial of V applied to Q, small on [0, bound] and scaled to 1 at ``top``; ``vq`` is V Q, known already."""
    half = bound / 2
    sigma = first = half / (half - top)
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, 2 * (times(now) - half * now) * (following / half) - before * (sigma * following)
        sigma = following
    return now


def components(table: DataFrame, fit: Fit, wanted: int = COMPONENTS, guard: int = GUARD) -> Fit:
    """The leading ``wanted`` eigenpairs of V, fewer if V has lower rank."""
    d, whole_rest = len(fit.sums), fit.centre

    def squares(x):
        own = (x - whole_rest[0]) - whole_rest[1]
        return np.array([[np.einsum("ij,ij->", own, own)]])

    fit.trace = float(summed(table, squares, 1, 1, fit.tasks)[0, 0]) / fit.n
    if fit.trace <= 0:
        fit.vectors, fit.values = np.zeros((d, 0)), np.zeros(0)
        return fit
    done, known = np.zeros((d, 0)), np.zeros(0)  # certified eigenpairs: taken out of V, so that the filter damps them

    def outside(y):
        return y - done @ (done.T @ y)

    def times(y):
        return product(table, fit, y) - done @ (known[:, None] * (done.T @ y))

    q = np.linalg.qr(np.random.default_rng(7).standard_normal((d, min(d, wanted + guard))))[0]
    last = math.inf
    for _ in range(MAX_ROUNDS):
        vq = times(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max([*known, values[0]])
        kept = int(np.sum(values[: wanted - len(known)] > RANK * top))
        residuals = np.linalg.norm(vq - q * values, axis=0)[:kept] / top
        fit.residual = float(residuals.max(initial=0))
        fine = kept if fit.residual <= ACCEPTED and fit.residual > last / 2 else int(np.argmax([*(residuals > TOLERANCE), True]))
        done, known = np.hstack([done, q[:, :fine]]), np.append(known, values[:fine])
        if fine == kept:
            order = np.argsort(-known, kind="stable")
            fit.vectors, fit.values = done[:, order], known[order]
            return fit
        last, q, vq, values = (math.inf if fine else fit.residual), q[:, fine:], vq[:, fine:], values[fine:]
        bound = max(float(values[-1]), RANK * top)
        far, near = (math.acosh(max(1 + 1e-9, 2 * float(v) / bound - 1)) for v in (values[0], values[kept - fine - 1]))
        degree = math.acosh(max(2.0, fit.residual / AIM)) / near
        degree = min(MAX_DEGREE, math.ceil(degree), int(math.log(SPREAD) / (far - near)) if far > near else MAX_DEGREE)
        q = outside(filtered(times, q, vq, max(2, degree), bound, float(values[0])))
        q = np.linalg.qr(outside(np.linalg.qr(q)[0]))[0]
    raise ArithmeticError(f"no convergence: residual {fit.residual} after {fit.passes} passes")


def whitened(table: DataFrame, fit: Fit) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained."""
    k, d, n = len(fit.values), len(fit.sums), fit.n
    basis, explained = fit.vectors / np.sqrt(fit.values), fit.values / fit.trace if fit.trace else fit.values
    sums = np.array([int(s) for s in fit.sums], object)
    whole, rest = fit.centre

    def deviations(x):
        own = (x - whole) - rest
        if n * np.abs(x).max(initial=0) < 2**62 and max(map(abs, fit.sums), default=0) < 2**62 and float(n) ** 2 * np.einsum("ij,ij->i", own, own).max(initial=0) < 2.0**62:
            y = n * x - sums.astype(np.int64)
            return pa.array(np.einsum("ij,ij->i", y, y))
        exact = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
        return pa.array([int(v) if v < 2**63 else None for v in exact], pa.int64())

    def work(batches):
        for batch in batches:
            for ids, x in zip(batch.column("ids"), matrices(batch)):
                rows, own = len(x), (x - whole) - rest
                pick = pa.array(np.repeat(np.arange(rows), k))
                values = [
                    ids.values.take(pick),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n)),
                    deviations(x).take(pick),
                    pa.array((own @ basis).ravel()),
                    pa.array(np.tile(explained, rows)),
                ]
                yield pa.record_batch(values, ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    if not k or not d:
        table = table.limit(0)
    return table.mapInArrow(work, "vec_id long, component int, n long, deviation long, whitened double, explained double")


def identity_error(table: DataFrame, fit: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity: one pass for their means, one for the products."""
    k = len(fit.values)
    if not k:
        return 0.0
    basis, (whole, rest) = fit.vectors / np.sqrt(fit.values), fit.centre
    mean = summed(table, lambda x: (((x - whole) - rest) @ basis).sum(axis=0, keepdims=True), 1, k, fit.tasks) / fit.n

    def products(x):
        own = ((x - whole) - rest) @ basis - mean
        return own.T @ own

    return float(np.abs(summed(table, products, k, k, fit.tasks) / fit.n - np.eye(k)).max())


def whiten(vectors: DataFrame, wanted: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, Fit | None]:
    """Whitened coordinates of all usable vectors, fitted on all of them, and the fit (None without vectors)."""
    table = written(blocks(vectors, vec_id, embedding), "vectors")
    fit = counted(table)
    done = components(table, fit, wanted) if fit else Fit(0, [], np.zeros((0, 0)), np.zeros(0))
    error = identity_error(table, done)
    return whitened(table, done).withColumn("identity_error", F.lit(error)), fit


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened ``embeddings``."""
    ship(spark)
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]
