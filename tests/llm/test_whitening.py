"""Whitening against numpy's eigenvectors and exact integer arithmetic."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x binary, n long"


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, 0, None, 1) for i, v in vectors], SCHEMA).repartition(parts)


def by_numpy(vectors):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    own = (x - np.array([int(s) // n for s in sums], object)).astype(float) - np.array([int(s) % n / n for s in sums])
    values, basis = np.linalg.eigh(own.T @ own / n)
    return n, deviation, own, values[::-1], basis[:, ::-1]


@pytest.mark.parametrize("d, rows, seed", [(64, 700, 0), (80, 500, 1), (20, 300, 2)])
def test_components_equal_dense_eigenvectors(spark, d, rows, seed):
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((rows, d)) * np.geomspace(4, 0.5, d)).tolist()
    found, fit = whitening.whiten(table(spark, enumerate(vectors)))
    got = found.toPandas().sort_values(["vec_id", "component"])
    n, deviation, own, values, basis = by_numpy(vectors)
    k = min(32, d)
    assert len(got) == rows * k and set(got.n) == {n}
    assert got.deviation.tolist() == [int(v) for v in np.repeat(deviation, k)]
    assert np.allclose(got.explained.to_numpy().reshape(rows, k), values[:k] / values.sum(), rtol=1e-10)
    expected, white = own @ basis[:, :k] / np.sqrt(values[:k]), got.whitened.to_numpy().reshape(rows, k)
    assert np.allclose(white * np.sign((white * expected).sum(axis=0)), expected, atol=1e-8)
    assert np.abs(np.cov(white.T, bias=True) - np.eye(k)).max() < 1e-10 and got.identity_error.max() < 1e-10
    assert fit.residual < 1e-12


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    good = [[float(c) for c in rng.standard_normal(4)] for _ in range(6)]
    rows = [(1, good[0]), (1, good[0]), (None, good[1]), *[(i + 2, v) for i, v in enumerate(good[2:])]]
    bad = [(90, None), (91, [1.0, None, 0.0, 1.0]), (92, [float("nan"), 1.0, 1.0, 1.0]), (93, [float("inf"), 1.0, 1.0, 1.0])]
    got = whitening.whiten(table(spark, rows + bad))[0].collect()
    assert {r.n for r in got} == {7} and len(got) == 7 * 4
    assert sum(r.vec_id is None for r in got) == 4 and sum(r.vec_id == 1 for r in got) == 8


def test_few_and_no_vectors(spark):
    assert whitening.whiten(table(spark, []))[0].collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])]))[0].collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))[0].collect() == []
    two = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])]))[0].collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 12), round(r.explained, 12)) for r in two) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_different_lengths_are_refused(spark):
    with pytest.raises(Exception, match="vectors of"):
        whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [3.0])], 1))


def test_one_vector_with_a_third_of_all_rows(spark):
    """One eigenvalue far above the rest: it is locked, and the others converge to the same accuracy."""
    rng = np.random.default_rng(4)
    own = (rng.standard_normal((600, 64)) + 0.0).tolist()
    hot = (20 * rng.standard_normal(64)).tolist()
    found, fit = whitening.whiten(table(spark, enumerate(own + [hot] * 300)))
    assert found.first().identity_error < 1e-10 and fit.passes < 100
    _, _, x, values, basis = by_numpy(own + [hot] * 300)
    assert np.allclose(fit.values, values[:32], rtol=1e-10)
    assert np.allclose(np.abs((fit.vectors * basis[:, :32]).sum(axis=0)), 1, atol=1e-9)
