"""Whitening against a plain computation, its exact columns, and the defined cases."""

from __future__ import annotations

import math

import numpy as np
import pytest

from openchair.llm import whitening
from openchair.llm.common import Stage
from openchair.llm.spectrum import inertia, leading

VECTORS = "vec_id bigint, embedding array<float>, label int, EMBEDDING string"


def report(spark, vectors, first=0):
    rows = [(first + i, v, 1, "clash") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, VECTORS)
    return whitening.whitened_report(df, Stage(spark, "test")).toPandas().sort_values(["vec_id", "component"])


def drawn(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.linspace(1, 3, d) + 5).astype(np.float32)


@pytest.mark.parametrize("d", [1, 2, 3, 17, 40])
def test_inertia_counts_the_signs_of_eigenvalues(d):
    rng = np.random.default_rng(d)
    for flat in range(3):
        a = rng.standard_normal((d, d))
        a = a + a.T
        a[:flat, :] = a[:, :flat] = 0
        e = np.linalg.eigvalsh(a)
        assert inertia(a) == ((e > 1e-12).sum(), (e < -1e-12).sum(), (np.abs(e) <= 1e-12).sum())
    assert inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 1, 0)


def test_leading_pairs_also_where_eigenvalues_are_equal_or_zero():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    true = np.array([5.0] * 4 + [3.0] * 3 + [1 + 1e-13, 1.0] + [0.5] * 2 + [0.0] * 9)
    for scale in (1e-200, 1.0, 1e150):
        a = scale * (q * true) @ q.T
        e, u = leading(a, 32)
        assert np.allclose(e / scale, true[:11], rtol=1e-12)
        assert np.abs(u.T @ u - np.eye(11)).max() < 1e-12
        assert np.abs(a @ u - u * e).max() < 1e-12 * scale
    assert len(leading(np.zeros((4, 4)), 4)[0]) == 0
    assert np.allclose(leading(np.eye(6), 2)[0], 1)


def test_whitening_equals_a_plain_computation(spark):
    data = drawn(400, 40)
    found = report(spark, data.tolist())
    x = np.floor(64 * data.astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    plain = centred @ u / np.sqrt(e)
    w = found.whitened.to_numpy().reshape(n, 32)
    assert (found.component.to_numpy().reshape(n, 32) == np.arange(1, 33)).all()
    assert np.abs(w * np.sign((w * plain).sum(axis=0)) - plain).max() < 1e-8
    assert (found.deviation.to_numpy()[::32] == ((n * x - s) ** 2).sum(axis=1)).all()
    assert np.allclose(found.explained.to_numpy()[:32], e / np.trace(v), rtol=1e-9)
    assert (found.n == n).all() and found.identity_error.max() < 1e-9


def test_unusable_vectors_are_dropped_and_repeated_rows_stay(spark):
    good = drawn(30, 3).tolist()
    odd = [None, [], [1.0, None, 2.0], [math.nan, 1.0, 2.0], [1.0, math.inf, 2.0], [1.0, 2.0], [1e30, 0.0, 0.0]]
    clean = report(spark, good + good[:5])
    mixed = report(spark, good + good[:5] + odd)
    assert clean.vec_id.tolist() == mixed.vec_id.tolist() and len(clean) == 3 * 35
    assert np.allclose(np.abs(clean.whitened), np.abs(mixed.whitened))
    assert (mixed.n == 35).all()


def test_large_entries_are_summed_exactly(spark):
    data = np.array([[2.0**33, 1.0], [-(2.0**33), 2.0], [0.0, 4.0]], dtype=np.float32)
    found = report(spark, data.tolist())
    x = [[int(math.floor(64 * c)) + 1_000_000 for c in row] for row in data.tolist()]
    s = [sum(column) for column in zip(*x)]
    true = [sum((3 * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    for vec_id, deviation in zip(found.vec_id, found.deviation):
        assert math.isnan(deviation) if true[vec_id] >= 2**63 else deviation == true[vec_id]
    assert found.identity_error.max() < 1e-4


def test_no_rows_without_vectors_or_without_variance(spark):
    for vectors in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 4):
        assert len(report(spark, vectors)) == 0


def test_components_end_at_the_rank(spark):
    flat = drawn(50, 2)
    found = report(spark, np.column_stack([flat, flat[:, 0]]).tolist())
    assert set(found.component) == {1, 2}
    assert found.identity_error.max() < 1e-9
