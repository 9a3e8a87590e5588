"""The Jacobi-Davidson solver and whitened rows, held against dense eigenvalues, and tables of odd kinds."""

import numpy as np
import pytest

from catalogcheck.llm import whitening as wh


@pytest.mark.parametrize(("dim", "decay"), [(200, 1.0), (64, 0.0), (400, 0.3), (40, 2.0), (20, 0.5), (1, 0.0)])
def test_eigenpairs_of_dense_matrices(dim, decay):
    rng = np.random.default_rng(dim)
    q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    spectrum = np.sort(rng.random(dim) * np.exp(-decay * np.arange(dim) / 20))[::-1] * 1000
    whole = (q * spectrum) @ q.T
    whole = (whole + whole.T) / 2
    values, vectors, products = wh.eigenpairs(lambda p: whole @ p, dim)
    assert len(values) == min(32, dim)
    assert np.allclose(values, np.linalg.eigvalsh(whole)[::-1][: len(values)], rtol=0, atol=1e-11 * spectrum[0])
    assert np.linalg.norm(whole @ vectors - vectors * values, axis=0).max() < 1e-12 * spectrum[0]
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(products, whole @ vectors, atol=1e-10 * spectrum[0])


def test_repeated_eigenvalues_and_a_low_rank():
    whole = np.diag([5.0] * 20 + [3.0] * 20 + [0.0] * 60)
    values, vectors, _ = wh.eigenpairs(lambda p: whole @ p, 100)
    assert np.allclose(values, [5.0] * 20 + [3.0] * 12)
    assert np.linalg.norm(whole @ vectors - vectors * values, axis=0).max() < 1e-12


def test_a_target_late_in_the_subspace_is_not_skipped():
    """The start basis is orthogonal to the leading vector but for rounding in most columns."""
    whole = np.diag(np.concatenate([[1e6], np.linspace(1, 2, 299)]))
    values, *_ = wh.eigenpairs(lambda p: whole @ p, 300)
    assert np.allclose(values, np.concatenate([[1e6], np.linspace(1, 2, 299)[::-1][:31]]), rtol=1e-9)


def brute(vectors):
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    centred = x - total / n
    v = centred.T @ centred / n
    values, turn = np.linalg.eigh(v)
    values, turn = values[::-1][:32], turn[:, ::-1][:, :32]
    return n, ((n * x - total) ** 2).sum(1), centred @ turn / np.sqrt(values), values / np.trace(v)


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + extra)


def test_whitened_equals_the_dense_result(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((700, 48)) @ rng.standard_normal((48, 48))).astype(np.float32)
    vectors[100:300] = vectors[7]
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(vectors)]
    odd = [(-1, None), (-2, [1.0, None] + [0.0] * 46), (-3, [float("nan")] * 48), (-4, [float("inf")] * 48), (-5, [1.0] * 47), (-6, [])]
    got = wh.whitened(table(spark, rows + odd).repartition(5)).toPandas().sort_values(["vec_id", "component"])
    n, deviation, whitened, explained = brute(vectors.astype(float))
    assert len(got) == 700 * 32 and set(got.n) == {n} and list(got.component[:32]) == list(range(1, 33))
    assert (got.deviation.to_numpy().reshape(700, 32) == deviation[:, None]).all()
    assert np.allclose(np.abs(got.whitened.to_numpy().reshape(700, 32)), np.abs(whitened), atol=1e-8)
    assert np.allclose(got.explained.to_numpy().reshape(700, 32), explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_odd_tables(spark):
    assert wh.whitened(table(spark, [])).collect() == []
    assert wh.whitened(table(spark, [(1, None), (2, [])])).collect() == []
    one = wh.whitened(table(spark, [(None, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(None, 1, 1, 0, 0.0, 0.0, 0.0), (None, 2, 1, 0, 0.0, 0.0, 0.0)]
    two = wh.whitened(table(spark, [(1, [0.0, 0.0]), (1, [1.0, 0.0])])).toPandas()  # rank one; ids may repeat
    assert sorted(round(abs(w), 12) for w in two.whitened) == [0.0, 0.0, 1.0, 1.0]
    far = wh.whitened(table(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0])])).toPandas()
    assert far.deviation.isna().any() and np.isfinite(far.whitened).all()
    extra = table(spark, [(1, [0.0], 5, "d"), (2, [1.0], 6, None)], ", n long, data string")
    assert wh.whitened(extra).count() == 2


def test_deviation_beyond_native_steps_is_exact():
    x = np.array([[1 << 33, 0], [3, 4]], np.int64)
    assert wh.exact_deviation(x, 2, x.sum(0)) == [None, None]
    x = np.array([[1 << 30, 0], [3, 4]], np.int64)
    total = [int(c) for c in x.sum(0)]
    assert wh.exact_deviation(x, 2, x.sum(0)) == [sum((2 * int(c) - t) ** 2 for c, t in zip(row, total, strict=True)) for row in x]
