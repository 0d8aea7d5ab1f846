"""Whitening against numpy's eigenvectors, and the spectrum's slices by themselves."""

import math

import numpy as np
import pytest

from plumbline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x int, n string, component int"


def whitened(df, k=whitening.K):
    return sorted((tuple(r) for r in whitening.whiten(df, k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def check(df, k=whitening.K):
    got = whitened(df, k)
    rows = [(r.vec_id, [math.floor(256 * float(c)) for c in r.embedding]) for r in df.collect()
            if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    fit = sorted({tuple(x) for _, x in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    exact = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit], object)
    covariance = (exact.T @ exact).astype(float) / n ** 3
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    kept = int((values > 1e-9 * values[0]).sum())
    assert len(got) == kept * len(rows)
    exact = [[n * c - s for c, s in zip(x, sums, strict=True)] for _, x in rows]
    projected = (np.array(exact, float) / n) @ vectors[:, :kept] / np.sqrt(values[:kept])
    # Rows of one vec_id are equal here, so the order of the keys is that of all values.
    wanted = sorted(((i, k + 1, sum(c * c for c in apart), whitened[k]) for (i, _), apart, whitened in zip(rows, exact, projected, strict=True)
                     for k in range(kept)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [(r[0], r[1], r[3]) for r in got] == [w[:3] for w in wanted]
    for k in range(1, kept + 1):
        pairs = [(r[4], w[3]) for r, w in zip(got, wanted, strict=True) if r[1] == k]
        sign = np.sign(sum(a * b for a, b in pairs))
        assert max(abs(a * sign - b) for a, b in pairs) < 1e-8
    for row in got:
        assert row[2] == n and abs(row[5] - values[row[1] - 1] / np.trace(covariance)) < 1e-12 and row[6] < 1e-9
    return got


def test_embeddings(spark, data_dir):
    df = spark.read.parquet(f"{data_dir}/embeddings.parquet")
    check(df)


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist(), 1, "a", 2) for i in range(30)]
    rows += [rows[3], rows[3], (31, rows[3][1], 9, None, None), (None, [1.0, 2.0, 3.0], 0, "", 0)]
    odd = [(40, None, 1, "b", 1), (41, [1.0, None, 2.0], 1, "b", 1), (42, [1.0, float("nan"), 0.0], 1, "", 1), (43, [1.0, float("inf"), 0.0], 1, "", 1)]
    check(spark.createDataFrame(rows + odd, SCHEMA))
    ragged = spark.createDataFrame(rows + odd + [(50, [1.0, 2.0], 1, "", 1), (51, [], 1, "", 1)], SCHEMA)
    assert {r[0] for r in whitened(ragged)} == {*range(30), 31, None}


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, []]])
def test_without_variance_there_are_no_components(spark, vectors):
    assert whitened(spark.createDataFrame([(i, v, 1, "", 1) for i, v in enumerate(vectors)], SCHEMA)) == []


def test_fewer_directions_than_components(spark):
    check(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 1, "", 1) for i in range(9)], SCHEMA))


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [1e6 + float(v) for v in rng.integers(0, 50, 4)], 1, "", 1) for i in range(40)]
    check(spark.createDataFrame(rows, SCHEMA))
    huge = spark.createDataFrame([(i, [1e10 * i, 1.0], 1, "", 1) for i in range(9)], SCHEMA)
    assert {r[0] for r in whitened(huge) if r[3] is None} == {0, 1, 2, 3, 5, 6, 7, 8}  # number 4 is the mean


def spectra():
    rng = np.random.default_rng(8)
    for values in ([5.0, 4.0, 3.0, 2.0, 1.0], [3.0, 3.0, 3.0, 1.0, 0.0], [1.0, 1.0 - 1e-13, 1.0 - 1e-9, 0.5], [1e12, 1.0, 1e-3, 1e-9],
                   [2.0] * 6, [7.0, 0.0, 0.0], [1.0], [4.0, 4.0 + 1e-15, 1e-300, 0.0], list(rng.random(40))):
        q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
        matrix = (q * np.array(values)) @ q.T
        yield (matrix + matrix.T) / 2, sorted(values, reverse=True)
        yield np.diag(values), sorted(values, reverse=True)


def test_leading_pairs_of_many_spectra():
    for matrix, values in spectra():
        found = whitening.leading(matrix, 4)
        scale = max(values)
        assert len(found) >= sum(v > 1e-10 * scale for v in values[:4])
        basis = np.array([v for _, v in found])
        assert np.abs(basis @ basis.T - np.eye(len(found))).max() < 1e-12
        for (value, vector), wanted in zip(found, values, strict=False):
            assert abs(value - wanted) < 1e-12 * scale
            assert np.linalg.norm(matrix @ vector - value * vector) < 1e-12 * scale


def test_positive_pivots_count_eigenvalues():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(-3, 4, (int(rng.integers(1, 9)),) * 2).astype(float)
        values = np.linalg.eigvalsh(a + a.T)
        if np.abs(values).min() > 1e-9:
            assert whitening.positive_pivots(a + a.T) == (values > 0).sum()
