"""Embedding whitening against numpy's own eigenvectors."""

import math

import numpy as np
import pytest

from hydroloom.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int"


def plain(rows, components=32):
    """Per (vec_id, component): deviation and whitened value without sign; and eigenvalue shares."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    whole = np.array([[n * c - s for c, s in zip(v, sums)] for v in x], float) / n
    values, vectors = np.linalg.eigh(whole.T @ whole / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = int((values[:components] > values[0] * 1e-12).sum())
    white = whole @ vectors[:, :count] / np.sqrt(values[:count])
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    return {(i, k + 1): (n, d, abs(w[k]), values[k] / values.sum()) for (i, _), d, w in zip(kept, deviation, white) for k in range(count)}


def compare(frame, want):
    got = {(r["vec_id"], r["component"]): r for r in frame.collect()}
    assert set(got) == set(want)
    for key, (n, deviation, whitened, explained) in want.items():
        r = got[key]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(abs(r["whitened"]) - whitened) < 1e-9 and abs(r["explained"] / explained - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_equal_to_a_direct_decomposition(spark):
    rng = np.random.default_rng(2)
    mixed = rng.normal(size=(700, 40)) * np.linspace(1, 3, 40) @ rng.normal(size=(40, 40)) / 7
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(mixed)]
    rows += [(1000 + k, rows[5][1]) for k in range(150)]  # copies
    rows += [(2000, None), (2001, []), (2002, [1.0] * 39 + [None]), (2003, [float("nan")] * 40), (2004, [math.inf] + [0.0] * 39), (2005, [-math.inf] * 40)]
    frame = spark.createDataFrame([(i, v, 1, "a", 2) for i, v in rows], SCHEMA).repartition(11)
    compare(whiten.whiten(frame), plain(rows))


def test_few_or_equal_rows(spark):
    rows = [(k, [float(k == j) * (j + 1) for j in range(6)]) for k in range(4)]
    compare(whiten.whiten(spark.createDataFrame([(i, v, 1, "a", 2) for i, v in rows], SCHEMA)), plain(rows))
    same = spark.createDataFrame([(k, [1.0, 2.0], 1, "a", 2) for k in range(5)], SCHEMA)
    assert whiten.whiten(same).count() == 0 and whiten.whiten(same.limit(0)).count() == 0
    mixed = spark.createDataFrame([(1, [1.0], 1, "a", 2), (2, [1.0, 2.0], 1, "a", 2)], SCHEMA)
    with pytest.raises(Exception, match="length"):
        whiten.whiten(mixed).count()


def test_rank_one_changes_with_deflation():
    rng = np.random.default_rng(4)
    for size in (1, 2, 5, 12):
        matrix = np.zeros((size, size))
        d, u = np.zeros((1, size)), np.eye(size)[None]
        for k in range(30):
            x = rng.integers(-3, 4, size) * (rng.random(size) < 0.5)  # many zeros, repeats and parallel rows
            matrix += 0.5 * np.outer(x, x)
            d, u = whiten.rank_one(d, u, x[None].astype(float), np.array([0.5]))
            assert np.abs(u[0] @ np.diag(d[0]) @ u[0].T - matrix).max() < 1e-8 * max(1, matrix.max())
            assert np.abs(u[0].T @ u[0] - np.eye(size)).max() < 1e-12


def test_deviation_beyond_a_long_is_null():
    assert whiten._exact(np.array([2**31, 2**31], object)) is None or whiten._exact(np.array([2**31], object)) == 2**62
    assert whiten._exact(np.array([3037000500], object)) is None and whiten._exact(np.array([3037000499], object)) == 3037000499**2
