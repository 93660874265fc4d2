"""Whitening against numpy's dense eigendecomposition: ties, nulls, hot vectors, ragged, empty and far-out vectors."""

import numpy as np
import pytest

from vocabloom.llm import whitening

R = np.random.default_rng(3)
SCHEMA = "vec_id long, embedding array<float>, label string, component string, x int"


def table(spark, vectors, parts=5):
    rows = [(None if i % 50 == 7 else i, v, "a", "b", 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def whole(vectors):
    good = [v for v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    return np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in good])


@pytest.mark.parametrize("size", [12, 3])
def test_whitening(spark, size):
    vectors = [list(map(float, v)) for v in R.normal(size=(300, size)) * np.linspace(0.05, 0.6, size)]
    vectors += [vectors[0]] * 150  # a third of all rows are one vector
    vectors += [None, [], [None] * size, [float("nan")] * size, [1.0] * (size - 1) + [float("inf")], [1.0] * (size + 1), [0.5]]
    x = whole([v for v in vectors if v and len(v) == size])
    n, sums = len(x), x.sum(axis=0)
    away = x - x.mean(axis=0)
    cov = away.T @ away / n
    vals, vecs = np.linalg.eigh(cov)
    vals, vecs = vals[::-1], vecs[:, ::-1]
    got = whitening.whiten(table(spark, vectors)).collect()
    k = min(8, size)
    assert len(got) == n * k and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    assert sorted(r.deviation for r in got) == sorted(int(((n * v - sums) ** 2).sum()) for v in x for _ in range(k))
    want = away @ vecs[:, :k] / np.sqrt(vals[:k])
    for c in range(k):
        own = sorted(((r.vec_id is None, r.vec_id), r.whitened) for r in got if r.component == c + 1 and r.vec_id is not None)
        ref = [(i, w) for i, w in enumerate(want[:, c]) if i % 50 != 7]
        mine, theirs = np.array([w for _, w in own]), np.array([w for _, w in ref])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-8
        assert all(abs(r.explained - vals[c] / vals.sum()) < 1e-12 for r in got if r.component == c + 1)
    assert {r.identity_error for r in got if r.identity_error > 1e-9} == set() and len({r.identity_error for r in got}) == 1


def test_few_directions(spark):
    """Vectors that vary in two directions have two components, equal ones none, and one vector none."""
    vectors = [[float(i % 7), 2.0 * (i % 7), float(i % 5), 3.0] for i in range(70)]
    got = whitening.whiten(table(spark, vectors)).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-9
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 9)).count() == 0
    assert whitening.whiten(table(spark, [[1.0, 2.0]], 1)).count() == 0
    assert whitening.whiten(table(spark, [None, []], 1)).count() == 0
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "component", "n"]


def test_far_entries(spark):
    """Entries too far out for a long are held; deviations beyond a long are null."""
    vectors = [[1e30, 0.5], [-1e30, 0.25], [3.0, 0.75], [4.0, 0.5]]
    got = whitening.whiten(table(spark, vectors)).collect()
    assert len(got) == 4 and {r.vec_id: r.deviation is None for r in got} == {0: True, 1: True, 2: False, 3: False}
    assert whitening.exact_deviation(np.array([[3, 5], [1 << 52, 7]]), 3, [4, 6]) == [106, None]


def test_rank_one_updates():
    """Spectra of rows in any order and any parts are those of the scatter; vectors stay orthogonal."""
    for size, rows in ((1, 9), (2, 40), (9, 300), (20, 8)):
        x = np.floor(R.normal(size=(rows, size)) * 100).astype(np.int64)
        if size == 9:
            x[:, 3] = x[:, 4]
            x[:, 5] = 2
        away = x - x.mean(axis=0)
        scatter = away.T @ away
        one = whitening.Spectrum.none(size)
        one.add(x)
        two, three = whitening.Spectrum.none(size), whitening.Spectrum.none(size)
        two.add(x[: rows // 3])
        three.add(x[rows // 3 :])
        two.join(three)
        for s in (one, two):
            assert s.n == rows and s.sums == x.sum(axis=0).tolist()
            assert np.abs(s.vecs @ np.diag(s.vals) @ s.vecs.T - scatter).max() < 1e-10 * max(1, np.abs(scatter).max())
            assert np.abs(s.vecs.T @ s.vecs - np.eye(size)).max() < 1e-12


def test_roots():
    """Roots lie between poles that are next to each other, however near these are."""
    d = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-7, 5.0])
    z = np.array([1e-3, 1.0, 1e-6, 2.0, 1.0])
    m, far = whitening.roots(d, z)
    assert (m[:-1] >= d[:-1]).all() and (m[:-1] <= d[1:]).all() and m[-1] > 5
    assert np.allclose(np.sort(np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))), m, rtol=1e-12, atol=1e-14)
    assert (np.sign(far) == np.sign(np.tri(5) - 0.5)).all()
