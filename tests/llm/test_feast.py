"""FEAST whitening against dense eigenvalues and exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from skein.llm import feast_whitening as FW


def spd(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))
    return (q * np.array(values, float)) @ q.T


@pytest.mark.parametrize("values", [
    [100, 90, 80, 70, 60, 50, 40, 30, 20, 10, 5, 1],
    [1e6, 1e4, 1e3, 1, 0.1, 1e-2, 1e-3, 1e-4, 1e-4, 1e-5],
    [5] * 12,
    [9, 9, 9, 4, 4, 4, 4, 4, 4, 4, 1, 1],
    list(1 + 1e-3 * np.arange(40)),
    list(np.random.default_rng(2).uniform(1, 2, 64)),
    [3, 2, 1],
    [7],
])
def test_components_against_a_dense_solver(values):
    v = spd(values)
    e, x = FW.leading(v)
    k = min(8, len(values))
    want = np.sort(values)[::-1][:k]
    count = FW.Inertia(v)
    assert np.all(np.abs(e - want) <= 1e-12 * want[0])
    assert np.abs(x.T @ x - np.eye(k)).max() < 1e-9
    assert np.linalg.norm(v @ x - x * e, axis=0).max() <= 1e-12 * want[0]
    ordered = sorted(set(np.round(values, 9)))
    for lo, hi in zip(ordered, ordered[1:]):
        assert count.above((lo + hi) / 2) == (np.array(values) > (lo + hi) / 2).sum()


def test_no_variance():
    assert len(FW.leading(np.zeros((5, 5)))[0]) == 0
    e, _ = FW.leading(spd([4, 2, 0, 0, 0]))
    assert np.allclose(e, [4, 2])


def test_whitening_of_a_table(spark):
    rng = np.random.default_rng(5)
    mats = (rng.standard_normal((400, 12)) * np.linspace(1, 3, 12)).astype(np.float32)
    rows = [(i, [float(c) for c in m], "x") for i, m in enumerate(mats)]
    rows += [(3, rows[3][1], "x"), (None, rows[4][1], "x")]
    nan, inf = float("nan"), float("inf")
    bad = [(900, None, "x"), (901, [], "x"), (902, [nan] + [0.0] * 11, "x"), (903, [-inf] + [0.0] * 11, "x"),
           (904, [None] + [0.0] * 11, "x"), (905, [1.0, 2.0], "x"), (906, [1e30] + [0.0] * 11, "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, component string").repartition(3)
    got = FW.whiten(df).collect()
    n = len(rows)
    assert len(got) == n * 8 and {r.component for r in got} == set(range(1, 9)) and {r.n for r in got} == {n}
    xs = [[math.floor(1024 * c) + 100000 for c in v] for _, v, _ in rows]
    sums = [sum(c) for c in zip(*xs)]
    dev = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for (i, _, _), x in zip(rows, xs)}
    assert all(r.deviation == dev[r.vec_id] for r in got)
    centred = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(x, sums)] for x in xs])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    z = {i: w for (i, _, _), w in zip(rows, centred @ u[:, ::-1][:, :8] / np.sqrt(e[::-1][:8]))}
    signs = {}
    for r in got:
        want = z[r.vec_id][r.component - 1]
        if abs(want) > 1e-6:
            signs.setdefault(r.component, np.sign(want * r.whitened))
            assert abs(r.whitened * signs[r.component] - want) < 1e-8
        assert abs(r.explained - e[::-1][r.component - 1] / e.sum()) < 1e-10
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert FW.whiten(df.limit(0)).count() == 0 and FW.whiten(df.where("vec_id >= 902 and vec_id < 905")).count() == 0


def test_few_vectors(spark):
    """Two vectors have one direction; one has none."""
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0]), (2, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in FW.whiten(df).collect()}
    assert len(got) == 6 and abs(got[1, 1].whitened) == pytest.approx(1) and got[1, 1].explained == pytest.approx(1)
    assert got[1, 2].whitened is None and got[2, 3].whitened is None
    one = FW.whiten(df.where("vec_id = 1")).collect()
    assert [(r.component, r.whitened, r.explained, r.deviation) for r in one] == [(c, None, 0.0, 0) for c in (1, 2, 3)]


def test_deviation_beyond_a_long():
    x = np.array([[100_000, 2_000_000], [100_001, 99_000]])
    n, sums = 10_000_000, [10 ** 12, 10 ** 12]
    want = [sum((n * v - t) ** 2 for v, t in zip(r, sums)) for r in x.tolist()]
    assert FW.deviations(x, n, sums) == [w if w < 1 << 63 else None for w in want] and want[0] >= 1 << 63


def test_query(spark):
    from skein.llm import queries as Q

    got = Q.op12_feast_whitening(spark, "/root/testdata/sf0.001").toPandas()
    assert got.identity_error.max() < 1e-9 and set(got.component) == set(range(1, 9))
    assert got.groupby("vec_id").size().eq(8).all()


@pytest.mark.parametrize("rows", [2_000_000, 20_000_000, 10 ** 12])
def test_eigenvalues_of_very_many_vectors_without_structure(rows):
    """The covariance of that many random vectors, by Bartlett's decomposition."""
    rng, d = np.random.default_rng(3), 64
    a = np.tril(rng.standard_normal((d, d)), -1) + np.diag(np.sqrt(rng.chisquare(rows - np.arange(d))))
    v = a @ a.T / rows * 16300
    e, x = FW.leading(v)
    assert np.abs(e - np.linalg.eigvalsh(v)[::-1][:8]).max() <= 1e-12 * e[0]
    assert np.abs(x.T @ x - np.eye(8)).max() < 1e-9
    assert np.linalg.norm(v @ x - x * e, axis=0).max() <= 1e-12 * e[0]


def test_more_equal_eigenvalues_than_components_look_ahead():
    v = np.eye(64) - 1 / 64  # one vector per axis
    e, x = FW.leading(v)
    assert np.abs(e - 1).max() < 1e-12 and np.abs(x.T @ x - np.eye(8)).max() < 1e-9
    assert np.abs(v @ x - x).max() < 1e-12
