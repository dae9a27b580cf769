import numpy as np

from strandlake.operators import splines


def test_banded_solve_is_the_dense_one():
    rng = np.random.default_rng(0)
    a = np.zeros((50, 50))
    for d in range(4):
        v = rng.normal(size=50 - d) * 0.3
        a += np.diag(v, d) + (np.diag(v, -d) if d else 0)
    a += 6 * np.eye(50)
    bands = np.zeros((4, 50))
    for d in range(4):
        bands[d, :50 - d] = np.diag(a, d)
    rhs = rng.normal(size=(50, 3))
    assert np.allclose(splines.banded_solve(bands, rhs), np.linalg.solve(a, rhs))


def test_residual_meets_its_target():
    rng = np.random.default_rng(1)
    u = np.linspace(0, 200, 220)
    true = np.stack([u, 20 * np.sin(u / 30), 10 * np.cos(u / 20)], 1)
    p = true + rng.normal(size=true.shape) * 0.28
    w = np.ones(220)
    w[[0, -1, 100]] = splines.PIN_WEIGHT
    out = splines.fitted(u, p, w, 0.25 * 220)(u)
    assert abs((((out - p) ** 2).sum(1) * w * w).sum() - 55) < 0.1
    assert np.abs(out - true).mean() < 0.6 * np.abs(p - true).mean() and np.abs(out[100] - p[100]).max() < 0.01


def test_long_curves_are_fitted_in_windows(spark):
    """Windows agree where they meet: no jump, pins kept, and the same as one fit away from the ends."""
    n = 5000
    t = np.arange(n) * 0.9
    p = np.stack([t, 30 * np.sin(t / 40), 12 * np.cos(t / 25)], 1) + np.random.default_rng(2).normal(size=(n, 3)) * 0.28
    rows = [(7, i, *map(float, p[i]), i == 2500) for i in range(n)]
    rows += [(8, i, float(i), 0.0, 0.0, False) for i in range(3)] + [(9, i, 1.0, 1.0, 1.0, False) for i in range(6)]
    df = spark.createDataFrame(rows, "curve int, seq long, z double, y double, x double, pin boolean").repartition(5)
    got = splines.spline_curves(df).orderBy("curve", "seq").collect()
    c = np.array([(r.z, r.y, r.x) for r in got if r.curve == 7])
    assert [r.seq for r in got if r.curve == 7] == list(range(len(c)))
    step = np.linalg.norm(np.diff(c, axis=0), axis=1)
    assert (c[0] == p[0]).all() and (c[-1] == p[-1]).all() and (c == p[2500]).all(1).any()
    assert step.max() < 2 and np.median(step) < 1.2
    clean = lambda q: np.abs(q - np.stack([q[:, 0], 30 * np.sin(q[:, 0] / 40), 12 * np.cos(q[:, 0] / 25)], 1)).mean()
    assert clean(c) < 0.75 * clean(p)
    assert [(r.z, r.y, r.x) for r in got if r.curve == 8] == [(float(i), 0.0, 0.0) for i in range(3)]
    assert sum(r.curve == 9 for r in got) == 6
    assert splines.spline_curves(df.limit(0)).collect() == []
