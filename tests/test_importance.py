"""Permutation importance in closed form, against every shuffle and against many shuffles."""

import itertools

import numpy as np
import pytest

from dosewise.operators.models import permutation_importance

NAMES = ["a", "b", "flat"]


def table(spark, sizes, seed):
    """Rows (block, fold, x, y): folds cut through blocks, the third feature is constant in every block."""
    rng = np.random.default_rng(seed)
    rows = []
    for block, n in enumerate(sizes):
        for i in range(n):
            x = [*rng.normal(size=2).round(3), float(block)]
            rows.append((block, int(i % 2), [float(v) for v in x], float((2 * x[0] - x[1] + rng.normal()).round(3))))
    fits = [(0, [1.5, -0.4, 0.3], [0.0, 0.0, 0.0], 0.1), (1, [2.2, 0.7, -0.2], [0.0, 0.0, 0.0], -0.3)]
    df = spark.createDataFrame(rows, "block int, fold int, x array<double>, y double")
    return rows, {f[0]: f for f in fits}, df, spark.createDataFrame(fits, "fold int, coef array<double>, median array<double>, intercept double")


def losses(rows, fits, j, shuffles):
    """R2 and r lost in every shuffle: a list of arrays of places."""
    x = np.array([r[2] for r in rows])
    y = np.array([r[3] for r in rows])
    b = np.array([fits[r[1]][1] for r in rows])
    c = np.array([fits[r[1]][3] for r in rows])

    def scores(z):
        p = c + (z * b).sum(axis=1)
        return 1 - ((y - p) ** 2).mean() / y.var(), np.corrcoef(p, y)[0, 1]

    base, out = scores(x), []
    for places in shuffles:
        z = x.copy()
        z[:, j] = x[places, j]
        out.append(np.subtract(base, scores(z)))
    return np.array(out)


def found(df, fits):
    return {r.feature: r for r in permutation_importance(df, fits, "x", NAMES, "y", ["block"]).collect()}


def test_mean_and_spread_are_those_of_all_shuffles(spark):
    rows, fits, df, table_of_fits = table(spark, [4, 3, 1], 1)
    orders = [[*p, *(4 + k for k in q), 7] for p in itertools.permutations(range(4)) for q in itertools.permutations(range(3))]
    got = found(df, table_of_fits)
    for j, name in enumerate(NAMES):
        want = losses(rows, fits, j, [np.array(o) for o in orders])[:, 0]
        assert got[name].importance == pytest.approx(want.mean(), abs=1e-12)
        assert got[name].sd == pytest.approx(want.std(), abs=1e-12)
    assert tuple(got["flat"])[1:] == (0.0, 0.0, 0.0)


def test_close_to_five_thousand_shuffles(spark):
    rows, fits, df, table_of_fits = table(spark, [30, 50, 20, 100], 2)
    rng = np.random.default_rng(3)
    starts = np.r_[0, np.cumsum([30, 50, 20, 100])]
    orders = [np.concatenate([rng.permutation(np.arange(a, b)) for a, b in zip(starts, starts[1:])]) for _ in range(5000)]
    got = found(df, table_of_fits)
    for j, name in enumerate(NAMES[:2]):
        want = losses(rows, fits, j, orders)
        assert got[name].importance == pytest.approx(want[:, 0].mean(), abs=5 * got[name].sd / 70)
        assert got[name].sd == pytest.approx(want[:, 0].std(), rel=0.05)
        assert got[name].importance_r == pytest.approx(want[:, 1].mean(), abs=0.01)


def test_missing_values_and_flat_targets(spark):
    rows, _, _, fits = table(spark, [6, 5], 4)
    more = [*rows, (0, 0, None, 1.0), (1, 1, [1.0, 2.0, 3.0], None), (None, 0, [1.0, None, 0.0], 2.0), (None, 1, [4.0, 1.0, 0.0], 5.0)]
    schema = "block int, fold int, x array<double>, y double"
    full = [(b, f, x if x is None else [0.0 if v is None else v for v in x], y) for b, f, x, y in more if x is not None and y is not None]
    a, b = (found(spark.createDataFrame(t, schema), fits) for t in (more, full))
    assert a.keys() == b.keys() and all(tuple(a[k])[1:] == pytest.approx(tuple(b[k])[1:]) for k in a)
    flat = found(spark.createDataFrame([(b, f, x, 1.0) for b, f, x, _ in rows], schema), fits)
    assert all(tuple(r)[1:] == (0.0, 0.0, 0.0) for r in flat.values())
    assert found(spark.createDataFrame([], schema), fits) == {}
