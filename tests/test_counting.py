"""Inversions and rank correlation between folds, against counting all pairs."""

import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dosewise.functions.counting import inversions
from dosewise.operators.stats import kendall_tau


def slow_inversions(v, w):
    return sum(int(w[i] * w[j]) for i in range(len(v)) for j in range(i + 1, len(v)) if v[i] > v[j])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 20), st.integers(1, 5)), max_size=40))
def test_inversions_count_all_pairs(rows):
    v, w = [r[0] for r in rows], [r[1] for r in rows]
    assert inversions(v, w) == slow_inversions(v, w)


def slow_tau(x, y):
    pairs = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i in range(len(x)) for j in range(i + 1, len(x))]
    den = sum(a != 0 for a, _ in pairs) * sum(b != 0 for _, b in pairs)
    return sum(a * b for a, b in pairs) / math.sqrt(den) if den else None


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_tau_of_folds_with_ties_gaps_and_a_hot_value(spark, partitions):
    rng = np.random.default_rng(partitions)
    rows, by = [], defaultdict(dict)
    for fold in range(4):
        for feature in range(150):
            v = None if rng.random() < 0.1 else float(rng.integers(0, 400)) if rng.random() < 0.6 else 7.0
            v = 7.0 if fold == 3 else v  # a fold of one value has no tau
            rows.append((fold, f"f{feature}", v))
            if v is not None:
                by[fold][feature] = v
    df = spark.createDataFrame(rows, "fold int, feature string, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.fold_a, r.fold_b): (r.n, r.tau) for r in kendall_tau(df, "fold", "feature", "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 12
    for (a, b), (n, tau) in got.items():
        common = sorted(by[a].keys() & by[b].keys())
        want = slow_tau([by[a][f] for f in common], [by[b][f] for f in common])
        assert n == len(common) and (tau is None if want is None else tau == pytest.approx(want, abs=1e-12))


def test_tau_of_text_and_of_an_empty_table(spark):
    rows = [(0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (1, 1, "x"), (1, 2, "z"), (1, 3, "y")]
    df = spark.createDataFrame(rows, "fold int, feature int, v string")
    assert {(r.fold_a, r.fold_b): round(r.tau, 12) for r in kendall_tau(df, "fold", "feature", "v").collect()} == {(0, 1): round(1 / 3, 12), (1, 0): round(1 / 3, 12)}
    assert kendall_tau(df.limit(0), "fold", "feature", "v").count() == 0
