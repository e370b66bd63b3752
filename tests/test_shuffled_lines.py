"""Pooled scores against shuffles, added up in the tasks, held against sums per group and replicate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.functions import shuffles
from dosewise.operators import models, resample

REPS = 40


def rows_of(spark, n, groups, scattered=False, constant=False):
    rng = np.random.default_rng(n + groups)
    x = np.full(n, 44.3) if constant else 40 + rng.integers(0, 5, n)
    y = 0.3 * x + rng.normal(size=n) + 100
    g = rng.integers(0, groups, n) if scattered else np.sort(rng.integers(0, groups, n))
    rows = [(None if k == 1 else int(k), i, float(a), float(b)) for i, (k, a, b) in enumerate(zip(g, x, y))]
    return spark.createDataFrame(rows + [(0, n, None, 1.0), (0, n + 1, 1.0, None)], "g long, i long, x double, y double")


def by_rows(df):
    """As it was: a row for each group and replicate."""
    ok = df.where("x is not null and y is not null")
    null = models._shuffled_pairs(ok, [], "g", ["x"], "y", ["i"], REPS, 42)
    got = models.pooled_scores(models.logo_lines(null.drop("model"), "g", ["rep"]), ["rep"])
    return {r["rep"]: r["r2"] for r in got.collect()}


def in_tasks(df):
    ok = df.where("x is not null and y is not null")
    return {r["rep"]: r["r2"] for r in resample.shuffled_lines(ok, "g", "x", "y", ["i"], REPS, 42).collect()}


@pytest.mark.parametrize("scattered", [False, True])
def test_scores_of_slices_tiles_and_cut_groups(spark, monkeypatch, scattered):
    df = rows_of(spark, 900, 40, scattered).cache()
    want = by_rows(df)
    assert len(want) == REPS
    near = in_tasks(df)
    monkeypatch.setattr(resample, "SLICE_ROWS", 64)
    monkeypatch.setattr(resample, "TILE_SLICES", 3)
    far = in_tasks(df)
    monkeypatch.setattr(resample, "HELD_LINES", 256)
    parts = in_tasks(df)
    for got in (near, far, parts):
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_no_row_per_group_and_replicate(spark, monkeypatch):
    """300 groups and 40 replicates were 12,000 rows; what leaves the tasks is a row per task and replicate and the cut groups."""
    made, kept = [], resample.stored
    monkeypatch.setattr(resample, "SLICE_ROWS", 256)
    monkeypatch.setattr(resample, "stored", lambda df, name="stage": made.append((name, kept(df, name))) or made[-1][1])
    resample.shuffled_lines(rows_of(spark, 1500, 300).where("x is not null and y is not null"), "g", "x", "y", ["i"], REPS, 42)
    lines = dict(made)["lines"]
    assert lines.where(F.size("sums") == 2).count() <= 2 * 6 * REPS and lines.count() < 12000 / 3


def test_odd_groups(spark):
    same = rows_of(spark, 60, 6, constant=True)
    assert all(v == pytest.approx(by_rows(same)[k], abs=1e-6) for k, v in in_tasks(same).items())
    assert in_tasks(rows_of(spark, 30, 1)) == {} and in_tasks(rows_of(spark, 30, 4).where("i < 0")) == {}
    flat = rows_of(spark, 30, 4).withColumn("y", F.when(F.col("y").isNotNull(), 2.0))
    assert set(in_tasks(flat).values()) == {None}


def test_long_walk_is_the_short_one(monkeypatch):
    for n in (5000, 9001, 70000):
        keys = shuffles.round_keys(7, 99, np.arange(1, 6))
        at = np.arange(n)
        for back in (False, True):
            long = shuffles.permuted_positions(keys, at, n, back)
            assert (np.sort(long[3]) == at).all()
            monkeypatch.setattr(shuffles, "LONG", n + 1)
            assert (shuffles.permuted_positions(keys, at, n, back) == long).all()
            assert (shuffles.permuted_positions(keys, at, n, back, shuffles.turn_tables(keys, n, back)) == long).all()
            monkeypatch.undo()
