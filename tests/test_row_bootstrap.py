"""The row bootstrap in slices against a run that copies the drawn rows."""

import numpy as np
import pandas as pd
import pytest

from dosewise.functions import shuffles
from dosewise.operators import resample as R

REPS = 40


def drawn(seed, rep, n, slice_rows):
    """How often each row of a group, in the order of x, is drawn."""
    cut = [slice_rows] * (n // slice_rows) + ([n % slice_rows] if n % slice_rows else [])
    totals = shuffles.slice_totals(seed, np.array([rep]), cut)
    return np.concatenate([shuffles.slice_counts(seed, np.array([rep]), k, totals[:, k], rows)[0] for k, rows in enumerate(cut)]).astype(int)


def plain(rows, slice_rows, statistic):
    out = {}
    for g, own in rows.groupby("g", dropna=False):
        own = own.dropna(subset=["x", "y"]).sort_values(["x", "at"]).reset_index(drop=True)
        for rep in range(1, REPS + 1):
            m = drawn(42, rep, len(own), slice_rows)
            assert m.sum() == len(own)
            copies = own.loc[np.repeat(np.arange(len(own)), m)]
            if statistic == "auc":
                pos = int((copies.y == 1).sum())
                neg = len(copies) - pos
                stat = (copies.x.rank()[copies.y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg) if pos and neg else None
            else:
                a, b = copies.x.rank(), copies.y.rank()
                stat = float(np.corrcoef(a, b)[0, 1]) if a.std() > 0 and b.std() > 0 else None
            out[g, rep] = stat
    return out


@pytest.mark.parametrize("statistic", ["auc", "spearman"])
@pytest.mark.parametrize("slice_rows,entries", [(16, 5), (32768, 4096)])
def test_slices_agree_with_copied_rows(spark, monkeypatch, statistic, slice_rows, entries):
    """Long and short groups, heavy ties over several slices, distinct values, a constant column, a group of one class."""
    monkeypatch.setattr(R, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(R, "Y_ENTRIES", entries)
    rng = np.random.default_rng(3)
    frames = []
    for g, n, x in (("tied", 90, lambda n: rng.integers(0, 3, n)), ("free", 70, lambda n: rng.normal(size=n)), ("short", 9, lambda n: rng.integers(0, 4, n)), ("flat", 40, lambda n: np.ones(n)), ("single", 1, lambda n: np.ones(n))):
        y = rng.integers(0, 2, n) if statistic == "auc" else np.round(rng.normal(size=n), 1) if g != "tied" else rng.integers(0, 5, n)
        frames.append(pd.DataFrame({"g": g, "at": np.arange(n), "x": x(n).astype(float), "y": y.astype(float)}))
    rows = pd.concat(frames)
    df = spark.createDataFrame(rows).unionByName(spark.createDataFrame([("tied", 1000, None, 1.0)], "g string, at long, x double, y double"))
    got = {(r["g"], r["rep"]): r["stat"] for r in R.resampled_statistic(df, ["g"], "x", "y", ["at"], REPS, 42, statistic).collect()}
    want = plain(rows, slice_rows, statistic)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, abs=1e-9)), k


def test_without_keys_and_empty(spark):
    rows = [(i, float(i % 7), float(i % 2)) for i in range(50)]
    df = spark.createDataFrame(rows, "at long, x double, y double")
    assert R.resampled_statistic(df, [], "x", "y", ["at"], 10).count() == 10
    assert R.resampled_statistic(df.where("false"), [], "x", "y", ["at"], 10).count() == 0
    assert R.bootstrap_percentile(df.withColumn("g", df.x * 0), ["g"], "x", "y", ["at"], 50, statistic="spearman").first()["n_boot"] == 50


@pytest.mark.parametrize("statistic", ["auc", "spearman"])
@pytest.mark.parametrize("slice_rows", [16, 32768])
def test_intervals_of_short_groups_leave_the_task_finished(spark, monkeypatch, statistic, slice_rows):
    """Short groups send no row per replicate; long ones beside them, and a group without a value, agree with the replicates."""
    monkeypatch.setattr(R, "SLICE_ROWS", slice_rows)
    rng = np.random.default_rng(5)
    frames = [pd.DataFrame({"g": g, "at": np.arange(n), "x": rng.integers(0, 5, n).astype(float), "y": rng.integers(0, top, n).astype(float)}) for g, n, top in (("a", 9, 2), ("b", 9, 2), ("c", 40, 2), ("none", 12, 1))]
    df = spark.createDataFrame(pd.concat(frames)).withColumn("g", R.F.when(R.F.col("g") != "b", R.F.col("g")))
    want = {r["g"]: r for r in R.percentile_interval(R.resampled_statistic(df, ["g"], "x", "y", ["at"], REPS, 42, statistic), ["g"], "stat").collect()}
    plan = R.bootstrap_percentile(df, ["g"], "x", "y", ["at"], REPS, 42, statistic)
    got = {r["g"]: r for r in plan.collect()}
    assert got.keys() == want.keys() == {"a", None, "c", "none"} and got["none"]["ci_low"] is None
    for k, r in want.items():
        assert got[k]["n_boot"] == r["n_boot"]
        for end in ("ci_low", "ci_high"):
            assert got[k][end] == (r[end] if r[end] is None else pytest.approx(r[end], abs=1e-12))
    if slice_rows > 40:
        assert "rep" not in plan._jdf.queryExecution().optimizedPlan().toString().replace("Repartition", "")
