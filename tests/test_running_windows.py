"""Running rank correlation by blocks of window starts, against pandas windows."""

import numpy as np
import pandas as pd
import pytest

from dosewise.operators.sequence import running_correlation


def test_windows_over_several_blocks(spark):
    rng = np.random.default_rng(1)
    frames = [pd.DataFrame({"s": s, "i": np.arange(n), "x": rng.integers(0, 4, n).astype(float), "y": rng.normal(size=n).round(1)}) for s, n in (("a", 150), ("b", 40), ("few", 39))]
    rows = pd.concat(frames)
    rows.loc[rows.i % 7 == 3, "x"] = np.nan
    df = spark.createDataFrame([(s, int(i), None if np.isnan(x) else float(x), float(y)) for s, i, x, y in rows.itertuples(index=False)] + [("a", None, 1.0, 1.0)], "s string, i long, x double, y double")
    plan = running_correlation(df, "s", "i", "x", "y")
    got = {(r["s"], r["start"]): (r["n"], r["rho"], r["midpoint"]) for r in plan.collect()}
    want = {}
    for s, own in rows[rows.s != "few"].groupby("s"):
        for start in range(len(own) - 19):
            w = own[(own.i >= start) & (own.i < start + 20)].dropna()
            want[s, start] = len(w), np.corrcoef(w.x.rank(), w.y.rank())[0, 1], start + 11
    assert got.keys() == want.keys()
    for k, (n, rho, mid) in want.items():
        assert got[k][0] == n and got[k][2] == mid and got[k][1] == pytest.approx(rho, abs=1e-9)
    assert "Window" not in plan._jdf.queryExecution().optimizedPlan().toString()
