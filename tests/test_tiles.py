"""Connectivity by tiles, against numpy on whole series."""

import numpy as np
import pytest

from dosewise.operators import linear

SCHEMA = "trial int, channel string, t int, x double"


def series(channels, samples, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=samples)
    return {(trial, f"c{k:02d}"): 1000.0 + base * rng.normal() + rng.normal(size=samples) for trial in range(3) for k in range(channels)}


def frame(spark, data):
    rows = [(trial, c, int(t), None if np.isnan(v) else float(v)) for (trial, c), x in data.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("block, chunk, bucket", [(64, 4096, 65536), (3, 7, 300), (1, 5, 1)])
def test_tiles_give_the_whole_matrix(spark, monkeypatch, block, chunk, bucket):
    monkeypatch.setattr(linear, "BLOCK_CHANNELS", block)
    monkeypatch.setattr(linear, "CHUNK_SAMPLES", chunk)
    monkeypatch.setattr(linear, "BUCKET_SAMPLES", bucket)
    data = series(10, 40, 1)
    df = frame(spark, data)
    got = {(r.trial, r.node_a, r.node_b): r.value for r in linear.envelope_connectivity(df, ["trial"]).collect()}
    assert len(got) == 3 * 45 and all(a > b for _, a, b in got)
    for (trial, a, b), r in got.items():
        assert r == pytest.approx(np.corrcoef(data[trial, a], data[trial, b])[0, 1], abs=1e-12)
    cov = {(r.trial, r.a, r.b): r["cov"] for r in linear.trial_covariance(df, ["trial"], shrink=False).collect()}
    assert len(cov) == 3 * 55
    for (trial, a, b), v in cov.items():
        assert v == pytest.approx(np.cov(data[trial, a], data[trial, b], bias=True)[0, 1], abs=1e-10)


def test_incomplete_pairs_stay_with_a_missing_value(spark, monkeypatch):
    monkeypatch.setattr(linear, "BLOCK_CHANNELS", 2)
    monkeypatch.setattr(linear, "CHUNK_SAMPLES", 2)
    rows = [(0, c, t, float(t * k + t % 3)) for k, c in enumerate("abcd", 1) for t in range(12)]
    rows += [(0, "gap", t, None if t == 5 else float(t)) for t in range(12)] + [(0, "short", t, float(t)) for t in range(11)]
    rows += [(0, "late", t, float(t)) for t in range(100, 112)] + [(0, "flat", t, 2.0) for t in range(12)] + [(0, "one", 500, 1.0), (None, "a", 0, 1.0), (None, "b", 0, 2.0)]
    got = {(r.trial, r.node_a, r.node_b): r.value for r in linear.envelope_connectivity(spark.createDataFrame(rows, SCHEMA), ["trial"]).collect()}
    assert len(got) == 9 * 8 // 2 + 1
    assert {k for k, v in got.items() if v is not None} == {(0, x, y) for x in "abcd" for y in "abcd" if x > y}


def test_repeated_times_and_an_empty_table(spark):
    rows = [(0, c, t, v) for c, xs in {"a": [1, 2, 5, 4], "b": [3, 3, 9, 1]}.items() for t, v in zip([0, 0, 1, 2], map(float, xs))]
    one = linear.envelope_connectivity(spark.createDataFrame(rows, SCHEMA), ["trial"]).collect()
    assert one[0].value == pytest.approx(np.corrcoef([1, 2, 5, 4], [3, 3, 9, 1])[0, 1], abs=1e-12)
    assert linear.envelope_connectivity(spark.createDataFrame([], SCHEMA), ["trial"]).count() == 0
