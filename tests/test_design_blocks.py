"""Design matrices by blocks of volumes, against sums over single events."""

import math

from pyspark.sql import functions as F

from dosewise.operators.linear import design_matrix, trial_design

TR, N = 0.9, 400


def _step(x):
    x = max(0.0, min(x, 32.0))
    cdf = lambda shape: 1 - math.exp(-x) * sum(x ** k / math.factorial(k) for k in range(shape))
    return (cdf(6) - cdf(16) / 6) / (5 / 6)


def _events(spark):
    rows = [(None if i % 11 == 0 else i % 3, f"t{i % 2}", (i * 37 % 499) * 0.71 - 5, float(i % 4) if i % 5 else 70.0) for i in range(300)]
    rows += [(0, "t0", None, 1.0), (0, "t1", 3.0, None), (1, None, 20.0, 2.0)]
    return rows, spark.createDataFrame(rows, "run int, trial_type string, onset double, duration double")


def test_blocks_go_on_over_batches(spark):
    rows, df = _events(spark)
    want = {}
    for run, name, onset, duration in rows:
        if onset is None or duration is None:
            continue
        for v in range(max(math.ceil(onset / TR), 0), min(math.floor((onset + duration + 32) / TR), N - 1) + 1):
            lag = v * TR - onset
            want[run, v, name] = want.get((run, v, name), 0.0) + _step(lag) - _step(lag - duration)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {(r["run"], r["volume"], r["trial_type"]): r["value"] for r in design_matrix(df, ["run"], TR, N).collect()}
            assert got.keys() == want.keys()
            assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_no_row_per_event_and_volume_is_aggregated(spark):
    df = _events(spark)[1].withColumns({"subject": F.lit(1), "trial_idx": F.col("onset")})
    plan = trial_design(df, ["subject"], "subject", "run", F.col("trial_type") == "t0", ["trial_idx"], TR, N)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" in text and "volume" in text
    assert not any("Aggregate" in line and "volume" in line for line in text.splitlines())
