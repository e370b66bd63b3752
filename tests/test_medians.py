"""Training medians against numpy, and how many rows they put in order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dosewise.operators import models


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    n = 4000
    a = rng.normal(size=n) + np.arange(n) % 4
    tied = np.round(rng.exponential(size=n), 1)
    few = np.where(np.arange(n) % 9 == 0, rng.normal(size=n), np.nan)
    return pd.DataFrame({"fold": np.arange(n) % 4, "a": a, "tied": tied, "few": few, "none": np.nan})


def as_frame(spark, rows):
    df = spark.createDataFrame(rows).repartition(5)
    return df.select("fold", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("a", "tied", "few", "none")])


def test_medians_equal_numpy(spark, rows):
    got = {(r["held_out"], r["feature"]): r["median"] for r in models.training_medians(as_frame(spark, rows), "fold", ["a", "tied", "few", "none"], 4).collect()}
    want = {(k, c): np.nanmedian(rows[c][rows["fold"] != k]) for k in (-1, 0, 1, 2, 3) for c in ("a", "tied", "few")}
    assert got == want


def test_a_row_without_a_fold_counts_for_all_rows_only(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 5.0), (None, 100.0), (7, 6.0)], "fold int, x double")
    got = {r["held_out"]: r["median"] for r in models.training_medians(df, "fold", ["x"], 2).collect()}
    assert got == {-1: 5.0, 0: 5.5, 1: 2.0}


def test_few_values_are_put_in_order(spark, rows, monkeypatch):
    sorted_rows = []
    scan = models.ordered_scan
    monkeypatch.setattr(models, "ordered_scan", lambda df, *a: sorted_rows.append(df.count()) or scan(df, *a))
    models.training_medians(as_frame(spark, rows), "fold", ["a"], 4).collect()
    assert sum(sorted_rows) < len(rows) / 4  # each value was copied to 4 of 5 training sets before


def test_the_search_is_run_once(spark, rows):
    df = as_frame(spark, rows.head(200)).select("fold", F.array("a", "tied").alias("x"), F.col("a").alias("y"))
    fits = models.elasticnet_nested(df, "x", "y", alphas=(0.1,), l1_ratios=(0.5,))
    assert "InPandas" not in fits._jdf.queryExecution().optimizedPlan().toString()
