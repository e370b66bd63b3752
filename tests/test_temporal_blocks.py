"""AUC of held-out rows from packed blocks and score ranges."""

import numpy as np
from pyspark.sql import functions as F

from dosewise.operators import models


def test_small_blocks_and_ranges_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(models, "PACK_ROWS", 7)
    monkeypatch.setattr(models, "BUCKET_SCORES", 10)
    rng = np.random.default_rng(3)
    rows = [(f, t, [float(v) for v in rng.integers(0, 4, 2)], int(rng.integers(0, 2))) for f in (0, 1) for t in (0, 1) for _ in range(60)]
    data = spark.createDataFrame(rows, "part int, t int, x array<double>, y int").withColumn("__h", F.xxhash64("x", "y"))
    packed = data.repartition(3).sortWithinPartitions("part", "t", "__h").mapInPandas(models._packed, "part int, t int, h long, x array<double>, y array<int>")
    size = packed.groupBy("part", "t").agg(F.sum(F.size("y")).alias("n"))
    w = spark.createDataFrame([(0, 0, [1.0, 0.5, 0.0]), (0, 1, [-1.0, 2.0, 0.0]), (1, 0, [0.3, 0.3, 0.0]), (1, 1, [0.0, 1.0, 0.0])], "fold int, t int, w array<double>")
    got = {(r["fold"], r["t_train"], r["t_test"]): r["auc"] for r in models._held_out_auc(packed, size, w, "int").collect()}
    want = {}
    for fold, t_train, c in [(r["fold"], r["t"], r["w"]) for r in w.collect()]:
        for t in (0, 1):
            s = [(x[0] * c[0] + x[1] * c[1], y) for f, u, x, y in rows if f == fold and u == t]
            pairs = [(p > q) + 0.5 * (p == q) for p, a in s if a == 1 for q, b in s if b == 0]
            want[fold, t_train, t] = np.mean(pairs)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_no_row_per_row_and_model(spark, monkeypatch):
    """The scores of all training times were rows of a sorted table before; now nothing is sorted by score in the plan."""
    df = spark.range(400).select((F.col("id") % 2).cast("int").alias("fold"), (F.col("id") % 3).alias("t"), F.array(F.rand(1), F.rand(2)).alias("x"), (F.rand(3) > 0.5).cast("int").alias("y"))
    monkeypatch.setattr(models, "auc", lambda *a: 1 / 0, raising=False)
    assert models.temporal_generalization_auc(df, "fold", "t", "x", "y").count() == 9
