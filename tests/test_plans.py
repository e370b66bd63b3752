"""Sliced plans against one-window plans, properties over random groups, and SQL agreement."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dosewise.functions import draws, special
from dosewise.operators import models, resample, stats
from dosewise.plans import shapes
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def sample(spark, n=120, seed=1):
    """Two groups, one with most of the rows, with ties and missing values."""
    rng = random.Random(seed)
    data = [("big" if i % 6 else "small", i, float(rng.randint(0, 30)), None if i % 11 == 0 else rng.random() + (i % 3)) for i in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "g string, i int, x double, y double")


KINDS = {"rn": ("row_number", "i"), "to": ("sum_to", "i"), "before": ("sum_before", "i"), "mx": ("max_before", "y"), "last": ("last_to", "y"), "first": ("first_after", "y"), "lg": ("lag", "y"), "ld": ("lead", "y")}


def rows(df):
    return sorted(map(repr, shapes.round6(df).collect()))


def one_window(df, keys, order):
    """The running values of KINDS by plain windows."""
    fwd = Window.partitionBy(*keys).orderBy(*order)
    back = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    upto, before = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    return df.withColumns({
        "rn": F.row_number().over(fwd).cast("long"), "to": F.coalesce(F.sum("i").over(fwd.rowsBetween(*upto)), F.lit(0)),
        "before": F.coalesce(F.sum("i").over(fwd.rowsBetween(*before)), F.lit(0)), "mx": F.max("y").over(fwd.rowsBetween(*before)),
        "last": F.last("y", True).over(fwd.rowsBetween(*upto)), "first": F.last("y", True).over(back.rowsBetween(*upto)),
        "lg": F.lag("y").over(fwd), "ld": F.lead("y").over(fwd),
    })


@pytest.mark.parametrize("keys,order", [(["g"], ["x", "i"]), ([], ["x", "i"]), (["g"], ["name"]), ([], ["g", "name"]), (["x"], ["i"])])
def test_ordered_scan_equals_one_window(spark, keys, order):
    """Number and text orders, composite orders, no keys, missing keys and values; slices far smaller than the groups."""
    df = sample(spark).withColumns({"name": F.concat(F.lit("s"), F.lpad("i", 4, "0")), "g": F.when(F.col("i") % 17 > 0, F.col("g"))}).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows(shapes.ordered_scan(df, keys, order, KINDS)) == rows(one_window(df, keys, order))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_tied_value_is_cut(spark):
    """A thousand rows with one order value: every position once, in several slices."""
    df = spark.range(1000).select(F.lit("hot").alias("g"), F.lit(1.0).alias("x"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(r["idx"] for r in shapes.with_index(df, ["g"], ["x"]).collect()) == list(range(1000))
        assert shapes._sliced(df, ["g"], [F.col("x")]).select("__slice").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rank_quantile_totals(spark):
    df = sample(spark)
    data = df.toPandas()
    ranks = {r["i"]: r["rk"] for r in shapes.with_midrank(df, ["g"], {"x": "rk"}).collect()}
    assert ranks == dict(zip(data["i"], data.groupby("g")["x"].rank()))
    q = {r["g"]: r for r in shapes.quantiles(df, ["g"], "y", {"lo": 0.02, "mid": 0.5, "hi": 0.98}).collect()}
    for g, part in data.groupby("g"):
        assert np.allclose([q[g]["lo"], q[g]["mid"], q[g]["hi"]], part["y"].quantile([0.02, 0.5, 0.98]))
    top = {r["i"]: r["m"] for r in shapes.with_totals(df, ["g"], {"m": F.max("y")}).collect()}
    assert top == dict(zip(data["i"], data.groupby("g")["y"].transform("max")))


def test_partitioning_does_not_matter(spark):
    df = sample(spark)
    got = [sorted(map(repr, shapes.round6(stats.spearman(df.repartition(n, F.rand(n)), ["g"], "x", "y")).collect())) for n in (1, 4, 16)]
    assert got[0] == got[1] == got[2]


def test_rank_properties(spark):
    """Many random groups in one frame: monotone maps, mirrored scores, wins plus half the ties."""
    rng = random.Random(3)
    df = spark.createDataFrame([(g, float(rng.randint(0, 9)), rng.random(), int(rng.random() < 0.5)) for g in range(25) for _ in range(20)], "g int, x double, y double, c int")
    a = {r["g"]: r["r"] for r in stats.spearman(df, ["g"], "x", "y").collect()}
    b = {r["g"]: r["r"] for r in stats.spearman(df.withColumns({"x": F.exp("x"), "y": F.col("y") * 3 - 7}), ["g"], "x", "y").collect()}
    assert all(abs(a[g] - b[g]) < 1e-12 for g in a)
    u = {r["g"]: r["auc"] for r in stats.auc(df, ["g"], "c", "x").collect()}
    v = {r["g"]: r["auc"] for r in stats.auc(df.withColumn("x", -F.col("x")), ["g"], "c", "x").collect()}
    assert all(u[g] is None or abs(u[g] + v[g] - 1) < 1e-12 for g in u)
    w = {r["g"]: (r["n_wins"], r["n_pairs"]) for r in stats.forced_choice(df.withColumn("d", F.col("c") * 2.0 + 45.5), ["g"], "d", "x").collect()}
    data = {}
    for r in df.collect():
        data.setdefault(r["g"], []).append((r["c"], r["x"]))
    for g, rows in data.items():
        lows, highs = [x for c, x in rows if c == 0], [x for c, x in rows if c == 1]
        ties = sum(x == y for x in lows for y in highs)
        assert w[g] == (sum(y > x for x in lows for y in highs), len(lows) * len(highs))
        assert abs(u[g] - (w[g][0] + ties / 2) / w[g][1]) < 1e-12


def test_q_values(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(round(rng.random() ** 2, 3),) for _ in range(80)], "p double")
    got = sorted((r["p"], r["q"]) for r in stats.bh_fdr(df).collect())
    assert all(q >= p - 1e-12 for p, q in got) and all(a[1] <= b[1] + 1e-12 for a, b in zip(got, got[1:]))


def test_leave_one_out_equals_refit(spark):
    df = sample(spark).where("y is not null").withColumn("h", F.col("i") % 4)
    pred = models.baseline_linear_logo(df, "h", "x", "y").toPandas()
    for h, sub in pred.groupby("h"):
        rest = pred[pred.h != h]
        b, a = np.polyfit(rest.x, rest.y, 1)
        assert np.allclose(sub.y_pred, a + b * sub.x)


def test_elastic_net_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y = x @ [2.0, 0.0, -1.0] + 0.1 * rng.normal(size=60)
    df = spark.createDataFrame([(int(i % 3), x[i].tolist(), float(y[i])) for i in range(60)], "fold int, x array<double>, y double")
    fits = {r["fold"]: r for r in models.elasticnet_nested(df, "x", "y", n_folds=3, alphas=(0.0001,), l1_ratios=(0.5,)).collect()}
    for f, r in fits.items():
        keep = np.arange(60) % 3 != f
        ols = np.linalg.lstsq(np.c_[x[keep], np.ones(keep.sum())], y[keep], rcond=None)[0]
        assert np.allclose([*r["coef"], r["intercept"]], ols, atol=5e-3)


def test_missing_features_take_training_medians(spark):
    rows = [(i % 2, None if i in (1, 4) else float(i * i % 7), float(3 * (i * i % 7) + i % 3)) for i in range(20)]
    df = spark.createDataFrame(rows, "fold int, a double, y double").withColumn("x", F.array("a"))
    med = models.training_medians(df, "fold", ["a"], 2)
    exp = {f: float(np.median([a for g, a, _ in rows if g != f and a is not None])) for f in (0, 1)}
    assert {r["held_out"]: r["median"] for r in med.collect() if r["held_out"] >= 0} == exp
    fits = models.elasticnet_nested(df, "x", "y", n_folds=2, alphas=(1e-6,), l1_ratios=(0.5,), medians=med.withColumn("feature", F.lit(0))).collect()
    for r in fits:
        a = np.array([exp[r["fold"]] if v is None else v for g, v, _ in rows if g != r["fold"]])
        y = np.array([v for g, _, v in rows if g != r["fold"]])
        assert np.allclose([r["coef"][0], r["intercept"]], np.polyfit(a, y, 1), atol=1e-3)


def test_permutation_p_in_range(spark):
    out = resample.permutation_correlation(sample(spark), ["g"], "x", "y", ["i"], 19).collect()
    assert len(out) == 2 and all(1 / 20 <= r["p_perm"] <= 1 for r in out)


def test_within_group_shuffle_moves_values(spark):
    df = sample(spark).where("y is not null")
    p = resample.permuted(df, ["g"], "y", ["i"], 3, 42)
    sums = p.groupBy("g", "rep").agg(F.round(F.sum("y"), 6).alias("s")).groupBy("g").agg(F.count_distinct("s").alias("d"), F.count("s").alias("n")).collect()
    assert all(r["d"] == 1 and r["n"] == 3 for r in sums)
    base = resample.with_index(df.select("g", "i", "y"), ["g"], ["i"], "__k")
    moved = p.join(base.withColumnRenamed("y", "y0"), ["g", "__k"]).where("y <> y0").count()
    assert moved > 100


def test_mixed_model_recovers_slope(spark):
    rng = np.random.default_rng(2)
    u = rng.normal(size=30) * 2
    data = [(s, float(t), float(0.5 * t + u[s] + 0.3 * rng.normal())) for s in range(30) for t in range(8)]
    r = resample.mixed_random_intercept(spark.createDataFrame(data, "s int, x double, y double"), "s", "x", "y").first()
    assert abs(r["beta"] - 0.5) < 0.03 and r["converged"] and 1 < r["var_subject"] < 9 and abs(r["var_residual"] - 0.09) < 0.03


def test_glm_against_numpy(spark):
    from dosewise.operators.linear import glm_fit

    rng = np.random.default_rng(4)
    a, y = rng.normal(size=20), rng.normal(size=(20, 2))
    design = spark.createDataFrame([(1, i, float(a[i]), 1.0) for i in range(20)], "run int, volume int, a double, one double")
    data = spark.createDataFrame([(1, i, c, float(y[i, c])) for i in range(20) for c in range(2)], "run int, volume int, cell int, value double")
    for r in glm_fit(design, data, ["run"], ["cell"], ["a", "one"]).collect():
        b = np.linalg.lstsq(np.c_[a, np.ones(20)], y[:, r["cell"]], rcond=None)[0]
        assert np.allclose([r["beta_a"], r["beta_one"]], b) and r["dof"] == 18


def test_registry_is_complete():
    names = set(entry.queries())
    assert len(names) >= 194 and set(entry.oracle_sql()) <= names


@pytest.mark.parametrize("name", ["drop_rejected_trials", "roi_assignment", "dose_response", "running_correlation", "local_variance", "signature_score", "learning_curve", "scan_events", "design_matrix", "dose_response_report"])
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())


def test_folds_come_from_the_data(spark):
    df = spark.createDataFrame([(i % 4, [float(i * i % 7), float(i % 3)], float(i % 5)) for i in range(40)], "fold int, x array<double>, y double")
    fits = models.elasticnet_nested(df, "x", "y", alphas=(0.01,), l1_ratios=(0.5,))
    assert models.predict_linear(df, fits, "x").count() == 40 and fits.where("converged").count() == 4
    for bad in (lambda: models.elasticnet_nested(df, "x", "y", n_folds=3), lambda: models.elasticnet_nested(df.withColumn("fold", F.when(F.col("fold") > 0, F.col("fold"))), "x", "y")):
        with pytest.raises(ValueError):
            bad()


def test_inner_folds_are_blocks_of_runs(spark):
    assert models.balanced_blocks({1: 5.0, 2: 9.0, 3: 4.0, 4: 1.0}, 2) == [[2, 4], [1, 3]]
    rng = np.random.default_rng(2)
    rows = [(int(i % 3), int(i % 7), rng.normal(size=2).tolist(), float(rng.normal())) for i in range(90)]
    df = spark.createDataFrame(rows, "fold int, run int, x array<double>, y double")
    got = {r["fold"]: r for r in models.elasticnet_nested(df, "x", "y", alphas=(0.1,), l1_ratios=(0.0,), inner="run").collect()}
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    fold, run = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for f in range(3):
        keep = fold != f
        sizes = {int(r): float((keep & (run == r)).sum()) for r in np.unique(run)}
        marks = []
        for block in models.balanced_blocks(sizes, 5):
            test = keep & np.isin(run, block)
            train = keep & ~test
            m, s = x[train].mean(0), x[train].std(0)
            z = (x[train] - m) / s
            w = np.linalg.solve(z.T @ z / train.sum() + 0.1 * np.eye(2), z.T @ (y[train] - y[train].mean()) / train.sum())
            pred = y[train].mean() + ((x[test] - m) / s) @ w
            marks.append(1 - ((y[test] - pred) ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum())
        assert np.isclose(got[f]["best_r2"], np.mean(marks))
    alone = models.elasticnet_nested(df.where("fold < 2"), "x", "y", alphas=(0.1, 1.0), l1_ratios=(0.5,)).first()
    assert alone["best_r2"] is None and alone["alpha"] == 0.1


def test_draws_use_every_bit_of_a_position(spark):
    far = 2**31 - 1
    h = draws.seeded_hash(1, F.lit(1), F.col("id"))
    got = [r["h"] for r in spark.createDataFrame([(i,) for i in (0, far, 2 * far, 2**40, 2**40 + far)], "id long").select(h.alias("h")).collect()]
    assert len(set(got)) == 5 and max(got) > 2**55 and all(0 <= x < 2**62 for x in got)
    sql = draws.sql_hash(1, "1", "id")
    assert [duckdb.sql(f"SELECT {sql} FROM (SELECT {i}::BIGINT AS id)").fetchall()[0][0] for i in (0, far, 2 * far, 2**40, 2**40 + far)] == got


def test_far_tails_keep_their_digits(spark):
    ts, dfs = (0.01, 1.0, 9.0, 14.0), (1, 2, 4, 999, 1000, 1001, 1002)
    p = {(r["t"], r["n"]): r["p"] for r in spark.createDataFrame([(t, n) for t in ts for n in dfs], "t double, n int").withColumn("p", special.t_two_sided(F.col("t"), F.col("n"))).collect()}
    for t in ts:
        assert np.isclose(p[t, 1], 2 / math.pi * math.atan(1 / t), rtol=1e-12) and np.isclose(p[t, 2], 2 / (2 + t * t + t * math.sqrt(2 + t * t)), rtol=1e-12)
        steps = [math.log(p[t, b] / p[t, a]) for a, b in ((999, 1000), (1000, 1001), (1001, 1002))]
        assert max(steps) - min(steps) < 1e-2 * max(map(abs, steps))
    assert 1.1e-18 < p[9.0, 1000] < 1.12e-18


def test_model_queries_read_the_whole_vectors(spark):
    from dosewise.catalog import k_models

    d = "/root/testdata/sf0.001"
    df = k_models.epochs(spark, d)
    sizes = {r[0] for r in df.select(F.size("x")).distinct().collect()}
    assert sizes == {64} and len(k_models.names(df)) == 64
    assert k_models.medians(df).select("feature").distinct().count() == 64
    coef = entry.queries()["final_refit"](spark, d).first()["coef"]
    assert len(coef) == 64 and all(c is not None for c in coef)
