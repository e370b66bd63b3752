"""Keyed permutations, sums against shuffles, and the nested permutation test, against brute-force versions."""

import hashlib
import math
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dosewise.functions import shuffles, solvers
from dosewise.operators import models, resample


def group_code(*keys):
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:12], 16)


def places(n, reps, *keys, seed=42):
    return shuffles.permuted_positions(shuffles.round_keys(seed, group_code(*keys), np.arange(1, reps + 1)), np.arange(n), n)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 10, 101, 4097])
def test_every_replicate_is_a_permutation(n):
    assert (np.sort(places(n, 30, "a"), axis=1) == np.arange(n)).all()


def test_all_orders_are_about_as_likely():
    for n in (3, 4, 5):
        seen = Counter(map(tuple, places(n, 24000, "g")))
        expected = 24000 / math.factorial(n)
        assert len(seen) == math.factorial(n) and sum((v - expected) ** 2 / expected for v in seen.values()) < 2 * math.factorial(n) + 10
    p = places(30, 20000, "g")
    pairs = np.bincount(p[:, 0] * 30 + p[:, 1], minlength=900).reshape(30, 30)
    expected = 20000 / (30 * 29)
    assert ((pairs - expected) ** 2 / expected)[~np.eye(30, dtype=bool)].sum() < 1.2 * 30 * 29
    assert not (places(50, 20, "g") == places(50, 20, "h")).all(axis=1).any()  # groups of one size are shuffled apart


def test_sql_gives_the_same_places():
    con = duckdb.connect()
    con.execute("CREATE TABLE src AS SELECT i % 3 AS g, i // 3 AS pos FROM range(100) t(i)")
    for keys in (("g",), ()):
        source = "src" if keys else "(SELECT row_number() OVER () - 1 AS pos FROM src)"
        got = con.execute(f"WITH RECURSIVE {shuffles.sql_shuffle('sh', source, 30, 42, keys)} SELECT {''.join(k + ', ' for k in keys)}pos, rep, moved FROM sh").fetchall()
        want = {k: places(34 if k == (0,) else 33 if k else 100, 30, *k) for k in ([(0,), (1,), (2,)] if keys else [()])}
        assert len(got) == 3000 and all(want[row[:-3]][row[-2] - 1, row[-3]] == row[-1] for row in got)


def table(spark, n=97):
    rng = np.random.default_rng(3)
    rows = [("big" if i % 4 else None, i, int(i % 3) if i % 5 else None, float(rng.normal()), float(rng.normal()), float(rng.normal())) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, i int, part int, a double, b double, y double").repartition(5)


def brute_sums(rows, n_perm, by_group, acc, centre):
    out = {}
    groups = {}
    for r in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(r[0] if by_group else "all", []).append(r)
    for g, held in groups.items():
        to = places(len(held), n_perm, *([g] if by_group and g is not None else []))
        x, y = np.array([r[3:5] for r in held]), np.array([r[5] for r in held])
        if centre:
            x, y = x - x.mean(axis=0), y - y.mean()
        for rep in range(n_perm):
            moved = np.empty(len(held))
            moved[to[rep]] = y
            for k, r in enumerate(held):
                key = (g, r[2] if acc else None, rep + 1)
                one = np.array([moved[k], moved[k] ** 2, *(x[k] * moved[k])])
                out[key] = out.get(key, 0) + one
    return out


@pytest.mark.parametrize("slice_rows,block_reps", [(1000, 125), (7, 4), (25, 3)])
@pytest.mark.parametrize("by_group,acc,centre", [(True, False, True), (False, True, False), (True, True, False)])
def test_sums_against_shuffles(spark, monkeypatch, slice_rows, block_reps, by_group, acc, centre):
    """One slice per group and many: what lies in other slices travels and arrives; missing keys are groups of their own."""
    monkeypatch.setattr(resample, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(resample, "BLOCK_REPS", block_reps)
    monkeypatch.setattr(resample, "AT_ONCE", 50)
    rows, df = table(spark)
    keys = ["g"] if by_group else []
    got = resample.shuffled_sums(df, keys, ["a", "b"], "y", ["i"], 10, 42, centre=keys if centre else None, acc="part" if acc else None).collect()
    want = brute_sums(rows, 10, by_group, acc, centre)
    assert len(got) == len(want)
    for r in got:
        one = want[(r["g"] if by_group else "all", r["part"] if acc else None, r["rep"])]
        assert np.allclose([r["sy"], r["syy"], *r["sxy"]], one, atol=1e-9)


def test_shuffles_of_nothing(spark):
    _, df = table(spark)
    assert resample.shuffled_sums(df.where("i < 0"), ["g"], ["a"], "y", ["i"], 5, 1).collect() == []
    assert resample.permutation_test(df.where("i < 0"), ["g"], "a", "y", ["i"], 5).collect() == []


@pytest.mark.parametrize("l1", [0.0, 0.3, 1.0])
def test_many_targets_equal_single_fits(l1):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((60, 6)), rng.standard_normal((60, 9))
    x[:, 4] = 1.0  # no spread
    y[:, 0] += 3 * x[:, 1]
    alpha = np.linspace(0.001, 0.5, 9)
    rows = np.column_stack([x, np.ones(60)])
    sides = np.vstack([rows.T @ y, (y * y).sum(axis=0)])
    one = [np.column_stack([rows, y[:, k]]) for k in range(9)]
    b, a, settled = solvers.enet_many(one[0].T @ one[0], sides, alpha, np.full(9, l1))
    r2, sse = solvers.r2_many(one[0].T @ one[0], sides, b, a)
    for k in range(9):
        bk, ak, _, ok = solvers.enet(one[k].T @ one[k], alpha[k], l1)
        assert ok and settled[k] and np.allclose(b[:, k], bk, atol=1e-7) and np.isclose(a[k], ak, atol=1e-7)
        pred = x @ bk + ak
        assert np.isclose(sse[k], ((y[:, k] - pred) ** 2).sum(), atol=1e-6) and np.isclose(r2[k], solvers.line_scores(one[k].T @ one[k], bk, ak)[0], atol=1e-7)


def test_nested_permutation_equals_one_run_per_shuffle(spark):
    """Every shuffle of the target searched again from the rows, in numpy."""
    rng = np.random.default_rng(5)
    n, p, reps = 200, 4, 20
    x = rng.standard_normal((n, p))
    y = x @ [1.0, 0.5, 0, 0] + rng.standard_normal(n)
    fold, run = np.arange(n) % 4, np.arange(n) // 4 % 6
    x[::9, 2] = np.nan
    grid = [(a, q) for a in (0.01, 0.2) for q in (0.3, 0.9)]
    med = {f: np.nanmedian(x[fold != f], axis=0) for f in range(4)}

    def products(rows, target, f):
        filled = np.where(np.isnan(x[rows]), med[f], x[rows])
        m = np.column_stack([filled, np.ones(len(filled)), target[rows]])
        return m.T @ m

    def nested_r2(target):
        sse = 0.0
        for f in range(4):
            train = fold != f
            blocks = models.balanced_blocks({r: int((train & (run == r)).sum()) for r in range(6)}, 5)
            whole = products(train, target, f)
            tests = [products(train & np.isin(run, b), target, f) for b in blocks]
            marks = [np.mean([solvers.line_scores(t, *solvers.enet(whole - t, *g)[:2])[0] for t in tests]) for g in grid]
            b, a, *_ = solvers.enet(whole, *grid[int(np.argmax(marks))])
            sse += ((target[~train] - np.where(np.isnan(x[~train]), med[f], x[~train]) @ b - a) ** 2).sum()
        return 1 - sse / ((target - target.mean()) ** 2).sum()

    null = []
    for to in places(n, reps):
        shuffled = np.empty(n)
        shuffled[to] = y
        null.append(nested_r2(shuffled))
    rows = [(int(fold[i]), int(run[i]), i, [None if np.isnan(v) else float(v) for v in x[i]], float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "fold int, run int, trial int, x array<double>, y double").repartition(3)
    wide = df.select("fold", *[F.get("x", F.lit(i)).alias(str(i)) for i in range(p)])
    medians = models.training_medians(wide, "fold", [str(i) for i in range(p)], 4).withColumn("feature", F.col("feature").cast("int"))
    got = models.permutation_r2_nested(df, "x", "y", ["trial"], alphas=(0.01, 0.2), l1_ratios=(0.3, 0.9), medians=medians, inner="run", n_perm=reps, block=7).first()
    observed = nested_r2(y)
    assert got["r2_obs"] == pytest.approx(observed, abs=1e-6) and got["n_perm"] == reps and got["unsettled"] == 0
    assert got["p"] == (sum(v >= observed for v in null) + 1) / (reps + 1)
    for name, q in (("null_q05", 0.05), ("null_q50", 0.5), ("null_q95", 0.95)):
        assert got[name] == pytest.approx(np.quantile(null, q), abs=1e-6)
    assert got["null_mean"] == pytest.approx(np.mean(null), abs=1e-6)


@pytest.mark.parametrize("slice_rows", [1000, 6])
def test_resampled_subjects(spark, monkeypatch, slice_rows):
    """Every replicate draws as many subjects as there are, each about as often, one or many slices; groups share the draw."""
    monkeypatch.setattr(resample, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(resample, "BLOCK_REPS", 70)
    subjects = [None, *range(1, 21)]
    rows = [(s, g, 1, float(2 ** k)) for k, s in enumerate(subjects) for g in ("a", None)]
    sums = spark.createDataFrame(rows, "subject int, g string, n int, x double").repartition(3)
    got = resample.resampled_sums(sums, "subject", ["g"], 300, 9).collect()
    assert len(got) == 600 and all(r["n"] == 21 for r in got)
    by_rep = {}
    for r in got:
        by_rep.setdefault(r["rep"], set()).add(r["x"])
    assert all(len(v) == 1 for v in by_rep.values()) and len({min(v) for v in by_rep.values()}) == 300
    total = sum(min(v) for v in by_rep.values()) / 300
    assert abs(total / (2 ** 21 - 1) - 1) < 0.25
    if slice_rows == 1000:
        from dosewise.functions.draws import seeded_draw

        slots = spark.range(21).crossJoin(spark.range(1, 301).withColumnRenamed("id", "rep")).select("rep", seeded_draw(9, F.col("rep"), F.col("id"), 21).alias("k"))
        want = {r["rep"]: r["x"] for r in slots.groupBy("rep").agg(F.sum(F.pow(F.lit(2.0), "k")).alias("x")).collect()}
        assert {k: min(v) for k, v in by_rep.items()} == want


def test_resampled_subjects_hold_few_replicates(spark, monkeypatch):
    """A slice's counts are spread over its rows a few replicates at a time, with the same sums."""
    n, groups = 2000, 5
    part = shuffles.Slice(pa.array(np.random.default_rng(3).normal(size=n * groups * 2)), pa.array([str(k) for k in range(groups)] * n))
    many, reps = np.full(n, groups), np.arange(1, 126)
    drawn = lambda now: shuffles.draw_counts(5, now, 0, [n], n)
    want = part.sums(np.repeat(drawn(reps), many, axis=1)[:, part.order])
    tracemalloc.start()
    got = list(shuffles.drawn_sums(part, many, reps, drawn, 40_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.concatenate([now for now, _ in got]).tolist() == reps.tolist()
    np.testing.assert_allclose(np.concatenate([v for _, v in got], axis=1), want, rtol=1e-9, atol=1e-9)
    assert peak < len(reps) * part.rows * 8 / 4
    sums = spark.createDataFrame([(s, g, 1, float(2 ** s)) for s in range(21) for g in ("a", "b")], "subject int, g string, n int, x double")
    rows = lambda: {(r["g"], r["rep"]): (r["n"], r["x"]) for r in resample.resampled_sums(sums, "subject", ["g"], 130, 9).collect()}
    whole = rows()
    monkeypatch.setattr(resample, "AT_ONCE", 100)
    assert len(whole) == 260 and rows() == whole


def temporal_rows(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(90):
        y = float(rng.normal())
        for t in range(3):
            x = rng.normal(size=3) + np.array([y * (t == 1), 0.5 * y, 0])
            rows.append((i, (7, 3, 20)[i % 3], t, x.tolist(), y, int(y + rng.normal() > 0)))
    return rows, spark.createDataFrame(rows, "i int, fold int, t int, x array<double>, y double, label int").repartition(4)


def test_temporal_ridge_searches_its_penalty(spark):
    """Folds with any numbers; every (fold, time) fitted from the rows in numpy."""
    rows, df = temporal_rows(spark)
    x = {t: np.array([r[3] for r in rows if r[2] == t]) for t in range(3)}
    fold, y = (np.array([r[k] for r in rows if r[2] == 0]) for k in (1, 4))
    alphas = (0.1, 5.0, 300.0)

    def line(a, b, alpha):
        mu, sd = a.mean(axis=0), a.std(axis=0)
        z = (a - mu) / sd
        w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (b - b.mean()))
        return lambda v: (v - mu) / sd @ w + b.mean()

    want = {}
    for k in (7, 3, 20):
        train = fold != k
        for s in range(3):
            marks = [np.mean([np.corrcoef(line(x[s][train & (fold != f)], y[train & (fold != f)], a)(x[s][fold == f]), y[fold == f])[0, 1] for f in (7, 3, 20) if f != k]) for a in alphas]
            fitted = line(x[s][train], y[train], alphas[int(np.argmax(marks))])
            for u in range(3):
                want.setdefault((s, u), []).append(np.corrcoef(fitted(x[u][~train]), y[~train])[0, 1])
    got = {(r["t_train"], r["t_test"]): (r["score"], r["n_folds"]) for r in models.temporal_generalization(df, "fold", "t", "x", "y", alphas=alphas).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == 3 and got[k][0] == pytest.approx(np.mean(want[k]), abs=1e-9) for k in want)


def test_temporal_newton_settles(spark):
    """Weights at the optimum: the same AUC as a plain Newton run to the end, separable times too; nothing is left unsettled."""
    rows, df = temporal_rows(spark)
    df = df.withColumn("x", F.when(F.col("t") == 2, F.array(F.col("label") * 50.0, F.get("x", F.lit(1)), F.get("x", F.lit(2)))).otherwise(F.col("x")))
    got = {(r["t_train"], r["t_test"]): r for r in models.temporal_generalization_auc(df, "fold", "t", "x", "label").collect()}
    assert all(r["unsettled"] == 0 and r["n_folds"] == 3 for r in got.values()) and got[(2, 2)]["score"] == 1.0
    data = df.collect()
    part = lambda t, keep: (np.array([r["x"] for r in data if r["t"] == t and keep(r["fold"])]), np.array([r["label"] for r in data if r["t"] == t and keep(r["fold"])]))
    scores = []
    for k in (7, 3, 20):
        a, b = part(1, lambda f: f != k)
        a = np.hstack([a, np.ones((len(a), 1))])
        cw = np.where(b == 1, len(b) / (2 * b.sum()), len(b) / (2 * (1 - b).sum()))
        w, pen = np.zeros(4), np.array([1.0, 1, 1, 0])
        for _ in range(60):
            mu = 1 / (1 + np.exp(-a @ w))
            w = w + np.linalg.solve((a * (cw * mu * (1 - mu))[:, None]).T @ a + np.diag(pen), a.T @ (cw * (b - mu)) - pen * w)
        c, d = part(0, lambda f: f == k)
        s = c @ w[:3]
        scores.append(np.mean([(p > q) + 0.5 * (p == q) for p in s[d == 1] for q in s[d == 0]]))
    assert got[(1, 0)]["score"] == pytest.approx(np.mean(scores), abs=1e-9)
