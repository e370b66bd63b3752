"""Small rows with answers worked out by hand."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from dosewise.functions import special
from dosewise.operators import aggregate as A
from dosewise.operators import align, columns, linear, models, reshape, resample, sequence, stats, topk


def rows(df, *cols):
    return sorted(tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def pairs(spark, data, names="g string, x double, y double"):
    return spark.createDataFrame(data, names)


def test_correlations(spark):
    df = pairs(spark, [("const", 1.0, 5.0), ("const", 2.0, 5.0), ("const", 3.0, 5.0), ("fit", 1.0, 2.0), ("fit", 2.0, 4.0), ("fit", 4.0, 5.0), ("one", 1.0, 1.0)])
    got = dict(rows(stats.safe_pearson(df, ["g"], "x", "y"), "g", "r"))
    assert got == {"const": None, "fit": 0.928571, "one": None}
    ties = pairs(spark, [("t", 1.0, 1.0), ("t", 2.0, 2.0), ("t", 2.0, 3.0), ("t", 3.0, 4.0)])
    assert rows(stats.spearman(ties, ["g"], "x", "y", 2), "r") == [(0.948683,)]


def test_auc_and_forced_choice(spark):
    df = spark.createDataFrame([(2.0, 1), (3.0, 1), (1.0, 0), (2.0, 0)], "s double, y int")
    assert rows(stats.auc(df, [], "y", "s", 2), "auc") == [(0.875,)]
    fc = spark.createDataFrame([(45.0, 1.0), (45.0, 2.0), (48.0, 2.0), (48.0, 3.0)], "dose double, s double")
    assert rows(stats.forced_choice(fc, [], "dose", "s"), "n_wins", "n_pairs", "accuracy") == [(3, 4, 0.75)]


def test_bh(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.5,), (None,)], "p double")
    got = {r["p"]: (r["q"] and round(r["q"], 6), r["reject"]) for r in stats.bh_fdr(df).collect()}
    assert got == {0.01: (0.04, True), 0.02: (0.04, True), 0.03: (0.04, True), 0.5: (0.5, False), None: (None, False)}


def test_fisher_mean_skips_missing(spark):
    df = spark.createDataFrame([(0.5,), (-0.5,), (None,)], "r double")
    assert rows(stats.fisher_mean(df, []), "mean_r", "n") == [(0.0, 2)]


def test_cousineau_morey(spark):
    df = spark.createDataFrame([("s1", "a", 1.0), ("s1", "b", 3.0), ("s2", "a", 5.0), ("s2", "b", 7.0)], "s string, c string, v double")
    assert rows(sequence.cousineau_morey(df, "s", "c", "v"), "c", "mean") == [("a", 2.585786), ("b", 5.414214)]


def test_group_out_mean(spark):
    df = spark.createDataFrame([("g1", 1.0), ("g1", 3.0), ("g2", 10.0)], "g string, y_true double")
    assert set(rows(models.baseline_mean_loso(df, "g"), "g", "y_pred")) == {("g1", 10.0), ("g2", 2.0)}


def test_clusters_and_segments(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 1.0, 2.0, 0.0, 3.0])], "i int, v double")
    assert rows(sequence.contiguous_clusters(df, [], "i", "v", 1.0), "start", "end", "n", "mass") == [(1, 2, 2, 3.0), (4, 4, 1, 3.0)]
    rec = spark.createDataFrame([("r", 10.0), ("all", 4.0)], "k string, end double")
    bad = spark.createDataFrame([("r", 0.0, 1.0), ("r", 4.0, 6.0), ("r", 4.5, 5.0)], "k string, start double, stop double")
    assert rows(sequence.keep_segments(rec, bad, ["k"]), "k", "start", "stop", "n_segments") == [("all", 0.0, 4.0, 1), ("r", 1.0, 4.0, 2), ("r", 6.0, 10.0, 2)]


def test_volumes(spark):
    ev = spark.createDataFrame([(2.0, 3.0)], "onset double, duration double").withColumn("s", F.lit(1))
    out = spark.createDataFrame([(2,), (7,)], "volume long").withColumn("s", F.lit(1))
    assert rows(align.events_by_volume(ev, out, ["s"], 1.0, 10), "n_heat", "n_outlier", "fraction") == [(3, 2, 0.5)]


def test_subsequence(spark):
    ev = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 2, 3, 4])], "s long, k long, value double")
    rt = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 3, 4])], "s long, k long, value double")
    got = {r["k"]: r["rating_k"] for r in align.subsequence_align(ev, rt, "s").collect()}
    assert got == {0: 0, 1: None, 2: 1, 3: 2}
    with pytest.raises(Exception):
        align.subsequence_align(ev, rt.withColumn("value", F.col("value") + 9), "s").collect()


def test_precision_and_limits(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0)], "value double, v double").withColumn("c", F.lit(1))
    assert rows(A.combine_runs_fixed(df, ["c"], variance="v"), "mean", "variance") == [(1.5, 0.75)]
    ba = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], "y_true double, y_pred double")
    assert rows(stats.bland_altman(ba, []), "mean_diff", "sd", "low", "high") == [(1.0, 1.0, -0.96, 2.96)]


def test_interpolation(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 4.0), (2, 0.0, 1.0)], "g int, t double, v double")
    grid = spark.createDataFrame([(g, t) for g in (1, 2) for t in (0.0, 1.0, 3.0)], "g int, t double")
    got = {(r["g"], r["t"]): r["v"] for r in reshape.interpolate_to_grid(s, grid, ["g"]).collect()}
    assert got == {(1, 0.0): 0.0, (1, 1.0): 2.0, (1, 3.0): None, (2, 0.0): None, (2, 1.0): None, (2, 3.0): None}


def test_labels(spark):
    df = spark.createDataFrame([(44.3, 1.0), (49.3, 2.0)], "temp double, l double")
    assert rows(columns.label_temperatures(df), "temp_label") == [("temp44p3",), ("temp49p3",)]
    assert rows(columns.binarize_labels(df, [], "l"), "label") == [(0,), (1,)]
    with pytest.raises(Exception):
        columns.binarize_labels(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "l double"), [], "l").collect()


def test_special_functions(spark):
    df = spark.createDataFrame([(2.5, 3), (1.0, 1), (2.0, 10), (1.96, 100000)], "t double, df int")
    got = rows(df.select("df", special.t_two_sided(F.col("t"), F.col("df")).alias("p")), "df", "p")
    assert got[1] == (3, 0.087707) and got[0] == (1, 0.5) and abs(got[2][1] - 0.073388) < 1e-5 and abs(got[3][1] - 0.049998) < 1e-4
    q = df.select(special.t_quantile(F.lit(10), 0.975).alias("a"), special.t_quantile(F.lit(5000), 0.975).alias("b")).first()
    assert abs(q["a"] - 2.228139) < 1e-6 and abs(q["b"] - 1.960439) < 1e-5
    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    z = spark.createDataFrame([(p,) for p in ps], "p double").select("p", special.normal_quantile(F.col("p")).alias("z")).collect()
    assert all(abs(r["z"] - NormalDist().inv_cdf(r["p"])) < 1e-7 for r in z)
    back = spark.createDataFrame([(x,) for x in (-4.0, -1.0, 0.0, 2.5)], "z double").select("z", special.normal_cdf(F.col("z")).alias("c")).collect()
    assert all(math.isclose(r["c"], NormalDist().cdf(r["z"]), rel_tol=1e-6) for r in back)


def test_stored_line_and_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "node_a string, node_b string").withColumn("g", F.lit(1))
    n = spark.createDataFrame([(c,) for c in "abcd"], "node string").withColumn("g", F.lit(1))
    r = linear.graph_metrics(e, n, ["g"]).first()
    assert (r["mean_degree"], round(r["clustering"], 6), round(r["path_length"], 6), round(r["efficiency"], 6)) == (2.0, 0.583333, 1.333333, 0.833333)
    lab = resample.connected_labels(n, e.where("node_b <> 'd'"), ["g"], a="node_a", b="node_b")
    assert rows(lab, "node", "label") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")]


def test_top_edges(spark):
    df = spark.createDataFrame([("m", "a", "b", -0.9), ("m", "a", "c", 0.5), ("m", "b", "c", None)], "measure string, node_a string, node_b string, r double")
    assert rows(topk.top_edges(df, 1), "node_b", "rank") == [("b", 1)]


def test_append_log_counts_a_run_once(spark, tmp_path):
    from dosewise.sources import tables

    path = f"{tmp_path}/log"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n long, t string")
    schema = "n long, t string"
    assert tables.scan_append_log(spark, path, schema).collect() == []
    assert tables.sink_append_log(df, path, "run 1/x") and not tables.sink_append_log(df, path, "run 1/x")
    df.write.parquet(f"{path}/data/attempt=lost-writer")  # written, never committed
    assert tables.sink_append_log(df.where("n = 2"), path, "run 2") and tables.sink_append_log(df.where("n > 9"), path, "empty")
    assert sorted(tuple(r) for r in tables.scan_append_log(spark, path, schema).collect()) == [(1, "a"), (2, "b"), (2, "b")]


def test_run_lengths_cut_nothing(spark):
    ev = spark.createDataFrame([("a", 0.0, 2.0), ("a", 250.5, 4.0), ("b", 1.0, 1.0)], "s string, onset double, duration double")
    out = spark.createDataFrame([("a", 252), ("b", 7)], "s string, volume int")
    runs = align.run_lengths(ev, ["s"], 1.0)
    assert rows(runs, "s", "n_volumes") == [("a", 255), ("b", 3)]
    assert rows(align.events_by_volume(ev, out, ["s"], 1.0, runs), "s", "n_heat", "n_outlier", "n_both") == [("a", 6, 1, 1), ("b", 1, 1, 0)]


def test_distances_of_many_sources(spark):
    """Graphs of more than 64 nodes, with a missing key, against a plain search."""
    import random

    rng = random.Random(2)
    edges, want = set(), {}
    for g, n in (("a", 150), (None, 70)):
        own = {(i, i + 1) for i in range(n - 1) if i % 13} | {(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)}
        own = {(u, v) for u, v in own if u != v}
        edges |= {(g, *e) for e in own}
        near = {}
        for u, v in own:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
        reached = hops = 0
        inverse = 0.0
        for s in near:
            dist, ring, d = {s: 0}, {s}, 0
            while ring:
                d += 1
                ring = {v for u in ring for v in near[u]} - dist.keys()
                dist |= dict.fromkeys(ring, d)
                reached, hops, inverse = reached + len(ring), hops + d * len(ring), inverse + len(ring) / d
        want[g] = (reached, hops, round(inverse, 6))
    df = spark.createDataFrame(sorted(edges, key=repr), "g string, u int, v int").repartition(3)
    both = df.unionByName(df.select("g", F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    got = linear.hop_sums(both, ["g"]).groupBy("g").agg(F.sum("reached"), F.sum("hops"), F.round(F.sum("inverse"), 6)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want
