"""Correlations, tests, corrections and agreement measures over groups."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions.counting import inversions
from ..functions.moments import clip, fisher_z, pair_aggs, r_of, r_with_p
from ..functions.solvers import partial_from_cov, slopes_from_cov
from ..functions.special import normal_quantile, r_p_value, t_greater, t_quantile, t_two_sided
from ..plans.shapes import join_keys, once, ordered_scan, quantiles, with_midrank, with_totals
from ..session import stored
from .aggregate import roi_mean
from .columns import TEMPERATURE_ALIASES, pick_first_column


def complete(df, *cols):
    """Rows with all columns present."""
    for c in cols:
        df = df.where(F.col(c).isNotNull())
    return df


def safe_pearson(df, keys, x, y, min_n=2, r="r", p="p"):
    """Guarded correlation with p per group; groups without a valid r stay with a missing r."""
    return r_with_p(df.groupBy(*keys).agg(*pair_aggs(x, y)), r=r, p=p, min_n=min_n)


def spearman(df, keys, x, y, min_n=5, r="r", p="p"):
    """Correlation of average ranks on the rows where both are present."""
    ranked = with_midrank(complete(df, x, y), keys, {x: "__rx", y: "__ry"})
    out = r_with_p(ranked.groupBy(*keys).agg(*pair_aggs("__rx", "__ry")), r=r, p=p, min_n=min_n)
    return out


def _dense(column):
    """Order codes of a column of any type; equal values share a code."""
    return pc.rank(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)


def _swaps(*cols):
    """A function for ``applyInArrow``: weighted inversions of a group, in the order of ``cols[0]``, then ``cols[1]``, of ``cols[-1]``."""
    def count(key, table):
        codes = [_dense(table[c]) for c in cols]
        order = np.lexsort(codes[::-1])
        found = inversions(codes[-1][order], table["w"].to_numpy()[order])
        ends = {name: pa.array([k.as_py()], k.type) for name, k in zip(("fold_a", "fold_b"), key)}
        return pa.table(ends | {"d": pa.array([found], pa.int64())})

    return count


def kendall_tau(df, fold, feature, value):
    """tau-b between the folds' value vectors, both orders of the pair.

    Discordant pairs are inversions between two orders of the distinct value pairs: by (first, second) and by (second, first), so that
    ties are never inverted.  Each order is cut into slices by range partitioning, and an inversion is counted where it lies: in one
    slice of the second order; else in one slice of the first order, by numbers of second slices; else between cells (first slice, second
    slice), of which there are at most the square of the number of slices.  No task holds a pair of folds, and no pair of rows is formed.
    Rows with a missing value are left out; a pair of folds without two different values on a side has a missing tau.
    """
    rows = complete(df, value)
    a = rows.select(feature, F.col(fold).alias("fold_a"), F.col(value).alias("va"))
    b = rows.select(feature, F.col(fold).alias("fold_b"), F.col(value).alias("vb"))
    keys = ["fold_a", "fold_b"]
    pairs = once(a.join(b, feature).where(F.col("fold_a") < F.col("fold_b")).groupBy(*keys, "va", "vb").agg(F.count(F.lit(1)).alias("w")))
    ties = None
    for name, cols in (("tx", ["va"]), ("ty", ["vb"]), ("txy", ["va", "vb"])):
        c = pairs.groupBy(*keys, *cols).agg(F.sum("w").alias("c")).groupBy(*keys).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias(name), F.sum("c").alias("n"))
        ties = c if ties is None else join_keys(ties, c.drop("n"), keys)
    cut = stored(pairs.repartitionByRange(*keys, "va", "vb").withColumn("s", F.spark_partition_id()), "slices")
    cut = stored(cut.repartitionByRange(*keys, "vb", "va").withColumn("b", F.spark_partition_id()), "slices")
    kinds = dict(df.dtypes)
    schema = f"fold_a {kinds[fold]}, fold_b {kinds[fold]}, d long"
    cells = cut.groupBy(*keys, "s", "b").agg(F.sum("w").alias("w"))
    parts = [cut.groupBy(*keys, "b").applyInArrow(_swaps("va", "vb"), schema),
             cut.groupBy(*keys, "s").applyInArrow(_swaps("va", "vb", "b"), schema),
             cells.groupBy(*keys).applyInArrow(_swaps("s", "b"), schema)]
    disc = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*keys).agg(F.sum("d").alias("d"))
    n0 = F.col("n") * (F.col("n") - 1) / 2
    tau = F.try_divide(n0 - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("d"), F.sqrt((n0 - F.col("tx")) * (n0 - F.col("ty"))))
    out = once(join_keys(ties, disc, keys).select(*keys, "n", tau.alias("tau")))
    return out.unionByName(out.select(F.col("fold_b").alias("fold_a"), F.col("fold_a").alias("fold_b"), "n", "tau"))


def _first_order(rxy, rxz, ryz):
    den = (1 - rxz * rxz) * (1 - ryz * ryz)
    return F.when((1 - rxz * rxz > 1e-12) & (1 - ryz * ryz > 1e-12), (rxy - rxz * ryz) / F.sqrt(den))


def partial_correlation(df, keys, x, y, covariates, method="pearson", min_n=5, r="r_partial", p="p_partial", n="n_partial"):
    """r of x and y given covariates, from one pass of cross moments; p has n - 2 degrees of freedom.

    One or two covariates close in plain expressions; more solve a small matrix per group row.
    """
    zs = list(covariates)
    ok = complete(df, x, y, *zs)
    names = [x, y, *zs]
    if method == "spearman":
        ok = with_midrank(ok, keys, {v: f"__r{i}" for i, v in enumerate(names)})
        names = [f"__r{i}" for i in range(len(names))]
    aggs = [F.count(F.lit(1)).alias(n), F.min(names[1]).alias("__ylo"), F.max(names[1]).alias("__yhi")]
    for i, a in enumerate(names):
        for j in range(i, len(names)):
            aggs.append((F.var_samp(a) if i == j else F.covar_samp(a, names[j])).alias(f"__c{i}_{j}"))
    g = ok.groupBy(*keys).agg(*aggs)
    c = lambda i, j: F.col(f"__c{min(i, j)}_{max(i, j)}")
    rr = lambda i, j: F.when((c(i, i) > 0) & (c(j, j) > 0), c(i, j) / F.sqrt(c(i, i) * c(j, j)))
    if len(zs) == 0:
        value = rr(0, 1)
    elif len(zs) == 1:
        value = _first_order(rr(0, 1), rr(0, 2), rr(1, 2))
    elif len(zs) == 2:
        g = g.withColumns({"__xy": _first_order(rr(0, 1), rr(0, 2), rr(1, 2)), "__xz": _first_order(rr(0, 3), rr(0, 2), rr(3, 2)), "__yz": _first_order(rr(1, 3), rr(1, 2), rr(3, 2))})
        value = _first_order(F.col("__xy"), F.col("__xz"), F.col("__yz"))
    else:
        m = len(names)
        value = F.pandas_udf(partial_from_cov, "double")(F.array(*[F.coalesce(c(i, j), F.lit(float("nan"))) for i in range(m) for j in range(m)]))
    valid = (F.col(n) >= max(min_n, len(zs) + 2)) & (F.col("__ylo") < F.col("__yhi"))
    g = g.withColumn("__v", value)
    out = g.withColumn(r, F.when(valid & ~F.isnan("__v"), clip(F.col("__v"), -1, 1)))
    return out.withColumn(p, r_p_value(F.col(r), F.col(n))).select(*keys, r, p, n)


def partial_residuals(df, keys, x, y, covariates):
    """Row residuals of x and y after a fit on the covariates; the coefficients come from group moments."""
    zs = list(covariates)
    ok = complete(df, x, y, *zs)
    aggs = [F.avg(v).alias(f"__m_{v}") for v in (x, y, *zs)]
    aggs += [F.array(*[F.covar_samp(a, b) for a in zs for b in zs]).alias("__zz")]
    aggs += [F.array(*[F.covar_samp(z, v) for z in zs]).alias(f"__z_{v}") for v in (x, y)]
    g = ok.groupBy(*keys).agg(*aggs)
    if len(zs) == 1:
        for v in (x, y):
            g = g.withColumn(f"__b_{v}", F.array(F.try_divide(F.col(f"__z_{v}")[0], F.col("__zz")[0])))
    else:
        g = g.withColumns({f"__b_{v}": F.pandas_udf(slopes_from_cov, "array<double>")("__zz", f"__z_{v}") for v in (x, y)})
    g = g.select(*keys, *[f"__m_{v}" for v in (x, y, *zs)], *[f"__b_{v}" for v in (x, y)])
    out = join_keys(ok, g, list(keys))
    new = {}
    for v in (x, y):
        res = F.col(v) - F.col(f"__m_{v}")
        for i, z in enumerate(zs):
            res = res - F.col(f"__b_{v}")[i] * (F.col(z) - F.col(f"__m_{z}"))
        new[f"{v}_res"] = res
    return out.withColumns(new).select(*df.columns, *new)


def covariate_matrix(df, keep, order_aliases=("trial", "trial_idx", "run", "block")):
    """Default covariates under one name each: temperature and the first of trial, run, block."""
    out = pick_first_column(df, TEMPERATURE_ALIASES, "cov_temperature", ())
    found = next(a for a in order_aliases if a in df.columns)
    return out.withColumn("cov_order", F.col(found).cast("double")).select(*keep, "cov_temperature", "cov_order")


def demean(df, subject, cols):
    """Columns minus their subject mean (subject dummies without the dummies)."""
    out = with_totals(df, [subject], {f"__m_{c}": F.avg(c) for c in cols})
    return out.withColumns({c: F.col(c) - F.col(f"__m_{c}") for c in cols}).drop(*[f"__m_{c}" for c in cols])


def partial_fixed_effects(df, keys, subject, x, y, covariates):
    """Partial correlation with subject effects removed; only covariates with a value in every subject count."""
    ok = complete(df, x, y, *covariates)
    return partial_correlation(demean(ok, subject, [x, y, *covariates]), keys, x, y, covariates)


def dose_response(df, keys, dose="temp", score="score", rating="rating", min_n=3):
    """Slope, intercept, r and p of score on dose, and r, p of score with rating."""
    g = df.groupBy(*keys).agg(*pair_aggs(dose, score, "_d"), *pair_aggs(score, rating, "_v"))
    fits = (F.col("n_d") >= min_n) & (F.col("vx_d") > 0)
    g = g.withColumn("slope", F.when(fits, F.col("cxy_d") / F.col("vx_d")))
    g = g.withColumn("intercept", F.col("my_d") - F.col("slope") * F.col("mx_d"))
    g = r_with_p(g, "_d", "r_dose", "p_dose", min_n)
    g = r_with_p(g, "_v", "r_rating", "p_rating", min_n)
    return g.select(*keys, "slope", "intercept", "r_dose", "p_dose", F.col("n_d").alias("n"), "r_rating", "p_rating")


def fisher_mean(df, keys, r="r", limit=0.999999, drop_extreme=False):
    """Mean correlation through the z scale; one form leaves out values at the limit."""
    x = F.when(F.abs(r) < limit, F.col(r)) if drop_extreme else F.col(r)
    return df.groupBy(*keys).agg(F.tanh(F.avg(fisher_z(x, limit))).alias("mean_r"), F.count(x).alias("n"))


def fisher_ci(df, r="r", n="n", level=0.95, low="ci_low", high="ci_high"):
    """Confidence limits of a correlation; needs four pairs."""
    z = fisher_z(F.col(r))
    h = normal_quantile(F.lit(0.5 + level / 2)) / F.sqrt(F.greatest(F.col(n) - 3, F.lit(1)))
    ok = F.col(n) >= 4
    return df.withColumns({low: F.when(ok, F.tanh(z - h)), high: F.when(ok, F.tanh(z + h))})


def fisher_group(df, keys, r="r", level=0.95):
    """Group correlation with t limits and p over the subjects' z values; needs two."""
    g = df.groupBy(*keys).agg(F.avg(fisher_z(F.col(r))).alias("__m"), F.stddev_samp(fisher_z(F.col(r))).alias("__s"), F.count(r).alias("n"))
    se = F.col("__s") / F.sqrt("n")
    ok = F.col("n") >= 2
    h = t_quantile(F.col("n") - 1, 0.5 + level / 2) * se
    t = F.try_divide(F.col("__m"), se)
    return g.select(*keys, F.when(ok, F.tanh("__m")).alias("r_group"), F.when(ok, F.tanh(F.col("__m") - h)).alias("ci_low"),
                    F.when(ok, F.tanh(F.col("__m") + h)).alias("ci_high"), F.when(ok, t_two_sided(t, F.col("n") - 1)).alias("p"), "n")


def ttest_one_sample(df, keys, value, popmean=0.0, alternative="two-sided", min_n=2):
    """t, df and p of a mean against a fixed value."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    t = F.when((F.col("n") >= min_n) & (F.col("sd") > 0), (F.col("mean") - popmean) / (F.col("sd") / F.sqrt("n")))
    g = g.withColumns({"t": t, "df": F.col("n") - 1})
    return g.withColumn("p", (t_greater if alternative == "greater" else t_two_sided)(F.col("t"), F.col("df")))


def ttest_paired(df, keys, unit, condition, value, a, b):
    """t on the differences of unit means of two conditions, units with both."""
    val = lambda c: F.avg(F.when(F.col(condition) == c, F.col(value)))
    d = df.groupBy(*keys, *unit).agg(val(a).alias("__a"), val(b).alias("__b")).withColumn("diff", F.col("__a") - F.col("__b"))
    return ttest_one_sample(d, keys, "diff")


def _score_counts(df, keys, score, first, second, weight=None):
    """Per distinct score: rows of two kinds and how many of the first lie strictly below."""
    w = F.lit(1) if weight is None else F.col(weight)
    vc = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(F.when(first, w).otherwise(0)).alias("__a"), F.sum(F.when(second, w).otherwise(0)).alias("__b"))
    return ordered_scan(vc, keys, [score], {"__below": ("sum_before", "__a")})


def auc(df, keys, label, score, min_n=10, weight=None):
    """Area under the curve with ties at one half; needs both classes."""
    vc = _score_counts(df, keys, score, F.col(label) == 0, F.col(label) == 1, weight)
    g = vc.groupBy(*keys).agg(F.sum(F.col("__b") * (F.col("__below") + F.col("__a") / 2)).alias("__u"), F.sum("__b").alias("n_pos"), F.sum("__a").alias("n_neg"))
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (F.col("n_pos") + F.col("n_neg") >= min_n)
    return g.select(*keys, F.when(ok, F.try_divide(F.col("__u"), F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def forced_choice(df, keys, dose, score, low=46.0, high=47.0):
    """Share of low-high pairs in which the high dose has the strictly higher score, by running counts."""
    vc = _score_counts(df, keys, score, F.col(dose) < low, F.col(dose) >= high)
    g = vc.groupBy(*keys).agg(F.sum(F.col("__b") * F.col("__below")).alias("n_wins"), (F.sum("__a") * F.sum("__b")).alias("n_pairs"))
    return g.withColumn("accuracy", F.when(F.col("n_pairs") > 0, F.try_divide(F.col("n_wins"), F.col("n_pairs"))))


def roc_curve(df, keys, label, score):
    """False and true positive rate at each threshold, from the highest score down."""
    neg = df.withColumn("__s", -F.col(score))
    vc = neg.where(F.col(score).isNotNull()).groupBy(*keys, "__s").agg(F.count_if(F.col(label) == 1).alias("__p"), F.count_if(F.col(label) == 0).alias("__n"))
    vc = ordered_scan(vc, keys, ["__s"], {"tp": ("sum_to", "__p"), "fp": ("sum_to", "__n")})
    vc = with_totals(vc, keys, {"__tp": F.sum("__p"), "__tn": F.sum("__n")}).where((F.col("__tp") > 0) & (F.col("__tn") > 0))
    return vc.select(*keys, (-F.col("__s")).alias("threshold"), (F.col("fp") / F.col("__tn")).alias("fpr"), (F.col("tp") / F.col("__tp")).alias("tpr"))


def group_roc(curves, subject, n_points=100):
    """Mean true positive rate over subjects at evenly spaced false positive rates."""
    pts = curves.groupBy(subject, "fpr").agg(F.min("tpr").alias("lo"), F.max("tpr").alias("hi"))
    zero = curves.select(subject).distinct().select(subject, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    pts = pts.unionByName(zero).groupBy(subject, "fpr").agg(F.struct(F.col("fpr").alias("t"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).alias("s"))
    grid = zero.select(subject, F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("i")).select(subject, "i", (F.col("i") / (n_points - 1)).alias("fpr"))
    both = pts.select(subject, "fpr", "s", F.lit(None).cast("int").alias("i")).unionByName(grid.select(subject, "fpr", F.lit(None).cast(pts.schema["s"].dataType).alias("s"), "i"))
    both = both.withColumn("__g", F.col("i").isNotNull().cast("int"))
    both = ordered_scan(both, [subject], ["fpr", "__g"], {"a": ("last_to", "s"), "b": ("first_after", "s")}).where("i is not null")
    a, b = F.col("a"), F.col("b")
    v = F.when((a["t"] == F.col("fpr")) | b.isNull(), a["hi"]).otherwise(a["hi"] + (b["lo"] - a["hi"]) * ((F.col("fpr") - a["t"]) / (b["t"] - a["t"])))
    return both.groupBy("i").agg(F.first("fpr").alias("fpr"), F.avg(v).alias("tpr"), F.count(v).alias("n"))


def bh_fdr(df, keys=(), p="p", alpha=0.05, q="q", reject="reject", crit="crit_p"):
    """Benjamini-Hochberg within ``keys``: q, critical p and rejection; missing p are left out.

    Ranks are counted over distinct p values, so heavy ties are one row.
    """
    keys = list(keys)
    df = once(df)
    vc = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("__c"))
    vc = with_totals(vc, keys, {"__m": F.sum("__c")})
    vc = ordered_scan(vc, keys, [p], {"__k": ("sum_to", "__c")})
    vc = vc.withColumns({"__raw": F.least(F.col(p) * F.col("__m") / F.col("__k"), F.lit(1.0)), "__np": -F.col(p),
                         "__ok": F.when(F.col(p) <= F.col("__k") / F.col("__m") * alpha, F.col(p))})
    vc = vc.withColumn("__nr", -F.col("__raw"))
    vc = ordered_scan(vc, keys, ["__np"], {"__later": ("max_before", "__nr")})
    vc = with_totals(vc, keys, {crit: F.max("__ok")})
    vc = vc.select(*keys, p, F.least("__raw", F.coalesce(-F.col("__later"), F.lit(1.0))).alias(q), crit)
    out = join_keys(df, vc, [*keys, p], "left")
    return out.withColumn(reject, F.coalesce(F.col(p) <= F.col(crit), F.lit(False)))


def global_fdr(df, keys=("subject",), p="p", p_perm="p_perm", alpha=0.05):
    """Correction over all result tables of a subject at once, on the permutation p where there is one."""
    out = df.withColumn("p_used", F.coalesce(p_perm, p))
    return bh_fdr(out, keys, "p_used", alpha, "q_global", "reject_global", "crit_global")


def within_subject_correlations(df, subject, x, y, min_n=3):
    return safe_pearson(df, [subject], x, y, min_n)


def pooled_group_correlation(df, subject, x, y, min_pairs=5):
    """Group correlation by four strategies over subjects with enough pairs."""
    ok = with_totals(complete(df, x, y), [subject], {"__n": F.count(F.lit(1))}).where(F.col("__n") >= min_pairs).select(subject, x, y)
    z = with_totals(ok, [subject], {"__mx": F.avg(x), "__my": F.avg(y), "__sx": F.stddev_samp(x), "__sy": F.stddev_samp(y)})
    cx, cy = F.col(x) - F.col("__mx"), F.col(y) - F.col("__my")
    forms = {
        "pooled_trials": (F.col(x), F.col(y), F.lit(True)),
        "within_subject_centered": (cx, cy, F.lit(True)),
        "within_subject_zscored": (F.try_divide(cx, F.col("__sx")), F.try_divide(cy, F.col("__sy")), (F.col("__sx") > 0) & (F.col("__sy") > 0)),
    }
    rows = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("strategy"), a.alias("a"), b.alias("b"))) for k, (a, b, c) in forms.items()]))
    pooled = spearman(z.select(F.inline(rows)), ["strategy"], "a", "b", 2).select("strategy", "r", "p", "n")
    by = spearman(ok, [subject], x, y, min_pairs)
    g = fisher_group(by, [], "r")
    total = by.where("r is not null").agg(F.sum("n").alias("n"))
    fish = g.select(F.lit("fisher_by_subject").alias("strategy"), F.col("r_group").alias("r"), "p", total.select("n").scalar().alias("n"))
    return pooled.unionByName(fish)


def regression_metrics(df, keys, truth="y_true", pred="y_pred"):
    """R2, explained variance, MAE, RMSE, Pearson, Spearman and calibration line (truth on prediction) per group."""
    ok = with_midrank(complete(df, truth, pred), keys, {truth: "__ry", pred: "__rp"})
    e = F.col(truth) - F.col(pred)
    g = ok.groupBy(*keys).agg(*pair_aggs(pred, truth), *pair_aggs("__rp", "__ry", "_s"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(e).alias("ve"), F.var_pop(truth).alias("vt"))
    g = g.withColumn("slope", F.when(F.col("vx") > 0, F.col("cxy") / F.col("vx")))
    g = g.withColumns({"intercept": F.col("my") - F.col("slope") * F.col("mx"), "pearson_r": r_of(), "spearman_r": r_of("_s")})
    se = F.when(F.col("n") > 2, F.sqrt(F.greatest((F.col("vy") - F.col("slope") * F.col("cxy")) / (F.col("n") - 2) * (F.col("n") - 1), F.lit(0.0)) / (F.col("vx") * (F.col("n") - 1))))
    return g.select(*keys, "n", F.when(F.col("vt") > 0, 1 - F.try_divide(F.col("mse"), F.col("vt"))).alias("r2"), F.when(F.col("vt") > 0, 1 - F.try_divide(F.col("ve"), F.col("vt"))).alias("explained_variance"),
                    "mae", F.sqrt("mse").alias("rmse"), "pearson_r", r_p_value(F.col("pearson_r"), F.col("n")).alias("pearson_p"), "spearman_r", "slope", "intercept", se.alias("slope_se"))


def calibration_bins(df, truth="y_true", pred="y_pred", n_bins=10):
    """Mean truth and prediction in right-closed quantile bins of truth (equal width under three edges).

    The lowest value lies outside the first bin.
    """
    ok = complete(df, truth, pred)
    q = quantiles(ok, [], truth, {f"q{i}": i / n_bins for i in range(n_bins + 1)})
    edges = F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(n_bins + 1)]))
    lo, hi = F.col("q0"), F.col(f"q{n_bins}")
    q = q.select(F.when(F.size(edges) < 3, F.array(*[lo + (hi - lo) * i / n_bins for i in range(n_bins + 1)])).otherwise(edges).alias("edges"))
    b = ok.withColumn("__e", q.select("edges").scalar()).withColumn("bin", F.size(F.filter("__e", lambda e: e < F.col(truth))))
    b = b.where((F.col("bin") >= 1) & (F.col("bin") < F.size("__e")))
    return b.groupBy("bin").agg(F.avg(truth).alias("mean_truth"), F.avg(pred).alias("mean_pred"), F.count(F.lit(1)).alias("n"))


def bland_altman(df, keys, truth="y_true", pred="y_pred"):
    """Mean difference, SD and limits of agreement."""
    d = F.col(truth) - F.col(pred)
    g = df.groupBy(*keys).agg(F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"), F.count(d).alias("n"))
    return g.withColumns({"low": F.col("mean_diff") - 1.96 * F.col("sd"), "high": F.col("mean_diff") + 1.96 * F.col("sd")})


def error_by_bin(df, level="temp", truth="y_true", pred="y_pred", max_levels=8, n_bins=5):
    """MAE and RMSE per level (at most ``max_levels`` of them), else per quintile of the level."""
    ok = complete(df, level, truth, pred)
    levels = ok.agg(F.count_distinct(level).alias("n"))
    q = quantiles(ok, [], level, {f"q{i}": i / n_bins for i in range(n_bins + 1)})
    q = q.select(F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(n_bins + 1)])).alias("e"))
    b = ok.withColumns({"__few": levels.select("n").scalar() <= max_levels, "__e": q.select("e").scalar()})
    closed = F.greatest(F.size(F.filter("__e", lambda e: e < F.col(level))), F.lit(1))
    b = b.withColumn("bin", F.when(F.col("__few"), F.format_string("%.1f", level)).otherwise(F.concat(F.lit("q"), closed)))
    e = F.col(truth) - F.col(pred)
    return b.groupBy("bin").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def incremental_validity(df, keys, truth, model, baseline, covariate):
    """What a model adds to a baseline: r, R2, partial r given the covariate, combined R2 in [0, 1]."""
    a = regression_metrics(df, keys, truth, model).select(*keys, F.col("pearson_r").alias("r_model"), F.col("r2").alias("r2_model"), "n")
    b = regression_metrics(df, keys, truth, baseline).select(*keys, F.col("pearson_r").alias("r_base"), F.col("r2").alias("r2_base"))
    c = partial_correlation(df, keys, model, truth, [covariate]).select(*keys, "r_partial")
    out = join_keys(join_keys(a, b, list(keys)), c, list(keys), "left")
    part = F.col("r_partial") * F.col("r_partial")
    return out.withColumns({"delta_r": F.col("r_model") - F.col("r_base"), "delta_r2": F.col("r2_model") - F.col("r2_base"), "r2_partial": part,
                            "r2_combined": clip(F.coalesce("r2_base", F.lit(0.0)) + F.coalesce(part, F.lit(0.0)), 0, 1)})


def design_correlations(df, keys, names, row="volume", name="name", value="value", limit=0.2):
    """r of each pair of regressors over the volumes; one pass over wide rows, no pair rows."""
    wide = df.groupBy(*keys, row).agg(*[F.max(F.when(F.col(name) == v, F.col(value))).alias(f"v{i}") for i, v in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    g = wide.groupBy(*keys).agg(*[a for i, j in pairs for a in pair_aggs(f"v{i}", f"v{j}", f"_{i}_{j}")])
    rows = F.array(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), r_of(f"_{i}_{j}").alias("r"), F.col(f"n_{i}_{j}").alias("n")) for i, j in pairs])
    return g.select(*keys, F.inline(rows)).withColumn("flagged", F.coalesce(F.abs("r") > limit, F.lit(False)))


def group_matrix_average(df, keys=("t_train", "t_test"), subject="subject", score="score", mode="r", config=None):
    """Mean of the subjects' matrices on the union grid, through z for correlations; mixed settings raise."""
    if config:
        n = df.agg(F.count_distinct(*config).alias("n"))
        one = F.when(n.select("n").scalar() == 1, F.col(score)).otherwise(F.raise_error(F.lit("mixed configurations")).cast("double"))
        df = df.withColumn(score, one)
    x = fisher_z(F.col(score)) if mode == "r" else F.col(score)
    g = df.groupBy(*keys).agg(F.avg(x).alias("__m"), F.count(x).alias("n"))
    return g.select(*keys, (F.tanh("__m") if mode == "r" else F.col("__m")).alias("mean"), "n")


def diagonal_summary(df, subject="subject", score="score", mode="r"):
    """Mean, SD and 1.96 SE limits of the scores with equal train and test time."""
    x = fisher_z(F.col(score)) if mode == "r" else F.col(score)
    back = F.tanh if mode == "r" else (lambda c: c)
    d = df.where(F.col("t_train") == F.col("t_test")).groupBy(F.col("t_train").alias("t")).agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.count(x).alias("n"))
    h = 1.96 * F.col("s") / F.sqrt("n")
    return d.select("t", back(F.col("m")).alias("mean"), F.col("s").alias("sd"), back(F.col("m") - h).alias("ci_low"), back(F.col("m") + h).alias("ci_high"), "n")


def interband_correlation(df, bands, subject="subject", channel="channel", value="power", min_common=2):
    """Per subject r across channels between band means, and the group's Fisher mean with t limits."""
    wide = df.groupBy(subject, channel).agg(*[F.avg(F.when(F.col("band") == b, F.col(value))).alias(f"b{i}") for i, b in enumerate(bands)])
    pairs = [(i, j) for i in range(len(bands)) for j in range(i + 1, len(bands))]
    g = wide.groupBy(subject).agg(*[a for i, j in pairs for a in pair_aggs(f"b{i}", f"b{j}", f"_{i}_{j}")])
    rows = F.array(*[F.struct(F.lit(bands[i]).alias("band_a"), F.lit(bands[j]).alias("band_b"), r_of(f"_{i}_{j}", min_common).alias("r")) for i, j in pairs])
    return fisher_group(g.select(subject, F.inline(rows)), ["band_a", "band_b"])


def target_correlations(df, keys, x, targets, min_n, covariates=None, alpha=0.05, fdr_keys=()):
    """Rank correlation of x with each target, limits, partial r and BH over ``fdr_keys``.

    ``covariates`` maps a target to its covariate columns.
    """
    parts = []
    for t in targets:
        out = fisher_ci(spearman(df, keys, x, t, min_n))
        zs = (covariates or {}).get(t)
        if zs:
            out = join_keys(out, partial_correlation(df, keys, x, t, zs, "spearman"), list(keys), "left")
        parts.append(out.withColumn("target", F.lit(t)))
    res = parts[0]
    for other in parts[1:]:
        res = res.unionByName(other, allowMissingColumns=True)
    return bh_fdr(res, fdr_keys, "p", alpha)


def roi_power_correlation(features, rois, trial_keys, targets=("rating", "temp"), covariates=None, alpha=0.05, keys=("roi", "band")):
    """Region power of each band against the targets; correction over all tests."""
    means = roi_mean(features, rois, [*trial_keys, *targets, "band"])
    return target_correlations(means, list(keys), "power", targets, 5, covariates, alpha)


def channel_power_correlation(features, targets=("rating", "temp"), covariates=None, alpha=0.05, keys=("band", "channel")):
    """Channel power of each band against the targets; at least ten trials, correction within the band."""
    return target_correlations(features, list(keys), "power", targets, 10, covariates, alpha, ["band", "target"])


def edge_correlation(edges, target="rating", keys=("measure", "node_a", "node_b"), value="value", alpha=0.05):
    """Every pair against the rating, corrected per measure; untested pairs stay with a missing r."""
    tested = spearman(edges, keys, value, target, 5)
    full = join_keys(edges.select(*keys).distinct(), tested, list(keys), "left")
    full = full.withColumn("n", F.coalesce("n", F.lit(0)))
    return bh_fdr(full, [keys[0]], "p", alpha)


def roi_edge_summary(edges, node_rois, trial_keys, value="value", fisher=True):
    """Mean edge per trial inside and between regions (through z for amplitude measures)."""
    a = join_keys(edges, node_rois.select(F.col("node").alias("node_a"), F.col("roi").alias("__ra")), ["node_a"])
    b = join_keys(a, node_rois.select(F.col("node").alias("node_b"), F.col("roi").alias("__rb")), ["node_b"])
    b = b.select(*trial_keys, "node_a", "node_b", value, F.least("__ra", "__rb").alias("roi_i"), F.greatest("__ra", "__rb").alias("roi_j")).distinct()
    x = fisher_z(F.col(value)) if fisher else F.col(value)
    g = b.groupBy(*trial_keys, "roi_i", "roi_j").agg(F.avg(x).alias("__m"), F.count(value).alias("n_edges"))
    return g.withColumn("value", F.tanh("__m") if fisher else F.col("__m")).drop("__m")


def group_roi_summary(df, keys=("roi", "band"), r="r", fdr_keys=("band",), alpha=0.05):
    """Group correlation over subjects per region and band, corrected within the band."""
    return bh_fdr(fisher_group(df, keys, r), fdr_keys, "p", alpha)


def timefreq_correlation(df, trial_keys, t0, width, n_bins, target="rating", freq="freq", t="t", value="power", alpha=0.05):
    """Rank correlation of trial power and rating per frequency and time bin; q over the grid."""
    b = F.floor((F.col(t) - t0) / width).cast("int")
    cells = df.where((F.col(t) >= t0) & (F.col(t) < t0 + width * n_bins)).groupBy(*trial_keys, freq, b.alias("bin")).agg(F.avg(value).alias("p_mean"), F.first(target).alias("target"))
    return bh_fdr(spearman(cells, [freq, "bin"], "p_mean", "target", 5), [], "p", alpha)


def psychometric(df, subject="subject", rating="rating", temp="temp"):
    return spearman(df, [subject], rating, temp, 5)


def null_band_interval(df, keys, subject="subject", value="v", small_n=30):
    """Group curve with t limits (1.96 from ``small_n`` subjects on), in log and ratio units."""
    g = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    crit = F.when(F.col("n") >= small_n, F.lit(1.96)).otherwise(t_quantile(F.col("n") - 1, 0.975))
    h = crit * F.col("sd") / F.sqrt("n")
    g = g.withColumns({"ci_low": F.col("mean") - h, "ci_high": F.col("mean") + h})
    return g.withColumns({f"{c}_ratio": F.pow(F.lit(10.0), F.col(c)) for c in ("mean", "ci_low", "ci_high")})


def regression_diagnostics(df, keys, x, y, min_n=10):
    """Fit, residual, standardised residual, leverage and Cook distance of a one-predictor fit."""
    ok = complete(df, x, y)
    g = ok.groupBy(*keys).agg(*pair_aggs(x, y)).where((F.col("n") >= min_n) & (F.col("vx") > 0))
    g = g.withColumn("__b", F.col("cxy") / F.col("vx"))
    g = g.withColumn("__sd", F.sqrt(F.greatest(F.col("vy") - F.col("__b") * F.col("cxy"), F.lit(0.0))))
    j = join_keys(ok, g.select(*keys, "n", "mx", "my", "vx", "__b", "__sd"), list(keys))
    j = j.withColumn("fitted", F.col("my") + F.col("__b") * (F.col(x) - F.col("mx")))
    j = j.withColumn("residual", F.col(y) - F.col("fitted"))
    j = j.withColumns({"std_residual": F.try_divide(F.col("residual"), F.col("__sd")),
                       "leverage": 1 / F.col("n") + (F.col(x) - F.col("mx")) * (F.col(x) - F.col("mx")) / (F.col("vx") * (F.col("n") - 1))})
    h, e = F.col("leverage"), F.col("std_residual")
    return j.withColumn("cook", F.try_divide(e * e / 2 * h, (1 - h) * (1 - h))).drop("n", "mx", "my", "vx", "__b", "__sd")


def residual_checks(df, keys, truth="y_true", pred="y_pred", covariate=None):
    """Rank correlations of the residual's size with truth, and of residual and size with a covariate."""
    d = df.withColumns({"residual": F.col(truth) - F.col(pred)}).withColumn("abs_residual", F.abs("residual"))
    tests = [("abs_residual", truth)] + ([("residual", covariate), ("abs_residual", covariate)] if covariate else [])
    out = None
    for a, b in tests:
        one = spearman(d, keys, a, b, 3).withColumns({"x": F.lit(a), "y": F.lit(b)})
        out = one if out is None else out.unionByName(one)
    return out


def paired_model_metrics(a, b, subject="subject", value="r", names=("loso", "within")):
    """Two validation schemes side by side with their difference."""
    x = a.select(subject, F.col(value).alias(names[0]))
    y = b.select(subject, F.col(value).alias(names[1]))
    out = complete(join_keys(x, y, [subject]), *names)
    return out.withColumn("difference", F.col(names[0]) - F.col(names[1])).orderBy(names[0], subject)
