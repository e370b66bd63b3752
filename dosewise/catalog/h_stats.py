"""Statistics on the driver's tables."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import stats as H
from ..operators.columns import roi_assignment
from .e_aggregate import ROI, SQL_ROI
from .f_sequence import IMP, importances
from .g_topk import COR, EDGE, correlations, edges
from .registry import query, sql, sql_midrank, sql_n, sql_r, sql_r_p, sql_t_p

T, FE, SP, CE, PR = fx.SQL_TRIALS, fx.SQL_FEATURES, fx.SQL_SPECTRA, fx.SQL_CELLS, fx.SQL_PREDICTIONS
CO = T + "," + fx.SQL_CONFOUNDS
Z975 = "1.959963984540054"


def rank_ctes(name, src, keys, x, y, min_n=5, extra=""):
    """Oracle tables for a rank correlation: {name} has keys, n, r, p."""
    return (f"{name}_k AS (SELECT {keys}, {sql_midrank(keys, x)} AS a, {sql_midrank(keys, y)} AS b FROM {src} WHERE ({x}) IS NOT NULL AND ({y}) IS NOT NULL {extra}),"
            f"{name}_r AS (SELECT {keys}, {sql_n('a', 'b')} AS n, {sql_r('a', 'b', min_n)} AS r FROM {name}_k GROUP BY ALL),"
            f"{name} AS (SELECT *, {sql_r_p('r', 'n')} AS p FROM {name}_r)")


def bh_ctes(name, src, keys="", p="p", alpha=0.05):
    """Oracle tables for the correction: adds q, crit_p, reject."""
    part = f"PARTITION BY {keys}" if keys else ""
    on = " AND ".join(f"s.{k.strip()} IS NOT DISTINCT FROM v.{k.strip()}" for k in keys.split(",")) if keys else "true"
    ks = f"{keys}, " if keys else ""
    return (f"{name}_v AS (SELECT {ks}{p} AS pv, row_number() OVER ({part} ORDER BY {p}) AS k, count(*) OVER ({part}) AS m FROM {src} WHERE {p} IS NOT NULL),"
            f"{name}_q AS (SELECT *, min(least(pv * m / k, 1)) OVER ({part} ORDER BY pv DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q, max(CASE WHEN pv <= k / m * {alpha} THEN pv END) OVER ({part}) AS crit_p FROM {name}_v),"
            f"{name}_d AS (SELECT DISTINCT {ks}pv, q, crit_p FROM {name}_q),"
            f"{name} AS (SELECT s.*, v.q, v.crit_p, coalesce(s.{p} <= v.crit_p, false) AS reject FROM {src} s LEFT JOIN {name}_d v ON {on} AND s.{p} = v.pv)")


def t_crit(df, name="tc"):
    """Oracle table of two-sided 5 percent t limits by bisection for the df in ``df`` (a table with column df)."""
    return (f"{name}_b AS (SELECT DISTINCT df, 0 AS i, 0.0::DOUBLE AS lo, 100.0::DOUBLE AS hi FROM {df} WHERE df >= 1 UNION ALL SELECT df, i + 1, CASE WHEN pp > 0.05 THEN mid ELSE lo END, CASE WHEN pp > 0.05 THEN hi ELSE mid END "
            f"FROM (SELECT *, {sql_t_p('mid', 'df')} AS pp FROM (SELECT *, (lo + hi) / 2 AS mid FROM {name}_b WHERE i < 55))), {name} AS (SELECT df, (lo + hi) / 2 AS crit FROM {name}_b WHERE i = 55)")


def fz(r):
    return f"CASE WHEN ({r}) IS NOT NULL THEN atanh(greatest(-0.999999, least(0.999999, {r}))) END"


@query("safe_pearson", sql(T + f", c AS (SELECT subject, {sql_n('rating', 'score')} AS n, {sql_r('rating', 'score')} AS r FROM (SELECT CASE WHEN subject % 9 = 0 THEN 7.0 ELSE rating END AS rating, CASE WHEN k % 5 <> 0 THEN score END AS score, subject FROM trials) GROUP BY 1)",
                           f"SELECT *, {sql_r_p('r', 'n')} AS p FROM c", "subject, n", "r p"))
def _(s, d):
    tr = fx.trials(s, d).withColumns({"rating": F.when(F.col("subject") % 9 == 0, 7.0).otherwise(F.col("rating")), "score": F.when(F.col("k") % 5 != 0, F.col("score"))})
    return H.safe_pearson(tr, ["subject"], "rating", "score")


@query("spearman", sql(T + "," + rank_ctes("sp", "trials", "subject", "level", "score", 10, "AND k % 5 <> 0"), "SELECT * FROM sp", "subject, n", "r p"))
def _(s, d):
    return H.spearman(fx.trials(s, d).withColumn("score", F.when(F.col("k") % 5 != 0, F.col("score"))), ["subject"], "level", "score", 10)


@query("kendall_tau", sql(IMP, """SELECT a.fold AS fold_a, b.fold AS fold_b, any_value(a.n) AS n, sum(sign(a.i - a.j) * sign(b.i - b.j)) / sqrt(count(*) FILTER (a.i <> a.j) * count(*) FILTER (b.i <> b.j)) AS tau
  FROM (SELECT x.fold, x.feature AS f, y.feature AS g, x.rank AS i, y.rank AS j, (SELECT count(DISTINCT feature) FROM rk) AS n FROM rk x JOIN rk y ON x.fold = y.fold AND x.feature < y.feature) a
  JOIN (SELECT x.fold, x.feature AS f, y.feature AS g, x.rank AS i, y.rank AS j FROM rk x JOIN rk y ON x.fold = y.fold AND x.feature < y.feature) b ON a.f = b.f AND a.g = b.g AND a.fold <> b.fold GROUP BY 1, 2""", "fold_a, fold_b, n", "tau"))
def _(s, d):
    from ..operators.sequence import feature_ranks
    return H.kendall_tau(feature_ranks(importances(s, d), "fold", "feature", "importance"), "fold", "feature", "rank")


def _partial(rxy, rxz, ryz):
    return f"(({rxy}) - ({rxz}) * ({ryz})) / sqrt((1 - ({rxz}) * ({rxz})) * (1 - ({ryz}) * ({ryz})))"


RANKED = f"rk AS (SELECT subject, {sql_midrank('subject', 'rating')} AS x, {sql_midrank('subject', 'score')} AS y, {sql_midrank('subject', 'temp')} AS z FROM trials)"


@query("partial_correlation", sql(T + "," + RANKED + ", m AS (SELECT subject, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM rk GROUP BY 1)" + f""",
  pp AS (SELECT subject, n, {_partial('xy', 'xz', 'yz')} AS r_partial FROM m),
  m3 AS (SELECT subject, corr(rating, score) AS xy, corr(rating, temp) AS xa, corr(rating, k) AS xb, corr(rating, onset) AS xc, corr(score, temp) AS ya, corr(score, k) AS yb, corr(score, onset) AS yc, corr(temp, k) AS ab, corr(temp, onset) AS ac, corr(k, onset) AS bc FROM trials GROUP BY 1),
  s1 AS (SELECT subject, {_partial('xy', 'xa', 'ya')} AS xy, {_partial('xb', 'xa', 'ab')} AS xb, {_partial('xc', 'xa', 'ac')} AS xc, {_partial('yb', 'ya', 'ab')} AS yb, {_partial('yc', 'ya', 'ac')} AS yc, {_partial('bc', 'ab', 'ac')} AS bc FROM m3),
  s2 AS (SELECT subject, {_partial('xy', 'xb', 'yb')} AS r2, {_partial('xc', 'xb', 'bc')} AS xc, {_partial('yc', 'yb', 'bc')} AS yc FROM s1)""",
  f"SELECT subject, n AS n_partial, r_partial, {sql_r_p('r_partial', 'n')} AS p_partial, r2 AS r_two, {_partial('r2', 'xc', 'yc')} AS r_three FROM pp JOIN s2 USING (subject)", "subject, n_partial", "r_partial p_partial r_two r_three"))
def _(s, d):
    tr = fx.trials(s, d)
    one = H.partial_correlation(tr, ["subject"], "rating", "score", ["temp"], "spearman")
    two = H.partial_correlation(tr, ["subject"], "rating", "score", ["temp", "k"]).select("subject", F.col("r_partial").alias("r_two"))
    three = H.partial_correlation(tr, ["subject"], "rating", "score", ["temp", "k", "onset"]).select("subject", F.col("r_partial").alias("r_three"))
    return one.join(two, "subject").join(three, "subject")


@query("partial_residuals", sql(T, "SELECT subject, trial_idx, rating - avg(rating) OVER w - regr_slope(rating, temp) OVER w * (temp - avg(temp) OVER w) AS rating_res, score - avg(score) OVER w - regr_slope(score, temp) OVER w * (temp - avg(temp) OVER w) AS score_res FROM trials WINDOW w AS (PARTITION BY subject)",
                                "subject, trial_idx", "rating_res score_res"))
def _(s, d):
    return H.partial_residuals(fx.trials(s, d), ["subject"], "rating", "score", ["temp"]).select("subject", "trial_idx", "rating_res", "score_res")


@query("covariate_matrix", sql(T, "SELECT subject, trial_idx, temp AS cov_temperature, trial_idx AS cov_order FROM trials", "subject, trial_idx", "cov_temperature cov_order"))
def _(s, d):
    return H.covariate_matrix(fx.trials(s, d), ["subject", "trial_idx"])


@query("partial_fixed_effects", sql(T + ", dm AS (SELECT pain, rating - avg(rating) OVER w AS x, score - avg(score) OVER w AS y, temp - avg(temp) OVER w AS z FROM trials WINDOW w AS (PARTITION BY subject)), m AS (SELECT pain, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM dm GROUP BY 1)",
                                    f"SELECT pain, n AS n_partial, r_partial, {sql_r_p('r_partial', 'n')} AS p_partial FROM (SELECT *, {_partial('xy', 'xz', 'yz')} AS r_partial FROM m)", "pain, n_partial", "r_partial p_partial"))
def _(s, d):
    return H.partial_fixed_effects(fx.trials(s, d), ["pain"], "subject", "rating", "score", ["temp"])


DOSE = f"""dr0 AS (SELECT subject, regr_slope(score, temp) AS slope, regr_intercept(score, temp) AS intercept, {sql_r('temp', 'score', 3)} AS r_dose, count(*) AS n, {sql_r('score', 'rating', 3)} AS r_rating FROM trials GROUP BY 1),
  dr AS (SELECT *, {sql_r_p('r_dose', 'n')} AS p_dose, {sql_r_p('r_rating', 'n')} AS p_rating FROM dr0)"""


@query("dose_response", sql(T + "," + DOSE, "SELECT * FROM dr", "subject, n", "slope intercept r_dose p_dose r_rating p_rating"))
def _(s, d):
    return H.dose_response(fx.trials(s, d), ["subject"])


def _subject_r(s, d):
    return H.dose_response(fx.trials(s, d), ["subject"]).withColumn("g", F.col("subject") % 7)


@query("fisher_mean", sql(T + "," + DOSE, f"SELECT subject % 7 AS g, tanh(avg({fz('r_dose')})) AS mean_r, count(r_dose) AS n, tanh(avg(atanh(r_rating)) FILTER (abs(r_rating) < 0.8)) AS inner_r FROM dr GROUP BY 1", "g, n", "mean_r inner_r"))
def _(s, d):
    r = _subject_r(s, d)
    return H.fisher_mean(r, ["g"], "r_dose").join(H.fisher_mean(r, ["g"], "r_rating", 0.8, True).select("g", F.col("mean_r").alias("inner_r")), "g")


@query("fisher_ci", sql(T + "," + DOSE, f"SELECT subject, n, tanh({fz('r_dose')} - {Z975} / sqrt(n - 3)) AS ci_low, tanh({fz('r_dose')} + {Z975} / sqrt(n - 3)) AS ci_high FROM dr", "subject, n", "ci_low ci_high"))
def _(s, d):
    return H.fisher_ci(_subject_r(s, d), "r_dose").select("subject", "n", "ci_low", "ci_high")


def fisher_group_ctes(name, src, keys, r):
    """Oracle tables for the group correlation."""
    on = f"USING ({keys})"
    sel = f"{keys}, " if keys else ""
    return (f"{name}_m AS (SELECT {sel}avg({fz(r)}) AS m, stddev_samp({fz(r)}) AS sd, count({r}) AS n, count({r}) - 1 AS df FROM {src} GROUP BY ALL),{t_crit(name + '_m', name + '_t')},"
            f"{name} AS (SELECT {sel}CASE WHEN n >= 2 THEN tanh(m) END AS r_group, tanh(m - crit * sd / sqrt(n)) AS ci_low, tanh(m + crit * sd / sqrt(n)) AS ci_high, {sql_t_p('(m / (sd / sqrt(n)))', 'df')} AS p, n FROM {name}_m LEFT JOIN {name}_t USING (df))")


@query("fisher_group", sql(T + "," + DOSE + ", src AS (SELECT subject % 7 AS g, r_dose FROM dr)," + fisher_group_ctes("fg", "src", "g", "r_dose"), "SELECT * FROM fg", "g, n", "r_group ci_low ci_high p"))
def _(s, d):
    return H.fisher_group(_subject_r(s, d), ["g"], "r_dose")


@query("ttest_one_sample", sql(T + ", t0 AS (SELECT subject, count(score) AS n, avg(score) AS mean, stddev_samp(score) AS sd, (avg(score) - 4.2) / (stddev_samp(score) / sqrt(count(score))) AS t, count(score) - 1 AS df FROM trials GROUP BY 1)",
                               f"SELECT *, {sql_t_p('t', 'df')} AS p, CASE WHEN t >= 0 THEN ({sql_t_p('t', 'df')}) / 2 ELSE 1 - ({sql_t_p('t', 'df')}) / 2 END AS p_greater FROM t0", "subject, n, df", "mean sd t p p_greater"))
def _(s, d):
    tr = fx.trials(s, d)
    g = H.ttest_one_sample(tr, ["subject"], "score", 4.2, "greater").select("subject", F.col("p").alias("p_greater"))
    return H.ttest_one_sample(tr, ["subject"], "score", 4.2).join(g, "subject")


@query("ttest_paired", sql(T + ", u AS (SELECT subject % 5 AS g, subject, avg(score) FILTER (trial_type = 'view') - avg(score) FILTER (trial_type = 'click') AS diff FROM trials GROUP BY 1, 2), t0 AS (SELECT g, count(diff) AS n, avg(diff) AS mean, stddev_samp(diff) AS sd, avg(diff) / (stddev_samp(diff) / sqrt(count(diff))) AS t, count(diff) - 1 AS df FROM u GROUP BY 1)",
                           f"SELECT *, {sql_t_p('t', 'df')} AS p FROM t0", "g, n, df", "mean sd t p"))
def _(s, d):
    return H.ttest_paired(fx.trials(s, d).withColumn("g", F.col("subject") % 5), ["g"], ["subject"], "trial_type", "score", "view", "click")


AUC = f"""au AS (SELECT subject, pain, {sql_midrank('subject', 'level')} AS rk FROM trials), auc AS (SELECT subject, count(*) FILTER (pain = 1) AS n_pos, count(*) FILTER (pain = 0) AS n_neg,
  (sum(rk) FILTER (pain = 1) - count(*) FILTER (pain = 1) * (count(*) FILTER (pain = 1) + 1) / 2) / nullif(count(*) FILTER (pain = 1) * count(*) FILTER (pain = 0), 0) AS auc FROM au GROUP BY 1)"""


@query("auc", sql(T + "," + AUC, "SELECT * FROM auc", "subject, n_pos, n_neg", "auc"))
def _(s, d):
    return H.auc(fx.trials(s, d), ["subject"], "pain", "level")


@query("forced_choice", sql(T, "SELECT a.subject, count(*) FILTER (b.score > a.score) AS n_wins, count(*) AS n_pairs, count(*) FILTER (b.score > a.score) / count(*) AS accuracy FROM trials a JOIN trials b ON a.subject = b.subject AND a.temp < 46 AND b.temp >= 47 GROUP BY 1", "subject, n_wins, n_pairs", "accuracy"))
def _(s, d):
    return H.forced_choice(fx.trials(s, d), ["subject"], "temp", "score")


ROC = """rc AS (SELECT subject, level AS threshold, (SELECT count(*) FROM trials u WHERE u.subject = t.subject AND u.pain = 0 AND u.level >= t.level) / nullif((SELECT count(*) FROM trials u WHERE u.subject = t.subject AND u.pain = 0), 0) AS fpr,
  (SELECT count(*) FROM trials u WHERE u.subject = t.subject AND u.pain = 1 AND u.level >= t.level) / nullif((SELECT count(*) FROM trials u WHERE u.subject = t.subject AND u.pain = 1), 0) AS tpr FROM (SELECT DISTINCT subject, level FROM trials) t)"""


@query("roc_curve", sql(T + "," + ROC + """, pt AS (SELECT subject, fpr, min(tpr) AS lo, max(tpr) AS hi FROM (SELECT subject, fpr, tpr FROM rc UNION ALL SELECT DISTINCT subject, 0, 0 FROM rc) GROUP BY 1, 2),
  gr AS (SELECT subject, i, i / 99 AS x FROM (SELECT DISTINCT subject FROM rc), range(0, 100) r(i)), ip AS (SELECT g.subject, g.i, CASE WHEN a.fpr = g.x OR b.fpr IS NULL THEN a.hi ELSE a.hi + (b.lo - a.hi) * ((g.x - a.fpr) / (b.fpr - a.fpr)) END AS v
  FROM gr g ASOF LEFT JOIN pt a ON a.subject = g.subject AND g.x >= a.fpr ASOF LEFT JOIN pt b ON b.subject = g.subject AND g.x <= b.fpr)""",
  "SELECT subject, threshold, fpr, tpr, 0 AS n FROM rc UNION ALL SELECT NULL, i, i / 99, avg(v), count(v) FROM ip GROUP BY i", "subject, threshold, n", "fpr tpr"))
def _(s, d):
    c = H.roc_curve(fx.trials(s, d), ["subject"], "pain", "level")
    g = H.group_roc(c, "subject")
    return c.withColumn("n", F.lit(0).cast("long")).unionByName(g.select(F.lit(None).cast("long").alias("subject"), F.col("i").alias("threshold"), "fpr", "tpr", "n"))


@query("bh_fdr", sql(COR + "," + bh_ctes("a", "cor", "", "p", 0.3) + ", cor2 AS (SELECT band, channel, p FROM cor)," + bh_ctes("b", "cor2", "band", "p", 0.3),
                     "SELECT band, channel, a.p, a.q, a.crit_p, a.reject, b.q AS q_band, b.reject AS reject_band FROM a JOIN b USING (band, channel)", "band, channel, reject, reject_band", "p q crit_p q_band"))
def _(s, d):
    c = correlations(s, d).select("band", "channel", "p")
    a = H.bh_fdr(c, [], "p", 0.3)
    b = H.bh_fdr(c, ["band"], "p", 0.3).select("band", "channel", F.col("q").alias("q_band"), F.col("reject").alias("reject_band"))
    return a.join(b, ["band", "channel"])


GF = T + "," + DOSE + """, al AS (SELECT subject % 20 AS subject, 'dose' AS tab, subject AS row_id, p_dose AS p, CASE WHEN subject % 3 = 0 THEN p_dose / 2 END AS p_perm FROM dr UNION ALL SELECT subject % 20, 'rating', subject, p_rating, NULL FROM dr),
  al2 AS (SELECT *, coalesce(p_perm, p) AS p_used FROM al),""" + bh_ctes("gf", "al2", "subject", "p_used")


def _result_tables(s, d):
    r = _subject_r(s, d)
    g = (F.col("subject") % 20).alias("subject")
    a = r.select(g, F.lit("dose").alias("tab"), F.col("subject").alias("row_id"), F.col("p_dose").alias("p"), F.when(F.col("subject") % 3 == 0, F.col("p_dose") / 2).alias("p_perm"))
    b = r.select(g, F.lit("rating").alias("tab"), F.col("subject").alias("row_id"), F.col("p_rating").alias("p"), F.lit(None).cast("double").alias("p_perm"))
    return a.unionByName(b)


@query("global_fdr", sql(GF, "SELECT subject, tab, row_id, p_used, q AS q_global, crit_p AS crit_global, reject AS reject_global FROM gf", "subject, tab, row_id, reject_global", "p_used q_global crit_global"))
def _(s, d):
    return H.global_fdr(_result_tables(s, d)).drop("p", "p_perm")


@query("within_subject_correlations", sql(T + f", c AS (SELECT subject, {sql_n('temp', 'score')} AS n, {sql_r('temp', 'score', 3)} AS r FROM trials GROUP BY 1)", f"SELECT *, {sql_r_p('r', 'n')} AS p FROM c", "subject, n", "r p"))
def _(s, d):
    return H.within_subject_correlations(fx.trials(s, d), "subject", "temp", "score")


@query("pooled_group_correlation", sql(T + """, ok AS (SELECT subject, k * 1.0::DOUBLE AS x, level + rating AS y FROM trials QUALIFY count(*) OVER (PARTITION BY subject) >= 5), z AS (SELECT subject, x, y, avg(x) OVER w AS mx, avg(y) OVER w AS my, stddev_samp(x) OVER w AS sx, stddev_samp(y) OVER w AS sy FROM ok WINDOW w AS (PARTITION BY subject)),
  u AS (SELECT 'pooled_trials' AS strategy, x AS a, y AS b FROM z UNION ALL SELECT 'within_subject_centered', round(x - mx, 9), round(y - my, 9) FROM z UNION ALL SELECT 'within_subject_zscored', round((x - mx) / sx, 9), round((y - my) / sy, 9) FROM z),"""
  + rank_ctes("pl", "u", "strategy", "a", "b", 2) + "," + rank_ctes("bys", "ok", "subject", "x", "y", 5) + "," + fisher_group_ctes("fg", "bys", "", "r"),
  "SELECT strategy, r, p, n FROM pl UNION ALL SELECT 'fisher_by_subject', r_group, p, (SELECT sum(n) FROM bys)::BIGINT FROM fg", "strategy, n, round(r::DOUBLE, 4) + 0.0 AS r, round(p::DOUBLE, 4) + 0.0 AS p"))
def _(s, d):
    tr = fx.trials(s, d).select("subject", (F.col("k") * F.lit(1.0)).alias("x"), (F.col("level") + F.col("rating")).alias("y"))
    return H.pooled_group_correlation(tr, "subject", "x", "y").select("strategy", F.round("r", 4).alias("r"), F.round("p", 4).alias("p"), "n")


def metric_cols(t, p):
    e = f"({t} - {p})"
    return (f"count(*) AS n, 1 - avg({e} * {e}) / var_pop({t}) AS r2, 1 - var_pop({e}) / var_pop({t}) AS explained_variance, avg(abs({e})) AS mae, sqrt(avg({e} * {e})) AS rmse, {sql_r(p, t)} AS pearson_r, "
            f"regr_slope({t}, {p}) AS slope, regr_intercept({t}, {p}) AS intercept, sqrt((1 - pow(corr({t}, {p}), 2)) * var_pop({t}) * count(*) / (count(*) - 2) / (var_pop({p}) * count(*))) AS slope_se")


@query("regression_metrics", sql(PR + "," + f"m AS (SELECT subject, {metric_cols('y_true', 'y_pred')} FROM predictions GROUP BY 1)," + rank_ctes("rs", "predictions", "subject", "y_true", "y_pred", 2),
                                 f"SELECT m.*, {sql_r_p('pearson_r', 'm.n')} AS pearson_p, rs.r AS spearman_r FROM m JOIN rs USING (subject)", "subject, n", "r2 explained_variance mae rmse pearson_r pearson_p spearman_r slope intercept slope_se"))
def _(s, d):
    return H.regression_metrics(fx.predictions(s, d), ["subject"])


@query("calibration_bins", sql(PR + ", e AS (SELECT unnest(quantile_cont(y_true, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS e FROM predictions), b AS (SELECT *, (SELECT count(DISTINCT e) FROM e WHERE e < y_true) AS bin FROM predictions)",
                               "SELECT bin, avg(y_true) AS mean_truth, avg(y_pred) AS mean_pred, count(*) AS n FROM b WHERE bin >= 1 GROUP BY 1", "bin::INTEGER AS bin, n", "mean_truth mean_pred"))
def _(s, d):
    return H.calibration_bins(fx.predictions(s, d))


@query("bland_altman", sql(PR, "SELECT fold, avg(y_true - y_pred) AS mean_diff, stddev_samp(y_true - y_pred) AS sd, count(*) AS n, avg(y_true - y_pred) - 1.96 * stddev_samp(y_true - y_pred) AS low, avg(y_true - y_pred) + 1.96 * stddev_samp(y_true - y_pred) AS high FROM predictions GROUP BY 1", "fold, n", "mean_diff sd low high"))
def _(s, d):
    return H.bland_altman(fx.predictions(s, d), ["fold"])


@query("error_by_bin", sql(PR + """, e AS (SELECT unnest(quantile_cont(trial, [0, .2, .4, .6, .8, 1])) AS e FROM predictions), b AS (SELECT printf('%.1f', temp) AS bin, y_true, y_pred FROM predictions
  UNION ALL SELECT 'q' || greatest(1, (SELECT count(*) FROM e WHERE e < trial)), y_true, y_pred FROM predictions)""", "SELECT bin, avg(abs(y_true - y_pred)) AS mae, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse, count(*) AS n FROM b GROUP BY 1", "bin, n", "mae rmse"))
def _(s, d):
    p = fx.predictions(s, d)
    return H.error_by_bin(p).unionByName(H.error_by_bin(p, "trial"))


@query("incremental_validity", sql(PR + f""", q AS (SELECT *, y_true * 0.2 + trial % 13 AS base, trial % 6 AS z FROM predictions), m AS (SELECT fold, {metric_cols('y_true', 'y_pred')}, corr(y_pred, z) AS xz, corr(y_true, z) AS yz FROM q GROUP BY 1), b AS (SELECT fold, {metric_cols('y_true', 'base')} FROM q GROUP BY 1),
  j AS (SELECT m.fold, m.n, m.pearson_r AS r_model, m.r2 AS r2_model, b.pearson_r AS r_base, b.r2 AS r2_base, {_partial('m.pearson_r', 'xz', 'yz')} AS r_partial FROM m JOIN b USING (fold))""",
  "SELECT *, r_model - r_base AS delta_r, r2_model - r2_base AS delta_r2, r_partial * r_partial AS r2_partial, greatest(0, least(1, r2_base + r_partial * r_partial)) AS r2_combined FROM j", "fold, n", "r_model r2_model r_base r2_base r_partial delta_r delta_r2 r2_partial r2_combined"))
def _(s, d):
    p = fx.predictions(s, d).withColumns({"base": F.col("y_true") * 0.2 + F.col("trial") % 13, "z": F.col("trial") % 6})
    return H.incremental_validity(p, ["fold"], "y_true", "y_pred", "base", "z")


DESIGN = """dz AS (SELECT subject, trial_idx // 5 AS volume, trial_type AS name, max(k) / 10 AS value FROM trials GROUP BY 1, 2, 3)"""


@query("design_correlations", sql(T + "," + DESIGN + f", pr AS (SELECT a.subject, a.name AS a, b.name AS b, {sql_r('a.value', 'b.value')} AS r, {sql_n('a.value', 'b.value')} AS n FROM dz a JOIN dz b ON a.subject = b.subject AND a.volume = b.volume AND a.name < b.name GROUP BY 1, 2, 3)",
                                  "SELECT s.subject, x.name AS a, y.name AS b, r, coalesce(n, 0) AS n, coalesce(abs(r) > 0.2, false) AS flagged FROM (SELECT DISTINCT subject FROM trials) s JOIN (SELECT DISTINCT trial_type AS name FROM trials) x ON true JOIN (SELECT DISTINCT trial_type AS name FROM trials) y ON x.name < y.name LEFT JOIN pr ON pr.subject = s.subject AND pr.a = x.name AND pr.b = y.name", "subject, a, b, n, flagged", "r"))
def _(s, d):
    dz = fx.trials(s, d).groupBy("subject", F.floor(F.col("trial_idx") / 5).alias("volume"), F.col("trial_type").alias("name")).agg((F.max("k") / 10).alias("value"))
    return H.design_correlations(dz, ["subject"], ["click", "error", "purchase", "signup", "view"])


SCORES = CE + ", sc AS (SELECT subject, cell // 8 / 10 AS t_train, cell % 8 / 10 AS t_test, avg(CASE WHEN NOT (subject = 2 AND cell > 50) THEN v END) AS score FROM cells GROUP BY ALL)"


def score_matrix(s, d):
    return fx.cells(s, d).withColumn("v", F.expr("case when not (subject = 2 and cell > 50) then v end")).groupBy("subject", (F.floor(F.col("cell") / 8) / 10).alias("t_train"), (F.col("cell") % 8 / 10).alias("t_test")).agg(F.avg("v").alias("score"))


@query("group_matrix_average", sql(SCORES, f"""SELECT t_train, t_test, tanh(avg({fz('score')})) AS mean, count(score) AS n, CASE WHEN t_train = t_test THEN stddev_samp({fz('score')}) END AS sd,
  CASE WHEN t_train = t_test THEN tanh(avg({fz('score')}) - 1.96 * stddev_samp({fz('score')}) / sqrt(count(score))) END AS ci_low, CASE WHEN t_train = t_test THEN tanh(avg({fz('score')}) + 1.96 * stddev_samp({fz('score')}) / sqrt(count(score))) END AS ci_high FROM sc GROUP BY 1, 2""", "t_train, t_test, n", "mean sd ci_low ci_high"))
def _(s, d):
    sc = score_matrix(s, d).withColumn("mode", F.lit("r"))
    g = H.group_matrix_average(sc, config=["mode"])
    dg = H.diagonal_summary(sc).select(F.col("t").alias("t_train"), F.col("t").alias("t_test"), "sd", "ci_low", "ci_high")
    return g.join(dg, ["t_train", "t_test"], "left")


@query("interband_correlation", sql(FE + ", w AS (SELECT subject, channel, band, avg(power) AS m FROM features GROUP BY ALL)," + f"pr AS (SELECT a.subject, a.band AS band_a, b.band AS band_b, {sql_r('a.m', 'b.m')} AS r FROM w a JOIN w b ON a.subject = b.subject AND a.channel = b.channel AND a.band < b.band GROUP BY 1, 2, 3)," + fisher_group_ctes("fg", "pr", "band_a, band_b", "r"),
                                    "SELECT * FROM fg", "band_a, band_b, n", "r_group ci_low ci_high p"))
def _(s, d):
    return H.interband_correlation(fx.features(s, d), ["b0", "b1", "b2", "b3", "b4"])


def _targets(src, keys, min_n, covariate):
    """Oracle tables for the correlations with rating and temperature; the first has a partial form."""
    rk = f"pk AS (SELECT {keys}, {sql_midrank(keys, 'power')} AS x, {sql_midrank(keys, 'rating')} AS y, {sql_midrank(keys, covariate)} AS z FROM {src}), pm AS (SELECT {keys}, count(*) AS n_partial, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM pk GROUP BY ALL), pp AS (SELECT *, {_partial('xy', 'xz', 'yz')} AS r_partial FROM pm)"
    cols = f"n, r, p, tanh({fz('r')} - {Z975} / sqrt(n - 3)) AS ci_low, tanh({fz('r')} + {Z975} / sqrt(n - 3)) AS ci_high"
    return (rank_ctes("c1", src, keys, "power", "rating", min_n) + "," + rank_ctes("c2", src, keys, "power", "temp", min_n) + "," + rk +
            f", al AS (SELECT {keys}, {cols}, r_partial, {sql_r_p('r_partial', 'n_partial')} AS p_partial, n_partial, 'rating' AS target FROM c1 JOIN pp USING ({keys}) UNION ALL SELECT {keys}, {cols}, NULL, NULL, NULL, 'temp' FROM c2)")


RM = FE + "," + SQL_ROI + ", rm AS (SELECT trial, rating, temp, band, roi, avg(power) AS power FROM features JOIN rois USING (channel) GROUP BY ALL)"


@query("roi_power_correlation", sql(RM + "," + _targets("rm", "roi, band", 5, "temp") + "," + bh_ctes("fd", "al", "", "p", 0.5), "SELECT * FROM fd", "roi, band, target, n, n_partial, reject", "r p ci_low ci_high r_partial p_partial q crit_p"))
def _(s, d):
    f = fx.features(s, d)
    return H.roi_power_correlation(f, roi_assignment(f, ROI), ["trial"], covariates={"rating": ["temp"]}, alpha=0.5)


@query("channel_power_correlation", sql(FE + "," + _targets("features", "band, channel", 10, "temp") + "," + bh_ctes("fd", "al", "band, target", "p", 0.5), "SELECT * FROM fd", "band, channel, target, n, n_partial, reject", "r p ci_low ci_high r_partial p_partial q crit_p"))
def _(s, d):
    return H.channel_power_correlation(fx.features(s, d), covariates={"rating": ["temp"]}, alpha=0.5)


CONN = CE + """, conn AS (SELECT a.subject, a.trial, CASE WHEN a.cell < 32 THEN 'aec' ELSE 'wpli' END AS measure, chr(101 + a.cell % 8) AS node_a, chr(97 + a.cell // 8 % 4) AS node_b, CASE WHEN NOT (cell = 1 AND trial > 3) THEN v END AS value, (trial * 37 % 97)::DOUBLE AS rating FROM cells a)"""


def connectivity(s, d):
    """Every cell as an edge: eight nodes from e on, four from a on, two measures; one pair is nearly untested."""
    c = fx.cells(s, d)
    tested = ~((F.col("cell") == 1) & (F.col("trial") > 3))
    return c.select("subject", "trial", F.when(F.col("cell") < 32, "aec").otherwise("wpli").alias("measure"), F.char(F.col("cell") % 8 + 101).alias("node_a"),
                    F.char(F.floor(F.col("cell") / 8) % 4 + 97).alias("node_b"), F.when(tested, F.col("v")).alias("value"), (F.col("trial") * 37 % 97).cast("double").alias("rating"))


@query("edge_correlation", sql(CONN + "," + rank_ctes("ec", "conn", "measure, node_a, node_b", "value", "rating", 5) + "," + bh_ctes("fd", "ec", "measure", "p", 0.5), "SELECT * FROM fd", "measure, node_a, node_b, n, reject", "r p q crit_p"))
def _(s, d):
    return H.edge_correlation(connectivity(s, d), alpha=0.5)


@query("roi_edge_summary", sql(CONN + """, nr AS (SELECT chr((97 + i)::INT) AS node, CASE WHEN i < 4 THEN 'A' ELSE 'B' END AS roi FROM range(0, 12) r(i) UNION ALL SELECT 'f', 'C'),
  e AS (SELECT DISTINCT trial, measure, node_a, node_b, value, least(x.roi, y.roi) AS roi_i, greatest(x.roi, y.roi) AS roi_j FROM conn JOIN nr x ON x.node = node_a JOIN nr y ON y.node = node_b)""",
  f"SELECT trial, measure, roi_i, roi_j, tanh(avg({fz('value')})) AS value, count(value) AS n_edges FROM e GROUP BY ALL", "trial, measure, roi_i, roi_j, n_edges", "value"))
def _(s, d):
    e = connectivity(s, d)
    nodes = e.select(F.explode(F.array("node_a", "node_b")).alias("node")).distinct()
    rois = nodes.select("node", F.explode(F.array_compact(F.array(F.when(F.col("node") < "e", "A").otherwise("B"), F.when(F.col("node") == "f", "C")))).alias("roi"))
    return H.roi_edge_summary(e, rois, ["trial", "measure"])


SUBR = FE + "," + SQL_ROI + ", rm AS (SELECT subject, trial, rating, band, roi, avg(power) AS power FROM features JOIN rois USING (channel) GROUP BY ALL)," + rank_ctes("sr", "rm", "subject, roi, band", "power", "rating", 5)


@query("group_roi_summary", sql(SUBR + "," + fisher_group_ctes("fg", "sr", "roi, band", "r") + "," + bh_ctes("fd", "fg", "band", "p", 0.5), "SELECT * FROM fd", "roi, band, n, reject", "r_group ci_low ci_high p q crit_p"))
def _(s, d):
    f = fx.features(s, d)
    rm = H.roi_mean(f, roi_assignment(f, ROI), ["subject", "trial", "rating", "band"])
    return H.group_roi_summary(H.spearman(rm, ["subject", "roi", "band"], "power", "rating", 5), alpha=0.5)


@query("timefreq_correlation", sql(SP + ", tb AS (SELECT trial, rating, freq, floor((t + 3) / 2)::INTEGER AS bin, avg(power) AS pm FROM spectra WHERE t >= -3 AND t < 5 GROUP BY ALL)," + rank_ctes("tf", "tb", "freq, bin", "pm", "rating", 5) + "," + bh_ctes("fd", "tf", "", "p", 0.5),
                                   "SELECT * FROM fd", "freq, bin, n, reject", "r p q crit_p"))
def _(s, d):
    return H.timefreq_correlation(fx.spectra(s, d), ["trial"], -3.0, 2.0, 4, alpha=0.5)


@query("psychometric", sql(T + "," + rank_ctes("ps", "trials", "subject", "rating", "temp", 5), "SELECT * FROM ps", "subject, n", "r p"))
def _(s, d):
    return H.psychometric(fx.trials(s, d))


@query("null_band_interval", sql(SP + ", sm AS (SELECT subject, freq AS band, t, avg(log10(power)) AS v FROM spectra GROUP BY ALL), g AS (SELECT band, t, avg(v) AS mean, stddev_samp(v) AS sd, count(v) AS n, count(v) - 1 AS df FROM sm GROUP BY ALL)," + t_crit("g"),
                                 """SELECT band, t, n, mean, sd, mean - crit * sd / sqrt(n) AS ci_low, mean + crit * sd / sqrt(n) AS ci_high, pow(10, mean) AS mean_ratio, pow(10, mean - crit * sd / sqrt(n)) AS ci_low_ratio, pow(10, mean + crit * sd / sqrt(n)) AS ci_high_ratio FROM g JOIN tc USING (df)""",
                                 "band, t, n", "mean sd ci_low ci_high mean_ratio ci_low_ratio ci_high_ratio"))
def _(s, d):
    sm = fx.spectra(s, d).groupBy("subject", F.col("freq").alias("band"), "t").agg(F.avg(F.log10("power")).alias("v"))
    return H.null_band_interval(sm, ["band", "t"])


@query("regression_diagnostics", sql(T + """, g AS (SELECT *, count(*) OVER w AS n, avg(temp) OVER w AS mx, regr_slope(score, temp) OVER w AS b, regr_intercept(score, temp) OVER w AS a, var_samp(temp) OVER w AS vx FROM trials WINDOW w AS (PARTITION BY subject)),
  f AS (SELECT *, a + b * temp AS fitted, score - a - b * temp AS residual, 1 / n + pow(temp - mx, 2) / (vx * (n - 1)) AS leverage FROM g WHERE n >= 10), h AS (SELECT *, residual / stddev_samp(residual) OVER (PARTITION BY subject) AS std_residual FROM f)""",
  "SELECT subject, trial_idx, fitted, residual, std_residual, leverage, pow(std_residual, 2) / 2 * leverage / pow(1 - leverage, 2) AS cook FROM h", "subject, trial_idx", "fitted residual std_residual leverage cook"))
def _(s, d):
    return H.regression_diagnostics(fx.trials(s, d), ["subject"], "temp", "score").select("subject", "trial_idx", "fitted", "residual", "std_residual", "leverage", "cook")


@query("residual_checks", sql(PR + ", e AS (SELECT fold, y_true, temp, round(y_true - y_pred, 9) AS r0, round(abs(y_true - y_pred), 9) AS ra FROM predictions)," + rank_ctes("a", "e", "fold", "ra", "y_true", 3) + "," + rank_ctes("b", "e", "fold", "r0", "temp", 3) + "," + rank_ctes("c", "e", "fold", "ra", "temp", 3),
                              "SELECT *, 'abs_residual' AS x, 'y_true' AS y FROM a UNION ALL SELECT *, 'residual', 'temp' FROM b UNION ALL SELECT *, 'abs_residual', 'temp' FROM c", "fold, x, y, n, round(r::DOUBLE, 5) + 0.0 AS r, round(p::DOUBLE, 4) + 0.0 AS p"))
def _(s, d):
    return H.residual_checks(fx.predictions(s, d), ["fold"], covariate="temp").select("fold", "x", "y", "n", F.round("r", 5).alias("r"), F.round("p", 4).alias("p"))


@query("paired_model_metrics", sql(T + "," + DOSE, "SELECT subject, r_dose AS loso, r_rating AS within, r_dose - r_rating AS difference FROM dr WHERE r_dose IS NOT NULL AND r_rating IS NOT NULL", "subject", "loso within difference"))
def _(s, d):
    r = _subject_r(s, d)
    return H.paired_model_metrics(r.select("subject", F.col("r_dose").alias("r")), r.select("subject", F.col("r_rating").alias("r")))
