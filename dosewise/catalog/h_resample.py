"""Resampling on the driver's tables."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.draws import sql_hash
from ..functions.shuffles import sql_shuffle
from ..operators import resample as R
from ..operators import stats as H
from .h_stats import bh_ctes, t_crit
from .registry import query, sql, sql_midrank, sql_n, sql_normal_sf, sql_r

T, FE, SI, CE = fx.SQL_TRIALS, fx.SQL_FEATURES, fx.SQL_SIGNALS, fx.SQL_CELLS
PERM, BOOT, FLIPS = 1000, 1000, 1000


def boot_rows(src, keys, index, n, seed, by=""):
    """Oracle table of resampled rows: bt(keys, rep, index)."""
    return (f"bt AS (SELECT {keys}, rep, ({sql_hash(seed, 'rep', index)}) % cnt AS {index} FROM (SELECT {keys}, {index}, count(*) OVER (PARTITION BY {keys}) AS cnt FROM {src}), range(1, {n + 1}) r(rep))")


@query("bootstrap_percentile", sql(T + "," + "br AS (SELECT subject, pain, score, level, row_number() OVER (PARTITION BY subject ORDER BY level, trial_idx) - 1 AS pos FROM trials)," + boot_rows("br", "subject", "pos", BOOT, 42) + f""", bs AS (SELECT subject, rep, pain, score, level FROM bt JOIN br USING (subject, pos)),
  rk AS (SELECT subject, rep, pain, {sql_midrank('subject, rep', 'level')} AS rk FROM bs), st AS (SELECT subject, rep, (sum(rk) FILTER (pain = 1) - count(*) FILTER (pain = 1) * (count(*) FILTER (pain = 1) + 1) / 2) / nullif(count(*) FILTER (pain = 1) * count(*) FILTER (pain = 0), 0) AS s FROM rk GROUP BY 1, 2),
  rs AS (SELECT subject, rep, {sql_midrank('subject, rep', 'level')} AS a, {sql_midrank('subject, rep', 'score')} AS b FROM bs), ss AS (SELECT subject, rep, {sql_r('a', 'b')} AS s FROM rs GROUP BY 1, 2)""",
  """SELECT st.subject, quantile_cont(st.s, 0.025) AS ci_low, quantile_cont(st.s, 0.975) AS ci_high, count(st.s) AS n_boot, quantile_cont(ss.s, 0.025) AS rho_low, quantile_cont(ss.s, 0.975) AS rho_high FROM st JOIN ss USING (subject, rep) GROUP BY 1""", "subject, n_boot", "ci_low ci_high rho_low rho_high"))
def _(s, d):
    tr = fx.trials(s, d)
    a = R.bootstrap_percentile(tr, ["subject"], "level", "pain", ["trial_idx"], BOOT)
    b = R.bootstrap_percentile(tr, ["subject"], "level", "score", ["trial_idx"], BOOT, statistic="spearman")
    return a.join(b.select("subject", F.col("ci_low").alias("rho_low"), F.col("ci_high").alias("rho_high")), "subject")


SUMS = "sm AS (SELECT subject, count(*) AS n, sum(temp) AS sx, sum(score) AS sy, sum(temp * temp) AS sxx, sum(score * score) AS syy, sum(temp * score) AS sxy FROM trials GROUP BY 1), sub AS (SELECT *, dense_rank() OVER (ORDER BY subject) - 1 AS i FROM sm)"


def _slope(w):
    return f"(sum({w}sxy) - sum({w}sx) * sum({w}sy) / sum({w}n)) / (sum({w}sxx) - sum({w}sx) * sum({w}sx) / sum({w}n))"


@query("cluster_bootstrap", sql(T + "," + SUMS + f", mu AS (SELECT rep, ({sql_hash(7, 'rep', 'i')}) % (SELECT count(*) FROM sub) AS i FROM sub, range(1, 1001) r(rep)), bs AS (SELECT rep, {_slope('')} AS st FROM mu JOIN sub USING (i) GROUP BY 1)",
                                f"SELECT (SELECT {_slope('')} FROM sub) AS estimate, quantile_cont(st, 0.025) AS ci_low, quantile_cont(st, 0.975) AS ci_high, count(st) AS n_boot FROM bs", "n_boot", "estimate ci_low ci_high"))
def _(s, d):
    return R.cluster_bootstrap(R.subject_sums(fx.trials(s, d), "subject", "temp", "score"), "subject", "slope", n_boot=1000, seed=7)


@query("bca_interval")
def _(s, d):
    return R.bca_interval(R.subject_sums(fx.trials(s, d), "subject", "temp", "score"), "subject", "slope", n_boot=1000, seed=7)


def perm_ctes(src, keys, x, y, index, seed, within=""):
    """Oracle tables of a permutation p: src has (keys, within, index 0..n-1, x, y)."""
    groups = [k for k in (keys, within) if k]
    inner = "".join(f"{k}, " for k in groups)
    sel = f"{keys}, " if keys else ""
    on = f"USING ({keys})" if keys else "ON true"
    return (f"{sql_shuffle('mv', src, PERM, seed, groups, index)}, sh AS (SELECT {inner}rep, moved AS {index}, {y} AS yp FROM mv JOIN {src} USING ({inner}{index})),"
            f"nl AS (SELECT {sel}rep, {sql_r(x, 'yp')} AS r0 FROM sh JOIN {src} USING ({inner}{index}) GROUP BY ALL), ob AS (SELECT {sel}{sql_n(x, y)} AS n, {sql_r(x, y)} AS r FROM {src} GROUP BY ALL),"
            f"pm AS (SELECT {sel}r, n, count(r0) AS n_perm, (1 + count(*) FILTER (abs(r0) >= abs(r) - 1e-12)) / (count(r0) + 1) AS p_perm FROM nl JOIN ob {on} GROUP BY ALL)")


@query("permutation_correlation", sql(T + f", rk AS (SELECT subject, trial_idx, {sql_midrank('subject', 'rating')} AS x, {sql_midrank('subject', 'score')} AS y FROM trials)," + perm_ctes("rk", "subject", "x", "y", "trial_idx", 42), "SELECT * FROM pm", "subject, n, n_perm", "r p_perm"))
def _(s, d):
    return R.permutation_correlation(fx.trials(s, d), ["subject"], "rating", "score", ["trial_idx"], PERM)


@query("permutation_freedman_lane", sql(T + ", rs AS (SELECT subject, trial_idx, rating - avg(rating) OVER w - regr_slope(rating, temp) OVER w * (temp - avg(temp) OVER w) AS x, score - avg(score) OVER w - regr_slope(score, temp) OVER w * (temp - avg(temp) OVER w) AS y FROM trials WINDOW w AS (PARTITION BY subject)),"
                                        + perm_ctes("rs", "subject", "x", "y", "trial_idx", 42), "SELECT * FROM pm", "subject, n, n_perm", "r p_perm"))
def _(s, d):
    return R.permutation_freedman_lane(fx.trials(s, d), ["subject"], "rating", "score", ["temp"], ["trial_idx"], PERM)


@query("permutation_within_group", sql(T + "," + perm_ctes("trials", "", "temp", "score", "trial_idx", 42, "subject"), "SELECT * FROM pm", "n, n_perm", "r p_perm"))
def _(s, d):
    return R.permutation_within_group(fx.trials(s, d), [], ["subject"], "temp", "score", ["trial_idx"], PERM)


def profile_round(i, centre, width, steps=81):
    """Oracle tables of one round of the likelihood search: m{i} is the best point."""
    return (f"g{i} AS (SELECT s.*, {centre} + {-width!r} + {2 * width!r} * j / {steps - 1} AS u FROM s, range(0, {steps}) r(j)), w{i} AS (SELECT *, exp(u) AS l, exp(u) / (1 + exp(u) * n) AS w FROM g{i}),"
            f"a{i} AS (SELECT u, sum(n) AS nn, sum(n - w * n * n) AS a11, sum(sx - w * n * sx) AS a12, sum(sxx - w * sx * sx) AS a22, sum(sy - w * n * sy) AS b1, sum(sxy - w * sx * sy) AS b2, sum(syy - w * sy * sy) AS c, sum(ln(1 + l * n)) AS ld FROM w{i} GROUP BY u),"
            f"d{i} AS (SELECT *, a11 * a22 - a12 * a12 AS det FROM a{i}), e{i} AS (SELECT *, (a11 * b2 - a12 * b1) / det AS beta, (a22 * b1 - a12 * b2) / det AS alpha FROM d{i}),"
            f"f{i} AS (SELECT *, (c - alpha * b1 - beta * b2) / (nn - 2) AS s2 FROM e{i}), m{i} AS (SELECT * FROM f{i} ORDER BY -0.5 * ((nn - 2) * ln(s2) + ld + ln(det)) DESC LIMIT 1)")


MIXED = (T + ", s AS (SELECT subject, count(*)::DOUBLE AS n, sum(temp) AS sx, sum(score) AS sy, sum(temp * temp) AS sxx, sum(score * score) AS syy, sum(temp * score) AS sxy FROM trials GROUP BY 1),"
         + profile_round(1, "-2.0::DOUBLE", 10.0) + "," + profile_round(2, "(SELECT u FROM m1)", 0.25) + "," + profile_round(3, "(SELECT u FROM m2)", 0.00625))


@query("mixed_random_intercept", sql(MIXED + ", z AS (SELECT *, sqrt(s2 * a11 / det) AS se, beta / sqrt(s2 * a11 / det) AS z FROM m3)",
                                     f"SELECT beta, alpha AS intercept, se, z, 2 * {sql_normal_sf('abs(z)')} AS p, exp(u) * s2 AS var_subject, s2 AS var_residual, u > -12 AND u < 8 AS converged FROM z", "converged", "beta intercept se z p var_subject var_residual"))
def _(s, d):
    return R.mixed_random_intercept(fx.trials(s, d), "subject", "temp", "score")


@query("group_stats_table")
def _(s, d):
    tr = fx.trials(s, d)
    m = H.dose_response(tr, ["subject"]).select("subject", "slope", "r_dose", "r_rating")
    m = m.join(H.auc(tr, ["subject"], "pain", "score").select("subject", "auc"), "subject").join(H.forced_choice(tr, ["subject"], "temp", "score").select("subject", "accuracy"), "subject")
    return R.group_stats_table(m, metrics={"slope": ("plain", 0), "r_dose": ("r", 0), "r_rating": ("r", 0), "auc": ("plain", 0.5), "accuracy": ("plain", 0.5)}, n_boot=500)


@query("diag_cluster_test", sql(SI + """, o AS (SELECT channel, ti, abs(atanh(avg(x) * 8)) AS st FROM signals GROUP BY 1, 2), nu AS (SELECT channel, trial AS rep, ti, abs(atanh(x / 5)) AS st FROM signals), th AS (SELECT channel, quantile_cont(st, 0.6) AS threshold FROM nu GROUP BY 1),
  oc AS (SELECT channel, threshold, ti, st, ti - row_number() OVER (PARTITION BY channel ORDER BY ti) AS g FROM o JOIN th USING (channel) WHERE st >= threshold), cl AS (SELECT channel, threshold, min(ti) AS start, max(ti) AS stop, count(*) AS n, sum(st) AS mass FROM oc GROUP BY channel, threshold, g),
  nc AS (SELECT channel, rep, st, ti - row_number() OVER (PARTITION BY channel, rep ORDER BY ti) AS g FROM nu JOIN th USING (channel) WHERE st >= threshold), nm AS (SELECT channel, rep, sum(st) AS mass FROM nc GROUP BY channel, rep, g),
  mx AS (SELECT u.channel, u.rep, coalesce(max(mass), 0) AS top FROM (SELECT DISTINCT channel, rep FROM nu) u LEFT JOIN nm USING (channel, rep) GROUP BY 1, 2)""",
  """SELECT cl.*, (SELECT (1 + count(*) FILTER (top >= mass - 1e-9 * abs(mass))) / (count(*) + 1) FROM mx WHERE mx.channel = cl.channel) AS p FROM cl""", 'channel, start, stop AS "end", n', "threshold mass p"))
def _(s, d):
    sg = fx.signals(s, d)
    obs = sg.groupBy("channel", "ti").agg((F.avg("x") * 8).alias("score"))
    null = sg.select("channel", F.col("trial").alias("rep"), "ti", (F.col("x") / 5).alias("score"))
    return R.diag_cluster_test(obs, null, ["channel"], "ti", "score", alpha=0.4)


SIGN = CE + f""", sb AS (SELECT subject, cell // 16 AS roi, cell % 16 AS ti, avg(v) AS v FROM cells GROUP BY 1, 2, 3), ids AS (SELECT DISTINCT subject, dense_rank() OVER (ORDER BY subject) - 1 AS sid FROM sb),
  sg AS (SELECT subject, rep, CASE WHEN ({sql_hash(42, 'rep', 'sid')}) % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign FROM ids, range(1, {FLIPS + 1}) r(rep) UNION ALL SELECT subject, 0, 1.0 FROM ids),
  tt AS (SELECT roi, ti, rep, abs(avg(v * sign) / (stddev_samp(v * sign) / sqrt(count(*)))) AS t, count(*) - 1 AS df FROM sb JOIN sg USING (subject) GROUP BY 1, 2, 3),{t_crit('tt')},
  ct AS (SELECT roi, rep, ti, t, crit AS threshold, ti - row_number() OVER (PARTITION BY roi, rep ORDER BY ti) AS g FROM tt JOIN tc USING (df) WHERE t >= crit), cl AS (SELECT roi, rep, threshold, min(ti) AS start, max(ti) AS stop, count(*) AS n, sum(t) AS mass FROM ct GROUP BY roi, rep, threshold, g),
  mx AS (SELECT u.roi, u.rep, coalesce(max(mass), 0) AS top FROM (SELECT DISTINCT roi, rep FROM tt WHERE rep > 0) u LEFT JOIN cl USING (roi, rep) GROUP BY 1, 2)"""


@query("signflip_cluster_test", sql(SIGN, "SELECT roi, threshold, start, stop, n, mass, (SELECT (1 + count(*) FILTER (top >= cl.mass - 1e-9 * abs(cl.mass))) / (count(*) + 1) FROM mx WHERE mx.roi = cl.roi) AS p FROM cl WHERE rep = 0", 'roi, start, stop AS "end", n', "threshold mass p"))
def _(s, d):
    sb = fx.cells(s, d).groupBy("subject", F.floor(F.col("cell") / 16).alias("roi"), (F.col("cell") % 16).alias("ti")).agg(F.avg("v").alias("v"))
    return R.signflip_cluster_test(sb, "subject", ["roi"], "ti", "v", FLIPS)


@query("graph_cluster_test")
def _(s, d):
    sb = fx.cells(s, d).groupBy("subject", F.col("cell").alias("channel")).agg(F.avg("v").alias("v"))
    ch = sb.select(F.col("channel").alias("a")).distinct()
    nb = ch.select("a", F.explode(F.array(F.col("a") + 1, F.col("a") - 1, F.col("a") + 8, F.col("a") - 8)).alias("b")).where("b >= 0 and b < 64")
    return R.graph_cluster_test(sb, nb, "subject", "channel", "v", FLIPS, p_threshold=0.2)


@query("group_null_resample", sql(SI + f""", nu AS (SELECT subject, dense_rank() OVER (PARTITION BY subject ORDER BY trial) - 1 AS perm, ti, avg(x) AS score FROM signals GROUP BY subject, trial, ti), ob AS (SELECT ti, avg(x) * 3 AS obs FROM signals GROUP BY 1),
  ids AS (SELECT subject, dense_rank() OVER (ORDER BY subject) - 1 AS sid, count(DISTINCT perm) AS np FROM nu GROUP BY 1), pk AS (SELECT subject, rep, ({sql_hash(42, 'rep', 'sid')}) % np AS perm FROM ids, range(1, 501) r(rep)),
  mx AS (SELECT rep, ti, avg(score) AS mix FROM nu JOIN pk USING (subject, perm) GROUP BY 1, 2), pv AS (SELECT ti, obs, count(*) AS n, (1 + count(*) FILTER (abs(atanh(mix)) >= abs(atanh(obs)))) / (count(*) + 1) AS p FROM mx JOIN ob USING (ti) GROUP BY 1, 2),"""
  + bh_ctes("fd", "pv", "", "p"), "SELECT * FROM fd", "ti, n, reject", "obs p q crit_p"))
def _(s, d):
    sg = fx.signals(s, d)
    null = sg.groupBy("subject", "trial", "ti").agg(F.avg("x").alias("score"))
    ks = R.with_index(null.select("subject", "trial").distinct(), ["subject"], ["trial"], "perm")
    null = null.join(ks, ["subject", "trial"]).select("subject", "perm", "ti", "score")
    obs = sg.groupBy("ti").agg((F.avg("x") * 3).alias("score"))
    return R.group_null_resample(null, obs, "subject", "ti", n_samples=500)
