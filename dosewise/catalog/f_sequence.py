"""Ordered operators on the driver's tables."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import sequence as S
from .registry import query, sql, sql_midrank, sql_n, sql_r, sql_r_p

T, FE, SP, SI = fx.SQL_TRIALS, fx.SQL_FEATURES, fx.SQL_SPECTRA, fx.SQL_SIGNALS


@query("within_subject_index", sql("", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS trial_idx FROM events", "user_id, event_id, trial_idx"))
def _(s, d):
    ev = fx.table(s, d, "events").select("user_id", "event_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("us"))
    return S.within_subject_index(ev, "user_id", ["us", "event_id"]).drop("us")


@query("infer_blocks", sql(T, "SELECT subject, trial_idx, CAST(trial_idx // 11 AS INTEGER) AS block FROM trials", "subject, trial_idx, block"))
def _(s, d):
    return S.infer_blocks(fx.trials(s, d)).select("subject", "trial_idx", "block")


@query("fold_adjacency", sql(T + ", g AS (SELECT subject, pain, trial_idx, trial_idx - lag(trial_idx) OVER (PARTITION BY subject, pain ORDER BY trial_idx) AS st FROM trials)",
                             "SELECT subject, pain, count(*) AS n, count(*) FILTER (st = 1) / nullif(count(st), 0) AS adjacent_share, count(*) / (max(trial_idx) - min(trial_idx) + 1) AS density FROM g GROUP BY 1, 2", "subject, pain, n", "adjacent_share density"))
def _(s, d):
    return S.fold_adjacency(fx.trials(s, d), ["subject", "pain"])


@query("running_correlation", sql(T + f""", nn AS (SELECT subject, count(*) AS n FROM trials GROUP BY 1 HAVING count(*) >= 40), w AS (SELECT t.subject, a.trial_idx AS start, t.rating, t.score FROM trials a JOIN nn USING (subject)
  JOIN trials t ON t.subject = a.subject AND t.trial_idx BETWEEN a.trial_idx AND a.trial_idx + 19 WHERE a.trial_idx + 20 <= n AND t.k > 14),
  rk AS (SELECT subject, start, {sql_midrank('subject, start', 'rating')} AS a, {sql_midrank('subject, start', 'score')} AS b FROM w)""",
  f"SELECT subject, start, {sql_n('a', 'b')} AS n, {sql_r('a', 'b', 5)} AS rho, start + 11 AS midpoint FROM rk GROUP BY 1, 2", "subject, start, n, midpoint", "rho"))
def _(s, d):
    tr = fx.trials(s, d).withColumn("rating", F.when(F.col("k") > 14, F.col("rating")))
    return S.running_correlation(tr, "subject", "trial_idx", "rating", "score")


@query("lag1_consistency", sql(T + f", l AS (SELECT subject, rating, lag(rating) OVER (PARTITION BY subject ORDER BY trial_idx) AS prev FROM trials), rk AS (SELECT subject, {sql_midrank('subject', 'rating')} AS a, {sql_midrank('subject', 'prev')} AS b FROM l WHERE prev IS NOT NULL), rr AS (SELECT subject, {sql_n('a', 'b')} AS n, {sql_r('a', 'b', 6)} AS rho FROM rk GROUP BY 1)",
                               f"SELECT subject, n, rho, {sql_r_p('rho', 'n')} AS p FROM rr", "subject, n", "rho p"))
def _(s, d):
    return S.lag1_consistency(fx.trials(s, d), "subject", ["trial_idx"], "rating")


@query("within_subject_center", sql(T, "SELECT subject, trial_idx, score - avg(score) OVER w AS score_centered, (score - avg(score) OVER w) / stddev_samp(score) OVER w AS score_z FROM trials WINDOW w AS (PARTITION BY subject)", "subject, trial_idx", "score_centered score_z"))
def _(s, d):
    return S.within_subject_center(fx.trials(s, d).select("subject", "trial_idx", "score"), ["score"]).drop("score")


@query("cousineau_morey", sql(T + """, c AS (SELECT subject, level, avg(score) AS v FROM trials GROUP BY 1, 2), a AS (SELECT level, (SELECT avg(v) FROM c) + sqrt(6 / 5) * (v - avg(v) OVER (PARTITION BY subject)) AS x FROM c)""",
  "SELECT level, avg(x) AS mean, stddev_samp(x) / sqrt(count(x)) AS sem, count(x) AS n FROM a GROUP BY 1", "level, n", "mean sem"))
def _(s, d):
    return S.cousineau_morey(fx.trials(s, d), "subject", "level", "score")


CELL = ["trial", "channel", "freq"]


@query("baseline_logratio", sql(SP, "SELECT trial, channel, freq, t, log10(power / avg(power) FILTER (t BETWEEN -3 AND -0.5) OVER (PARTITION BY trial, channel, freq)) AS logratio FROM spectra", "trial, channel, freq, t", "logratio"))
def _(s, d):
    return S.baseline_logratio(fx.spectra(s, d).select(*CELL, "t", "power"), CELL, (-3.0, -0.5)).drop("power")


@query("unit_standardize", sql(SP, """SELECT trial, channel, freq, t, CASE trial % 3 WHEN 0 THEN log10(greatest(power, 1e-20)) WHEN 1 THEN log10(greatest(1 + power / 100, 1e-20)) ELSE power END AS logratio FROM spectra""", "trial, channel, freq, t", "logratio"))
def _(s, d):
    sp = fx.spectra(s, d).withColumn("mode", F.get(F.array(F.lit("ratio"), F.lit("percent"), F.lit("logratio")), (F.col("trial") % 3).cast("int")))
    return S.unit_standardize(sp).select(*CELL, "t", "logratio")


@query("envelope_logpower", sql(SI, "SELECT trial, channel, t, 10 * log10(greatest(x * x, 1e-12) / greatest(avg(x * x) FILTER (t BETWEEN -3 AND -0.5) OVER (PARTITION BY trial, channel), 1e-12)) AS db FROM signals", "trial, channel, t", "db"))
def _(s, d):
    return S.envelope_logpower(fx.signals(s, d).select("trial", "channel", "t", "x"), ["trial", "channel"], (-3.0, -0.5)).drop("x")


@query("contiguous_clusters", sql(SI + ", g AS (SELECT trial, channel, ti, x, ti - row_number() OVER (PARTITION BY trial, channel ORDER BY ti) AS i FROM signals WHERE x >= 0.02)",
                                  'SELECT trial, channel, min(ti) AS start, max(ti) AS "end", count(*) AS n, sum(x) AS mass FROM g GROUP BY trial, channel, i', 'trial, channel, start, "end", n', "mass"))
def _(s, d):
    return S.contiguous_clusters(fx.signals(s, d).select("trial", "channel", "ti", "x"), ["trial", "channel"], "ti", "x", 0.02)


@query("gaussian_smooth", sql(T + """, nn AS (SELECT subject, count(*) AS n, avg(CASE WHEN k % 8 <> 0 THEN rating END) AS m FROM trials GROUP BY 1),
  g AS (SELECT subject, trial_idx, o, n, (trial_idx + o + 20 * n) % (2 * n) AS q FROM trials JOIN nn USING (subject), range(-8, 9) r(o)),
  h AS (SELECT subject, trial_idx, o, CASE WHEN q >= n THEN 2 * n - 1 - q ELSE q END AS j FROM g)""",
  """SELECT h.subject, h.trial_idx, sum(exp(-0.5 * pow(o / 2.0, 2)) * CASE WHEN t.k % 8 <> 0 THEN t.rating ELSE m END) / (SELECT sum(exp(-0.5 * pow(o / 2.0, 2))) FROM range(-8, 9) r(o)) AS smooth
  FROM h JOIN trials t ON t.subject = h.subject AND t.trial_idx = h.j JOIN nn ON nn.subject = h.subject GROUP BY 1, 2""", "subject, trial_idx", "smooth"))
def _(s, d):
    tr = fx.trials(s, d).withColumn("rating", F.when(F.col("k") % 8 != 0, F.col("rating")))
    return S.gaussian_smooth(tr, "subject", "trial_idx", "rating")


@query("break_intervals", sql(T + ", l AS (SELECT *, lead(onset) OVER (PARTITION BY subject ORDER BY onset, trial_idx) AS nx FROM trials)",
                              'SELECT subject, onset + duration + 2 AS start, nx - 2 AS "end", nx - onset - duration - 4 AS removed FROM l WHERE nx - (onset + duration) > 7200', "subject", "start end removed".replace("end", '"end"')))
def _(s, d):
    return S.break_intervals(fx.trials(s, d), ["subject"], 7200.0, order=["trial_idx"])


@query("keep_segments", sql(T + """, rec AS (SELECT subject, max(onset) AS e FROM trials GROUP BY 1), bad AS (SELECT subject, onset - 3600.0 AS a, least(onset + 7200.0 * (k % 4), e) AS b FROM trials JOIN rec USING (subject) WHERE trial_type = 'error'),
  u AS (SELECT subject, greatest(a, 0) AS a, b FROM bad WHERE greatest(a, 0) < b UNION ALL SELECT subject, e, e FROM rec), m AS (SELECT subject, coalesce(max(b) OVER (PARTITION BY subject ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, a AS stop FROM u)""",
  "SELECT *, count(*) OVER (PARTITION BY subject) AS n_segments FROM m WHERE start < stop", "subject, n_segments", "start stop"))
def _(s, d):
    tr = fx.trials(s, d)
    rec = tr.groupBy("subject").agg(F.max("onset").alias("end"))
    bad = tr.where("trial_type = 'error'").select("subject", (F.col("onset") - 3600.0).alias("start"), (F.col("onset") + 7200.0 * (F.col("k") % 4)).alias("stop"))
    return S.keep_segments(rec, bad, ["subject"])


@query("rolling_windows", sql(SP, "SELECT trial, channel, freq, start, avg(power) AS mean, count(power) AS n FROM spectra JOIN (SELECT 0.5 + 0.75 * i AS start FROM range(0, 4) r(i)) ON t >= start AND t <= start + 1.5 GROUP BY ALL", "trial, channel, freq, n", "start mean"))
def _(s, d):
    return S.rolling_windows(fx.spectra(s, d), CELL, 0.5, 4.25, 1.5, 0.75)


IMP = FE + ", imp AS (SELECT run AS fold, band || '_' || channel AS feature, round(abs(avg(power)), 3) AS importance FROM features GROUP BY 1, 2), rk AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY importance DESC) AS rank FROM imp)"


def importances(s, d):
    return fx.features(s, d).groupBy(F.col("run").alias("fold"), F.concat_ws("_", "band", "channel").alias("feature")).agg(F.round(F.abs(F.avg("power")), 3).alias("importance"))


@query("feature_ranks", sql(IMP, "SELECT *, avg(rank) OVER (PARTITION BY feature) AS mean_rank FROM rk", "fold, feature, rank", "importance mean_rank"))
def _(s, d):
    return S.feature_ranks(importances(s, d), "fold", "feature", "importance")


@query("baseline_modes", sql(SP + """, b AS (SELECT trial, channel, freq, t, power, avg(power) FILTER (t BETWEEN -3 AND -0.5) OVER w AS ml, stddev_pop(power) FILTER (t BETWEEN -3 AND -0.5) OVER w AS sl, avg(power) FILTER (t BETWEEN -1.5 AND 0) OVER w AS mn, stddev_pop(power) FILTER (t BETWEEN -1.5 AND 0) OVER w AS sn
  FROM spectra WINDOW w AS (PARTITION BY trial, channel, freq)), u AS (SELECT trial, channel, freq, t, power, 'long' AS baseline, ml AS m, sl AS sd FROM b UNION ALL SELECT trial, channel, freq, t, power, 'near', mn, sn FROM b)""",
  " UNION ALL ".join(f"SELECT trial, channel, freq, t, baseline, '{m}' AS mode, {e} AS corrected FROM u" for m, e in (("logratio", "log10(power / m)"), ("ratio", "power / m"), ("percent", "(power - m) / m"), ("zscore", "(power - m) / sd"))),
  "trial, channel, freq, t, baseline, mode", "corrected"))
def _(s, d):
    sp = fx.spectra(s, d).select(*CELL, "t", "power")
    return S.baseline_modes(sp, CELL, {"long": (-3.0, -0.5), "near": (-1.5, 0.0), "early": (-9.0, -4.0), "late": (0.0, 1.0)}).drop("power")
