"""Aggregations on the driver's tables."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import aggregate as A
from ..operators.columns import roi_assignment
from .registry import query, sql, sql_midrank, sql_n, sql_r, sql_r_p

T, FE, SP, SI, MA = fx.SQL_TRIALS, fx.SQL_FEATURES, fx.SQL_SPECTRA, fx.SQL_SIGNALS, fx.SQL_MAPS
CO = T + "," + fx.SQL_CONFOUNDS
MW = MA + "," + fx.SQL_WEIGHTS
ROI = {"front": ["^c[0-5]$"], "back": ["^c([6-9]|1[0-2])$"]}
SQL_ROI = "rois AS (SELECT 'c' || i AS channel, CASE WHEN i <= 5 THEN 'front' ELSE 'back' END AS roi FROM range(0, 13) r(i))"


@query("validate_events", sql(T + """, v AS (SELECT subject, run, count(*) FILTER (h) AS n_heat, count(*) FILTER (trial_type = 'purchase') AS n_decision, count(*) FILTER (trial_type = 'signup') AS n_rating,
  avg(duration) FILTER (h) AS dur_mean, stddev_samp(duration) FILTER (h) AS dur_sd, min(duration) FILTER (h) AS dur_min, max(duration) FILTER (h) AS dur_max, min(onset) AS onset_min, max(onset) AS onset_max
  FROM (SELECT *, trial_type IN ('view', 'click') AS h FROM trials) GROUP BY 1, 2),
  e AS (SELECT *, concat_ws('; ', CASE WHEN n_heat <> 4 THEN 'heat trials: ' || n_heat END, CASE WHEN coalesce(abs(dur_mean - 6) >= 1 OR dur_sd >= 2.5, true) THEN 'heat duration' END,
  CASE WHEN n_decision <> 4 THEN 'decisions: ' || n_decision END, CASE WHEN n_rating <> 4 THEN 'ratings: ' || n_rating END) AS errors FROM v)""",
  "SELECT *, errors = '' AS valid FROM e", "subject, run, n_heat, n_decision, n_rating, errors, valid", "dur_mean dur_sd dur_min dur_max onset_min onset_max"))
def _(s, d):
    tr = fx.trials(s, d).withColumn("trial_type", F.when(F.col("trial_type") == "purchase", "decision").when(F.col("trial_type") == "signup", "rating").otherwise(F.col("trial_type")))
    return A.validate_events(tr, ["subject", "run"], F.col("trial_type").isin("view", "click"), 4, 6, 1.0, 2.5)


@query("validate_confounds", sql(CO, """SELECT c.subject, c.run, count(DISTINCT volume) AS n_rows, count(DISTINCT name) AS n_columns, count(DISTINCT name) FILTER (starts_with(name, 'motion_outlier')) AS n_outlier_columns,
  count(DISTINCT name) FILTER (name IN ('view', 'click', 'signup')) AS n_present,
  concat_ws('|', CASE WHEN count(*) FILTER (name = 'click') = 0 THEN 'click' END, CASE WHEN count(*) FILTER (name = 'signup') = 0 THEN 'signup' END, CASE WHEN count(*) FILTER (name = 'view') = 0 THEN 'view' END) AS missing,
  11 AS n_volumes, count(DISTINCT volume) = 11 AS rows_match FROM confounds c GROUP BY 1, 2""", "subject, run, n_rows, n_columns, n_outlier_columns, n_present, missing, n_volumes, rows_match"))
def _(s, d):
    c = fx.confounds(s, d)
    vol = c.select("subject", "run").distinct().withColumn("n_volumes", F.lit(11))
    return A.validate_confounds(c, ["subject", "run"], ["view", "click", "signup"], volumes=vol)


@query("condition_balance", sql(T, """SELECT s.subject, l.level, count(t.trial_idx) AS n, count(t.trial_idx) = 11 AS balanced FROM (SELECT DISTINCT subject FROM trials) s
  JOIN range(0, 7) l(level) ON true LEFT JOIN trials t ON t.subject = s.subject AND t.level = l.level GROUP BY 1, 2""", "subject, level, n, balanced"))
def _(s, d):
    return A.condition_balance(fx.trials(s, d), ["subject"], "level", range(7))


@query("extract_confounds", sql(CO, """SELECT subject, run, volume, name, coalesce(value, 0) AS value, value IS NULL AS filled FROM confounds WHERE name IN ('view', 'click') OR starts_with(name, 'motion_outlier')""",
                                "subject, run, volume, name, filled", "value"))
def _(s, d):
    return A.extract_confounds(fx.confounds(s, d), ["subject", "run"], ["view", "click"])


@query("confound_summary", sql(CO + """, r AS (SELECT subject, run, count(*) FILTER (starts_with(name, 'motion_outlier')) AS n_outliers, count(*) FILTER (value IS NULL) AS n_filled FROM confounds GROUP BY 1, 2)""",
  """SELECT subject, count(*) AS n_runs, string_agg(n_outliers, ',' ORDER BY run) AS outliers, min(n_outliers) AS min_outliers, max(n_outliers) AS max_outliers, avg(n_outliers) AS mean_outliers,
  sum(n_outliers)::BIGINT AS total_outliers, bool_or(n_filled > 0) AS any_filled FROM r GROUP BY 1""", "subject, n_runs, outliers, min_outliers, max_outliers, total_outliers, any_filled", "mean_outliers"))
def _(s, d):
    r = fx.confounds(s, d).groupBy("subject", "run").agg(F.count_if(F.col("name").startswith("motion_outlier")).alias("n_outliers"), F.count_if(F.col("value").isNull()).alias("n_filled"))
    return A.confound_summary(r)


@query("rating_stats", sql(T, """SELECT s.subject, l.level, avg(rating) AS mean, stddev_pop(rating) AS sd, median(rating) AS median, min(rating) AS min, max(rating) AS max, count(rating) AS n
  FROM (SELECT DISTINCT subject FROM trials) s JOIN range(0, 7) l(level) ON true LEFT JOIN trials t ON t.subject = s.subject AND t.level = l.level GROUP BY 1, 2""", "subject, level, n", "mean sd median min max"))
def _(s, d):
    return A.rating_stats(fx.trials(s, d), ["subject"], "level", range(7))


@query("displacement_stats", sql(T + """, r AS (SELECT subject, run, avg(fd) AS m, max(fd) AS mx, stddev_pop(fd) AS sd, count(fd) + 1 AS nv, count(*) FILTER (trial_type = 'error') AS n_out
  FROM (SELECT *, CASE WHEN trial_idx % 11 > 0 THEN k / 100 END AS fd FROM trials) GROUP BY 1, 2)""",
  """SELECT subject, avg(m) AS mean_fd, median(m) AS median_run_fd, max(mx) AS max_fd, avg(sd) AS sd_fd, sum(nv)::BIGINT AS n_volumes, sum(n_out)::BIGINT AS n_outliers, sum(n_out) / sum(nv) AS outlier_fraction FROM r GROUP BY 1""",
  "subject, n_volumes, n_outliers", "mean_fd median_run_fd max_fd sd_fd outlier_fraction"))
def _(s, d):
    tr = fx.trials(s, d).withColumn("fd", F.when(F.col("trial_idx") % 11 > 0, F.col("k") / 100))
    return A.displacement_stats(tr, ["subject", "run"], ["subject"], "fd", F.col("trial_type") == "error")


@query("qc_status", sql(T + """, q AS (SELECT subject, avg(k) / 97.3 AS fd, count(*) AS dof, count(*) FILTER (trial_type = 'error') AS n_bad FROM trials GROUP BY 1)""",
  """SELECT subject, (n_bad > 15)::INT + (fd > 0.55)::INT AS n_flags, (fd > 0.5)::INT + (dof < 60)::INT AS n_warnings, concat_ws('; ', CASE WHEN n_bad > 15 THEN n_bad || ' bad values' END, CASE WHEN fd > 0.55 THEN 'motion' END) AS flags,
  concat_ws('; ', CASE WHEN fd > 0.5 THEN 'mean displacement' END, CASE WHEN dof < 60 THEN 'low dof' END) AS warnings, CASE WHEN n_bad > 15 OR fd > 0.55 THEN 'FAIL' ELSE 'PASS' END AS status, fd FROM q""",
  "subject, n_flags, n_warnings, flags, warnings, status", "fd"))
def _(s, d):
    q = fx.trials(s, d).groupBy("subject").agg((F.avg("k") / 97.3).alias("fd"), F.count("k").alias("dof"), F.count_if(F.col("trial_type") == "error").alias("n_bad"))
    return A.qc_status(q, [(F.col("n_bad") > 15, F.format_string("%d bad values", "n_bad")), (F.col("fd") > 0.55, "motion")],
                       [(F.col("fd") > 0.5, "mean displacement"), (F.col("dof") < 60, "low dof")]).drop("dof", "n_bad")


@query("nonfinite_counts", sql(MA, "SELECT subject, count(*) AS n, count(*) FILTER ((trial * 7 + cell) % 53 = 0) AS n_nan, count(*) FILTER ((trial * 7 + cell) % 53 = 1) AS n_inf FROM maps GROUP BY 1", "subject, n, n_nan, n_inf"))
def _(s, d):
    h = (F.col("trial") * 7 + F.col("cell")) % 53
    m = fx.maps(s, d).withColumn("value", F.when(h == 0, float("nan")).when(h == 1, float("inf")).otherwise(F.col("value")))
    return A.nonfinite_counts(m, ["subject"], "value")


@query("pain_counts_total", sql(T, "SELECT coalesce(subject::VARCHAR, 'TOTAL') AS subject, count(*) FILTER (pain = 1) AS n_pain, count(*) FILTER (pain = 0) AS n_nonpain, count(pain) AS n_total FROM trials GROUP BY ROLLUP (subject)",
                                "subject, n_pain, n_nonpain, n_total"))
def _(s, d):
    return A.pain_counts_total(fx.trials(s, d))


@query("preprocessing_stats", sql(T + """, p AS (SELECT subject, run, count(DISTINCT k % 16) FILTER (rating > 80) AS n_bad_channels, count(*) FILTER (k > 90) AS n_bad_components, count(*) FILTER (st = 'clean') AS n_clean,
  count(*) FILTER (st = 'removed') AS n_removed, count(*) FILTER (st = 'boundary') AS n_boundary, count(*) FILTER (st = 'clean' AND trial_type = 'view') AS clean_view, count(*) FILTER (st = 'clean' AND trial_type = 'click') AS clean_click
  FROM (SELECT *, CASE WHEN trial_type = 'error' THEN 'removed' WHEN k < 5 THEN 'boundary' ELSE 'clean' END AS st FROM trials) GROUP BY 1, 2),
  u AS (SELECT unnest(['n_bad_channels', 'n_bad_components', 'n_clean', 'n_removed', 'n_boundary', 'clean_view', 'clean_click']) AS metric, unnest([n_bad_channels, n_bad_components, n_clean, n_removed, n_boundary, clean_view, clean_click]) AS x FROM p)""",
  """SELECT metric, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS min, max(x) AS max, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q75 FROM u GROUP BY 1""",
  "metric, n", "mean sd min max q25 median q75"))
def _(s, d):
    tr = fx.trials(s, d)
    ks = ["subject", "run"]
    ch = tr.select(*ks, (F.col("k") % 16).alias("channel"), F.when(F.col("rating") > 80, "bad").otherwise("good").alias("status"))
    co = tr.select(*ks, F.when(F.col("k") > 90, "bad").otherwise("good").alias("status"))
    ep = tr.select(*ks, F.when(F.col("trial_type") == "error", "removed").when(F.col("k") < 5, "boundary").otherwise("clean").alias("state"), F.col("trial_type").alias("event"))
    st = A.preprocessing_stats(ch, co, ep, ks, ["view", "click"])
    return A.describe_columns(st, [c for c in st.columns if c not in ks])


@query("sync_bad_channels", sql(T, "SELECT subject, run, trial_idx, k % 16 AS channel, CASE WHEN bool_or(rating > 150) OVER (PARTITION BY subject, k % 16) THEN 'bad' ELSE 'good' END AS status FROM trials", "subject, run, trial_idx, channel, status"))
def _(s, d):
    ch = fx.trials(s, d).select("subject", "run", "trial_idx", (F.col("k") % 16).alias("channel"), F.when(F.col("rating") > 150, "bad").otherwise("good").alias("status"))
    return A.sync_bad_channels(ch)


@query("events_integrity", sql(T + """, x AS (SELECT subject, run, trial_idx, CASE WHEN k % 13 <> 0 THEN onset - 3600 * (k % 5) END AS onset, duration, CASE WHEN k % 6 <> 0 THEN trial_type END AS trial_type FROM trials),
  y AS (SELECT *, onset - lag(onset) OVER (PARTITION BY subject, run ORDER BY trial_idx) < -1e-9 AS back FROM x)""",
  """SELECT subject, run, count(*) AS n_rows, count(*) - count(onset) AS n_missing_onset, count(*) - count(duration) AS n_missing_duration, count(*) - count(trial_type) AS n_missing_trial_type,
  coalesce(string_agg(DISTINCT trial_type, '|' ORDER BY trial_type), '') AS trial_types, min(onset) AS onset_min, max(onset) AS onset_max, coalesce(bool_or(back), false) AS nonmonotonic, count(*) FILTER (onset < 0) AS n_negative FROM y GROUP BY 1, 2""",
  "subject, run, n_rows, n_missing_onset, n_missing_duration, n_missing_trial_type, trial_types, nonmonotonic, n_negative", "onset_min onset_max"))
def _(s, d):
    tr = fx.trials(s, d).select("subject", "run", "trial_idx", F.when(F.col("k") % 13 != 0, F.col("onset") - 3600 * (F.col("k") % 5)).alias("onset"), "duration",
                                F.when(F.col("k") % 6 != 0, F.col("trial_type")).alias("trial_type"))
    return A.events_integrity(tr, ["subject", "run"], ["trial_idx"])


@query("param_mode", sql(T + ", c AS (SELECT subject, level AS value, count(*) AS n FROM trials GROUP BY 1, 2)", "SELECT subject, value, n FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, value) AS o FROM c) WHERE o = 1", "subject, value, n"))
def _(s, d):
    return A.param_mode(fx.trials(s, d).withColumnRenamed("level", "value"), ["subject"])


@query("null_summary", sql(T, """SELECT trial_type, count(*) AS n, avg(score) AS mean, stddev_samp(score) AS sd, min(score) AS min, max(score) AS max, quantile_cont(score, 0.25) AS q25, median(score) AS median, quantile_cont(score, 0.75) AS q75,
  (avg(pow(score, 3)) - 3 * avg(score) * avg(pow(score, 2)) + 2 * pow(avg(score), 3)) / pow(var_pop(score), 1.5) AS skew, kurtosis_pop(score) AS kurtosis FROM trials GROUP BY 1""", "trial_type, n", "mean sd min max q25 median q75 skew kurtosis"))
def _(s, d):
    return A.null_summary(fx.trials(s, d), ["trial_type"], "score")


@query("roi_mean", sql(FE + "," + SQL_ROI, "SELECT trial, band, roi, avg(power) AS power, count(power) AS n_channels FROM features JOIN rois USING (channel) GROUP BY 1, 2, 3", "trial, band, roi, n_channels", "power"))
def _(s, d):
    f = fx.features(s, d)
    return A.roi_mean(f, roi_assignment(f, ROI), ["trial", "band"])


BANDS = {"theta": (4.0, 7.9), "alpha": (8.0, 12.9), "gamma": (30.1, 80.0)}


@query("band_power", sql(SP, """SELECT trial, channel, b.band, coalesce((SELECT avg(power) FROM spectra s WHERE s.trial = x.trial AND s.channel = x.channel AND s.freq BETWEEN lo AND hi AND t BETWEEN 0.5 AND 4), 0) AS power
  FROM (SELECT DISTINCT trial, channel FROM spectra) x, (VALUES ('theta', 4.0, 7.9), ('alpha', 8.0, 12.9), ('gamma', 30.1, 80.0)) b(band, lo, hi)""", "trial, channel, band", "power"))
def _(s, d):
    return A.band_power(fx.spectra(s, d), ["trial", "channel"], BANDS, 0.5, 4.0)


@query("group_channel_power", sql(FE, "SELECT band, channel, avg(m) AS mean, stddev_samp(m) AS sd, count(m) AS n FROM (SELECT subject, band, channel, avg(power) AS m FROM features GROUP BY ALL) GROUP BY 1, 2", "band, channel, n", "mean sd"))
def _(s, d):
    return A.group_channel_power(fx.features(s, d))


@query("group_band_power_ci", sql(FE, """SELECT band, avg(m) AS mean, avg(m) - 1.96 * stddev_samp(m) / sqrt(count(m)) AS ci_low, avg(m) + 1.96 * stddev_samp(m) / sqrt(count(m)) AS ci_high, count(m) AS n
  FROM (SELECT subject, band, avg(power) AS m FROM features GROUP BY ALL) GROUP BY 1""", "band, n", "mean ci_low ci_high"))
def _(s, d):
    return A.group_band_power_ci(fx.features(s, d))


def _summary(src, keys):
    return f"""s1 AS (SELECT subject, {keys}, pain, temp, CASE WHEN NOT (subject = 4 AND pain = 1) THEN power END AS power FROM {src}),
  lab AS (SELECT subject, {keys}, 'All' AS label, avg(power) AS mu FROM s1 GROUP BY ALL UNION ALL SELECT subject, {keys}, printf('%.1f', temp), avg(power) FROM s1 GROUP BY subject, {keys}, temp),
  pr AS (SELECT subject, {keys}, avg(power) FILTER (pain = 1) AS p, avg(power) FILTER (pain = 0) AS q FROM s1 GROUP BY ALL HAVING count(power) FILTER (pain = 1) > 0 AND count(power) FILTER (pain = 0) > 0),
  al AS (SELECT * FROM lab UNION ALL SELECT subject, {keys}, 'Pain', p FROM pr UNION ALL SELECT subject, {keys}, 'Non-pain', q FROM pr UNION ALL SELECT subject, {keys}, 'Diff', p - q FROM pr)"""


# One subject has no value under pain.
GAP = "case when not (subject = 4 and pain = 1) then power end"
SUMMARY = "SELECT {k}, label, avg(mu) AS mu_log10, count(mu) AS n, (pow(10, avg(mu)) - 1) * 100 AS pct_change FROM al GROUP BY ALL"


@query("band_condition_summary", sql(FE + "," + _summary("features", "band"), SUMMARY.format(k="band"), "band, label, n", "mu_log10 pct_change"))
def _(s, d):
    return A.band_condition_summary(fx.features(s, d).withColumn("power", F.expr(GAP)))


@query("roi_condition_summary", sql(FE + "," + SQL_ROI + ", rm AS (SELECT subject, trial, pain, temp, band, roi, avg(power) AS power FROM features JOIN rois USING (channel) GROUP BY ALL)," + _summary("rm", "band, roi"),
                                    SUMMARY.format(k="band, roi"), "band, roi, label, n", "mu_log10 pct_change"))
def _(s, d):
    f = fx.features(s, d).withColumn("power", F.expr(GAP))
    return A.roi_condition_summary(f, roi_assignment(f, ROI), ["subject", "trial", "pain", "temp", "band"])


@query("baseline_plateau_qc", sql(SP + """, c AS (SELECT freq AS band, trial, channel, avg(power) FILTER (t BETWEEN -3 AND -0.5) AS b, avg(power) FILTER (t BETWEEN 0.5 AND 4) AS p, count(*) FILTER (t BETWEEN -3 AND -0.5) AS nb,
  count(*) FILTER (t BETWEEN 0.5 AND 4) AS np FROM spectra GROUP BY ALL), r AS (SELECT *, log10((p + 1e-20) / (b + 1e-20)) AS l FROM c)""",
  """SELECT band, avg(b) AS mean_baseline, avg(p) AS mean_plateau, avg(l) AS mean_logratio, median(b) AS median_baseline, median(p) AS median_plateau, median(l) AS median_logratio, sum(nb)::BIGINT AS n_baseline, sum(np)::BIGINT AS n_plateau FROM r GROUP BY 1""",
  "band, n_baseline, n_plateau", "mean_baseline mean_plateau mean_logratio median_baseline median_plateau median_logratio"))
def _(s, d):
    sp = fx.spectra(s, d).withColumnRenamed("freq", "band")
    return A.baseline_plateau_qc(sp, ["trial", "channel"], ["band"], (-3.0, -0.5), (0.5, 4.0))


@query("condition_contrast", sql(FE + """, c AS (SELECT band, channel, 'pain' AS contrast, pain = 1 AS hi, pain = 0 AS lo, power FROM features UNION ALL
  SELECT band, channel, 'temperature', round(temp, 1) = (SELECT max(round(temp, 1)) FROM features), round(temp, 1) = (SELECT min(round(temp, 1)) FROM features), power FROM features)""",
  """SELECT band, channel, contrast, avg(power) FILTER (hi) AS mean_high, avg(power) FILTER (lo) AS mean_low, count(*) FILTER (hi) AS n_high, count(*) FILTER (lo) AS n_low,
  avg(power) FILTER (hi) - avg(power) FILTER (lo) AS diff, (pow(10, avg(power) FILTER (hi) - avg(power) FILTER (lo)) - 1) * 100 AS pct_change FROM c GROUP BY ALL""", "band, channel, contrast, n_high, n_low", "mean_high mean_low diff pct_change"))
def _(s, d):
    return A.condition_contrast(fx.features(s, d))


@query("windowed_contrast", sql(SP + """, w AS (SELECT subject, channel, floor((t - 0.5) / 1)::INTEGER AS "window", avg(power) FILTER (pain = 1) AS p, avg(power) FILTER (pain = 0) AS q FROM spectra WHERE t >= 0.5 AND t < 4.5 GROUP BY ALL)""",
  """SELECT channel, "window", avg(p) AS mean_pain, avg(q) AS mean_nonpain, count(*) AS n_subjects, avg(p) - avg(q) AS diff FROM w WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""",
  'channel, "window", n_subjects', "mean_pain mean_nonpain diff"))
def _(s, d):
    return A.windowed_contrast(fx.spectra(s, d), 0.5, 4.5, 4)


@query("evoked_average", sql(SI + """, b AS (SELECT trial, channel, avg(x) AS b FROM signals WHERE t >= -3 AND t < 0 GROUP BY ALL), m AS (SELECT subject, pain, channel, t, avg(x - b) AS m FROM signals JOIN b USING (trial, channel) GROUP BY ALL),
  g AS (SELECT pain, channel, t, avg(m) AS evoked, count(m) AS n_subjects FROM m GROUP BY ALL)""", "SELECT *, stddev_pop(evoked) OVER (PARTITION BY pain, t) AS field_power FROM g", "pain, channel, t, n_subjects", "evoked field_power"))
def _(s, d):
    return A.evoked_average(fx.signals(s, d), ["trial"])


SCORE = """sc AS (SELECT subject, run, trial, sum(w * v) AS score, count(*) AS n_cells, count(*) FILTER (v <> 0) AS n_nonzero, count(*) FILTER (bad) AS n_bad, avg(v) AS mean, stddev_pop(v) AS sd, min(v) AS min, max(v) AS max
  FROM (SELECT m.*, (trial + cell) % 97 = 5 AS bad, CASE WHEN (trial + cell) % 97 = 5 THEN 0 ELSE value END AS v, w FROM maps m JOIN weights USING (cell) WHERE w <> 0) GROUP BY ALL)"""


def _scores(s, d):
    m = fx.maps(s, d).withColumn("value", F.when((F.col("trial") + F.col("cell")) % 97 == 5, float("nan")).otherwise(F.col("value")))
    return A.signature_score(m, fx.weights(s, d), ["subject", "run", "trial"])


@query("signature_score", sql(MW + "," + SCORE, "SELECT * FROM sc", "subject, run, trial, n_cells, n_nonzero, n_bad", "score mean sd min max"))
def _(s, d):
    return _scores(s, d)


@query("trial_scores", sql(MW + "," + SCORE, """SELECT subject, run, trial, score, row_number() OVER (PARTITION BY subject ORDER BY run, trial) - 1 AS trial_idx_global, row_number() OVER (PARTITION BY subject, run ORDER BY trial) - 1 AS trial_idx_run,
  'temp' || replace(printf('%.1f', 44.3 + trial % 6), '.', 'p') AS temp_label, trial * 37 % 197 AS rating, CAST(trial * 37 % 197 > 100 AS INTEGER) AS pain_binary FROM sc""", "subject, run, trial, trial_idx_global, trial_idx_run, temp_label, rating, pain_binary", "score"))
def _(s, d):
    sc = _scores(s, d)
    from ..functions.scalars import temperature_label
    meta = fx.table(s, d, "embeddings").select(F.col("vec_id").alias("trial"), temperature_label(F.lit(44.3) + F.col("vec_id") % 6).alias("temp_label"), (F.col("vec_id") * 37 % 197).alias("rating"))
    meta = sc.select("subject", "run", "trial").join(meta, "trial")
    return A.trial_scores(sc, meta, ["subject", "run", "trial"])


@query("combine_runs_fixed", sql(MA + """, rv AS (SELECT subject, run, cell, avg(value) AS value, 0.01 + cell % 5 * 0.02 + run * 0.001 AS v FROM maps WHERE cell % 9 <> 4 GROUP BY ALL UNION ALL SELECT DISTINCT subject, run, cell, 0.0, 0.01 + cell % 5 * 0.02 + run * 0.001 FROM maps WHERE cell % 9 = 4)""",
  """SELECT subject, cell, CASE WHEN count(*) FILTER (value <> 0) = 0 THEN 0 ELSE avg(value) END AS mean, CASE WHEN count(*) FILTER (value <> 0) = 0 THEN 0 ELSE var_samp(value) / count(*) END AS variance, count(*) FILTER (value <> 0) AS n_nonzero,
  CASE WHEN count(*) FILTER (value <> 0) = 0 THEN 0 ELSE sum(value / v) / sum(1 / v) END AS wmean, CASE WHEN count(*) FILTER (value <> 0) = 0 THEN 0 ELSE 1 / sum(1 / v) END AS wvariance FROM rv GROUP BY 1, 2""", "subject, cell, n_nonzero", "mean variance wmean wvariance"))
def _(s, d):
    m = fx.maps(s, d).withColumn("value", F.when(F.col("cell") % 9 == 4, 0.0).otherwise(F.col("value")))
    r = m.groupBy("subject", "run", "cell").agg(F.avg("value").alias("value")).withColumn("v", 0.01 + F.col("cell") % 5 * 0.02 + F.col("run") * 0.001)
    a = A.combine_runs_fixed(r, ["subject", "cell"])
    b = A.combine_runs_fixed(r, ["subject", "cell"], variance="v").select("subject", "cell", F.col("mean").alias("wmean"), F.col("variance").alias("wvariance"))
    return a.join(b, ["subject", "cell"])


@query("local_variance", sql(MA, """SELECT a.trial, a.x, a.y, a.z, greatest(sum(b.value * b.value) / 27 - pow(sum(b.value) / 27, 2), 1e-6) AS variance FROM maps a JOIN maps b
  ON a.trial = b.trial AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 GROUP BY ALL""", "trial, x, y, z", "variance"))
def _(s, d):
    return A.local_variance(fx.maps(s, d), ["trial"])


@query("grid_overlap", sql(MW, """SELECT trial, count(*) FILTER (value <> 0 AND w <> 0) AS n_overlap, 0 AS n_nan, count(*) FILTER ((trial + cell) % 301 = 7) AS n_inf, (SELECT count(*) FROM weights WHERE w <> 0) AS n_weights,
  100.0 * count(*) FILTER (value <> 0 AND w <> 0) / (SELECT count(*) FROM weights WHERE w <> 0) AS overlap_pct, 100.0 * count(*) FILTER (value <> 0 AND w <> 0) / (SELECT count(*) FROM weights WHERE w <> 0) >= 90 AND count(*) FILTER ((trial + cell) % 301 = 7) = 0 AS valid
  FROM (SELECT trial, cell, CASE WHEN (trial + cell) % 301 = 7 THEN 'inf'::DOUBLE ELSE value END AS value FROM maps) JOIN weights USING (cell) GROUP BY 1""", "trial, n_overlap, n_nan, n_inf, n_weights, valid", "overlap_pct"))
def _(s, d):
    m = fx.maps(s, d).withColumn("value", F.when((F.col("trial") + F.col("cell")) % 301 == 7, float("inf")).otherwise(F.col("value")))
    return A.grid_overlap(m, fx.weights(s, d), ["trial"], minimum=90.0).withColumn("n_nan", F.col("n_nan").cast("int"))


@query("trial_variability", sql(FE, "SELECT band, avg(m) AS mean, stddev_samp(m) AS sd, count(m) AS n, CASE WHEN abs(avg(m)) > 1e-10 THEN stddev_samp(m) / abs(avg(m)) END AS cv FROM (SELECT band, trial, avg(power) AS m FROM features GROUP BY ALL) GROUP BY 1", "band, n", "mean sd cv"))
def _(s, d):
    return A.trial_variability(fx.features(s, d), ["trial"])


@query("robust_limits", sql(FE, """SELECT band, quantile_cont(power, 0.02) AS q02, quantile_cont(power, 0.98) AS q98, CASE WHEN least(greatest(abs(quantile_cont(power, 0.02)), abs(quantile_cont(power, 0.98))), 0.25) > 0
  THEN least(greatest(abs(quantile_cont(power, 0.02)), abs(quantile_cont(power, 0.98))), 0.25) ELSE 1e-6 END AS vlim FROM features GROUP BY 1""", "band", "q02 q98 vlim"))
def _(s, d):
    return A.robust_limits(fx.features(s, d), ["band"], "power")


@query("deviant_channels", sql(FE + """, a AS (SELECT subject, channel, stddev_samp(power) * CASE WHEN channel = 'c3' AND subject % 2 = 0 THEN 9 ELSE 1 END AS amplitude FROM features GROUP BY subject, channel), am AS (SELECT *, median(amplitude) OVER (PARTITION BY subject) AS md FROM a),
  z AS (SELECT *, (amplitude - md) / (1.4826 * median(abs(amplitude - md)) OVER (PARTITION BY subject)) AS z FROM am)""", "SELECT subject, channel, z, abs(z) > 5 OR (subject = 1 AND channel = 'c7') AS flagged FROM z", "subject, channel, flagged", "z"))
def _(s, d):
    a = fx.features(s, d).groupBy("subject", "channel").agg(F.stddev_samp("power").alias("amplitude"))
    a = a.withColumn("amplitude", F.col("amplitude") * F.when((F.col("channel") == "c3") & (F.col("subject") % 2 == 0), 9).otherwise(1))
    return A.deviant_channels(a, ["subject"], custom=a.where("subject = 1 and channel = 'c7'"))


@query("subject_summary_means", sql(T + """, m AS (SELECT subject, avg(score) AS score, avg(rating) FILTER (k > 95) AS high, max(rating) AS top FROM trials GROUP BY 1), u AS (SELECT unnest(['score', 'high', 'top']) AS metric, unnest([score, high, top]) AS x FROM m)""",
  "SELECT metric, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd, printf('%.3f +- %.3f (n=%d)', avg(x), stddev_samp(x), count(x)) AS text FROM u GROUP BY 1", "metric, n, text", "mean sd"))
def _(s, d):
    m = fx.trials(s, d).groupBy("subject").agg(F.avg("score").alias("score"), F.avg(F.when(F.col("k") > 95, F.col("rating"))).alias("high"), F.max("rating").alias("top"))
    return A.subject_summary_means(m, ["score", "high", "top"])


@query("monotone_trend_check", sql(T + f", rk AS (SELECT subject, {sql_midrank('subject', 'level')} AS a, {sql_midrank('subject', 'score')} AS b FROM trials), rr AS (SELECT subject, {sql_n('a', 'b')} AS n, {sql_r('a', 'b', 10)} AS rho FROM rk GROUP BY 1)",
                                   f"SELECT subject, n, rho, {sql_r_p('rho', 'n')} AS p, rho > 0 AS increasing FROM rr", "subject, n, increasing", "rho p"))
def _(s, d):
    return A.monotone_trend_check(fx.trials(s, d), ["subject"], "level", "score", 10)


@query("alpha_peak_cog", sql(FE + """, sp AS (SELECT subject, freq, avg(power + 1) AS p FROM features WHERE freq BETWEEN 3 AND 11 GROUP BY ALL), n AS (SELECT *, p > lag(p) OVER w AND p > lead(p) OVER w AS pk FROM sp WINDOW w AS (PARTITION BY subject ORDER BY freq))""",
  """SELECT subject, coalesce(arg_max(freq, p) FILTER (pk), arg_max(freq, p)) AS peak_freq, count(*) FILTER (pk) > 0 AS has_peak, sum(p * freq) / sum(p) AS cog, sum(p) AS band_power FROM n GROUP BY 1""", "subject, peak_freq, has_peak", "cog band_power"))
def _(s, d):
    return A.alpha_peak_cog(fx.features(s, d).withColumn("power", F.col("power") + 1), ["subject"], 3, 11)


@query("spectrum_by_projection", sql(SI, """SELECT trial, channel, f AS freq, (pow(sum(x * cos(2 * pi() * f * t)), 2) + pow(sum(x * sin(2 * pi() * f * t)), 2)) / pow(count(x), 2) AS power
  FROM signals, (VALUES (0.125::DOUBLE), (0.25), (0.5), (0.75)) v(f) GROUP BY ALL""", "trial, channel, freq", "power"))
def _(s, d):
    return A.spectrum_by_projection(fx.signals(s, d), ["trial", "channel"], [0.125, 0.25, 0.5, 0.75])


@query("baseline_stability", sql(SP + """, b AS (SELECT * FROM spectra WHERE t BETWEEN -3 AND -0.5), sd AS (SELECT subject, trial, channel, freq, stddev_pop(power) AS sd, count(*) AS n FROM b GROUP BY ALL), tm AS (SELECT subject, trial, avg(power) AS m FROM b GROUP BY ALL),
  md AS (SELECT *, median(m) OVER (PARTITION BY subject) AS md FROM tm), o AS (SELECT subject, any_value(md) AS median_trial, median(abs(m - md)) AS mad FROM md GROUP BY 1)""",
  """SELECT subject, (SELECT max(n) FROM sd WHERE sd.subject = o.subject) AS n_samples, (SELECT median(sd) FROM sd WHERE sd.subject = o.subject) AS median_sd, median_trial, mad, 1.4826 * mad / greatest(abs(median_trial), 1e-12) AS robust_cv FROM o""", "subject, n_samples", "median_sd median_trial mad robust_cv"))
def _(s, d):
    return A.baseline_stability(fx.spectra(s, d), ["subject"], ["trial"], ["channel", "freq"], (-3.0, -0.5))


@query("power_time_course", sql(SP, "SELECT freq AS band, t, avg(power) AS mean, avg(power) FILTER (pain = 1) AS pain, avg(power) FILTER (pain = 0) AS nonpain, avg(power) FILTER (pain = 1) - avg(power) FILTER (pain = 0) AS diff FROM spectra GROUP BY ALL", "band, t", "mean pain nonpain diff"))
def _(s, d):
    return A.power_time_course(fx.spectra(s, d).withColumnRenamed("freq", "band"))


@query("model_diag_summary", sql(T + ", r AS (SELECT subject, run, count(*) - 2 AS dof, avg(k) / 100 AS r2 FROM trials GROUP BY 1, 2)", "SELECT subject, avg(dof) AS mean_dof, min(dof) AS min_dof, avg(r2) AS mean_r2, count(*) AS n_runs FROM r GROUP BY 1", "subject, min_dof, n_runs", "mean_dof mean_r2"))
def _(s, d):
    return A.model_diag_summary(fx.trials(s, d).groupBy("subject", "run").agg((F.count("k") - 2).alias("dof"), (F.avg("k") / 100).alias("r2")))
