"""Alignment joins on the driver's tables."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import align as A
from .registry import query, sql

T = fx.SQL_TRIALS
TD = T + "," + fx.SQL_DROPS
FE = fx.SQL_FEATURES


@query("align_by_selection", sql(T, """SELECT subject, run, trial_idx AS idx, sel.epoch, score FROM (SELECT subject, trial_idx AS idx, row_number() OVER (PARTITION BY subject ORDER BY trial_idx) - 1 AS epoch
  FROM trials WHERE k % 4 <> 0) sel JOIN trials t USING (subject) WHERE t.trial_idx = sel.idx AND subject % 10 <> 3""", "subject, run, idx, epoch", "score"))
def _(s, d):
    tr = fx.trials(s, d)
    ev = tr.select("subject", F.col("trial_idx").alias("idx"), "run", "score")
    sel = A.with_index(tr.where("k % 4 <> 0"), ["subject"], ["trial_idx"], "epoch")
    # Every tenth subject's selection points behind its table, so it is not valid.
    sel = sel.select("subject", "epoch", (F.col("trial_idx") + F.when(F.col("subject") % 10 == 3, 100000).otherwise(0)).alias("idx"))
    return A.align_by_selection(ev, sel, ["subject"])


@query("align_by_sample", sql(T, """SELECT subject, count(*) AS n, count(*) FILTER (k % 9 = 0) AS n_missing, count(*) FILTER (k % 9 = 0) <= 0.1 * count(*) AS valid, sum(CASE WHEN k % 9 <> 0 THEN score END) AS total
  FROM trials GROUP BY 1""", "subject, n, n_missing, valid", "total"))
def _(s, d):
    smp = F.bround(F.col("onset") * 500).cast("long").alias("sample")
    tr = fx.trials(s, d)
    ep = tr.select("subject", "event_id", smp)
    ev = tr.where("k % 9 <> 0").select("subject", smp, "score", "rating").groupBy("subject", "sample").agg(F.max("score").alias("score"), F.max("rating").alias("rating"))
    al = A.align_by_sample(ep, ev, ["subject"], strict=False)
    rep = A.alignment_report(al, ["subject"], ["score", "rating"])
    return rep.join(al.groupBy("subject").agg(F.sum("score").alias("total")), "subject")


@query("zip_behavior_to_events", sql(T, """SELECT e.subject, e.event_id, CASE WHEN e.trial_type IN ('view', 'click') THEN b.score ELSE e.rating END AS rating, e.trial_type IN ('view', 'click') AS on_target
  FROM (SELECT *, row_number() OVER (PARTITION BY subject, trial_type IN ('view', 'click') ORDER BY trial_idx) AS j FROM trials) e
  JOIN (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY trial_idx) AS j FROM trials) b ON b.subject = e.subject AND b.j = e.j""", "subject, event_id, on_target", "rating"))
def _(s, d):
    tr = fx.trials(s, d)
    ev = tr.select("subject", "trial_idx", "event_id", "trial_type", "rating")
    beh = tr.select("subject", "trial_idx", F.col("score").alias("rating"))
    z = A.zip_behavior_to_events(ev, beh, ["subject"], ["trial_idx"], ["trial_idx"], ["rating"], F.col("trial_type").isin("view", "click"))
    return z.select("subject", "event_id", "rating", "on_target")


@query("drop_rejected_trials", sql(TD, """SELECT subject, run, trial_idx, event_id FROM trials t WHERE NOT EXISTS (SELECT 1 FROM drops d WHERE d.subject = t.subject AND d.trial_idx = t.trial_idx)""",
                                   "subject, run, trial_idx, event_id"))
def _(s, d):
    tr = fx.trials(s, d).select("subject", "run", "trial_idx", "event_id", "trial_type")
    log = fx.drop_log(tr)
    # Odd subjects' logs carry no run, so that only the original index can match.
    log = log.select("subject", F.when(F.col("subject") % 2 == 0, F.col("run")).alias("run"), "trial_idx", F.col("trial_idx").alias("original_index"))
    return A.drop_rejected_trials(tr, log, fallback=(["subject"], "trial_idx", "original_index")).select("subject", "run", "trial_idx", "event_id")


@query("build_drop_log", sql(T, """SELECT subject, trial_idx, CASE WHEN k > 80 AND rating > 60 THEN 'amplitude;muscle' WHEN k > 80 THEN 'muscle' WHEN rating > 60 THEN 'amplitude' ELSE '' END AS drop_reason
  FROM trials WHERE k > 70 OR rating > 60""", "subject, trial_idx, drop_reason"))
def _(s, d):
    tr = fx.trials(s, d).select("subject", "trial_idx", "k", "rating")
    why = tr.where("k > 80").select("subject", "trial_idx", F.lit("muscle").alias("reason")).unionAll(
        tr.where("rating > 60").select("subject", "trial_idx", F.lit("amplitude")))
    return A.build_drop_log(tr.select("subject", "trial_idx"), tr.where("k <= 70 AND rating <= 60"), why, ["subject", "trial_idx"])


@query("kept_semi", sql(TD, "SELECT subject, trial_idx, score FROM trials t WHERE EXISTS (SELECT 1 FROM drops d WHERE d.subject = t.subject AND d.trial_idx = t.trial_idx)", "subject, trial_idx", "score"))
def _(s, d):
    tr = fx.trials(s, d)
    return A.kept_semi(tr.select("subject", "trial_idx", "score"), fx.drop_log(tr), ["subject", "trial_idx"])


@query("subsequence_align", sql(T + """, seq AS (SELECT subject, list(rating ORDER BY trial_idx) AS ev, list(rating ORDER BY trial_idx) FILTER (k % 10 <> 0) AS rt FROM trials GROUP BY 1),
  walk AS (SELECT subject, ev, rt, 0 AS i, 0 AS j, NULL::BOOLEAN AS matched FROM seq UNION ALL
  SELECT subject, ev, rt, i + 1, j + CASE WHEN hit THEN 1 ELSE 0 END, hit FROM (SELECT *, j < len(rt) AND abs(ev[i + 1] - rt[j + 1]) <= greatest(1e-5 * greatest(abs(ev[i + 1]), abs(rt[j + 1])), 1e-4) AS hit FROM walk WHERE i < len(ev)))""",
  "SELECT subject, i - 1 AS k, ev[i] AS ev, matched, CASE WHEN matched THEN j - 1 END AS rating_k FROM walk WHERE i > 0", "subject, k, matched, rating_k", "ev"))
def _(s, d):
    tr = fx.trials(s, d)
    ev = tr.select("subject", F.col("trial_idx").alias("k"), F.col("rating").alias("value"))
    kept = tr.where("k % 10 <> 0").select("subject", "trial_idx", F.col("rating").alias("value"))
    rt = A.with_index(kept, ["subject"], ["trial_idx"], "k")
    return A.subsequence_align(ev, rt, "subject")


@query("merge_predictions", sql(fx.SQL_PREDICTIONS, "SELECT subject, trial, y_true, y_pred AS y_model, CASE WHEN trial % 5 <> 0 THEN y_true * 0.5 END AS y_baseline FROM predictions",
                                "subject, trial", "y_true y_model y_baseline"))
def _(s, d):
    p = fx.predictions(s, d)
    b = p.where("trial % 5 <> 0").select("subject", "trial", (F.col("y_true") * 0.5).alias("y_pred"))
    return A.merge_predictions(p, b)


@query("assemble_cross_modal", sql(FE + "," + T + """, ft AS (SELECT subject, dense_rank() OVER (PARTITION BY subject ORDER BY trial) - 1 AS k, band, power FROM features),
  wide AS (SELECT subject, k, avg(power) FILTER (band = 'b0') AS mean_b0, stddev_samp(power) FILTER (band = 'b0') AS sd_b0, avg(power) FILTER (band = 'b4') AS mean_b4, stddev_samp(power) FILTER (band = 'b4') AS sd_b4 FROM ft GROUP BY ALL)""",
  """SELECT w.subject, w.k, mean_b0, sd_b0, mean_b4, sd_b4, temp, rating, score, (SELECT count(*) FROM wide x WHERE x.subject = w.subject) = (SELECT count(*) FROM trials x WHERE x.subject = w.subject) AS counts_equal
  FROM wide w JOIN trials t ON t.subject = w.subject AND t.trial_idx = w.k""", "subject, k, counts_equal", "mean_b0 sd_b0 mean_b4 sd_b4 temp rating score"))
def _(s, d):
    f = fx.features(s, d)
    ks = A.with_index(f.select("subject", "trial").distinct(), ["subject"], ["trial"], "k")
    f = f.join(ks, ["subject", "trial"])
    tr = fx.trials(s, d).drop("k").withColumnRenamed("trial_idx", "k")
    return A.assemble_cross_modal(f, tr.select("subject", "k", "temp", "rating"), tr.select("subject", "k", "score"), bands=("b0", "b4"), strict=False)


@query("subjects_with_both", sql("", "SELECT user_id AS subject FROM events INTERSECT SELECT label FROM embeddings", "subject::BIGINT AS subject"))
def _(s, d):
    return A.subjects_with_both(fx.table(s, d, "events").select(F.col("user_id").alias("subject")), fx.table(s, d, "embeddings").select(F.col("label").cast("long").alias("subject")))


@query("events_by_volume", sql(T + """, tt AS (SELECT subject, trial_type, onset / 20000 AS onset, duration FROM trials),
  rn AS (SELECT subject, floor(max(onset + duration) / 0.9)::BIGINT + 1 AS n FROM tt GROUP BY 1),
  heat AS (SELECT DISTINCT subject, v AS volume FROM (SELECT subject, unnest(range(greatest(floor(onset / 0.9)::BIGINT, 0), least(floor((onset + duration) / 0.9)::BIGINT, n))) AS v FROM tt JOIN rn USING (subject) WHERE trial_type IN ('view', 'click'))),
  outl AS (SELECT DISTINCT subject, floor(onset / 0.9)::BIGINT AS volume FROM tt WHERE trial_type = 'error')""",
  """SELECT subject, count(h.volume) AS n_heat, count(o.volume) AS n_outlier, count(CASE WHEN h.volume = o.volume THEN 1 END) AS n_both,
  coalesce(count(CASE WHEN h.volume = o.volume THEN 1 END) / nullif(count(o.volume), 0), 0) AS fraction FROM heat h FULL JOIN outl o USING (subject, volume) GROUP BY 1""",
  "subject, n_heat, n_outlier, n_both", "fraction"))
def _(s, d):
    tr = fx.trials(s, d).withColumn("onset", F.col("onset") / 20000)
    out = tr.where("trial_type = 'error'").select("subject", F.floor(F.col("onset") / 0.9).alias("volume"))
    return A.events_by_volume(tr.where("trial_type in ('view', 'click')"), out, ["subject"], 0.9, A.run_lengths(tr, ["subject"], 0.9))


@query("attach_covariates", sql(T, """SELECT subject, trial_idx AS k, CASE WHEN k % 3 <> 0 THEN temp END AS temp, trial_idx + 1 AS trial,
  CASE WHEN k % 3 <> 0 THEN run::BIGINT ELSE dense_rank() OVER (ORDER BY subject) - 1 END AS block FROM trials""", "subject, k, trial, block", "temp"))
def _(s, d):
    tr = fx.trials(s, d)
    cov = tr.where("k % 3 <> 0").select("subject", F.col("trial_idx").alias("k"), "temp", (F.col("trial_idx") + 1).alias("trial"), F.col("run").alias("block"))
    return A.attach_covariates(tr.select("subject", F.col("trial_idx").alias("k")), cov)
