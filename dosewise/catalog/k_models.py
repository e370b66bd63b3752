"""Cross-validated models on the driver's tables."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.draws import sql_hash
from ..functions.shuffles import sql_shuffle
from ..operators import models as M
from ..operators.columns import clean_number
from ..operators.stats import regression_metrics
from .h_stats import metric_cols
from .registry import query, sql

T = fx.SQL_TRIALS
N_FOLDS, PERM = 10, 1000
# The search grid of the nested model.
GRID = {"alphas": [0.001, 0.01, 0.1, 1.0, 10.0], "l1_ratios": [0.1, 0.3, 0.5, 0.7, 0.9]}


def epochs(s, d):
    """The whole vector of a trial (one feature with missing values), a target that depends on two of its elements, fold = subject."""
    e = fx.table(s, d, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    x = F.transform(x, lambda v, i: F.when((i != 2) | (F.col("vec_id") % 7 != 0), v))
    noise = (F.col("vec_id") * 37 % 97) / 97
    y = 10 * F.col("embedding")[0].cast("double") + 5 * F.col("embedding")[1].cast("double") + noise
    return e.select(F.col("label").alias("subject"), (F.col("vec_id") % 6).cast("int").alias("run"), F.col("vec_id").alias("trial"), F.col("label").cast("int").alias("fold"), x.alias("x"), y.alias("y_true"))


def names(df):
    """A name for every element of the longest vector."""
    return [f"c{i}" for i in range(df.select(F.max(F.size("x"))).first()[0] or 0)]


def medians(df, n_folds=N_FOLDS):
    """Training medians of every feature position, for the folds left out."""
    places = [str(i) for i in range(len(names(df)))]
    wide = df.select("fold", *[F.get("x", F.lit(int(i))).alias(i) for i in places])
    m = M.training_medians(wide, "fold", places, n_folds)
    return m.withColumn("feature", F.col("feature").cast("int"))


def fits(s, d):
    df = epochs(s, d)
    return df, M.elasticnet_nested(df, "x", "y_true", n_folds=N_FOLDS, medians=medians(df), inner="run", **GRID)


GREEDY = """, sz AS (SELECT subject, count(*) AS sz FROM trials GROUP BY 1), od AS (SELECT subject, sz, row_number() OVER (ORDER BY sz DESC, subject) AS i FROM sz),
  wk AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS subject, [0, 0, 0, 0, 0]::BIGINT[] AS loads, 0 AS fold UNION ALL SELECT od.i, od.subject, list_transform(loads, lambda v, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN v + sz ELSE v END), list_position(loads, list_min(loads)) - 1 FROM wk JOIN od ON od.i = wk.i + 1),
  st AS (SELECT subject, trial_idx, bin, row_number() OVER (PARTITION BY bin ORDER BY """ + sql_hash(42, "0", "pos") + """, pos) - 1 AS k FROM (SELECT subject, trial_idx, row_number() OVER (ORDER BY subject, trial_idx) - 1 AS pos, (SELECT count(*) FROM (SELECT unnest(quantile_cont(score, [.2, .4, .6, .8])) AS e FROM trials) WHERE e < t.score) AS bin FROM trials t))"""


@query("assign_folds", sql(T + GREEDY, "SELECT t.subject, t.trial_idx, dense_rank() OVER (ORDER BY t.subject) - 1 AS logo, wk.fold AS balanced, st.k % 5 AS stratified FROM trials t JOIN wk USING (subject) JOIN st ON st.subject = t.subject AND st.trial_idx = t.trial_idx",
                           "subject, trial_idx, logo::INTEGER AS logo, balanced::INTEGER AS balanced, stratified::INTEGER AS stratified"))
def _(s, d):
    tr = fx.trials(s, d).select("subject", "trial_idx", "score")
    a = M.assign_folds(tr, "subject").withColumnRenamed("fold", "logo")
    b = M.assign_folds(a, "subject", "group").withColumnRenamed("fold", "balanced")
    return M.assign_folds(b, "subject", "stratified", y="score", order=["subject", "trial_idx"]).select("subject", "trial_idx", "logo", "balanced", F.col("fold").alias("stratified"))


@query("baseline_mean_loso", sql(T, "SELECT subject, trial_idx, (sum(score) OVER () - sum(score) OVER (PARTITION BY subject)) / (count(*) OVER () - count(*) OVER (PARTITION BY subject)) AS y_pred FROM trials", "subject, trial_idx", "y_pred"))
def _(s, d):
    return M.baseline_mean_loso(fx.trials(s, d), "subject", "score").select("subject", "trial_idx", "y_pred")


LOGO = T + """, tx AS (SELECT subject, trial_idx, run % 5 AS fold, CASE WHEN k % 10 <> 0 THEN temp END AS x, score AS y_true FROM trials), f AS (SELECT DISTINCT fold FROM tx),
  md AS (SELECT f.fold, median(x) AS m FROM f JOIN tx ON tx.fold <> f.fold GROUP BY 1), ln AS (SELECT f.fold, any_value(m) AS m, regr_slope(y_true, coalesce(x, m)) AS b, regr_intercept(y_true, coalesce(x, m)) AS a FROM f JOIN md USING (fold) JOIN tx ON tx.fold <> f.fold GROUP BY 1),
  pd AS (SELECT tx.*, a + b * coalesce(x, m) AS y_pred FROM tx JOIN ln USING (fold))"""


@query("baseline_linear_logo", sql(LOGO + f", m AS (SELECT fold, {metric_cols('y_true', 'y_pred')} FROM pd GROUP BY 1)", "SELECT * FROM m", "fold, n", "r2 mae rmse pearson_r"))
def _(s, d):
    tr = fx.trials(s, d).select("subject", "trial_idx", (F.col("run") % 5).alias("fold"), F.when(F.col("k") % 10 != 0, F.col("temp")).alias("x"), F.col("score").alias("y_true"))
    m = M.training_medians(tr, "fold", ["x"], 5).select("held_out", "median")
    pred = M.baseline_linear_logo(tr, "fold", "x", "y_true", m)
    return regression_metrics(pred, ["fold"]).select("fold", "n", "r2", "mae", "rmse", "pearson_r")


@query("elasticnet_nested")
def _(s, d):
    df, f = fits(s, d)
    pred = M.predict_linear(df, f, "x")
    return regression_metrics(pred, ["fold"]).join(f.select("fold", "alpha", "l1_ratio", "best_r2", "best_r", "params_by_r"), "fold")


@query("forest_nested")
def _(s, d):
    df = epochs(s, d).withColumn("fold", F.col("fold") % 3)
    return M.forest_nested(df, "x", "y_true", n_folds=3, trees=10).select("subject", "trial", "fold", "y_true", "y_pred", "max_depth")


@query("predict_fixed_params", sql("""e AS (SELECT label AS fold, vec_id AS trial, embedding[1]::DOUBLE AS x, 10 * embedding[1]::DOUBLE + 5 * embedding[2]::DOUBLE + (vec_id * 37 % 97) / 97 AS y FROM embeddings), f AS (SELECT DISTINCT fold FROM e),
  ln AS (SELECT f.fold, covar_pop(x, y) / var_pop(x) / (1 + CASE WHEN f.fold % 2 = 0 THEN 0.1 ELSE 0.5 END) AS b, avg(x) AS mx, avg(y) AS my FROM f JOIN e ON e.fold <> f.fold GROUP BY 1)""",
  "SELECT trial, e.fold, my + b * (x - mx) AS y_pred FROM e JOIN ln USING (fold)", "trial, fold", "y_pred"))
def _(s, d):
    df = epochs(s, d).withColumn("x", F.slice("x", 1, 1))
    params = df.select("fold").distinct().select("fold", F.when(F.col("fold") % 2 == 0, 0.1).otherwise(0.5).alias("alpha"), F.lit(0.0).alias("l1_ratio"))
    return M.predict_fixed_params(df, params, "x", "y_true", n_folds=N_FOLDS).select("trial", "fold", "y_pred")


@query("predict_fixed_params_all")
def _(s, d):
    """The same with every element of the vector; the query with SQL has one."""
    df = epochs(s, d)
    params = df.select("fold").distinct().select("fold", F.when(F.col("fold") % 2 == 0, 0.1).otherwise(0.5).alias("alpha"), F.lit(0.0).alias("l1_ratio"))
    return M.predict_fixed_params(df, params, "x", "y_true", n_folds=N_FOLDS).select("trial", "fold", "y_pred")


@query("within_subject_cv")
def _(s, d):
    return regression_metrics(M.within_subject_cv(epochs(s, d), "subject", "run", "x", "y_true", alpha=0.01), ["subject"])


@query("final_refit")
def _(s, d):
    df = epochs(s, d)
    return M.final_refit(df, "x", "y_true", n_folds=N_FOLDS, medians=medians(df))


def pooled_ctes(src, keys, by="subject"):
    """Oracle tables of group-out lines scored on sums: src has keys, the group, x and y."""
    ks = f"{keys}, " if keys else ""
    return (f"gs AS (SELECT {ks}{by}, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM {src} GROUP BY ALL),"
            f"tr AS (SELECT *, sum(n) OVER w - n AS tn, sum(sx) OVER w - sx AS tx, sum(sy) OVER w - sy AS ty, sum(sxx) OVER w - sxx AS txx, sum(sxy) OVER w - sxy AS txy FROM gs WINDOW w AS (PARTITION BY {keys})),"
            f"ln AS (SELECT *, (txy - tx * ty / tn) / (txx - tx * tx / tn) AS b FROM tr), la AS (SELECT *, ty / tn - b * tx / tn AS a FROM ln),"
            f"sc AS (SELECT {ks}sum(n) AS nn, sum(sy) AS yy, sum(syy) AS y2, sum(a * n + b * sx) AS p1, sum(a * a * n + 2 * a * b * sx + b * b * sxx) AS p2, sum(a * sy + b * sxy) AS py FROM la GROUP BY ALL),"
            f"po AS (SELECT {ks}(py - p1 * yy / nn) / sqrt((y2 - yy * yy / nn) * (p2 - p1 * p1 / nn)) AS r, 1 - (y2 - 2 * py + p2) / (y2 - yy * yy / nn) AS r2 FROM sc)")


SHUFFLED = (T + ", b0 AS (SELECT subject, temp AS x, score AS y, row_number() OVER (ORDER BY subject, trial_idx) - 1 AS pos FROM trials),"
            + sql_shuffle("mv", "b0", PERM, 42)
            + ", sx0 AS (SELECT rep, t.subject, t.x, g.y FROM mv JOIN b0 g USING (pos) JOIN b0 t ON t.pos = mv.moved UNION ALL SELECT 0, subject, x, y FROM b0),")
MODELS = (T + ", b0 AS (SELECT subject, trial_idx AS pos, temp, rating, trial_idx, score AS y FROM trials),"
          + sql_shuffle("mv", "b0", PERM, 42, ("subject",))
          + ", sh AS (SELECT rep, t.subject, t.temp, t.rating, t.trial_idx, g.y FROM mv JOIN b0 g USING (subject, pos) JOIN b0 t ON t.subject = mv.subject AND t.pos = mv.moved UNION ALL SELECT 0, subject, temp, rating, trial_idx, y FROM b0),"
          "sx0 AS (SELECT rep, subject, y, unnest(['temp', 'rating', 'trial_idx']) AS model, unnest([temp, rating, trial_idx]::DOUBLE[]) AS x FROM sh),")


@query("permutation_r2", sql(SHUFFLED + pooled_ctes("sx0", "rep"), """SELECT o.r2 AS r2_obs, count(n.r2) AS n_perm, (1 + count(*) FILTER (n.r2 >= o.r2)) / (count(n.r2) + 1) AS p, quantile_cont(n.r2, 0.05) AS null_q05, quantile_cont(n.r2, 0.5) AS null_q50, quantile_cont(n.r2, 0.95) AS null_q95, avg(n.r2) AS null_mean, stddev_pop(n.r2) AS null_sd
  FROM po n JOIN po o ON o.rep = 0 AND n.rep > 0 GROUP BY 1""", "n_perm", "r2_obs p null_q05 null_q50 null_q95 null_mean null_sd"))
def _(s, d):
    return M.permutation_r2(fx.trials(s, d), "subject", "temp", "score", ["subject", "trial_idx"], PERM)


@query("permutation_r2_nested")
def _(s, d):
    """The nested search on every shuffle of the target, over whole vectors."""
    df = epochs(s, d)
    return M.permutation_r2_nested(df, "x", "y_true", ["trial"], medians=medians(df), inner="run", n_perm=PERM, **GRID)


@query("max_stat_permutation", sql(MODELS + pooled_ctes("sx0", "rep, model") + ", mx AS (SELECT rep, max(abs(r)) AS t2, max(r) AS t1 FROM po WHERE rep > 0 GROUP BY 1)",
                                   "SELECT model, r AS r_obs, (SELECT count(*) FROM mx) AS n_perm, (SELECT (1 + count(*) FILTER (t2 >= abs(po.r))) / (count(*) + 1) FROM mx) AS p_two_sided, (SELECT (1 + count(*) FILTER (t1 >= po.r)) / (count(*) + 1) FROM mx) AS p_greater FROM po WHERE rep = 0", "model, n_perm", "r_obs p_two_sided p_greater"))
def _(s, d):
    return M.max_stat_permutation(fx.trials(s, d), "subject", ["temp", "rating", "trial_idx"], "score", ["trial_idx"], PERM)


@query("feature_importance")
def _(s, d):
    df, f = fits(s, d)
    return M.feature_importance(f, names(df))


@query("permutation_importance")
def _(s, d):
    df, f = fits(s, d)
    clean = df.withColumn("x", F.transform("x", lambda v: F.coalesce(clean_number(v), F.lit(0.0))))
    return M.permutation_importance(clean, f, "x", names(df), "y_true", ["subject", "run"])


# One slope per element and fold, from the other folds' rows; every element counts a sixteenth.
MARGINAL = """e AS (SELECT label, vec_id % 6 AS run, list_transform(embedding, lambda v, i: CASE WHEN i <> 3 OR vec_id % 7 <> 0 THEN v::DOUBLE END) AS v, 10 * embedding[1]::DOUBLE + 5 * embedding[2]::DOUBLE + (vec_id * 37 % 97) / 97 AS y, vec_id FROM embeddings),
  l AS (SELECT label, run, vec_id, y, i - 1 AS pos, v[i] AS x FROM e, range(1, 1 + (SELECT max(len(v)) FROM e)) t(i)), f AS (SELECT DISTINCT label AS fold FROM e),
  ft AS (SELECT fold, pos, regr_slope(y, x) / 16 AS b, avg(x) FILTER (y IS NOT NULL) AS mx FROM f JOIN l ON l.label <> f.fold GROUP BY 1, 2), ic AS (SELECT fold, avg(y) AS my FROM f JOIN e ON e.label <> f.fold GROUP BY 1),
  lx AS (SELECT l.*, coalesce(x, mx) AS z, b, mx FROM l JOIN ft ON ft.fold = l.label AND ft.pos = l.pos), pd AS (SELECT label, vec_id, any_value(my) + sum(b * (z - mx)) AS p FROM lx JOIN ic ON ic.fold = label GROUP BY 1, 2),
  a AS (SELECT lx.label, run, pos, y, z, z * z AS zz, b, p, (y - p + b * z) * b AS aa, b * b AS bb, p - b * z AS u FROM lx JOIN pd USING (label, vec_id)),
  w AS (SELECT avg(y) AS my, var_pop(y) AS vy, corr(y, p) AS r0 FROM a WHERE pos = 0),
  bl AS (SELECT pos, label, run, count(*) AS n, avg(aa) * avg(z) AS az, avg(aa * z) AS az0, avg(bb) * avg(zz) AS bz, avg(bb * zz) AS bz0, avg(u + b * avg_z) AS s, avg((u + b * avg_z) * y) AS sy, avg(u * u + 2 * u * b * avg_z + bb * avg_zz) AS ss,
    sum(4 * aa * aa) - 4 * n0 * avg(aa) ^ 2 AS c11, sum(-2 * aa * bb) + 2 * n0 * avg(aa) * avg(bb) AS c12, sum(bb * bb) - n0 * avg(bb) ^ 2 AS c22, sum(zz) - n0 * avg(z) ^ 2 AS d11, sum(z * zz) - n0 * avg(z) * avg(zz) AS d12, sum(zz * zz) - n0 * avg(zz) ^ 2 AS d22
    FROM (SELECT *, avg(z) OVER g AS avg_z, avg(zz) OVER g AS avg_zz, count(*) OVER g AS n0 FROM a WINDOW g AS (PARTITION BY pos, label, run)) GROUP BY pos, label, run, n0)"""


@query("permutation_importance_marginal", sql(MARGINAL, """SELECT 'c' || pos AS feature, sum(n * (-2 * (az - az0) + (bz - bz0))) / sum(n) / any_value(vy) AS importance, sqrt(sum(CASE WHEN n > 1 THEN (c11 * d11 + 2 * c12 * d12 + c22 * d22) / (n - 1) END)) / sum(n) / any_value(vy) AS sd,
  any_value(r0) - (sum(n * sy) / sum(n) - sum(n * s) / sum(n) * any_value(my)) / sqrt((sum(n * ss) / sum(n) - (sum(n * s) / sum(n)) ^ 2) * any_value(vy)) AS importance_r FROM bl, w GROUP BY pos""", "feature", "importance importance_r sd"))
def _(s, d):
    """The same for a model that SQL can fit: one slope per element, from the rows of the other folds."""
    df = epochs(s, d)
    long = df.select("fold", F.col("y_true").alias("y"), F.posexplode("x").alias("pos", "x"))
    here = long.groupBy("fold", "pos").agg(F.count("x").alias("n"), F.sum("x").alias("sx"), F.sum(F.when(F.col("x").isNotNull(), F.col("y"))).alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    here = here.join(df.groupBy("fold").agg(F.sum("y_true").alias("ty"), F.count("y_true").alias("tn")), "fold")
    columns = ("n", "sx", "sy", "sxy", "sxx", "ty", "tn")
    every = here.groupBy("pos").agg(*[F.sum(c).alias(f"all_{c}") for c in columns])
    sums = here.join(every, "pos").select(F.col("fold").alias("held"), "pos", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in columns])
    b = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) / 16
    lines = sums.select("held", "pos", b.alias("b"), (F.col("sx") / F.col("n")).alias("m"), (F.col("ty") / F.col("tn")).alias("my"))
    f = lines.groupBy(F.col("held").alias("fold")).agg(F.array_sort(F.collect_list(F.struct("pos", "b", "m"))).alias("l"), F.max("my").alias("my"))
    f = f.select("fold", F.col("l.b").alias("coef"), F.col("l.m").alias("median"), (F.col("my") - F.aggregate("l", F.lit(0.0), lambda t, v: t + v["b"] * v["m"])).alias("intercept"))
    return M.permutation_importance(df, f, "x", names(df), "y_true", ["subject", "run"])


@query("prediction_frame", sql(LOGO, "SELECT t.subject, t.trial_idx, t.temp, t.pain, y_true, y_pred, fold, 'line' AS model FROM pd JOIN trials t USING (subject, trial_idx)", "subject, trial_idx, pain, fold, model", "temp y_true y_pred"))
def _(s, d):
    tr = fx.trials(s, d)
    rows = tr.select("subject", "trial_idx", (F.col("run") % 5).alias("fold"), F.when(F.col("k") % 10 != 0, F.col("temp")).alias("x"), F.col("score").alias("y_true"))
    pred = M.baseline_linear_logo(rows, "fold", "x", "y_true", M.training_medians(rows, "fold", ["x"], 5).select("held_out", "median"))
    return M.prediction_frame(tr.select("subject", "trial_idx", "temp", "pain"), pred, ["subject", "trial_idx"], "line")


@query("learning_curve", sql(T + f""", dr AS (SELECT *, count(*) OVER (PARTITION BY subject) AS cnt, row_number() OVER (PARTITION BY subject ORDER BY {sql_hash(42, '1', 'trial_idx')}, trial_idx) - 1 AS o FROM trials),
  kp AS (SELECT share, subject, count(*) AS n, sum(temp) AS sx, sum(score) AS sy, sum(temp * temp) AS sxx, sum(temp * score) AS sxy FROM dr, (VALUES (0.1::DOUBLE), (0.2), (0.4), (0.6), (0.8), (1.0)) v(share) WHERE o < greatest(1, ceil(round(cnt * share, 9))) GROUP BY 1, 2),
  tr AS (SELECT share, subject, n, sum(n) OVER w - n AS tn, sum(sx) OVER w - sx AS tx, sum(sy) OVER w - sy AS ty, sum(sxx) OVER w - sxx AS txx, sum(sxy) OVER w - sxy AS txy FROM kp WINDOW w AS (PARTITION BY share)),
  ln AS (SELECT share, subject, n, (txy - tx * ty / tn) / (txx - tx * tx / tn) AS b, ty / tn - (txy - tx * ty / tn) / (txx - tx * tx / tn) * tx / tn AS a FROM tr), pd AS (SELECT share, score AS y, a + b * temp AS p FROM ln JOIN trials USING (subject))""",
  "SELECT share, count(*) AS n, corr(y, p) AS r, 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS r2, (SELECT sum(n) FROM ln WHERE ln.share = pd.share)::BIGINT AS n_train FROM pd GROUP BY 1", "share, n, n_train", "r r2"))
def _(s, d):
    return M.learning_curve(fx.trials(s, d), "subject", "temp", "score", ["trial_idx"])


@query("temporal_generalization")
def _(s, d):
    """Four channels at sixteen times per trial; ridge scores by r."""
    sg = fx.signals(s, d).groupBy("subject", "trial", "ti", "rating", "pain").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "x"))), lambda c: c["x"]).alias("x"))
    sg = sg.withColumn("fold", F.col("subject").cast("int"))
    return M.temporal_generalization(sg, "fold", "ti", "x", "rating")


@query("temporal_generalization_auc")
def _(s, d):
    sg = fx.signals(s, d).groupBy("subject", "trial", "ti", "rating", "pain").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "x"))), lambda c: c["x"]).alias("x"))
    sg = sg.withColumn("fold", F.col("subject").cast("int"))
    return M.temporal_generalization_auc(sg, "fold", "ti", "x", "pain")


@query("subject_identifiability")
def _(s, d):
    e = epochs(s, d).withColumn("x", F.transform("x", lambda v: F.coalesce(v, F.lit(0.0))))
    e = M.with_index(e, ["subject"], ["trial"], "k").withColumn("fold", (F.col("k") % 3).cast("int"))
    return M.subject_identifiability(e, "subject", "x").withColumn("confusion", F.to_json("confusion"))
