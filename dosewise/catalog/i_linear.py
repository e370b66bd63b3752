"""Linear model and connectivity on the driver's tables."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import linear as L
from ..operators.align import run_lengths
from .registry import query, sql

T, CE, SI = fx.SQL_TRIALS, fx.SQL_CELLS, fx.SQL_SIGNALS


def _g(x, shape):
    """Gamma integral as SQL."""
    return f"(1 - exp(-({x})) * ({' + '.join(f'pow({x}, {k}) / gamma({k + 1}.0)' for k in range(shape))}))"


def _hrf(x):
    x = f"greatest(0.0, least({x}, 32.0))"
    return f"(({_g(x, 6)} - {_g(x, 16)} / 6) / (5.0 / 6))"


def conv(src, keys, name):
    return (f"SELECT {keys}, volume, {name}, sum({_hrf('(volume * 0.9::DOUBLE - onset)')} - {_hrf('(volume * 0.9::DOUBLE - onset - duration)')}) AS value FROM {src} JOIN rn USING (subject), unnest(range(0, n)) v(volume) "
            f"WHERE volume * 0.9::DOUBLE >= onset AND volume * 0.9::DOUBLE <= onset + duration + 32 GROUP BY ALL")


SHORT = T + ", tt AS (SELECT subject, run, trial_idx, trial_type, onset / 20000 AS onset, duration FROM trials), rn AS (SELECT subject, floor((max(onset + duration) + 32) / 0.9::DOUBLE)::BIGINT + 1 AS n FROM tt GROUP BY 1)"


def short_trials(s, d):
    return fx.trials(s, d).select("subject", "run", "trial_idx", "trial_type", (F.col("onset") / 20000).alias("onset"), "duration")


@query("design_matrix", sql(SHORT, conv("tt", "subject", "trial_type"), "subject, volume, trial_type", "value"))
def _(s, d):
    tr = short_trials(s, d)
    return L.design_matrix(tr, ["subject"], 0.9, run_lengths(tr, ["subject"], 0.9, L.HRF_LENGTH))


@query("trial_design", sql(SHORT + ", rg AS (SELECT subject, onset, duration, CASE WHEN trial_type IN ('view', 'click') THEN 'trial_' || lpad((row_number() OVER (PARTITION BY subject, trial_type IN ('view', 'click') ORDER BY run, trial_idx) - 1)::VARCHAR, 3, '0') ELSE trial_type END AS regressor FROM tt)",
                           conv("rg", "subject", "regressor"), "subject, volume, regressor", "value"))
def _(s, d):
    tr = short_trials(s, d)
    return L.trial_design(tr, ["subject"], "subject", "run", F.col("trial_type").isin("view", "click"), ["trial_idx"], 0.9, run_lengths(tr, ["subject"], 0.9, L.HRF_LENGTH))


def bold(s, d):
    """Volumes = trials of a subject, cells = vector elements; two regressors from the trial number."""
    c = fx.cells(s, d).select("subject", F.col("trial").alias("volume"), "cell", F.col("v").alias("value"))
    design = fx.table(s, d, "embeddings").select(F.col("label").alias("subject"), F.col("vec_id").alias("volume"), (F.col("vec_id") * 37 % 97 / 97).alias("heat"), (F.col("vec_id") * 11 % 23 / 23).alias("rate"))
    return c, design


@query("glm_fit")
def _(s, d):
    c, design = bold(s, d)
    return L.glm_fit(L.with_drift(design, ["subject"], 2), c, ["subject"], ["cell"], ["heat", "rate", "intercept", "drift1", "drift2"])


@query("regressor_snr", sql(CE + """, ds AS (SELECT subject, trial, cell, v, trial * 37 % 97 / 97 AS heat, trial * 11 % 23 / 23 AS rate FROM cells),
  r AS (SELECT subject, cell, corr(heat, v) AS rh, corr(rate, v) AS rr FROM ds GROUP BY 1, 2), u AS (SELECT DISTINCT subject, trial, heat, rate FROM ds), x AS (SELECT subject, stddev_samp(heat) AS sh, max(heat) - min(heat) AS nh, stddev_samp(rate) AS sr, max(rate) - min(rate) AS nr FROM u GROUP BY 1)""",
  """SELECT subject, 'heat' AS regressor, avg(abs(rh)) AS mean_abs_r, count(rh) AS n_cells, any_value(sh) AS sd, any_value(nh) AS "range" FROM r JOIN x USING (subject) GROUP BY 1 UNION ALL SELECT subject, 'rate', avg(abs(rr)), count(rr), any_value(sr), any_value(nr) FROM r JOIN x USING (subject) GROUP BY 1""",
  "subject, regressor, n_cells", 'mean_abs_r sd "range"'))
def _(s, d):
    c, design = bold(s, d)
    return L.regressor_snr(design, c, ["subject"], ["cell"], ["heat", "rate"])


@query("envelope_connectivity", sql(SI, "SELECT a.trial, a.channel AS node_a, b.channel AS node_b, corr(a.x, b.x) AS value FROM signals a JOIN signals b ON a.trial = b.trial AND a.ti = b.ti AND a.channel > b.channel GROUP BY 1, 2, 3", "trial, node_a, node_b", "value"))
def _(s, d):
    return L.envelope_connectivity(fx.signals(s, d), ["trial"], t="ti")


COV = """c0 AS (SELECT a.subject, a.trial, a.channel AS a, b.channel AS b, covar_pop(a.x, b.x) AS c, count(*) AS n FROM signals a JOIN signals b ON a.trial = b.trial AND a.ti = b.ti AND a.channel <= b.channel GROUP BY 1, 2, 3, 4),
  w AS (SELECT trial, any_value(n) AS n, count(*) FILTER (a = b) AS p, sum(c) FILTER (a = b) AS tr, sum(c * c * CASE WHEN a = b THEN 1 ELSE 2 END) AS tr2 FROM c0 GROUP BY 1),
  w2 AS (SELECT trial, tr / p AS mu, least(1, (tr2 / (p * p) + pow(tr / p, 2)) / ((n + 1) * (tr2 / (p * p) - pow(tr / p, 2) / p))) AS rho FROM w),
  cv AS (SELECT subject, trial, a, b, (1 - rho) * c + CASE WHEN a = b THEN rho * mu ELSE 0 END AS cov, rho AS shrinkage FROM c0 JOIN w2 USING (trial))"""


@query("trial_covariance", sql(SI + "," + COV, "SELECT * FROM cv", "trial, a, b", "cov shrinkage"))
def _(s, d):
    return L.trial_covariance(fx.signals(s, d), ["trial"], t="ti")


@query("covariance_bin_contrast", sql(SI + "," + COV + """, one AS (SELECT DISTINCT subject, trial, rating FROM signals), qs AS (SELECT subject, quantile_cont(rating, 0.333) AS lo, quantile_cont(rating, 0.667) AS hi FROM one GROUP BY 1),
  bn AS (SELECT subject, trial, CASE WHEN rating <= lo THEN 'low' WHEN rating >= hi THEN 'high' END AS bin FROM one JOIN qs USING (subject)), sc AS (SELECT subject, bin, a, b, avg(cov) AS c FROM cv JOIN bn USING (subject, trial) WHERE bin IS NOT NULL GROUP BY ALL)""",
  "SELECT a, b, avg(c) FILTER (bin = 'low') AS low, avg(c) FILTER (bin = 'high') AS high, count(DISTINCT subject) AS n_subjects, avg(c) FILTER (bin = 'high') - avg(c) FILTER (bin = 'low') AS difference FROM sc GROUP BY 1, 2", "a, b, n_subjects", "low high difference"))
def _(s, d):
    return L.covariance_bin_contrast(fx.signals(s, d), "subject", "trial", "rating", t="ti")


def node_series(s, d):
    return fx.cells(s, d).select("trial", F.concat(F.lit("n"), F.floor(F.col("cell") / 8)).alias("channel"), (F.col("cell") % 8).alias("t"), F.col("v").alias("x"))


@query("threshold_graph", sql(CE + """, e AS (SELECT a.trial, 'n' || (a.cell // 8) AS node_a, 'n' || (b.cell // 8) AS node_b, corr(a.v, b.v) AS value FROM cells a JOIN cells b ON a.trial = b.trial AND a.cell % 8 = b.cell % 8 AND a.cell > b.cell GROUP BY 1, 2, 3),
  k AS (SELECT *, abs(value) AS weight, list_sort(list(abs(value)) OVER (PARTITION BY trial)) AS l FROM e)""", "SELECT trial, node_a, node_b, value, weight, l[floor(0.7 * len(l))::INT + 1] AS cutoff FROM k WHERE weight >= l[floor(0.7 * len(l))::INT + 1]", "trial, node_a, node_b", "value weight cutoff"))
def _(s, d):
    return L.threshold_graph(L.envelope_connectivity(node_series(s, d), ["trial"]), ["trial"], 0.7)


GRAPH = CE + """, e AS (SELECT a.trial, 'n' || (a.cell // 8) AS node_a, 'n' || (b.cell // 8) AS node_b, corr(a.v, b.v) AS value FROM cells a JOIN cells b ON a.trial = b.trial AND a.cell % 8 = b.cell % 8 AND a.cell > b.cell GROUP BY 1, 2, 3),
  k AS (SELECT *, abs(value) AS weight, list_sort(list(abs(value)) OVER (PARTITION BY trial)) AS l FROM e), g AS (SELECT trial, node_a, node_b FROM k WHERE weight >= l[floor(0.7 * len(l))::INT + 1]),
  bo AS (SELECT trial, node_a AS u, node_b AS v FROM g UNION SELECT trial, node_b, node_a FROM g), dg AS (SELECT trial, u, count(*) AS deg FROM bo GROUP BY 1, 2),
  tr AS (SELECT x.trial, x.u, count(*) / 2 AS tri FROM bo x JOIN bo y ON x.trial = y.trial AND x.u = y.u AND x.v <> y.v JOIN bo z ON z.trial = x.trial AND z.u = x.v AND z.v = y.v GROUP BY 1, 2),
  nd AS (SELECT DISTINCT trial, 'n' || (cell // 8) AS u FROM cells), lo AS (SELECT trial, coalesce(deg, 0) AS deg, coalesce(tri, 0) AS tri FROM nd LEFT JOIN dg USING (trial, u) LEFT JOIN tr USING (trial, u)),
  mt AS (SELECT trial, count(*) AS n_nodes, avg(deg) AS mean_degree, avg(CASE WHEN deg > 1 THEN 2 * tri / (deg * (deg - 1)) ELSE 0 END) AS clustering FROM lo GROUP BY 1),
  wk AS (SELECT trial, u AS s, v AS t, 1 AS d FROM bo UNION SELECT wk.trial, s, bo.v, d + 1 FROM wk JOIN bo ON bo.trial = wk.trial AND bo.u = wk.t WHERE d < 7 AND bo.v <> s),
  ds AS (SELECT trial, s, t, min(d) AS d FROM wk GROUP BY 1, 2, 3), pa AS (SELECT trial, avg(d) AS path_length, sum(1 / d) AS e FROM ds GROUP BY 1)"""


@query("graph_metrics", sql(GRAPH, "SELECT mt.*, path_length, coalesce(e / (n_nodes * (n_nodes - 1)), 0) AS efficiency FROM mt LEFT JOIN pa USING (trial)", "trial, n_nodes", "mean_degree clustering path_length efficiency"))
def _(s, d):
    c = node_series(s, d)
    g = L.threshold_graph(L.envelope_connectivity(c, ["trial"]), ["trial"], 0.7)
    return L.graph_metrics(g, c.select("trial", F.col("channel").alias("node")).distinct(), ["trial"])
