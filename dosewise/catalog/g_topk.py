"""Ordered selections on the driver's tables."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.moments import pair_aggs, r_with_p
from ..operators import topk as G
from .f_sequence import IMP, importances
from .registry import query, sql, sql_n, sql_r, sql_r_p

FE = fx.SQL_FEATURES
COR = FE + f""", c0 AS (SELECT band, channel, {sql_n('power', 'rating')} AS n, {sql_r('power', 'rating')} AS r FROM features GROUP BY 1, 2), cor AS (SELECT *, {sql_r_p('r', 'n')} AS p FROM c0)"""
EDGE = FE + f""", e0 AS (SELECT a.band, a.channel AS node_a, b.channel AS node_b, {sql_n('a.power', 'b.power')} AS n, {sql_r('a.power', 'b.power')} AS r FROM features a JOIN features b ON a.trial = b.trial AND a.band = b.band AND a.freq < b.freq GROUP BY 1, 2, 3),
  edges AS (SELECT *, {sql_r_p('r', 'n')} AS p FROM e0)"""


def correlations(s, d):
    return r_with_p(fx.features(s, d).groupBy("band", "channel").agg(*pair_aggs("power", "rating")))


def edges(s, d):
    """All pairs of channels of a band (thirteen channels at most)."""
    f = fx.features(s, d)
    a = f.select("trial", "band", F.col("channel").alias("node_a"), F.col("power").alias("x"), F.explode(F.array(*[F.col("freq") + i for i in range(1, 13)])).alias("freq"))
    b = f.select("trial", "band", F.col("channel").alias("node_b"), F.col("power").alias("y"), "freq")
    return r_with_p(a.join(b, ["trial", "band", "freq"]).groupBy("band", "node_a", "node_b").agg(*pair_aggs("x", "y")))


@query("top_predictors", sql(COR, "SELECT band, channel, n, r, p, channel || ' (' || band || ') [rating]' AS label FROM cor WHERE p <= 0.5 ORDER BY abs(r) DESC, channel, band LIMIT 20", "band, channel, n, label", "r p"))
def _(s, d):
    c = correlations(s, d).withColumn("target", F.lit("rating"))
    return G.top_predictors(c, 20, 0.5).drop("target")


@query("top_edges", sql(EDGE, "SELECT * FROM (SELECT band, node_a, node_b, n, r, row_number() OVER (PARTITION BY band ORDER BY abs(r) DESC, node_a, node_b) AS rank FROM edges) WHERE rank <= 20", "band, node_a, node_b, n, rank", "r"))
def _(s, d):
    return G.top_edges(edges(s, d).drop("p"), 20, "band")


@query("significant_predictors", sql(COR + f""", rc0 AS (SELECT CASE WHEN freq <= 6 THEN 'front' ELSE 'back' END AS roi, band, {sql_n('power', 'rating')} AS n, {sql_r('power', 'rating')} AS r FROM features GROUP BY 1, 2), rc AS (SELECT *, {sql_r_p('r', 'n')} AS p FROM rc0)""",
  """SELECT 'channel' AS level, band, channel, NULL::VARCHAR AS roi, p, r FROM cor WHERE CASE WHEN band IN ('b0', 'b1') THEN p < 0.4 WHEN band = 'b2' THEN p <= 0.3 ELSE p <= 0.6 END
  UNION ALL SELECT 'roi', band, NULL::VARCHAR, roi, p, r FROM rc WHERE p <= 0.6""", "level, band, channel, roi", "p r"))
def _(s, d):
    f = fx.features(s, d).withColumn("roi", F.when(F.col("freq") <= 6, "front").otherwise("back"))
    roi = r_with_p(f.groupBy("roi", "band").agg(*pair_aggs("power", "rating"))).select("roi", "band", "r", "p")
    ch = correlations(s, d).select("channel", "band", "r", "p")
    ch = ch.withColumns({"fdr_reject": F.when(F.col("band").isin("b0", "b1"), F.col("p") < 0.4), "fdr_crit_p": F.when(F.col("band") == "b2", 0.3)})
    return G.significant_predictors(roi, ch, 0.6).select("level", "band", "channel", "roi", "p", "r")


@query("topk_by_mean_rank", sql(IMP, "SELECT feature, avg(rank) AS mean_rank FROM rk GROUP BY 1 ORDER BY 2, 1 LIMIT 30", "feature", "mean_rank"))
def _(s, d):
    return G.topk_by_mean_rank(importances(s, d), "fold", "feature", "importance", 30)


@query("best_model", sql(COR, "SELECT channel AS model, max(abs(r)) AS r2 FROM cor GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", "model", "r2"))
def _(s, d):
    m = correlations(s, d).groupBy(F.col("channel").alias("model")).agg(F.max(F.abs("r")).alias("r2"))
    return G.best_model(m)


@query("strong_edges", sql(EDGE + ", ok AS (SELECT *, count(*) OVER (PARTITION BY band) AS n_edges FROM edges WHERE abs(r) > 0.03 AND p < 0.4)",
                           "SELECT band, node, n_edges, count(*) AS degree FROM (SELECT band, n_edges, unnest([node_a, node_b]) AS node FROM ok WHERE n_edges >= 3) GROUP BY ALL", "band, node, n_edges, degree"))
def _(s, d):
    return G.strong_edges(edges(s, d), min_abs=0.03, alpha=0.4)
