"""Ordered selections."""

from pyspark.sql import functions as F

from ..plans.shapes import ordered_scan
from .sequence import feature_ranks


def top_predictors(df, n=20, alpha=0.05, r="r", p="p", keys=("channel", "band", "target")):
    """Significant rows with the largest absolute r, labelled ``channel (band) [target]``."""
    ok = df.where(F.col(r).isNotNull() & F.col(p).isNotNull() & (F.col(p) <= alpha))
    ok = ok.withColumn("label", F.format_string("%s (%s) [%s]", *[F.col(k) for k in keys]))
    return ok.orderBy(F.abs(r).desc(), *keys).limit(n)


def top_edges(df, n=20, measure="measure", r="r", keys=("node_a", "node_b")):
    """The n pairs with the largest absolute r per measure."""
    ok = df.where(F.col(r).isNotNull()).withColumn("__o", -F.abs(r))
    return ordered_scan(ok, [measure], ["__o", *keys], {"rank": ("row_number", F.lit(1))}).where(F.col("rank") <= n).drop("__o")


def significant_predictors(roi, channel, alpha=0.05):
    """Region and channel results that pass: by the corrected flag, else p <= critical p, else p <= alpha; by p."""
    both = roi.withColumn("level", F.lit("roi")).unionByName(channel.withColumn("level", F.lit("channel")), allowMissingColumns=True)
    keep = F.when(F.col("fdr_reject").isNotNull(), F.col("fdr_reject")).when(F.col("fdr_crit_p").isNotNull(), F.col("p") <= F.col("fdr_crit_p")).otherwise(F.col("p") <= alpha)
    return both.where(F.coalesce(keep, F.lit(False))).orderBy("p", "level")


def topk_by_mean_rank(df, fold, feature, importance, k=30):
    """Features with the lowest mean rank over folds."""
    ranked = feature_ranks(df, fold, feature, importance)
    return ranked.groupBy(feature).agg(F.avg("rank").alias("mean_rank")).orderBy("mean_rank", feature).limit(k)


def best_model(df, model="model", score="r2", keys=()):
    """The model with the largest pooled score; ties go to the first name."""
    best = F.max_by(F.struct(F.col(model), F.col(score)), F.struct(F.col(score))).alias("__b")
    if not keys:
        return df.orderBy(F.col(score).desc_nulls_last(), model).limit(1).select(model, score)
    return df.groupBy(*keys).agg(best).select(*keys, f"__b.{model}", f"__b.{score}")


def strong_edges(df, keys=("band",), a="node_a", b="node_b", r="r", p="p", min_abs=0.3, alpha=0.05, min_edges=3):
    """Strong significant edges of bands that have enough of them, and the degree of each node."""
    ok = df.where((F.abs(r) > min_abs) & (F.col(p) < alpha))
    bands = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges")).where(F.col("n_edges") >= min_edges)
    kept = ok.join(bands, list(keys))
    return kept.select(*keys, "n_edges", F.explode(F.array(a, b)).alias("node")).groupBy(*keys, "node", "n_edges").agg(F.count(F.lit(1)).alias("degree"))
