"""Mixing sources to target weights: whole copies by the source's repetition rate, and one seeded coin for the rest."""

from pyspark.sql import functions as F

from ..session import stored
from .common import WORD, global_rank, unit_draw

# Fixed values of the mix: weights in the order of the sources, the share of all sizes, and the highest rate.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def word_count(text):
    """Words of a text column (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes, source="source", size="size", weights=WEIGHTS, share=SHARE, most=MOST):
    """One row per source: size, weight, target and rate.

    ``share`` of all sizes is dealt by weight; a target that would pass ``most`` times its source's size stops there and
    the excess is dealt among the others, until none is above.  Each round is one aggregate over the sources, of which
    only three sums reach the driver.  A null source is a source of its own, in the last place.
    """
    totals = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    ranked = global_rank(totals, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = stored(ranked.withColumn("weight", weight), "sources")
    cap = F.lit(float(most)) * F.col("source_size")
    level = None
    while True:
        full = F.lit(False) if level is None else F.lit(level) * F.col("weight") > cap
        row = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("capped"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if not row["weight"]:
            break
        now = (share * row["all"] - most * row["capped"]) / row["weight"]
        if level is not None and now == level:
            break
        level = now
    target = F.least(F.lit(level or 0.0) * F.col("weight"), cap)
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return stored(table.select("source", "source_size", "weight", target.alias("target"), rate.alias("rate")), "targets")


def copies_of(rate, key, seed):
    """floor(rate) copies, and one more with the probability of the fraction."""
    return (F.floor(rate) + F.when(unit_draw(F.lit(str(seed)), key) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def draw_key(doc_id, text):
    """What a document's coin depends on: its id, or its text where it has none."""
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def mix_plan(docs, doc_id="doc_id", text="text", source="source", seed=7, **settings):
    """One row per document: its size, its source's size and target, its copies, and the words the mix takes.

    The texts are read once, into a stored table of sizes.  Documents without words take none; repeated rows with one id
    share one coin; an empty table gives no rows.  Only the four result columns and the id are kept.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), draw_key(doc_id, text).alias("draw_key"))
    sizes = stored(sized, "sizes")
    targets = source_targets(sizes, **settings).withColumnRenamed("source", "of_source")
    return sizes.join(targets, F.col("source").eqNullSafe(F.col("of_source")), "left").select(
        "doc_id", "source", "size", "source_size", "target", copies_of(F.col("rate"), F.col("draw_key"), seed).alias("copies")
    ).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs, doc_id="doc_id", text="text", source="source", seed=7, **settings):
    """The mixed documents themselves: every row of ``docs`` as often as the mix takes it, with all its columns."""
    sizes = stored(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    targets = source_targets(sizes, **settings).select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    return (
        docs.join(targets, F.col(source).eqNullSafe(F.col("__source")), "left")
        .withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies_of(F.col("__rate"), draw_key(doc_id, text), seed).cast("int"))))
        .drop("__source", "__rate", "__copy")
    )
