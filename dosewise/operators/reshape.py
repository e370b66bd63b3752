"""Reshaping and set operations."""

from functools import reduce

from pyspark.sql import functions as F

from ..functions.scalars import temperature_label
from ..plans.shapes import join_keys, ordered_scan, with_totals
from .columns import parse_feature_name


def _millis(x):
    """Three decimals, half to even."""
    return F.rint(x * 1000) / 1000


def trials_to_events(df, carry=("temp", "rating", "pain"), include_delay=True, known_labels=None):
    """One trial row to its heat, decision, rating and (if longer than 0 s) delay rows."""
    span = [
        (temperature_label(F.col("temp"), known_labels), "stim_start", "stim_end"),
        (F.lit("decision"), "pain_q_start", "pain_q_end"),
        (F.lit("rating"), "vas_start", "vas_end"),
    ]
    if include_delay:
        span.append((F.lit("delay"), "stim_end", "pain_q_start"))
    rows = F.array(*[
        F.struct(name.alias("trial_type"), _millis(F.col(a)).alias("onset"), _millis(F.col(b) - F.col(a)).alias("duration"),
                 (F.col(b) - F.col(a)).alias("__length"))
        for name, a, b in span
    ])
    out = df.select("subject", "run", "trial_number", *carry, F.inline(rows))
    return out.where((F.col("trial_type") != "delay") | (F.col("__length") > 0)).drop("__length")


def features_wide_to_long(df, keys, prefix="pow"):
    """``pow_{band}_{channel}`` columns to rows."""
    cols = [c for c in df.columns if c.startswith(prefix + "_")]
    long = df.unpivot(list(keys), cols, "name", "power")
    return parse_feature_name(long, "name", prefix).drop("name")


def features_long_to_wide(df, keys, names=None, prefix="pow"):
    """The inverse, on output only; ``names`` avoids a job that looks for them."""
    named = df.withColumn("__name", F.concat_ws("_", F.lit(prefix), "band", "channel"))
    return named.groupBy(*keys).pivot("__name", names).agg(F.max("power"))


def pivot_mean_matrix(df, test_times=None):
    values = None if test_times is None else [str(float(t)) for t in test_times]
    named = df.withColumns({"t_train": F.round("t_train", 6), "__t": F.round("t_test", 6).cast("string")})
    return named.groupBy("t_train").pivot("__t", values).agg(F.avg("score"))


def lower_triangle_pairs(df, keys, matrix, names, prefix):
    """Entries below the diagonal of a matrix column as named rows; ``names`` labels the nodes."""
    labels = F.array(*[F.lit(n) for n in names])
    rows = df.select(*keys, F.posexplode(matrix).alias("i", "row"))
    cells = rows.where(F.col("i") > 0).select(*keys, "i", F.posexplode(F.slice("row", F.lit(1), F.col("i"))).alias("j", "value"))
    a, b = F.get(labels, F.col("i")), F.get(labels, F.col("j"))
    return cells.select(*keys, F.concat(F.lit(prefix + "_"), a, F.lit("__"), b).alias("name"), a.alias("node_a"), b.alias("node_b"), "value")


def combine_runs(frames, keys=("subject",)):
    """Union of run tables by column name; run from the table, else from its file."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if "run" in out.columns and "file_run" in out.columns:
        out = out.withColumn("run", F.coalesce("run", "file_run")).drop("file_run")
    elif "file_run" in out.columns:
        out = out.withColumnRenamed("file_run", "run")
    return out.orderBy(*keys, "run", "onset")


def best_params_long(df, keys=("model", "fold", "subject")):
    """Parameter maps of the three criteria to rows."""
    parts = []
    for criterion, column, score in (("primary", "best_params", "best_score_r"), ("r", "best_params_by_r", "best_score_r"),
                                     ("neg_mse", "best_params_by_neg_mse", "best_score_neg_mse")):
        parts.append(F.struct(F.lit(criterion).alias("criterion"), F.col(column).alias("params"), F.col(score).alias("score")))
    rows = df.select(*keys, F.inline(F.array(*parts))).where(F.col("params").isNotNull())
    return rows.select(*keys, "criterion", "score", F.explode("params").alias("key", "value"))


def metrics_wide(df, metrics, models, key="subject"):
    """One row per subject with ``{metric}__{model}`` columns; a subject in any model stays."""
    aggs = [F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{c}__{m}") for m in models for c in metrics]
    return df.groupBy(key).agg(*aggs)


def common_channels(df, subject="subject", channel="channel", axes=("freq", "t")):
    """Channels present in every subject whose grid equals that of the first subject.

    Grid equality is counted on distinct points: as many points as the first has, all shared.
    """
    axes = list(axes)
    first = df.agg(F.min(subject).alias("s0"))
    points = df.select(subject, *axes).distinct()
    ref = points.where(F.col(subject) == first.select("s0").scalar()).select(*axes, F.lit(1).alias("__hit"))
    size = ref.agg(F.count("__hit").alias("n"))
    match = join_keys(points, ref, axes, "left").groupBy(subject).agg(F.count(F.lit(1)).alias("n"), F.count("__hit").alias("hit"))
    want = size.select("n").scalar()
    kept = match.where((F.col("n") == want) & (F.col("hit") == want)).select(subject)
    n_kept = kept.agg(F.count(F.lit(1)).alias("n"))
    pairs = df.select(subject, channel).distinct().join(kept, subject, "left_semi")
    return pairs.groupBy(channel).agg(F.count(F.lit(1)).alias("n_subjects")).where(F.col("n_subjects") == n_kept.select("n").scalar())


def missing_required(df, required, name="name", keys=()):
    """Required names a group lacks, and how many are present."""
    want = df.select(*keys).distinct().withColumn(name, F.explode(F.array(*[F.lit(r) for r in required])))
    have = df.select(*keys, name).distinct()
    n = with_totals(join_keys(want, have.withColumn("__p", F.lit(1)), [*keys, name], "left"), keys, {"n_present": F.count("__p")})
    return n.where(F.col("__p").isNull()).drop("__p")


def union_stat_tables(tables):
    """Append result tables, naming the band and target a table stands for where it has no such column.

    ``tables`` holds (frame, {"band": ..., "target": ...}).
    """
    named = [df.withColumns({k: F.lit(v) for k, v in tags.items() if k not in df.columns}) for df, tags in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def reindex_to_grid(df, keys, subject, axes, value):
    """Each subject on the union grid of its configuration ``keys``, missing where it has no value."""
    grid = df.select(*keys, *axes).distinct()
    subjects = df.select(*keys, subject).distinct()
    full = join_keys(subjects, grid, list(keys))
    return join_keys(full, df.select(*keys, subject, *axes, value), [*keys, subject, *axes], "left")


def interpolate_to_grid(samples, grid, keys, t="t", value="v"):
    """Linear interpolation at grid times inside each group's own range, missing outside; needs two points.

    Samples and grid points are put in one order; the neighbours are running values.
    """
    pts = samples.where(F.col(value).isNotNull()).select(*keys, t, F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("__s"))
    pts = with_totals(pts, keys, {"__n": F.count(F.lit(1))}).where(F.col("__n") >= 2)
    both = pts.select(*keys, t, "__s", F.lit(0).alias("__grid")).unionByName(
        grid.select(*keys, t, F.lit(None).cast(pts.schema["__s"].dataType).alias("__s"), F.lit(1).alias("__grid")))
    both = ordered_scan(both, keys, [t, "__grid"], {"__a": ("last_to", "__s"), "__b": ("first_after", "__s")})
    a, b = F.col("__a"), F.col("__b")
    v = F.when(a["t"] == F.col(t), a["v"]).when(
        a.isNotNull() & b.isNotNull(), a["v"] + (b["v"] - a["v"]) * ((F.col(t) - a["t"]) / (b["t"] - a["t"])))
    return both.where(F.col("__grid") == 1).select(*keys, t, v.alias(value))
