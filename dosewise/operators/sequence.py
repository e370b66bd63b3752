"""Operators along an order: indexes, windows, baselines, clusters and intervals."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions.moments import pair_aggs, r_with_p
from ..plans.shapes import join_keys, ordered_scan, with_index, with_midrank, with_midrank_in, with_row, with_totals

TINY = 1e-20


def within_subject_index(df, subject="subject", order=("ts", "event_id"), name="trial_idx"):
    """0-based trial number in arrival order."""
    return with_index(df, [subject], list(order), name)


def infer_blocks(df, index="trial_idx", per_run=11, name="block"):
    return df.withColumn(name, F.floor(F.col(index) / per_run).cast("int"))


def fold_adjacency(df, keys, index="trial_idx"):
    """Share of neighbouring indexes inside a fold and its density n / (range + 1)."""
    df = ordered_scan(df, keys, [index], {"__prev": ("lag", index)})
    step = F.col(index) - F.col("__prev")
    out = df.groupBy(*keys).agg(F.count(index).alias("n"), F.count_if(step == 1).alias("adj"), F.count(step).alias("steps"), F.min(index).alias("lo"), F.max(index).alias("hi"))
    return out.select(*keys, "n", F.try_divide(F.col("adj"), F.col("steps")).alias("adjacent_share"), (F.col("n") / (F.col("hi") - F.col("lo") + 1)).alias("density"))


BLOCK_STARTS, BLOCKS_AT_ONCE = 64, 256


def _ranked_windows(width, n_keys):
    """A function for ``mapInArrow`` over (keys, block, last start, rows): the moments of the ranks in every window that starts in the block."""
    size, at_once = BLOCK_STARTS, BLOCKS_AT_ONCE

    def windows(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, at_once):
                part = batch.slice(a, at_once)
                begin, last = (part.column(n_keys + i).to_numpy() * by for i, by in ((0, size), (1, 1)))
                rows = part.column(n_keys + 2)
                own = np.repeat(np.arange(part.num_rows), pc.list_value_length(rows).to_numpy())
                index, x, y = rows.flatten().flatten()
                index = index.to_numpy()
                low = np.maximum(np.maximum(index - width + 1, begin[own]), 0)
                many = np.minimum(np.minimum(index, begin[own] + size - 1), last[own]) - low + 1
                row = np.repeat(np.arange(len(own)), many)
                start = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                at = own[row] * size + start - begin[own[row]]

                def ranks(values):
                    code = pc.rank(values, sort_keys="ascending", tiebreaker="dense").to_numpy()[row]
                    order = np.lexsort((code, at))
                    head = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
                    tie = np.flatnonzero(np.r_[True, (np.diff(at[order]) != 0) | (np.diff(code[order].astype(np.int64)) != 0)])
                    before = np.repeat(head, np.diff(np.r_[head, len(at)]))[tie]
                    out, ties = np.empty(len(at)), np.diff(np.r_[tie, len(at)])
                    out[order] = np.repeat(tie - before + (ties + 1) / 2, ties)
                    return out

                rx, ry = ranks(x), ranks(y)
                n = np.bincount(at)
                kept = np.flatnonzero(n)
                total = lambda v: np.bincount(at, v)[kept]
                n, sx, sy = n[kept], total(rx), total(ry)
                over = lambda s, t, v: (total(v) - s * t / n) / np.maximum(n - 1, 1)
                moments = [sx / n, sy / n, over(sx, sx, rx * rx), over(sy, sy, ry * ry), over(sx, sy, rx * ry)]
                of = kept // size
                keys = [part.column(k).take(pa.array(of)) for k in range(n_keys)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(begin[of] + kept % size), pa.array(n), *[pa.array(m) for m in moments]], names=[*batch.schema.names[:n_keys], "start", "n", "mx", "my", "vx", "vy", "cxy"])

    return windows


def running_correlation(df, subject, index, x, y, width=20, min_valid=5, min_trials=40):
    """Rank correlation in every full window of ``width`` trials; the mid-point is start + width/2 + 1 (1-based).

    Each trial goes to the one or two blocks of ``BLOCK_STARTS`` window starts it belongs to; a task ranks the windows of some blocks at a time.
    """
    kinds = dict(df.dtypes)
    df = with_totals(df, [subject], {"__n": F.max(index)}).withColumn("__n", F.col("__n") + 1).where(F.col("__n") >= min_trials)
    first, last = F.greatest(F.col(index) - (width - 1), F.lit(0)), F.least(F.col(index), F.col("__n") - width)
    block = lambda c: F.floor(c / BLOCK_STARTS).cast("long")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (first <= last) & F.col(index).isNotNull())
    rows = rows.select(subject, F.explode(F.sequence(block(first), block(last))).alias("__block"), (F.col("__n") - width).cast("long").alias("__last"), F.struct(F.col(index).cast("long").alias("i"), F.col(x).alias("x"), F.col(y).alias("y")).alias("__r"))
    rows = rows.groupBy(subject, "__block").agg(F.max("__last").alias("__last"), F.collect_list("__r").alias("__r"))
    moments = rows.mapInArrow(_ranked_windows(width, 1), f"`{subject}` {kinds[subject]}, start long, n long, mx double, my double, vx double, vy double, cxy double")
    out = r_with_p(moments.withColumn("start", F.col("start").cast(kinds[index])), r="rho", p=None, min_n=min_valid)
    return out.withColumn("midpoint", F.col("start") + width // 2 + 1)


def lag1_consistency(df, subject, order, value, min_pairs=6, min_trials=11):
    """Rank correlation of a rating with the one before."""
    df = ordered_scan(df, [subject], list(order), {"__prev": ("lag", value)})
    df = with_totals(df, [subject], {"__n": F.count(F.lit(1))}).where(F.col("__n") >= min_trials)
    ok = df.where(F.col("__prev").isNotNull() & F.col(value).isNotNull())
    ranked = with_midrank(ok, [subject], {value: "__a", "__prev": "__b"})
    return r_with_p(ranked.groupBy(subject).agg(*pair_aggs("__a", "__b")), r="rho", min_n=min_pairs)


def within_subject_center(df, columns, subject="subject"):
    """Centred and standardised columns per subject; without spread the standardised form is missing."""
    aggs = {}
    for c in columns:
        aggs[f"__m_{c}"], aggs[f"__s_{c}"] = F.avg(c), F.stddev_samp(c)
    df = with_totals(df, [subject], aggs)
    new = {}
    for c in columns:
        centred = F.col(c) - F.col(f"__m_{c}")
        new[f"{c}_centered"] = centred
        new[f"{c}_z"] = F.when(F.col(f"__s_{c}") > 0, centred / F.col(f"__s_{c}"))
    return df.withColumns(new).drop(*aggs)


def cousineau_morey(df, subject, condition, value):
    """Within-subject error bars: subject means removed, spread scaled by sqrt(k/(k-1)) about the grand mean."""
    cells = df.groupBy(subject, condition).agg(F.avg(value).alias("v"))
    cells = with_totals(cells, [subject], {"__s": F.avg("v")})
    tot = cells.agg(F.avg("v").alias("g"), F.count_distinct(condition).alias("k"))
    norm = with_row(cells, tot.select(F.col("g").alias("__g"), F.col("k").alias("__k")))
    scale = F.when(F.col("__k") > 1, F.sqrt(F.col("__k") / (F.col("__k") - 1))).otherwise(F.lit(1.0))
    adj = F.col("__g") + scale * (F.col("v") - F.col("__s"))
    return norm.groupBy(condition).agg(F.avg(adj).alias("mean"), (F.stddev_samp(adj) / F.sqrt(F.count(adj))).alias("sem"), F.count(adj).alias("n"))


def _check_baseline(window):
    if window[1] > 0 or window[0] >= window[1]:
        raise ValueError("the baseline must end at or before 0")


def baseline_logratio(df, cell, window, t="t", value="power", min_samples=5):
    """log10 of power over mean baseline power per cell; too few baseline samples leave it missing."""
    _check_baseline(window)
    b = F.when(F.col(t).between(*window), F.col(value))
    out = with_totals(df, cell, {"__b": F.avg(b), "__n": F.count(b)})
    ok = (F.col("__n") >= min_samples) & (F.col("__b") > 0) & (F.col(value) > 0)
    return out.withColumn("logratio", F.when(ok, F.log10(F.col(value) / F.col("__b")))).drop("__b", "__n")


def unit_standardize(df, value="power", mode="mode", name="logratio"):
    """Any unit to log10 ratio; an unknown unit raises."""
    x = F.col(value)
    out = (
        F.when(F.col(mode) == "ratio", F.log10(F.greatest(x, F.lit(TINY))))
        .when(F.col(mode) == "percent", F.log10(F.greatest(1 + x / 100, F.lit(TINY))))
        .when(F.col(mode) == "logratio", x)
        .otherwise(F.raise_error(F.concat(F.lit("unknown unit "), F.coalesce(F.col(mode), F.lit("none")))).cast("double"))
    )
    return df.withColumn(name, out)


def envelope_logpower(df, cell, window, t="t", value="x", eps=1e-12):
    """Decibels of envelope power over its baseline mean."""
    p = F.col(value) * F.col(value)
    out = with_totals(df, cell, {"__b": F.avg(F.when(F.col(t).between(*window), p))})
    return out.withColumn("db", 10 * F.log10(F.greatest(p, F.lit(eps)) / F.greatest(F.col("__b"), F.lit(eps)))).drop("__b")


def contiguous_clusters(df, keys, index, stat, threshold):
    """Runs of neighbouring rows at or above a threshold: start, end, length and mass.

    The threshold is a number or a column; missing statistics end a run.
    """
    thr = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    pos = with_index(df, keys, [index], "__pos")
    up = pos.where(F.coalesce(F.col(stat) >= thr, F.lit(False)))
    up = with_index(up, keys, ["__pos"], "__k").withColumn("__island", F.col("__pos") - F.col("__k"))
    return up.groupBy(*keys, "__island").agg(F.min(index).alias("start"), F.max(index).alias("end"), F.count(stat).alias("n"), F.sum(stat).alias("mass")).drop("__island")


def gaussian_smooth(df, subject, index, value, sigma=2.0, truncate=4.0):
    """Gaussian smoothing over trials with mirrored edges; missing values become the subject mean first.

    Every trial sends its weighted value to the trials in reach (also from its mirror
    images), which are then summed per trial.
    """
    radius = int(truncate * sigma + 0.5)
    norm = sum(math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1))
    df = with_totals(df, [subject], {"__m": F.avg(value), "__n": F.max(index)}).withColumn("__n", F.col("__n") + 1)
    base = df.select(subject, F.col(index).cast("long").alias("j"), F.coalesce(F.col(value), F.col("__m")).alias("v"), F.col("__n").cast("long").alias("n"))
    period = 2 * F.col("n")
    copies = F.ceil((F.lit(radius) + 1) / period)
    images = base.withColumn("m", F.explode(F.sequence(-copies, copies)))
    images = images.select(subject, "n", "v", F.explode(F.array(F.col("j") + period * F.col("m"), -F.col("j") - 1 + period * F.col("m"))).alias("p"))
    low, high = F.greatest(F.col("p") - radius, F.lit(0)), F.least(F.col("p") + radius, F.col("n") - 1)
    near = images.where(low <= high).select(subject, "v", "p", F.explode(F.sequence(low, high)).alias(index))
    w = F.exp(-0.5 * F.pow((F.col(index) - F.col("p")) / sigma, F.lit(2))) / norm
    return near.groupBy(subject, index).agg(F.sum(w * F.col("v")).alias("smooth"))


def break_intervals(df, keys, min_gap=20.0, shrink=2.0, onset="onset", duration="duration", order=()):
    """Gaps longer than ``min_gap`` between events, shrunk at both sides."""
    nxt = ordered_scan(df, keys, [onset, *order], {"__next": ("lead", onset)})
    end = F.col(onset) + F.col(duration)
    gap = nxt.where(F.col("__next") - end > min_gap)
    return gap.select(*keys, (end + shrink).alias("start"), (F.col("__next") - shrink).alias("end"), (F.col("__next") - end - 2 * shrink).alias("removed"))


def keep_segments(records, bad, keys, end="end"):
    """Good segments of [0, end]: the complement of the (possibly overlapping) bad intervals."""
    cut = join_keys(bad.select(*keys, F.greatest("start", F.lit(0.0)).alias("a"), F.col("stop").alias("b")), records.select(*keys, F.col(end).alias("__end")), list(keys))
    cut = cut.withColumn("b", F.least("b", "__end")).where(F.col("a") < F.col("b")).select(*keys, "a", "b")
    tail = records.select(*keys, F.col(end).cast("double").alias("a"), F.col(end).cast("double").alias("b"))
    both = ordered_scan(cut.unionByName(tail), keys, ["a", "b"], {"__to": ("max_before", "b")})
    good = both.select(*keys, F.coalesce("__to", F.lit(0.0)).alias("start"), F.col("a").alias("stop"))
    return with_totals(good.where(F.col("start") < F.col("stop")), keys, {"n_segments": F.count(F.lit(1))})


def rolling_windows(df, keys, tmin, tmax, length, step, t="t", value="power"):
    """Mean power in windows [start, start + length]; a row is copied to the windows that hold it."""
    starts, s = [], tmin
    while s + length <= tmax + 1e-6:
        starts.append(s)
        s += step
    inside = F.filter(F.array(*[F.lit(float(x)) for x in starts]), lambda a: (F.col(t) >= a) & (F.col(t) <= a + length))
    rows = df.select(*keys, value, F.explode(inside).alias("start"))
    return rows.groupBy(*keys, "start").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def feature_ranks(df, fold, feature, importance):
    """Rank of importance per fold (1 is best) and its mean over folds."""
    neg = df.withColumn("__i", -F.col(importance))
    vc = neg.groupBy(fold, "__i").agg(F.count(F.lit(1)).alias("__n"))
    vc = ordered_scan(vc, [fold], ["__i"], {"__b": ("sum_before", "__n")})
    ranked = join_keys(neg, vc.select(fold, "__i", (F.col("__b") + 1).alias("rank")), [fold, "__i"])
    return with_totals(ranked.drop("__i"), [feature], {"mean_rank": F.avg("rank")})


def baseline_modes(df, cell, windows, modes=("logratio", "ratio", "percent", "zscore"), t="t", value="power"):
    """The same power under several corrections and baseline windows.

    ``windows`` maps a name to limits; those outside the data or ending after 0 are left out.
    ``percent`` is the relative change, ``zscore`` uses the population SD.
    """
    windows = {k: w for k, w in windows.items() if w[1] <= 0}
    aggs = {"__tlo": F.min(t)}
    for k, w in windows.items():
        b = F.when(F.col(t).between(*w), F.col(value))
        aggs[f"__m_{k}"], aggs[f"__s_{k}"] = F.avg(b), F.stddev_pop(b)
    out = with_totals(df, cell, aggs)
    x, rows = F.col(value), []
    for k, w in windows.items():
        m, sd = F.col(f"__m_{k}"), F.col(f"__s_{k}")
        forms = {"logratio": F.log10(x / m), "ratio": x / m, "percent": (x - m) / m, "zscore": F.try_divide(x - m, sd)}
        for mode in modes:
            inside = F.col("__tlo") <= w[0]
            rows.append(F.when(inside & (m > 0), F.struct(F.lit(k).alias("baseline"), F.lit(mode).alias("mode"), forms[mode].alias("corrected"))))
    return out.select(*df.columns, F.inline(F.array_compact(F.array(*rows))))

