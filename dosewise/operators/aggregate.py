"""Aggregations and reports.  Two-level averages count each subject once."""

import math

from pyspark.sql import functions as F

from ..functions.moments import pair_aggs, r_with_p
from ..functions.scalars import joined, logratio_to_percent
from ..plans.shapes import join_keys, ordered_scan, quantiles, with_midrank, with_row, with_totals

TINY = 1e-20


def validate_events(df, keys, heat, expected=11, duration=12.5, tolerance=1.0, max_sd=0.5):
    """Per run: counts by type, heat durations, onset range, checks and the list of errors."""
    dur = F.when(heat, F.col("duration"))
    out = df.groupBy(*keys).agg(
        F.count_if(heat).alias("n_heat"), F.count_if(F.col("trial_type") == "decision").alias("n_decision"),
        F.count_if(F.col("trial_type") == "rating").alias("n_rating"), F.avg(dur).alias("dur_mean"), F.stddev_samp(dur).alias("dur_sd"),
        F.min(dur).alias("dur_min"), F.max(dur).alias("dur_max"), F.min("onset").alias("onset_min"), F.max("onset").alias("onset_max"))
    checks = [
        (F.col("n_heat") != expected, F.format_string("heat trials: %d", "n_heat")),
        (F.coalesce((F.abs(F.col("dur_mean") - duration) >= tolerance) | (F.col("dur_sd") >= max_sd), F.lit(True)), F.lit("heat duration")),
        (F.col("n_decision") != expected, F.format_string("decisions: %d", "n_decision")),
        (F.col("n_rating") != expected, F.format_string("ratings: %d", "n_rating")),
    ]
    return out.withColumn("errors", joined([F.when(c, t) for c, t in checks])).withColumn("valid", F.col("errors") == "")


def validate_confounds(df, keys, required, outlier_prefix="motion_outlier", volumes=None):
    """Rows, columns, missing motion columns and outlier columns per run; rows against volumes where given."""
    one = df.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(r) for r in required])
    cols = one.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_columns"), F.count_if(F.col("name").startswith(outlier_prefix)).alias("n_outlier_columns"),
        F.array_sort(F.array_except(names, F.coalesce(F.collect_list(F.when(F.col("name").isin(list(required)), F.col("name"))), F.array()))).alias("lack"))
    rows = df.groupBy(*keys, "volume").agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count("one").alias("n_rows"))
    out = join_keys(rows, cols, list(keys))
    out = out.withColumns({"missing": F.array_join("lack", "|"), "n_present": F.lit(len(required)) - F.size("lack")}).drop("lack")
    if volumes is not None:
        out = join_keys(out, volumes, list(keys), "left").withColumn("rows_match", F.col("n_rows") == F.col("n_volumes"))
    return out


def condition_balance(df, keys, column, conditions, expected=11):
    """Trials per condition, zero-filled, against the expected number."""
    want = df.select(*keys).distinct().withColumn(column, F.explode(F.array(*[F.lit(c) for c in conditions])))
    n = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    out = join_keys(want, n, [*keys, column], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("balanced", F.col("n") == expected)


def extract_confounds(df, keys, motion, outlier_prefix="motion_outlier"):
    """Motion and outlier columns with missing values set to 0 and flagged."""
    keep = df.where(F.col("name").isin(list(motion)) | F.col("name").startswith(outlier_prefix))
    return keep.select(*keys, "volume", "name", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNull().alias("filled"))


def confound_summary(runs, key="subject"):
    """Per subject over run rows (run, n_outliers, n_filled)."""
    return runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "n_outliers"))), lambda e: e["n_outliers"].cast("string")), ",").alias("outliers"),
        F.min("n_outliers").alias("min_outliers"), F.max("n_outliers").alias("max_outliers"), F.avg("n_outliers").alias("mean_outliers"),
        F.sum("n_outliers").alias("total_outliers"), F.bool_or(F.col("n_filled") > 0).alias("any_filled"))


def rating_stats(df, keys, column, conditions, value="rating"):
    """Per (group, condition): mean, SD (population), median, min, max, n; empty gives missing and n = 0."""
    full = [*keys, column]
    want = df.select(*keys).distinct().withColumn(column, F.explode(F.array(*[F.lit(c) for c in conditions])))
    agg = df.groupBy(*full).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))
    out = join_keys(join_keys(want, agg, full, "left"), quantiles(df, full, value, {"median": 0.5}), full, "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def displacement_stats(df, keys, subject, value="fd", outlier=None):
    """Run statistics of displacement (the first volume has none, so n = count + 1), rolled up per subject."""
    outlier = F.lit(False) if outlier is None else outlier
    run = df.groupBy(*keys).agg(F.avg(value).alias("mean_fd"), F.max(value).alias("max_fd"), F.stddev_pop(value).alias("sd_fd"),
                                (F.count(value) + 1).alias("n_volumes"), F.count_if(outlier).alias("n_outliers"))
    run = join_keys(run, quantiles(df, keys, value, {"median_fd": 0.5}), list(keys))
    sub = run.groupBy(*subject).agg(F.avg("mean_fd").alias("mean_fd"), F.max("max_fd").alias("max_fd"), F.avg("sd_fd").alias("sd_fd"), F.sum("n_volumes").alias("n_volumes"),
                                    F.sum("n_outliers").alias("n_outliers"))
    med = quantiles(run, subject, "mean_fd", {"median_run_fd": 0.5})
    out = join_keys(sub, med, list(subject)) if subject else sub
    return out.withColumn("outlier_fraction", F.col("n_outliers") / F.col("n_volumes"))


def qc_status(df, critical, warnings):
    """PASS without critical flags; flags and warnings as joined text.  Both lists hold (condition, text)."""
    pick = lambda items: F.array_compact(F.array(*[F.when(c, t if not isinstance(t, str) else F.lit(t)) for c, t in items]))
    out = df.withColumns({"__f": pick(critical), "__w": pick(warnings)})
    return out.withColumns({
        "n_flags": F.size("__f"), "n_warnings": F.size("__w"), "flags": F.array_join("__f", "; "), "warnings": F.array_join("__w", "; "),
        "status": F.when(F.size("__f") == 0, "PASS").otherwise("FAIL")}).drop("__f", "__w")


def nonfinite_counts(df, keys, value):
    x = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan(x)).alias("n_nan"), F.count_if(F.abs(x) == float("inf")).alias("n_inf"))


def pain_counts_total(df, subject="subject", pain="pain"):
    out = df.rollup(subject).agg(F.count_if(F.col(pain) == 1).alias("n_pain"), F.count_if(F.col(pain) == 0).alias("n_nonpain"), F.count(pain).alias("n_total"))
    return out.withColumn(subject, F.coalesce(F.col(subject).cast("string"), F.lit("TOTAL")))


def preprocessing_stats(channels, components, epochs, keys, events):
    """Per (participant, session): distinct bad channels, bad components, epochs clean/removed/boundary and clean per event."""
    bad = channels.where("status = 'bad'").select(*keys, "channel").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bad_channels"))
    comp = components.where("status = 'bad'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bad_components"))
    clean = F.col("state") == "clean"
    ep = epochs.groupBy(*keys).agg(
        F.count_if(clean).alias("n_clean"), F.count_if(F.col("state") == "removed").alias("n_removed"), F.count_if(F.col("state") == "boundary").alias("n_boundary"),
        *[F.count_if(clean & (F.col("event") == e)).alias(f"clean_{e}") for e in events])
    out = join_keys(join_keys(ep, bad, list(keys), "left"), comp, list(keys), "left")
    return out.fillna(0, ["n_bad_channels", "n_bad_components"])


def describe_columns(df, columns):
    """count, mean, SD, min, quartiles and max of each column."""
    long = df.unpivot([], list(columns), "metric", "x").withColumn("x", F.col("x").cast("double"))
    agg = long.groupBy("metric").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"), F.max("x").alias("max"))
    return join_keys(agg, quantiles(long, ["metric"], "x", {"q25": 0.25, "median": 0.5, "q75": 0.75}), ["metric"])


def sync_bad_channels(df, subject="subject", channel="channel"):
    """A channel bad in one run is bad in all runs of the subject."""
    out = with_totals(df, [subject, channel], {"__bad": F.bool_or(F.col("status") == "bad")})
    return out.withColumn("status", F.when(F.col("__bad"), "bad").otherwise("good")).drop("__bad")


def events_integrity(df, keys, order):
    """Rows, missing values, types, onset range, backward steps and negative onsets per file."""
    df = ordered_scan(df, keys, order, {"__prev": ("lag", "onset")})
    back = F.coalesce(F.col("onset") - F.col("__prev") < -1e-9, F.lit(False))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_missing_{c}") for c in ("onset", "duration", "trial_type")],
        F.array_join(F.array_sort(F.collect_set("trial_type")), "|").alias("trial_types"), F.min("onset").alias("onset_min"), F.max("onset").alias("onset_max"),
        F.bool_or(back).alias("nonmonotonic"), F.count_if(F.col("onset") < 0).alias("n_negative"))


def param_mode(df, keys, value="value"):
    """Most frequent value per key; ties go to the smallest."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("__b")).select(
        *keys, F.col("__b.v").alias(value), (-F.col("__b.m")).alias("n"))


def null_summary(df, keys, value):
    """Shape of a null distribution; skew and excess kurtosis are the population forms."""
    x = F.col(value)
    agg = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"),
                                F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"))
    return join_keys(agg, quantiles(df, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}), list(keys))


def roi_mean(df, rois, keys, channel="channel", value="power"):
    """Mean over the region's channels that have a value.  ``rois`` is a (roi, channel) frame."""
    return join_keys(df, rois, [channel]).groupBy(*keys, "roi").agg(F.avg(value).alias(value), F.count(value).alias("n_channels"))


def band_power(df, keys, bands, tmin, tmax, freq="freq", t="t", value="power"):
    """Mean power over band frequencies and a closed time window; a band without frequencies gives 0."""
    inside = F.col(t).between(tmin, tmax)
    aggs = [F.avg(F.when(F.col(freq).between(lo, hi) & inside, F.col(value))).alias(b) for b, (lo, hi) in bands.items()]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(b).alias("band"), F.coalesce(F.col(b), F.lit(0.0)).alias("power")) for b in bands])
    return wide.select(*keys, F.inline(rows))


def group_channel_power(df, subject="subject", keys=("band", "channel"), value="power"):
    """Mean of subject means, SD (n-1) and number of subjects with a value."""
    sub = df.groupBy(subject, *keys).agg(F.avg(value).alias("m"))
    return sub.groupBy(*keys).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.count("m").alias("n"))


def group_band_power_ci(df, subject="subject", keys=("band",), value="power"):
    out = group_channel_power(df, subject, keys, value)
    se = F.col("sd") / F.sqrt("n")
    return out.select(*keys, "mean", (F.col("mean") - 1.96 * se).alias("ci_low"), (F.col("mean") + 1.96 * se).alias("ci_high"), "n")


def condition_summary(df, keys, subject="subject", value="power", pain="pain", temp="temp"):
    """mu_log10, percent change and n of All, Pain, Non-pain, Diff and each temperature.

    Subject means first; a subject that lacks a class leaves Pain, Non-pain and Diff.
    """
    labels = F.array_compact(F.array(F.lit("All"), F.when(F.col(pain) == 1, "Pain").when(F.col(pain) == 0, "Non-pain"),
                                     F.when(F.col(temp).isNotNull(), F.format_string("%.1f", temp))))
    sub = df.select(subject, *keys, F.col(value).alias("v"), F.explode(labels).alias("label")).groupBy(subject, *keys, "label").agg(F.avg("v").alias("mu"))
    pair = sub.where(F.col("label").isin("Pain", "Non-pain")).groupBy(subject, *keys).agg(
        F.max(F.when(F.col("label") == "Pain", F.col("mu"))).alias("p"), F.max(F.when(F.col("label") == "Non-pain", F.col("mu"))).alias("q"))
    pair = pair.where(F.col("p").isNotNull() & F.col("q").isNotNull())
    rows = F.array(*[F.struct(F.lit(n).alias("label"), e.alias("mu")) for n, e in (
        ("Pain", F.col("p")), ("Non-pain", F.col("q")), ("Diff", F.col("p") - F.col("q")))])
    full = sub.where(~F.col("label").isin("Pain", "Non-pain")).select(*keys, "label", "mu").unionByName(pair.select(*keys, F.inline(rows)))
    out = full.groupBy(*keys, "label").agg(F.avg("mu").alias("mu_log10"), F.count("mu").alias("n"))
    return out.withColumn("pct_change", logratio_to_percent(F.col("mu_log10")))


def band_condition_summary(df, **kw):
    return condition_summary(df, ["band"], **kw)


def roi_condition_summary(df, rois, trial_keys, **kw):
    """As the band summary, after averaging the channels of each region within a trial."""
    means = roi_mean(df, rois, trial_keys)
    return condition_summary(means, ["band", "roi"], **kw)


def baseline_plateau_qc(df, cell, keys, baseline, plateau, t="t", value="power"):
    """Mean and median over cells of baseline, plateau and their log10 ratio; samples per window."""
    inb, inp = F.col(t).between(*baseline), F.col(t).between(*plateau)
    cells = df.groupBy(*keys, *cell).agg(F.avg(F.when(inb, F.col(value))).alias("baseline"), F.avg(F.when(inp, F.col(value))).alias("plateau"),
                                         F.count_if(inb).alias("n_b"), F.count_if(inp).alias("n_p"))
    cells = cells.withColumn("logratio", F.log10((F.col("plateau") + TINY) / (F.col("baseline") + TINY)))
    names = ("baseline", "plateau", "logratio")
    agg = cells.groupBy(*keys).agg(*[F.avg(n).alias(f"mean_{n}") for n in names], F.sum("n_b").alias("n_baseline"), F.sum("n_p").alias("n_plateau"))
    for n in names:
        agg = join_keys(agg, quantiles(cells, keys, n, {f"median_{n}": 0.5}), list(keys))
    return agg


def class_contrast(df, keys, high, low, value="power"):
    """Means of two classes, difference and percent change; ``high`` and ``low`` are row predicates."""
    x = F.col(value)
    out = df.groupBy(*keys).agg(F.avg(F.when(high, x)).alias("mean_high"), F.avg(F.when(low, x)).alias("mean_low"),
                                F.count(F.when(high, x)).alias("n_high"), F.count(F.when(low, x)).alias("n_low"))
    diff = F.col("mean_high") - F.col("mean_low")
    return out.withColumns({"diff": diff, "pct_change": logratio_to_percent(diff)})


def condition_contrast(df, keys=("band", "channel"), value="power", pain="pain", temp="temp"):
    """Pain against non-pain, and the highest against the lowest temperature (1 decimal)."""
    ends = df.agg(F.min(F.round(temp, 1)).alias("lo"), F.max(F.round(temp, 1)).alias("hi"))
    a = class_contrast(df, keys, F.col(pain) == 1, F.col(pain) == 0, value).withColumn("contrast", F.lit("pain"))
    rounded = with_row(df.withColumn("__t", F.round(temp, 1)), ends.select(F.col("lo").alias("__lo"), F.col("hi").alias("__hi")))
    b = class_contrast(rounded, keys, F.col("__t") == F.col("__hi"), F.col("__t") == F.col("__lo"), value).withColumn("contrast", F.lit("temperature"))
    return a.unionByName(b)


def windowed_contrast(df, tmin, tmax, k, subject="subject", keys=("channel",), t="t", value="power", pain="pain", min_subjects=2):
    """Class means and difference in K equal half-open windows: subject means, then their mean."""
    edges = [tmin + (tmax - tmin) * i / k for i in range(k + 1)]
    x = F.col(t)
    win = F.coalesce(*[F.when((x >= edges[i]) & (x < edges[i + 1]), F.lit(i)) for i in range(k)])
    sub = df.select(subject, *keys, pain, value, win.alias("window")).where(F.col("window").isNotNull()).groupBy(subject, *keys, "window").agg(
        F.avg(F.when(F.col(pain) == 1, F.col(value))).alias("p"), F.avg(F.when(F.col(pain) == 0, F.col(value))).alias("q"))
    sub = sub.where(F.col("p").isNotNull() & F.col("q").isNotNull())
    out = sub.groupBy(*keys, "window").agg(F.avg("p").alias("mean_pain"), F.avg("q").alias("mean_nonpain"), F.count(F.lit(1)).alias("n_subjects"))
    return out.where(F.col("n_subjects") >= min_subjects).withColumn("diff", F.col("mean_pain") - F.col("mean_nonpain"))


def evoked_average(df, trial_keys, subject="subject", cls="pain", channel="channel", t="t", value="x", baseline=(-3.0, 0.0)):
    """Baseline-corrected averages per (class, channel, time), each subject once, with field power over channels."""
    inb = (F.col(t) >= baseline[0]) & (F.col(t) < baseline[1])
    base = with_totals(df, [*trial_keys, channel], {"__b": F.avg(F.when(inb, F.col(value)))})
    sub = base.groupBy(subject, cls, channel, t).agg(F.avg(F.col(value) - F.col("__b")).alias("m"))
    grand = sub.groupBy(cls, channel, t).agg(F.avg("m").alias("evoked"), F.count("m").alias("n_subjects"))
    return with_totals(grand, [cls, t], {"field_power": F.stddev_pop("evoked")})


def signature_score(maps, weights, keys, cell=("cell",), value="value", weight="w"):
    """Weighted sum over cells with a weight; non-finite cells count as 0 and are reported."""
    x = F.col(value).cast("double")
    bad = F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull()
    j = join_keys(maps, weights.where(F.col(weight) != 0).select(*cell, weight), list(cell)).withColumns({"__v": F.when(bad, 0.0).otherwise(x), "__bad": bad})
    v = F.col("__v")
    return j.groupBy(*keys).agg(
        F.sum(F.col(weight) * v).alias("score"), F.count(F.lit(1)).alias("n_cells"), F.count_if(v != 0).alias("n_nonzero"), F.count_if("__bad").alias("n_bad"),
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))


def trial_scores(scores, meta, keys, subject="subject", run="run", order=("trial",), threshold=100.0):
    """Signature score per trial with its indexes, label, rating and pain flag."""
    out = join_keys(scores.select(*keys, "score"), meta, list(keys))
    out = ordered_scan(out, [subject], [run, *order], {"trial_idx_global": ("row_number", F.lit(1))})
    out = ordered_scan(out, [subject, run], list(order), {"trial_idx_run": ("row_number", F.lit(1))})
    return out.withColumns({"trial_idx_global": F.col("trial_idx_global") - 1, "trial_idx_run": F.col("trial_idx_run") - 1,
                            "pain_binary": (F.col("rating") > threshold).cast("int")})


def combine_runs_fixed(df, keys, value="value", variance=None):
    """Runs to one map: plain mean with var/n, or precision weighted; a cell zero in all runs stays 0."""
    b = F.col(value)
    nonzero = F.count_if(b != 0).alias("n_nonzero")
    if variance is None:
        out = df.groupBy(*keys).agg(F.avg(b).alias("mean"), (F.var_samp(b) / F.count(b)).alias("variance"), nonzero)
    else:
        v = F.col(variance)
        ok = (v > 0)
        out = df.groupBy(*keys).agg(F.try_divide(F.sum(F.when(ok, b / v)), F.sum(F.when(ok, 1 / v))).alias("mean"),
                                    F.try_divide(F.lit(1.0), F.sum(F.when(ok, 1 / v))).alias("variance"), nonzero)
    zero = F.col("n_nonzero") == 0
    return out.withColumns({"mean": F.when(zero, 0.0).otherwise(F.col("mean")), "variance": F.when(zero, 0.0).otherwise(F.col("variance"))})


def local_variance(df, keys, value="value", floor=1e-6):
    """Population variance over the 3x3x3 neighbourhood, zero outside the map.

    The box sum is taken one axis at a time: three rows per cell and pass, not 27 at once.
    """
    cur = df.select(*keys, "x", "y", "z", F.col(value).alias("__s"), (F.col(value) * F.col(value)).alias("__q"), F.lit(1).alias("__own"))
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    for axis in ("x", "y", "z"):
        cur = cur.withColumn("__d", F.explode(steps))
        own = F.when(F.col("__d") == 0, F.col("__own"))
        cur = cur.select(*keys, *[F.col(a) + F.col("__d") if a == axis else F.col(a) for a in ("x", "y", "z")], "__s", "__q", own.alias("__own"))
        cur = cur.toDF(*keys, "x", "y", "z", "__s", "__q", "__own").groupBy(*keys, "x", "y", "z").agg(
            F.sum("__s").alias("__s"), F.sum("__q").alias("__q"), F.max("__own").alias("__own"))
    var = F.col("__q") / 27 - (F.col("__s") / 27) * (F.col("__s") / 27)
    return cur.where("__own = 1").select(*keys, "x", "y", "z", F.greatest(var, F.lit(floor)).alias("variance"))


def grid_overlap(maps, weights, keys, cell=("x", "y", "z"), value="value", weight="w", minimum=98.0):
    """Share of weight cells that are nonzero in each map; valid from 98 percent on and without bad values."""
    w = weights.where(F.col(weight) != 0).select(*cell, F.lit(1).alias("__w"))
    total = w.agg(F.count(F.lit(1)).alias("n"))
    x = F.col(value).cast("double")
    bad_nan, bad_inf = F.isnan(x), F.abs(x) == float("inf")
    agg = join_keys(maps, w, list(cell), "left").groupBy(*keys).agg(
        F.count_if(F.col("__w").isNotNull() & (x != 0)).alias("n_overlap"), F.count_if(bad_nan).alias("n_nan"), F.count_if(bad_inf).alias("n_inf"))
    out = agg.withColumn("n_weights", total.select("n").scalar())
    out = out.withColumn("overlap_pct", 100.0 * F.col("n_overlap") / F.col("n_weights"))
    return out.withColumn("valid", (F.col("overlap_pct") >= minimum) & (F.col("n_nan") + F.col("n_inf") == 0))


def trial_variability(df, trial_keys, keys=("band",), value="power"):
    """Mean, SD and coefficient of variation of trial means."""
    tm = df.groupBy(*keys, *trial_keys).agg(F.avg(value).alias("m"))
    out = tm.groupBy(*keys).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.count("m").alias("n"))
    return out.withColumn("cv", F.when(F.abs("mean") > 1e-10, F.col("sd") / F.abs("mean")))


def robust_limits(df, keys, value, cap=0.25, floor=1e-6):
    """Symmetric display limit from the 2nd and 98th percentile."""
    x = F.col(value).cast("double")
    q = quantiles(df, keys, F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x), {"q02": 0.02, "q98": 0.98})
    lim = F.least(F.greatest(F.abs("q02"), F.abs("q98")), F.lit(cap))
    return q.withColumn("vlim", F.when(lim > 0, lim).otherwise(floor))


def deviant_channels(df, keys, channel="channel", value="amplitude", limit=5.0, custom=None):
    """Channels whose robust z over channels passes the limit, with a custom list added."""
    med = quantiles(df, keys, value, {"__m": 0.5})
    dev = join_keys(df, med, list(keys)).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    mad = quantiles(dev, keys, "__d", {"__mad": 0.5})
    z = F.try_divide(F.col(value) - F.col("__m"), 1.4826 * F.col("__mad"))
    out = join_keys(dev, mad, list(keys)).select(*keys, channel, z.alias("z")).withColumn("flagged", F.coalesce(F.abs("z") > limit, F.lit(False)))
    if custom is not None:
        named = custom.select(*keys, channel).distinct().withColumn("__c", F.lit(True))
        out = join_keys(out, named, [*keys, channel], "left").withColumn("flagged", F.col("flagged") | F.col("__c").isNotNull()).drop("__c")
    return out


def subject_summary_means(df, metrics):
    """Group mean and SD of each subject metric with a formatted row."""
    long = df.unpivot([], list(metrics), "metric", "x")
    out = long.groupBy("metric").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    return out.withColumn("text", F.format_string("%.3f +- %.3f (n=%d)", "mean", "sd", "n"))


def monotone_trend_check(df, keys, condition, score, min_n=3):
    """Rank correlation of condition and score per group with its sign."""
    ok = df.where(F.col(condition).isNotNull() & F.col(score).isNotNull())
    ranked = with_midrank(ok, keys, {condition: "__rc", score: "__rs"})
    out = r_with_p(ranked.groupBy(*keys).agg(*pair_aggs("__rc", "__rs")), r="rho", min_n=min_n)
    return out.withColumn("increasing", F.when(F.col("rho").isNotNull(), F.col("rho") > 0))


def alpha_peak_cog(df, keys, fmin, fmax, freq="freq", value="power"):
    """Peak frequency (highest local maximum, else the largest value, flagged), centre of gravity, band power."""
    spec = df.where(F.col(freq).between(fmin, fmax)).groupBy(*keys, freq).agg(F.avg(value).alias("p"))
    spec = ordered_scan(spec, keys, [freq], {"__a": ("lag", "p"), "__b": ("lead", "p")})
    peak = (F.col("p") > F.col("__a")) & (F.col("p") > F.col("__b"))
    best = lambda cond: F.max(F.when(cond, F.struct("p", (-F.col(freq)).alias("nf"))))
    out = spec.groupBy(*keys).agg(best(peak).alias("__pk"), best(F.lit(True)).alias("__am"), F.sum("p").alias("band_power"), F.sum(F.col("p") * F.col(freq)).alias("__pf"))
    return out.select(*keys, (-F.coalesce("__pk.nf", "__am.nf")).alias("peak_freq"), F.col("__pk").isNotNull().alias("has_peak"),
                      F.when(F.col("band_power") > TINY, F.try_divide(F.col("__pf"), F.col("band_power"))).alias("cog"), "band_power")


def spectrum_by_projection(df, keys, freqs, t="t", value="x"):
    """Periodogram at listed frequencies: squared cosine and sine sums over n squared."""
    wide = df.withColumn("freq", F.explode(F.array(*[F.lit(float(f)) for f in freqs])))
    arg = 2 * math.pi * F.col("freq") * F.col(t)
    out = wide.groupBy(*keys, "freq").agg(F.sum(F.col(value) * F.cos(arg)).alias("c"), F.sum(F.col(value) * F.sin(arg)).alias("s"), F.count(value).alias("n"))
    return out.select(*keys, "freq", ((F.col("c") * F.col("c") + F.col("s") * F.col("s")) / (F.col("n") * F.col("n"))).alias("power"))


def baseline_stability(df, keys, trial, cell, baseline, t="t", value="power"):
    """Baseline noise: median temporal SD over cells, MAD and robust variation of trial means."""
    b = df.where(F.col(t).between(*baseline))
    sd = b.groupBy(*keys, *trial, *cell).agg(F.stddev_pop(value).alias("sd"), F.count(value).alias("n"))
    n = sd.groupBy(*keys).agg(F.max("n").alias("n_samples"))
    tm = b.groupBy(*keys, *trial).agg(F.avg(value).alias("m"))
    med = quantiles(tm, keys, "m", {"median_trial": 0.5})
    dev = (join_keys(tm, med, list(keys)) if keys else tm.withColumn("median_trial", med.select("median_trial").scalar())).withColumn("d", F.abs(F.col("m") - F.col("median_trial")))
    out = join_keys(n, quantiles(sd, keys, "sd", {"median_sd": 0.5}), list(keys))
    out = join_keys(join_keys(out, med, list(keys)), quantiles(dev, keys, "d", {"mad": 0.5}), list(keys))
    return out.withColumn("robust_cv", 1.4826 * F.col("mad") / F.greatest(F.abs("median_trial"), F.lit(1e-12)))


def power_time_course(df, keys=("band", "t"), value="power", pain="pain"):
    """Mean over trials and channels per time point, and the contrast of two classes."""
    x = F.col(value)
    out = df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.avg(F.when(F.col(pain) == 1, x)).alias("pain"), F.avg(F.when(F.col(pain) == 0, x)).alias("nonpain"))
    return out.withColumn("diff", F.col("pain") - F.col("nonpain"))


def model_diag_summary(df, subject="subject"):
    return df.groupBy(subject).agg(F.avg("dof").alias("mean_dof"), F.min("dof").alias("min_dof"), F.avg("r2").alias("mean_r2"), F.count(F.lit(1)).alias("n_runs"))
