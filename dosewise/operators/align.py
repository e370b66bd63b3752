"""Joins that bring trials of several sources together."""

from collections import deque

from pyspark.sql import functions as F

from ..plans.shapes import join_keys, with_index


def align_by_selection(events, selection, keys, index="idx"):
    """Events row ``selection[k]`` for epoch k; a group is valid only if its selection stays inside the table."""
    size = events.groupBy(*keys).agg((F.max(index) + 1).alias("__n"))
    top = selection.groupBy(*keys).agg(F.max(index).alias("__top"))
    valid = join_keys(top, size, list(keys)).where(F.col("__top") < F.col("__n")).select(*keys)
    return join_keys(join_keys(selection, valid, list(keys)), events, [*keys, index])


def align_by_sample(epochs, events, keys, sample="sample", strict=True):
    """Events on each epoch by sample; an epoch without an event raises in strict mode."""
    out = join_keys(epochs, events.withColumn("__hit", F.lit(True)), [*keys, sample], "left")
    matched = F.coalesce(F.col("__hit"), F.lit(False))
    if strict:
        matched = F.when(matched, True).otherwise(F.raise_error(F.lit("epoch without an event")).cast("boolean"))
    return out.withColumn("matched", matched).drop("__hit")


def alignment_report(aligned, keys, columns, n_expected=None, max_missing=0.1):
    """Per group: rows, rows missing every column, and validity (at most a tenth all-missing, expected length)."""
    blank = F.lit(True)
    for c in columns:
        blank = blank & F.col(c).isNull()
    out = aligned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("n_missing"))
    ok = F.col("n_missing") <= max_missing * F.col("n")
    return out.withColumn("valid", ok & (F.col("n") == n_expected) if n_expected is not None else ok)


def zip_behavior_to_events(events, behavior, keys, order, behavior_order, columns, target):
    """k-th behaviour row onto the k-th target event; longer behaviour is trimmed, shorter raises.

    ``columns`` overwrite on target rows only.
    """
    is_target = F.expr(target) if isinstance(target, str) else target
    hits = with_index(events.where(is_target), keys, order, "__k")
    beh = with_index(behavior, keys, behavior_order, "__k").select(*keys, "__k", *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__has"))
    zipped = join_keys(hits, beh, [*keys, "__k"], "left")
    checked = F.when(F.col("__has"), True).otherwise(F.raise_error(F.lit("behaviour is shorter than the target events")).cast("boolean"))
    zipped = zipped.withColumn("on_target", checked)
    zipped = zipped.withColumns({c: F.coalesce(F.col(f"__new_{c}"), F.col(c)) if c in events.columns else F.col(f"__new_{c}") for c in columns})
    zipped = zipped.drop("__k", "__has", *[f"__new_{c}" for c in columns])
    rest = events.where(~F.coalesce(is_target, F.lit(False))).withColumn("on_target", F.lit(False))
    return zipped.unionByName(rest, allowMissingColumns=True)


def drop_rejected_trials(trials, drop_log, keys=("subject", "run", "trial_idx"), fallback=None):
    """Trials not in the drop log by pair; a group with no pair match falls back on the original index.

    ``fallback`` is (group keys, index column of trials, index column of the log).
    """
    kept = trials.join(drop_log, list(keys), "left_anti")
    if fallback is None:
        return kept
    group, mine, theirs = fallback
    paired = trials.join(drop_log, list(keys), "left_semi").select(*group).distinct().withColumn("__paired", F.lit(True))
    log = drop_log.select(*group, F.col(theirs).alias(mine)).where(F.col(mine).isNotNull()).distinct().withColumn("__listed", F.lit(True))
    out = join_keys(join_keys(kept, paired, list(group), "left"), log, [*group, mine], "left")
    return out.where(F.col("__paired").isNotNull() | F.col("__listed").isNull()).drop("__paired", "__listed")


def build_drop_log(events, kept, reasons, keys):
    """Events outside the selection with their reasons joined by ``;``."""
    lost = events.join(kept, list(keys), "left_anti")
    text = reasons.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("drop_reason"))
    return join_keys(lost, text, list(keys), "left").withColumn("drop_reason", F.coalesce("drop_reason", F.lit("")))


def kept_semi(events, kept, keys):
    return events.join(kept, list(keys), "left_semi")


def subsequence_align(events, ratings, key, index="k", value="value", strict=True):
    """Walk the events in order and match the next rating within rel 1e-5 / abs 1e-4.

    The walk is sequential inside a subject by definition, so rows are sorted per
    subject and streamed in Arrow batches; the state is the queue of ratings not yet met,
    never the subject's rows.
    """
    ev = events.select(key, F.col(index).cast("long").alias("k"), F.col(value).cast("double").alias("ev"), F.lit(1).alias("has_ev"))
    rt = ratings.select(key, F.col(index).cast("long").alias("k"), F.col(value).cast("double").alias("rt"))
    rows = join_keys_full(ev, rt, key)

    def walk(batches):
        current, queue, head = None, deque(), 0
        for pdf in batches:
            keep, pos = [], []
            for s, has, e, r in zip(pdf[key], pdf["has_ev"], pdf["ev"], pdf["rt"]):
                if s != current:
                    if strict and queue:
                        raise ValueError(f"{len(queue)} ratings of {current} could not be matched")
                    current, queue, head = s, deque(), 0
                if r == r and r is not None:
                    queue.append(r)
                hit = False
                if has == 1 and queue and e is not None:
                    hit = abs(e - queue[0]) <= max(1e-5 * max(abs(e), abs(queue[0])), 1e-4)
                if hit:
                    queue.popleft()
                    head += 1
                keep.append(hit)
                pos.append(head - 1 if hit else -1)
            pdf = pdf.assign(matched=keep, rating_k=pos)
            yield pdf[pdf["has_ev"] == 1][[key, "k", "ev", "matched", "rating_k"]]
        if strict and queue:
            raise ValueError(f"{len(queue)} ratings of {current} could not be matched")

    kt = dict(events.dtypes)[key]
    out = rows.repartition(F.col(key)).sortWithinPartitions(key, "k").mapInPandas(
        walk, f"{key} {kt}, k bigint, ev double, matched boolean, rating_k bigint")
    return out.withColumn("rating_k", F.when(F.col("matched"), F.col("rating_k")))


def join_keys_full(ev, rt, key):
    return ev.join(rt, [key, "k"], "full").select(key, "k", "ev", F.coalesce("has_ev", F.lit(0)).alias("has_ev"), "rt")


def merge_predictions(left, right, keys=("subject", "trial"), names=("model", "baseline")):
    """Two models' predictions side by side."""
    a = left.select(*keys, "y_true", F.col("y_pred").alias(f"y_{names[0]}"))
    b = right.select(*keys, F.col("y_pred").alias(f"y_{names[1]}"))
    return join_keys(a, b, list(keys), "left")


def assemble_cross_modal(features, events, scores, keys=("subject", "k"), bands=("b0",), strict=True):
    """Features x events x scores by (subject, trial); per-band mean and SD over channels are added.

    Counts per subject must agree, else it raises (or the flag says so).
    """
    aggs = []
    for b in bands:
        x = F.when(F.col("band") == b, F.col("power"))
        aggs += [F.avg(x).alias(f"mean_{b}"), F.stddev_samp(x).alias(f"sd_{b}")]
    wide = features.groupBy(*keys).agg(*aggs)
    subject = [keys[0]]
    counts = None
    for name, df in (("features", wide), ("events", events), ("scores", scores)):
        n = df.groupBy(*subject).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        counts = n if counts is None else join_keys(counts, n, subject)
    same = (F.col("n_features") == F.col("n_events")) & (F.col("n_features") == F.col("n_scores"))
    flag = F.when(same, True).otherwise(F.raise_error(F.lit("trial counts differ")).cast("boolean")) if strict else same
    counts = counts.select(*subject, flag.alias("counts_equal"))
    out = join_keys(join_keys(wide, events, list(keys)), scores, list(keys))
    return join_keys(out, counts, subject)


def subjects_with_both(a, b, key="subject"):
    return a.select(key).intersect(b.select(key))


def run_lengths(events, keys, tr, tail=0.0):
    """Volumes of each run: up to the end of its last event and ``tail`` seconds more."""
    end = F.max(F.col("onset") + F.col("duration")) + tail
    return events.groupBy(*keys).agg((F.floor(end / tr) + 1).alias("n_volumes"))


def with_run_length(events, keys, n_volumes):
    if isinstance(n_volumes, int):
        return events.withColumn("n_volumes", F.lit(n_volumes))
    return join_keys(events, n_volumes.select(*keys, "n_volumes"), list(keys))


def events_by_volume(events, outliers, keys, tr, n_volumes):
    """Volumes covered by events, outlier volumes, and the share of outliers inside events (0 without outliers).

    Each interval is opened to the volumes it covers, so the range join is an equi join.  ``n_volumes`` is the length of
    every run, or a frame with the keys and ``n_volumes`` of each (``run_lengths``).
    """
    events = with_run_length(events, keys, n_volumes)
    start = F.greatest(F.floor(F.col("onset") / tr), F.lit(0))
    end = F.least(F.floor((F.col("onset") + F.col("duration")) / tr), F.col("n_volumes")) - 1
    covered = events.select(*keys, start.alias("a"), end.alias("b")).where(F.col("a") <= F.col("b"))
    covered = covered.select(*keys, F.explode(F.sequence("a", "b")).alias("volume")).distinct().withColumn("__in", F.lit(1))
    out = outliers.select(*keys, F.col("volume").cast("long").alias("volume")).distinct().withColumn("__out", F.lit(1))
    j = covered.join(out, [*keys, "volume"], "full")
    agg = j.groupBy(*keys).agg(F.count("__in").alias("n_heat"), F.count("__out").alias("n_outlier"),
                               F.count_if(F.col("__in").isNotNull() & F.col("__out").isNotNull()).alias("n_both"))
    return agg.withColumn("fraction", F.coalesce(F.try_divide(F.col("n_both"), F.col("n_outlier")), F.lit(0.0)))


def attach_covariates(rows, covariates, keys=("subject", "k")):
    """Temperature, trial and block per row; missing trial = k + 1, missing block = one number per subject."""
    out = join_keys(rows, covariates, list(keys), "left")
    subjects = with_index(rows.select(keys[0]).distinct(), [], [keys[0]], "__sid")
    out = join_keys(out, subjects, [keys[0]], "left")
    return out.withColumns({"trial": F.coalesce(F.col("trial"), F.col(keys[1]) + 1),
                            "block": F.coalesce(F.col("block").cast("long"), F.col("__sid"))}).drop("__sid")

