"""Bootstrap and permutation.  Draws are a function of (seed, replicate, position), so reruns and lost tasks agree."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import shuffles
from ..functions.draws import seeded_draw, seeded_hash
from ..functions.moments import clip, fisher_z, pair_aggs, r_of
from ..functions.special import let, normal_cdf, normal_quantile, t_quantile
from ..plans.shapes import join_keys, once, ordered_scan, quantiles, replicate_quantiles, replicates, with_index, with_midrank, with_row, with_totals
from ..session import stored
from .sequence import contiguous_clusters
from .stats import bh_fdr, complete, partial_residuals, ttest_one_sample


def with_replicates(df, n):
    return df.withColumn("rep", F.explode(replicates(n)))


def percentile_interval(boots, keys, value, level=0.95):
    """Percentile limits over replicates; a group holds one row per replicate, so its size is known."""
    tail = (1 - level) / 2
    ci = replicate_quantiles(boots, keys, value, {"ci_low": tail, "ci_high": 1 - tail})
    n = boots.groupBy(*keys).agg(F.count(value).alias("n_boot"))
    return join_keys(ci, n, list(keys)) if keys else with_row(ci, n)


def bootstrap_percentile(df, keys, x, y, order, n_boot=1000, seed=42, statistic="auc", level=0.95):
    """Percentile interval of AUC (y is 0/1, other rows do not count) or Spearman from row resamples; one-class resamples are skipped."""
    keys = list(keys)
    stat, limits = _resampled(df, keys, x, y, order, n_boot, seed, statistic, level if keys else None)
    far = percentile_interval(stat, keys, "stat", level) if stat is not None else None
    return far if limits is None else limits if far is None else limits.unionByName(far)


def resampled_statistic(df, keys, x, y, order, n_boot=1000, seed=42, statistic="auc"):
    """AUC or Spearman of every replicate of a row bootstrap: (keys, rep, stat), null where the resample has no value.

    Rows are numbered by x (then ``order``) inside their group and cut into slices of ``SLICE_ROWS``.  How many of a
    replicate's draws fall to a slice is a multinomial draw that every task repeats, and inside a slice each draw is a hash; so a
    task knows how often each of its rows is drawn, how many draws lie below them, and hence their average ranks by x.
    AUC closes over sums of these.  Spearman needs the ranks by y too: a group of one slice has them in the task; longer ones send,
    per block of replicates and distinct y, the counts and summed x ranks as packed arrays to slices of y.  No row is copied.
    """
    return _resampled(df, list(keys), x, y, order, n_boot, seed, statistic)[0]


def _resampled(df, keys, x, y, order, n_boot, seed, statistic, level=None):
    """(replicates, limits): ``resampled_statistic``; with a ``level``, groups of one slice give their interval in the task instead.

    No replicate of theirs leaves it, and groups of equal size share the counts of their draws.  Either frame may be missing.
    """
    ok = complete(df, x, y).select(*keys, *[c for c in order if c not in keys], F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    if statistic == "auc":
        ok = ok.where(F.col("__y").isin(0.0, 1.0))
    rows = with_index(ok, keys, ["__x", *order], "__k").select(*keys, "__k", "__x", "__y", F.floor(F.col("__k") / SLICE_ROWS).alias("__slice"))
    rows = stored(rows, "rows")
    ties = rows.groupBy(*keys, "__x").agg(F.min("__k").alias("__low"), F.max("__k").alias("__high")).where(F.floor(F.col("__low") / SLICE_ROWS) < F.floor(F.col("__high") / SLICE_ROWS))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    one_slice = F.col("__n") <= SLICE_ROWS
    any_long = (level is not None or statistic != "auc") and sizes.where(~one_slice).limit(1).count() > 0
    long_groups = statistic != "auc" and any_long
    if long_groups:
        # Slices of y hold about as many (distinct y, slice of x) entries; a single y has one entry per slice of x at most.
        ys = rows.groupBy(*keys, "__y").agg(F.count_distinct("__slice").alias("__e"))
        ys = ordered_scan(ys, keys, ["__y"], {"__b": ("sum_before", "__e")}).select(*keys, "__y", F.floor(F.coalesce("__b", F.lit(0)) / Y_ENTRIES).alias("__ys"))
        rows = join_keys(rows, ys, [*keys, "__y"])
    else:
        rows = rows.withColumn("__ys", F.lit(0).cast("long"))
    packed = rows.groupBy(*keys, "__slice").agg(F.array_sort(F.collect_list(F.struct("__k", "__x", "__y", "__ys"))).alias("__r"))
    r = F.col("__r")
    packed = packed.select(*keys, "__slice", r["__x"].alias("__x"), r["__y"].alias("__y"), r["__ys"].alias("__ys"), r[0]["__x"].alias("__x0"), F.element_at(r, -1)["__x"].alias("__x1"))
    packed = join_keys(packed, sizes, keys) if keys else with_row(packed, sizes)
    packed = join_keys(packed, ties.select(*keys, F.col("__x").alias("__x0"), F.col("__low").alias("__first")), [*keys, "__x0"], "left")
    packed = join_keys(packed, ties.select(*keys, F.col("__x").alias("__x1"), F.col("__high").alias("__last")), [*keys, "__x1"], "left")
    start = F.col("__slice") * SLICE_ROWS
    packed = packed.select(*keys, "__slice", "__x", "__y", "__ys", "__n", F.coalesce("__first", start).alias("__first"), F.coalesce("__last", start + F.size("__x") - 1).alias("__last"))
    packed = stored(packed, "slices")
    near = packed.where(one_slice)
    packed = packed if level is None else packed.where(~one_slice)
    packed = packed.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // BLOCK_REPS)))).repartition(*keys, "__slice", "__block")
    kinds = dict(packed.dtypes)
    head = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    n_keys, slice_rows, block_reps, at_once = len(keys), SLICE_ROWS, BLOCK_REPS, AT_ONCE

    def slices_of(batch):
        """(row, y, slices of y, group size, replicates, counts, centred ranks by x) for chunks of replicates whose arrays stay small."""
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            n, mine = col["__n"][i].as_py(), col["__slice"][i].as_py()
            cut = [slice_rows] * (n // slice_rows) + [n % slice_rows] * (n % slice_rows > 0)
            values, y, to = (col[c][i].values.to_numpy() for c in ("__x", "__y", "__ys"))
            a, b = col["__block"][i].as_py() * block_reps + 1, min(n_boot, (col["__block"][i].as_py() + 1) * block_reps)
            step = max(1, at_once // cut[0])
            for reps in (np.arange(c, min(c + step, b + 1)) for c in range(a, b + 1, step)):
                yield i, y, to, n, reps, *shuffles.drawn_midranks(values, seed, reps, mine, cut, col["__first"][i].as_py(), col["__last"][i].as_py())

    def closed(batches):
        """Sums per replicate: (drawn ones, their ranks) for AUC, (xy, xx, yy) for the correlation."""
        for batch in batches:
            at, numbers, sums = [], [], []
            for i, y, _, n, reps, m, rx in slices_of(batch):
                if statistic == "auc":
                    one = m * y
                    found = [one.sum(axis=1), (one * rx).sum(axis=1)]
                else:
                    _, c, p = shuffles.tied_sums(y, m, m * rx)
                    ry = np.cumsum(c, axis=1) - c + (c + 1) / 2 - (n + 1) / 2
                    found = [(p * ry).sum(axis=1), (m * rx * rx).sum(axis=1), (c * ry * ry).sum(axis=1)]
                at.append(np.full(len(reps), i))
                numbers.append(reps)
                sums.append(np.stack(found))
            if at:
                kept = [batch.column(k).take(pa.array(np.concatenate(at))) for k in range(n_keys)]
                sums = np.concatenate(sums, axis=1)
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(numbers)), *[pa.array(v) for v in sums]], names=[*batch.schema.names[:n_keys], "rep", *[f"s{j}" for j in range(len(sums))]])

    near_limits = None
    if level is not None:
        tail = (1 - level) / 2

        def limits(batches):
            counts = {}
            for batch in batches:
                col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                low, high, many = [], [], []
                for i in range(batch.num_rows):
                    values, y = (col[c][i].values.to_numpy() for c in ("__x", "__y"))
                    n, found = len(values), []
                    step = max(1, at_once // n)
                    for a in range(1, n_boot + 1, step):
                        reps = np.arange(a, min(a + step, n_boot + 1))
                        if (n, a) not in counts:
                            if sum(m.size for m in counts.values()) > 4 * at_once:
                                counts.clear()
                            counts[n, a] = shuffles.slice_counts(seed, reps, 0, np.full(len(reps), n), n)
                        m, rx = shuffles.drawn_midranks(values, seed, reps, 0, [n], 0, n - 1, counts[n, a])
                        if statistic == "auc":
                            one = m * y
                            p, u = one.sum(axis=1), (one * rx).sum(axis=1)
                            both = (p > 0) & (p < n)
                            found.append((u[both] + p[both] * (n - p[both]) / 2) / (p[both] * (n - p[both])))
                        else:
                            _, c, p = shuffles.tied_sums(y, m, m * rx)
                            ry = np.cumsum(c, axis=1) - c + (c + 1) / 2 - (n + 1) / 2
                            xy, xx, yy = (p * ry).sum(axis=1), (m * rx * rx).sum(axis=1), (c * ry * ry).sum(axis=1)
                            both = (xx > 1e-9) & (yy > 1e-9)
                            found.append(xy[both] / np.sqrt(xx[both] * yy[both]))
                    found = np.concatenate(found)
                    ends = np.quantile(found, [tail, 1 - tail]).tolist() if len(found) else [None, None]
                    low.append(ends[0])
                    high.append(ends[1])
                    many.append(len(found))
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(n_keys)], pa.array(low, pa.float64()), pa.array(high, pa.float64()), pa.array(many, pa.int64())], names=[*batch.schema.names[:n_keys], "ci_low", "ci_high", "n_boot"])

        # Groups of equal size meet in a task, for their counts; a stated number, as small rows that take long would be put together again.
        near_limits = near.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__n", *keys).mapInArrow(limits, f"{head}ci_low double, ci_high double, n_boot long")
        if not any_long:
            return None, near_limits
    if statistic == "auc":
        got = packed.mapInArrow(closed, f"{head}rep long, s0 double, s1 double").groupBy(*keys, "rep").agg(F.sum("s0").alias("p"), F.sum("s1").alias("u"))
        got = join_keys(got, sizes, keys) if keys else with_row(got, sizes)
        p, n = F.col("p"), F.col("__n")
        return got.select(*keys, "rep", F.when((p > 0) & (p < n), (F.col("u") + p * (n - p) / 2) / (p * (n - p))).alias("stat")), near_limits
    sums = packed.where(one_slice).mapInArrow(closed, f"{head}rep long, s0 double, s1 double, s2 double")
    if long_groups:
        def sent(batches):
            for batch in batches:
                for i, y, to, n, reps, m, rx in slices_of(batch):
                    for ys in np.unique(to):
                        own = to == ys
                        held, c, p = shuffles.tied_sums(y[own], m[:, own], m[:, own] * rx[:, own])
                        xx = (m[:, own] * rx[:, own] * rx[:, own]).sum(axis=1)
                        key = [batch.column(k).slice(i, 1) for k in range(n_keys)]
                        flat = [pa.array([v.ravel()], pa.list_(pa.float64())) for v in (held, c.T, p.T, xx)]
                        yield pa.RecordBatch.from_arrays([*key, pa.array([int(ys)], pa.int64()), pa.array([int(reps[0])], pa.int64()), *flat], names=[*batch.schema.names[:n_keys], "__ys", "__rep", "y", "c", "p", "xx"])

        def joined(table):
            """Sums of a slice of y, with ranks counted from the slice's own lowest draw."""
            values = np.concatenate([v.values.to_numpy() for v in table["y"]])
            width = len(table["xx"][0].values)
            c, p = (np.concatenate([v.values.to_numpy() for v in table[name]]).reshape(-1, width).T for name in ("c", "p"))
            _, c, p = shuffles.tied_sums(values, c, p)
            ry = np.cumsum(c, axis=1) - c + (c + 1) / 2
            found = [c.sum(axis=1), p.sum(axis=1), (p * ry).sum(axis=1), (c * ry).sum(axis=1), (c * ry * ry).sum(axis=1), np.sum([v.values.to_numpy() for v in table["xx"]], axis=0)]
            same = pa.array(np.zeros(width, np.int64))
            taken = [table.column(k).take(same) for k in range(n_keys)]
            return pa.Table.from_arrays([*taken, table["__ys"].take(same), pa.array(table["__rep"][0].as_py() + np.arange(width)), *[pa.array(v) for v in found]], names=[*table.schema.names[:n_keys], "__ys", "rep", *[f"f{j}" for j in range(6)]])

        parts = packed.where(~one_slice).mapInArrow(sent, f"{head}__ys long, __rep long, y array<double>, c array<double>, p array<double>, xx array<double>")
        parts = parts.groupBy(*keys, "__ys", "__rep").applyInArrow(joined, f"{head}__ys long, rep long, " + ", ".join(f"f{j} double" for j in range(6)))
        by = Window.partitionBy(*keys, "rep")
        earlier = F.coalesce(F.sum("f0").over(by.orderBy("__ys").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        parts = parts.withColumn("__off", earlier - (F.sum("f0").over(by) + 1) / 2)
        n, p, q, v, w, off = (F.col(c) for c in ("f0", "f1", "f2", "f3", "f4", "__off"))
        parts = parts.groupBy(*keys, "rep").agg(F.sum(q + off * p).alias("s0"), F.sum("f5").alias("s1"), F.sum(w + 2 * off * v + off * off * n).alias("s2"))
        sums = sums.unionByName(parts)
    spread = F.col("s1") * F.col("s2")
    return sums.select(*keys, "rep", F.when((F.col("s1") > 1e-9) & (F.col("s2") > 1e-9), F.col("s0") / F.sqrt(spread)).alias("stat")), near_limits


def resampled_sums(sums, subject, keys, n_boot, seed):
    """Sums over resampled subjects: (rep, keys, the other columns), from per-subject sums.

    Subjects are dealt to slices by a hash; how many of a replicate's draws fall to each slice is a multinomial draw that every
    task repeats from the seed, and inside a slice each draw is a hash of (replicate, slice, number).  So a slice knows the counts
    of its own subjects, multiplies them into its sums, and nothing but sums per replicate is moved.
    """
    keys = list(keys)
    cols = [c for c in sums.columns if c not in (subject, *keys)]
    n_slices = -(-(sums.agg(F.count_distinct(F.coalesce(F.xxhash64(subject), F.lit(0)))).first()[0] or 1) // SLICE_ROWS)
    named = sums.withColumn("__acc", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit(""))
    at = F.pmod(F.xxhash64(subject), F.lit(n_slices)).alias("__slice")
    rows = named.select(at, "__acc", F.col(subject).alias("__subject"), F.array(*[F.col(c).cast("double") for c in cols]).alias("__x"))
    by_subject = rows.groupBy("__slice", "__subject").agg(F.array_sort(F.collect_list(F.struct("__acc", "__x"))).alias("__r"))
    packed = by_subject.groupBy("__slice").agg(F.array_sort(F.collect_list(F.struct("__subject", "__r"))).alias("__s"))
    s = F.col("__s")
    packed = stored(packed.select("__slice", F.size(s).alias("__n"), F.transform(s, lambda v: F.size(v["__r"])).alias("__many"), F.flatten(F.transform(s, lambda v: v["__r"]["__acc"])).alias("__acc"),
                                  F.flatten(F.flatten(F.transform(s, lambda v: v["__r"]["__x"]))).alias("__x")), "subjects")
    sizes = {r["__slice"]: r["__n"] for r in packed.select("__slice", "__n").collect()}  # one number per 32,768 subjects
    order, n_subjects, block_reps, at_once = sorted(sizes), sum(sizes.values()), BLOCK_REPS, AT_ONCE
    dealt = packed.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // block_reps)))).repartition("__slice", "__block")

    def run(batches):
        into = shuffles.Rows(0)
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                mine, block, n = col["__slice"][i].as_py(), col["__block"][i].as_py(), col["__n"][i].as_py()
                reps = np.arange(block * block_reps + 1, min(n_boot, (block + 1) * block_reps) + 1)
                drawn = lambda now: shuffles.draw_counts(seed, now, order.index(mine), [sizes[k] for k in order], n_subjects)
                many = col["__many"][i].values.to_numpy()
                part = shuffles.Slice(col["__x"][i].values, col["__acc"][i].values)
                for now, got in shuffles.drawn_sums(part, many, reps, drawn, at_once):
                    yield from into.add(batch, i, part, now, got) or ()
        yield from into.end()

    out = dealt.mapInArrow(run, "__acc string, rep long, sums array<double>")
    out = out.groupBy("__acc", "rep").agg(*[F.sum(F.get("sums", F.lit(i + 2))).alias(c) for i, c in enumerate(cols)])
    if not keys:
        return out.drop("__acc")
    names = named.select("__acc", *keys).groupBy("__acc").agg(*[F.first(k).alias(k) for k in keys])
    return out.join(names, "__acc").select("rep", *keys, *cols)


# Sufficient statistics of a pair and the statistics they close over.
PAIR_SUMS = {
    "n": lambda x, y: F.count(F.lit(1)), "sx": lambda x, y: F.sum(x), "sy": lambda x, y: F.sum(y),
    "sxx": lambda x, y: F.sum(x * x), "syy": lambda x, y: F.sum(y * y), "sxy": lambda x, y: F.sum(x * y),
    "see": lambda x, y: F.sum((y - x) * (y - x)), "sae": lambda x, y: F.sum(F.abs(y - x)),
}


def pair_statistic(name):
    """slope, r, r2 (y is truth, x prediction), mae, rmse or mean (of y) as an expression over the sums."""
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    vx, vy, c = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
    return {
        "slope": F.when(vx > 1e-9, c / vx), "r": F.when((vx > 1e-9) & (vy > 1e-9), c / F.sqrt(vx * vy)),
        "r2": F.when(vy > 1e-9, 1 - F.col("see") / vy), "mae": F.col("sae") / n, "rmse": F.sqrt(F.col("see") / n), "mean": sy / n,
    }[name]


def subject_sums(df, subject, x, y, keys=()):
    ok = complete(df, x, y)
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return ok.groupBy(*keys, subject).agg(*[f(a, b).alias(k) for k, f in PAIR_SUMS.items()])


def cluster_bootstrap(sums, subject, statistic, keys=(), n_boot=1000, seed=42, level=0.95, samples=False):
    """Interval of a statistic when whole subjects are resampled.

    A replicate is one row of sums (``resampled_sums``); neither trials nor subjects are copied.
    ``statistic`` is a name of ``pair_statistic`` or an expression over the summed columns.
    """
    close = pair_statistic(statistic) if isinstance(statistic, str) else statistic
    sums = once(sums)
    cols = [c for c in sums.columns if c not in (subject, *keys)]
    g = resampled_sums(sums, subject, keys, n_boot, seed)
    boots = g.select("rep", *keys, close.alias("stat"))
    if samples:
        return boots
    boots = once(boots)
    point = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols]).select(*keys, close.alias("estimate"))
    ci = percentile_interval(boots, keys, "stat", level)
    if keys:
        return join_keys(point, ci, list(keys))
    return with_row(point, ci)


def jackknife(sums, subject, statistic, keys=()):
    """The statistic without each subject, by subtracting its sums from the totals."""
    close = pair_statistic(statistic) if isinstance(statistic, str) else statistic
    cols = [c for c in sums.columns if c not in (subject, *keys)]
    tot = with_totals(sums, keys, {f"__t_{c}": F.sum(c) for c in cols})
    left = tot.select(*keys, subject, *[(F.col(f"__t_{c}") - F.col(c)).alias(c) for c in cols])
    return left.where(F.col("n") > 0).select(*keys, subject, close.alias("stat"))


def bca_interval(sums, subject, statistic, keys=(), n_boot=1000, seed=42, level=0.95, clip_to=(0.001, 0.999)):
    """Bias-corrected and accelerated interval over subjects; percentile limits where it has no value."""
    keys = list(keys)
    group = keys or ["__g"]
    if not keys:
        sums = sums.withColumn("__g", F.lit(0))
    # One row per subject, then one per replicate: written once, read by each step below.
    sums = stored(sums, "sums")
    boots = stored(cluster_bootstrap(sums, subject, statistic, group, n_boot, seed, samples=True), "boots")
    cols = [c for c in sums.columns if c not in (subject, *group)]
    close = pair_statistic(statistic) if isinstance(statistic, str) else statistic
    point = sums.groupBy(*group).agg(*[F.sum(c).alias(c) for c in cols]).select(*group, close.alias("estimate"))
    point = join_keys(point, percentile_interval(boots, group, "stat", level), group)
    jk = jackknife(sums, subject, statistic, group)
    jm = with_totals(jk, group, {"__jm": F.avg("stat")}).withColumn("__d", F.col("__jm") - F.col("stat"))
    acc = jm.groupBy(*group).agg(F.sum(F.col("__d") * F.col("__d") * F.col("__d")).alias("c3"), F.sum(F.col("__d") * F.col("__d")).alias("c2"))
    b = join_keys(boots.where("stat is not null"), point.select(*group, "estimate"), group)
    share = b.groupBy(*group).agg(F.avg((F.col("stat") < F.col("estimate")).cast("double")).alias("share"))
    z0 = normal_quantile(F.col("share"))
    a = F.coalesce(F.try_divide(F.col("c3"), 6 * F.pow("c2", F.lit(1.5))), F.lit(0.0))
    tail = (1 - level) / 2
    lim = join_keys(share, acc, group).select(*group, z0.alias("z0"), a.alias("a"))

    def adjusted(prob):
        z = normal_quantile(F.lit(prob))
        q = normal_cdf(F.col("z0") + let(lambda s, a: F.try_divide(s, 1 - a * s), s=F.col("z0") + z, a=F.col("a")))
        return F.greatest(F.lit(clip_to[0]), F.least(F.lit(clip_to[1]), q))

    lim = lim.select(*group, F.when(F.col("z0").isNotNull(), adjusted(tail)).alias("p_lo"), F.when(F.col("z0").isNotNull(), adjusted(1 - tail)).alias("p_hi"))
    # The probabilities differ per group, so the quantile is read off the ordered replicates.
    ranked = with_index(boots.where("stat is not null"), group, ["stat", "rep"], "__k")
    ranked = join_keys(with_totals(ranked, group, {"__n": F.count("stat")}), lim, group)
    at = lambda pos: F.max(F.when(F.col("__k") == pos, F.col("stat")))
    pos = {e: F.col(f"p_{e}") * (F.col("__n") - 1) for e in ("lo", "hi")}
    q = ranked.groupBy(*group).agg(*[x for e in ("lo", "hi") for x in (at(F.floor(pos[e])).alias(f"f_{e}"), at(F.ceil(pos[e])).alias(f"c_{e}"), F.max(pos[e] - F.floor(pos[e])).alias(f"w_{e}"))])
    q = q.select(*group, *[(F.col(f"f_{e}") + (F.col(f"c_{e}") - F.col(f"f_{e}")) * F.col(f"w_{e}")).alias(f"bca_{e}") for e in ("lo", "hi")])
    out = join_keys(point, q, group, "left")
    return out.select(*keys, "estimate", F.coalesce("bca_lo", "ci_low").alias("ci_low"), F.coalesce("bca_hi", "ci_high").alias("ci_high"), "n_boot")


def permuted(df, keys, value, order, n_perm, seed):
    """Every replicate's shuffle of ``value`` inside ``keys``: (keys, rep, __k, value).

    Row k receives the value whose draw has rank k in the replicate.
    """
    idx = with_index(df.select(*keys, *order, value), keys, list(order), "__k")
    shuffled = with_replicates(idx.select(*keys, "__k", value), n_perm)
    shuffled = shuffled.withColumn("__h", seeded_hash(seed, F.col("rep"), F.col("__k")))
    shuffled = with_index(shuffled.drop("__k").withColumn("__v", F.col(value)), [*keys, "rep"], ["__h", "__v"], "__k")
    return shuffled.select(*keys, "rep", "__k", value)


SLICE_ROWS = 32768
BLOCK_REPS = 125
AT_ONCE = 1 << 20
HELD = 1 << 24
HELD_LINES = 1 << 26
TILE_SLICES = 32
FAR_TASKS = 48
Y_ENTRIES = 4096
TIE = 1e-9


def group_number(keys):
    """A number below 2^48 for each group, from its keys as text."""
    text = F.concat_ws(":", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def shuffle_slices(df, keys, xs, y, order, centre=None, acc=None):
    """Rows of ``df`` packed for shuffling: (keys, __slice, __y, __x, __acc, __n, __group), at most ``SLICE_ROWS`` rows each, stored."""
    keys = list(keys)
    x = F.col(xs) if isinstance(xs, str) else F.array(*[F.col(c).cast("double") for c in xs])
    base = with_index(df.select(*keys, *[c for c in order if c not in keys], *[c for c in (centre or []) if c not in keys], *([F.col(acc).alias("__acc")] if acc else []),
                                x.alias("__x"), F.col(y).cast("double").alias("__y")), keys, list(order), "__k")
    if centre is not None:
        width = len(xs)
        base = with_totals(once(base), centre, {"__my": F.avg("__y"), **{f"__m{i}": F.avg(F.get("__x", F.lit(i))) for i in range(width)}})
        base = base.withColumns({"__y": F.col("__y") - F.col("__my"), "__x": F.array(*[F.get("__x", F.lit(i)) - F.col(f"__m{i}") for i in range(width)])})
    base = base.withColumn("__acc", F.col("__acc") if acc else F.lit(0))
    packed = base.withColumn("__slice", F.floor(F.col("__k") / SLICE_ROWS)).groupBy(*keys, "__slice").agg(F.array_sort(F.collect_list(F.struct("__k", "__x", "__y", "__acc"))).alias("__r"))
    r = F.col("__r")
    packed = packed.select(*keys, "__slice", r["__y"].alias("__y"), F.flatten(r["__x"]).alias("__x"), r["__acc"].alias("__acc"))
    return stored(with_totals(packed, keys, {"__n": F.sum(F.size("__y"))}).withColumn("__group", group_number(keys)), "slices")


def key_types(packed, keys):
    kinds = dict(packed.dtypes)
    return "".join(f"`{k}` {kinds[k]}, " for k in keys)


def sums_schema(packed, keys):
    return f"{key_types(packed, keys)}__acc {dict(packed.dtypes)['__acc'][len('array<'):-1]}, rep long, sums array<double>"


def near_sums(packed, keys, n_perm, seed, schema, sink):
    """Sums against shuffles for the groups of one slice, put into the rows of ``schema`` by ``sink``, one for each task.

    A group is sent once for each block of replicates (all of them, if the group is short).
    """
    block_reps, at_once = BLOCK_REPS, AT_ONCE
    size = F.greatest(F.lit(block_reps), F.floor(F.lit(at_once) / F.col("__n")))
    dealt = packed.where(F.col("__n") <= SLICE_ROWS).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.lit(n_perm - 1) / size)))).repartition(*keys, "__block")

    def run(batches):
        into = sink()
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                n, block, group = (col[c][i].as_py() for c in ("__n", "__block", "__group"))
                part, ys = shuffles.Slice(col["__x"][i].values, col["__acc"][i].values), col["__y"][i].values.to_numpy()
                each, step = max(block_reps, at_once // n), max(1, at_once // n)
                for a in range(block * each + 1, min(n_perm, (block + 1) * each) + 1, step):
                    reps = np.arange(a, min(a + step, (block + 1) * each + 1, n_perm + 1))
                    yield from into.add(batch, i, part, reps, part.sums(part.received(shuffles.round_keys(seed, group, reps), 0, n, ys, 0))) or ()
        yield from into.end()

    return dealt.mapInArrow(run, schema)


def far_sums(packed, keys, n_perm, seed, sink=None, schema=None, told=(), held=None):
    """The same for groups of many slices, as rows (keys, acc, rep, sums) to be added up, or what ``sink`` makes of them.

    A ``sink`` gets the sums of a slice whole if all of y is held; it finds the columns ``told`` of the slice in its batch.

    A task takes a tile of slices and some of the replicates, and gets the y of all slices one after the other.  It works out from
    which place each of its rows gets its value (the permutation backwards), holds at most ``HELD`` values of y at a time, and
    sums what they give.  So no value is sent per replicate: y travels once for each task, and there are at most ``FAR_TASKS`` tasks
    or one for each tile.
    """
    far = packed.where(F.col("__n") > SLICE_ROWS)
    width = far.select((F.size("__x") / F.size("__y")).cast("int").alias("w")).limit(1).first()
    if width is None:
        return None
    slice_rows, at_once, held = SLICE_ROWS, AT_ONCE, held or HELD
    tile = max(1, TILE_SLICES // max(1, width[0] // 4))
    far = far.withColumn("__tiles", F.ceil(F.col("__n") / (slice_rows * tile)))
    far = far.withColumn("__blocks", F.greatest(F.lit(1), F.least(F.lit(-(-n_perm // BLOCK_REPS)), F.floor(F.lit(FAR_TASKS) / F.col("__tiles")))))
    count = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    side = [*keys, "__tile", "__block", "__slice", "__n", "__group", "__blocks"]
    targets = far.withColumn("__tile", F.floor(F.col("__slice") / tile)).withColumn("__block", count("__blocks")).select(*side, F.lit(0).alias("__kind"), F.lit(None).cast("array<double>").alias("__y"), "__x", "__acc", *told)
    sources = far.withColumn("__tile", count("__tiles")).withColumn("__block", count("__blocks"))
    sources = sources.select(*side, F.lit(1).alias("__kind"), "__y", F.lit(None).cast("array<double>").alias("__x"), F.lit(None).cast(dict(far.dtypes)["__acc"]).alias("__acc"), *[F.lit(None).cast(dict(far.dtypes)[c]).alias(c) for c in told])
    at = [*keys, "__tile", "__block"]
    dealt = targets.unionByName(sources).repartition(*at).sortWithinPartitions(*at, "__kind", "__slice")
    n_keys = len(keys)
    sink = sink or (lambda: shuffles.Rows(n_keys))

    def run(batches):
        into, now, tiles, ys, low, filled = sink(), None, [], None, 0, 0

        def work():
            """Sums of the tile against the values held."""
            values = ys[:filled]
            n, group, first, last = tiles[0][4:]
            step = max(1, at_once // max(t[3].rows for t in tiles))
            for a in range(first, last + 1, step):
                reps = np.arange(a, min(a + step, last + 1))
                keyed = shuffles.round_keys(seed, group, reps)
                tables = shuffles.turn_tables(keyed, n, back=True)  # for all slices of the tile
                for batch, i, start, part, *_ in tiles:
                    yield from into.add(batch, i, part, reps, part.sums(part.received(keyed, start, n, values, low, tables))) or ()

        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                here = tuple(batch.column(k)[i].as_py() for k in range(n_keys + 2))
                if here != now:
                    if filled:
                        yield from work()
                    now, tiles, filled = here, [], 0
                mine = col["__slice"][i].as_py()
                if col["__kind"][i].as_py() == 0:
                    n, group, blocks = (col[c][i].as_py() for c in ("__n", "__group", "__blocks"))
                    each, block = -(-n_perm // blocks), here[-1]
                    tiles.append((batch.slice(i, 1).select([*range(n_keys), *[batch.schema.get_field_index(c) for c in told]]), 0, mine * slice_rows, shuffles.Slice(col["__x"][i].values, col["__acc"][i].values), n, group, block * each + 1, min(n_perm, (block + 1) * each)))
                    continue
                if not filled:
                    low, most = mine * slice_rows, min(col["__n"][i].as_py(), -(-held // slice_rows) * slice_rows)
                    ys = ys if ys is not None and len(ys) >= most else np.empty(most)
                part = col["__y"][i].values.to_numpy()
                ys[filled:filled + len(part)] = part
                filled += len(part)
                if filled >= held:
                    yield from work()
                    filled = 0
        if filled:
            yield from work()
        yield from into.end()

    return dealt.mapInArrow(run, schema or sums_schema(packed, keys))


def shuffled_sums(df, keys, xs, y, order, n_perm, seed, centre=None, acc=None):
    """Sums against ``n_perm`` shuffles of y inside ``keys``: (keys, acc, rep, sy, syy, sxy as an array over ``xs``).

    In replicate r the row at place k of its group gives its y to the row at place p_r(k), a keyed permutation that is
    computed from k alone, forwards or backwards; so no replicate is sorted and no row is copied per replicate.  Groups lie in
    slices of at most ``SLICE_ROWS`` rows, one row of arrays each (``near_sums``, ``far_sums``).  With ``centre`` (keys), x and y are
    first reduced by their means over these keys.  ``acc`` names a column by whose values of the receiving rows the sums are kept
    apart.  ``xs`` are column names, or one name of an array column.
    """
    return shuffled_from(shuffle_slices(df, keys, xs, y, order, centre, acc), keys, xs, n_perm, seed, acc)


def shuffled_from(packed, keys, xs, n_perm, seed, acc=None):
    """``shuffled_sums`` of packed slices."""
    keys = list(keys)
    n_keys = len(keys)
    out = near_sums(packed, keys, n_perm, seed, sums_schema(packed, keys), lambda: shuffles.Rows(n_keys))
    far = far_sums(packed, keys, n_perm, seed)
    out = out if far is None else out.unionByName(far)
    width = (len(xs) if not isinstance(xs, str) else None) or (packed.select((F.size("__x") / F.size("__y")).cast("int").alias("w")).limit(1).first() or [0])[0]
    got = out.groupBy(*keys, "__acc", "rep").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"__s{i}") for i in range(width + 2)])
    return got.select(*keys, *([F.col("__acc").alias(acc)] if acc else []), "rep", F.col("__s0").alias("sy"), F.col("__s1").alias("syy"), F.array(*[F.col(f"__s{i + 2}") for i in range(width)]).alias("sxy"))


def shuffled_lines(df, group, x, y, order, n_perm, seed):
    """R2 of the lines of all other groups, pooled over the groups, against shuffles of y over all rows: (rep, r2).

    The score is a sum over groups that is quadratic in their sums and in the sum of x y over all rows (``shuffles.line_terms``), so a
    task adds it up over its groups; a row per group and replicate leaves it only for a group that is cut by the end of a slice.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    centred = with_row(df, df.agg(F.avg(a).alias("__mx"), F.avg(b).alias("__my"))).withColumns({"__x": a - F.col("__mx"), "__y": b - F.col("__my")})
    sums = centred.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("n"), F.sum("__x").alias("sx"), F.sum(F.col("__x") * F.col("__x")).alias("sxx"), F.sum(F.col("__y") * F.col("__y")).alias("syy"))
    t = stored(with_totals(sums, [], {f"t{c}": F.sum(c) for c in ("n", "sx", "sxx", "syy")}).where("tn > n"), "groups")
    n, tn, sx, sxx = F.col("n"), F.col("tn") - F.col("n"), F.col("sx"), F.col("sxx")
    m = (F.col("tsx") - sx) / tn
    vx = F.col("tsxx") - sxx - (F.col("tsx") - sx) * m
    w = F.when(F.abs(vx) > 1e-9, 1 / vx).otherwise(0.0)
    numbers = {"n": n.cast("double"), "tn": tn.cast("double"), "m": m, "w": w, "cx": sx - m * n, "cxx": sxx - 2 * m * sx + m * m * n}
    fixed = t.select("__g", *[v.alias(f"__{k}") for k, v in numbers.items()])
    fixed_columns = [F.col(f"__{k}") for k in numbers]
    packed = shuffle_slices(df, [], [x], y, order, centre=[], acc=group)
    of = packed.select("__slice", F.explode(F.array_distinct("__acc")).alias("__g"))
    of = join_keys(of, fixed, ["__g"]).groupBy("__slice").agg(F.collect_list(F.struct("__g", F.array(*fixed_columns).alias("f"))).alias("__f"))
    of = of.select("__slice", F.col("__f")["__g"].alias("__of"), F.flatten(F.col("__f")["f"]).alias("__fixed"))
    packed = stored(packed.join(of, "__slice"), "slices")
    if (packed.agg(F.max("__n")).first()[0] or 0) > HELD_LINES:
        # y is not held whole, so a task has no whole sums: a row for each group and replicate
        null = shuffled_from(packed, [], [x], n_perm, seed, group)
        parts = null.select(F.col(group).alias("__g"), "rep", "sy", F.get("sxy", F.lit(0)).alias("sxy"))
        pooled = None
    else:
        of_acc = StructType.fromDDL(sums_schema(packed, []))
        kind = to_arrow_type(of_acc["__acc"].dataType)
        sink = lambda: shuffles.Lines(kind)
        schema = sums_schema(packed, [])
        out = near_sums(packed, [], n_perm, seed, schema, sink)
        far = far_sums(packed, [], n_perm, seed, sink, schema, ("__of", "__fixed"), HELD_LINES)
        out = stored(out if far is None else out.unionByName(far), "lines")
        at = lambda i: F.sum(F.get("sums", F.lit(i)))
        pooled = out.where(F.size("sums") == 3).groupBy("rep").agg(at(0).alias("S"), at(1).alias("q0"), at(2).alias("q1"))
        parts = out.where(F.size("sums") == 2).groupBy(F.col("__acc").alias("__g"), "rep").agg(at(0).alias("sy"), at(1).alias("sxy"))
    terms = shuffles.line_terms(F.col("sy"), F.col("sxy"), *fixed_columns)
    terms = join_keys(parts, fixed, ["__g"]).select("rep", *[v.alias(k) for k, v in zip(("S", "q0", "q1"), terms)])
    terms = terms if pooled is None else terms.unionByName(pooled)
    terms = terms.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("S", "q0", "q1")])
    whole = t.agg(F.sum(w * w * numbers["cxx"]).alias("q2"), F.sum("syy").alias("vy"))
    j = with_row(terms, whole)
    s = F.col("S")
    return j.select("rep", F.when(F.col("vy") > 1e-9, 1 - (F.col("vy") + F.col("q0") + s * F.col("q1") + s * s * F.col("q2")) / F.col("vy")).alias("r2"))


def shuffled_totals(packed, keys, outer, width, n_perm, seed, lines=1, squares=0):
    """Sums of x y against shuffles inside ``keys``, weighed and added up over the groups of equal first ``outer`` keys: (outer keys, rep, sums).

    Weights are a column __w of ``packed`` (``shuffles.Totals``).  A task adds up its groups, so no row is made per group and replicate.
    """
    kept = keys[:outer]
    schema = f"{key_types(packed, kept)}rep long, sums array<double>"
    out = near_sums(packed, keys, n_perm, seed, schema, lambda: shuffles.Totals(outer, lines, squares))
    far = far_sums(packed, keys, n_perm, seed)
    if far is not None:
        whole = far.groupBy(*keys, "rep").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"__s{i}") for i in range(width + 2)])
        whole = whole.withColumn("__s", F.array(*[F.col(f"__s{i}") for i in range(width + 2)]))
        weighed = "__w" in packed.columns
        if weighed:
            whole = join_keys(whole, packed.where(F.col("__slice") == 0).select(*keys, "__w"), keys)

        def run(batches):
            into = shuffles.Totals(outer, lines, squares)
            for batch in batches:
                rep, s = batch.schema.get_field_index("rep"), batch.schema.get_field_index("__s")
                for i in range(batch.num_rows):
                    yield from into.add(batch, i, None, np.array([batch.column(rep)[i].as_py()]), batch.column(s)[i].values.to_numpy().reshape(1, 1, -1)) or ()
            yield from into.end()

        out = out.unionByName(whole.select(*keys, "rep", "__s", *(["__w"] if weighed else [])).mapInArrow(run, schema))
    size = width * (lines + squares)
    got = out.groupBy(*kept, "rep").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"__s{i}") for i in range(size)])
    return got.select(*kept, "rep", F.array(*[F.col(f"__s{i}") for i in range(size)]).alias("sums"))


def permutation_test(df, keys, x, y, order, n_perm=1000, seed=42, within=()):
    """Two-sided p of r(x, y) on the given columns (ranks or residuals), shuffling y inside ``within`` too.

    Only the cross product changes with a shuffle.  A group that is shuffled as one is counted out where it lies; with ``within`` a
    replicate is one number per group of ``keys``.
    """
    keys = list(keys)
    inner = [*keys, *within]
    ok = once(complete(df, x, y).select(*dict.fromkeys([*inner, *order, x, y])))
    obs = ok.groupBy(*keys).agg(*pair_aggs(x, y)).withColumn("r", r_of())
    spread = F.sqrt(F.col("vx") * F.col("vy")) * (F.col("n") - 1)
    obs = obs.select(*keys, "r", "n", F.when(F.col("r").isNotNull(), spread).alias("__spread"))
    packed = shuffle_slices(ok, inner, [x], y, order, centre=keys)

    def counted(null):
        """(keys, ge, n_perm) of rows with the cross product __c of a replicate."""
        j = join_keys(null, obs, keys) if keys else with_row(null, obs)
        j = j.withColumn("r_null", clip(F.col("__c") / F.col("__spread"), -1, 1))
        return j.groupBy(*keys).agg(F.count_if(F.abs("r_null") >= F.abs("r") - 1e-12).alias("ge"), F.count("r_null").alias("n_perm"), F.count(F.lit(1)).alias("__made")).where("__made > 0").drop("__made")

    if within or not keys:
        null = shuffled_totals(packed, inner, len(keys), 1, n_perm, seed)
        got = counted(null.select(*keys, "rep", F.get("sums", F.lit(0)).alias("__c")))
    else:
        n_keys = len(keys)
        judged = join_keys(packed, obs.select(*keys, F.col("r").alias("__r"), "__spread"), keys)
        got = near_sums(judged, keys, n_perm, seed, f"{key_types(packed, keys)}ge long, n_perm long", lambda: shuffles.Counts(n_keys))
        got = got.groupBy(*keys).agg(F.sum("ge").alias("ge"), F.sum("n_perm").alias("n_perm"))
        far = far_sums(packed, keys, n_perm, seed)
        if far is not None:
            got = got.unionByName(counted(far.groupBy(*keys, "rep").agg(F.sum(F.get("sums", F.lit(2))).alias("__c"))))
    out = join_keys(obs, got, keys) if keys else with_row(got, obs)
    return out.select(*keys, "r", "n", "n_perm", ((F.col("ge") + 1) / (F.col("n_perm") + 1)).alias("p_perm"))


def permutation_correlation(df, keys, x, y, order, n_perm=1000, seed=42, method="spearman"):
    """Shuffled y against x; ranks are taken once, as a shuffle does not change them."""
    ok = complete(df, x, y)
    if method == "spearman":
        ok = with_midrank(ok, keys, {x: "__rx", y: "__ry"})
        x, y = "__rx", "__ry"
    return permutation_test(ok, keys, x, y, order, n_perm, seed)


def permutation_freedman_lane(df, keys, x, y, covariates, order, n_perm=1000, seed=42):
    """Shuffled residuals of y against residuals of x."""
    res = partial_residuals(df, keys, x, y, covariates)
    return permutation_test(res, keys, f"{x}_res", f"{y}_res", order, n_perm, seed)


def permutation_within_group(df, keys, group, x, y, order, n_perm=1000, seed=42):
    """Shuffle inside each subject (or run), then correlate over all rows."""
    return permutation_test(df, keys, x, y, order, n_perm, seed, list(group))


def mixed_random_intercept(df, subject, x, y, keys=(), lo=-12.0, hi=8.0, steps=81, rounds=3):
    """y on x with a random intercept per subject, by restricted likelihood.

    Subjects give six sums; the likelihood is profiled over the log variance ratio on a
    grid that narrows around the best point each round.
    """
    keys = list(keys)
    ok = complete(df, x, y)
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    s = ok.groupBy(*keys, subject).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"))
    s = s.withColumn("__g", F.lit(0))
    group = [*keys, "__g"]
    centre, width = None, (hi - lo) / 2
    best = None
    for _ in range(rounds):
        grid = F.array(*[F.lit(-width + 2 * width * i / (steps - 1)) for i in range(steps)])
        base = s.withColumn("__c", F.lit((lo + hi) / 2)) if centre is None else join_keys(s, centre, group)
        pts = base.withColumn("u", F.explode(grid)).withColumn("u", F.col("u") + F.col("__c"))
        lam = F.exp(F.col("u"))
        w = lam / (1 + lam * F.col("n"))
        q = pts.groupBy(*group, "u").agg(
            F.sum("n").alias("N"), F.sum(F.col("n") - w * F.col("n") * F.col("n")).alias("a11"), F.sum(F.col("sx") - w * F.col("n") * F.col("sx")).alias("a12"),
            F.sum(F.col("sxx") - w * F.col("sx") * F.col("sx")).alias("a22"), F.sum(F.col("sy") - w * F.col("n") * F.col("sy")).alias("b1"),
            F.sum(F.col("sxy") - w * F.col("sx") * F.col("sy")).alias("b2"), F.sum(F.col("syy") - w * F.col("sy") * F.col("sy")).alias("c"), F.sum(F.ln(1 + lam * F.col("n"))).alias("ld"))
        q = q.withColumn("det", F.col("a11") * F.col("a22") - F.col("a12") * F.col("a12")).where("det > 0 and N > 2")
        q = q.withColumns({"beta": (F.col("a11") * F.col("b2") - F.col("a12") * F.col("b1")) / F.col("det"), "alpha": (F.col("a22") * F.col("b1") - F.col("a12") * F.col("b2")) / F.col("det")})
        q = q.withColumn("s2", (F.col("c") - F.col("alpha") * F.col("b1") - F.col("beta") * F.col("b2")) / (F.col("N") - 2))
        q = q.withColumn("ll", -0.5 * ((F.col("N") - 2) * F.ln("s2") + F.col("ld") + F.ln("det")))
        best = q.groupBy(*group).agg(F.max_by(F.struct("u", "beta", "alpha", "s2", F.sqrt(F.col("s2") * F.col("a11") / F.col("det")).alias("se"), "ll"), "ll").alias("m"))
        centre = best.select(*group, F.col("m.u").alias("__c"))
        width = 2 * width / (steps - 1)
    m = F.col("m")
    z = m["beta"] / m["se"]
    return best.select(*keys, m["beta"].alias("beta"), m["alpha"].alias("intercept"), m["se"].alias("se"), z.alias("z"), (2 * normal_cdf(-F.abs(z))).alias("p"),
                       (F.exp(m["u"]) * m["s2"]).alias("var_subject"), m["s2"].alias("var_residual"), ((m["u"] > lo) & (m["u"] < hi)).alias("converged"))


def group_stats_table(df, subject="subject", metrics=None, primary=("slope", "auc"), n_boot=1000, seed=42, r_limit=0.9999):
    """Group tests of subject metrics: n, mean, SD, corrected interval, t, one-sided p; BH over the primary ones.

    ``metrics`` maps a column to (kind, null value); kind ``r`` goes through the z scale, clipped at ``r_limit``.
    """
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), (fisher_z(F.col(m), r_limit) if kind == "r" else F.col(m)).alias("v"), F.lit(kind).alias("kind"), F.lit(float(mu)).alias("mu"))
                     for m, (kind, mu) in metrics.items()])
    long = df.select(subject, F.inline(rows)).where(F.col("v").isNotNull())
    shifted = long.withColumn("d", F.col("v") - F.col("mu"))
    t = ttest_one_sample(shifted, ["metric", "kind", "mu"], "d", 0.0, "greater", 3).where("n >= 3")
    sums = subject_sums(long.withColumn("x", F.lit(0.0)), subject, "x", "v", ["metric"])
    ci = bca_interval(sums, subject, "mean", ["metric"], n_boot, seed)
    out = join_keys(t, ci.select("metric", "ci_low", "ci_high"), ["metric"], "left")
    back = lambda c: F.when(F.col("kind") == "r", F.tanh(c)).otherwise(c)
    out = out.select("metric", "n", back(F.col("mean") + F.col("mu")).alias("mean"), "sd", back(F.col("ci_low")).alias("ci_low"), back(F.col("ci_high")).alias("ci_high"), "t", "df", "p")
    first = F.col("metric").isin(list(primary))
    return bh_fdr(out.withColumn("p_primary", F.when(first, F.col("p"))), [], "p_primary", 0.05).drop("p_primary")


def cluster_null_test(obs, null, keys, index, stat, rep="rep", alpha=0.05):
    """Clusters of an observed curve against the largest cluster of each null curve.

    The threshold is the (1 - alpha) percentile of all null values.
    """
    thr = quantiles(null, keys, stat, {"threshold": 1 - alpha})
    o = contiguous_clusters(join_keys(obs, thr, list(keys)), [*keys, "threshold"], index, stat, F.col("threshold"))
    n = contiguous_clusters(join_keys(null, thr, list(keys)), [*keys, rep], index, stat, F.col("threshold"))
    top = n.groupBy(*keys, rep).agg(F.max("mass").alias("top"))
    reps = null.select(*keys, rep).distinct()
    top = join_keys(reps, top, [*keys, rep], "left").withColumn("top", F.coalesce("top", F.lit(0.0)))
    return p_against_maxima(o, top, keys)


def p_against_maxima(clusters, maxima, keys, mass="mass", top="top"):
    """p = (1 + maxima at or above the mass) / (P + 1), by a running count over both sets in one order.

    A maximum that is the same sum in another order counts as at the mass: the limit lies ``TIE`` of the mass below it.
    """
    at = F.col(mass) - TIE * F.abs(mass)
    side = maxima.select(*keys, F.col(top).alias("v"), F.lit(1).alias("m"), F.lit(None).cast(clusters.withColumn("s", F.struct("*")).schema["s"].dataType).alias("s"))
    both = side.unionByName(clusters.select(*keys, at.alias("v"), F.lit(0).alias("m"), F.struct("*").alias("s")))
    both = ordered_scan(both, keys, ["v", "m"], {"below": ("sum_before", "m")})
    both = with_totals(both, keys, {"P": F.sum("m")}).where(F.col("s").isNotNull())
    return both.select("s.*", ((1 + F.col("P") - F.col("below")) / (F.col("P") + 1)).alias("p"))


def diag_cluster_test(obs, null, keys, index, score, mode="r", two_sided=True, baseline=0.5, rep="rep", alpha=0.05):
    """Cluster test of a diagonal: absolute z of correlations, or AUC about 0.5 (one- or two-sided)."""
    def stat(c):
        if mode == "r":
            return F.abs(fisher_z(c))
        d = c - baseline
        return F.abs(d) if two_sided else F.greatest(d, F.lit(0.0))
    return cluster_null_test(obs.withColumn("__st", stat(F.col(score))), null.withColumn("__st", stat(F.col(score))), keys, index, "__st", rep, alpha)


def _sign_flip_t(df, subject, keys, value, n_perm, seed):
    """t over subjects per point, observed (rep 0) and under random subject signs."""
    ids = with_index(df.select(subject).distinct(), [], [subject], "__sid")
    signs = with_replicates(ids, n_perm).select(subject, "rep", F.when(seeded_hash(seed, F.col("rep"), F.col("__sid")) % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))
    signs = signs.unionByName(ids.select(subject, F.lit(0).cast("long").alias("rep"), F.lit(1.0).alias("sign")))
    v = F.col(value) * F.col("sign")
    g = df.where(F.col(value).isNotNull()).join(signs, subject).groupBy(*keys, "rep").agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.count(v).alias("n"))
    return g.select(*keys, "rep", "n", F.when((F.col("n") >= 2) & (F.col("s") > 0), F.col("m") / (F.col("s") / F.sqrt("n"))).alias("t"))


def signflip_cluster_test(df, subject, keys, index, value, n_perm=1000, seed=42, p_threshold=0.05):
    """Per region: t over subjects per time, clusters of |t|, family p from sign flips of whole subjects.

    The threshold is the two-sided critical t at the smallest number of subjects.
    """
    t = _sign_flip_t(df, subject, [*keys, index], value, n_perm, seed)
    t = with_totals(t, keys, {"__n": F.min(F.when(F.col("rep") == 0, F.col("n")))})
    t = t.withColumns({"threshold": t_quantile(F.col("__n") - 1, 1 - p_threshold / 2), "abs_t": F.abs("t")})
    c = contiguous_clusters(t, [*keys, "rep", "threshold"], index, "abs_t", F.col("threshold"))
    obs = c.where("rep = 0").drop("rep")
    top = c.where("rep > 0").groupBy(*keys, "rep").agg(F.max("mass").alias("top"))
    reps = t.where("rep > 0").select(*keys, "rep").distinct()
    top = join_keys(reps, top, [*keys, "rep"], "left").withColumn("top", F.coalesce("top", F.lit(0.0)))
    return p_against_maxima(obs, top, keys)


def connected_labels(nodes, edges, keys, node="node", a="a", b="b"):
    """Smallest node name of each connected component, by repeated exchange with neighbours.

    Each round joins labels to neighbours and also to the label's own label, so the
    number of rounds grows with the logarithm of the longest path in practice; the state is
    written to the shared folder each round and the loop stops when no label changes.
    """
    both = edges.select(*keys, F.col(a).alias("__x"), F.col(b).alias("__y"))
    both = stored(both.unionByName(edges.select(*keys, F.col(b).alias("__x"), F.col(a).alias("__y"))).distinct(), "edges")
    state = stored(nodes.select(*keys, node, F.col(node).alias("label")), "labels")
    while True:
        near = join_keys(both, state.select(*keys, F.col(node).alias("__y"), "label"), [*keys, "__y"]).groupBy(*keys, F.col("__x").alias(node)).agg(F.min("label").alias("__near"))
        step = join_keys(state, near, [*keys, node], "left").withColumn("label2", F.least("label", F.coalesce("__near", F.col("label"))))
        jump = state.select(*keys, F.col(node).alias("label2"), F.col("label").alias("__jump"))
        step = join_keys(step, jump, [*keys, "label2"], "left").select(*keys, node, F.col("label").alias("old"), F.least("label2", F.coalesce("__jump", F.col("label2"))).alias("label"))
        step = stored(step, "labels")
        changed = step.where(F.col("old") != F.col("label")).limit(1).count()
        state = step.drop("old")
        if not changed:
            return state


def graph_cluster_test(df, neighbours, subject, channel, value, n_perm=1000, seed=42, p_threshold=0.05, keys=()):
    """Sign-flip test on channels with a neighbour table: p, size and mass of the largest observed cluster."""
    keys = list(keys)
    t = _sign_flip_t(df, subject, [*keys, channel], value, n_perm, seed)
    t = t.withColumn("thr", t_quantile(F.col("n") - 1, 1 - p_threshold / 2)).where(F.abs("t") >= F.col("thr"))
    # Clusters hold channels of one sign.
    t = stored(t.select(*keys, "rep", channel, F.abs("t").alias("abs_t"), F.signum("t").cast("int").alias("sign")), "supra")
    part = [*keys, "rep", "sign"]
    left = t.select(*part, F.col(channel).alias("a"))
    e = left.join(neighbours.select("a", "b"), "a")
    e = join_keys(e, t.select(*part, F.col(channel).alias("b")), [*part, "b"])
    lab = connected_labels(t.select(*part, F.col(channel).alias("node")), e, part)
    c = join_keys(t.withColumnRenamed(channel, "node"), lab, [*part, "node"]).groupBy(*keys, "rep", "sign", "label").agg(F.sum("abs_t").alias("mass"), F.count(F.lit(1)).alias("size"))
    best = c.groupBy(*keys, "rep").agg(F.max(F.struct("mass", "size")).alias("b")).select(*keys, "rep", "b.mass", "b.size")
    reps = with_replicates(df.select(*keys, F.lit(0).alias("__one")).distinct(), n_perm).select(*keys, "rep")
    top = join_keys(reps, best.select(*keys, "rep", F.col("mass").alias("top")), [*keys, "rep"], "left").withColumn("top", F.coalesce("top", F.lit(0.0)))
    return p_against_maxima(best.where("rep = 0").drop("rep"), top, keys)


def group_null_resample(null, obs, subject, index, score="score", mode="r", n_samples=1000, seed=42):
    """Group null per time: mean over subjects of one random null draw each; p per time and BH over time.

    ``null`` is (subject, perm 0..P-1, index, score), ``obs`` (index, score).
    """
    sizes = null.groupBy(subject).agg((F.max("perm") + 1).alias("P"))
    ids = with_index(sizes, [], [subject], "__sid")
    picks = with_replicates(ids, n_samples).select(subject, "rep", seeded_draw(seed, F.col("rep"), F.col("__sid"), F.col("P")).alias("perm"))
    # A draw is fixed per (rep, subject): merge equal (subject, perm) use before meeting the curves.
    mix = null.join(picks, [subject, "perm"]).groupBy("rep", index).agg(F.avg(score).alias("mix"))
    eff = (lambda c: F.abs(fisher_z(c))) if mode == "r" else (lambda c: c)
    j = mix.join(obs.select(index, F.col(score).alias("obs")), index)
    g = j.groupBy(index, "obs").agg(F.count_if(eff(F.col("mix")) >= eff(F.col("obs"))).alias("ge"), F.count("mix").alias("n"))
    return bh_fdr(g.withColumn("p", (F.col("ge") + 1) / (F.col("n") + 1)).drop("ge"), [], "p", 0.05)


