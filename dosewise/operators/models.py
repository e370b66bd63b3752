"""Cross-validated models.

Linear models are fitted from cross products summed once per fold: a training set is
the sum over its folds, so no fold re-reads the rows.  Only p x p matrices reach a
solver, one task per (outer fold).
"""

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.draws import seeded_hash
from ..functions.moments import pair_aggs, r_of, r_with_p
from ..functions.solvers import enet, enet_many, filled, line_scores, r2_many, ridge_path
from ..plans.shapes import join_keys, once, ordered_scan, quantiles, with_index, with_row, with_totals
from ..session import stored
from .columns import clean_number
from .resample import PAIR_SUMS, shuffled_lines, shuffled_sums
from .stats import auc, complete

# ---------------------------------------------------------------- folds


def group_folds(df, group, n_splits, subject=()):
    """Folds of whole groups balanced by size: largest first, each to the lightest fold.

    The walk reads one row per group (not the data) in sorted order and keeps only the fold loads.
    """
    subject = list(subject)
    sizes = df.groupBy(*subject, group).agg(F.count(F.lit(1)).alias("__size"))
    names = subject + [group, "__size"]
    n_sub = len(subject)

    def walk(batches):
        current, loads = object(), None
        for pdf in batches:
            folds = []
            for row in pdf.itertuples(index=False):
                key = tuple(row[:n_sub])
                if key != current:
                    current, loads = key, np.zeros(n_splits)
                f = int(np.argmin(loads))
                loads[f] += row[n_sub + 1]
                folds.append(f)
            yield pdf.assign(fold=np.asarray(folds, dtype="int32"))

    types = dict(sizes.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + ", fold int"
    by = [F.col(c) for c in subject]
    one = sizes.repartition(*by) if by else sizes.repartition(1)
    return one.sortWithinPartitions(*by, F.col("__size").desc(), group).select(*names).mapInPandas(walk, schema).drop("__size")


def assign_folds(df, group, scheme="logo", n_splits=5, y=None, order=(), seed=42):
    """Add ``fold``: one group out, groups balanced by size, or quantile-stratified rows."""
    if scheme == "logo":
        ids = with_index(df.select(group).distinct(), [], [group], "fold").withColumn("fold", F.col("fold").cast("int"))
        return join_keys(df, ids, [group])
    if scheme == "group":
        return join_keys(df, group_folds(df, group, n_splits), [group])
    q = quantiles(df, [], y, {f"q{i}": i / n_splits for i in range(1, n_splits)})
    b = with_row(df, q.select(F.array(*[f"q{i}" for i in range(1, n_splits)]).alias("__e")))
    b = b.withColumn("bin", F.size(F.filter("__e", lambda e: e < F.col(y)))).drop("__e")
    b = with_index(b, [], list(order), "__pos")
    b = with_index(b.withColumn("__h", seeded_hash(seed, F.lit(0), F.col("__pos"))), ["bin"], ["__h", "__pos"], "__k")
    return b.withColumn("fold", (F.col("__k") % n_splits).cast("int")).drop("__h", "__pos", "__k")


# ---------------------------------------------------------------- baselines in closed form


def baseline_mean_loso(df, group, y="y_true"):
    """Each held-out group predicted by the mean of all the others."""
    g = df.groupBy(group).agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
    g = with_totals(g, [], {"__all_s": F.sum("__s"), "__all_n": F.sum("__n")})
    g = g.select(group, F.try_divide(F.col("__all_s") - F.col("__s"), (F.col("__all_n") - F.col("__n")).cast("double")).alias("y_pred"))
    return join_keys(df, g, [group])


MEDIAN_CUTS = 256


def training_medians(df, fold, columns, n_folds):
    """Median of each column over all folds but one (and over all, as held_out -1).

    No value is copied to the folds and few are sorted: every column is cut at approximate quantiles, one pass counts its values
    by cut and fold, and only the cuts that hold a middle value of some training set are put in order, with running counts per
    fold.  The cuts decide how much is sorted, not the result.  Equal values are one row.
    """
    columns = list(columns)
    wide = df.select(F.col(fold).cast("long").alias("fold"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    shares = F.array(*[F.lit(i / MEDIAN_CUTS) for i in range(1, MEDIAN_CUTS)])
    edges = df.agg(F.array(*[F.percentile_approx(F.col(c).cast("double"), shares, F.lit(10 * MEDIAN_CUTS)) for c in columns]).alias("e")).first()["e"]
    edges = [np.unique(np.array(e or [], dtype=float)) for e in edges]

    def cut(batch):
        """(fold of a row, values by column, cut of each value or -1 for a missing one)."""
        flat = batch.column("x").flatten()
        here = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, len(edges))
        x = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, len(edges))
        place = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
        return batch.column("fold"), x, np.where(here, place, -1)

    def count(batches):
        found = {}
        for batch in batches:
            folds, _, place = cut(batch)
            for f in pc.unique(folds).to_pylist():
                rows = pc.is_null(folds) if f is None else pc.fill_null(pc.equal(folds, f), False)
                at = place[rows.to_numpy(zero_copy_only=False)]
                n = np.stack([np.bincount(at[:, j] + 1, minlength=MEDIAN_CUTS + 1) for j in range(len(edges))])
                found[f] = found[f] + n if f in found else n
        for f, n in found.items():
            feature, place = np.nonzero(n[:, 1:])
            yield pa.RecordBatch.from_pydict({"feature": pa.array(feature, pa.int32()), "cut": pa.array(place, pa.int32()), "fold": pa.array([f] * len(place), pa.int64()), "c": pa.array(n[:, 1:][feature, place], pa.int64())})

    outs = [-1, *range(n_folds)]
    # A row without a fold is in no training set but that of all rows.
    training = [F.sum("c").alias("t0"), *[F.coalesce(F.sum(F.when(F.col("fold") != k, F.col("c"))), F.lit(0)).alias(f"t{k + 1}") for k in range(n_folds)]]
    counts = wide.mapInArrow(count, "feature int, cut int, fold long, c long").groupBy("feature", "cut").agg(*training)
    counts = counts.select("feature", "cut", F.inline(F.array(*[F.struct(F.lit(k).alias("held_out"), F.col(f"t{k + 1}").alias("c")) for k in outs])))
    by = Window.partitionBy("held_out", "feature")  # at most MEDIAN_CUTS rows
    counts = counts.withColumns({"b": F.coalesce(F.sum("c").over(by.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("c").over(by)})
    lo, hi = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    holds = lambda p: (F.col("b") <= p) & (p < F.col("b") + F.col("c"))
    middle = stored(counts.where(holds(lo) | holds(hi)).select("held_out", "feature", "cut", "b", lo.alias("lo"), hi.alias("hi")), "middles")
    wanted = np.zeros((len(columns), MEDIAN_CUTS + 1), dtype=bool)  # the last place stands for a missing value
    for r in middle.select("feature", "cut").distinct().collect():
        wanted[r["feature"], r["cut"]] = True

    def pick(batches):
        for batch in batches:
            folds, x, place = cut(batch)
            row, feature = np.nonzero(wanted[np.arange(len(edges)), place])
            yield pa.RecordBatch.from_pydict({"feature": pa.array(feature, pa.int32()), "cut": pa.array(place[row, feature], pa.int32()), "x": pa.array(x[row, feature]), "fold": folds.take(pa.array(row))})

    values = wide.mapInArrow(pick, "feature int, cut int, x double, fold long").withColumn("c", F.lit(1)).groupBy("feature", "cut", "x").agg(*training)
    values = ordered_scan(values, ["feature", "cut"], ["x"], {f"b{k + 1}": ("sum_before", f"t{k + 1}") for k in outs})
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("held_out"), F.col(f"t{k + 1}").alias("c"), F.col(f"b{k + 1}").alias("within")) for k in outs]))
    values = values.select("feature", "cut", "x", each).where("c > 0").join(middle, ["held_out", "feature", "cut"])
    at = lambda p: F.max(F.when((F.col("b") + F.col("within") <= F.col(p)) & (F.col(p) < F.col("b") + F.col("within") + F.col("c")), F.col("x")))
    labels = F.array(*[F.lit(c) for c in columns])
    return values.groupBy("held_out", "feature").agg(((at("lo") + at("hi")) / 2).alias("median")).select("held_out", F.get(labels, F.col("feature")).alias("feature"), "median")


LOGO_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _pair_sums(df, keys, x, y):
    ok = complete(df, x, y)
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return ok.groupBy(*keys).agg(*[PAIR_SUMS[k](a, b).alias(k) for k in LOGO_SUMS])


def logo_lines(sums, group, keys=()):
    """Per held-out group the line fitted on all other groups."""
    t = with_totals(sums, keys, {f"__t_{c}": F.sum(c) for c in LOGO_SUMS})
    n, sx, sy, sxx, sxy = (F.col(f"__t_{c}") - F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy"))
    vx = sxx - sx * sx / n
    b = F.when(F.abs(vx) > 1e-9, (sxy - sx * sy / n) / vx).otherwise(0.0)
    out = t.where(F.col("__t_n") > F.col("n")).withColumn("slope", b)
    return out.withColumn("intercept", (F.col("__t_sy") - F.col("sy")) / (F.col("__t_n") - F.col("n")) - F.col("slope") * (F.col("__t_sx") - F.col("sx")) / (F.col("__t_n") - F.col("n"))).select(
        *sums.columns, "slope", "intercept")


def pooled_scores(lines, keys=()):
    """Pooled r and R2 of line predictions from the groups' sums; no prediction row is made."""
    a, b = F.col("intercept"), F.col("slope")
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in LOGO_SUMS)
    g = lines.groupBy(*keys).agg(F.sum("n").alias("N"), F.sum(sy).alias("Y"), F.sum(syy).alias("YY"), F.sum(a * n + b * sx).alias("P"),
                                 F.sum(a * a * n + 2 * a * b * sx + b * b * sxx).alias("PP"), F.sum(a * sy + b * sxy).alias("PY"))
    vy, vp = F.col("YY") - F.col("Y") * F.col("Y") / F.col("N"), F.col("PP") - F.col("P") * F.col("P") / F.col("N")
    r = F.when((vy > 1e-9) & (vp > 1e-9), (F.col("PY") - F.col("P") * F.col("Y") / F.col("N")) / F.sqrt(vy * vp))
    return g.select(*keys, F.col("N").alias("n"), r.alias("r"), F.when(vy > 1e-9, 1 - (F.col("YY") - 2 * F.col("PY") + F.col("PP")) / vy).alias("r2"))


def baseline_linear_logo(df, group, x, y="y_true", medians=None):
    """One-feature regression with a group left out, predictions on all rows.

    ``medians`` (group, median) fills missing x with the training median of the held-out group.
    """
    if medians is None:
        lines = logo_lines(_pair_sums(df, [group], x, y), group)
        return join_keys(df, lines.select(group, "slope", "intercept"), [group]).withColumn("y_pred", F.col("intercept") + F.col("slope") * F.col(x)).drop("slope", "intercept")
    # Filled sums follow from the sums of observed rows and the count and y-sum of missing ones.
    xx, yy = F.col(x).cast("double"), F.col(y).cast("double")
    miss = xx.isNull()
    s = df.where(F.col(y).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(yy).alias("sy"), F.coalesce(F.sum(xx), F.lit(0.0)).alias("sx"), F.coalesce(F.sum(xx * xx), F.lit(0.0)).alias("sxx"),
                                                          F.coalesce(F.sum(xx * yy), F.lit(0.0)).alias("sxy"), F.count_if(miss).alias("nm"), F.coalesce(F.sum(F.when(miss, yy)), F.lit(0.0)).alias("sym"))
    cols = ["n", "sy", "sx", "sxx", "sxy", "nm", "sym"]
    t = with_totals(s, [], {f"__t_{c}": F.sum(c) for c in cols})
    t = join_keys(t, medians.select(F.col("held_out").alias(group), "median"), [group])
    d = {c: F.col(f"__t_{c}") - F.col(c) for c in cols}
    m = F.col("median")
    t = t.select(group, "median", d["n"].alias("n"), d["sy"].alias("sy"), (d["sx"] + d["nm"] * m).alias("sx"), (d["sxx"] + d["nm"] * m * m).alias("sxx"), (d["sxy"] + m * d["sym"]).alias("sxy"))
    t = t.withColumn("slope", (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")))
    t = t.withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).select(group, "median", "slope", "intercept")
    return join_keys(df, t, [group]).withColumn("y_pred", F.col("intercept") + F.col("slope") * F.coalesce(F.col(x), F.col("median"))).drop("median", "slope", "intercept")


# ---------------------------------------------------------------- cross products


def cross_products(df, keys, features, y):
    """Per key the cross products of (x, missing flag, 1, y), by partial sums in each task.

    ``features`` is an array column of doubles of one length; missing entries count as 0
    with their flag set, so a training median can be put in later.
    """
    types = dict(df.dtypes)
    keys = list(keys)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", row int, sums array<double>"

    def partial(batches):
        acc = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack([np.asarray(v, dtype=float) for v in pdf["__x"]])
            u = ~np.isfinite(x)
            a = np.hstack([np.where(u, 0.0, x), u.astype(float), np.ones((len(x), 1)), pdf["__y"].to_numpy(float)[:, None]])
            for key, idx in pdf.groupby(keys, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                part = a[idx].T @ a[idx]
                acc[key] = acc[key] + part if key in acc else part
        for key, m in acc.items():
            out = pd.DataFrame({k: [v] * len(m) for k, v in zip(keys, key)})
            out["row"] = np.arange(len(m), dtype="int32")
            out["sums"] = list(m)
            yield out[[*keys, "row", "sums"]]

    def added(batches):
        acc = {}
        for pdf in batches:
            for *key, sums in zip(*[pdf[k] for k in keys], pdf["row"], pdf["sums"]):
                key, sums = tuple(None if pd.isna(k) else k for k in key), np.asarray(sums, float)
                acc[key] = acc[key] + sums if key in acc else sums
        at = 0
        while at < len(acc):
            some = list(acc.items())[at:at + 1000]
            at += len(some)
            yield pd.DataFrame({**{k: [key[i] for key, _ in some] for i, k in enumerate([*keys, "row"])}, "sums": [v for _, v in some]})

    parts = df.where(F.col(y).isNotNull()).select(*keys, F.col(features).alias("__x"), F.col(y).cast("double").alias("__y")).mapInPandas(partial, schema)
    # p x p numbers per key, whatever the number of rows; the tasks' shares are added row by row, as arrays.
    rows = parts.repartition(*keys, "row").mapInPandas(added, schema)
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "sums"))).alias("m"))
    return g.select(*keys, F.flatten(F.transform("m", lambda c: c["sums"])).alias("gram"))


FIT_SCHEMA = ("fold int, alpha double, l1_ratio double, best_r2 double, best_r double, best_neg_mse double, params_by_r string, params_by_neg_mse string, "
              "intercept double, coef array<double>, scale array<double>, median array<double>, n_train bigint, converged boolean")


def fold_ids(df, fold, grams, n_folds=None):
    """The folds in the data, which are few; a row without one, or outside the ``n_folds`` that are asked for, is an error."""
    ids = sorted(int(r["part"]) for r in grams.select("part").distinct().collect())
    if df.where(F.col(fold).isNull()).limit(1).count():
        raise ValueError("rows without a fold")
    if n_folds is not None and not set(ids) <= set(range(n_folds)):
        raise ValueError(f"folds {ids} do not lie in 0..{n_folds - 1}")
    return ids


def balanced_blocks(rows, n_splits):
    """Blocks (block -> rows) to at most ``n_splits`` inner folds: the largest first, each to the lightest fold."""
    n = min(n_splits, len(rows))
    load, out = [0.0] * n, [[] for _ in range(n)]
    for block in sorted(rows, key=lambda k: (-rows[k], k)):
        k = load.index(min(load))
        load[k] += rows[block]
        out[k].append(block)
    return out


def outer_products(keyed, features, y, fold, medians=None, n_folds=None, refit_all=False):
    """(folds, grams, table): per outer fold the product sums of every ``__block`` over all folds, and the fold's own parts.

    In the table (fold, __block, own, gram, median) a row with ``own`` false is a block's sum over all folds, one with ``own``
    true the fold's part of it, which the solver takes off; so no product is sent to every other fold.
    """
    grams = stored(cross_products(keyed, [fold, "__block"], features, y).withColumnRenamed(fold, "part"), "grams")
    ids = fold_ids(keyed, fold, grams, n_folds)
    cells = grams.select("__block", F.posexplode("gram").alias("i", "v")).groupBy("__block", "i").agg(F.sum("v").alias("v"))
    total = cells.groupBy("__block").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("gram"))
    each = F.explode(F.array(*[F.lit(i) for i in [*ids, *([-1] if refit_all else [])]])).alias("fold")
    table = total.select(each, "__block", F.lit(False).alias("own"), "gram")
    table = table.unionByName(grams.select(F.col("part").cast("int").alias("fold"), "__block", F.lit(True).alias("own"), "gram"))
    if medians is None:
        return ids, grams, table.withColumn("median", F.lit(None).cast("array<double>"))
    m = medians.groupBy("held_out").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "median"))), lambda s: s["median"]).alias("median"))
    return ids, grams, join_keys(table, m.withColumnRenamed("held_out", "fold"), ["fold"], "left")


def training_parts(pdf, inner_splits, by_blocks):
    """(medians, block -> products of the training rows, products of the fold's own rows, blocks of each inner fold)."""
    size = int(round(len(pdf["gram"].iloc[0]) ** 0.5))
    p = (size - 2) // 2
    med = pdf["median"].iloc[0]
    med = np.zeros(p) if med is None else np.nan_to_num(np.asarray(med, float))
    g, own = {}, np.zeros((p + 2, p + 2))
    for block, mine, v in zip(pdf["__block"], pdf["own"], pdf["gram"]):
        one = filled(np.asarray(v, float).reshape(size, size), med)
        g[block] = g.get(block, 0.0) + (-one if mine else one)
        own += one if mine else 0.0
    train = {k: v for k, v in g.items() if v[p, p] > 0.5}
    return med, train, own, balanced_blocks({k: v[p, p] for k, v in train.items()}, inner_splits) if by_blocks else [[k] for k in sorted(train)]


def elasticnet_nested(df, features, y, fold="fold", n_folds=None, alphas=(0.01, 0.1, 1.0), l1_ratios=(0.2, 0.5, 0.8), medians=None, refit_all=False, inner=None, inner_splits=5):
    """Per outer fold: search the grid by R2 over inner folds of the training rows, refit on all of them; one row per outer fold.

    ``inner`` names the column (a run) whose values are grouped into at most ``inner_splits`` inner folds of about equal
    size; without it the other outer folds are the inner ones.  Missing features take the training median (``medians``:
    held_out, feature position, median; held_out is the fold left out).  The best settings by r and by error are recorded
    too.  Where fewer than two inner folds are left there is nothing to choose by: the first setting is fitted and the best
    scores are NULL.  ``converged`` tells whether the final solver settled.  With ``refit_all`` one extra row (fold -1) is
    chosen over all folds and fitted on all rows.  The folds are those in the data; ``n_folds`` only checks them.
    """
    keyed = df.withColumn("__block", F.col(inner).cast("long") if inner else F.col(fold).cast("long"))
    table = outer_products(keyed, features, y, fold, medians, n_folds, refit_all)[2]
    grid = [(float(a), float(q)) for a in alphas for q in l1_ratios]

    def fit(pdf):
        fold_id = int(pdf["fold"].iloc[0])
        med, train, _, splits = training_parts(pdf, inner_splits, bool(inner))
        p = len(med)
        total = sum(train.values()) if train else np.zeros((p + 2, p + 2))
        tests = [sum(train[k] for k in s) for s in splits] if len(splits) > 1 else []
        alpha, l1 = (np.array([g[i] for g in grid]) for i in (0, 1))
        scores = []  # inner folds x settings x (r2, r, mse); all settings are columns of one descent
        for t in tests:
            b, c, _ = enet_many(total - t, np.tile((total - t)[:, p + 1:], (1, len(grid))), alpha, l1)
            scores.append([line_scores(t, b[:, k], c[k]) for k in range(len(grid))])
        each = np.array(scores, dtype=float).reshape(-1, len(grid), 3)
        known = ~np.isnan(each)
        marks = np.where(known.any(axis=0), np.where(known, each, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1), np.nan)
        by_r2, by_r, by_mse = (int(np.argmax(np.nan_to_num(v, nan=-np.inf))) for v in (marks[:, 0], marks[:, 1], -marks[:, 2]))
        b, c, sd, settled = enet(total, *grid[by_r2])
        text = lambda i: f'{{"alpha": {grid[i][0]}, "l1_ratio": {grid[i][1]}}}'
        none = lambda v: None if np.isnan(v) else float(v)
        return pd.DataFrame([{"fold": fold_id, "alpha": grid[by_r2][0], "l1_ratio": grid[by_r2][1], "best_r2": none(marks[by_r2, 0]), "best_r": none(marks[by_r, 1]), "best_neg_mse": none(-marks[by_mse, 2]),
                              "params_by_r": text(by_r), "params_by_neg_mse": text(by_mse), "intercept": c, "coef": b.tolist(), "scale": sd.tolist(), "median": med.tolist(), "n_train": int(total[p, p]), "converged": settled}])

    # Written: every use of a lazy frame would search the grid again.
    return stored(table.groupBy("fold").applyInPandas(fit, FIT_SCHEMA), "fits")


def predict_linear(df, fits, features, fold="fold", name="y_pred"):
    """Out-of-fold predictions: each row meets the fit of its own fold; the product stays in the JVM."""
    f = fits.select(F.col("fold").alias(fold), "intercept", "coef", "median")
    j = df.join(f, fold)
    x = F.zip_with(F.col(features), F.col("median"), lambda v, m: F.coalesce(F.when(~F.isnan(v), v), m).cast("double"))
    dot = F.aggregate(F.zip_with(x, F.col("coef"), lambda v, c: v * c), F.lit(0.0), lambda a, v: a + v)
    return j.withColumn(name, F.col("intercept") + dot).drop("intercept", "coef", "median")


def predict_fixed_params(df, params, features, y, fold="fold", n_folds=None):
    """Leave-one-fold-out with stored settings (fold, alpha, l1_ratio): one fit per fold in the data, then predictions."""
    grams = stored(cross_products(df, [fold], features, y).withColumnRenamed(fold, "part"), "grams")
    table = grams.withColumn("fold", F.explode(F.array(*[F.lit(int(i)) for i in fold_ids(df, fold, grams, n_folds)]))).join(params, "fold")

    def fit(pdf):
        size = int(round(len(pdf["gram"].iloc[0]) ** 0.5))
        p = (size - 2) // 2
        f = int(pdf["fold"].iloc[0])
        total = sum(filled(np.asarray(v, float).reshape(size, size), np.zeros(p)) for k, v in zip(pdf["part"], pdf["gram"]) if int(k) != f)
        b, c, *_ = enet(total, float(pdf["alpha"].iloc[0]), float(pdf["l1_ratio"].iloc[0]))
        return pd.DataFrame([{"fold": f, "intercept": c, "coef": b.tolist(), "median": [0.0] * p}])

    fits = table.groupBy("fold").applyInPandas(fit, "fold int, intercept double, coef array<double>, median array<double>")
    return predict_linear(df, fits, features, fold)


def within_subject_cv(df, subject, block, features, y, n_splits=5, alpha=1.0, l1_ratio=0.5):
    """Block folds inside each subject; subjects without two blocks are left out.

    The solver sees one subject's fold products, never its rows.
    """
    n = df.groupBy(subject).agg(F.count_distinct(block).alias("__b")).where(F.col("__b") >= 2).select(subject)
    ok = df.join(n, subject, "left_semi")
    ok = join_keys(ok.drop("fold"), group_folds(ok, block, n_splits, [subject]), [subject, block])
    grams = cross_products(ok, [subject, "fold"], features, y)
    kt = dict(df.dtypes)[subject]

    def fit(pdf):
        size = int(round(len(pdf["gram"].iloc[0]) ** 0.5))
        p = (size - 2) // 2
        g = {int(k): filled(np.asarray(v, float).reshape(size, size), np.zeros(p)) for k, v in zip(pdf["fold"], pdf["gram"])}
        rows = []
        for f in g:
            b, c, *_ = enet(sum(v for k, v in g.items() if k != f), alpha, l1_ratio)
            rows.append({subject: pdf[subject].iloc[0], "fold": f, "intercept": c, "coef": b.tolist(), "median": [0.0] * p})
        return pd.DataFrame(rows)

    fits = grams.groupBy(subject).applyInPandas(fit, f"`{subject}` {kt}, fold int, intercept double, coef array<double>, median array<double>")
    j = join_keys(ok, fits, [subject, "fold"])
    dot = F.aggregate(F.zip_with(F.col(features), F.col("coef"), lambda v, c: F.coalesce(v.cast("double"), F.lit(0.0)) * c), F.lit(0.0), lambda a, v: a + v)
    return j.withColumn("y_pred", F.col("intercept") + dot).drop("intercept", "coef", "median")


def final_refit(df, features, y, fold="fold", n_folds=None, **grid):
    """Settings by all folds, one fit on all rows, and its metrics on those rows."""
    fits = elasticnet_nested(df, features, y, fold, n_folds, refit_all=True, **grid).where("fold = -1")
    pred = predict_linear(df.withColumn("__all", F.lit(-1)), fits, features, "__all")
    return with_row(fits.select("alpha", "l1_ratio", "intercept", "coef", "n_train"), in_sample_metrics(pred, y))


def in_sample_metrics(pred, y, y_pred="y_pred"):
    e = F.col(y) - F.col(y_pred)
    g = pred.groupBy().agg(*pair_aggs(y_pred, y), F.avg(e * e).alias("mse"), F.var_pop(y).alias("vt"), F.avg(F.abs(e)).alias("mae"))
    return r_with_p(g, p=None).select("r", (1 - F.try_divide(F.col("mse"), F.col("vt"))).alias("r2"), "mae", F.sqrt("mse").alias("rmse"))


def feature_importance(fits, names):
    """Coefficient per feature in units of its SD, per fold, with the rank by size; a constant feature has 0."""
    z = F.zip_with("coef", "scale", lambda c, s: c * s)
    rows = fits.select("fold", F.posexplode(F.arrays_zip(F.col("coef").alias("coef"), z.alias("scaled"))).alias("pos", "v"))
    labels = F.array(*[F.lit(n) for n in names])
    return rows.select("fold", F.get(labels, F.col("pos")).alias("feature"), F.col("v.coef").alias("coef"), F.col("v.scaled").alias("scaled"), F.abs("v.scaled").alias("importance"))


# ---------------------------------------------------------------- permutation on sums


def _shuffled_pairs(df, keys, group, xs, y, order, n_perm, seed):
    """(rep, group, model, LOGO_SUMS) of y shuffled inside ``keys``: what a shuffle does not change is summed once."""
    acc = None if group in keys else group
    null = shuffled_sums(df, keys, xs, y, order, n_perm, seed, acc=acc)
    fixed = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[f(F.col(x).cast("double")).alias(f"__{k}{i}") for i, x in enumerate(xs) for k, f in (("sx", F.sum), ("sxx", lambda v: F.sum(v * v)))])
    j = join_keys(null, fixed, [group])
    models = F.array(*[F.struct(F.lit(x).alias("model"), F.col(f"__sx{i}").alias("sx"), F.col(f"__sxx{i}").alias("sxx"), F.get("sxy", F.lit(i)).alias("sxy")) for i, x in enumerate(xs)])
    return j.select("rep", group, "n", "sy", "syy", F.inline(models)).select("rep", "model", group, *LOGO_SUMS)


def null_summary(scores, obs):
    """p = (ge + 1) / (P + 1) of ``r2`` against the null scores, one per replicate, and the null's mean, spread and quantiles."""
    j = with_row(scores, obs)
    g = j.groupBy("r2_obs").agg(F.count_if(F.col("r2") >= F.col("r2_obs")).alias("ge"), F.count("r2").alias("n_perm"), F.percentile("r2", 0.05).alias("null_q05"), F.percentile("r2", 0.5).alias("null_q50"),
                                F.percentile("r2", 0.95).alias("null_q95"), F.avg("r2").alias("null_mean"), F.stddev_pop("r2").alias("null_sd"))
    return g.select("r2_obs", "n_perm", ((F.col("ge") + 1) / (F.col("n_perm") + 1)).alias("p"), "null_q05", "null_q50", "null_q95", "null_mean", "null_sd")


def permutation_r2(df, group, x, y, order, n_perm=1000, seed=42):
    """Shuffle the target, repeat the group-out line on sums; the search of the nested model is in ``permutation_r2_nested``."""
    ok = once(complete(df, x, y).select(*dict.fromkeys([group, *order, x, y])))
    scores = stored(shuffled_lines(ok, group, x, y, order, n_perm, seed), "scores")
    obs = pooled_scores(logo_lines(_pair_sums(ok, [group], x, y), group)).select(F.col("r2").alias("r2_obs"))
    return null_summary(scores, obs)


def permutation_r2_nested(df, features, y, order, fold="fold", alphas=(0.01, 0.1, 1.0), l1_ratios=(0.2, 0.5, 0.8), medians=None, inner=None, inner_splits=5, n_perm=1000, seed=42, block=50):
    """The whole nested search of ``elasticnet_nested`` repeated on ``n_perm`` shuffles of the target over all rows.

    A shuffle leaves X'X, the training medians and the folds alone; only X'y changes.  So the rows are read once for the
    products and once for the right-hand sides of all shuffles (``shuffled_sums``, kept apart by fold and inner block), and a
    task takes one outer fold with ``block`` shuffles: coordinate descent runs on all of them and all settings together, as
    columns of one matrix.  The score is the R2 of all out-of-fold predictions, from sums; the target as it is goes along as
    replicate 0.  One row as in ``null_summary``, with ``unsettled``, the number of fits that used up their sweeps.
    """
    ok = df.where(F.col(y).isNotNull())
    keyed = once(ok.select(*dict.fromkeys([fold, *order, y]), F.col(features).alias("__f"), (F.col(inner) if inner else F.col(fold)).cast("long").alias("__block")))
    folds, grams, table = outer_products(keyed, "__f", y, fold, medians)
    size = F.sqrt(F.size("gram")).cast("int")
    observed = grams.select("part", "__block", F.lit(0).cast("long").alias("rep"), F.transform(F.sequence(F.lit(1), size), lambda i: F.get("gram", i * size - 1)).alias("side"))
    value = lambda v: clean_number(v.cast("double"))
    both = F.concat(F.transform("__f", lambda v: F.coalesce(value(v), F.lit(0.0))), F.transform("__f", lambda v: value(v).isNull().cast("double")))
    sides = keyed.withColumns({"__xu": both, "__acc": F.concat_ws(":", fold, "__block")})
    cut = F.split("__acc", ":")
    null = shuffled_sums(sides, [], "__xu", y, order, n_perm, seed, acc="__acc")
    null = null.select(cut[0].cast("int").alias("part"), cut[1].cast("long").alias("__block"), "rep", F.concat("sxy", F.array("sy", "syy")).alias("side"))
    rhs = stored(null.unionByName(observed).withColumn("reps", F.floor(F.col("rep") / block).cast("int")), "sides")
    long = rhs.select("__block", "reps", "rep", F.posexplode("side").alias("i", "v")).groupBy("__block", "reps", "rep", "i").agg(F.sum("v").alias("v"))
    total = long.groupBy("__block", "reps", "rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("side"))
    each = F.explode(F.array(*[F.lit(i) for i in folds])).alias("fold")
    columns = ["__block", "reps", "rep", "side"]
    sides = total.select(each, F.lit(False).alias("own"), *columns).unionByName(rhs.select(F.col("part").alias("fold"), F.lit(True).alias("own"), *columns))
    grid = [(float(a), float(q)) for a in alphas for q in l1_ratios]

    def solve(products, targets):
        med, train, own, splits = training_parts(products, inner_splits, bool(inner))
        p, many = len(med), targets["rep"].nunique()
        reps = np.sort(targets["rep"].unique())
        at = {r: i for i, r in enumerate(reps)}
        sums = {k: np.zeros((2 * p + 2, many)) for k in train}
        held = np.zeros((2 * p + 2, many))
        for k, rep, mine, side in zip(targets["__block"], targets["rep"], targets["own"], targets["side"]):
            v = np.asarray(side, float)
            if mine:
                held[:, at[rep]] += v
            if k in sums:
                sums[k][:, at[rep]] += -v if mine else v
        fill = lambda m: np.vstack([m[:p] + med[:, None] * m[p:2 * p], m[2 * p:]])
        right, held = {k: fill(m) for k, m in sums.items()}, fill(held)
        total_g, total_r = sum(train.values()), sum(right.values())
        tests = [(sum(train[k] for k in s), sum(right[k] for k in s)) for s in splits] if len(splits) > 1 else []
        # columns: all shuffles under the first setting, then under the second, and so on
        alpha, l1 = (np.repeat([g[i] for g in grid], many) for i in (0, 1))
        marks, known, unsettled = np.zeros((len(grid), many)), np.zeros((len(grid), many)), 0
        for g, r in tests:
            b, c, settled = enet_many(total_g - g, np.tile(total_r - r, (1, len(grid))), alpha, l1)
            r2 = r2_many(g, np.tile(r, (1, len(grid))), b, c)[0].reshape(len(grid), many)
            marks, known, unsettled = marks + np.nan_to_num(r2), known + ~np.isnan(r2), unsettled + int((~settled).sum())
        best = np.argmax(np.where(known > 0, marks / np.maximum(known, 1), -np.inf), axis=0)
        b, c, settled = enet_many(total_g, total_r, *(np.array([grid[k][i] for k in best]) for i in (0, 1)))
        counts = np.zeros(many, dtype=np.int64)
        counts[0] = unsettled + int((~settled).sum())
        return pd.DataFrame({"rep": reps, "sse": r2_many(own, held, b, c)[1], "n": own[p, p], "sy": held[p], "syy": held[p + 1], "unsettled": counts})

    dealt = table.withColumn("reps", F.explode(F.sequence(F.lit(0), F.lit(n_perm // block))))
    got = dealt.groupBy("fold", "reps").cogroup(sides.groupBy("fold", "reps")).applyInPandas(solve, "rep long, sse double, n double, sy double, syy double, unsettled long")
    scores = stored(got.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("sse", "n", "sy", "syy", "unsettled")]), "scores")
    spread = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r2 = scores.select("rep", F.when(spread > 1e-12, 1 - F.col("sse") / spread).alias("r2"))
    return with_row(null_summary(r2.where("rep > 0"), r2.where("rep = 0").select(F.col("r2").alias("r2_obs"))), scores.agg(F.sum("unsettled").alias("unsettled")))


def max_stat_permutation(df, group, xs, y, order, n_perm=1000, seed=42):
    """Shuffle inside each subject; the largest absolute r over one-feature models per replicate gives corrected p."""
    xs = list(xs)
    ok = once(complete(df, y, *xs).select(*dict.fromkeys([group, *order, *xs, y])))
    rows = ok.select(group, y, F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("x")) for m in xs])))
    obs = pooled_scores(logo_lines(_pair_sums(rows, ["model", group], "x", y), group, ["model"]), ["model"]).select("model", F.col("r").alias("r_obs"))
    null = _shuffled_pairs(ok, [group], group, xs, y, order, n_perm, seed)
    r = pooled_scores(logo_lines(null, group, ["rep", "model"]), ["rep", "model"])
    top = r.groupBy("rep").agg(F.max(F.abs("r")).alias("top2"), F.max("r").alias("top1"))
    reps = top.withColumn("model", F.explode(F.array(*[F.lit(m) for m in xs])))
    g = join_keys(reps, obs, ["model"]).groupBy("model", "r_obs").agg(F.count_if(F.col("top2") >= F.abs("r_obs")).alias("g2"), F.count_if(F.col("top1") >= F.col("r_obs")).alias("g1"), F.count(F.lit(1)).alias("n_perm"))
    return g.select("model", "r_obs", "n_perm", ((F.col("g2") + 1) / (F.col("n_perm") + 1)).alias("p_two_sided"), ((F.col("g1") + 1) / (F.col("n_perm") + 1)).alias("p_greater"))


def permutation_importance(df, fits, features, names, y, block, fold="fold"):
    """Loss of R2 when a feature is shuffled inside its block: exact mean and spread over all shuffles, from moments of the blocks.

    Without the feature's term b x a row's residual is a; shuffled, its square is a^2 - 2 a b x' + b^2 x'^2 with x' from another row of
    the block.  The sum of c(i, j) = -2 A_i x_j + B_i x_j^2 (A = a b, B = b^2) over a shuffle has a mean from averages and a variance
    from covariances of (A, B) and of (x, x^2) inside the block; blocks are shuffled apart, so both add up.  No replicate is drawn.

    ``importance``: mean loss of R2; ``sd``: its standard deviation from shuffle to shuffle; ``importance_r``: loss of r at the expected
    moments of the shuffled prediction (r is no sum, so this is its mean up to a term that falls with the number of rows).
    Rows without y or without a prediction are left out; missing features stand at the fit's median, as in the prediction; a feature
    that is constant in every block has 0, and so has every feature where y does not vary.
    """
    block = list(block)
    base = complete(predict_linear(df, fits, features, fold), y, "y_pred")
    base = join_keys(base, fits.select(F.col("fold").alias(fold), "coef", "median"), [fold])
    x = F.zip_with(F.col(features), F.col("median"), lambda v, m: F.coalesce(F.when(~F.isnan(v), v), m).cast("double"))
    long = base.select(*block, F.col(y).cast("double").alias("y"), F.col("y_pred").alias("p"), F.posexplode(F.arrays_zip(x.alias("x"), F.col("coef").alias("b"))).alias("pos", "v"))
    long = long.select(*block, "pos", "y", "p", F.col("v.x").alias("x"), F.col("v.b").alias("b")).withColumn("u", F.col("p") - F.col("b") * F.col("x"))
    long = long.withColumns({"ab": (F.col("y") - F.col("u")) * F.col("b"), "bb": F.col("b") * F.col("b"), "xx": F.col("x") * F.col("x")})
    cov, var, ub = F.covar_pop, F.var_pop, F.col("u") * F.col("b")
    m = long.groupBy("pos", *block).agg(
        F.count(F.lit(1)).alias("n"), (2 * cov("ab", "x") - cov("bb", "xx")).alias("gain"),
        (4 * var("ab") * var("x") - 4 * cov("ab", "bb") * cov("x", "xx") + var("bb") * var("xx")).alias("spread"),
        F.avg("u").alias("u"), F.avg("b").alias("b"), F.avg("x").alias("x"), F.avg("xx").alias("xx"), F.avg("bb").alias("bb"), F.avg(ub).alias("ub"),
        F.avg(F.col("b") * F.col("y")).alias("by"), F.avg(F.col("u") * F.col("y")).alias("uy"), F.avg(F.col("u") * F.col("u")).alias("uu"),
        (F.max("x") > F.min("x")).alias("varies"))
    n = F.col("n")
    total = m.groupBy("pos").agg(
        F.sum("n").alias("n"), F.bool_or("varies").alias("varies"), F.sum(n * F.col("gain")).alias("gain"),
        F.sum(F.when(n > 1, n * n / (n - 1) * F.col("spread"))).alias("spread"),
        F.sum(n * (F.col("u") + F.col("b") * F.col("x"))).alias("s"), F.sum(n * (F.col("uy") + F.col("by") * F.col("x"))).alias("sy"),
        F.sum(n * (F.col("uu") + 2 * F.col("ub") * F.col("x") + F.col("bb") * F.col("xx"))).alias("ss"))
    whole = base.agg(F.avg(F.col(y).cast("double")).alias("my"), F.var_pop(F.col(y).cast("double")).alias("vy"), F.try_divide(F.covar_pop(F.col(y).cast("double"), "y_pred"), F.sqrt(F.var_pop(F.col(y).cast("double")) * F.var_pop("y_pred"))).alias("r0"))
    t = with_row(total, whole)
    r1 = F.try_divide(F.col("sy") / n - F.col("s") / n * F.col("my"), F.sqrt((F.col("ss") / n - F.pow(F.col("s") / n, 2)) * F.col("vy")))
    labels = F.array(*[F.lit(v) for v in names])
    zero = lambda e: F.coalesce(F.when(F.col("varies"), e), F.lit(0.0))
    return t.select(F.get(labels, F.col("pos")).alias("feature"), zero(F.try_divide(F.col("gain") / n, F.col("vy"))).alias("importance"), zero(F.col("r0") - r1).alias("importance_r"),
                    zero(F.try_divide(F.sqrt(F.greatest(F.col("spread"), F.lit(0.0))) / n, F.col("vy"))).alias("sd"))


def learning_curve(df, subject, x, y, order, shares=(0.1, 0.2, 0.4, 0.6, 0.8, 1.0), seed=42):
    """Group-out r and R2 against the share of trials kept from each training subject.

    A subject's draw order is fixed, so a share is a prefix of it: ceil(n f) trials, at least one.
    """
    ok = with_index(complete(df, x, y), [subject], list(order), "__k")
    ok = with_totals(ok.withColumn("__h", seeded_hash(seed, F.lit(1), F.col("__k"))), [subject], {"__n": F.count(F.lit(1))})
    ok = with_index(ok, [subject], ["__h", "__k"], "__d")
    rows = ok.select(subject, x, y, "__d", "__n", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    kept = rows.where(F.col("__d") < F.greatest(F.ceil(F.round(F.col("__n") * F.col("share"), 9)), F.lit(1)))
    train = logo_lines(_pair_sums(kept, ["share", subject], x, y), subject, ["share"]).select("share", subject, "slope", "intercept", F.col("n").alias("kept"))
    test = _pair_sums(ok, [subject], x, y)
    j = join_keys(train, test, [subject])
    n = j.groupBy("share").agg(F.sum("kept").alias("n_train"))
    return join_keys(pooled_scores(j, ["share"]), n, ["share"])


def prediction_frame(meta, predictions, keys, model):
    """Metadata, truth, prediction, model name and fold in one table."""
    return join_keys(meta, predictions.select(*keys, "y_true", "y_pred", "fold"), list(keys)).withColumn("model", F.lit(model))


# ---------------------------------------------------------------- models fitted by Spark ML


def _vector(df, features, keep):
    from pyspark.ml.functions import array_to_vector

    return df.select(*keep, array_to_vector(F.transform(features, lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))).alias("features"))


def forest_nested(df, features, y, fold="fold", n_folds=3, grid=({"maxDepth": 3}, {"maxDepth": 5}), trees=20, seed=42):
    """Random forest per outer fold; its settings are searched over the other folds; out-of-fold predictions."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    keep = [c for c in df.columns if c != features]
    data = stored(_vector(df, features, keep).withColumn("__all", F.col(fold)), "vectors")
    rf = RandomForestRegressor(featuresCol="features", labelCol=y, predictionCol="y_pred", numTrees=trees, seed=seed)
    builder = ParamGridBuilder()
    for name in {k for g in grid for k in g}:
        builder = builder.addGrid(rf.getParam(name), sorted({g[name] for g in grid if name in g}))
    out = None
    for k in range(n_folds):
        # Inner folds are the outer ones still in training, numbered from 0.
        train = data.where(F.col(fold) != k).withColumn("__inner", F.when(F.col(fold) > k, F.col(fold) - 1).otherwise(F.col(fold)).cast("int"))
        cv = CrossValidator(estimator=rf, estimatorParamMaps=builder.build(), evaluator=RegressionEvaluator(labelCol=y, predictionCol="y_pred", metricName="r2"),
                            numFolds=n_folds - 1, foldCol="__inner", parallelism=4)
        model = cv.fit(train)
        best = model.bestModel
        pred = best.transform(data.where(F.col(fold) == k)).select(*keep, "y_pred", F.lit(best.getMaxDepth()).alias("max_depth"), F.lit(float(max(model.avgMetrics))).alias("best_r2"))
        out = pred if out is None else out.unionByName(pred)
    return out


def subject_identifiability(df, subject, features, fold="fold", reg=0.01, max_iter=100):
    """Predict the subject from its features, each fold by a model of the others.

    Per subject: AUC against the rest, rows and hits, the mean AUC, how often each subject was predicted for its rows
    (``confusion``: predicted subject -> rows), and ``unsettled``, the number of fits that used up their iterations.  The
    folds are those in the data; a row without one is an error.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import vector_to_array

    data = _vector(df, features, [subject, fold])
    indexer = StringIndexer(inputCol="__s", outputCol="__y", stringOrderType="alphabetAsc").fit(data.withColumn("__s", F.col(subject).cast("string")))
    data = stored(indexer.transform(data.withColumn("__s", F.col(subject).cast("string"))), "labelled")
    lr = LogisticRegression(family="multinomial", labelCol="__y", regParam=reg, maxIter=max_iter)
    folds = sorted(r[0] for r in data.select(fold).distinct().collect() if r[0] is not None)
    if data.where(F.col(fold).isNull()).limit(1).count():
        raise ValueError("rows without a fold")
    parts, unsettled = [], 0
    for k in folds:
        model = lr.fit(data.where(F.col(fold) != k))
        unsettled += int(model.summary.totalIterations >= max_iter)
        parts.append(model.transform(data.where(F.col(fold) == k)).select("__y", "__s", F.col("prediction"), vector_to_array("probability").alias("prob")))
    pred = reduce(lambda one, two: one.unionByName(two), parts)
    pred = stored(pred, "predictions")
    long = pred.select("__y", F.posexplode("prob").alias("cls", "score")).withColumn("label", (F.col("__y") == F.col("cls")).cast("int"))
    per = auc(long, ["cls"], "label", "score", 2)
    hits = pred.groupBy(F.col("__y").cast("int").alias("cls")).agg(F.first("__s").alias(subject), F.count(F.lit(1)).alias("n"), F.count_if(F.col("__y") == F.col("prediction")).alias("n_correct"))
    names = F.array(*[F.lit(x) for x in indexer.labels])
    confusion = pred.groupBy(F.col("__y").cast("int").alias("cls"), F.get(names, F.col("prediction").cast("int")).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    confusion = confusion.groupBy("cls").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "c")))).alias("confusion"))
    out = per.join(hits, "cls").join(confusion, "cls").select(subject, "auc", "n", "n_correct", "confusion", F.lit(unsettled).alias("unsettled"))
    return with_totals(out, [], {"macro_auc": F.avg("auc")})


# ---------------------------------------------------------------- train time x test time


def temporal_generalization(df, fold, t, features, y, n_folds=None, alphas=(0.01, 0.1, 1.0, 10.0, 100.0)):
    """Ridge trained at each time and scored (r) at every time, per outer fold; fold means weighted by test size.

    Training uses the other folds' products at the train time; scoring uses the held-out
    fold's products at the test time, so a score costs p x p numbers and no rows.  The penalty of each (fold, time) is the
    one with the best mean r over the other folds in turn (the first where there is no such score): one decomposition of a
    product gives all penalties.  The folds are those in the data; ``n_folds`` only checks them.
    """
    grams = stored(cross_products(df, [fold, t], features, y), "products")
    fold_ids(df, fold, grams.withColumnRenamed(fold, "part"), n_folds)
    types = dict(grams.dtypes)

    def fit(pdf):
        size = int(round(len(pdf["gram"].iloc[0]) ** 0.5))
        p = (size - 2) // 2
        g = {int(k): filled(np.asarray(v, float).reshape(size, size), np.zeros(p)) for k, v in zip(pdf[fold], pdf["gram"])}
        rows = []
        for k in g:
            rest = [f for f in g if f != k]
            if not rest:
                continue
            train = sum(g[f] for f in rest)
            inner = [[line_scores(g[f], *line)[1] for line in ridge_path(train - g[f], alphas)] for f in rest] if len(rest) > 1 else []
            known = ~np.isnan(np.array(inner, dtype=float).reshape(-1, len(alphas)))
            mean = np.where(known, np.array(inner, dtype=float).reshape(-1, len(alphas)), 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
            best = int(np.argmax(np.where(known.any(axis=0), mean, -np.inf)))
            b, c = ridge_path(train, alphas)[best]
            rows.append({"t_train": pdf[t].iloc[0], "fold": k, "w": [*b, c]})
        return pd.DataFrame(rows, columns=["t_train", "fold", "w"])

    fits = grams.groupBy(t).applyInPandas(fit, f"t_train {types[t]}, fold int, w array<double>")

    @F.pandas_udf("double")
    def score(w: pd.Series, gram: pd.Series) -> pd.Series:
        out = []
        for a, m in zip(w, gram):
            size = int(round(len(m) ** 0.5))
            p = (size - 2) // 2
            r = line_scores(filled(np.asarray(m, float).reshape(size, size), np.zeros(p)), np.asarray(a[:-1]), a[-1])[1]
            out.append(None if not np.isfinite(r) else float(r))
        return pd.Series(out, dtype="float64")

    n_rows = F.sqrt(F.size("gram")).cast("int")
    test = grams.select(F.col(fold).cast("int").alias("fold"), F.col(t).alias("t_test"), "gram", F.element_at("gram", (n_rows * (n_rows - 2) + n_rows - 1).cast("int")).alias("weight"))
    s = fits.join(test, "fold").select("t_train", "t_test", "fold", "weight", score("w", "gram").alias("r")).where("r is not null")
    return s.groupBy("t_train", "t_test").agg((F.sum(F.col("r") * F.col("weight")) / F.sum("weight")).alias("score"), F.count(F.lit(1)).alias("n_folds"))


PACK_ROWS, BUCKET_SCORES = 4096, 262144


def _packed(batches):
    """Sorted rows (part, t, x, y) as blocks of at most ``PACK_ROWS`` of one fold and time; rows without a label are left out."""
    for pdf in batches:
        pdf = pdf[pdf["y"].notna()]
        for (part, t), rows in pdf.groupby(["part", "t"], sort=False, dropna=False):
            for at in range(0, len(rows), PACK_ROWS):
                some = rows.iloc[at:at + PACK_ROWS]
                x = np.stack([np.asarray(v, float) for v in some["x"]])
                yield pd.DataFrame({"part": [part], "t": [t], "h": [some["__h"].iloc[0]], "x": [x.ravel()], "y": [some["y"].to_numpy("int32")]})


def _held_out_auc(data, size, w, tt):
    """(fold, t_train, t_test, auc, weight) of every fold's rows under its own models, from packed blocks.

    A block's scores leave as distinct values with counts, cut into score ranges of about ``BUCKET_SCORES`` rows; wins are counted
    inside a range and ranges are put together from their totals.  The ranges are quantiles of one block's scores; they decide how
    the work is dealt, not the result.
    """
    def scored(flat, y, weights):
        x = np.asarray(flat, float).reshape(len(y), -1)
        out = np.zeros(len(y))  # feature by feature, so that equal rows have equal scores in every block
        for j in range(x.shape[1]):
            out += x[:, j] * weights[j]
        return out

    def ranges(batches):
        for pdf in batches:
            made = []
            for n, flat, y, models in zip(pdf["n"], pdf["x"], pdf["y"], pdf["models"]):
                share = np.arange(1, -(-n // BUCKET_SCORES)) / -(-n // BUCKET_SCORES)
                scores = [scored(flat, y, m["w"]) for m in models]
                made.append([{"t": m["t"], "w": m["w"], "edges": np.quantile(v[np.isfinite(v)], share) if len(share) and np.isfinite(v).any() else []} for m, v in zip(models, scores)])
            yield pdf[["fold", "t_test"]].assign(models=made)

    def scores(batches):
        for pdf in batches:
            for fold, t_test, flat, y, models in zip(pdf["fold"], pdf["t_test"], pdf["x"], pdf["y"], pdf["models"]):
                y, out = np.asarray(y), []
                for m in models:
                    v = scored(flat, y, m["w"])
                    ok = ~np.isnan(v) & ((y == 0) | (y == 1))
                    value, at = np.unique(v[ok], return_inverse=True)
                    pos, n = (np.bincount(at, weights=g, minlength=len(value)).astype(np.int64) for g in (y[ok] == 1, y[ok] == 0))
                    edges = np.asarray(m["edges"], float)
                    cut = np.searchsorted(value, edges, side="right")
                    for k, (i, j) in enumerate(zip([0, *cut], [*cut, len(value)])):
                        if j > i:
                            out.append((fold, m["t"], t_test, k, value[i:j], pos[i:j], n[i:j]))
                yield pd.DataFrame(out, columns=["fold", "t_train", "t_test", "bucket", "v", "pos", "neg"])

    def wins(key, pdf):
        v, pos, neg = (np.concatenate(list(pdf[c])) for c in ("v", "pos", "neg"))
        value, at = np.unique(v, return_inverse=True)
        pos, neg = (np.bincount(at, weights=c, minlength=len(value)) for c in (pos, neg))
        return pd.DataFrame([(*key, float((pos * (np.cumsum(neg) - neg / 2)).sum()), int(pos.sum()), int(neg.sum()))])

    models = w.groupBy("fold").agg(F.collect_list(F.struct("t", "w")).alias("models"))
    one = data.groupBy(F.col("part").alias("fold"), F.col("t").alias("t_test")).agg(F.max_by(F.struct("x", "y"), F.struct(F.size("y"), "h")).alias("b"))
    one = one.join(size.select(F.col("part").alias("fold"), F.col("t").alias("t_test"), "n"), ["fold", "t_test"]).join(models, "fold").select("fold", "t_test", "n", "b.x", "b.y", "models")
    cut = one.mapInPandas(ranges, f"fold int, t_test {tt}, models array<struct<t: {tt}, w: array<double>, edges: array<double>>>")
    rows = data.select(F.col("part").alias("fold"), F.col("t").alias("t_test"), "x", "y").join(stored(cut, "ranges"), ["fold", "t_test"])
    keys = f"fold int, t_train {tt}, t_test {tt}, bucket int"
    rows = rows.mapInPandas(scores, f"{keys}, v array<double>, pos array<long>, neg array<long>")
    won = rows.groupBy("fold", "t_train", "t_test", "bucket").applyInPandas(wins, f"{keys}, wins double, pos long, neg long")
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("fold", "t_train", "t_test").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = won.withColumn("wins", F.col("wins") + F.col("pos") * below)
    g = won.groupBy("fold", "t_train", "t_test").agg(F.sum("wins").alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos > 0 and neg > 0")
    return g.select("fold", "t_train", "t_test", (F.col("wins") / F.col("pos") / F.col("neg")).alias("auc"), (F.col("pos") + F.col("neg")).alias("weight"))


def temporal_generalization_auc(df, fold, t, features, label, n_folds=None, c=1.0, rounds=50, tol=1e-10):
    """Balanced logistic model trained at each time, AUC at every time.

    All (fold, time) models take their Newton steps together: each step is one pass that sums
    gradients and curvature per model in the tasks, followed by a p x p solve per model.  A step that lowers a model's
    penalised likelihood is halved; a model is done when a full step would gain less than ``tol`` of it, and takes no
    further part.  ``unsettled`` counts the fold models of the training time that used up ``rounds``.  The folds are those in the
    data; ``n_folds`` only checks them.
    """
    data = df.select(F.col(fold).cast("int").alias("part"), F.col(t).alias("t"), F.transform(features, lambda v: v.cast("double")).alias("x"), F.col(label).cast("int").alias("y"))
    # Blocks of rows of one fold and time, as arrays; the hash deals a large fold to many tasks and makes a block a fair draw of its rows.
    data = data.withColumn("__h", F.xxhash64("x", "y")).repartition("part", "t", F.pmod("__h", F.lit(64))).sortWithinPartitions("part", "t", "__h")
    tt = dict(data.dtypes)["t"]
    data = stored(data.mapInPandas(_packed, f"part int, t {tt}, h long, x array<double>, y array<int>"), "epochs")
    ones, zeros = F.size(F.filter("y", lambda v: v == 1)), F.size(F.filter("y", lambda v: v == 0))
    size = data.groupBy("part", "t").agg(F.sum(ones).alias("n1"), F.sum(zeros).alias("n0"), F.sum(F.size("y")).alias("n"))
    ids = F.array(*[F.lit(i) for i in fold_ids(data, "part", size, n_folds)])
    base = size.withColumn("fold", F.explode(ids)).where("part <> fold").groupBy("fold", "t").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where("n1 > 0 and n0 > 0")
    first = df.select(F.size(features).alias("p")).limit(1)
    zero = F.array_repeat(F.lit(0.0), F.col("p") + 1)
    w = with_row(base, first).withColumns({"w": zero, "best": zero, "step": zero, "goal": F.lit(None).cast("double"), "done": F.lit(False)}).drop("p")
    w = stored(w, "weights")

    def sums(batches):
        acc = {}
        for pdf in batches:
            for part, time, flat, y, models in zip(pdf["part"], pdf["t"], pdf["x"], pdf["y"], pdf["models"]):
                yy = np.asarray(y, float)
                x = np.hstack([np.asarray(flat, float).reshape(len(yy), -1), np.ones((len(yy), 1))])
                for m in models:
                    if m["fold"] == part:
                        continue
                    n1, n0 = float(m["n1"]), float(m["n0"])
                    cw = np.where(yy == 1, (n1 + n0) / (2 * n1), (n1 + n0) / (2 * n0))
                    z = x @ np.asarray(m["w"], float)
                    mu = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    gain = -(cw * np.logaddexp(0.0, np.where(yy == 1, -z, z))).sum()
                    v = np.concatenate([((x * (cw * mu * (1 - mu))[:, None]).T @ x).ravel(), x.T @ (cw * (yy - mu)), [gain]])
                    key = (m["fold"], time)
                    acc[key] = acc[key] + v if key in acc else v
        for (f, time), v in acc.items():
            yield pd.DataFrame({"fold": np.array([f], dtype="int32"), "t": [time], "v": [v]})

    def newton(batches):
        for pdf in batches:
            out = []
            for at, best, step, goal, v in zip(pdf["w"], pdf["best"], pdf["step"], pdf["goal"], pdf["v"]):
                at, best, step, v = (np.asarray(m, float) for m in (at, best, step, v))
                q = len(at)
                pen = np.append(np.full(q - 1, 1 / c), 0.0)
                now = v[-1] - 0.5 * (pen * at * at).sum()
                if np.isnan(goal) or now >= goal - 1e-12 * abs(goal):
                    slope = v[q * q:-1] - pen * at
                    step = np.linalg.solve(v[:q * q].reshape(q, q) + np.diag(pen) + 1e-9 * np.eye(q), slope)
                    best, goal, done = at, now, slope @ step <= tol * (1 + abs(now))
                else:
                    step = step / 2
                    done = np.abs(step).max() <= 1e-14 * (1 + np.abs(best).max())
                out.append((best + step, best, step, goal, bool(done)))
            yield pdf[["fold", "t", "n1", "n0"]].assign(**{k: [o[i] for o in out] for i, k in enumerate(("w", "best", "step", "goal", "done"))})

    shape = f"fold int, t {tt}, n1 long, n0 long, w array<double>, best array<double>, step array<double>, goal double, done boolean"
    for _ in range(rounds):
        live = w.where("not done")
        if not live.limit(1).count():
            break
        models = live.groupBy("t").agg(F.collect_list(F.struct("fold", "w", "n1", "n0")).alias("models"))
        parts = data.join(models, "t").mapInPandas(sums, f"fold int, t {tt}, v array<double>").select("fold", "t", F.posexplode("v").alias("i", "e"))
        total = parts.groupBy("fold", "t", "i").agg(F.sum("e").alias("e")).groupBy("fold", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda z: z["e"]).alias("v"))
        moved = live.join(total, ["fold", "t"]).select("fold", "t", "n1", "n0", "w", "best", "step", "goal", "v").mapInPandas(newton, shape)
        w = stored(w.where("done").select("fold", "t", "n1", "n0", "w", "best", "step", "goal", "done").unionByName(moved), "weights")
    w = w.select("fold", "t", F.col("best").alias("w"), "done")
    # The intercept does not change the order of scores.
    a = _held_out_auc(data, size, w, tt)
    slow = w.groupBy(F.col("t").alias("t_train")).agg(F.count_if(~F.col("done")).alias("unsettled"))
    return a.join(slow, "t_train").groupBy("t_train", "t_test", "unsettled").agg((F.sum(F.col("auc") * F.col("weight")) / F.sum("weight")).alias("score"), F.count(F.lit(1)).alias("n_folds"))
