"""Query shapes shared by the operators: ordered scans, ranks, quantiles, group totals.

A window function sends all rows of a partition key to one task, which is wrong when one subject holds a third of a large
table.  Each shape therefore has one plan, chosen by nothing: the rows are cut into ordered slices by range partitioning on
the keys and the *full* order (a hash of the row breaks ties), the slices are written once so that their numbers hold in every
later read, windows run inside a slice, and totals carried over from the earlier slices of the group make the result exact.
Ranks and quantiles first reduce the rows to distinct values with counts, so a heavy tie is one row.
"""

import re
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import stored

def once(df):
    """``df``, written to the shared folder first if computing it takes more than a scan.

    The shapes read their input several times; without this, nested ones would repeat all work below them.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    costly = re.search(r"Join|Aggregate|Window|Sort|Generate|Repartition|InPandas|MapInArrow|LogicalRDD|Union", plan)
    return stored(df, "once") if costly else df


def join_keys(left, right, keys, how="inner"):
    """Equi-join on keys that may be missing; the keys appear once."""
    tmp = {k: f"__r_{k}" for k in keys}
    right = right.withColumnsRenamed(tmp)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(tmp[k])) for k in keys])
    return left.join(right, cond, how).drop(*tmp.values())


def _sliced(df, keys, order):
    """``df`` with ``__slice`` and ``__tie``: ordered slices of the rows, stored; a group may lie in one or in many."""
    tied = df.withColumn("__tie", F.xxhash64(*df.columns))
    return stored(tied.repartitionByRange(*keys, *order, "__tie").withColumn("__slice", F.spark_partition_id()), "slices")


def ordered_scan(df, keys, order, outs):
    """Add running values along ``order`` inside ``keys``.

    ``outs`` maps a new column to ``(kind, expression)``:
    row_number, sum_before, sum_to, max_before, last_to, first_after, lag, lead.
    ``last_to``/``first_after`` skip missing values; ``order`` is ascending, of any orderable types, missing values first.
    Rows that ``order`` does not tell apart follow each other by a hash of the row.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    outs = {k: (kind, F.col(e) if isinstance(e, str) else e) for k, (kind, e) in outs.items()}
    base = list(df.columns)
    keys = list(keys)
    if not keys:
        df, keys = df.withColumn("__all", F.lit(0)), ["__all"]
    df = _sliced(df, keys, order)
    order = [*order, F.col("__tie")]
    part = keys + ["__slice"]
    fwd = Window.partitionBy(*part).orderBy(*order)
    back = Window.partitionBy(*part).orderBy(*[o.desc() for o in order])
    upto, before = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    local = {
        "row_number": lambda e: F.row_number().over(fwd).cast("long"),
        "sum_to": lambda e: F.sum(e).over(fwd.rowsBetween(*upto)),
        "sum_before": lambda e: F.sum(e).over(fwd.rowsBetween(*before)),
        "max_before": lambda e: F.max(e).over(fwd.rowsBetween(*before)),
        "last_to": lambda e: F.last(e, True).over(fwd.rowsBetween(*upto)),
        "first_after": lambda e: F.last(e, True).over(back.rowsBetween(*upto)),
        "lag": lambda e: F.lag(e).over(fwd),
        "lead": lambda e: F.lead(e).over(fwd),
    }
    first_row = F.row_number().over(fwd) == 1
    last_row = F.row_number().over(back) == 1
    res = df.withColumns({f"__l_{k}": local[kind](e) for k, (kind, e) in outs.items()})
    res = res.withColumns({"__first": first_row, "__last": last_row})
    at = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    carry_aggs = {
        "row_number": lambda e: F.count(F.lit(1)),
        "sum_to": F.sum,
        "sum_before": F.sum,
        "max_before": F.max,
        "last_to": lambda e: F.max_by(e, F.when(e.isNotNull(), at)),
        "first_after": lambda e: F.min_by(e, F.when(e.isNotNull(), at)),
        "lag": lambda e: F.max_by(F.struct(e.alias("v")), at),
        "lead": lambda e: F.min_by(F.struct(e.alias("v")), at),
    }
    carry = df.groupBy(*part).agg(*[carry_aggs[kind](e).alias(f"__c_{k}") for k, (kind, e) in outs.items()])
    over = Window.partitionBy(*keys).orderBy("__slice")
    over_back = Window.partitionBy(*keys).orderBy(F.col("__slice").desc())
    earlier, later = over.rowsBetween(*before), over_back.rowsBetween(*before)
    spread = {
        "row_number": lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)),
        "sum_to": lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)),
        "sum_before": lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)),
        "max_before": lambda c: F.max(c).over(earlier),
        "last_to": lambda c: F.last(c, True).over(earlier),
        "first_after": lambda c: F.last(c, True).over(later),
        "lag": lambda c: F.lag(c).over(over)["v"],
        "lead": lambda c: F.lead(c).over(over)["v"],
    }
    carry = carry.select(*part, *[spread[kind](F.col(f"__c_{k}")).alias(f"__p_{k}") for k, (kind, _) in outs.items()])
    res = join_keys(res, carry, part, "left")

    def combine(kind, k):
        here, past = F.col(f"__l_{k}"), F.col(f"__p_{k}")
        if kind in ("row_number", "sum_to", "sum_before"):
            return F.coalesce(here, F.lit(0)) + past
        if kind == "max_before":
            return F.greatest(here, past)
        if kind == "lag":
            return F.when(F.col("__first"), past).otherwise(here)
        if kind == "lead":
            return F.when(F.col("__last"), past).otherwise(here)
        return F.coalesce(here, past)

    return res.select(*base, *[combine(kind, k).alias(k) for k, (kind, _) in outs.items()])


def with_index(df, keys, order, name="idx", start=0):
    """Position of each row inside its group, counted from ``start``."""
    out = ordered_scan(df, keys, order, {name: ("row_number", F.lit(1))})
    return out.withColumn(name, F.col(name) - 1 + start)


def with_row(df, one):
    """Attach the columns of a one-row frame, as one scalar subquery."""
    row = one.select(F.struct(*one.columns).alias("__row")).scalar()
    out = df.withColumn("__row", row)
    return out.withColumns({c: F.col("__row")[c] for c in one.columns}).drop("__row")


def with_totals(df, keys, aggs):
    """Attach group aggregates to the rows: one merged aggregate joined back, so that no task holds a group."""
    keys = list(keys)
    df = once(df)
    if not keys:
        return with_row(df, df.agg(*[a.alias(k) for k, a in aggs.items()]))
    return join_keys(df, df.groupBy(*keys).agg(*[a.alias(k) for k, a in aggs.items()]), keys, "left")


def with_midrank(df, keys, cols):
    """Add average ranks (ties share their mean rank) of non-missing values; ``cols`` maps value to rank name.

    Distinct values are ranked with their counts, so a heavy tie is one row.
    """
    keys = list(keys)
    df = once(df)
    kinds = dict(df.dtypes)
    common = kinds[next(iter(cols))] if len({kinds[x] for x in cols}) == 1 else "double"
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("__col"), F.col(x).cast(common).alias("__x")) for k, x in enumerate(cols)]))
    vc = df.select(*keys, values.alias("__v")).select(*keys, "__v.*").where(F.col("__x").isNotNull())
    vc = vc.groupBy(*keys, "__col", "__x").agg(F.count(F.lit(1)).alias("__n"))
    vc = once(ordered_scan(vc, [*keys, "__col"], ["__x"], {"__b": ("sum_before", "__n")}))
    for k, (x, out) in enumerate(cols.items()):
        own = vc.where(F.col("__col") == k).select(*keys, F.col("__x").alias("__own"), (F.col("__b") + (F.col("__n") + 1) / 2.0).alias(out))
        df = join_keys(df.withColumn("__own", F.col(x).cast(common)), own, [*keys, "__own"], "left").drop("__own")
    return df


def with_midrank_in(df, keys, cols):
    """The same where a parameter of the caller bounds the rows of a group: one window for each value."""
    def rank(x):
        by, tie = Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last()), Window.partitionBy(*keys, x)
        return F.when(F.col(x).isNotNull(), F.rank().over(by) + (F.count(F.lit(1)).over(tie) - 1) / 2.0)

    return df.withColumns({out: rank(x) for x, out in cols.items()})


def quantiles(df, keys, x, points):
    """Linear-interpolated quantiles per group; ``points`` maps a name to a probability."""
    x = F.col(x) if isinstance(x, str) else x
    keys = list(keys)
    df = once(df.select(*keys, x.cast("double").alias("__x")))
    vc = df.where(F.col("__x").isNotNull()).groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__n"))
    vc = with_totals(ordered_scan(vc, keys, ["__x"], {"__b": ("sum_before", "__n")}), keys, {"__t": F.sum("__n")})
    aggs = []
    for k, q in points.items():
        pos = float(q) * (F.col("__t") - 1)
        for end, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("__b") <= at) & (at < F.col("__b") + F.col("__n"))
            aggs.append(F.max(F.when(hit, F.col("__x"))).alias(f"__{end}_{k}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"__f_{k}"))
    out = vc.groupBy(*keys).agg(*aggs)
    out = out.select(*keys, *[
        (F.col(f"__lo_{k}") + (F.col(f"__hi_{k}") - F.col(f"__lo_{k}")) * F.col(f"__f_{k}")).alias(k) for k in points
    ])
    return join_keys(df.select(*keys).distinct(), out, keys, "left") if keys else out


def replicate_quantiles(df, keys, x, points):
    """The same for groups that hold one value per replicate, whose number the caller states: one exact aggregate."""
    return df.groupBy(*keys).agg(*[F.percentile(x, float(q)).alias(k) for k, q in points.items()])


def replicates(n):
    """Replicate numbers 1..n as an array to explode."""
    return F.sequence(F.lit(1).cast("long"), F.lit(int(n)).cast("long"))


def round6(df, digits=6):
    """Round all double columns as the reports do."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])
