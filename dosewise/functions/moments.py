"""Moments and the statistics that close over them.

Every aggregate here merges partial results, so a group of any size is reduced
before the shuffle.
"""

from pyspark.sql import functions as F

from .special import r_p_value


def both(x, y, value):
    """``value`` where x and y are both present."""
    return F.when(x.isNotNull() & y.isNotNull(), value)


def pair_aggs(x, y, tag=""):
    """Aggregates over the rows where both are present; close them with ``r_of``."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    x, y = x.cast("double"), y.cast("double")
    bx, by = both(x, y, x), both(x, y, y)
    return [
        F.count(bx).alias(f"n{tag}"),
        F.avg(bx).alias(f"mx{tag}"),
        F.avg(by).alias(f"my{tag}"),
        F.var_samp(bx).alias(f"vx{tag}"),
        F.var_samp(by).alias(f"vy{tag}"),
        F.covar_samp(bx, by).alias(f"cxy{tag}"),
    ]


def r_of(tag="", min_n=2):
    """Correlation from ``pair_aggs``: missing on too few rows or a variance near zero, else within [-1, 1]."""
    n, mx, my = F.col(f"n{tag}"), F.col(f"mx{tag}"), F.col(f"my{tag}")
    vx, vy, cxy = F.col(f"vx{tag}"), F.col(f"vy{tag}"), F.col(f"cxy{tag}")
    floor = 1e-12 * F.greatest(F.abs(mx), F.abs(my), F.lit(1.0))
    ok = (n >= max(2, min_n)) & (vx >= floor) & (vy >= floor)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cxy / F.sqrt(vx * vy))))


def r_with_p(agg, tag="", r="r", p="p", min_n=2, keep=()):
    """Replace the moment columns of ``agg`` by r, p and n."""
    moments = [f"{c}{tag}" for c in ("mx", "my", "vx", "vy", "cxy")]
    out = agg.withColumn(r, r_of(tag, min_n))
    if p:
        out = out.withColumn(p, r_p_value(F.col(r), F.col(f"n{tag}")))
    return out.drop(*[c for c in moments if c not in keep])


def clip(x, low, high):
    """``x`` within limits; missing stays missing (``least`` and ``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def fisher_z(r, limit=0.999999):
    return F.atanh(clip(r, -limit, limit))
