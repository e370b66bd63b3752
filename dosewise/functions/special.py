"""Student t and normal distribution as column expressions (no Python UDF)."""

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

TABLE_DF = 1000  # quantiles above this come from the expansion in 1 / df, whose error is below 1e-9 there


def let(fn, **values):
    """``fn`` of named values that are evaluated once, so that long formulas do not repeat their inputs."""
    row = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.get(F.transform(F.array(row), lambda s: fn(**{k: s[k] for k in values})), F.lit(0))


def erfc(z):
    """Complementary error function for z >= 0; Chebyshev fit, relative error below 1.2e-7."""
    # Coefficients of the published fit, highest power first.
    coef = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807,
            -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223]
    def fit(z, t):
        poly = F.lit(coef[0])
        for c in coef[1:]:
            poly = poly * t + F.lit(c)
        return t * F.exp(-z * z + poly)

    return let(fit, z=z, t=1.0 / (1.0 + 0.5 * z))


def normal_sf(z):
    """P(Z > z)."""
    tail = 0.5 * erfc(F.abs(z) / math.sqrt(2.0))
    return let(lambda z, tail: F.when(z >= 0, tail).otherwise(1.0 - tail), z=z, tail=tail)


def normal_cdf(z):
    return normal_sf(-z)


def normal_quantile(p):
    """Inverse normal by a published rational approximation, relative error below 1.2e-9."""
    # Coefficients of the approximation, highest power first.
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01, 1.0]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00, 1.0]
    low = 0.02425

    def horner(coef, x):
        out = F.lit(coef[0])
        for k in coef[1:]:
            out = out * x + F.lit(k)
        return out

    def tail(u):
        return let(lambda x: horner(c, x) / horner(d, x), x=F.sqrt(-2.0 * F.ln(u)))

    def pick(p, q, qq):
        return (
            F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(p < low, tail(p))
            .when(p > 1 - low, -tail(1.0 - p))
            .otherwise(horner(a, qq) * q / horner(b, qq))
        )

    return let(pick, p=p, q=p - 0.5, qq=(p - 0.5) * (p - 0.5))


NODES, WEIGHTS = (x.tolist() for x in np.polynomial.legendre.leggauss(48))
DEPTH = 45.0  # the integral stops where its integrand has fallen to exp(-DEPTH)


def t_two_sided(t, df):
    """Two-sided p of a t value, for any degrees of freedom from 1, with the same relative accuracy in the far tail.

    The tail is an integral of a power of the cosine from the angle of t to the right angle.  Scaled by its first value, the
    integrand falls from 1; it is summed at the nodes of a Gauss rule up to where nothing is left of it, and divided by the
    same sum from the angle 0.
    """
    return let(_t_tail, t=t.cast("double"), nu=df.cast("double"))


def _t_tail(t, nu):
    rule = F.array(*[F.struct(F.lit((1 + x) / 2).alias("x"), F.lit(w / 2).alias("w")) for x, w in zip(NODES, WEIGHTS)])

    def area(slope, most):
        # where slope * s + s * s / 2, which the logarithm falls by at least, reaches the depth
        room = F.when(nu > 1, 2 * DEPTH / (nu - 1) / (F.sqrt(slope * slope + 2 * DEPTH / (nu - 1)) + slope))
        end = F.least(most, F.coalesce(room, most))

        def at(acc, node):
            s = end * node["x"]
            half = F.sin(s / 2)
            return acc + node["w"] * F.exp((nu - 1) * F.log1p(F.greatest(-2 * half * half - slope * F.sin(s), F.lit(-1 + 1e-16))))

        return end * F.aggregate(rule, F.lit(0.0), at)

    slope = F.abs(t) / F.sqrt(nu)
    part = let(area, slope=slope, most=F.atan(1 / slope))
    whole = area(F.lit(0.0), F.lit(math.pi / 2))
    p = F.exp(-(nu - 1) / 2 * F.log1p(slope * slope)) * part / whole
    return F.when(t.isNull() | nu.isNull() | (nu < 1), F.lit(None).cast("double")).when(t == 0, 1.0).otherwise(F.least(F.lit(1.0), p))


def t_greater(t, df):
    """One-sided p for the alternative that the mean is above the null value."""
    return let(lambda t, half: F.when(t >= 0, half).otherwise(1 - half), t=t, half=t_two_sided(t, df) / 2)


def r_p_value(r, n):
    """Two-sided p of a correlation of n pairs (t with n - 2 degrees of freedom)."""
    def close(r, n):
        t = r * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-300)))
        return (
            F.when(r.isNull() | (n < 3), F.lit(None).cast("double"))
            .when(F.abs(r) >= 1, F.lit(0.0))
            .otherwise(t_two_sided(t, n - 2))
        )

    return let(close, r=r, n=n)


def _t_two_sided_all(t):
    """Two-sided p of ``t[i]`` at i + 1 degrees of freedom, the same series for all df at once."""
    nu = np.arange(1, len(t) + 1, dtype=float)
    even = nu % 2 == 0
    last = np.where(even, nu / 2 - 1, (nu - 1) / 2 - 1)
    cos2 = nu / (nu + t * t)
    sin, cos, theta = np.sqrt(1 - cos2), np.sqrt(cos2), np.arctan(t / np.sqrt(nu))
    term, total = np.ones_like(nu), np.ones_like(nu)
    for k in range(1, int(last.max()) + 1):
        term = term * np.where(even, (2 * k - 1) / (2 * k), 2 * k / (2 * k + 1)) * cos2
        total = total + np.where(k <= last, term, 0.0)
    odd = 2 / np.pi * (theta + np.where(nu > 1, sin * cos * total, 0.0))
    return 1 - np.where(even, sin * total, odd)


@lru_cache(maxsize=32)
def _t_table(prob):
    """Upper quantiles for df 1..TABLE_DF; the size is fixed and does not follow the data."""
    lo, hi = np.zeros(TABLE_DF), np.full(TABLE_DF, 2.0)
    while (_t_two_sided_all(hi) > 2 * (1 - prob)).any():
        hi = np.where(_t_two_sided_all(hi) > 2 * (1 - prob), 2 * hi, hi)
    for _ in range(60):
        mid = (lo + hi) / 2
        above = _t_two_sided_all(mid) > 2 * (1 - prob)
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return ((lo + hi) / 2).tolist()


def t_quantile(df, prob):
    """Quantile ``prob`` (above 0.5) of Student t for a column of whole-number df."""
    table = F.expr("array(" + ", ".join(f"{v!r}D" for v in _t_table(float(prob))) + ")")
    nu = df.cast("double")
    z = NormalDist().inv_cdf(float(prob))
    z3, z5 = z**3, z**5
    far = z + (z3 + z) / (4 * nu) + (5 * z5 + 16 * z3 + 3 * z) / (96 * nu * nu)
    return (
        F.when(df.isNull() | (df < 1), F.lit(None).cast("double"))
        .when(df > TABLE_DF, far)
        .otherwise(F.get(table, (df - 1).cast("int")))
    )
