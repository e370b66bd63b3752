"""Registry of the checked queries: name -> Spark plan, and the SQL another engine must agree with."""

from ..plans.shapes import round6

QUERIES = {}
ORACLE = {}


def query(name, oracle=None, digits=6):
    def keep(fn):
        QUERIES[name] = lambda spark, sf_dir: round6(fn(spark, sf_dir), digits)
        if oracle:
            ORACLE[name] = oracle
        return fn
    return keep


def sql(ctes, body, keep, rounded="", digits=6):
    """Oracle text: the tables, the query as ``res``, then the columns to keep and those to round."""
    cols = [c.strip() for c in keep.split(",") if c.strip()]
    cols += [f"round({c}::DOUBLE, {digits}) + 0.0 AS {c}" for c in rounded.split()]
    head = ",\n".join([*([ctes] if isinstance(ctes, str) and ctes else ctes or []), f"res AS ({body})"])
    return f"WITH RECURSIVE {head}\nSELECT {', '.join(cols)} FROM res"


def sql_r(x, y, min_n=2):
    """Guarded correlation of two SQL expressions over the rows where both are present."""
    a, b = f"CASE WHEN ({y}) IS NOT NULL THEN ({x}) END", f"CASE WHEN ({x}) IS NOT NULL THEN ({y}) END"
    floor = f"1e-12 * greatest(abs(avg({a})), abs(avg({b})), 1.0)"
    return (f"CASE WHEN count({a}) >= {max(2, min_n)} AND var_samp({a}) >= {floor} AND var_samp({b}) >= {floor} THEN "
            f"greatest(-1.0, least(1.0, covar_samp({a}, {b}) / sqrt(var_samp({a}) * var_samp({b})))) END")


def sql_n(x, y):
    return f"count(CASE WHEN ({x}) IS NOT NULL AND ({y}) IS NOT NULL THEN 1 END)"


def sql_t_p(t, df):
    """Two-sided Student p by the gamma form of the series (a different route from the column version)."""
    nu = f"({df})::DOUBLE"
    c2 = f"({nu} / ({nu} + ({t}) * ({t})))"
    s = f"sqrt(({t}) * ({t}) / ({nu} + ({t}) * ({t})))"
    even = (f"{s} * list_sum(list_transform(range(0, ({df})::BIGINT // 2), lambda k: "
            f"exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow({c2}, k)))")
    odd = (f"2 / pi() * (atan(abs({t}) / sqrt({nu})) + CASE WHEN ({df}) = 1 THEN 0 ELSE {s} * sqrt({c2}) * "
           f"list_sum(list_transform(range(0, greatest(1, (({df})::BIGINT - 1) // 2)), lambda k: "
           f"sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow({c2}, k))) END)")
    z = f"(abs({t}) * (1 - 1 / (4 * {nu})) / sqrt(1 + ({t}) * ({t}) / (2 * {nu})))"
    return (f"CASE WHEN ({t}) IS NULL OR ({df}) IS NULL OR ({df}) < 1 THEN NULL "
            f"WHEN ({df}) > 1000 THEN 2 * {sql_normal_sf(z)} "
            f"WHEN ({df})::BIGINT % 2 = 0 THEN greatest(0.0, 1 - ({even})) ELSE greatest(0.0, 1 - ({odd})) END")


def sql_normal_sf(z):
    """Upper normal tail by the published Chebyshev fit."""
    a = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.5 * {a}))"
    coef = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807,
            -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223]
    poly = " + ".join(f"({c}) * pow({t}, {len(coef) - 1 - i})" for i, c in enumerate(coef))
    tail = f"(0.5 * {t} * exp(-({a} * {a}) + {poly}))"
    return f"(CASE WHEN ({z}) >= 0 THEN {tail} ELSE 1 - {tail} END)"


def sql_r_p(r, n):
    t = f"(({r}) * sqrt((({n}) - 2) / greatest(1 - ({r}) * ({r}), 1e-300)))"
    return (f"CASE WHEN ({r}) IS NULL OR ({n}) < 3 THEN NULL WHEN abs({r}) >= 1 THEN 0.0 "
            f"ELSE {sql_t_p(t, f'(({n}) - 2)')} END")


def sql_midrank(keys, x):
    """Average rank of x inside keys."""
    return (f"rank() OVER (PARTITION BY {keys} ORDER BY {x}) + "
            f"(count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0")
