"""Composed reports, and the many-group scale table."""


from .. import fixtures as fx
from ..operators.stats import bh_fdr, spearman
from ..plans.flagship import dose_response_report
from .h_stats import DOSE, bh_ctes, fisher_group_ctes, rank_ctes
from .registry import query, sql, sql_t_p

FLAG = (fx.SQL_TRIALS + "," + fx.SQL_DROPS + ", kept AS (SELECT * FROM trials t WHERE NOT EXISTS (SELECT 1 FROM drops d WHERE d.subject = t.subject AND d.trial_idx = t.trial_idx)),"
        + DOSE.replace("FROM trials", "FROM kept") + "," + bh_ctes("fd", "dr", "", "p_dose") + "," + fisher_group_ctes("fg", "dr", "", "r_dose")
        + ", tt AS (SELECT avg(slope) / (stddev_samp(slope) / sqrt(count(slope))) AS group_t, count(slope) - 1 AS df FROM dr)")


@query("dose_response_report", sql(FLAG, f"SELECT fd.*, group_t, CASE WHEN group_t >= 0 THEN ({sql_t_p('group_t', 'df')}) / 2 ELSE 1 - ({sql_t_p('group_t', 'df')}) / 2 END AS group_p, r_group AS group_r, ci_low AS group_ci_low, ci_high AS group_ci_high FROM fd, tt, fg",
                                   "subject, n, reject", "slope intercept r_dose p_dose r_rating p_rating q crit_p group_t group_p group_r group_ci_low group_ci_high"))
def _(s, d):
    return dose_response_report(s, d)


LINE = "li AS (SELECT l_suppkey, l_quantity, l_extendedprice FROM lineitem),"


@query("supplier_rank_correlation", sql(LINE + rank_ctes("sp", "li", "l_suppkey", "l_quantity", "l_extendedprice", 10) + "," + bh_ctes("fd", "sp", "", "p"), "SELECT * FROM fd", "l_suppkey, n, reject", "r p q crit_p"))
def _(s, d):
    """The largest table: rank correlation of quantity and price per supplier, corrected."""
    li = fx.table(s, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")
    return bh_fdr(spearman(li, ["l_suppkey"], "l_quantity", "l_extendedprice", 10), [], "p")


