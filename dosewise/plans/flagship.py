"""Does the score rise with the stimulus level, per subject and for the group, after correction?"""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators.align import drop_rejected_trials
from ..operators.stats import bh_fdr, dose_response, fisher_group, ttest_one_sample
from ..session import stored
from .shapes import round6, with_row


def dose_response_report(spark, sf_dir):
    """Kept trials -> per-subject line and correlation -> correction over subjects -> group tests on each row."""
    trials = fx.trials(spark, sf_dir)
    kept = drop_rejected_trials(trials, fx.drop_log(trials), ("subject", "run", "trial_idx"))
    # One row per subject; stored because the table and both group tests read it.
    fits = bh_fdr(stored(dose_response(kept, ["subject"]), "fits"), [], "p_dose")
    slopes = ttest_one_sample(fits, [], "slope", 0.0, "greater").select(F.col("t").alias("group_t"), F.col("p").alias("group_p"))
    group = fisher_group(fits, [], "r_dose").select(F.col("r_group").alias("group_r"), F.col("ci_low").alias("group_ci_low"), F.col("ci_high").alias("group_ci_high"))
    return round6(with_row(with_row(fits, slopes), group))
