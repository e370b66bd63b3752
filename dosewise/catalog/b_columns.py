"""Column operators on the driver's tables."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import columns as C
from .registry import query, sql

T, FE, SP, CE, MA = fx.SQL_TRIALS, fx.SQL_FEATURES, fx.SQL_SPECTRA, fx.SQL_CELLS, fx.SQL_MAPS


@query("pick_first_column", sql(T, "SELECT subject, trial_idx, temp AS stimulus, rating AS target, coalesce(CASE WHEN k > 50 THEN score END, rating, temp) AS first_value FROM trials",
                                "subject, trial_idx", "stimulus target first_value"))
def _(s, d):
    tr = fx.trials(s, d)
    tr = C.pick_first_column(tr, C.TEMPERATURE_ALIASES, "stimulus")
    tr = C.pick_first_column(tr, ["vas_final"], "target")
    tr = tr.withColumn("maybe", F.when(F.col("k") > 50, F.col("score")))
    return C.first_present(tr, ["maybe", "rating", "temp"], "first_value").select(
        "subject", "trial_idx", "stimulus", "target", "first_value")


@query("numeric_coerce", sql("", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN event_type ELSE \"value\"::VARCHAR END AS DOUBLE) AS x, TRY_CAST(event_type AS DOUBLE) AS y FROM events",
                             "event_id", "x y"))
def _(s, d):
    ev = fx.table(s, d, "events").select(
        "event_id", F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("value").cast("string")).alias("x"),
        F.col("event_type").alias("y"))
    return C.numeric_coerce(ev, ["x", "y"])


@query("select_trial_type", sql("", r"SELECT event_id, trim(regexp_replace('  ' || event_type || '   ' || (event_id % 3), '\s+', ' ', 'g')) AS trial_type FROM events WHERE event_type = 'view' AND event_id % 3 = 1 OR event_type = 'click'",
                                "event_id, trial_type"))
def _(s, d):
    ev = fx.table(s, d, "events").select("event_id", F.concat(F.lit("  "), "event_type", F.lit("   "), F.col("event_id") % 3).alias("trial_type"))
    return C.select_trial_type(ev, types=["view 1"], prefixes=["click"])


@query("temperature_label", sql(T, "SELECT subject, trial_idx, CASE WHEN temp = 49.3 THEN 'top' ELSE 'temp' || replace(printf('%.1f', temp), '.', 'p') END AS temp_label FROM trials",
                                "subject, trial_idx, temp_label"))
def _(s, d):
    return C.label_temperatures(fx.trials(s, d), known={49.3: "top"}).select("subject", "trial_idx", "temp_label")


@query("parse_feature_name", sql("", r"""SELECT event_id, split_part(event_type, 'z', 1) || '_' || (event_id % 4) AS band, 'ch' || (event_id % 7) AS channel,
  CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 11 AS INTEGER) ELSE -1 END AS run FROM events""", "event_id, band, channel, run"))
def _(s, d):
    ev = fx.table(s, d, "events").select(
        "event_id",
        F.concat(F.lit("pow_"), "event_type", F.lit("_"), F.col("event_id") % 4, F.lit("_ch"), F.col("event_id") % 7).alias("name"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("sub_run-0"), F.col("event_id") % 11, F.lit("_bold"))).otherwise("none").alias("file"))
    return C.parse_run_number(C.parse_feature_name(ev)).select("event_id", "band", "channel", "run")


# One name per vector element: four bands in turn, and both forms of the name for the first.
ELEMENTS = [f"alpha_power_c{i}" if i % 8 == 4 else f"pow_{('alpha', 'beta', 'gamma', 'delta')[i % 4]}_c{i}" for i in range(64)]
CHOSEN = [n for n in ELEMENTS if "alpha" in n or "beta" in n]


@query("select_band_columns", sql("", "SELECT vec_id, " + ", ".join(f"embedding[{ELEMENTS.index(n) + 1}]::DOUBLE AS {n}" for n in CHOSEN) + " FROM embeddings", "vec_id", " ".join(CHOSEN)))
def _(s, d):
    wide = fx.table(s, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(ELEMENTS)])
    return C.select_band_columns(wide, ["alpha", "beta"], keep=["vec_id"])


@query("finite_filter", sql(T, """SELECT subject, trial_idx, CASE WHEN k % 7 IN (0, 1) THEN NULL ELSE score END AS clean,
  CASE WHEN k % 7 IN (0, 1) THEN 0.0 ELSE score END AS filled, count(*) FILTER (k % 7 = 0) OVER w AS n_nan, count(*) FILTER (k % 7 = 1) OVER w AS n_inf
  FROM trials WINDOW w AS (PARTITION BY subject)""", "subject, trial_idx, n_nan, n_inf", "clean filled"))
def _(s, d):
    bad = F.when(F.col("k") % 7 == 0, float("nan")).when(F.col("k") % 7 == 1, float("-inf")).otherwise(F.col("score"))
    tr = fx.trials(s, d).withColumns({"clean": bad, "raw": bad})
    tr = C.finite_filter(tr, ["clean"])
    return C.nonfinite_to_zero(tr, ["subject"], "raw", "filled").select("subject", "trial_idx", "clean", "filled", "n_nan", "n_inf")


@query("binarize_labels", sql("", """SELECT doc_id, quality AS q01, CAST(toxic = 1 AS INTEGER) AS t12, CAST(quality = 1 AS INTEGER) AS sign, CAST(n_chars > 1000 AS INTEGER) AS long_text
  FROM labels JOIN documents USING (doc_id)""", "doc_id, q01, t12, sign, long_text"))
def _(s, d):
    lab = fx.table(s, d, "labels").join(fx.table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    lab = lab.withColumns({"a": F.col("toxic") + 1, "b": F.col("quality") * 2 - 1})
    out = C.binarize_labels(lab, [], "quality", "q01")
    out = C.binarize_labels(out, [], "a", "t12")
    out = C.binarize_labels(out, [], "b", "sign")
    return C.binarize_threshold(out, "n_chars", 1000, "long_text").select("doc_id", "q01", "t12", "sign", "long_text")


@query("onset_to_sample", sql(T, """SELECT subject, trial_idx, onset - min(onset) OVER w AS onset, CAST(round_even((onset - min(onset) OVER w) * 500, 0) AS BIGINT) AS sample
  FROM trials WINDOW w AS (PARTITION BY subject, run)""", "subject, trial_idx, sample", "onset"))
def _(s, d):
    return C.onset_to_sample(fx.trials(s, d), 500, ["subject", "run"], True).select("subject", "trial_idx", "onset", "sample")


ROIS = {"front": ["^c[0-3]$"], "back": ["^c(9|1[0-2])$", "^c8$"], "mid": ["^c[3-9]$"]}


@query("roi_assignment", sql(FE, r"""SELECT DISTINCT roi, 'EEG ' || channel || '-Ref' AS channel FROM features
  JOIN (VALUES ('front', '^c[0-3]$'), ('back', '^c(9|1[0-2])$'), ('back', '^c8$'), ('mid', '^c[3-9]$')) p(roi, pattern) ON regexp_matches(channel, pattern, 'i')""", "roi, channel"))
def _(s, d):
    ch = fx.features(s, d).select(F.concat(F.lit("EEG "), "channel", F.lit("-Ref")).alias("channel"))
    return C.roi_assignment(ch, ROIS)


@query("window_mask", sql(SP, """SELECT trial, channel, count(*) FILTER (t BETWEEN -2 AND 1) AS n_closed, count(*) FILTER (t >= -2 AND t < 1) AS n_open
  FROM spectra WHERE freq BETWEEN 5 AND 8 GROUP BY 1, 2""", "trial, channel, n_closed, n_open"))
def _(s, d):
    sp = C.window_mask(fx.spectra(s, d), 5, 8, -2, 1)
    return sp.groupBy("trial", "channel").agg(
        F.count("t").alias("n_closed"), F.count_if(C.in_window("t", -2, 1, closed=False)).alias("n_open"))


@query("flag_components", sql("", """SELECT event_id, CASE WHEN "value" / 100 > 0.8 AND event_type NOT IN ('view', 'click') THEN 'bad' ELSE 'good' END AS status FROM events""", "event_id, status"))
def _(s, d):
    ev = fx.table(s, d, "events").select("event_id", F.col("event_type").alias("label"), (F.col("value") / 100).alias("prob"))
    return C.flag_components(ev, ["view", "click"]).select("event_id", "status")


PREFIX_NAMES = "CASE s_nationkey % 8 WHEN 0 THEN 'FC' WHEN 1 THEN 'Fp' WHEN 2 THEN 'CP' WHEN 3 THEN 'PO' WHEN 4 THEN 'TP' WHEN 5 THEN 'Cz' WHEN 6 THEN 'O' ELSE 'AF' END || s_suppkey"


@query("roi_by_prefix", sql("", f"""SELECT DISTINCT roi, channel FROM (SELECT {PREFIX_NAMES} AS channel FROM supplier)
  JOIN (VALUES ('Frontal', 'FP'), ('Frontal', 'AF'), ('Frontal', 'F'), ('Central', 'C'), ('Parietal', 'P'), ('Occipital', 'O'), ('Occipital', 'PO'),
  ('Temporal', 'T'), ('Temporal', 'TP'), ('Temporal', 'FT'), ('Sensorimotor', 'FC'), ('Sensorimotor', 'C'), ('Sensorimotor', 'CP')) p(roi, prefix)
  ON starts_with(upper(channel), prefix) AND NOT (roi = 'Frontal' AND starts_with(upper(channel), 'FC'))""", "roi, channel"))
def _(s, d):
    return C.roi_by_prefix(fx.table(s, d, "supplier").select(F.expr(PREFIX_NAMES).alias("channel")))


@query("band_limits", sql(FE, """SELECT * FROM (SELECT band, fmin, CASE WHEN band = 'beta' THEN least(fmax, (SELECT max(freq) FROM features)) ELSE fmax END AS fmax
  FROM (VALUES ('delta', 1.0, 3.9), ('theta', 4.0, 7.9), ('alpha', 8.0, 12.9), ('beta', 12.5, 30.0), ('gamma', 30.1, 80.0)) b(band, fmin, fmax))
  WHERE fmin < fmax AND fmin <= (SELECT max(freq) FROM features)""", "band", "fmin fmax"))
def _(s, d):
    bands = dict(C.BANDS, beta=(12.5, 30.0))
    return C.band_limits(fx.features(s, d), bands, cap="beta")
