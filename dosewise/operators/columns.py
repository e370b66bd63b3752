"""Column choice, coercion, labels and row predicates."""

from pyspark.sql import functions as F

from ..functions.moments import clip  # noqa: F401  (part of the column toolbox)
from ..functions.scalars import canonical_channel, clean_number, squeeze_blanks, temperature_label
from ..plans.shapes import with_totals

# Column aliases and regions used by the experiment's tables.
TEMPERATURE_ALIASES = ["stimulus_temp", "stimulus_temperature", "temp", "temperature", "temp_celsius"]
PREFIX_REGIONS = {
    "Frontal": ["FP", "AF", "F"],
    "Central": ["C", "CZ"],
    "Parietal": ["P", "PZ"],
    "Occipital": ["O", "PO", "OZ"],
    "Temporal": ["T", "TP", "FT"],
    "Sensorimotor": ["FC", "C", "CP", "CZ"],
}
PREFIX_EXCLUDED = {"Frontal": ["FC"]}
BANDS = {"delta": (1.0, 3.9), "theta": (4.0, 7.9), "alpha": (8.0, 12.9), "beta": (13.0, 30.0), "gamma": (30.1, 80.0)}


def pick_first_column(df, aliases, name, fallback_words=("vas", "rating")):
    """Add ``name`` from the first alias present, else from a numeric column whose name holds a fallback word."""
    found = [a for a in aliases if a in df.columns]
    if not found:
        numeric = {c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")}
        found = [c for c in df.columns if c in numeric and any(w in c.lower() for w in fallback_words)]
    if not found:
        raise ValueError(f"none of {aliases} in {df.columns}")
    return df.withColumn(name, F.col(found[0]))


def first_present(df, columns, name):
    """Row by row, the first value present."""
    return df.withColumn(name, F.coalesce(*columns))


def numeric_coerce(df, columns):
    return df.withColumns({c: clean_number(F.col(c)) for c in columns})


def select_trial_type(df, types=(), prefixes=(), column="trial_type", default_prefix="stim"):
    """Rows whose blank-squeezed type equals a type or starts with a prefix."""
    if not types and not prefixes:
        prefixes = [default_prefix]
    df = df.withColumn(column, squeeze_blanks(F.col(column)))
    keep = F.col(column).isin(list(types)) if types else F.lit(False)
    for p in prefixes:
        keep = keep | F.col(column).startswith(p)
    return df.where(keep)


def label_temperatures(df, temp="temp", name="temp_label", known=None):
    return df.withColumn(name, temperature_label(F.col(temp), known))


def parse_feature_name(df, name="name", prefix="pow"):
    """Band and channel of ``pow_<band>_<channel>``; the split is at the last underscore."""
    pattern = rf"^{prefix}_(.+)_([^_]+)$"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    return df.withColumns({"band": part(1), "channel": part(2)})


def parse_run_number(df, name="file"):
    """Run number held in a file name, -1 if none."""
    run = F.regexp_extract(name, r"(?i)run-?0*(\d+)", 1)
    return df.withColumn("run", F.when(run == "", F.lit(-1)).otherwise(run.try_cast("int")))


def select_band_columns(df, bands, keep=()):
    """Power columns of the bands, by prefix and sorted by name."""
    starts = tuple(s for b in bands for s in (f"pow_{b}_", f"{b}_power_"))
    return df.select(*keep, *sorted(c for c in df.columns if c.startswith(starts)))


def finite_filter(df, columns):
    return df.withColumns({c: clean_number(F.col(c)) for c in columns})


def nonfinite_to_zero(df, keys, column, name="value"):
    """Values with NaN and infinities set to 0, and how many there were per group."""
    x = F.col(column).cast("double")
    nan, inf = F.isnan(x), F.abs(x) == float("inf")
    out = df.withColumn(name, F.when(nan | inf | x.isNull(), 0.0).otherwise(x))
    return with_totals(out, keys, {"n_nan": F.count_if(nan), "n_inf": F.count_if(inf)})


def binarize_labels(df, keys, column, name="label"):
    """Two label values to 0/1 per group; {0,1} is kept; more than two values raise."""
    x = F.col(column).cast("double")
    df = with_totals(df, keys, {"__lo": F.min(x), "__hi": F.max(x),
                                "__mid": F.min(F.struct(x.alias("x")))})
    # A third value is one that is neither end of the group's range.
    third = x.isNotNull() & (x != F.col("__lo")) & (x != F.col("__hi"))
    only_known = (F.col("__lo") == F.col("__hi")) & F.col("__lo").isin(0.0, 1.0)
    value = (
        F.when(third, F.raise_error(F.lit("more than two labels")).cast("int"))
        .when(x.isNull(), F.lit(None).cast("int"))
        .when(only_known, x.cast("int"))
        .otherwise((x == F.col("__hi")).cast("int"))
    )
    return df.withColumn(name, value).drop("__lo", "__hi", "__mid")


def binarize_threshold(df, column, threshold=100.0, name="label"):
    return df.withColumn(name, (F.col(column) > threshold).cast("int"))


def onset_to_sample(df, sfreq, run_keys=(), zero_base=False):
    """Sample number of an onset, half to even; zero-based on the run's first onset if asked."""
    onset = F.col("onset")
    if zero_base:
        df = with_totals(df, list(run_keys), {"__first": F.min("onset")})
        onset = onset - F.col("__first")
    return df.withColumns({"onset": onset, "sample": F.bround(onset * float(sfreq)).cast("long")}).drop("__first")


def roi_assignment(df, rois, channel="channel"):
    """(roi, channel) once for each region whose pattern fits the raw or canonical name.

    The patterns are settings, so they are tested inside the projection; no join.
    """
    names = df.select(channel).where(F.col(channel).isNotNull()).distinct()
    canon = canonical_channel(F.col(channel))
    hits = []
    for roi, patterns in rois.items():
        fit = F.lit(False)
        for p in patterns:
            fit = fit | canon.rlike("(?i)" + p) | F.col(channel).rlike("(?i)" + p)
        hits.append(F.when(fit, F.lit(roi)))
    return names.select(F.explode(F.array_compact(F.array(*hits))).alias("roi"), channel)


def roi_by_prefix(df, channel="channel", regions=None, excluded=None):
    """Regions from upper-case channel prefixes, minus the excluded prefixes."""
    regions, excluded = regions or PREFIX_REGIONS, PREFIX_EXCLUDED if excluded is None else excluded
    up = F.upper(canonical_channel(F.col(channel)))
    hits = []
    for roi, prefixes in regions.items():
        fit = F.lit(False)
        for p in prefixes:
            fit = fit | up.startswith(p)
        for p in excluded.get(roi, []):
            fit = fit & ~up.startswith(p)
        hits.append(F.when(fit, F.lit(roi)))
    names = df.select(channel).where(F.col(channel).isNotNull()).distinct()
    return names.select(F.explode(F.array_compact(F.array(*hits))).alias("roi"), channel)


def in_window(t, tmin, tmax, closed=True):
    """Closed limits for features, half-open for contrasts."""
    t = F.col(t) if isinstance(t, str) else t
    return t.between(tmin, tmax) if closed else (t >= tmin) & (t < tmax)


def window_mask(df, fmin, fmax, tmin, tmax, closed=True, freq="freq", t="t"):
    return df.where(F.col(freq).between(fmin, fmax) & in_window(t, tmin, tmax, closed))


def flag_components(df, keep_labels, threshold=0.8, label="label", prob="prob"):
    bad = (F.col(prob) > threshold) & ~F.col(label).isin(list(keep_labels))
    return df.withColumn("status", F.when(bad, "bad").otherwise("good"))


def band_expression(freq, bands):
    """Band name of a frequency, missing outside all bands (bands do not overlap)."""
    out = F.lit(None).cast("string")
    for band, (lo, hi) in bands.items():
        out = F.when(freq.between(lo, hi), F.lit(band)).otherwise(out)
    return out


def band_limits(df, bands=None, freq="freq", cap=None):
    """The band table with the ``cap`` band (default: the last) cut at the data's top frequency; empty bands go."""
    bands = bands or BANDS
    cap = cap or list(bands)[-1]
    rows = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(float(lo)).alias("fmin"), F.lit(float(hi)).alias("fmax"))
                     for b, (lo, hi) in bands.items()])
    top = df.agg(F.max(F.col(freq).cast("double")).alias("top"))
    out = top.select("top", F.inline(rows))
    out = out.withColumn("fmax", F.when(F.col("band") == cap, F.least("fmax", "top")).otherwise(F.col("fmax")))
    return out.where((F.col("fmin") < F.col("fmax")) & (F.col("fmin") <= F.col("top"))).select("band", "fmin", "fmax")
