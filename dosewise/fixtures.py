"""The driver's tables seen as trials, cells and spectra (the mapping of FIXTURES.md)."""

from pyspark.sql import functions as F

from .plans.shapes import with_index, with_totals

TRIALS_PER_RUN = 11


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark, sf_dir):
    """One row per event as a trial: subject, run, trial_idx, onset, temp, rating, pain, score."""
    k = F.get_json_object("props", "$.k").cast("int")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"), "event_id", micros.alias("us"),
        F.col("event_type").alias("trial_type"), F.col("value").alias("rating"), k.alias("k"))
    ev = with_index(ev, ["subject"], ["us", "event_id"], "trial_idx")
    ev = with_totals(ev, ["subject"], {"us0": F.min("us")})
    level = F.floor(F.col("k") / 17).cast("int")
    return ev.select(
        "subject",
        F.floor(F.col("trial_idx") / TRIALS_PER_RUN).cast("int").alias("run"),
        "trial_idx", "event_id",
        ((F.col("us") - F.col("us0")) / 1e6).alias("onset"),
        (1 + F.col("rating") % 10).alias("duration"),
        "trial_type", "k", level.alias("level"), (F.lit(44.3) + level).alias("temp"),
        "rating", (F.col("rating") > 50).cast("int").alias("pain"),
        (F.ln(1 + F.col("rating")) + F.col("k") / 100).alias("score"))


SQL_TRIALS = """ev0 AS (SELECT user_id AS subject, event_id, epoch_us(ts) AS us, event_type AS trial_type, value AS rating,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
trials AS (SELECT subject, CAST((row_number() OVER w - 1) // 11 AS INTEGER) AS run, row_number() OVER w - 1 AS trial_idx, event_id,
  (us - min(us) OVER (PARTITION BY subject)) / 1e6 AS onset, 1 + rating % 10 AS duration, trial_type, k,
  CAST(k // 17 AS INTEGER) AS level, 44.3::DOUBLE + k // 17 AS temp, rating, CAST(rating > 50 AS INTEGER) AS pain,
  ln(1 + rating) + k / 100 AS score FROM ev0 WINDOW w AS (PARTITION BY subject ORDER BY us, event_id))"""


def drop_log(tr):
    """Rejected trials: errors whose event id is a multiple of seven."""
    return tr.where((F.col("trial_type") == "error") & (F.col("event_id") % 7 == 0)).select(
        "subject", "run", "trial_idx", F.lit("artifact").alias("reason"))


SQL_DROPS = """drops AS (SELECT subject, run, trial_idx, 'artifact' AS reason FROM trials
  WHERE trial_type = 'error' AND event_id % 7 = 0)"""


def cells(spark, sf_dir):
    """One row per vector element: subject (label), run, trial (vec_id), cell, value."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("subject"), (F.col("vec_id") % 6).cast("int").alias("run"),
        F.col("vec_id").alias("trial"), F.posexplode("embedding").alias("cell", "v"),
    ).withColumn("v", F.col("v").cast("double"))


SQL_CELLS = """cells AS (SELECT label AS subject, CAST(vec_id % 6 AS INTEGER) AS run, vec_id AS trial,
  unnest(range(len(embedding)))::INTEGER AS cell, unnest(embedding)::DOUBLE AS v FROM embeddings)"""


def features(spark, sf_dir):
    """Band x channel power per trial: band = cell div 13, freq = cell mod 13 + 1; rating = trial mod 97."""
    c = cells(spark, sf_dir)
    return c.select(
        "subject", "run", "trial", F.concat(F.lit("b"), F.floor(F.col("cell") / 13)).alias("band"),
        F.concat(F.lit("c"), F.col("cell") % 13).alias("channel"), (F.col("cell") % 13 + 1).alias("freq"),
        F.col("v").alias("power"), (F.col("trial") * 37 % 97).cast("double").alias("rating"),
        (F.lit(44.3) + F.col("trial") % 6).alias("temp"), (F.col("trial") * 37 % 97 > 48).cast("int").alias("pain"))


SQL_FEATURES = SQL_CELLS + """,
features AS (SELECT subject, run, trial, 'b' || (cell // 13) AS band, 'c' || (cell % 13) AS channel, cell % 13 + 1 AS freq,
  v AS power, (trial * 37 % 97)::DOUBLE AS rating, 44.3::DOUBLE + trial % 6 AS temp,
  CAST(trial * 37 % 97 > 48 AS INTEGER) AS pain FROM cells)"""


def spectra(spark, sf_dir):
    """Time-frequency power: 2 channels x 2 freqs x 16 times from -3 s in steps of 0.5 s."""
    c = cells(spark, sf_dir)
    return c.select(
        "subject", "run", "trial", F.concat(F.lit("c"), F.floor(F.col("cell") / 32)).alias("channel"),
        (F.floor(F.col("cell") / 16) % 2 * 4 + 6).cast("double").alias("freq"), (F.col("cell") % 16).cast("int").alias("ti"),
        ((F.col("cell") % 16 - 6) / 2).alias("t"), (F.col("v") + 1).alias("power"),
        (F.col("trial") * 37 % 97).cast("double").alias("rating"), (F.lit(44.3) + F.col("trial") % 6).alias("temp"),
        (F.col("trial") * 37 % 97 > 48).cast("int").alias("pain"))


SQL_SPECTRA = SQL_CELLS + """,
spectra AS (SELECT subject, run, trial, 'c' || (cell // 32) AS channel, (cell // 16 % 2 * 4 + 6)::DOUBLE AS freq,
  CAST(cell % 16 AS INTEGER) AS ti, (cell % 16 - 6) / 2 AS t, v + 1 AS power, (trial * 37 % 97)::DOUBLE AS rating,
  44.3::DOUBLE + trial % 6 AS temp, CAST(trial * 37 % 97 > 48 AS INTEGER) AS pain FROM cells)"""


def signals(spark, sf_dir):
    """Epoch signals: 4 channels x 16 samples per trial."""
    c = cells(spark, sf_dir)
    return c.select(
        "subject", "run", "trial", F.concat(F.lit("c"), F.floor(F.col("cell") / 16)).alias("channel"),
        (F.col("cell") % 16).cast("int").alias("ti"), ((F.col("cell") % 16 - 6) / 2).alias("t"), F.col("v").alias("x"),
        (F.col("trial") * 37 % 97).cast("double").alias("rating"), (F.col("trial") * 37 % 97 > 48).cast("int").alias("pain"))


SQL_SIGNALS = SQL_CELLS + """,
signals AS (SELECT subject, run, trial, 'c' || (cell // 16) AS channel, CAST(cell % 16 AS INTEGER) AS ti,
  (cell % 16 - 6) / 2 AS t, v AS x, (trial * 37 % 97)::DOUBLE AS rating, CAST(trial * 37 % 97 > 48 AS INTEGER) AS pain FROM cells)"""


def maps(spark, sf_dir):
    """Cells on a 4 x 4 x 4 grid; near-zero values are outside the mask (0)."""
    c = cells(spark, sf_dir)
    return c.select(
        "subject", "run", "trial", "cell", (F.col("cell") % 4).alias("x"), (F.floor(F.col("cell") / 4) % 4).cast("int").alias("y"),
        F.floor(F.col("cell") / 16).cast("int").alias("z"),
        F.when(F.abs("v") < 0.02, 0.0).otherwise(F.col("v")).alias("value"))


SQL_MAPS = SQL_CELLS + """,
maps AS (SELECT subject, run, trial, cell, cell % 4 AS x, cell // 4 % 4 AS y, cell // 16 AS z,
  CASE WHEN abs(v) < 0.02 THEN 0.0 ELSE v END AS value FROM cells)"""


def weights(spark, sf_dir):
    """The weight map: the first vector of the table (64 cells)."""
    return maps(spark, sf_dir).where(F.col("trial") == 0).select("cell", "x", "y", "z", F.col("value").alias("w"))


SQL_WEIGHTS = "weights AS (SELECT cell, x, y, z, value AS w FROM maps WHERE trial = 0)"


def confounds(spark, sf_dir):
    """Volume-wise regressors from events: name = event type, volume = trial, value missing when k = 0."""
    return trials(spark, sf_dir).select(
        "subject", "run", F.col("trial_idx").alias("volume"),
        F.when(F.col("trial_type") == "error", F.concat(F.lit("motion_outlier"), F.col("level")))
        .otherwise(F.col("trial_type")).alias("name"),
        F.when(F.col("k") > 3, F.col("k") / 50.0).alias("value"))


SQL_CONFOUNDS = """confounds AS (SELECT subject, run, trial_idx AS volume,
  CASE WHEN trial_type = 'error' THEN 'motion_outlier' || level ELSE trial_type END AS name,
  CASE WHEN k > 3 THEN k / 50.0 END AS value FROM trials)"""


def predictions(spark, sf_dir):
    """Order totals against the mean of the other priorities (leave one group out); subject = customer."""
    o = table(spark, sf_dir, "orders")
    by = o.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("sg"), F.count("o_totalprice").alias("ng"))
    by = with_totals(by, [], {"st": F.sum("sg"), "nt": F.sum("ng")})
    base = (F.col("st") - F.col("sg")) / (F.col("nt") - F.col("ng"))
    return o.join(by, "o_orderpriority").select(
        (F.col("o_custkey") % 25).alias("subject"), F.col("o_orderkey").alias("trial"),
        F.col("o_orderpriority").alias("fold"), (F.lit(44.3) + F.col("o_orderkey") % 6).alias("temp"),
        (F.col("o_totalprice") / 1000).alias("y_true"),
        ((base + 0.5 * (F.col("o_totalprice") - base) + (F.col("o_orderkey") * 7919 % 1000) * 100 - 50000) / 1000).alias("y_pred"))


SQL_PREDICTIONS = """pred0 AS (SELECT o_orderpriority, sum(o_totalprice) AS sg, count(*) AS ng FROM orders GROUP BY 1),
pred1 AS (SELECT o_orderpriority, ((SELECT sum(sg) FROM pred0) - sg) / ((SELECT sum(ng) FROM pred0) - ng) AS base FROM pred0),
predictions AS (SELECT o_custkey % 25 AS subject, o_orderkey AS trial, o_orderpriority AS fold, 44.3::DOUBLE + o_orderkey % 6 AS temp,
  o_totalprice / 1000 AS y_true,
  (base + 0.5 * (o_totalprice - base) + (o_orderkey * 7919 % 1000) * 100 - 50000) / 1000 AS y_pred
  FROM orders JOIN pred1 USING (o_orderpriority))"""
