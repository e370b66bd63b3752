"""Reshaping operators on the driver's tables."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import reshape as R
from .registry import query, sql

T, FE, SP, CE, MA = fx.SQL_TRIALS, fx.SQL_FEATURES, fx.SQL_SPECTRA, fx.SQL_CELLS, fx.SQL_MAPS

PHASES = """phases AS (SELECT subject, run, trial_idx + 1 AS trial_number, temp, rating, pain, onset AS stim_start, onset + duration AS stim_end,
  onset + duration + k % 3 * 0.5::DOUBLE AS pain_q_start, onset + duration + k % 3 * 0.5::DOUBLE + 2 AS pain_q_end,
  onset + duration + 2.5::DOUBLE AS vas_start, onset + duration + 6 AS vas_end FROM trials)"""


def phases(s, d):
    end, gap = F.col("onset") + F.col("duration"), F.col("k") % 3 * 0.5
    return fx.trials(s, d).select(
        "subject", "run", (F.col("trial_idx") + 1).alias("trial_number"), "temp", "rating", "pain", F.col("onset").alias("stim_start"),
        end.alias("stim_end"), (end + gap).alias("pain_q_start"), (end + gap + 2).alias("pain_q_end"), (end + 2.5).alias("vas_start"), (end + 6).alias("vas_end"))


def _span(name, a, b, where=""):
    return (f"SELECT subject, run, trial_number, temp, rating, pain, {name} AS trial_type, round_even({a} * 1000, 0) / 1000 AS onset, "
            f"round_even(({b} - {a}) * 1000, 0) / 1000 AS duration FROM phases {where}")


@query("trials_to_events", sql(T + "," + PHASES, " UNION ALL ".join([
    _span("'temp' || replace(printf('%.1f', temp), '.', 'p')", "stim_start", "stim_end"), _span("'decision'", "pain_q_start", "pain_q_end"),
    _span("'rating'", "vas_start", "vas_end"), _span("'delay'", "stim_end", "pain_q_start", "WHERE pain_q_start - stim_end > 0")]),
    "subject, run, trial_number, trial_type, pain", "temp rating onset duration"))
def _(s, d):
    return R.trials_to_events(phases(s, d))


@query("features_wide_to_long", sql("", """SELECT vec_id, 'alpha' AS band, 'c' || (i - 1) AS channel, embedding[i]::DOUBLE AS power FROM embeddings, range(1, 33) r(i)
  UNION ALL SELECT vec_id, 'low_beta', 'c' || (i - 33), embedding[i]::DOUBLE FROM embeddings, range(33, 65) r(i)""", "vec_id, band, channel", "power"))
def _(s, d):
    e = F.col("embedding")
    wide = fx.table(s, d, "embeddings").select(
        "vec_id", *[e[i].cast("double").alias(f"pow_alpha_c{i}") for i in range(32)], *[e[i].cast("double").alias(f"pow_low_beta_c{i - 32}") for i in range(32, 64)])
    long = R.features_wide_to_long(wide, ["vec_id"])
    names = [f"pow_{b}_c{i}" for b in ("alpha", "low_beta") for i in range(32)]
    return R.features_wide_to_long(R.features_long_to_wide(long, ["vec_id"], names), ["vec_id"])


TIMES = [i / 10 for i in range(8)]


@query("pivot_mean_matrix", sql(CE, "SELECT round(cell // 8 / 10, 6) AS t_train, " + ", ".join(f'avg(v) FILTER (cell % 8 = {i}) AS "{t}"' for i, t in enumerate(TIMES)) +
                                " FROM cells GROUP BY 1", "t_train, " + ", ".join(f'round("{t}", 6) + 0.0 AS "{t}"' for t in TIMES)))
def _(s, d):
    sc = fx.cells(s, d).select((F.floor(F.col("cell") / 8) / 10).alias("t_train"), (F.col("cell") % 8 / 10).alias("t_test"), F.col("v").alias("score"))
    wide = R.pivot_mean_matrix(sc, TIMES)
    return wide.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) for c in wide.columns])


@query("lower_triangle_pairs", sql("", """SELECT vec_id, 'aec_n' || i || '__n' || j AS name, 'n' || i AS node_a, 'n' || j AS node_b, embedding[i * 8 + j + 1]::DOUBLE AS value
  FROM embeddings, range(0, 8) a(i), range(0, 8) b(j) WHERE i > j""", "vec_id, name, node_a, node_b", "value"))
def _(s, d):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)).cast("array<double>"))
    m = fx.table(s, d, "embeddings").select("vec_id", rows.alias("m"))
    return R.lower_triangle_pairs(m, ["vec_id"], "m", [f"n{i}" for i in range(8)], "aec")


@query("combine_runs", sql(T, "SELECT subject, CASE WHEN k % 2 = 0 THEN run ELSE 9 END AS run, trial_idx, onset, CASE WHEN k % 2 = 0 THEN rating END AS rating, CASE WHEN k % 2 = 1 THEN score END AS score FROM trials",
                           "subject, run, trial_idx", "onset rating score"))
def _(s, d):
    tr = fx.trials(s, d)
    a = tr.where(F.col("k") % 2 == 0).select("subject", "run", "trial_idx", "onset", "rating")
    b = tr.where(F.col("k") % 2 == 1).select("subject", F.lit(9).alias("file_run"), "trial_idx", "onset", "score")
    return R.combine_runs([a, b])


RECORDS = """records AS (SELECT event_type AS model, event_id AS fold, user_id AS subject, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


@query("best_params_long", sql(RECORDS, " UNION ALL ".join(
    f"SELECT model, fold, subject, '{c}' AS criterion, {s} AS score, u.key, u.value FROM records, (VALUES ('k'), ('alpha')) n(key), LATERAL (SELECT n.key, CASE n.key WHEN 'k' THEN k::VARCHAR ELSE (k % 4)::VARCHAR END AS value) u WHERE {w}"
    for c, s, w in (("primary", "k / 100", "true"), ("r", "k / 100", "k % 2 = 0"), ("neg_mse", "-k / 10", "k % 3 = 0"))),
    "model, fold, subject, criterion, key, value", "score"))
def _(s, d):
    ev = fx.table(s, d, "events").select("event_id", "event_type", "user_id", F.from_json("props", "map<string,string>").alias("m"))
    k = F.col("m")["k"].cast("int")
    m = F.map_concat(F.col("m"), F.create_map(F.lit("alpha"), (k % 4).cast("string")))
    rec = ev.select(F.col("event_type").alias("model"), F.col("event_id").alias("fold"), F.col("user_id").alias("subject"), m.alias("best_params"),
                    F.when(k % 2 == 0, m).alias("best_params_by_r"), F.when(k % 3 == 0, m).alias("best_params_by_neg_mse"),
                    (k / 100).alias("best_score_r"), (-k / 10).alias("best_score_neg_mse"))
    return R.best_params_long(rec)


KINDS = ["view", "click", "error", "purchase", "signup"]


@query("metrics_wide", sql(T, "SELECT subject, " + ", ".join(f"avg(score) FILTER (trial_type = '{m}') AS r__{m}, max(rating) FILTER (trial_type = '{m}') AS top__{m}" for m in KINDS) +
                           " FROM trials GROUP BY 1", "subject", " ".join(f"r__{m} top__{m}" for m in KINDS)))
def _(s, d):
    m = fx.trials(s, d).groupBy("subject", F.col("trial_type").alias("model")).agg(F.avg("score").alias("r"), F.max("rating").alias("top"))
    return R.metrics_wide(m, ["r", "top"], KINDS)


@query("common_channels", sql(FE, """SELECT channel, count(DISTINCT subject) AS n_subjects FROM (SELECT subject, channel FROM features UNION ALL SELECT 1, 'c99') WHERE subject <> 3
  GROUP BY 1 HAVING count(DISTINCT subject) = (SELECT count(DISTINCT subject) - 1 FROM features)""", "channel, n_subjects"))
def _(s, d):
    """Subject 3 has a frequency of its own, so its grid differs; subject 1 has a channel of its own."""
    f = fx.features(s, d).select("subject", "channel", "freq")
    extra = s.createDataFrame([(3, "c0", 99), (1, "c99", 1)], "subject int, channel string, freq int")
    return R.common_channels(f.unionByName(extra), axes=("freq",))


@query("missing_required", sql(T, """SELECT s.subject, r.name, (SELECT count(DISTINCT trial_type) FROM trials t WHERE t.subject = s.subject AND t.run = s.run AND trial_type IN ('view', 'click', 'error', 'other')) AS n_present, s.run
  FROM (SELECT DISTINCT subject, run FROM trials) s, (VALUES ('view'), ('click'), ('error'), ('other')) r(name)
  WHERE NOT EXISTS (SELECT 1 FROM trials t WHERE t.subject = s.subject AND t.run = s.run AND t.trial_type = r.name)""", "subject, run, name, n_present"))
def _(s, d):
    return R.missing_required(fx.trials(s, d).withColumnRenamed("trial_type", "name"), ["view", "click", "error", "other"], keys=["subject", "run"])


@query("union_stat_tables", sql(T, """SELECT subject, avg(score) FILTER (pain = 1) AS r, 'alpha' AS band, 'rating' AS target FROM trials GROUP BY 1
  UNION ALL SELECT subject, avg(rating), trial_type, 'temp' FROM trials GROUP BY 1, trial_type""", "subject, band, target", "r"))
def _(s, d):
    tr = fx.trials(s, d)
    a = tr.groupBy("subject").agg(F.avg(F.when(F.col("pain") == 1, F.col("score"))).alias("r"))
    b = tr.groupBy("subject", F.col("trial_type").alias("band")).agg(F.avg("rating").alias("r"))
    return R.union_stat_tables([(a, {"band": "alpha", "target": "rating"}), (b, {"band": "x", "target": "temp"})])


@query("reindex_to_grid", sql(T, """SELECT s.trial_type, s.subject, g.run, v.score FROM (SELECT DISTINCT trial_type, subject FROM trials) s
  JOIN (SELECT DISTINCT trial_type, run FROM trials) g USING (trial_type) LEFT JOIN (SELECT trial_type, subject, run, avg(score) AS score FROM trials GROUP BY ALL) v
  ON v.trial_type = s.trial_type AND v.subject = s.subject AND v.run = g.run""", "trial_type, subject, run", "score"))
def _(s, d):
    m = fx.trials(s, d).groupBy("trial_type", "subject", "run").agg(F.avg("score").alias("score"))
    return R.reindex_to_grid(m, ["trial_type"], "subject", ["run"], "score")


@query("interpolate_to_grid", sql(T, """SELECT g.subject, g.t, CASE WHEN a.onset = g.t THEN a.score ELSE a.score + (b.score - a.score) * ((g.t - a.onset) / (b.onset - a.onset)) END AS v
  FROM (SELECT DISTINCT subject, 86400.0::DOUBLE * i AS t FROM trials, range(0, 30) r(i)) g ASOF LEFT JOIN (SELECT * FROM trials WHERE k > 9) a ON a.subject = g.subject AND g.t >= a.onset
  ASOF LEFT JOIN (SELECT * FROM trials WHERE k > 9) b ON b.subject = g.subject AND g.t <= b.onset""", "subject", "t v"))
def _(s, d):
    tr = fx.trials(s, d)
    smp = tr.select("subject", F.col("onset").alias("t"), F.when(F.col("k") > 9, F.col("score")).alias("v"))
    grid = tr.select("subject").distinct().select("subject", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("i")).select("subject", (F.lit(86400.0) * F.col("i")).alias("t"))
    return R.interpolate_to_grid(smp, grid, ["subject"])
