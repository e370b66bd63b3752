"""Sources and sinks on the driver's tables.  Files are written to the shared folder first, then read back."""

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators.stats import dose_response, global_fdr
from ..session import scratch_path
from ..sources import tables as S
from .h_stats import GF, _result_tables
from .registry import query, sql

T, FE = fx.SQL_TRIALS, fx.SQL_FEATURES
EVENT_COLUMNS = ["subject", "run", "trial_idx", "onset", "duration", "trial_type", "temp", "rating", "pain"]


@query("scan_events", sql(T, "SELECT subject, run, trial_idx, onset, duration, trial_type, temp, rating, pain, 0 AS n_corrupt FROM trials", "subject, run, trial_idx, trial_type, pain, n_corrupt", "onset duration temp rating"))
def _(s, d):
    path = scratch_path(s, "events")
    fx.trials(s, d).select(*EVENT_COLUMNS).write.option("header", True).option("sep", "\t").csv(path)
    loose = S.scan_events(s, path, strict=False).where("_corrupt is not null").groupBy("subject").agg(F.count(F.lit(1)).alias("n_corrupt"))
    return S.scan_events(s, path).join(loose, "subject", "left").withColumn("n_corrupt", F.coalesce(F.col("n_corrupt"), F.lit(0)).cast("int"))


@query("scan_behavior_latest", sql(T, "SELECT subject, run, trial_idx, rating * 2 AS rating FROM trials", "subject, run, trial_idx", "rating"))
def _(s, d):
    """Every run is written twice; only the second file of each run may be read."""
    path = scratch_path(s, "behaviour")
    tr = fx.trials(s, d)
    for version, factor in (("old", 1), ("new", 2)):
        part = tr.select("subject", "run", "trial_idx", (F.col("rating") * factor).alias("rating"), F.concat(F.lit(f"{version}_run-"), F.col("run")).alias("file"))
        part.repartition("file").write.partitionBy("file").option("header", True).csv(f"{path}/{version}")
    return S.scan_behavior_latest(s, path, "subject bigint, run int, trial_idx bigint, rating double")


RECORDS = """rec AS (SELECT event_type AS model, user_id % 40 AS fold, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


@query("scan_json_records", sql(RECORDS, """SELECT model, fold, CASE WHEN k % 3 = 0 THEN 'a' ELSE 'b' END || k AS alpha, event_id AS line_no FROM rec WHERE k % 5 <> 0
  QUALIFY row_number() OVER (PARTITION BY model, fold ORDER BY event_id DESC) = 1""", "model, fold, alpha, line_no"))
def _(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    ev = fx.table(s, d, "events").withColumn("k", k)
    params = F.create_map(F.lit("alpha"), F.concat(F.when(F.col("k") % 3 == 0, "a").otherwise("b"), F.col("k")))
    rec = F.to_json(F.struct(F.col("event_type").alias("model"), (F.col("user_id") % 40).alias("fold"), F.when(F.col("k") % 3 == 0, params).alias("best_params"), F.when(F.col("k") % 3 != 0, params).alias("best_params_by_r"), F.col("event_id").alias("best_score_r")))
    path = scratch_path(s, "records")
    ev.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select(F.when(F.col("k") % 5 == 0, F.concat(F.lit("{broken"), rec)).otherwise(rec).alias("value")).write.text(path)
    return S.read_json_records(s, path, ["model", "fold"]).select("model", "fold", F.col("params")["alpha"].alias("alpha"), F.col("best_score_r").cast("long").alias("line_no"))


@query("scan_tensor_long", sql("", "SELECT vec_id, CAST(i // 16 AS INTEGER) AS channel, CAST(i % 16 AS INTEGER) AS t, embedding[i + 1]::DOUBLE AS value FROM embeddings, range(0, 64) r(i)", "vec_id, channel, t", "value"))
def _(s, d):
    nested = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.slice("embedding", c * 16 + 1, F.lit(16)))
    return S.scan_tensor_long(fx.table(s, d, "embeddings").select("vec_id", nested.alias("m")), ["vec_id"], "m", ["channel", "t"])


@query("file_inventory", sql(T + """, w AS (SELECT s.subject, s.run, kd.kind, c.n FROM (SELECT DISTINCT subject, run FROM trials) s, (VALUES ('view'), ('click'), ('signup'), ('error')) kd(kind)
  LEFT JOIN (SELECT subject, run, trial_type AS kind, count(*) AS n FROM trials GROUP BY 1, 2, 3) c ON c.subject = s.subject AND c.run = s.run AND c.kind = kd.kind),
  g AS (SELECT subject, run, bool_and(n IS NOT NULL) AS complete, count(n) AS n_found, sum(n)::BIGINT AS n_rows, coalesce(string_agg(kind, '|' ORDER BY kind) FILTER (n IS NULL), '') AS missing FROM w GROUP BY 1, 2)""",
  "SELECT *, count(*) FILTER (complete) OVER (PARTITION BY subject) AS runs_complete FROM g", "subject, run, complete, n_found, n_rows, missing, runs_complete"))
def _(s, d):
    tr = fx.trials(s, d)
    files = tr.groupBy("subject", "run", F.col("trial_type").alias("kind")).agg(F.count(F.lit(1)).alias("n_rows"))
    return S.file_inventory(tr, files, ["view", "click", "signup", "error"])


@query("file_inventory_folder", sql(T, """SELECT r.run, bool_and(c.n IS NOT NULL) AS complete, count(c.n) AS n_found, sum(c.n)::BIGINT AS n_rows, coalesce(string_agg(r.kind, '|' ORDER BY r.kind) FILTER (c.n IS NULL), '') AS missing, 1 AS runs_complete
  FROM (SELECT * FROM (SELECT DISTINCT run FROM trials), (VALUES ('view'), ('click'), ('signup'), ('error')) kd(kind)) r
  LEFT JOIN (SELECT run, trial_type AS kind, count(*) AS n FROM trials GROUP BY 1, 2) c ON c.run = r.run AND c.kind = r.kind GROUP BY r.run""", "run, complete, n_found, n_rows, missing"))
def _(s, d):
    """A folder of files per run and kind of event, listed and counted."""
    tr = fx.trials(s, d)
    path = scratch_path(s, "runs")
    tr.select("subject", "trial_idx", "rating", F.concat_ws("-", "run", "trial_type").alias("name")).repartition("name").write.partitionBy("name").option("header", True).csv(path)
    files = S.files_with_counts(s, path, r"name=(\d+)-(\w+)", ["run", "kind"]).select(F.col("run").cast("int"), "kind", "n_rows")
    return S.file_inventory(tr, files, ["view", "click", "signup", "error"], ["run"]).drop("runs_complete")


@query("sink_delimited", sql(T, "SELECT subject, trial_idx, score, CASE WHEN k > 50 THEN rating END AS rating FROM trials", "subject, trial_idx", "score rating"))
def _(s, d):
    path = scratch_path(s, "report")
    S.sink_delimited(fx.trials(s, d).select("subject", "trial_idx", "score", F.when(F.col("k") > 50, F.col("rating")).alias("rating")), path)
    return S.scan_events(s, path, "subject bigint, trial_idx bigint, score double, rating double")


@query("sink_partitioned_by_band", sql(FE, "SELECT trial, channel, band, power FROM features", "trial, channel, band", "power"))
def _(s, d):
    path = scratch_path(s, "bands")
    S.sink_partitioned_by_band(fx.features(s, d).select("trial", "band", "channel", "power"), path)
    return s.read.parquet(path)


@query("sink_json", sql(T, """SELECT subject, count(*) AS n, CASE WHEN subject % 5 > 0 THEN avg(score) END AS mean FROM trials GROUP BY 1""", "subject, n", "mean"))
def _(s, d):
    path = scratch_path(s, "json")
    g = fx.trials(s, d).groupBy("subject").agg(F.count("k").alias("n"), F.avg("score").alias("mean"))
    g = g.withColumn("mean", F.when(F.col("subject") % 5 > 0, F.col("mean")).otherwise(float("nan")))
    S.sink_json(g, path)
    return s.read.schema("subject bigint, n bigint, mean double").json(path)


@query("sink_append_log", sql(T, "SELECT subject, run, count(*) AS n_rows FROM trials GROUP BY 1, 2", "subject, run, n_rows"))
def _(s, d):
    path = scratch_path(s, "log")
    rows = fx.trials(s, d).groupBy("subject", "run").agg(F.count("k").alias("n_rows"))
    S.sink_append_log(rows.where("subject % 2 = 0"), path, "even")
    S.sink_append_log(rows.where("subject % 2 = 1"), path, "odd")
    S.sink_append_log(rows.where("subject % 2 = 0"), path, "even")  # a retry
    return S.scan_append_log(s, path, "subject bigint, run int, n_rows bigint")


@query("write_back_columns", sql(GF, "SELECT d.subject, n, q AS q_global, coalesce(reject, false) AS reject_global FROM dr d JOIN gf ON gf.row_id = d.subject AND gf.tab = 'dose'", "subject, n, reject_global", "q_global"))
def _(s, d):
    table = dose_response(fx.trials(s, d), ["subject"]).select("subject", "n")
    computed = global_fdr(_result_tables(s, d)).where("tab = 'dose'").select(F.col("row_id").alias("subject"), "q_global", "reject_global")
    path = scratch_path(s, "version")
    S.write_back_columns(table, computed, ["subject"], path)
    return s.read.parquet(path)

