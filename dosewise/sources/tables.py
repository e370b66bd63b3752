"""Reading and writing the experiment's tables."""

import re
import uuid

from pyspark.sql import functions as F

from ..functions.scalars import clean_number
from ..plans.shapes import join_keys, with_totals

EVENTS_SCHEMA = ("subject bigint, run int, trial_idx bigint, onset double, duration double, trial_type string, temp double, "
                 "rating double, pain int")


def scan_events(spark, path, schema=EVENTS_SCHEMA, strict=True, sep="\t"):
    """A delimited events table with a header.

    Strict: a bad or missing file raises.  Otherwise bad rows carry their text in
    ``_corrupt`` and a missing file gives an empty table.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("nullValue", "n/a")
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").csv(path)
    reader = reader.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.csv(path) if path_exists(spark, path) else spark.createDataFrame([], schema + ", _corrupt string")


def path_exists(spark, path):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.globStatus(jpath)) if any(c in path for c in "*?[{") else fs.exists(jpath)


def list_files(spark, path, pattern, names):
    """One row per file below a folder: path, length, modification time and the groups of ``pattern`` found in its path.

    File contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime", *[F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def latest_by_run(files, keys):
    """Paths of the newest file per run from a file list; the run number is in the path, and of files without one the first by name."""
    run = F.regexp_extract("path", r"(?i)run-?0*(\d+)(?!\d)", 1)
    files = files.withColumn("file_run", F.when(run != "", run.try_cast("int")))
    best = F.max_by("path", F.struct("modificationTime", "path"))
    return files.groupBy("file_run", *keys).agg(F.when(F.col("file_run").isNotNull(), best).otherwise(F.min("path")).alias("path"))


def scan_behavior_latest(spark, path, schema, pattern="()", keys=()):
    """The newest trial-summary file per run, and per the groups of ``pattern`` named by ``keys``; no other file is opened."""
    chosen = latest_by_run(list_files(spark, path, pattern, list(keys)), list(keys))
    paths = [r["path"] for r in chosen.select("path").collect()]  # one path per run, as a file list already is on the driver
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(paths)


def scan_json_records(df, keys, line="line_no", text="record"):
    """JSON-lines records to settings: malformed lines are skipped, the last record per key wins.

    Settings are ``best_params``, else ``best_params_by_r``.
    """
    rec = F.from_json(text, "model string, fold bigint, heldout_subject string, best_params map<string,string>, best_params_by_r map<string,string>, best_score_r double",
                      {"mode": "PERMISSIVE"})
    rows = df.select(line, rec.alias("r")).select(line, "r.*").withColumn("params", F.coalesce("best_params", "best_params_by_r")).where("params is not null")
    return rows.groupBy(*keys).agg(F.max_by("params", line).alias("params"), F.max_by("best_score_r", line).alias("best_score_r"))


def read_json_records(spark, path, keys):
    """The same from files of JSON lines; later lines win, and later files by name."""
    lines = spark.read.text(path).select(
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line_no"), F.col("value").alias("record")
    )
    return scan_json_records(lines, keys)


def scan_tensor_long(df, keys, column, axes):
    """An array column, nested once per axis, to one row per cell."""
    out = df.select(*keys, F.posexplode(column).alias(axes[0], "__v"))
    for i, axis in enumerate(axes[1:]):
        out = out.select(*keys, *axes[: i + 1], F.posexplode("__v").alias(axis, "__v"))
    return out.withColumn("value", clean_number(F.col("__v"))).drop("__v")


def file_inventory(runs, files, kinds, keys=("subject", "run")):
    """Required files per run with an exists flag and size; a run is complete when all exist.

    ``files`` holds (keys, kind, n_rows), as ``files_with_counts`` reads them from a folder.
    """
    want = runs.select(*keys).distinct().withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    j = join_keys(want, files.withColumn("found", F.lit(True)), [*keys, "kind"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    g = j.groupBy(*keys).agg(F.bool_and("found").alias("complete"), F.count_if("found").alias("n_found"), F.sum("n_rows").alias("n_rows"),
                             F.array_join(F.array_sort(F.collect_list(F.when(~F.col("found"), F.col("kind")))), "|").alias("missing"))
    return with_totals(g, [keys[0]], {"runs_complete": F.count_if("complete")})


def files_with_counts(spark, path, pattern, names):
    """The files below a folder of delimited tables, summed by the groups of ``pattern``: files, bytes, rows, columns."""
    counts = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    n_columns = len(counts.columns)
    counts = counts.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    files = list_files(spark, path, pattern, names).join(counts, "path", "left")
    return files.groupBy(*names).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).withColumn("n_columns", F.lit(n_columns))


def sink_delimited(df, path, digits=6, sep="\t", mode="error"):
    """Delimited text with a header; doubles rounded for reports."""
    out = df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    out.write.mode(mode).option("header", True).option("sep", sep).option("nullValue", "n/a").csv(path)


def sink_partitioned_by_band(df, path, mode="error"):
    """Long features in one folder per band; each band's rows are gathered and spread again by channel."""
    df.repartition("band", "channel").write.mode(mode).partitionBy("band").parquet(path)


def to_json_rows(df, keys, name="record"):
    """Result columns as a JSON record; non-finite numbers become null."""
    fields = [clean_number(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(name))


def sink_json(df, path, mode="error"):
    clean = df.select(*[clean_number(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    clean.write.mode(mode).option("ignoreNullFields", False).json(path)


def _files(spark, path):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def sink_append_log(df, path, run_id):
    """Append the rows of one run, once: whether they were added now.

    The rows are written to a folder of their own below ``path``; they count only when a commit record named by the run is
    there, which is moved into place as a whole after the write.  So a run that is repeated adds nothing, of two writers of
    one run the later one gives way, and what a lost writer left behind is never read.
    """
    spark = df.sparkSession
    fs, at = _files(spark, path)
    name = re.sub(r"[^A-Za-z0-9_-]", lambda c: f".{ord(c[0]):x}.", str(run_id))
    record = at(f"{path}/commits/{name}")
    if fs.exists(record):
        return False
    attempt = f"{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/data/attempt={attempt}")
    staged = at(f"{path}/staged/{attempt}")
    out = fs.create(staged, False)
    out.write(bytearray(f"{attempt}\n".encode()))
    out.close()
    fs.mkdirs(record.getParent())
    if fs.exists(record) or not fs.rename(staged, record):
        fs.delete(staged, False)
        return False
    return True


def scan_append_log(spark, path, schema):
    """The rows of all committed runs; of a run that is not committed, none."""
    fs, at = _files(spark, path)
    if not fs.exists(at(f"{path}/commits")):
        return spark.createDataFrame([], schema)
    attempts = spark.read.text(f"{path}/commits").select(F.col("value").alias("attempt"))
    rows = spark.read.schema(f"{schema}, attempt string").parquet(f"{path}/data")
    return rows.join(attempts, "attempt", "left_semi").drop("attempt")


def write_back_columns(table, computed, keys, path=None):
    """Add columns computed over the union of all tables to one table; a new version is written where asked."""
    new = [c for c in computed.columns if c not in keys]
    out = join_keys(table.drop(*new), computed, list(keys), "left")
    if path:
        out.write.mode("overwrite").parquet(path)
    return out
