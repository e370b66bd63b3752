"""Helpers shared by the operators of this subpackage."""

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

WORD = r"[^\x20\x09-\x0D]+"

ARROW = {
    "long": (T.LongType(), pa.int64()),
    "int": (T.IntegerType(), pa.int32()),
    "double": (T.DoubleType(), pa.float64()),
    "string": (T.StringType(), pa.string()),
    "boolean": (T.BooleanType(), pa.bool_()),
    "binary": (T.BinaryType(), pa.binary()),
    "longs": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    "ints": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "strings": (T.ArrayType(T.StringType()), pa.list_(pa.string())),
}


def fields_of(fields):
    return [T.StructField(name, ARROW[kind][0]) for name, kind in fields.items()]


def batch_of(columns, fields):
    """A record batch from name -> list, typed as ``fields`` say."""
    return pa.RecordBatch.from_arrays([pa.array(columns[n], ARROW[k][1]) for n, k in fields.items()], list(fields))


SLICE_ROWS = 512


def slices(batches, rows=SLICE_ROWS):
    """The batches in parts of at most ``rows`` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_texts(df, text, keep, fields, fn):
    """``fn`` over parts of Arrow batches: a list of texts (null kept as None) becomes name -> list for ``fields``.

    Only ``keep`` and the text column are read.  A kept column whose name is also in ``fields`` is replaced.
    """
    keep = [k for k in keep if k not in fields]
    src = df.select(*[F.col(k) for k in keep], F.col(text).cast("string").alias("__text"))
    schema = T.StructType([src.schema[k] for k in keep] + fields_of(fields))

    def run(batches):
        for batch in slices(batches):
            made = batch_of(fn(batch.column(len(keep)).to_pylist()), fields)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made.columns], [*keep, *fields])

    return src.mapInArrow(run, schema)


def partition_count(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_in_order(df, order):
    """``df`` cut into ordered partitions and stored, with ``__part``; equal order values may be cut apart only if ``order`` tells them apart."""
    return stored(
        df.repartitionByRange(partition_count(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()),
        "ordered",
    )


def global_rank(df, order, name):
    """Position of every row in the given order, from 0, without one task for all rows.

    The rows are cut into ordered partitions; each ranks its own rows and adds the row count of those before it
    (one number for each partition).
    """
    parts = parts_in_order(df, order)
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = parts.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return within.join(before, "__part").withColumn(name, F.col("__before") + F.col("__row") - 1).drop("__part", "__before", "__row")


def unit_draw(*parts):
    """A number in [0, 1) from the md5 of the joined parts; the same on every engine and in every run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
