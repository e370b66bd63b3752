"""Vectors whitened on their leading principal components, found by spectrum slicing.

The rows are read three times, each time summed inside the tasks: number and sums, products of the centred rows, and
the rows themselves.  Only arrays of d and d x d numbers reach the driver, whatever the number of rows.  Sums are whole
numbers, so they do not depend on the order of the rows or on lost tasks.
"""

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ARROW, fields_of
from .spectrum import leading

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0 ** 46
DECIMAL = (T.DecimalType(38, 0), pa.decimal128(38, 0))
NUMBERS = decimal.Context(prec=60)
BATCH_ROWS = 4096
OUT = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}


def usable(df, key, vector):
    """Rows whose vector is there and holds finite entries only, as (key, vector of doubles)."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return df.where(F.col(vector).isNotNull() & finite).select(F.col(key), v.alias("__v"))


def scaled(column):
    """Whole numbers floor(64 c) + 1,000,000 of a batch of vectors (rows, d); entries beyond 2^46 count as 2^46."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.floor(SCALE * np.clip(flat, -LARGEST, LARGEST)).astype(np.int64) + SHIFT


def products(a):
    """aᵀa of whole numbers, exact: by floating point where no sum can pass 2^53, else by Python's whole numbers."""
    most = int(np.abs(a).max(initial=0))
    if most < 1 << 26:
        step = max(1, (1 << 53) // max(1, most * most))
        total = np.zeros((a.shape[1],) * 2, dtype=object)
        for at in range(0, len(a), step):
            f = a[at:at + step].astype(np.float64)
            total += (f.T @ f).astype(np.int64).astype(object)
        return total
    big = a.astype(object)
    return big.T @ big


def batches_of(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def summed(rows, fn, shape):
    """Sum over all batches of ``fn(batch)``, an array of whole numbers of that shape; added up by Spark entry by entry."""
    schema = T.StructType([*fields_of({"at": "int"}), T.StructField("s", DECIMAL[0])])

    def run(batches):
        total = None
        for batch in batches_of(batches):
            if batch.num_rows:
                part = fn(batch)
                total = part if total is None else total + part
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array([NUMBERS.create_decimal(int(x)) for x in flat], DECIMAL[1])], ["at", "s"])

    out = np.zeros(int(np.prod(shape)), dtype=object)
    for row in rows.mapInArrow(run, schema).groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[row["at"]] = int(row["s"])
    return out.reshape(shape)


def fit(rows, size, k):
    """Number of rows, sums per dimension, the leading eigenpairs of their covariance and its trace."""
    n, sums = 0, np.zeros(size, dtype=object)
    if size:
        def count(batch):
            x = scaled(batch.column(1)).astype(object)
            return np.concatenate([[len(x)], x.sum(axis=0)])
        total = summed(rows, count, (size + 1,))
        n, sums = int(total[0]), total[1:]
    if not n:
        return 0, sums, np.zeros(0), np.zeros((size, 0)), 0.0
    base = np.array([s // n for s in sums], dtype=object)
    low = base.astype(np.int64)
    square = summed(rows, lambda batch: products(scaled(batch.column(1)) - low), (size, size))
    rest = sums - n * base  # of sums of the centred rows, each below n
    exact = n * square - np.outer(rest, rest)
    cov = np.array([[float(decimal.Decimal(int(v)) / (decimal.Decimal(n) * n)) for v in row] for row in exact])
    values, vectors = leading(cov, k)
    return n, sums, values, vectors, float(np.trace(cov))


def whiten(df, key="vec_id", vector="embedding", k=32):
    """Per remaining row and component (at most ``k``): its number, ``whitened`` and the figures of the fit.

    Rows whose vector is null or holds null or non-finite entries are left out.  The dimension is that of the longest
    remaining vector; a shorter one lacks entries and is left out too.  ``n`` rows remain; ``deviation`` is the sum over
    dimensions of (n x - S)^2, exact (null where it does not fit a long); ``whitened`` is x - S / n on the component over
    the root of its eigenvalue; ``explained`` its share of the trace; ``identity_error`` the largest entry of the measured covariance
    of all ``whitened`` minus the identity.  Components without variance (eigenvalue zero up to rounding) have a null
    ``whitened`` and do not count for that error; without any variance ``explained`` is null.  Repeated rows and keys, null
    keys too, each give their rows; other columns are not read; an empty table gives none.
    """
    if key in OUT:
        raise ValueError("the key must not be named like a result column")
    rows = usable(df, key, vector)
    size = rows.agg(F.max(F.size("__v"))).first()[0] or 0
    rows = rows.where((F.size("__v") == size) & (F.lit(size) > 0))
    n, sums, values, vectors, trace = fit(rows, size, k)
    base = np.array([s // n for s in sums], dtype=np.int64) if n else np.zeros(size, np.int64)
    rest = np.array([int(s) - n * int(b) for s, b in zip(sums, base)], dtype=object)
    part = np.array([float(r) / n for r in rest]) if n else np.zeros(size)
    real = values > len(sums) * 4 * np.finfo(float).eps * max(trace, 0.0)
    axes = vectors[:, real] / np.sqrt(values[real])

    def whitened(batch):
        a = scaled(batch.column(1)) - base
        return a, (a - part) @ axes

    def moments(batches):
        total = None
        for batch in batches_of(batches):
            if batch.num_rows:
                w = whitened(batch)[1]
                grown = np.vstack([w.sum(axis=0), w.T @ w])
                total = grown if total is None else total + grown
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel(), pa.float64())], ["at", "s"])

    error, count = None, int(real.sum())
    if count:
        found = np.zeros((count + 1) * count)
        for row in rows.mapInArrow(moments, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
            found[row["at"]] = row["s"]
        found = found.reshape(count + 1, count) / n
        error = float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(count)).max())
    explained = [float(v) / trace if trace > 0 else None for v in values]
    schema = T.StructType([rows.schema[key], *fields_of(OUT)])

    def deviation(a):
        most = n * (int(np.abs(a).max(initial=0)) + 1)
        if most * most * size < 1 << 63:
            d = n * a - rest.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = ((n * a.astype(object) - rest) ** 2).sum(axis=1).tolist()
        return [x if x < 1 << 63 else None for x in exact]

    def result(batches):
        many = len(values)
        for batch in batches_of(batches):
            a, w = whitened(batch)
            full = np.full((len(a), many), np.nan)
            full[:, real] = w
            blank = np.tile(~real, len(a))
            at = pa.array(np.repeat(np.arange(len(a)), many))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(a))), pa.array([n] * (len(a) * many), ARROW["long"][1]),
                pa.array(deviation(a), ARROW["long"][1]).take(at), pa.array(full.ravel(), mask=blank), pa.array(explained * len(a), ARROW["double"][1]),
                pa.array([error] * (len(a) * many), ARROW["double"][1]),
            ], [key, *OUT])

    return rows.mapInArrow(result, schema)
