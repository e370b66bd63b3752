"""A uniform shuffle into shards of exact sizes: exact counts from each block to each shard, permuted locally before and after."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import stored

SUB_ROWS = 1 << 18


def hypergeometric(rng, good, bad, drawn):
    """Marked items among ``drawn`` of ``good`` + ``bad``; numpy's sampler holds below 1e9, beyond it a ratio of uniforms."""
    if drawn == 0 or good == 0:
        return 0
    if bad == 0:
        return drawn
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, drawn))
    n = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)

    def log_p(k):
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(drawn - k + 1) + math.lgamma(bad - drawn + k + 1))

    mean = drawn * (good / n)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (n + 2)))
    spread = math.sqrt(max(1.0, mean * (bad / n) * ((n - drawn) / (n - 1))) + 0.5)
    top, width = log_p(mode), 2.0 * math.sqrt(2.0 / math.e) * spread + 2.0
    while True:
        u, v = rng.random(), rng.random()
        if u == 0.0:
            continue
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2.0 * math.log(u) <= log_p(k) - top:
            return k


def deal(rng, rows, room):
    """Exact counts of each entry of ``rows`` in each shard when ``sum(rows)`` items fall uniformly into shards with ``room``.

    One line of the communication matrix after the other: a multivariate hypergeometric draw from the room left.
    """
    left = [int(x) for x in room]
    matrix = np.zeros((len(rows), len(left)), np.int64)
    for i, take in enumerate(map(int, rows)):
        bad = sum(left)
        for j, here in enumerate(left):
            bad -= here
            matrix[i, j] = got = hypergeometric(rng, here, bad, take)
            take -= got
        left = [a - int(b) for a, b in zip(left, matrix[i])]
    return matrix


def room_of(total, n_shards, seed):
    """Shard sizes at most one apart; the seed picks the larger ones."""
    room = np.full(n_shards, total // n_shards, np.int64)
    room[np.random.default_rng([seed, 1]).permutation(n_shards)[:total % n_shards]] += 1
    return room


def communication(blocks, n_shards, seed):
    """``blocks`` (block, rows) with ``upto``: for each block the running counts of its rows over the shards.

    Two levels, so that neither the driver nor a task draws for all blocks: the driver draws for about sqrt(blocks) groups
    of blocks, then one task for each group draws for its blocks from what the group was given.
    """
    size = blocks.agg(F.max("block").alias("last"), F.sum("rows").alias("all")).first()
    if size["all"] is None:
        return blocks.select("block", F.array().cast("array<long>").alias("upto"))
    span = math.isqrt(size["last"]) + 1
    grouped = blocks.withColumn("group", F.floor(F.col("block") / span).cast("int"))
    groups = grouped.groupBy("group").agg(F.sum("rows").alias("rows")).orderBy("group").collect()
    matrix = deal(np.random.default_rng([seed, 2]), [g["rows"] for g in groups], room_of(size["all"], n_shards, seed))
    rooms = blocks.sparkSession.createDataFrame([(g["group"], line.tolist()) for g, line in zip(groups, matrix)], "group int, room array<long>")

    def lines(part):
        part = part.sort_values("block")
        got = deal(np.random.default_rng([seed, 3, int(part["group"].iloc[0])]), part["rows"], part["room"].iloc[0])
        return pd.DataFrame({"block": part["block"], "upto": list(got.cumsum(axis=1))})

    return grouped.join(rooms, "group").groupBy("group").applyInPandas(lines, "block int, upto array<long>")


def shuffle_into_shards(docs, n_shards=40, doc_id="doc_id", text="text", seed=11, sub_rows=SUB_ROWS):
    """A shard and a slot for every row: a uniform random permutation cut into shards whose row counts are at most one apart.

    1. Each input partition is a block; its narrow rows (no text) are stored with the block's number.
    2. The communication matrix fixes how many rows of each block go to each shard.
    3. Within a block the rows are put in seeded random order; the running counts of the matrix cut that order.
    4. Within a shard a second random order gives the slots.  A shard is cut into ranges of that order of about
       ``sub_rows`` rows, so no task holds a whole shard.

    A null text has no bytes; null and repeated ids are rows like any other, also repeated rows, whose copies are dealt on
    their own; an empty table gives no rows.  Only these columns are returned.
    """
    here = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumns({"block": F.spark_partition_id(), "order": F.monotonically_increasing_id()})
    rows = stored(here, "blocks")
    counts = stored(rows.groupBy("block").agg(F.count(F.lit(1)).alias("rows")), "counts")
    matrix = stored(communication(counts, n_shards, seed), "matrix")
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    n_sub = max(1, math.ceil(total / n_shards / sub_rows))

    first = F.xxhash64(F.lit(f"{seed}:first"), "doc_id", "text_crc32", "order")
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy("block").orderBy(first, "order")) - 1).join(matrix, "block")
    second = F.xxhash64(F.lit(f"{seed}:second"), "doc_id", "text_crc32", "order")
    sub = F.floor(((F.shiftrightunsigned(second, 11)).cast("double") / float(2**53)) * n_sub).cast("int")
    dealt = placed.select(
        "doc_id", "size", "text_crc32", "order",
        F.size(F.filter("upto", lambda x: x <= F.col("at"))).alias("shard"),
        second.alias("second"), sub.alias("sub"),
    )
    dealt = stored(dealt, "dealt")
    subs = dealt.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = subs.select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "sub").orderBy(F.shiftrightunsigned("second", 11), "order")) - 1
    out = dealt.withColumn("inside", inside).join(offsets, ["shard", "sub"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"),
        (F.col("before") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
