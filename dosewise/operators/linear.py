"""Design matrices, least squares on sums, and connectivity graphs."""

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions.solvers import inverse
from ..plans.shapes import join_keys, once, quantiles, with_index, with_row, with_totals
from ..session import stored
from .align import with_run_length

HRF_LENGTH = 32.0  # seconds


BLOCK_VOLUMES = 64


def _gamma_cdf(x, shape):
    """Integral of the gamma density of whole-number shape from 0 to x."""
    poly = 1.0 / math.factorial(shape - 1)
    for k in range(shape - 2, -1, -1):
        poly = poly * x + 1.0 / math.factorial(k)
    return 1 - np.exp(-x) * poly


def hrf_step(x):
    """Response to a step input: the integrated double-gamma response (peak 6 s, undershoot 16 s, ratio 1/6), unit area."""
    x = np.fmax(0.0, np.fmin(x, HRF_LENGTH))
    return (_gamma_cdf(x, 6) - _gamma_cdf(x, 16) / 6) / (5 / 6)


def _convolved(tr, n_by):
    """A function for ``mapInArrow`` over events sorted by group (the first ``n_by`` columns, a block of volumes last): the sums of their responses."""
    def rows(groups, value, reached):
        at, offset = np.nonzero(reached)
        names = groups.column_names
        volume = groups[names[-1]].to_numpy()[at] * BLOCK_VOLUMES + offset
        kept = [groups[n].combine_chunks().take(pa.array(at)) for n in names[:-1]]
        return pa.table([*kept, pa.array(volume), pa.array(value[at, offset])], names=[*names[:-1], "volume", "value"]).combine_chunks().to_batches()

    def convolve(batches):
        held = value = reached = None
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = pa.table(batch.columns[:n_by], names=batch.schema.names[:n_by])
            n = len(groups)
            groups = groups if held is None else pa.concat_tables([held, groups])
            starts = _starts(*[c.combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in groups.columns])
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(groups)]))[len(groups) - n:]
            begin = batch.column(n_by - 1).to_numpy() * BLOCK_VOLUMES
            first, last, onset, duration = (batch.column(n_by + i).to_numpy() for i in range(4))
            low = np.maximum(first - begin, 0)
            width = np.minimum(last - begin, BLOCK_VOLUMES - 1) - low + 1
            row = np.repeat(np.arange(n), width)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width) + low[row]
            lag = (begin[row] + offset) * tr - onset[row]
            at, size = group[row] * BLOCK_VOLUMES + offset, len(starts) * BLOCK_VOLUMES
            sums = np.bincount(at, hrf_step(lag) - hrf_step(lag - duration[row]), size).reshape(-1, BLOCK_VOLUMES)
            hits = np.bincount(at, minlength=size).reshape(-1, BLOCK_VOLUMES) > 0
            if held is not None:
                sums[0] += value
                hits[0] |= reached
            groups = groups.take(pa.array(starts))
            if len(starts) > 1:
                yield from rows(groups.slice(0, len(starts) - 1), sums[:-1], hits[:-1])
            held, value, reached = groups.slice(len(starts) - 1), sums[-1], hits[-1]  # the next batch may go on with it
        if held is not None:
            yield from rows(held, value[None], reached[None])

    return convolve


def design_matrix(events, keys, tr, n_volumes, name="trial_type", onset="onset", duration="duration"):
    """Regressor values per volume (sparse, long): a boxcar convolved with the response, in closed form.

    An event goes to the blocks of ``BLOCK_VOLUMES`` volumes it reaches, so there is no range join and no row per event and volume:
    the events of a (run, regressor, block) follow each other in a task, which adds up one block at a time.  An event without
    onset or duration reaches nothing.  ``n_volumes`` is the length of every run, or a frame with the keys and ``n_volumes`` of each
    (``align.run_lengths``).
    """
    kinds = dict(events.dtypes)
    events = with_run_length(events.where(F.col(onset).isNotNull() & F.col(duration).isNotNull()), keys, n_volumes)
    first = F.greatest(F.ceil(F.col(onset) / tr), F.lit(0))
    last = F.least(F.floor((F.col(onset) + F.col(duration) + HRF_LENGTH) / tr), F.col("n_volumes") - 1)
    by = [*keys, name]
    rows = events.select(*by, first.cast("long").alias("__first"), last.cast("long").alias("__last"), F.col(onset).cast("double").alias("__onset"), F.col(duration).cast("double").alias("__duration")).where("__first <= __last")
    block = lambda c: F.floor(F.col(c) / BLOCK_VOLUMES)
    rows = rows.select(*by, F.explode(F.sequence(block("__first"), block("__last"))).alias("__block"), "__first", "__last", "__onset", "__duration")
    rows = rows.repartition(*by, "__block").sortWithinPartitions(*by, "__block")
    out = rows.mapInArrow(_convolved(tr, len(by) + 1), "".join(f"`{c}` {kinds[c]}, " for c in by) + "volume long, value double")
    return out.select(*keys, "volume", name, "value")


def trial_design(events, keys, subject, run, is_trial, order, tr, n_volumes, nuisance="trial_type"):
    """One regressor per trial plus the nuisance types; the trial number runs on over the subject's runs."""
    trials = with_index(events.where(is_trial), [subject], [run, *order], "trial_idx_global")
    trials = trials.withColumn("regressor", F.format_string("trial_%03d", "trial_idx_global"))
    rest = events.where(~is_trial).withColumns({"regressor": F.col(nuisance), "trial_idx_global": F.lit(None).cast("long")})
    return design_matrix(trials.unionByName(rest), keys, tr, n_volumes, "regressor")


def with_drift(design, keys, n_cosines, order="volume"):
    """Add an intercept and slow cosine columns c1.. to a wide design."""
    d = with_index(design, keys, [order], "__i")
    d = with_totals(d, keys, {"__n": F.count(F.lit(1))})
    cos = {f"drift{j}": F.cos(math.pi * (2 * F.col("__i") + 1) * j / (2 * F.col("__n"))) for j in range(1, n_cosines + 1)}
    return d.withColumns({"intercept": F.lit(1.0), **cos}).drop("__i", "__n")


def _cell_sums(design, data, keys, cell, regressors, row, value):
    """Sums over volumes: of the design per run, and of design x value per (run, cell); no row is copied."""
    x = [F.col(r) for r in regressors]
    k = len(x)
    des = design.groupBy(*keys).agg(*[F.sum(a).alias(f"__s{i}") for i, a in enumerate(x)],
                                    *[F.sum(x[i] * x[j]).alias(f"__x{i}_{j}") for i in range(k) for j in range(i, k)], F.count(F.lit(1)).alias("n"))
    y = F.col(value)
    joined = join_keys(data.select(*keys, row, *cell, value), design.select(*keys, row, *regressors), [*keys, row])
    cells = joined.groupBy(*keys, *cell).agg(*[F.sum(a * y).alias(f"__y{i}") for i, a in enumerate(x)], F.sum(y).alias("__sy"), F.sum(y * y).alias("__syy"))
    return des, cells


def glm_fit(design, data, keys, cell, regressors, row="volume", value="value"):
    """Ordinary least squares per run and cell: betas, degrees of freedom and R2.

    X'X is inverted once per run; each cell then needs its k products with the data.
    """
    k = len(regressors)
    des, cells = _cell_sums(design, data, keys, cell, regressors, row, value)
    flat = F.array(*[F.col(f"__x{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
    inv = des.select(*keys, "n", F.pandas_udf(inverse, "array<double>")(flat).alias("__inv"))
    c = join_keys(cells.select(*keys, *cell, "__sy", "__syy", F.array(*[F.col(f"__y{i}") for i in range(k)]).alias("__xty")), inv, list(keys))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    c = c.withColumn("betas", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: dot(F.slice("__inv", j * k + 1, F.lit(k)), F.col("__xty"))))
    sst = F.col("__syy") - F.col("__sy") * F.col("__sy") / F.col("n")
    sse = F.greatest(F.col("__syy") - dot(F.col("betas"), F.col("__xty")), F.lit(0.0))
    c = c.withColumns({"dof": F.col("n") - k, "r2": F.when(sst > 1e-12, 1 - sse / sst)})
    return c.select(*keys, *cell, "dof", "r2", *[F.col("betas")[i].alias(f"beta_{r}") for i, r in enumerate(regressors)])


def regressor_snr(design, data, keys, cell, regressors, row="volume", value="value"):
    """Mean absolute r of each regressor with all cells, and the regressor's SD and range."""
    des, cells = _cell_sums(design, data, keys, cell, regressors, row, value)
    j = join_keys(cells, des, list(keys))
    n, sy = F.col("n"), F.col("__sy")
    vy = F.col("__syy") - sy * sy / n
    rows = []
    for i, r in enumerate(regressors):
        sx = F.col(f"__s{i}")
        vx = F.col(f"__x{i}_{i}") - sx * sx / n
        rows.append(F.struct(F.lit(r).alias("regressor"), F.when((vx > 1e-12) & (vy > 1e-12), (F.col(f"__y{i}") - sx * sy / n) / F.sqrt(vx * vy)).alias("r")))
    out = j.select(*keys, F.inline(F.array(*rows))).groupBy(*keys, "regressor").agg(F.avg(F.abs("r")).alias("mean_abs_r"), F.count("r").alias("n_cells"))
    sd = F.array(*[F.struct(F.lit(r).alias("regressor"), F.stddev_samp(r).alias("sd"), (F.max(r) - F.min(r)).alias("range")) for r in regressors])
    return join_keys(out, design.groupBy(*keys).agg(sd.alias("__s")).select(*keys, F.inline("__s")), [*keys, "regressor"])


BLOCK_CHANNELS, CHUNK_SAMPLES, BUCKET_SAMPLES = 64, 4096, 65536


def _starts(*codes):
    """Places where sorted codes begin a new combination."""
    return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)])


def _multiplied(n_keys, a_first):
    """A function for ``applyInArrow``: for each trial of a bucket, the products of two blocks' channels over one chunk, as a matrix product."""
    def multiply(key, table):
        low, high = key[1].as_py(), key[2].as_py()
        names = [f"k{n}" for n in range(n_keys)]
        code = {n: pc.rank(table[n].combine_chunks(), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64) for n in (*names, "c", "t", "v")}
        trial = np.unique(np.stack([code[n] for n in names]), axis=1, return_inverse=True)[1].reshape(-1) if names else np.zeros(len(table), np.int64)
        order = np.lexsort((code["v"], code["t"], code["c"], trial))
        trial, c, t = trial[order], code["c"][order], code["t"][order]
        values, real, block = pc.fill_null(table["v"], 0.0).to_numpy()[order], table["real"].to_numpy()[order], table["block"].to_numpy()[order]
        # The k-th of several samples at one time meets the k-th of the other channel.
        first = _starts(trial, c, t)
        nth = np.arange(len(c)) - np.repeat(first, np.diff(np.r_[first, len(c)]))
        times, place = np.unique(np.stack([trial, t, nth]), axis=1, return_inverse=True)
        place, heads = place.reshape(-1), _starts(trial, c)
        row = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(c)]))
        begin = np.r_[_starts(trial), len(c)]
        column = np.r_[_starts(times[0]), times.shape[1]]
        found = []
        for s0, s1, p0, p1 in zip(begin, begin[1:], column, column[1:]):
            here, r0 = slice(s0, s1), row[s0]
            x = np.zeros((row[s1 - 1] + 1 - r0, p1 - p0))
            seen = np.zeros_like(x)
            x[row[here] - r0, place[here] - p0] = values[here]
            seen[row[here] - r0, place[here] - p0] = real[here]
            of = block[heads[r0:row[s1 - 1] + 1]]
            left, right = np.flatnonzero(of == low), np.flatnonzero(of == high)
            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
            keep = i >= j if low == high else np.ones(len(i), bool)
            dot, both = ((m[left] @ m[right].T).reshape(-1)[keep] for m in (x, seen))
            found.append((r0 + np.maximum(i, j)[keep], r0 + np.minimum(i, j)[keep], dot, both))
        later, earlier, dot, both = (np.concatenate(f) for f in zip(*found))
        ends = {"a": later, "b": earlier} if a_first else {"a": earlier, "b": later}
        take = lambda name, k: table[name].take(pa.array(order[heads[k]]))
        out = {n: take(n, later) for n in names} | {e: take("c", k) for e, k in ends.items()}
        out |= {"dot": pa.array(dot), "both": pa.array(both.astype(np.int64))}
        return pa.table(out | {f"{f}{e}": take(f, k) for e, k in ends.items() for f in ("s", "n")})

    return multiply


def _channel_pairs(df, keys, channel, t, value, strict):
    """Products of centred series for all channel pairs of a trial: (keys, a, b, dot, sa, sb, n); a > b if ``strict``, else a <= b.

    Channels fall into blocks of about ``BLOCK_CHANNELS`` and samples into chunks of about ``CHUNK_SAMPLES`` by hashes, so a task holds
    two blocks of one chunk (short trials share a task, about ``BUCKET_SAMPLES`` of theirs), multiplies them as matrices and emits numbers; a sample is copied once per block, not once per channel,
    and sums over chunks finish a pair.  A series with a missing sample, or two series with other times, have a missing dot.
    """
    keys = list(keys)
    kinds = dict(df.dtypes)
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(channel).alias("c"), F.col(t).alias("t"), F.col(value).cast("double").alias("v"))
    own = [f"k{i}" for i in range(len(keys))]
    stats = rows.groupBy(*own, "c").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.when(F.count("v") == F.count(F.lit(1)), F.count("v") * F.var_pop("v")).alias("s"))
    stats = with_totals(stats, own, {"longest": F.max("n")})
    stats = with_row(stats, stats.agg(F.ceil(F.count_distinct("c") / BLOCK_CHANNELS).alias("blocks"), F.ceil(F.sum("n") / BUCKET_SAMPLES).alias("buckets")))
    stats = once(stats).select(*own, "c", "n", "m", "s", F.ceil(F.col("longest") / CHUNK_SAMPLES).alias("chunks"), F.pmod(F.xxhash64("c"), F.col("blocks")).alias("block"), "blocks", F.pmod(F.xxhash64(F.lit(0), *own), F.col("buckets")).alias("bucket"))
    rows = join_keys(rows, stats, [*own, "c"]).withColumns({"chunk": F.pmod(F.xxhash64("t"), F.col("chunks")), "real": F.lit(1.0)})
    # A row without a sample in the first chunk lets two channels meet that share no chunk.
    rows = rows.unionByName(stats.withColumns({"chunk": F.lit(0).cast("long"), "real": F.lit(0.0)}), allowMissingColumns=True)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select(*own, "c", "t", (F.col("v") - F.col("m")).alias("v"), "real", "s", "n", "bucket", "block", "chunk", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    c = kinds[channel]
    schema = ", ".join([*[f"k{i} {kinds[k]}" for i, k in enumerate(keys)], f"a {c}, b {c}, dot double, both long, sa double, na long, sb double, nb long"])
    tiles = rows.groupBy("bucket", "low", "high", "chunk").applyInArrow(_multiplied(len(own), strict), schema)
    if strict:
        tiles = tiles.where(F.col("a") != F.col("b"))
    g = tiles.groupBy(*own, "a", "b").agg(F.sum("dot").alias("dot"), F.sum("both").alias("both"), *[F.max(x).alias(x) for x in ("sa", "na", "sb", "nb")])
    whole = (F.col("both") == F.col("na")) & (F.col("both") == F.col("nb")) & F.col("sa").isNotNull() & F.col("sb").isNotNull()
    return g.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "a", "b", F.when(whole, F.col("dot")).alias("dot"), "sa", "sb", F.col("na").alias("n"))


def envelope_connectivity(df, keys, channel="channel", t="t", value="x"):
    """Correlation of amplitude envelopes per (trial, node pair), lower triangle."""
    j = _channel_pairs(df, keys, channel, t, value, True)
    ok = (F.col("sa") > 1e-24) & (F.col("sb") > 1e-24)
    return j.select(*keys, F.col("a").alias("node_a"), F.col("b").alias("node_b"), F.when(ok, F.col("dot") / F.sqrt(F.col("sa") * F.col("sb"))).alias("value"))


def trial_covariance(df, keys, channel="channel", t="t", value="x", shrink=True):
    """Channel covariance per trial (upper triangle), shrunk toward the mean variance by the oracle-approximating weight."""
    j = _channel_pairs(df, keys, channel, t, value, False).withColumn("cov", F.col("dot") / F.col("n"))
    if shrink:
        diag = F.col("a") == F.col("b")
        agg = j.groupBy(*keys).agg(F.count_if(diag).alias("__p"), F.sum(F.when(diag, F.col("cov"))).alias("__tr"), F.sum(F.col("cov") * F.col("cov") * F.when(diag, 1.0).otherwise(2.0)).alias("__tr2"), F.max("n").alias("__T"))
        mu, alpha = F.col("__tr") / F.col("__p"), F.col("__tr2") / (F.col("__p") * F.col("__p"))
        rho = F.least(F.lit(1.0), F.coalesce(F.try_divide(alpha + mu * mu, (F.col("__T") + 1) * (alpha - mu * mu / F.col("__p"))), F.lit(1.0)))
        agg = agg.select(*keys, mu.alias("__mu"), rho.alias("shrinkage"))
        j = join_keys(j, agg, list(keys)).withColumn("cov", (1 - F.col("shrinkage")) * F.col("cov") + F.when(diag, F.col("shrinkage") * F.col("__mu")).otherwise(0.0))
        return j.select(*keys, "a", "b", "cov", "shrinkage")
    return j.select(*keys, "a", "b", "cov")


def covariance_bin_contrast(df, subject, trial, rating, channel="channel", t="t", value="x", low=0.333, high=0.667, min_trials=2):
    """Mean covariance of low- and high-rating trials over subjects with enough of both, and their difference."""
    one = df.select(subject, trial, rating).distinct()
    q = quantiles(one, [subject], rating, {"__lo": low, "__hi": high})
    b = join_keys(one, q, [subject]).withColumn("bin", F.when(F.col(rating) <= F.col("__lo"), "low").when(F.col(rating) >= F.col("__hi"), "high")).where("bin is not null")
    b = with_totals(b, [subject, "bin"], {"__n": F.count(F.lit(1))}).where(F.col("__n") >= min_trials).select(subject, trial, "bin")
    cov = join_keys(trial_covariance(df, [subject, trial], channel, t, value), b, [subject, trial])
    sub = cov.groupBy(subject, "bin", "a", "b").agg(F.avg("cov").alias("c"))
    g = sub.groupBy("a", "b").agg(F.avg(F.when(F.col("bin") == "low", F.col("c"))).alias("low"), F.avg(F.when(F.col("bin") == "high", F.col("c"))).alias("high"), F.count_distinct(subject).alias("n_subjects"))
    return g.withColumn("difference", F.col("high") - F.col("low"))


def threshold_graph(edges, keys, quantile, value="value", order=("node_a", "node_b")):
    """Pairs whose absolute weight reaches the value at index int(q n) of the sorted weights."""
    w = edges.where(F.col(value).isNotNull()).withColumn("weight", F.abs(value))
    w = with_index(w, keys, ["weight", *order], "__i")
    w = with_totals(w, keys, {"__n": F.count(F.lit(1))})
    at = F.greatest(F.least(F.floor(quantile * F.col("__n")), F.col("__n") - 1), F.lit(0))
    cut = w.where(F.col("__i") == at).select(*keys, F.col("weight").alias("cutoff"))
    return join_keys(w.drop("__i", "__n"), cut, list(keys)).where(F.col("weight") >= F.col("cutoff"))


def hop_sums(both, keys, u="u", v="v"):
    """Per node and group of 64 sources: how many of them it ``reached``, the sum of their distances and of their inverses.

    A breadth-first search from all nodes of a graph at once: sources are bits of a long, so a row is a node with 64
    sources and not a pair of nodes.  A round merges the bits of a node's neighbours by ``bit_or`` (partial results are merged, so
    a hub is no task of its own) and keeps those it has not seen; each round's rows are written, and nothing else
    is carried.  ``both`` has every edge in both directions.
    """
    keys = list(keys)
    numbered = with_index(both.select(*keys, F.col(u).alias("u")).distinct(), keys, ["u"], "__i")
    bit = F.expr("shiftleft(1L, cast(__i % 64 as int))")
    state = numbered.select(*keys, "u", F.floor(F.col("__i") / 64).alias("word"), bit.alias("seen"), bit.alias("fresh"), *[F.lit(z).alias(c) for c, z in (("reached", 0), ("hops", 0), ("inverse", 0.0))])
    state = stored(state.select(*keys, "u", "word", "seen", "fresh", F.col("reached").cast("long"), F.col("hops").cast("long"), "inverse"), "hops")
    edges = both.select(*keys, F.col(u).alias("u"), F.col(v).alias("__to"))
    distance = 0
    while True:
        distance += 1
        met = join_keys(state.where("fresh <> 0").select(*keys, "u", "word", "fresh"), edges, [*keys, "u"])
        met = met.groupBy(*keys, F.col("__to").alias("u"), "word").agg(F.bit_or("fresh").alias("__met"))
        both_ways = join_full(state, met, [*keys, "u", "word"])
        seen = F.coalesce("seen", F.lit(0).cast("long"))
        new = F.coalesce("__met", F.lit(0).cast("long")).bitwiseAND(F.bitwise_not(seen))
        count = F.bit_count(new).cast("long")
        add = lambda c, x: (F.coalesce(c, F.lit(0)) + x).alias(c)
        state = stored(both_ways.select(*keys, "u", "word", seen.bitwiseOR(new).alias("seen"), new.alias("fresh"), add("reached", count), add("hops", count * F.lit(distance)), add("inverse", count / F.lit(float(distance)))), "hops")
        if not state.where("fresh <> 0").limit(1).count():
            return state


def join_full(left, right, keys):
    """Full join on keys that may be missing; the keys appear once."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    # a word is never missing, so it tells the sides of an unmatched row apart
    mine = F.col(keys[-1]).isNotNull()
    j = left.join(right, reduce(lambda a, b: a & b, on), "full")
    return j.select(*[F.when(mine, F.col(k)).otherwise(F.col(f"__r_{k}")).alias(k) for k in keys], *[c for c in j.columns if c not in keys and c not in {f"__r_{k}" for k in keys}])


def graph_metrics(edges, nodes, keys, a="node_a", b="node_b", node="node"):
    """Mean degree, mean clustering, path length over reachable pairs and global efficiency of undirected graphs.

    Triangles are closed from the end of lower degree, which keeps hubs from opening all
    their neighbour pairs.  Distances come from ``hop_sums``.
    """
    e = edges.select(*keys, F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()
    both = stored(e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))), "adjacency")
    deg = both.groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("deg"))
    directed = join_keys(join_keys(both, deg, [*keys, "u"]), deg.withColumnsRenamed({"u": "v", "deg": "deg_v"}), [*keys, "v"])
    out = directed.where((F.col("deg") < F.col("deg_v")) | ((F.col("deg") == F.col("deg_v")) & (F.col("u") < F.col("v")))).select(*keys, "u", "v")
    wedge = join_keys(out.withColumnRenamed("v", "x"), out.withColumnRenamed("v", "y"), [*keys, "u"]).where("x < y")
    tri = join_keys(wedge, e.select(*keys, F.col("u").alias("x"), F.col("v").alias("y")), [*keys, "x", "y"])
    per = tri.select(*keys, F.explode(F.array("u", "x", "y")).alias("u")).groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("tri"))
    n = nodes.select(*keys, F.col(node).alias("u"))
    local = join_keys(join_keys(n, deg, [*keys, "u"], "left"), per, [*keys, "u"], "left").fillna(0, ["deg", "tri"])
    cc = F.when(F.col("deg") > 1, 2 * F.col("tri") / (F.col("deg") * (F.col("deg") - 1))).otherwise(0.0)
    m = local.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("deg").alias("mean_degree"), F.avg(cc).alias("clustering"))

    paths = hop_sums(both, keys).groupBy(*keys).agg((F.sum("hops") / F.sum("reached")).alias("path_length"), F.sum("inverse").alias("__e"))
    out = join_keys(m, paths, list(keys), "left")
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return out.withColumn("efficiency", F.coalesce(F.try_divide(F.col("__e"), pairs), F.lit(0.0))).drop("__e")


