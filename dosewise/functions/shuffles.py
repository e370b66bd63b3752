"""Keyed permutations of [0, n) by whole-number arithmetic, for arrays inside tasks and as SQL text.

A position is a cell of a grid with about sqrt(n) rows and columns.  Ten rounds turn each row (or column) by an amount that
its number and the round's key decide, which is a Feistel network and so one-to-one on the grid; a result outside [0, n) goes
through the rounds again until it is inside.  Nothing is sorted, and one position needs no other.

Sent to the workers by value, so executors need numpy and pyarrow but not this package.
"""

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from .draws import FACTORS, MODULUS, sql_hash

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUNDS = 10
CARRY = 48271  # Fixed value: a primitive root of the modulus.


def mixed(h):
    return ((h & 65535) * 69621 + (h >> 16) * 40692 + (h % 32749) * (h % 31337)) % MODULUS


def long_hashes(seed, rep, pos):
    """``seeded_hash`` itself for arrays: 62 bits."""
    words = []
    for low, middle, high, copy, salt in FACTORS:
        place = pos % 65536 * low + (pos >> 16) % 65536 * middle + (pos >> 32) * high
        words.append(mixed(mixed((place + (rep % MODULUS) * copy + (int(seed) * salt % MODULUS + 12345)) % MODULUS)))
    return words[0] * 2147483648 + words[1]


def draw_counts(seed, reps, mine, sizes, n):
    """How often each of the slice's members is drawn when ``n`` are drawn with replacement from all slices: (replicates, members).

    The split over slices is one multinomial draw per replicate, repeated alike wherever it is needed.
    """
    share, rows = np.asarray(sizes, dtype=float) / n, sizes[mine]
    counts = np.zeros((len(reps), rows))
    for k, rep in enumerate(reps):
        here = np.random.default_rng([int(seed) % (1 << 32), int(rep)]).multinomial(n, share)[mine]
        slots = (np.int64(mine) << 40) + np.arange(here, dtype=np.int64)
        counts[k] = np.bincount(long_hashes(seed, np.int64(rep), slots) % rows, minlength=rows)
    return counts


def slice_totals(seed, reps, sizes):
    """How many of a replicate's draws (as many as there are rows) fall to each slice: (replicates, slices).

    One multinomial draw per replicate, repeated alike wherever it is needed.
    """
    n = sum(sizes)
    if len(sizes) == 1:
        return np.full((len(reps), 1), n)
    share = np.asarray(sizes, dtype=float) / n
    return np.stack([np.random.default_rng([int(seed) % (1 << 32), int(rep)]).multinomial(n, share) for rep in reps])


def slice_counts(seed, reps, mine, here, rows):
    """How often each row of a slice is drawn when ``here`` draws of the replicate fall to it: (replicates, rows)."""
    reps, here = np.asarray(reps, dtype=np.int64)[:, None], np.asarray(here)[:, None]
    slots = np.arange(int(here.max()), dtype=np.int64)[None, :]
    drawn = long_hashes(seed, reps, (np.int64(mine) << 40) + slots) % rows + np.arange(len(reps))[:, None] * rows
    return np.bincount(drawn[slots < here], minlength=len(reps) * rows).reshape(len(reps), rows).astype(float)


def drawn_midranks(x, seed, reps, mine, sizes, first, last, counts=None):
    """Counts and centred average ranks of a slice's rows in each replicate: two arrays (replicates, rows).

    ``x`` are the slice's values; rows are numbered through all slices in the order of the values.  ``first`` is the number of
    the first row anywhere that ties with the slice's lowest value, ``last`` that of the last row that ties with its highest:
    such ties may lie in other slices, whose draws are repeated here.  ``counts`` are the slice's own, if the caller has them.
    """
    totals = slice_totals(seed, reps, sizes)
    counts = slice_counts(seed, reps, mine, totals[:, mine], sizes[mine]) if counts is None else counts
    starts = np.flatnonzero(np.r_[True, np.diff(x) != 0])
    tied = np.add.reduceat(counts, starts, axis=1)
    below = totals[:, :mine].sum(axis=1)[:, None] + np.cumsum(tied, axis=1) - tied
    a, b = first // sizes[0], last // sizes[0]
    if a < mine:
        part = slice_counts(seed, reps, a, totals[:, a], sizes[a])[:, first - a * sizes[0]:].sum(axis=1) + totals[:, a + 1:mine].sum(axis=1)
        below[:, 0] -= part
        tied[:, 0] += part
    if b > mine:
        tied[:, -1] += slice_counts(seed, reps, b, totals[:, b], sizes[b])[:, :last - b * sizes[0] + 1].sum(axis=1) + totals[:, mine + 1:b].sum(axis=1)
    ranks = below + (tied + 1) / 2 - (sum(sizes) + 1) / 2
    return counts, np.repeat(ranks, np.diff(np.r_[starts, len(x)]), axis=1)


def tied_sums(values, *tables):
    """The distinct values in order, and the sums of each table's columns (replicates, rows) over rows of equal value."""
    order = np.argsort(values, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(values[order]) != 0])
    return [values[order][starts], *[np.add.reduceat(np.ascontiguousarray(t.T)[order], starts, axis=0).T for t in tables]]


def round_keys(seed, group, reps):
    """One key per replicate and round: (replicates, ROUNDS); ``group`` is a number below 2^48."""
    reps = np.asarray(reps, dtype=np.int64)[:, None]
    return long_hashes(seed, reps, np.int64(group) * 16 + np.arange(ROUNDS, dtype=np.int64)[None, :]) % MODULUS


def turns(keys, rows, cols):
    """How far each round turns each row (or column) of the grid: one array (replicates, rows or columns) per round."""
    h = (np.arange(max(rows, cols), dtype=np.uint64) * np.uint64(CARRY) + keys.astype(np.uint64)[:, :, None]) % np.uint64(MODULUS)
    h = mixed(h)
    return [(h[:, t, :rows] % np.uint64(cols) if t % 2 == 0 else h[:, t, :cols] % np.uint64(rows)).astype(np.int64) for t in range(ROUNDS)]


NEAR = 1 << 16  # positions that are worked on together, so that they stay in the cache
LONG = 1 << 12  # from so many positions on a replicate is worked on by itself


def grid(n):
    """Rows and columns of the grid for ``n`` positions."""
    rows = math.isqrt(n - 1) + 1 if n > 1 else 1
    return rows, -(-n // rows)


def turn_tables(keys, n, back=False):
    """``turns`` on the grid of ``n`` positions, or (``back``) those that undo them."""
    rows, cols = grid(n)
    tables = turns(keys, rows, cols)
    if back:
        tables = [np.where(v == 0, 0, (rows if t % 2 else cols) - v) for t, v in enumerate(tables)]
    return [v.astype(np.uint32) for v in tables]


def long_walk(tables, order, i, j, rows, cols, out):
    """``out``: where one replicate sends the cells (i, j), for many of them."""
    ends, near = (np.uint32(rows), np.uint32(cols)), NEAR >> 2
    moved = np.empty(min(near, len(i)), np.uint32)
    for a in range(0, len(i), near):
        place = [i[a:a + near].astype(np.uint32), j[a:a + near].astype(np.uint32)]
        got = moved[:len(place[0])]
        for t in order:
            here = place[1 - t % 2]
            np.take(tables[t], place[t % 2], out=got, mode="clip")
            here += got
            np.subtract(here, ends[1 - t % 2], out=got)
            np.minimum(here, got, out=here)  # below zero is above all others
        part = out[a:a + near]
        np.multiply(place[0], cols, out=part, dtype=np.int64)
        part += place[1]


def permuted_positions(keys, at, n, back=False, tables=None):
    """Where each replicate sends the positions ``at``, or (``back``) takes them from: (replicates, positions), in [0, n).

    A round turns all cells of a row alike, so its numbers are worked out once per row and looked up for the positions.  A
    caller that asks for many positions in parts has them from ``turn_tables`` once.
    """
    rows, cols = grid(n)
    at = np.asarray(at, dtype=np.int64)
    out = np.empty((len(keys), len(at)), np.int64)
    step = max(1, NEAR // max(1, len(at), rows))
    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    at_i, at_j = np.divmod(at, cols)
    for a in range(0, len(keys), step):
        part = out[a:a + step]
        table = turn_tables(keys[a:a + step], n, back) if tables is None else [v[a:a + step] for v in tables]
        flat = [v.ravel() for v in table]

        def walk(i, j, rep):
            for t in order:
                if t % 2 == 0:
                    j += flat[t].take(i + rep * rows)
                    j -= cols * (j >= cols)
                else:
                    i += flat[t].take(j + rep * cols)
                    i -= rows * (i >= rows)
            i *= cols
            i += j
            return i

        if len(at) >= LONG:
            for k in range(len(part)):
                long_walk([v[k] for v in table], order, at_i, at_j, rows, cols, part[k])
        else:
            part[:] = walk(np.repeat(at_i[None, :], len(part), axis=0), np.repeat(at_j[None, :], len(part), axis=0), np.arange(len(part))[:, None])
        rep, where = np.nonzero(part >= n)
        while len(rep):
            p = part[rep, where]
            again = walk(p // cols, p % cols, rep)
            part[rep, where] = again
            left = again >= n
            rep, where = rep[left], where[left]
    return out


class Slice:
    """Rows of one slice as arrays, ordered by the values that sums are kept apart by."""

    def __init__(self, x, acc):
        self.rows = len(acc)
        x = x.to_numpy(zero_copy_only=False).reshape(self.rows, -1)
        kept = acc.dictionary_encode(null_encoding="encode")
        codes = kept.indices.to_numpy()
        self.order = np.argsort(codes, kind="stable")
        self.x = x[self.order]
        self.starts = np.flatnonzero(np.r_[True, np.diff(codes[self.order]) != 0]) if self.rows else np.zeros(0, np.int64)
        self.values = kept.dictionary.take(pa.array(codes[self.order][self.starts]))

    def received(self, keyed, start, n, ys, low, tables=None):
        """What the rows get in each replicate, in their order here, of the values ``ys`` of places from ``low`` on; 0 for others."""
        at = permuted_positions(keyed, start + self.order, n, back=True, tables=tables)
        if low == 0 and len(ys) == n:
            return ys.take(at)
        at -= low
        there = (at >= 0) & (at < len(ys))
        return np.where(there, ys.take(at, mode="clip"), 0.0)

    def sums(self, got):
        """(values of acc, replicates, [sum y, sum y^2, sums x y]) of the received values."""
        many, width = len(self.starts), self.x.shape[1]
        out = np.empty((many, len(got), width + 2))
        if many == 1:
            out[0, :, 0], out[0, :, 1], out[0, :, 2:] = got.sum(axis=1), np.einsum("ij,ij->i", got, got), got @ self.x
        elif width <= 4:
            out[:, :, 0] = np.add.reduceat(got, self.starts, axis=1).T
            out[:, :, 1] = np.add.reduceat(got * got, self.starts, axis=1).T
            for j in range(width):
                out[:, :, j + 2] = np.add.reduceat(got * self.x[:, j], self.starts, axis=1).T
        else:
            for k, (a, b) in enumerate(zip(self.starts, [*self.starts[1:], self.rows])):
                part = got[:, a:b]
                out[k, :, 0], out[k, :, 1], out[k, :, 2:] = part.sum(axis=1), (part * part).sum(axis=1), part @ self.x[a:b]
        return out


def drawn_sums(part, many, reps, drawn, at_once):
    """(replicates, sums) of the members' counts ``drawn(replicates)``, each over its ``many`` rows, a few replicates at a time.

    No array of replicates and rows has more than ``at_once`` entries (or one replicate's).
    """
    member = np.repeat(np.arange(len(many)), many)[part.order]
    step = max(1, at_once // max(1, part.rows))
    for k in range(0, len(reps), step):
        now = reps[k:k + step]
        yield now, part.sums(drawn(now).take(member, axis=1))


ROWS_OUT = 1 << 17


class Rows:
    """Sums of a task as rows (keys, acc, rep, sums)."""

    def __init__(self, n_keys):
        self.n_keys, self.held, self.size = n_keys, [], 0

    def add(self, batch, i, part, reps, sums):
        many, width = len(part.starts), sums.shape[2]
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, width), pa.int32()), pa.array(sums.ravel()))
        acc = part.values.take(pa.array(np.repeat(np.arange(many), len(reps))))
        key = [batch.column(k).take(pa.array(np.full(len(acc), i))) for k in range(self.n_keys)]
        self.held.append(pa.RecordBatch.from_arrays([*key, acc, pa.array(np.tile(reps, many), pa.int64()), flat], names=[*batch.schema.names[:self.n_keys], "__acc", "rep", "sums"]))
        self.size += len(acc)
        if self.size >= ROWS_OUT:
            yield from self.end()

    def end(self):
        if self.held:
            yield from pa.Table.from_batches(self.held).combine_chunks().to_batches()
        self.held, self.size = [], 0


class Counts:
    """How many of a group's shuffles reach its r: rows (keys, ge, n_perm), from sums of x y and the columns __r and __spread."""

    def __init__(self, n_keys):
        self.n_keys, self.at, self.found, self.batch = n_keys, [], [], None

    def add(self, batch, i, part, reps, sums):
        if batch is not self.batch:
            yield from self.end()
            self.batch = batch
        r, spread = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("__r", "__spread"))
        known = spread is not None and r is not None
        null = np.clip(sums[0, :, 2] / spread, -1.0, 1.0) if known else None
        self.at.append(i)
        self.found.append((int((np.abs(null) >= abs(r) - 1e-12).sum()), len(reps)) if known else (0, 0))

    def end(self):
        if self.at:
            key = [self.batch.column(k).take(pa.array(self.at)) for k in range(self.n_keys)]
            yield pa.RecordBatch.from_arrays([*key, *[pa.array(v, pa.int64()) for v in zip(*self.found)]], names=[*self.batch.schema.names[:self.n_keys], "ge", "n_perm"])
        self.at, self.found = [], []


class Totals:
    """Sums over a task's groups, apart by the first ``outer`` keys: rows (outer keys, rep, sums).

    Of each group's s = sum x y the terms w s of ``lines`` weights for each x and v s^2 of ``squares`` weights are added up; the
    column __w has the weights, for each x the lines and then the squares.  Without weights s itself is added.
    """

    def __init__(self, outer, lines=1, squares=0):
        self.outer, self.lines, self.squares, self.held, self.size = outer, lines, squares, {}, 0

    def weighed(self, s, w):
        if w is None:
            return s
        w = np.asarray(w, dtype=float).reshape(s.shape[1], self.lines + self.squares)
        line, square = w[:, :self.lines], w[:, self.lines:]
        return np.concatenate([s[:, :, None] * line, (s * s)[:, :, None] * square], axis=2).reshape(len(s), -1)

    def add(self, batch, i, part, reps, sums):
        at = batch.schema.get_field_index("__w")
        new = self.weighed(sums[0, :, 2:], batch.column(at)[i].values.to_numpy() if at >= 0 else None)
        key = (*[batch.column(k)[i].as_py() for k in range(self.outer)], int(reps[0]), len(reps))
        if key in self.held:
            self.held[key] += new
        else:
            self.held[key] = new.copy()
            self.size += new.size
        self.schema = batch.schema
        if self.size >= ROWS_OUT * 16:
            yield from self.end()

    def end(self):
        for key, sums in self.held.items():
            many, width = sums.shape
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, width), pa.int32()), pa.array(sums.ravel()))
            same = [pa.array([key[k]] * many, self.schema.field(k).type) for k in range(self.outer)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(key[-2] + np.arange(many), pa.int64()), flat], names=[*self.schema.names[:self.outer], "rep", "sums"])
        self.held, self.size = {}, 0


def line_terms(sy, sxy, n, tn, m, w, cx, cxx):
    """What a left-out group adds to (S, q0, q1): its predictions' squares less twice their products with y are q0 + S q1 + S^2 w^2 cxx.

    x and y are reduced by their means over all rows, S is the sum of x y over all groups, sy and sxy are the group's sums.  The line
    of the other groups (tn rows with mean m of x) has the slope b = w (S - sxy + m sy) and passes through (m, -sy / tn); cx and
    cxx are the group's sums of x - m and its square.
    """
    e, cxy = -sy / tn, sxy - m * sy
    v, t = cxy * w, e * cx - cxy
    return sxy, e * e * n - 2 * e * sy - 2 * v * t + v * v * cxx, 2 * w * (t - v * cxx)


class Lines:
    """``line_terms`` of the groups that lie whole in a slice, added up over a task: rows (no acc, rep, [S, q0, q1]).  The sums of
    parts of groups leave as rows (acc, rep, [sy, sxy]).  The columns __of and __fixed have the groups of a slice and their numbers."""

    def __init__(self, kind):
        self.parts, self.held, self.kind = Rows(0), {}, kind

    def add(self, batch, i, part, reps, sums):
        of, fixed = (batch.column(batch.schema.get_field_index(c))[i].values for c in ("__of", "__fixed"))
        fixed = fixed.to_numpy().reshape(len(of), -1)[pc.index_in(part.values, value_set=of).to_numpy()]
        whole = np.diff(np.r_[part.starts, part.rows]) == fixed[:, 0]
        terms = line_terms(sums[whole, :, 0], sums[whole, :, 2], *fixed[whole].T[:, :, None])
        new = np.stack([v.sum(axis=0) for v in terms], axis=1)
        key = int(reps[0]), len(reps)
        self.held[key] = self.held[key] + new if key in self.held else new
        if not whole.all():
            rest = np.flatnonzero(~whole)
            yield from self.parts.add(batch, i, Part(part.starts[rest], part.values.take(pa.array(rest))), reps, sums[rest][:, :, [0, 2]])

    def end(self):
        yield from self.parts.end()
        for (first, many), sums in self.held.items():
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, 3), pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([pa.nulls(many, self.kind), pa.array(first + np.arange(many), pa.int64()), flat], names=["__acc", "rep", "sums"])
        self.held = {}


class Part:
    """Some of the groups of a slice."""

    def __init__(self, starts, values):
        self.starts, self.values = starts, values


def sql_group(*keys):
    """The number of a group, as SQL text over its key columns."""
    text = f"concat_ws(':', {', '.join(f'{k}::VARCHAR' for k in keys)})" if keys else "''"
    return f"('0x' || substr(md5({text}), 1, 12))::BIGINT"


def sql_shuffle(name, source, n_perm, seed, keys=(), at="pos"):
    """Oracle tables: ``name`` has keys, ``at``, rep and ``moved``, the place that replicate gives to the row at ``at``.

    ``source`` has the keys and positions 0..n-1 inside them.
    """
    ks = "".join(f"{k}, " for k in keys)
    by = f"PARTITION BY {', '.join(keys)}" if keys else ""
    key = ", ".join(f"({sql_hash(seed, 'rep', f'grp_code * 16 + {t}')}) % {MODULUS} AS c{t}" for t in range(ROUNDS))
    mix = "(((h % 65536) * 69621 + (h // 65536) * 40692 + (h % 32749) * (h % 31337)) % 2147483647)"
    rest = f"{ks}{at}, rep, n, rws, cls, {', '.join(f'c{t}' for t in range(ROUNDS))}, step"
    turn = f"SELECT {rest}, p // cls AS i, p % cls AS j FROM {name}_w WHERE step = 0 OR p >= n"
    for t in range(ROUNDS):
        src = "i" if t % 2 == 0 else "j"
        turn = f"SELECT {rest}, i, j, ({src} * {CARRY} + c{t}) % {MODULUS} AS h FROM ({turn})"
        moved = f"i, (j + {mix}) % cls AS j" if t % 2 == 0 else f"(i + {mix}) % rws AS i, j"
        turn = f"SELECT {rest}, {moved} FROM ({turn})"
    return (f"{name}_n AS (SELECT {ks}{at}, count(*) OVER ({by}) AS n FROM {source}),"
            f"{name}_g AS (SELECT {ks}{at}, n, rws, (n + rws - 1) // rws AS cls, {sql_group(*keys)} AS grp_code FROM (SELECT *, CASE WHEN n > 1 THEN floor(sqrt(n - 1))::BIGINT + 1 ELSE 1 END AS rws FROM {name}_n)),"
            f"{name}_k AS (SELECT {ks}rep, {key} FROM (SELECT DISTINCT {ks}grp_code FROM {name}_g), range(1, {n_perm + 1}) r(rep)),"
            f"{name}_w AS (SELECT {ks}{at}, rep, n, rws, cls, {', '.join(f'c{t}' for t in range(ROUNDS))}, 0 AS step, {at}::BIGINT AS p FROM {name}_g JOIN {name}_k {f'USING ({', '.join(keys)})' if keys else 'ON true'}"
            f" UNION ALL SELECT {ks}{at}, rep, n, rws, cls, {', '.join(f'c{t}' for t in range(ROUNDS))}, step + 1, i * cls + j FROM ({turn})),"
            f"{name} AS (SELECT {ks}{at}, rep, p AS moved FROM {name}_w WHERE step > 0 AND p < n)")
