"""Exact n-gram Jaccard join by partition-and-enumerate signatures, and the groups its links form.

A document is its set of hashed word shingles.  Sets are sorted into size bands; within a band a bound on the Jaccard
similarity is a bound on the number of elements in which two sets differ.  The element domain is cut into first-level
partitions and each of those into second-level ones; a signature is what a set holds in a subset of the second-level
partitions of one first-level partition.  There are more partitions than differences, so two similar sets agree in some
subset and share its signature.
"""

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import batch_of, fields_of, slices
from .hashing import WordHashes, fold_table, mix, space_table

WORDS = 5
NUM, DEN = 75, 100
BAND_RATIO = 2.0
SECOND, LEFT_OUT = 2, 1
SKETCH_BINS = 128
COARSE, FINE = 0.2, 0.7
BLOCK_ROWS = 1024
SET_BYTES = 16 << 20
BROADCAST_ROWS = 1_000_000
# Shingles that a task counts at a time and the most frequent of them that leave it; those that the signatures are told of.
COUNTED, SENT, FREQUENT = 1 << 21, 1 << 14, 1 << 17

SPACES, FOLD = space_table(), fold_table()
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingle_sets(texts, n=WORDS):
    """The sorted distinct shingle hashes of every text; of a shorter text its whole word sequence; none without words."""
    words = WordHashes(texts, SPACES, FOLD)
    h = words.hash
    steps = np.resize(STEPS, n) * np.arange(1, 2 * n, 2, dtype=np.uint64)
    total = len(h) - n + 1
    runs = np.zeros(max(0, total), np.uint64)
    for k in range(n):
        runs += h[k:k + max(0, total)] * steps[k]
    runs = mix(runs)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= n:
            yield np.unique(runs[a:b - n + 1])
        elif b > a:
            yield mix((h[a:b] * steps[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def in_stretches(texts, chars=1 << 21):
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def sketch_of(s, bins):
    """Counts of the elements by bin, in bytes.  Two sketches are no further apart than their sets."""
    return np.minimum(np.bincount((s >> np.uint64(32)).astype(np.int64) % bins, minlength=bins), 255).astype(np.uint8)


def bins_for(size, share):
    """Bins of a sketch: a power of two that follows the set's size, ``share`` bins for each element at least."""
    return max(SKETCH_BINS, 1 << max(0, int(np.ceil(np.log2(share * max(1, size))))))


def folded(sketch, bins):
    """A sketch in fewer bins: the bins are powers of two, so counts of equal remainders add up."""
    return sketch.reshape(*sketch.shape[:-1], -1, bins).sum(axis=-2, dtype=np.int16)


PROFILE = {"n": "long", "f1": "long", "f2": "long", "sketch": "binary", "fine": "binary"}


def profiles(texts, see=None):
    out = {k: [] for k in PROFILE}
    for part in in_stretches(texts):
        for s in shingle_sets(part):
            if see:
                see(s)
            out["n"].append(len(s))
            out["f1"].append(int(s.sum(dtype=np.uint64).view(np.int64)))
            out["f2"].append(int(mix(s ^ STEPS[4]).sum(dtype=np.uint64).view(np.int64)))
            out["sketch"].append(sketch_of(s, bins_for(len(s), COARSE)).tobytes())
            out["fine"].append(sketch_of(s, bins_for(len(s), FINE)).tobytes())
    return out


class Seen:
    """Counts of the shingles in the different sets of a task, ``COUNTED`` or more at a time: (shingle, seen) of the most frequent."""

    def __init__(self):
        self.held, self.known, self.size = [], set(), 0

    def see(self, s):
        key = (len(s), int(s.sum(dtype=np.uint64)))
        if len(s) and key not in self.known:
            self.known.add(key)
            self.held.append(s)
            self.size += len(s)

    def counts(self):
        values, seen = np.unique(np.concatenate(self.held or [np.zeros(0, np.uint64)]), return_counts=True)
        self.__init__()
        values, seen = values[seen > 1], seen[seen > 1]
        top = np.argsort(-seen, kind="stable")[:SENT]
        return values[top].view(np.int64), seen[top]


def profile_rows(docs, doc_id, text):
    """A profile for every row (doc_id, ``PROFILE``), and beside them rows with the counts of frequent shingles (shingle, seen)."""
    fields = {"doc_id": "long", **PROFILE, "shingle": "long", "seen": "long"}
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        count = Seen()

        def counted():
            values, seen = count.counts()
            return batch_of({k: [None] * len(values) for k in ["doc_id", *PROFILE]} | {"shingle": values, "seen": seen}, fields)

        for batch in slices(batches):
            made = profiles(batch.column(1).to_pylist(), count.see)
            none = [None] * batch.num_rows
            yield batch_of({"doc_id": batch.column(0), **made, "shingle": none, "seen": none}, fields)
            if count.size >= COUNTED:
                yield counted()
        yield counted()

    return src.mapInArrow(run, T.StructType(fields_of(fields)))


def frequent(rows):
    """The most frequent shingles in ascending order, with their counts: ``FREQUENT`` of them at most reach the driver."""
    top = rows.filter("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "shingle").limit(FREQUENT).toArrow()
    values = top["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(values)
    return values[order], np.minimum(top["seen"].to_numpy()[order], 2**31 - 1).astype(np.int32)


def seen_of(s, often):
    """The counts of a set's elements among the frequent ones, 0 for others."""
    if often is None or not len(often[0]):
        return np.zeros(len(s), np.int32)
    at = np.minimum(np.searchsorted(often[0], s), len(often[0]) - 1)
    return np.where(often[0][at] == s, often[1][at], 0)


def band_of(size):
    """Number and largest size of the band that holds sets of ``size``."""
    top, band = 1, 0
    while top < size:
        top, band = max(top + 1, int(top * BAND_RATIO)), band + 1
    return band, top


def most_apart(size, top):
    """Elements in which a set of ``size`` can differ from a similar one of at most ``top`` elements."""
    return int((DEN - NUM) * (size + min(size * DEN // NUM, top)) // (DEN + NUM))


def partitions(top):
    """First-level partitions for sets of up to ``top`` elements: more second-level partitions than differences, by a margin
    for those in which a set holds nothing."""
    wanted = max(most_apart(top, top) + 1, top * 31 // 100 + 8 if top > 64 else 4 * top if top < 10 else top)
    return -(-wanted // SECOND)


def signatures(s, often=None):
    """The signatures of one set: in its own band, and in the next if a set there can be similar to it.

    An agreement about nothing at all is no evidence, so a subset without elements has a signature only where the set
    fills too few subsets to be sure of agreeing in a filled one; a similar set that it meets there alone does the same.

    A set that fills more subsets than differences can spoil agrees with every similar one in several.  All signatures have one
    order, those of frequent shingles only (``often``: values and counts) first and the others by their hash.  A set leaves out
    as many of the first as it has agreements to spare, so the last of a pair's common signatures is in both whatever the
    counts say; what a common passage brings about is left out.
    """
    band, top = band_of(len(s))
    tags = [(band, top)]
    after = band_of(top + 1)
    if (top + 1) * NUM <= len(s) * DEN:
        tags.append(after)
    shown = seen_of(s, often)
    out = []
    for tag, high in tags:
        first = partitions(high)
        cell = (s % np.uint64(first * SECOND)).astype(np.int64)
        marked = mix(s + np.uint64(tag))
        order = np.argsort(cell, kind="stable")
        sums, least = np.zeros(first * SECOND, np.uint64), np.full(first * SECOND, 2**31 - 1, np.int32)
        at = np.flatnonzero(np.diff(cell[order], prepend=-1))
        sums[cell[order][at]] = np.add.reduceat(marked[order], at)
        least[cell[order][at]] = np.minimum.reduceat(shown[order], at)
        sums, least = sums.reshape(first, SECOND), least.reshape(first, SECOND)
        made = []
        for q, chosen in enumerate(combinations(range(SECOND), SECOND - LEFT_OUT)):
            held = sums[:, chosen]
            sig = np.full(first, np.uint64(tag * 1009 + q))
            for c in range(len(chosen)):
                sig = mix(sig * STEPS[0] + held[:, c])
            sig = mix(sig + np.arange(first, dtype=np.uint64) * STEPS[1])
            made.append((sig, (held != 0).any(axis=1), least[:, chosen].min(axis=1)))
        sig, some, least = (np.concatenate(x) for x in zip(*made))
        spare = int(some.sum()) - most_apart(len(s), high) * comb(SECOND - 1, LEFT_OUT) - 1
        if spare < 0:
            out.append(sig)
        else:
            sig, least = sig[some], least[some]
            out.append(sig[np.lexsort((sig, -least))[spare:]])
    return np.concatenate(out)


def set_rows(docs, doc_id, text, fields, make):
    """``make(ids, sets)`` over the shingle sets of a frame, as a frame with ``fields``."""
    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for part in in_stretches(texts):
                yield make(ids[at:at + len(part)], shingle_sets(part))
                at += len(part)

    return src.mapInArrow(run, T.StructType(fields_of(fields)))


def of_documents(docs, ids, doc_id="doc_id"):
    """The documents whose id is in the stored frame ``ids`` (id).  A list of at most ``BROADCAST_ROWS`` ids, 8 bytes each, is
    sent to every executor; a longer one is joined by a shuffle."""
    return joined_by_id(docs, ids, doc_id, "left_semi")


def joined_by_id(docs, ids, doc_id, how):
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ids = ids.select(F.col("id").alias("__id"))
    return docs.join(F.broadcast(ids) if few else ids, F.col(doc_id) == F.col("__id"), how)


def standing(docs, real, reps, doc_id):
    """The documents whose id is in ``reps``.  Where those are too many to be sent, but the other ids of ``real`` are not, the others are taken out."""
    ids = reps.select("id")
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return of_documents(docs, ids, doc_id)
    copies = stored(real.select(F.col("doc_id").alias("id")).distinct().join(ids, "id", "left_anti"), "copies")
    if copies.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return of_documents(docs, ids, doc_id)
    return joined_by_id(docs.filter(F.col(doc_id).isNotNull()), copies, doc_id, "left_anti")


def signature_rows(docs, doc_id, text, often=None):
    def make(ids, sets):
        sigs, owners = [], []
        for i, s in zip(ids, sets):
            if len(s):
                sigs.append(signatures(s, often).view(np.int64))
                owners.append(np.full(len(sigs[-1]), i, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (sigs, owners)], ["sig", "id"])

    return set_rows(docs, doc_id, text, {"sig": "long", "id": "long"}, make)


def stars(rows):
    """For every signature that ids share: (rep, other) from the smallest of them to each other one, repeats in a batch left out.

    Each task reads its signatures in order, so it holds a batch and the last smallest id, however many ids share one.
    """
    fields = {"rep": "long", "other": "long"}

    def run(batches):
        last, rep = None, 0
        for batch in batches:
            sig, ids = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(sig):
                continue
            head = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            first = ids[head].copy()
            if last is not None and sig[0] == last:
                first[0] = rep
            reps = np.repeat(first, np.diff(np.append(head, len(sig))))
            last, rep = sig[-1], reps[-1]
            apart = ids != reps
            pairs = np.unique(np.stack([reps[apart], ids[apart]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], list(fields))

    ordered = rows.repartition("sig").sortWithinPartitions("sig", "id").select("sig", "id")
    return ordered.mapInArrow(run, T.StructType(fields_of(fields))).distinct()


def may_be_similar(a, b, na, nb):
    """Whether the sketches (bytes) and sizes leave room for the asked similarity; never false for a similar pair."""
    close = np.abs(a.astype(np.int16) - b.astype(np.int16)).sum(axis=-1, dtype=np.int64) * (DEN + NUM) <= (DEN - NUM) * (na + nb)
    return close & (np.minimum(na, nb) * DEN >= np.maximum(na, nb) * NUM)


def plausible(pairs, sketches, sketch):
    """The pairs (a, b) whose sketches (in the column ``sketch``) leave room for similarity."""
    one = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col(sketch).alias("sa"))
    two = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col(sketch).alias("sb"))
    wide = pairs.join(one, "a").join(two, "b").filter(f"least(na, nb) * {DEN} >= greatest(na, nb) * {NUM}")

    def run(batches):
        for batch in batches:
            c = [batch.column(k) for k in range(6)]
            ok = np.zeros(batch.num_rows, bool)
            for k, (na, nb, sa, sb) in enumerate(zip(*(x.to_pylist() for x in c[2:]))):
                x, y = np.frombuffer(sa, np.uint8), np.frombuffer(sb, np.uint8)
                bins = min(len(x), len(y))
                ok[k] = may_be_similar(folded(x, bins), folded(y, bins), na, nb)
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(ok)) for x in c[:2]], ["a", "b"])

    return wide.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, T.StructType(fields_of({"a": "long", "b": "long"})))


def near(pairs, sketches):
    """Plausible by the coarse sketch, and then by the finer one, which fewer pairs carry."""
    return plausible(stored(plausible(pairs, sketches, "sketch"), "coarse"), sketches, "fine")


def linked(pairs, docs, doc_id, text):
    """The pairs whose sets are similar, by counting their common elements.  Only sets of ids in a pair are built."""
    pairs = stored(pairs, "pairs")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")

    sets = stored(shingle_frame(docs, ids, doc_id, text), "sets")
    wide = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")

    def run(batches):
        for batch in slices(batches):
            out = {"a": [], "b": []}
            for a, b, sa, sb in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                common = common_of(x, y)
                if DEN * common >= NUM * (len(x) + len(y) - common):
                    out["a"].append(a)
                    out["b"].append(b)
            yield batch_of(out, {"a": "long", "b": "long"})

    return stored(wide.select("a", "b", "sa", "sb").mapInArrow(run, T.StructType(fields_of({"a": "long", "b": "long"}))), "links")


def components(links):
    """(id, comp) with the smallest id that links reach, for every id in a link.

    Alternates the published large-star and small-star steps: every id hands its smallest neighbour to its larger
    neighbours, then to its smaller ones, until each edge points to the smallest id.  Every round is stored.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.*").filter("u <> v").distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return stored(edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots), "components")


def least_reached(a, b, size):
    """The smallest index that each of ``size`` indices reaches over the edges (a, b)."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def open_pairs(comp, n, raw, own, both):
    """Plausible pairs (as positions) of different components: all of a chunk, or only those between its two chunks."""
    bins = np.array([len(r) for r in raw])
    _, back, counts = np.unique(comp, return_inverse=True, return_counts=True)
    # one side is never of the component with most members: two of its members are together already
    minor = back != counts.argmax()
    for level_a in np.unique(bins[minor]):
        for level_b in np.unique(bins):
            level = min(level_a, level_b)
            rows, columns = np.flatnonzero(minor & (bins == level_a)), np.flatnonzero(bins == level_b)
            x, y = (folded(np.frombuffer(b"".join(raw[k] for k in at), np.uint8).reshape(len(at), -1), level) for at in (rows, columns))
            step = max(1, (1 << 22) // (len(columns) * level))
            for at in range(0, len(rows), step):
                r = rows[at:at + step]
                ok = may_be_similar(x[at:at + step, None], y[None], n[r][:, None], n[columns][None]) & (comp[r][:, None] != comp[columns][None])
                if both:
                    ok &= own[r][:, None] != own[columns][None]
                u, v = np.nonzero(ok)
                yield r[u], columns[v]


def chunked(members, group, chunks):
    """``members`` with i, j and own: every pair of a group's chunks is a group of its own, and each member is in all of its chunk's."""
    dealt = members.join(chunks.select(group, "chunks"), group).withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.withColumns({"i": F.least("own", "mate"), "j": F.greatest("own", "mate")})


def crossing(star, comps, sketches):
    """Edges (a, b) that connect ids with a plausible pair in some star whose ids lie in different components.

    Ids that share a signature are in the star of its smallest id, so the pairs of each star are compared, once for all its
    signatures.  That happens inside a task, on sketches.  What leaves it is not the pairs, whose number grows with the
    square of a star, but for each id with a plausible partner one edge to the smallest id that such pairs lead to.
    """
    placed = star.join(comps.withColumnRenamed("id", "other"), "other", "left").select("rep", F.col("other").alias("id"), F.coalesce("comp", "other").alias("comp"))
    live = placed.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    members = chunked(placed, "rep", live.withColumn("chunks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")))
    wide = members.join(sketches.select("id", "n", "sketch"), "id").select("rep", "i", "j", "own", "id", "comp", "n", "sketch")

    def compare(group):
        n, comp, ids, own = (group.column(k).to_numpy(zero_copy_only=False) for k in ("n", "comp", "id", "own"))
        found = list(open_pairs(comp, n, group.column("sketch").to_pylist(), own, group["i"][0] != group["j"][0]))
        u, v = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = least_reached(place[u], place[v], len(ids))
        ids = ids[order]
        away = root != np.arange(len(ids))
        return pa.table({"a": pa.array(ids[root[away]], pa.int64()), "b": pa.array(ids[away], pa.int64())})

    return wide.groupBy("rep", "i", "j").applyInArrow(compare, T.StructType(fields_of({"a": "long", "b": "long"}))).distinct()


def shingle_frame(docs, ids, doc_id, text):
    """(id, set as bytes) of the documents in ``ids``; rows that share an id and a text once."""
    def make(own, sets):
        kept = [(i, s.tobytes()) for i, s in zip(own, sets) if len(s)]
        return batch_of({"id": [i for i, _ in kept], "set": [s for _, s in kept]}, {"id": "long", "set": "binary"})

    return set_rows(of_documents(docs, ids, doc_id), doc_id, text, {"id": "long", "set": "binary"}, make).distinct()


def common_of(x, y):
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def settle(edges, comps, docs, doc_id, text):
    """Links between components among ids that ``edges`` connect: exact, and none missing that would merge two components.

    The ids of a connected cluster meet with their sets, each once (a cluster of more than ``SET_BYTES`` is cut into chunks, and
    each pair of chunks is a group of its own).  In the task every plausible pair of two components is counted on the sets,
    unless links found before have merged them; so at most one link for each component leaves it.
    """
    clusters = components(edges)
    sets = stored(shingle_frame(docs, clusters.select("id"), doc_id, text), "sets")
    placed = clusters.withColumnRenamed("comp", "cluster").join(comps, "id", "left").select("cluster", "id", F.coalesce("comp", "id").alias("comp"))
    held = placed.join(sets.select("id", F.length("set").alias("bytes")), "id")
    chunks = held.groupBy("cluster").agg(F.ceil(F.sum("bytes") / SET_BYTES).cast("int").alias("chunks"))
    wide = chunked(placed, "cluster", chunks).join(sets, "id").select("cluster", "i", "j", "own", "id", "comp", "set")

    def count(group):
        comp, ids, own = (group.column(k).to_numpy(zero_copy_only=False) for k in ("comp", "id", "own"))
        sets_ = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
        n = np.array([len(x) for x in sets_])
        coarse = [sketch_of(x, bins_for(len(x), COARSE)).tobytes() for x in sets_]
        fine = [sketch_of(x, bins_for(len(x), FINE)) for x in sets_]
        heads = {c: c for c in comp.tolist()}

        def head(c):
            while heads[c] != c:
                heads[c] = heads[heads[c]]
                c = heads[c]
            return c

        a, b = [], []
        for us, vs in open_pairs(comp, n, coarse, own, group["i"][0] != group["j"][0]):
            for u, v in zip(us.tolist(), vs.tolist()):
                one, two = head(int(comp[u])), head(int(comp[v]))
                if one == two:
                    continue
                level = min(len(fine[u]), len(fine[v]))
                if not may_be_similar(folded(fine[u], level), folded(fine[v], level), n[u], n[v]):
                    continue
                common = common_of(sets_[u], sets_[v])
                if DEN * common >= NUM * (n[u] + n[v] - common):
                    heads[max(one, two)] = min(one, two)
                    a.append(min(ids[u], ids[v]))
                    b.append(max(ids[u], ids[v]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return stored(wide.groupBy("cluster", "i", "j").applyInArrow(count, T.StructType(fields_of({"a": "long", "b": "long"}))), "links")


def groups(docs, doc_id="doc_id", text="text"):
    """One row per document: id, size of its shingle set, and the smallest id that it reaches by links.

    1. Every text becomes a small profile (size, fingerprint, sketch); equal sets stand for each other from there on, by
       their smallest id.  The most frequent shingles are counted on the way.
    2. The signatures of those sets meet; each shared signature gives a star, not all pairs.
    3. Plausible pairs (by sketch, which errs only towards plausible) are counted exactly; links give components.
    4. Stars whose ids are still apart are compared in full, on sketches; ids with plausible partners meet with their sets,
       and every such pair that is still apart is counted as well.

    After that every two similar sets are in one component, and all links are real.  A document without words, or null, is
    alone; one without an id takes no part and has no component; rows that share an id count as one document with several
    texts; an empty table gives no rows.  Ids must be whole numbers.
    """
    told = stored(profile_rows(docs, doc_id, text), "profiles")
    narrow = told.filter("shingle is null").drop("shingle", "seen")
    real = narrow.filter("n > 0 and doc_id is not null")
    reps = stored(real.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id")), "reps")
    sketches = stored(real.join(reps.select("id", "f1", "f2", "n").withColumnsRenamed({"f1": "g1", "f2": "g2", "n": "m"}), F.col("doc_id") == F.col("id"), "inner").filter("f1 = g1 and f2 = g2 and n = m").select("id", "n", "sketch", "fine").distinct(), "sketches")
    star = stored(stars(signature_rows(standing(docs, real, reps, doc_id), doc_id, text, frequent(told))), "stars")
    links = linked(near(star.select(F.col("rep").alias("a"), F.col("other").alias("b")), sketches), docs, doc_id, text)
    comps = components(links)
    more = settle(stored(crossing(star, comps, sketches), "crossing"), comps, docs, doc_id, text)
    comps = components(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(more))
    named = reps.join(comps, "id", "left").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("m"), F.coalesce("comp", "id").alias("group_id"))
    same = (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("m")) & F.col("doc_id").isNotNull()
    return narrow.join(named, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("group_id", "doc_id").alias("component_id"))


def one_of_each(docs, doc_id="doc_id", text="text"):
    """The documents with one of every group: the row with the group's smallest id.

    Rows that repeat that id are copies in the same group, so one of them stays, the one whose columns hash smallest.  Documents without words or without an id all stay.
    """
    members = stored(groups(docs, doc_id, text), "groups")
    gone = stored(members.filter("component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct(), "gone")
    again = members.filter("n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    again = stored(again.join(gone, "id", "left_anti").select("id"), "again")
    kept = joined_by_id(docs, gone, doc_id, "left_anti")
    if not again.limit(1).count():
        return kept
    repeated = joined_by_id(kept, again, doc_id, "left_semi")
    has_words = F.coalesce(F.col(text).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # partial minima are merged, so no task holds the repeats of one id
    one = repeated.filter(has_words).groupBy(F.col(doc_id).alias("__id")).agg(F.min_by(whole, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row")).select("__row.*")
    return joined_by_id(kept, again, doc_id, "left_anti").unionByName(repeated.filter(~has_words)).unionByName(one)


