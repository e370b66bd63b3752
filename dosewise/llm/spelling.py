"""Spelling variants by pivotal grams: words one edit apart, grouped under the form that outweighs them.

Two bigrams of a word that share no character cannot both be touched by one inserted, deleted or replaced character.  Order
all bigrams by how many words hold them, rare ones first.  A word's *prefix* is its three rarest bigrams (and all that tie
with the third); its *pivots* are two disjoint ones of the prefix, chosen by dynamic programming to meet the fewest others.
Of two words one edit apart, let r be the one whose prefix ends earlier in that order: one of r's pivots is left whole, so it
stands in the other word, at a rank before the end of that word's prefix, hence in that prefix.  Its position is limited too:
the edit lies on one side of it, and everything from the pivot to the other end of the word is the same in both.  So the
join key is that common end of the word (pivot included) with the length that the other word has; what meets there is verified.
"""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import batch_of, fields_of, slices

# Fixed values of the word definition: letters A-Z and Latin-1 letters with the signs between them.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
CHUNK = 1 << 20
HELD_WORDS = 200_000


def runs(text):
    """Maximal runs of letters with A-Z lower-cased, and their counts, from a text read in parts."""
    found, at = Counter(), 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and RUN.match(text, end):  # a run is not cut
            end = RUN.match(text, end).end()
        # lower-casing bytes touches A-Z alone
        part = text[at:end].encode("utf-8", "replace").lower().decode()
        found.update(RUN.findall(part))
        at = end
    return found


def word_counts(docs, key="doc_id", text="text", one_in=199, least_length=6, least_count=5):
    """Words of all whole texts with their number of occurrences: ``word``, ``n``.

    Where ``one_in`` divides the crc32 of "key:run", the run lost one character before it was counted (the place is the crc32
    modulo its length); None counts the runs as they are.  A null key reads as nothing, a null text has no runs.  Only
    words of ``least_length`` characters and ``least_count`` occurrences are kept.
    """
    src = docs.select(F.col(key).cast("string").alias("__key"), F.col(text).cast("string").alias("__text"))
    fields = {"word": "string", "n": "long"}

    def held(counts):
        return batch_of({"word": list(counts), "n": list(counts.values())}, fields)

    def count(batches):
        counts = Counter()
        for batch in slices(batches):
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seed = zlib.crc32(f"{doc or ''}:".encode())
                for word, n in runs(body or "").items():
                    if one_in:
                        h = zlib.crc32(word.encode(), seed)
                        if h % one_in == 0:
                            cut = h % len(word)
                            word = word[:cut] + word[cut + 1:]
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) >= HELD_WORDS:
                    yield held(counts)
                    counts = Counter()
        yield held(counts)

    total = src.mapInArrow(count, T.StructType(fields_of(fields))).groupBy("word").agg(F.sum("n").alias("n"))
    return total.where(F.col("n") >= least_count)


def gram_classes(word):
    """Number of each bigram: the low bytes of its two characters, so the numbers stay below 65,536 in any alphabet."""
    code = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.int64) & 0xFF
    return (code[:-1] << 8) | code[1:]


def gram_order(words, word="word"):
    """How many bigrams of each class the words hold: one array of 65,536 numbers, whatever the number of words."""
    fields = {"gram": "int", "n": "long"}

    def count(batches):
        total = np.zeros(65536, np.int64)
        for batch in slices(batches, 4096):
            grams = [gram_classes(w) for w in batch.column(0).to_pylist()]
            if grams:
                total += np.bincount(np.concatenate(grams), minlength=65536)
        seen = np.flatnonzero(total)
        yield batch_of({"gram": seen.tolist(), "n": total[seen].tolist()}, fields)

    rows = words.select(word).mapInArrow(count, T.StructType(fields_of(fields))).groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(65536, np.int64)
    for row in rows:
        counts[row["gram"]] = row["n"]
    return counts


def prefix_and_pivots(word, counts, ranks):
    """(rank where the prefix ends, positions of the prefix bigrams, positions of the two pivots)."""
    grams = gram_classes(word)
    order = ranks[grams]
    last = int(np.sort(order)[2])
    at = np.flatnonzero(order <= last)
    # What a pivot meets: its words, thinned out by every further character of the shorter common end.
    shared = np.minimum(at + 2, len(word) - at)
    cost = counts[grams[at]] * 0.25 ** (shared - 2.0)
    # Two disjoint ones of least cost: the best single one among those that end before each.
    best, pivots, one, k = math.inf, None, (math.inf, -1), 0
    for i, p in enumerate(at.tolist()):
        while at[k] <= p - 2:
            one = min(one, (float(cost[k]), int(at[k])))
            k += 1
        if one[1] >= 0 and one[0] + cost[i] < best:
            best, pivots = one[0] + float(cost[i]), [one[1], p]
    return last, at.tolist(), pivots


def near_pairs(words, word="word"):
    """All pairs of different words one edit apart, each once: ``a`` < ``b``.  Words have four characters or more, each once."""
    counts = gram_order(words, word)
    # equal counts are told apart by the class, so that a rank is one class
    ranks = np.empty(65536, np.int64)
    ranks[np.lexsort((np.arange(65536), counts))] = np.arange(65536)
    fields = {"w": "string", "last": "int", "prefix": "ints", "pivots": "ints"}

    def choose(batches):
        for batch in slices(batches, 4096):
            held = batch.column(0).to_pylist()
            made = [prefix_and_pivots(w, counts, ranks) for w in held]
            last, prefix, pivots = zip(*made) if made else ((), (), ())
            yield batch_of({"w": held, "last": last, "prefix": prefix, "pivots": pivots}, fields)

    chosen = stored(words.select(word).mapInArrow(choose, T.StructType(fields_of(fields))), "grams")

    def key(side, end, length):
        return F.xxhash64(F.lit(side), end, length)

    def keys(positions, lengths):
        p, w = F.col("p"), F.col("w")
        head, tail = F.substring(w, F.lit(1), p + 2), F.substring(w, p + 1, F.length(w) - p)
        each = [key(side, end, F.length(w) + d) for side, end in (("head", head), ("tail", tail)) for d in lengths]
        rows = chosen.select("w", "last", F.explode(positions).alias("p"))
        return rows.select("w", "last", F.explode(F.array_distinct(F.array(*each))).alias("key"))

    pivot = keys("pivots", (-1, 0, 1)).select("key", F.col("w").alias("r"), F.col("last").alias("r_last"))
    prefix = keys("prefix", (0,)).select("key", F.col("w").alias("s"), F.col("last").alias("s_last"))
    met = pivot.join(prefix, "key").where((F.col("r_last") <= F.col("s_last")) & (F.levenshtein("r", "s", 1) == 1))
    return met.select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")).distinct()


def with_roots(forms, word, form, rounds):
    """``root`` of every word with a form: pointers doubled until none moves; each round is written, so lineage stays short."""
    cur = stored(forms.select(F.col(word).alias("w"), F.col(form).alias("root")), "roots")
    for _ in range(rounds):
        ahead = cur.select(F.col("w").alias("root"), F.col("root").alias("__far"))
        cur = stored(cur.join(ahead, "root", "left").select("w", F.coalesce("__far", "root").alias("root")), "roots")
    return cur


def group_variants(words, word="word", n="n", ratio=5):
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every word of a table of words and counts.

    Two words are near if exactly one inserted, deleted or replaced character tells them apart.  A word's form is its near
    word of largest count (ties: the smallest), if that count is at least ``ratio`` times its own; following forms, the last
    is the root (the word itself where there is none).  Counts grow along that way, so it ends, after at most
    log(largest / smallest count) / log(ratio) steps.  Repeated words are added up, null counts as 0; null words and words of fewer than four
    characters are left out, because they have no two disjoint bigrams.  Other columns are not read.
    """
    if ratio <= 1:
        raise ValueError("a form must outweigh its variants")
    clean = words.select(F.col(word).cast("string").alias("word"), F.coalesce(F.col(n).cast("long"), F.lit(0)).alias("n")).where(F.length("word") >= 4)
    clean = stored(clean.groupBy("word").agg(F.sum("n").alias("n")), "words")
    pairs = near_pairs(clean)
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = clean.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    near = links.join(other, "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("best"))
    seen = clean.join(near.withColumnRenamed("a", "word"), "word", "left")
    best_n = -F.col("best.less")
    outweighs = best_n >= F.col("n") * F.lit(ratio)
    seen = seen.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(outweighs, F.col("best.b")).alias("form"), F.when(outweighs, best_n).alias("form_n"))
    seen = stored(seen, "variants")
    most, least = clean.agg(F.max("n"), F.min("n")).first()
    steps = math.log(most / max(1, least)) / math.log(ratio) if most and most > 1 else 0
    roots = with_roots(seen.where(F.col("form").isNotNull()), "word", "form", math.ceil(math.log2(steps + 1)))
    out = seen.join(roots.withColumnRenamed("w", "word"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
