"""Quality rules with thresholds taken from the corpus: quantile sketches per language and source, then a joined filter.

The sketch of a group is its counts by logarithmic bins (relative error at most ``ALPHA``); two sketches merge by adding
counts, so they are built by one partial aggregate and merged again for coarser groups.
"""

import math
from functools import reduce

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import stored
from .common import map_texts

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
ALPHA = 0.01
FENCE = 3.0
GROUP_ROWS = 200

# Each share that is judged, the least spread its fence is given, and whether small values are judged too.
SHARES = {
    "symbol_share": (0.01, False),
    "dup_line_share": (0.15, False),
    "repeat_share": (0.1, False),
    "upper_share": (0.04, False),
    "word_length": (0.5, True),
}
STATS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_lines": "long", "n_upper": "long"}
UPPER = bytes(range(65, 91))
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def repeated_words(words):
    """Words inside a window of three that occurs twice or more."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = (h[:-2] * MIX[0] + h[1:-1]) * MIX[1] + h[2:]
    order = np.sort(window)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, back, counts = np.unique(window, return_inverse=True, return_counts=True)
    twice = counts[back] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:len(words) - 2 + k] |= twice
    return int(covered.sum())


def duplicate_lines(text):
    """Lines with a word, and those of them that equal an earlier one."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines), len(lines) - len(set(lines))


def text_stats(texts):
    out = {name: [] for name in STATS}
    for t in texts:
        t = t or ""
        raw = t.encode()
        words = raw.split()
        n_lines, n_dup = duplicate_lines(t)
        out["n_words"].append(len(words))
        out["word_chars"].append(len(t) - sum(map(t.count, SPACES)))
        out["n_symbols"].append(sum(map(t.count, SYMBOLS)))
        out["n_dup_lines"].append(n_dup)
        out["n_repeat_words"].append(repeated_words(words))
        out["n_lines"].append(n_lines)
        out["n_upper"].append(len(raw) - len(raw.translate(None, UPPER)))
    return out


def with_shares(stats):
    def share(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return stats.withColumns({
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "word_length": share("word_chars", "n_words"),
    })


def sketch(shares, groups):
    """Bin counts of every share for each group: the mergeable sketch, one row for each bin in use."""
    bins = [
        F.struct(F.lit(s).alias("share"), F.when(F.col(s) > 1e-9, F.ceil(F.ln(F.col(s)) / F.lit(math.log((1 + ALPHA) / (1 - ALPHA))))).cast("int").alias("bin"))
        for s in SHARES
    ]
    return shares.select(*groups, F.explode(F.array(*bins)).alias("b")).select(*groups, "b.*").groupBy(*groups, "share", "bin").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketches, groups, at):
    """The value at each of the ranks ``at`` and the row count, for each group and share.  A null bin holds the zeros."""
    gamma = (1 + ALPHA) / (1 - ALPHA)
    keys = [*groups, "share"]
    run = Window.partitionBy(*keys).orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.coalesce(2.0 * F.pow(F.lit(gamma), F.col("bin")) / F.lit(gamma + 1), F.lit(0.0))
    cum = sketches.withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(Window.partitionBy(*keys)), "value": value})
    picks = [F.min(F.when(F.col("upto") >= F.lit(q) * F.col("all"), F.col("value"))).alias(name) for name, q in at.items()]
    return cum.groupBy(*keys).agg(F.max("all").alias("rows"), *picks)


def thresholds(sketches, fence=FENCE, group_rows=GROUP_ROWS):
    """Limits of every share for each (language, source).

    The limit is the quartile plus ``fence`` quartile distances, of at least the spread in ``SHARES``.  A group of fewer
    than ``group_rows`` documents takes its language's limits (merged sketches), and a smaller language those of all.
    """
    levels = [["lang", "source"], ["lang"], []]
    rows = None
    for k, groups in enumerate(levels):
        merged = sketches.groupBy(*groups, "share", "bin").agg(F.sum("n").alias("n"))
        q = quantiles(merged, groups, {"q1": 0.25, "q3": 0.75}).select(*groups, "share", *[F.col(c).alias(f"{c}_{k}") for c in ("rows", "q1", "q3")])
        if rows is None:
            rows = q
            continue
        q = q.select(*[F.col(g).alias(f"__{g}") for g in groups], F.col("share").alias("__share"), *[f"{c}_{k}" for c in ("rows", "q1", "q3")])
        same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups], F.col("share") == F.col("__share"))
        rows = rows.join(q, same, "left").drop("__share", *[f"__{g}" for g in groups])

    def pick(c):
        return F.when(F.col("rows_0") >= group_rows, F.col(f"{c}_0")).when(F.col("rows_1") >= group_rows, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))

    least = reduce(lambda col, s: col.when(F.col("share") == s, SHARES[s][0]), SHARES, F.when(F.lit(False), 0.0))
    low = F.col("share").isin([s for s, (_, both) in SHARES.items() if both])
    spread = F.lit(float(fence)) * F.greatest(pick("q3") - pick("q1"), least)
    limits = rows.select("lang", "source", "share", (pick("q3") + spread).alias("most"), F.when(low, pick("q1") - spread).alias("least"))
    wide = limits.groupBy("lang", "source").pivot("share", list(SHARES)).agg(F.first("most").alias("most"), F.first("least").alias("least"))
    return wide.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[F.col(f"{s}_{side}").alias(f"{s}_{side}") for s in SHARES for side in ("most", "least")])


def verdict(stats, limits):
    """``base_failed`` and ``kept`` beside the columns of ``stats`` (which hold lang and source)."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    beyond = reduce(lambda a, b: a | b, [
        F.coalesce(F.col(s) > F.col(f"{s}_most"), F.lit(False)) | F.coalesce(F.col(s) < F.col(f"{s}_least"), F.lit(False)) for s in SHARES
    ])
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    return stats.join(limits, same, "left").select(*stats.columns, failed.alias("base_failed"), (~failed & ~beyond).alias("kept"))


def judge(docs, doc_id="doc_id", text="text", lang="lang", source="source", fence=FENCE, group_rows=GROUP_ROWS):
    """One row per document: its counts, shares, ``base_failed`` and ``kept``.

    The texts are read once; the counts are stored, sketched, and joined with the limits of their group.  ``base_failed``:
    under 50 words, or more than half of them in repeated windows; such a document is not kept.  Any other is kept unless
    a share passes its group's limit.  A null text has no words; null languages and sources are groups of their own;
    repeated rows each get a row; an empty table gives none; columns beside these four are left out.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    stats = stored(with_shares(map_texts(src, "text", ["doc_id", "lang", "source"], STATS, text_stats)), "quality")
    return verdict(stats, stored(thresholds(sketch(stats, ["lang", "source"]), fence, group_rows), "limits"))


def filter_documents(docs, text="text", lang="lang", source="source", fence=FENCE, group_rows=GROUP_ROWS):
    """The documents that the rules keep, with all their columns.

    Two passes over the texts: one stores the counts for the limits, one takes the counts again beside the document, so
    that no text is shuffled for its verdict.
    """
    names = [f"__{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c: names[docs.columns.index(c)] for c in (text, lang, source)}
    tagged = plain.withColumns({"lang": F.col(at[lang]), "source": F.col(at[source])})
    stats = stored(with_shares(map_texts(tagged, at[text], ["lang", "source"], STATS, text_stats)), "quality")
    limits = stored(thresholds(sketch(stats, ["lang", "source"]), fence, group_rows), "limits")
    beside = with_shares(map_texts(tagged, at[text], tagged.columns, STATS, text_stats))
    return verdict(beside, limits).filter("kept").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
