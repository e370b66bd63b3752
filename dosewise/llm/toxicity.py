"""Toxic spans by a linear-chain conditional random field; its marginals add up to document scores."""

import numpy as np
from pyspark.sql import functions as F

from .common import map_texts
from .hashing import WordHashes, fold_table, mark_table

# Parameters of the bounded training sample and of the fit.
TRAIN_ROWS = 2000
TRAIN_CHARS = 24_000_000
DIMS = 1 << 17
CHAIN = 64
EPOCHS = 6
LEAST_DOCS = 3
LIFT = 8.0
THRESHOLD = 0.3
HELD_OUT = 2

MARKS, FOLD = mark_table(), fold_table()
PREFIXES, SUFFIXES = (3, 4, 5), (4,)


def features(texts):
    """The words of the texts, and the hashed feature numbers of each word: itself, its prefixes and suffixes, and a bias."""
    words = WordHashes(texts, MARKS, FOLD, PREFIXES, SUFFIXES)
    columns = [words.hash, *words.extra]
    ids = np.empty((len(words.hash), len(columns) + 1), np.int32)
    for k, h in enumerate(columns):
        ids[:, k] = (h + np.uint64(k * 0xC2B2AE3D27D4EB4F % 2**64)) % np.uint64(DIMS - 1) + np.uint64(1)
    ids[:, -1] = 0
    return words, ids


class Chains:
    """One chain per text, laid out in stretches of ``CHAIN`` words as rows so that every step works on all of them.

    A stretch is a 2 x 2 matrix from the tag before it to the tag at its end; the matrices of a text, applied one after the other
    from both ends, give each stretch what the rest of the chain says, so the cuts change no marginal.
    """

    def __init__(self, words):
        self.place = np.arange(len(words.hash)) - words.first[:-1][words.text]
        new = self.place % CHAIN == 0
        self.row, self.col = np.cumsum(new) - 1, self.place % CHAIN
        self.n = int(new.sum())
        self.length = np.bincount(self.row, minlength=self.n)
        self.part = self.place[new] // CHAIN
        self.later = np.flatnonzero(self.part)
        order = np.argsort(self.part, kind="stable")
        cuts = np.searchsorted(self.part[order], np.arange(1, self.part.max(initial=0) + 2))
        self.waves = [order[i:j] for i, j in zip(cuts, cuts[1:])]

    def spread(self, values, fill):
        out = np.full((CHAIN, self.n), fill)
        out[self.col, self.row] = values
        return out

    def ends(self, e, trans):
        """Odds at the end of the stretch before each stretch, and what follows a stretch says of its last word."""
        enter, leave = np.ones(self.n), np.ones(self.n)
        if not self.waves:
            return enter, leave
        t00, t01, t10, t11 = np.exp(trans)
        rows = np.union1d(self.later, self.later - 1)
        e, length, first = e[:, rows], self.length[rows], self.part[rows] == 0
        m = np.stack([np.where(first, 1.0, t00), np.where(first, e[0], e[0] * t01), np.where(first, 1.0, t10), np.where(first, e[0], e[0] * t11)])
        for k in range(1, CHAIN):
            c, x = m[0::2], m[1::2]
            step = np.empty_like(m)
            step[0::2], step[1::2] = t00 * c + t10 * x, e[k] * (t01 * c + t11 * x)
            m = np.where(k < length, step, m)
            if k % 8 == 0:
                m /= m.sum(axis=0)
        m /= m.sum(axis=0)
        c0, x0, c1, x1 = full = np.ones((4, self.n))
        full[:, rows] = m
        state = x0 / c0
        for own in self.waves:
            r = enter[own] = state[own - 1]
            state[own] = (x0[own] + r * x1[own]) / (c0[own] + r * c1[own])
        for own in reversed(self.waves):
            r = leave[own]
            leave[own - 1] = (c1[own] + x1[own] * r) / (c0[own] + x0[own] * r)
        return enter, leave

    def marginals(self, emission, trans):
        """Odds of the toxic tag before and after each word, as ratios to the other tag; and the marginal of each word.

        ``trans`` holds the log weights (clean-clean, clean-toxic, toxic-clean, toxic-toxic).
        """
        t00, t01, t10, t11 = np.exp(trans)
        e = np.exp(np.clip(self.spread(emission, -30.0), -30, 30))
        enter, leave = self.ends(e, trans)
        ahead, back = np.empty_like(e), np.empty_like(e)
        ahead[0] = np.where(self.part > 0, e[0] * (t01 + enter * t11) / (t00 + enter * t10), e[0])
        for k in range(1, CHAIN):
            r = ahead[k - 1]
            ahead[k] = e[k] * (t01 + r * t11) / (t00 + r * t10)
        last = self.length - 1
        back[-1] = leave
        for k in range(CHAIN - 2, -1, -1):
            x = e[k + 1] * back[k + 1]
            back[k] = np.where(k < last, (t10 + t11 * x) / (t00 + t01 * x), leave)
        odds = (ahead * back)[self.col, self.row]
        return e, ahead, back, odds / (1.0 + odds)

    def neighbours(self, left, right):
        """The values of ``left`` and ``right`` at all pairs of neighbouring words, over the cuts too."""
        real = np.arange(1, CHAIN)[:, None] < self.length[None, :]
        return np.r_[left[:-1][real], left[-1, self.later - 1]], np.r_[right[1:][real], right[0, self.later]]

    def pairs(self, e, ahead, back, trans):
        """Expected counts of the four transitions."""
        t00, t01, t10, t11 = np.exp(trans)
        r, x = self.neighbours(ahead, e * back)
        cells = np.stack([np.full_like(r, t00), t01 * x, t10 * r, t11 * r * x])
        return (cells / cells.sum(axis=0)).sum(axis=1)


def token_tags(words, ids, toxic):
    """Labelled tokens from labelled texts: a word of a toxic text is tagged if one of its features marks toxic texts.

    A feature marks them if at least ``LEAST_DOCS`` toxic texts hold it, and ``LIFT`` times as large a share of the toxic
    texts as of the others.
    """
    counts = []
    for side in (1, 0):
        own = toxic[words.text] == side
        seen = [np.unique(words.text[own].astype(np.int64) * DIMS + ids[own, k]) % DIMS for k in range(ids.shape[1] - 1)]
        counts.append([np.bincount(s, minlength=DIMS) for s in seen])
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    tagged = np.zeros(len(words.hash), bool)
    for k, (c1, c0) in enumerate(zip(*counts)):
        marks = (c1 >= LEAST_DOCS) & ((c1 + 0.5) / (n1 + 1) >= LIFT * (c0 + 0.5) / (n0 + 1))
        tagged |= marks[ids[:, k]]
    return (tagged & (toxic[words.text] == 1)).astype(np.float64)


def fit_chain(texts, toxic, seed=5):
    """Weights and transitions that fit the labelled tokens: adaptive steps on the likelihood, in shuffled blocks of texts."""
    weights, squares = np.zeros(DIMS), np.full(DIMS, 1e-8)
    trans, trans_squares = np.zeros(4), np.full(4, 1e-8)
    words, ids = features(texts)
    tags = token_tags(words, ids, toxic)
    blocks = [range(i, min(i + 200, len(texts))) for i in range(0, len(texts), 200)]
    made = []
    for block in blocks:
        lo, hi = words.first[block.start], words.first[block.stop]
        if hi > lo:
            part = object.__new__(WordHashes)
            part.hash, part.text = words.hash[lo:hi], words.text[lo:hi] - block.start
            part.first = words.first[block.start:block.stop + 1] - lo
            made.append((Chains(part), ids[lo:hi], tags[lo:hi]))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for b in rng.permutation(len(made)):
            chains, own, y = made[b]
            e, ahead, back, p = chains.marginals(weights[own].sum(axis=1), trans)
            step = np.bincount(own.ravel(), np.repeat(p - y, own.shape[1]), DIMS) + 1e-3 * weights
            squares += step * step
            weights -= 0.3 * step / np.sqrt(squares)
            path = chains.spread(y, 0.0)
            before, after = chains.neighbours(path, path)
            seen = np.bincount((before * 2 + after).astype(int), minlength=4)
            t_step = chains.pairs(e, ahead, back, trans) - seen + 1e-3 * trans
            trans_squares += t_step * t_step
            trans -= 0.3 * t_step / np.sqrt(trans_squares)
    return weights.astype(np.float32), trans


def evidence(texts, weights, trans):
    """What the marginals say of each text: (words, marginals, number of words, highest log odds, expected toxic words)."""
    words, ids = features(texts)
    n = np.diff(words.first)
    top, total = np.full(words.n, -12.0), np.zeros(words.n)
    p = np.zeros(0)
    if len(ids):
        p = Chains(words).marginals(weights[ids].sum(axis=1, dtype=np.float64), trans)[3]
        safe = np.clip(p, 1e-9, 1 - 1e-9)
        at = words.first[:-1][n > 0]
        top[n > 0] = np.clip(np.log(np.maximum.reduceat(safe, at) / (1 - np.maximum.reduceat(safe, at))), -12, 12)
        total[n > 0] = np.add.reduceat(np.where(p > 0.05, p, 0.0), at)
    return words, p, n, top, total


def design(n, top, total):
    return np.stack([np.ones(len(n)), top, np.log1p(total), np.log(np.maximum(n, 30))], axis=1)


def fit_scale(x, y):
    """Logistic weights from evidence to labels: Newton steps with a ridge, to convergence."""
    w = np.zeros(x.shape[1])
    ridge = np.array([1e-6, 1e-2, 1e-2, 1e-2]) * max(1, len(y)) / 10
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge + 1e-9), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs, labels, doc_id="doc_id", text="text", label="toxic", train_rows=TRAIN_ROWS, train_chars=TRAIN_CHARS):
    """A model from a bounded sample of labelled rows, or the plain share of toxic labels where one class is missing.

    The sample: of the rows whose crc32(id as text) mod 4 is not 2, those with the smallest id hashes, at most
    ``train_rows`` of each class and ``train_chars`` characters in all (a text that would pass that is left out, later ones
    that fit are taken).  Two thirds of it fit the chain and the rest fits
    the scale from marginals to scores, so that the scale sees words as new as they are in other texts.
    """
    key = F.col(doc_id).cast("string")
    known = labels.filter((F.crc32(key.cast("binary")) % 4 != HELD_OUT) & F.col(label).isin(0, 1))
    known = known.groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("__toxic")).withColumn("__at", F.xxhash64(F.lit("train"), "__id"))
    present = known.join(docs.select(F.col(doc_id).alias("__id")).distinct(), "__id", "left_semi")
    chosen = [present.filter(F.col("__toxic") == side).orderBy("__at", "__id").limit(train_rows) for side in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    sample = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text")).join(F.broadcast(ids), "__id")
    rows, chars = [], 0
    for row in sample.groupBy("__id").agg(F.max("__text").alias("__text"), F.first("__toxic").alias("__toxic"), F.first("__at").alias("__at")).orderBy("__at", "__id").toLocalIterator():
        if chars + len(row["__text"] or "") > train_chars:
            continue
        chars += len(row["__text"] or "")
        rows.append((row["__text"] or "", int(row["__toxic"])))
    toxic = np.array([y for _, y in rows], np.int64)
    if len(set(toxic.tolist())) < 2:
        return {"share": float(toxic.mean()) if len(toxic) else 0.0}
    part = np.arange(len(rows)) % 3 == 2
    if len(set(toxic[part].tolist())) < 2 or len(set(toxic[~part].tolist())) < 2:
        part[:] = True
    texts = [t for t, _ in rows]
    fit = [t for t, other in zip(texts, part) if not other] or texts
    weights, trans = fit_chain(fit, toxic[~part] if not part.all() else toxic)
    scaled = [t for t, other in zip(texts, part) if other]
    return {"weights": weights, "trans": trans, "scale": fit_scale(design(*evidence(scaled, weights, trans)[2:]), toxic[part])}


FIELDS = {"score": "double", "predicted": "int", "spans": "strings"}


def score_texts(texts, model, threshold=THRESHOLD):
    """Scores, decisions and the spans of words whose toxic tag is likelier than not, as code point offsets "from-to"."""
    if "share" in model:
        return {"score": [model["share"]] * len(texts), "predicted": [int(model["share"] >= threshold)] * len(texts), "spans": [[] for _ in texts]}
    words, p, n, top, total = evidence(texts, model["weights"], model["trans"])
    score = 1 / (1 + np.exp(-np.clip(design(n, top, total) @ model["scale"], -30, 30)))
    spans = [[] for _ in texts]
    hit = np.flatnonzero(p > 0.5)
    if len(hit):
        breaks = np.flatnonzero((np.diff(hit) > 1) | (np.diff(words.text[hit]) > 0)) + 1
        for run in np.split(hit, breaks):
            t = int(words.text[run[0]])
            a, b = (int(x - words.offsets[t]) for x in (words.start[run[0]], words.stop[run[-1]]))
            begin = len(words.raw[t][:a].decode())
            spans[t].append(f"{begin}-{begin + len(words.raw[t][a:b].decode())}")
    return {"score": score.tolist(), "predicted": (score >= threshold).astype(int).tolist(), "spans": spans}


def in_slices(fn, texts, model, chars=1 << 21):
    """``fn`` over stretches of the texts of about ``chars`` characters, so that working memory does not follow the batch."""
    out, held, size = {k: [] for k in FIELDS}, [], 0

    def flush():
        for k, v in fn(held, model).items():
            out[k] += v

    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= chars:
            flush()
            held, size = [], 0
    if held:
        flush()
    return out


def score(docs, model, doc_id="doc_id", text="text", keep=None):
    """Every document's score, decision, toxic spans, and whether its label was held out of training.

    Only the text enters the score.  A null or empty text has no words and is scored like any other text without evidence;
    repeated rows get equal scores; an empty table gives no rows.
    """
    keep = [doc_id] if keep is None else keep
    held = (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT).alias("held_out")
    scored = map_texts(docs, text, keep, FIELDS, lambda texts: in_slices(score_texts, texts, model))
    return scored.select("*", F.coalesce(held, F.lit(False)).alias("held_out"))


def filter_documents(docs, labels, doc_id="doc_id", text="text"):
    """The documents not predicted toxic, with all their columns."""
    model = train(docs, labels, doc_id, text)
    names = [f"__{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    scored = map_texts(docs.toDF(*names), at[text], names, FIELDS, lambda texts: in_slices(score_texts, texts, model))
    return scored.filter("predicted = 0").select(*[F.col(n).alias(c) for c, n in at.items()])
