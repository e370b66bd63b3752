"""Word hashes of many texts at once, with whole-array arithmetic."""

import numpy as np

SLICE_BYTES = 1 << 21
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers = {}


def fold_table(lower=True):
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    return table


def space_table():
    """True for the white space that ends a word: blank, and 0x09 to 0x0D."""
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def mark_table():
    """True for every character below 0x80 that is no letter or digit."""
    table = np.zeros(256, bool)
    table[:128] = [not chr(c).isalnum() for c in range(128)]
    return table


def mix(x):
    """A bijection of 64-bit words that spreads every bit (constants of the published splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n):
    """BASE**i and BASE**-i modulo 2**64 for i below ``n`` or more; kept between calls."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


class WordHashes:
    """Hash, byte offsets and text number of every word of ``texts`` (null: no words), in order.

    ``hash`` is 64 bits of the folded bytes and depends on nothing else.  ``prefixes`` asks for hashes of the first k bytes
    as well, ``suffixes`` for the last k.  The texts are worked through in slices that end between words, so one very long
    text needs no more working memory than many short ones.
    """

    def __init__(self, texts, ends, fold, prefixes=(), suffixes=()):
        raw = [(t or "").encode() for t in texts]
        self.raw = raw
        self.n = len(raw)
        joined = b"\n".join(raw) + b"\n"
        self.offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
        data = np.frombuffer(joined, np.uint8)
        starts, stops, hashes, more = [], [], [], []
        at = 0
        while at < len(data):
            stop = min(at + SLICE_BYTES, len(data))
            while stop < len(data) and not ends[data[stop - 1]]:
                stop += 1
            a, b, h, extra = self.slice(data[at:stop], ends, fold, prefixes, suffixes)
            starts.append(a + at)
            stops.append(b + at)
            hashes.append(h)
            more.append(extra)
            at = stop
        self.start, self.stop, self.hash = (np.concatenate(x) for x in (starts, stops, hashes))
        self.extra = [np.concatenate(x) for x in zip(*more)]
        # words of text i are those from first[i] to first[i + 1]
        self.first = np.searchsorted(self.start, self.offsets)
        self.text = np.repeat(np.arange(self.n), np.diff(self.first))

    @staticmethod
    def slice(data, ends, fold, prefixes, suffixes):
        up, down = powers(len(data) + 1)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~ends[data]
        step = np.diff(inside)
        start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])

        def of(a, b):
            return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))

        extra = [of(start, np.minimum(start + k, stop)) for k in prefixes] + [of(np.maximum(stop - k, start), stop) for k in suffixes]
        return start, stop, of(start, stop), extra
