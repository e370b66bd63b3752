"""Documents packed into token windows: bounded-space best fit inside each partition, leftovers merged over partitions.

A partition keeps a fixed number of open windows.  A document goes whole into the open window it fills best; windows that
come full leave at once.  Where no window takes it, the fullest one leaves, filled up with the head of the document if both
parts of that cut are worth a piece.  What is still open at the end of a partition (at most ``open_windows`` windows) is
packed again together with that of other partitions, over fewer and fewer groups, so no task ever sees more than
``fan_in`` times the open windows, whatever the corpus holds.
"""

import bisect
import functools
import json
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .bpe import encoded_parts
from .common import fields_of, slices

VOCABULARY = "byte_bpe_50k.json"
END = 1
PIECE = {"start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "sequence_id": "long", "offset": "long"}
OUT_ROWS = 8192


def byte_of_letter():
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def encoder(path):
    """Text -> lists of ids by the vocabulary file of the ``tokenizers`` library; loaded once in each Python worker.

    A byte-level BPE whose merges stand in the order of their ids has the ids of a rank file, so the faster library gives
    the same ids; any other file is left to ``tokenizers`` itself.  No text is taken for a special token.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    vocab, merges = model.get("vocab"), model.get("merges") or []
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "unk_token"))
    level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec["normalizer"] is None
    if plain and level:
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        letter = byte_of_letter()
        in_order = all(vocab[m] == 256 + k for k, m in enumerate(made)) and len(vocab) == 256 + len(made)
        if in_order and all(vocab.get(c, 256) < 256 for c in letter):
            ranks = {bytes(letter[c] for c in token): i for token, i in vocab.items()}
            enc = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            return lambda text: encoded_parts(enc, text)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda text: iter([tok.encode(text, add_special_tokens=False).ids])


def token_ids(encode, text, end=END):
    """Ids of a whole text and the end id, as 32-bit numbers; a null text counts as empty."""
    parts = [np.array(part, dtype="<u4") for part in encode(text or "")]
    return np.concatenate([*parts, np.array([end], dtype="<u4")])


class Packer:
    """Open windows of one partition; ``closed`` collects (doc, start, ids, doc_tokens, sequence number, offset)."""

    def __init__(self, window, open_windows, least_cut):
        self.window, self.most, self.least_cut = window, open_windows, least_cut
        self.gaps, self.windows = [], []  # ascending free room, and the pieces of that window
        self.closed, self.sequences = [], 0

    def emit(self, pieces):
        at = 0
        for doc, start, ids, total in pieces:
            self.closed.append((doc, start, ids, total, self.sequences, at))
            at += len(ids)
        self.sequences += 1

    def put(self, gap, pieces):
        if gap == 0:
            self.emit(pieces)
            return
        k = bisect.bisect_left(self.gaps, gap)
        self.gaps.insert(k, gap)
        self.windows.insert(k, pieces)

    def take(self, k):
        return self.gaps.pop(k), self.windows.pop(k)

    def add(self, doc, start, ids, total):
        at = 0
        while len(ids) - at >= self.window:
            self.emit([(doc, start + at, ids[at:at + self.window], total)])
            at += self.window
        left = len(ids) - at
        if not left:
            return
        if not self.gaps or left > self.gaps[-1]:
            if len(self.gaps) == self.most:
                gap, pieces = self.take(0)
                if gap >= self.least_cut and left - gap >= self.least_cut:
                    pieces.append((doc, start + at, ids[at:at + gap], total))
                    at, left = at + gap, left - gap
                self.emit(pieces)
            gap, pieces = self.window, []
            k = bisect.bisect_left(self.gaps, left)
            if k < len(self.gaps):  # what the cut left may fit
                gap, pieces = self.take(k)
        else:
            gap, pieces = self.take(bisect.bisect_left(self.gaps, left))
        # a copy, so that an open window holds its own ids and not those of a whole long document
        pieces.append((doc, start + at, ids[at:].copy(), total))
        self.put(gap - left, pieces)

    def leftovers(self):
        return [piece for pieces in self.windows for piece in pieces]

    def finish(self):
        """End of the corpus: what is open is laid end to end in full windows, the rest in windows of powers of two."""
        pieces = self.leftovers()
        self.gaps, self.windows = [], []
        total = sum(len(p[2]) for p in pieces)
        bounds = [self.window] * (total // self.window) + [1 << b for b in reversed(range(self.window.bit_length())) if total % self.window >> b & 1]
        room, now = (bounds.pop(0) if bounds else 0), []
        for doc, start, ids, n in pieces:
            at = 0
            while at < len(ids):
                cut = ids[at:at + room]
                now.append((doc, start + at, cut, n))
                at, room = at + len(cut), room - len(cut)
                if not room:
                    self.emit(now)
                    room, now = (bounds.pop(0) if bounds else 0), []


def sequence_id(turn, part, k):
    """A number no other window of the corpus has: the merging round, the partition, and a count there."""
    return (turn << 58) | (part << 34) | k


def rows_of(closed, turn, part, key_type, with_ids):
    docs, starts, ids, totals, seqs, offsets = zip(*closed) if closed else ((),) * 6
    raw = [x.tobytes() for x in ids]
    arrays = [
        pa.array(docs, key_type), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(map(zlib.crc32, raw), pa.int64()),
        pa.array(totals, pa.int64()), pa.array([sequence_id(turn, part, k) for k in seqs], pa.int64()), pa.array(offsets, pa.int64()),
        pa.array([part] * len(docs), pa.int64()), pa.array(raw if with_ids else [None] * len(docs), pa.binary()),
    ]
    return arrays


def open_rows(pieces, part, key_type):
    docs, starts, ids, totals = zip(*pieces) if pieces else ((),) * 4
    n = len(docs)
    none = pa.nulls(n, pa.int64())
    return [
        pa.array(docs, key_type), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), none, pa.array(totals, pa.int64()), none, none,
        pa.array([part] * n, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()),
    ]


def pack(docs, key="doc_id", text="text", window=2048, open_windows=32, least_cut=16, fan_in=64, vocabulary=None, end=END, with_ids=False):
    """Pieces of all documents in sequences of at most ``window`` ids.

    One row per piece: the key, ``start`` and ``length`` in its document, ``ids_crc32`` of the ids as little-endian 32-bit
    numbers, ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence, and with ``with_ids`` the ids themselves (binary).
    Every id of a document, the end id included, lies in exactly one piece; a null or empty text is its end id alone.
    Rows are packed one by one, so repeated keys and null keys are documents of their own.  Windows leave with at most
    ``least_cut - 1`` free places, or more only where the next document left no piece of that length; the last ones of the
    corpus have lengths of powers of two and need none.  Other columns are not read; an empty table has no pieces.
    """
    if key in PIECE or window < 2 or window & (window - 1):
        raise ValueError("the key must not be named like a result column, and the window is a power of two")
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    src = docs.select(F.col(key), F.col(text).cast("string").alias("__text"), F.spark_partition_id().alias("__part"))
    schema = T.StructType([src.schema[key], *fields_of(PIECE), T.StructField("__part", T.LongType()), T.StructField("__ids", T.BinaryType())])
    names = schema.names

    def first(batches):
        encode, packer, part, key_type = encoder(path), Packer(window, open_windows, least_cut), None, None
        for batch in slices(batches):
            key_type = batch.schema.field(0).type
            for doc, body, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = token_ids(encode, body, end)
                packer.add(doc, 0, ids, len(ids))
                if len(packer.closed) >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays(rows_of(packer.closed, 0, part, key_type, with_ids), names)
                    packer.closed = []
        if part is not None:
            yield pa.RecordBatch.from_arrays(rows_of(packer.closed, 0, part, key_type, with_ids), names)
            yield pa.RecordBatch.from_arrays(open_rows(packer.leftovers(), part, key_type), names)

    def merged(turn, last):
        def run(group, table):
            part, key_type = group[0].as_py(), table.schema.field(key).type
            packer = Packer(window, open_windows, least_cut)
            docs_, starts, totals, raw = (table.column(c).to_pylist() for c in (key, "start", "doc_tokens", "__ids"))
            pieces = [(d, s, np.frombuffer(b, dtype="<u4"), t) for d, s, t, b in zip(docs_, starts, totals, raw)]
            # longest first; the crc makes the order the same in every run
            for piece in sorted(pieces, key=lambda p: (-len(p[2]), p[0] is None, p[0], p[1], zlib.crc32(p[2]))):
                packer.add(*piece)
            if last:
                packer.finish()
            columns = rows_of(packer.closed, turn, part, key_type, with_ids)
            still = open_rows(packer.leftovers(), part, key_type)
            return pa.Table.from_arrays([pa.chunked_array([a, b]) for a, b in zip(columns, still)], names)
        return run

    done = stored(src.mapInArrow(first, schema), "packed")
    results, left = [done], done.where(F.col("sequence_id").isNull())
    parts = (left.agg(F.max("__part")).first()[0] or 0) + 1
    turn = 0
    while parts:
        turn += 1
        parts = math.ceil(parts / fan_in)
        again = left.withColumn("__part", F.floor(F.col("__part") / fan_in)).groupBy("__part").applyInArrow(merged(turn, parts == 1), schema)
        again = stored(again, "packed")
        results.append(again)
        left = again.where(F.col("sequence_id").isNull())
        if parts == 1:
            break
    pieces = functools.reduce(lambda a, b: a.unionAll(b), results).where(F.col("sequence_id").isNotNull())
    return pieces.select(key, *PIECE, *([F.col("__ids").alias("ids")] if with_ids else []))
