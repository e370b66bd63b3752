"""Byte-level BPE: texts to token ids and back to bytes, with a rank file that every executor has locally."""

import base64
import functools
import hashlib

import public_tokenizers
import regex
import tiktoken
from pyspark.sql import functions as F

from .common import ARROW, map_texts

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECE_CHARS = 65536
LEAST_LONG = 16384

# The characters that the pattern takes for white space (the Unicode property, not Python's str.isspace).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# A place between a character that is no white space and one that is.  No match of the pattern runs across it: only its
# white-space alternatives contain white space after their first character, and those contain nothing else.  Its only
# look-around looks forward from inside white space, so a piece that ends before white space is matched as in the whole.
SAFE_CUT = regex.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])")

# White space that the matcher would walk through with a stack that grows with it.
LONG_BLANK = regex.compile(rf"[{SPACE}]{{{LEAST_LONG},}}+")


@functools.lru_cache(maxsize=4)
def encoding(ranks_path, pattern):
    """The tokenizer of a rank file (a base64 token and its rank in each line); loaded once in each Python worker."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text, size=PIECE_CHARS):
    """``text`` in pieces of about ``size`` characters, cut only where no token can lie across the cut.

    A stretch without white space longer than ``size`` stays in one piece, so the ids never depend on the cuts.
    """
    start = 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if not cut:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encoded_parts(enc, text):
    """Lists of ids that follow each other, from parts of the text no match of the pattern lies across.

    Of a run of white space before a word the pattern takes all but the last character as one match, and at the end of the
    text all of it; a long run is therefore merged as one piece by the library, without its matcher.
    """
    at = 0
    for blank in LONG_BLANK.finditer(text):
        start, end = blank.span()
        end -= end < len(text)
        for piece in pieces(text[at:start]):
            yield enc.encode_ordinary(piece)
        yield enc._encode_single_piece(text[start:end])
        at = end
    for piece in pieces(text[at:]):
        yield enc.encode_ordinary(piece)


def encode_one(enc, text):
    if len(text) <= LEAST_LONG:
        return enc.encode_ordinary(text)
    return [i for part in encoded_parts(enc, text) for i in part]


def encode(docs, text="text", keep=("doc_id",), ids="ids", ranks_path=None, pattern=public_tokenizers.PATTERN):
    """Token ids of every whole text as an array column; a null or empty text has no ids."""
    path = ranks_path or public_tokenizers.path(RANKS)

    def run(texts):
        enc = encoding(path, pattern)
        return {ids: [encode_one(enc, t or "") for t in texts]}

    return map_texts(docs, text, list(keep), {ids: "ints"}, run)


def decode(df, ids="ids", out="decoded", ranks_path=None, pattern=public_tokenizers.PATTERN):
    """Raw bytes of every id array (null: null); bytes, because ids may end inside a character."""
    path = ranks_path or public_tokenizers.path(RANKS)

    @F.pandas_udf(ARROW["binary"][0])
    def to_bytes(column):
        enc = encoding(path, pattern)
        return column.map(lambda x: None if x is None else enc.decode_bytes(x.tolist()))

    return df.withColumn(out, to_bytes(F.col(ids)))


def round_trip(docs, text="text", keep=("doc_id",), ranks_path=None, pattern=public_tokenizers.PATTERN):
    """Number of ids, and digests of the ids and of the bytes decoded from them, for every whole text.

    A null text counts as empty: no ids, and both digests are those of nothing.  Repeated rows each give a row; all
    columns but ``keep`` and the text are left out.
    """
    path = ranks_path or public_tokenizers.path(RANKS)
    fields = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}

    def run(texts):
        enc = encoding(path, pattern)
        names = [str(i) for i in range(enc.n_vocab)]
        out = {name: [] for name in fields}
        for t in texts:
            ids = encode_one(enc, t or "")
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
        return out

    return map_texts(docs, text, list(keep), fields, run)
