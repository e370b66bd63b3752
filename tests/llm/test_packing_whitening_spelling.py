"""Window packing, whitening by spectrum slicing, and spelling variants, against brute-force versions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from dosewise.llm import bpe, packing, queries, spectrum, spelling, whitening

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, start string, word string, n string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in texts], DOC)


# --- white space in byte-level BPE -----------------------------------------------------------------------------------

def plain_ids(enc, text):
    """Matches of the pattern one after the other, each merged on its own; no long run goes through the library's matcher."""
    import regex

    return [i for m in regex.finditer(public_tokenizers.PATTERN.replace(r"\s", f"[{bpe.SPACE}]").replace(r"\S", f"[^{bpe.SPACE}]").replace(f"[^[{bpe.SPACE}]", f"[^{bpe.SPACE}"), text)
            for i in enc._encode_single_piece(m[0])]


@pytest.mark.parametrize("blank", [" " * 2_000_000, "\t" * 2_000_000, "\n" * 2_000_000, " \n\t　" * 500_000])
def test_long_white_space(blank):
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    for text in (blank, blank + "word, 12", "word" + blank, "a b" + blank + "cd", "!" + blank + "!" + blank + "x"):
        parts = list(bpe.encoded_parts(enc, text))
        got = [i for p in parts for i in p]
        assert enc.decode_bytes(got) == text.encode()
        assert got == plain_ids(enc, text)


def test_white_space_cuts_change_nothing(monkeypatch):
    """With tiny limits every kind of cut occurs in short texts, which the library can encode whole."""
    import regex

    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "LONG_BLANK", regex.compile(rf"[{bpe.SPACE}]{{3,}}+"))
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "Bc", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "7", "!", "'s", "é", "​"]) for _ in range(rng.randint(0, 25)))
        assert [i for p in bpe.encoded_parts(enc, text) for i in p] == enc.encode_ordinary(text)


# --- 11 packing ------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END]


def check_packing(rows, want, window):
    """Every id once, crc of the right ids, gapless offsets, and no sequence longer than a window; the padding is returned."""
    left = Counter({k: 0 for k in want})
    sequences = defaultdict(list)
    by_doc = defaultdict(list)
    for doc, start, length, crc, total, seq, offset in rows:
        by_doc[doc].append((start, length, crc, total))
        sequences[seq].append((offset, length))
    assert set(by_doc) == set(want)
    for doc, parts in by_doc.items():
        at = 0
        for start, length, crc, total in sorted(parts):
            assert start == at and length > 0 and total == len(want[doc])
            assert crc == zlib.crc32(np.array(want[doc][start:start + length], dtype="<u4").tobytes())
            at += length
        assert at == len(want[doc])
        left[doc] = at
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding / sum(len(x) for x in want.values())


@pytest.mark.parametrize("parts,fan_in,open_windows", [(1, 64, 32), (37, 2, 3), (9, 64, 32)])
def test_packing_is_whole_and_tight(spark, tokenizer, parts, fan_in, open_windows):
    table = queries.table(spark, SF, "documents")
    want = {r["doc_id"]: ids_of(tokenizer, r["text"]) for r in table.select("doc_id", "text").collect()}
    out = packing.pack(table.repartition(parts), fan_in=fan_in, open_windows=open_windows)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert check_packing([tuple(r) for r in out.collect()], want, 2048) < 0.01


def test_packing_query(spark, tokenizer):
    want = {r["doc_id"]: ids_of(tokenizer, r["text"]) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()}
    assert check_packing([tuple(r) for r in queries.QUERIES["op11_window_packing"](spark, SF).collect()], want, 2048) < 0.01


def test_packing_edges(spark, tokenizer):
    long_text = " ".join(f"w{i}" for i in range(40000)) + " " * 300000 + "end"
    texts = [(1, None), (2, ""), (3, long_text), (4, "same"), (5, "same"), (None, "no id"), (7, "<|endoftext|> in a text"), (8, "\x00 \U0001f600 é")]
    out = packing.pack(docs_of(spark, texts), window=256, open_windows=2, with_ids=True)
    assert check_packing([tuple(r)[:7] for r in out.collect()], {k: ids_of(tokenizer, t) for k, t in texts}, 256) < 0.01
    assert all(np.frombuffer(r["ids"], "<u4").size == r["length"] for r in out.collect())
    twice = packing.pack(docs_of(spark, [(4, "same words"), (4, "same words")])).collect()
    assert sum(r["length"] for r in twice) == 2 * len(ids_of(tokenizer, "same words")) and sum(r["start"] == 0 for r in twice) == 2
    assert packing.pack(docs_of(spark, [])).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs_of(spark, texts), key="start")


def test_packer_against_plain_rule():
    """The same windows as a plain walk over all open windows."""
    rng = random.Random(3)
    for _ in range(50):
        window, most, least = 64, rng.randint(1, 6), rng.choice([1, 8, 64])
        packer, opened, done = packing.Packer(window, most, least), [], []
        for doc in range(200):
            n = rng.choice([rng.randint(1, 20), rng.randint(1, 90)])
            packer.add(doc, 0, np.zeros(n, "<u4"), n)
            while n >= window:
                done.append(window)
                n -= window
            if not n:
                continue
            fits = [w for w in opened if window - w >= n]
            if not fits and len(opened) == most:
                full = max(opened)
                opened.remove(full)
                gap = window - full
                if gap >= least and n - gap >= least:
                    full, n = window, n - gap
                done.append(full)
                fits = [w for w in opened if window - w >= n]
            best = max(fits) if fits else 0
            if fits:
                opened.remove(best)
            if best + n == window:
                done.append(window)
            else:
                opened.append(best + n)
        lengths = Counter()
        for _, _, ids, _, seq, _ in packer.closed:
            lengths[seq] += len(ids)
        assert sorted(lengths.values()) == sorted(done)
        assert sorted(window - g for g in packer.gaps) == sorted(opened)


def test_vocabulary_gives_the_library_ids(tokenizer):
    """Ids by rank equal those of the library, beside every kind of character."""
    encode = packing.encoder(public_tokenizers.path(packing.VOCABULARY))
    rng = random.Random(1)
    points = [*range(0x3000), *rng.sample([c for c in range(0x3000, 0x110000) if not 0xD800 <= c < 0xE000], 20000)]
    rng.shuffle(points)
    texts = ["".join(f"a{chr(c)}1 {chr(c)}{rng.choice([' ', '!', 'b', ''])}" for c in points[i:i + 50]) for i in range(0, len(points), 50)]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert [i for p in encode(text) for i in p] == want.ids


# --- 12 whitening ----------------------------------------------------------------------------------------------------

def test_leading_pairs():
    rng = np.random.default_rng(2)
    for size in (1, 2, 5, 20, 60):
        q, _ = np.linalg.qr(rng.standard_normal((size, size)))
        for values in (rng.standard_normal(size), np.repeat(3.0, size), np.where(np.arange(size) < size // 2, 5.0, 1e-9), 2.0 ** -np.arange(size), np.zeros(size), 1 + 1e-9 * np.arange(size)):
            m = (q * values) @ q.T
            m = (m + m.T) / 2
            got, vectors = spectrum.leading(m, size)
            want = np.linalg.eigvalsh(m)[::-1]
            assert np.abs(got - want).max() < 1e-13 * max(1, np.abs(want).max()) * size
            assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-9
            assert np.abs(m @ vectors - vectors * got).max() < 1e-13 * max(1, np.abs(want).max()) * size
            s = float(rng.standard_normal())
            assert spectrum.count_above(m, s) == int((want > s).sum())


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], "vec_id long, embedding array<float>, n string, component string")


def check_whitening(rows, vectors, k=32):
    """Figures of all rows against numpy's eigenvectors and Python's whole numbers."""
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(int) + 1000000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    got = np.array([[r["whitened"] for r in part] for part in rows], dtype=float)
    for part, row in zip(rows, x.tolist()):
        assert [r["component"] for r in part] == list(range(1, min(k, x.shape[1]) + 1)) and all(r["n"] == n for r in part)
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(row, total))
        assert {r["deviation"] for r in part} == {deviation if deviation < 1 << 63 else None}
    for c in range(got.shape[1]):
        assert rows[0][c]["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9, abs=1e-12)
        if values[c] > 1e-9 * values[0]:
            want = centred @ axes[:, c] / np.sqrt(values[c])
            assert min(np.abs(got[:, c] - want).max(), np.abs(got[:, c] + want).max()) < 1e-6
            assert rows[0][c]["identity_error"] < 1e-4


def by_row(out):
    rows = defaultdict(list)
    for r in out.collect():
        rows[r["vec_id"]].append(r)
    return [sorted(rows[k], key=lambda r: r["component"]) for k in sorted(rows)]


def test_whitening_query(spark):
    held = queries.table(spark, "/root/testdata/sf0.01", "embeddings").orderBy("vec_id").collect()
    check_whitening(by_row(queries.QUERIES["op12_sliced_whitening"](spark, "/root/testdata/sf0.01")), [r["embedding"] for r in held])


@pytest.mark.parametrize("scale", [1.0, 1e3, 3e6])
def test_whitening_of_any_size(spark, scale):
    rng = np.random.default_rng(7)
    vectors = (scale * rng.standard_normal((60, 5)) * [5, 4, 3, 2, 1] + 100 * scale).astype(np.float32).tolist()
    check_whitening(by_row(whitening.whiten(vectors_of(spark, list(enumerate(vectors))).repartition(7))), vectors)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(90, None), (91, [1.0, None]), (92, [nan, 1.0]), (93, [inf, 1.0]), (94, [1.0])]
    good = [(1, [0.5, 1.0]), (2, [0.5, -1.0]), (2, [0.5, -1.0]), (None, [0.5, 3.0])]
    out = whitening.whiten(vectors_of(spark, bad + good)).collect()
    assert len(out) == 8 and {r["vec_id"] for r in out} == {1, 2, None} and {r["n"] for r in out} == {4}
    second = [r for r in out if r["component"] == 2]  # the first dimension does not vary
    assert all(r["whitened"] is None and r["explained"] == pytest.approx(0, abs=1e-12) for r in second)
    assert all(r["identity_error"] < 1e-9 and r["explained"] == pytest.approx(1) for r in out if r["component"] == 1)
    same = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in same)
    assert whitening.whiten(vectors_of(spark, [])).collect() == [] == whitening.whiten(vectors_of(spark, [(1, []), (2, None)])).collect()
    huge = whitening.whiten(vectors_of(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0])])).collect()
    assert len(huge) == 4 and all(r["deviation"] is None for r in huge)


# --- 13 spelling -----------------------------------------------------------------------------------------------------

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


@pytest.mark.parametrize("letters,lengths", [("ab", (4, 9)), ("abcdé", (4, 7)), ("abcdefghijÿ", (6, 8)), ("aĀ\U0001f600b", (4, 6))])
def test_variants_are_all_found(spark, letters, lengths):
    """Few letters, so that every word has many near ones and repeated bigrams; letters whose low bytes agree as well."""
    rng = random.Random(9)
    counts = {}
    for _ in range(500):
        counts["".join(rng.choice(letters) for _ in range(rng.randint(*lengths)))] = 5 ** rng.randint(1, 9) + rng.randint(0, 1)
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    got = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group_variants(table).collect()}
    assert got == brute_variants(counts)


def brute_words(rows, one_in=199):
    total = Counter()
    for key, text in rows:
        word, runs = "", []
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                word += c.lower() if c < "À" else c
            elif word:
                runs.append(word)
                word = ""
        for run in runs:
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def test_words_and_variants_of_texts(spark, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeÀÿéXY") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    rows = [(k, " ".join(rng.choices(words, k=400)) + "×÷_ß1") for k in range(60)] + [(None, "Variant variant VARIANT variant variant"), (3, None), (4, ""), (4, ""), (5, "x" * 3_000_000)]
    monkeypatch.setattr(spelling, "CHUNK", 50)
    monkeypatch.setattr(spelling, "HELD_WORDS", 100)
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs_of(spark, rows), one_in=7).collect()}
    assert got == brute_words(rows, 7) and "variant" in got


def test_spelling_edges(spark):
    schema = "word string, n long, form string, root string"
    rows = [("colour", 100, "", ""), ("color", 500, "", ""), ("colours", 100, "", ""), (None, 7, "", ""), ("abc", 9, "", ""), ("collour", 60, "", ""), ("collour", 40, "", ""), ("colomr", None, "", "")]
    out = {r["word"]: r for r in spelling.group_variants(spark.createDataFrame(rows, schema)).collect()}
    assert set(out) == {"colour", "color", "colours", "collour", "colomr"} and out["collour"]["n"] == 100
    assert out["colour"]["form"] == "color" and out["colours"]["root"] == "colours" and out["colour"]["n_near"] == 4
    assert spelling.group_variants(spark.createDataFrame([], schema)).collect() == []
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([], schema), ratio=1)


# --- 6 the step between components -----------------------------------------------------------------------------------

def template_texts(n, rng, shared=60, own=24):
    """Texts of one template: pairs lie a little below or above the asked similarity."""
    base = [f"t{k}" for k in range(shared)]
    texts = []
    for i in range(n):
        words = list(base)
        for k in range(rng.choice([1, 2, 2])):
            words[rng.randrange(shared)] = f"x{i}_{k}"
        texts.append(" ".join(words + [f"o{rng.randrange(4)}_{k}" for k in range(rng.randrange(own))]))
    return texts


@pytest.mark.parametrize("block_rows,set_bytes", [(1024, 16 << 20), (7, 3000)])
def test_step_between_components(spark, monkeypatch, block_rows, set_bytes):
    """Small chunks, so that every pair of chunks is met: groups equal brute force, and rows out stay linear."""
    from dosewise.llm import partenum

    monkeypatch.setattr(partenum, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(partenum, "SET_BYTES", set_bytes)
    rng = random.Random(8)
    texts = template_texts(90, rng)
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    root = list(range(len(texts)))

    def head(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((head(i), head(j)))
                root[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in partenum.groups(docs).collect()}
    assert got == {i: head(i) for i in range(len(texts))} and 3 < len(set(got.values())) < 90
    # nothing known to be linked: every star is compared, and each chunk gives at most one edge for each of its ids
    none = spark.createDataFrame([], "id long, comp long")
    ids = [(0, i) for i in range(1, 90)]
    profile = partenum.profiles(texts)
    sketches = spark.createDataFrame([(i, profile["n"][i], bytearray(profile["sketch"][i]), bytearray(profile["fine"][i])) for i in range(90)], "id long, n long, sketch binary, fine binary")
    edges = partenum.crossing(spark.createDataFrame(ids, "rep long, other long"), none, sketches)
    pairs = -(-89 // block_rows) * (-(-89 // block_rows) + 1) // 2
    assert edges.count() <= 2 * block_rows * pairs and (block_rows < 90 or edges.count() < 90)
    links = partenum.settle(edges, none, docs, "doc_id", "text")
    linked = {r["id"]: r["comp"] for r in partenum.components(links).collect()}
    within = {}
    for i in range(1, 90):
        within.setdefault(linked.get(i, i), set()).add(i)
    assert sum(len(v) for v in within.values()) == 89


def test_one_row_of_a_repeated_smallest_id(spark):
    from dosewise.llm import partenum

    body = "one two three four five six seven eight nine ten"
    rows = [(1, body, "b"), (1, body, "a"), (1, body, "a"), (2, body, "c"), (3, "", "x"), (3, "", "x"), (None, body, "n"), (None, body, "n"), (4, "other words here", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted(partenum.one_of_each(docs).collect(), key=repr)
    assert [r["doc_id"] for r in kept].count(1) == 1 and [r["doc_id"] for r in kept].count(3) == 2 and [r["doc_id"] for r in kept].count(None) == 2
    assert {r["doc_id"] for r in kept} == {1, 3, 4, None} and len(kept) == 6


# --- 10 overlapping detections ---------------------------------------------------------------------------------------

def test_containment_against_all_pairs():
    """A match goes if any match ranked before it and kept contains it, wherever that one starts."""
    from dosewise.llm import licenses

    rng = random.Random(12)
    for _ in range(400):
        found = []
        for order in range(rng.randint(0, 25)):
            start = rng.randint(0, 30)
            end = start + rng.randint(1, 15)
            found.append((rng.randint(0, 3), start - end, start, order, end, f"l{order}", 0.5))
        kept = []
        for m in sorted(found):
            if not any(k[0] <= m[2] and k[1] >= m[4] for k in kept):
                kept.append((m[2], m[4], m[5], m[6]))
        assert licenses.uncontained(sorted(found)) == sorted(kept)


def test_many_detections_in_one_text():
    import time

    from dosewise.llm import licenses

    few = licenses.scan_text("Licensed under the MIT license and " * 3)
    start = time.time()
    many = licenses.scan_text("Licensed under the MIT license and " * 60_000)
    assert time.time() - start < 20 and len(many["found"]) == 20_000 * len(few["found"]) and many["labels"] == few["labels"] and few["found"]
    first, end, _ = few["found"][0].split(":")
    assert 0 <= int(first) < int(end) <= 6
