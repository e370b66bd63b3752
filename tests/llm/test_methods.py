"""The operators against brute-force versions, exact round trips, and held-out accuracy."""

import gzip
import hashlib
import io
import itertools
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from dosewise.llm import bpe, hashing, html_diff, licenses, mixing, oracles, partenum, queries, quality, sharding, syncmers, toxicity, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id").df()["text"].tolist()


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string")


# --- queries against SQL ---------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


# --- 1 mixing --------------------------------------------------------------------------------------------------------

def test_targets_and_copies(spark):
    rng = random.Random(1)
    docs = documents(spark, [(i, "w " * rng.randint(1, 30), rng.choice("abbbcd")) for i in range(4000)])
    plan = mixing.mix_plan(docs).toPandas()
    size = plan.groupby("source")["size"].sum()
    weight = dict(zip(sorted(size.index), itertools.cycle((3, 1, 2))))
    target, free = {}, set(size.index)
    while free:
        left = 1.5 * size.sum() - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in over} if over else {s: level * weight[s] for s in free}
        free = free - over if over else set()
    for s, part in plan.groupby("source"):
        assert part["target"].iloc[0] == pytest.approx(target[s]) and part["source_size"].iloc[0] == size[s]
        assert part["taken"].sum() == pytest.approx(target[s], rel=0.1)
    assert (plan["taken"] <= 2 * plan["size"]).all()
    mixed = mixing.mix(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert mixed.reindex(plan["doc_id"]).fillna(0).tolist() == plan["copies"].tolist()


# --- 2 pages ---------------------------------------------------------------------------------------------------------

def test_blocks_of_markup():
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><nav>n</nav>
    <div class="layout with-sidebar"><h2>Title &amp; more</h2><p>one <i>two</i>three
    four<p>five<div class="ad-box">AD</div><ul><li>x<li>y</ul></div><div id="comments">c</div><form><p>f</form>
    <!-- <p>no</p> --><script>if (a < b) { "</p>" }</script><p hidden>h</p><p>a&nbsp;&#8364;</p><footer>z</footer>"""
    assert [t for t, _ in html_diff.blocks(page)] == ["Title & more", "one twothree four", "five", "x", "y", "a €"]
    inner = '<div class="sidebar"><article><header>H</header><p>in</p><aside>no</aside></article></div><p>out</p>'
    assert html_diff.blocks(inner) == [("H", True), ("in", True), ("out", False)]


def brute_lcs(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


def test_common_lines_are_longest():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        at = html_diff.common_lines(a, b)
        assert at == sorted(set(at)) and len(at) == brute_lcs(a, b)
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in at)


def test_template_lines_go(spark):
    """Pages without an article element lose what the page with the nearest address has too; other hosts do not matter."""
    page = "<div>Menu of {h}</div><div>Story {k} of {h}</div><div>More about {k}</div><div>Imprint of {h}</div>".format
    pages = [(10 * n + k, f"http://{h}.example/news/{k}", page(h=h, k=f"{h}{k}")) for n, h in enumerate("abc") for k in range(7)]
    pages += [(99, "http://alone.example/x", page(h="alone", k=1)), (98, "http://a.example/news/2b", "<article>Menu of a</article><p>Imprint of a</p>")]
    out = {r["page_id"]: r["text"] for r in html_diff.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()}
    assert all(out[10 * n + k] == f"Story {h}{k} of {h} More about {h}{k}" for n, h in enumerate("abc") for k in range(7) if (h, k) != ("a", 2) and (h, k) != ("a", 3))
    assert out[99] == "Menu of alone Story 1 of alone More about 1 Imprint of alone" and out[98] == "Menu of a"


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_copies_keep_their_text(spark, parts):
    """Copies under other ids and addresses, in runs longer than a part, are no template; pages beyond the run are."""
    page = "<div>Menu</div><div>Story {0}</div><div>More about {0}</div><div>Imprint</div>".format
    pages = [(k, f"http://h.example/n/{k:03}", page("A" if 10 <= k < 40 else f"B{k}")) for k in range(50)]
    pages += [(100 + k, "http://h.example/n/020", page("A")) for k in range(5)]
    pages += [(200 + k, f"http://mirror.example/x?copy={k}", page("M")) for k in range(30)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = {r["page_id"]: r["text"] for r in html_diff.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {k: "Story {0} More about {0}".format("A" if 10 <= k < 40 or k >= 100 else f"B{k}") for k, _, _ in pages if k < 200}
    assert out == want | {200 + k: "Menu Story M More about M Imprint" for k in range(30)}


def test_template_at_the_edges_of_articles(spark):
    """Lines without a class that open or close the articles of neighbours go; shared lines inside, and versions of a text, stay."""
    page = "<article><p>Daily news</p><p>Story {0}</p><p>As said</p><p>More {0}</p><p>End {0}</p><p>Read on</p></article>".format
    near = "<article><p>One</p><p>Two</p><p>Three {0}</p><p>Four</p><p>Five</p></article>".format
    pages = [(k, f"http://a.example/{k}", page(k)) for k in range(6)] + [(10 + k, f"http://b.example/{k}", near(k)) for k in range(3)]
    out = {r["page_id"]: r["text"] for r in html_diff.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out == {k: f"Story {k} As said More {k} End {k}" for k in range(6)} | {10 + k: f"One Two Three {k} Four Five" for k in range(3)}
    assert html_diff.template_edges([], [1]) == html_diff.template_edges([1], []) == []


# --- 3 syncmers ------------------------------------------------------------------------------------------------------

def test_anchors_are_closed_syncmers(texts):
    text = texts[3][:500]
    codes = np.array([ord(c) + 1 for c in text], np.uint64)
    inner = hashing.mix(syncmers.rolling(codes, syncmers.S)).tolist()
    want = []
    for i in range(len(text) - syncmers.K + 1):
        w = inner[i:i + syncmers.K - syncmers.S + 1]
        if min(w) in (w[0], w[-1]):
            want.append(i)
    at, h = syncmers.anchors(text)
    assert at.tolist() == want
    # free of context: the same stretch has the same anchors elsewhere
    at2, h2 = syncmers.anchors("§" * 7 + text)
    assert set(zip(at.tolist(), h.tolist())) <= set(zip((at2 - 7).tolist(), h2.tolist()))
    one, two = syncmers.sketch(text), syncmers.sketch("§" * 7 + text)
    assert syncmers.shift_between(one, two)[0] == 7
    assert [x.tolist() for x in syncmers.parse(syncmers.fingerprint(*one))] == [x.tolist() for x in one]


def test_edits_against_brute_force(spark, texts):
    docs = documents(spark, [(3 * i, t, "s") for i, t in enumerate(texts)]).repartition(5)
    got = syncmers.compare_with_next(docs).toPandas().set_index("doc_id")
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        n = len(t) // 4
        changed = t[:len(t) - n] + after[:n]
        row = got.loc[3 * i]
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and row["n_chars"] == len(t)
        assert row["near_edited"] == syncmers.likeness(syncmers.sketch(t), syncmers.sketch(changed))
        assert row["near_next"] == syncmers.likeness(syncmers.sketch(t), syncmers.sketch(after))
    assert got["near_edited"].mean() > 0.5 > 0.1 > got["near_next"].mean()


def test_likeness_of_very_long_texts(spark):
    """Whole anchor sets of texts with more than 10^5 anchors, counted with dictionaries; local edits and a shared passage show."""
    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    base = " ".join(rng.choice(words) for _ in range(80000))
    edit = base[:200000] + "a local edit" + base[200000:]
    passage = " ".join(rng.choice(words) for _ in range(70000)) + base[100000:102000]
    texts = [base, edit, passage]

    def brute(one, two):
        first = []
        for t in (one, two):
            at, h = syncmers.anchors(t)
            first.append({v: p for p, v in zip(reversed(at.tolist()), reversed(h.tolist()))})
        a, b = first
        shifts = [b[v] - a[v] for v in a.keys() & b.keys()]
        matched = sum(n for n in Counter(shifts).values() if n > 1)
        return matched / (len(a) + len(b) - matched)

    got = {r["doc_id"]: r for r in syncmers.compare_with_next(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        after = texts[(i + 1) % 3]
        assert got[i]["near_next"] == pytest.approx(brute(t, after), abs=1e-4)
        assert got[i]["near_edited"] == pytest.approx(brute(t, syncmers.edited(t, after)), abs=1e-4)
        assert len(got[i]["fingerprint"].split()) > 100000 and got[i]["fingerprint"] != got[(i + 1) % 3]["fingerprint"]
    assert 0.999 < got[0]["near_next"] < 1 and 0.002 < got[1]["near_next"] < 0.01
    # the same words in another order share anchors, but not their distances
    assert syncmers.likeness((np.arange(9), np.arange(9) ** 2), (np.arange(9), np.arange(9))) == 2 / 16


# --- 4 quality -------------------------------------------------------------------------------------------------------

def test_counts_against_brute_force(texts):
    for t in [*texts, None, "", "a a a", "a b c a b c", "x y z w x y z"]:
        got = {k: v[0] for k, v in quality.text_stats([t]).items()}
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(w) < 800 else None
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert got["n_words"] == len(w) and got["word_chars"] == sum(map(len, w)) and got["n_dup_lines"] == len(lines) - len(set(lines))
        assert got["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t)) and (inside is None or got["n_repeat_words"] == len(inside))


def test_sketch_merges_and_bounds_the_error(spark):
    rng = np.random.default_rng(3)
    values = np.exp(rng.normal(0, 2, 5000))
    df = spark.createDataFrame([(int(i % 3), *[float(v)] * len(quality.SHARES)) for i, v in enumerate(values)], ["g", *quality.SHARES])
    fine = quality.sketch(df, ["g"])
    merged = quality.quantiles(fine.groupBy("share", "bin").agg(F.sum("n").alias("n")), [], {"q1": 0.25, "q3": 0.75}).first()
    for name, at in (("q1", 0.25), ("q3", 0.75)):
        assert merged[name] == pytest.approx(np.quantile(values, at, method="inverted_cdf"), rel=quality.ALPHA * 1.01)


# --- 5 shards --------------------------------------------------------------------------------------------------------

def test_shards_are_exact_and_uniform(spark):
    docs = documents(spark, [(i, None if i % 9 == 0 else "t" * (i % 50), "s") for i in range(1003)]).repartition(6)
    out = sharding.shuffle_into_shards(docs, 40, sub_rows=10).toPandas()
    counts = out.groupby("shard").size()
    assert len(out) == 1003 and set(out["doc_id"]) == set(range(1003)) and len(counts) == 40 and counts.max() - counts.min() <= 1
    assert all(sorted(part["slot"]) == list(range(len(part))) for _, part in out.groupby("shard"))
    assert ((out["size"] - 16) == [0 if i % 9 == 0 else i % 50 for i in out["doc_id"]]).all()
    assert out["text_crc32"].tolist() == [zlib.crc32(b"" if i % 9 == 0 else b"t" * (i % 50)) for i in out["doc_id"]]


def test_matrix_has_exact_margins_and_the_right_law():
    rng = np.random.default_rng(4)
    total = np.zeros((3, 4))
    for _ in range(2000):
        m = sharding.deal(rng, [5, 0, 7], [3, 3, 3, 3])
        assert m.sum(axis=1).tolist() == [5, 0, 7] and m.sum(axis=0).tolist() == [3, 3, 3, 3]
        total += m
    assert np.allclose(total / 2000, np.outer([5, 0, 7], [3, 3, 3, 3]) / 12, atol=0.08)
    big = [sharding.hypergeometric(rng, 4 * 10**9, 6 * 10**9, 1000) for _ in range(3000)]
    assert np.mean(big) == pytest.approx(400, abs=1.5) and np.var(big) == pytest.approx(240, rel=0.15)


# --- 6 set join ------------------------------------------------------------------------------------------------------

def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for _ in range(1500):
        n = int(rng.choice([1, 2, 3, 4, 5, 8, 13, 31, 64, 65, 200, 700]))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        gone = int(rng.integers(0, n // 4 + 1))
        new = int(rng.integers(0, max(0, (n - gone) * 4 // 3 - n) + 1))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, new, dtype=np.uint64)]))
        a = np.unique(a)
        common = len(np.intersect1d(a, b))
        if 100 * common >= 75 * (len(a) + len(b) - common):
            assert len(np.intersect1d(partenum.signatures(a), partenum.signatures(b)))
            for share in (partenum.COARSE, partenum.FINE):
                bins = [partenum.bins_for(len(s), share) for s in (a, b)]
                x, y = (partenum.folded(partenum.sketch_of(s, k), min(bins)) for s, k in zip((a, b), bins))
                assert partenum.may_be_similar(x, y, len(a), len(b))


def test_groups_against_brute_force(spark):
    """Chains and families of near copies, exact copies, short texts, and a passage that unlike texts share."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    made = []
    for family in range(4):
        base = [rng.choice(words) for _ in range(rng.choice([12, 80, 150]))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            made.append(copy)
            base = copy if rng.random() < 0.3 else base
    made += [[rng.choice(words) for _ in range(40)] + passage for _ in range(12)] + [["Only", "three", "WORDS"], ["only", "three", "words"], ["x"], ["x"]]
    rng.shuffle(made)
    docs = documents(spark, [(i, "\t".join(w), "s") for i, w in enumerate(made)])
    sets = [{tuple(x.lower() for x in w)[k:k + 5] for k in range(max(1, len(w) - 4))} for w in made]
    label = list(range(len(made)))
    for a, b in itertools.combinations(range(len(made)), 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * len(sets[a] | sets[b]):
            lo, hi = sorted((label[a], label[b]))
            label = [lo if x == hi else x for x in label]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.groups(docs).collect()}
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    assert {r["doc_id"] for r in partenum.one_of_each(docs).collect()} == set(label)


def test_components_of_a_chain(spark):
    ids = list(range(60))
    random.Random(7).shuffle(ids)
    links = spark.createDataFrame([*zip(ids, ids[1:]), (100, 101)], "a long, b long")
    assert {r["id"]: r["comp"] for r in partenum.components(links).collect()} == {i: 0 for i in range(60)} | {100: 100, 101: 100}


@pytest.mark.parametrize("page", ["<a " * 60000, "<a" * 60000, '<a "' * 60001 + ">", "<!" * 60000, "<div>" * 60000 + "</b>" * 60000, "<b>" * 60000 + "<p></p>" * 60000, "<a '\"" * 60000 + ">", "<!--" * 60000])
def test_hostile_markup_ends(page):
    """Tags that never end, quotes that never close, and end tags without a start: read in time linear in the page."""
    begun = time.monotonic()
    html_diff.blocks(page)
    assert time.monotonic() - begun < 20


def test_what_is_no_whole_tag_is_text():
    assert html_diff.blocks('1 < 2 <b>bold</b> <a "x>y') == [('1 < 2 bold <a "x>y', False)]
    assert html_diff.blocks("<p title='a>b'>one<p>two</i></p>three<!-- never closed") == [("one", False), ("two", False), ("three", False)]
    assert html_diff.blocks("text <!--") == [("text", False)]


def test_common_lines_are_longest():
    """Against the table of all prefixes, whole and cut in two; and on many repeats."""
    rng = random.Random(6)
    for _ in range(400):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 25))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        for found in (html_diff.common_lines(a, b), html_diff.common_places(a, b, 20)):
            rest = iter(b)
            assert len(found) == best[-1][-1] and found == sorted(set(found)) and all(a[i] in rest for i in found)
    assert len(html_diff.common_lines([1, 2] * 4000 + [3], [2, 1] * 4000 + [4])) == 7999


# --- 7 toxicity ------------------------------------------------------------------------------------------------------

def test_marginals_against_enumeration():
    words = hashing.WordHashes(["a b c d e f"], toxicity.MARKS, toxicity.FOLD)
    emission, trans = np.random.default_rng(8).normal(size=6), np.array([0.4, -0.3, 0.2, 0.9])
    weight = {}
    for tags in itertools.product((0, 1), repeat=6):
        weight[tags] = np.exp(emission @ tags + sum(trans[2 * a + b] for a, b in zip(tags, tags[1:])))
    z = sum(weight.values())
    want = [sum(w for t, w in weight.items() if t[k]) / z for k in range(6)]
    chains = toxicity.Chains(words)
    e, ahead, back, p = chains.marginals(emission, trans)
    assert np.allclose(p, want)
    pairs = [sum(w * sum(2 * a + b == c for a, b in zip(t, t[1:])) for t, w in weight.items()) / z for c in range(4)]
    assert np.allclose(chains.pairs(e, ahead, back, trans), pairs)


def test_chains_longer_than_a_stretch():
    """Marginals and transition counts of texts of many stretches, against one walk through each text in log space."""
    rng = np.random.default_rng(4)
    sizes = [1, 63, 64, 65, 0, 128, 200, 129, 1000]
    words = hashing.WordHashes([" ".join(["w"] * n) for n in sizes], toxicity.MARKS, toxicity.FOLD)
    emission, trans = rng.normal(size=sum(sizes)) * 6, np.array([1.5, -1.0, -0.7, 1.2])
    t = trans.reshape(2, 2)
    want, pairs, at = [], np.zeros((2, 2)), 0
    for n in sizes:
        own = np.stack([np.zeros(n), emission[at:at + n]], axis=1)
        at += n
        fore, aft = own.copy(), np.zeros((n, 2))
        for k in range(1, n):
            fore[k] += np.logaddexp.reduce(fore[k - 1][:, None] + t, axis=0)
        for k in range(n - 2, -1, -1):
            aft[k] = np.logaddexp.reduce(t + (own[k + 1] + aft[k + 1])[None, :], axis=1)
        both = fore + aft
        want.append(1 / (1 + np.exp(both[:, 0] - both[:, 1])))
        for k in range(1, n):
            cell = fore[k - 1][:, None] + t + (own[k] + aft[k])[None, :]
            pairs += np.exp(cell - np.logaddexp.reduce(cell.ravel()))
    chains = toxicity.Chains(words)
    e, ahead, back, p = chains.marginals(emission, trans)
    assert np.allclose(p, np.concatenate(want), atol=1e-9)
    assert np.allclose(chains.pairs(e, ahead, back, trans), pairs.ravel())


def test_a_span_across_a_cut_scores_like_any_other():
    strength = {n: np.r_[np.zeros(n), [1.5] * 3, np.zeros(300 - n)] for n in (30, 62, 63, 64, 127)}
    words = hashing.WordHashes([" ".join(["w"] * 303)], toxicity.MARKS, toxicity.FOLD)
    found = {n: toxicity.Chains(words).marginals(e, np.array([1.0, -2.0, -1.0, 0.5]))[3][n:n + 3] for n, e in strength.items()}
    assert all(np.allclose(p, found[127], atol=1e-6) for p in found.values())


def test_a_text_beyond_the_sample_is_left_out_of_it(spark):
    """The sample goes on after a text that does not fit."""
    docs = spark.createDataFrame([(i, "you vile wretched thing " * 3 if i % 2 else "a calm day by the sea " * 3) for i in range(60)] + [(i, "calm " * 2000) for i in range(60, 70)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2 if i < 60 else 0) for i in range(70)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, train_chars=9000)
    assert "share" not in model
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert min(scores[i] for i in range(1, 60, 2)) > max(scores[i] for i in range(0, 60, 2))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out and toxic is not null").toPandas()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) for i in scored["doc_id"])
    hit = (scored["predicted"] == 1) & (scored["toxic"] == 1)
    assert hit.sum() >= 0.6 * (scored["toxic"] == 1).sum() and ((scored["predicted"] == 1) & (scored["toxic"] == 0)).sum() <= 4
    again = toxicity.score(docs, toxicity.train(docs, labels)).toPandas().set_index("doc_id")["score"]
    assert (scored.set_index("doc_id")["score"] == again.loc[scored["doc_id"]]).all()


def test_spans_are_places_in_the_text(spark):
    rng = random.Random(9)
    plain = [f"plain{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(plain) for _ in range(30)) + " é." + (" nasty!" if i % 4 == 0 else ""), "s") for i in range(400)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).toPandas().set_index("doc_id")
    for i, t, _ in rows:
        found = [t[int(a):int(b)] for a, b in (s.split("-") for s in out.loc[i, "spans"])]
        assert found == (["nasty"] if i % 4 == 0 else []) and out.loc[i, "predicted"] == int(i % 4 == 0)


# --- 8 archives ------------------------------------------------------------------------------------------------------

def test_records_by_ranges(spark, tmp_path):
    rng = random.Random(10)
    body = lambda n: "".join(rng.choice("abcdefgh<> é") for _ in range(n))
    same = body(1500)
    pages = [(i, f"http://x.example/{i}", same if i % 10 == 0 else "short" if i % 10 == 1 else body(rng.randint(0, 6000))) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    archives = warc.write_warc(df, str(tmp_path))
    read = [warc.read_warc(archives, r).toPandas().set_index("page_id").sort_index() for r in (997, 1 << 16, 1 << 30)]
    assert len(read[0]) == 300 and all(x.drop(columns=["payload"]).equals(read[0].drop(columns=["payload"])) for x in read)
    for i, url, html in pages:
        row = read[0].loc[i]
        revisit = i % 10 == 0 and i != 290
        assert row["payload_digest"] == hashlib.sha1(html.encode()).hexdigest() and row["payload_bytes"] == len(html.encode()) and row["url"] == url
        assert row["record_type"] == ("revisit" if revisit else "response") and (row["refers_to"] == 290 if revisit else row["payload"] == html.encode())
    # every file is a plain series of gzip members
    for path in tmp_path.glob("*.gz"):
        assert gzip.open(io.BytesIO(path.read_bytes())).read().startswith(b"WARC/1.1\r\n")


# --- 9 tokens --------------------------------------------------------------------------------------------------------

def test_tokens_against_the_library(spark, texts):
    ranks = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    assert isinstance(ranks, tiktoken.Encoding)
    odd = ["", "  ", "a  b\n\n c's 12 éß\t x", "<|endoftext|>", "\U0001f600" * 9, " " * 300 + "x"]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate([*texts, *odd])])
    got = bpe.encode(docs).toPandas().set_index("doc_id")["ids"]
    back = bpe.decode(bpe.encode(docs)).toPandas().set_index("doc_id")["decoded"]
    for i, t in enumerate([*texts, *odd]):
        assert list(got[i]) == ranks.encode_ordinary(t) and bytes(back[i]) == t.encode()


def test_pieces_do_not_change_the_ids(texts):
    ranks = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    rng = random.Random(11)
    for _ in range(200):
        t = "".join(rng.choice(["ab", " ", "  ", "\n", "\t", "7", "'s", "é", "!", " ", "x" * 30]) for _ in range(rng.randint(1, 120)))
        cut = list(bpe.pieces(t, 16))
        assert "".join(cut) == t and [i for p in cut for i in ranks.encode_ordinary(p)] == ranks.encode_ordinary(t)


# --- 10 licences -----------------------------------------------------------------------------------------------------

def test_base_places_against_brute_force():
    rng = random.Random(12)
    parts = ["CC", "by", "cc-BY", "General", "public license", "GENERAL PUBLIC", "license", "all rights", "reserved.", "x", "é", "ccé", "by/cc/by", "All.Rights\nReserved"]
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for _ in range(400):
        t = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        at = [(i, label) for i in range(len(w)) for p, label in phrases.items() if tuple(w[i:i + len(p)]) == p]
        got = licenses.scan_text(t)
        assert (got["n_words"], got["n_base"]) == (len(w), len(at)) and got["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert (got["first_word"], got["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(filter(None, got["base_labels"].split(","))) <= set(got["labels"].split(",")) and 0 <= got["score"] <= 1


def test_rules_and_their_order():
    cases = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "SPDX-License-Identifier: LGPL-2.1": "lgpl-2.1",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "GPLv3": "gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd", "All rights reserved": "reserved", "no licence here": "",
    }
    assert {t: licenses.scan_text(t)["labels"] for t in cases} == cases
    assert len(licenses.RULES) > 300


def test_gate_never_hides_a_match():
    """Texts built from the rules' own names: scanning without the keyword gate finds the same."""
    rng = random.Random(13)
    words = sorted({w for _, _, _, p, _ in licenses.RULES for w in re.findall(r"[a-z0-9]+", p.pattern.decode())} | {"gplv3", "v2", "lgpl3", "mpl2"})
    names = [re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", p.pattern.decode()[6:-5]).replace("?", "") for _, _, _, p, _ in licenses.RULES]
    for _ in range(300):
        t = " ".join(rng.choice(names) if rng.random() < 0.5 else rng.choice(words) for _ in range(8))
        folded = f" {t} ".encode()
        tokens = folded.split()
        folded = b" " + b" ".join(tokens) + b" "
        present = licenses.GATE.intersection(tokens)
        for _, _, label, pattern, gate in licenses.RULES:
            if pattern.search(folded):
                assert present.issuperset(gate) if gate else not present.isdisjoint(licenses.LOOSE), (label, t)


def test_gate_passes_every_form_of_every_rule():
    """Each rule alone, in all of its optional forms, against its gate; the leading grant with the longest and shortest name."""
    grants = sorted(licenses.forms(licenses.GRANT))
    for order, (priority, _, label, pattern, gate) in enumerate(licenses.RULES):
        plain = pattern.pattern.decode()[len("(?<= )"):-len("(?= )")]
        if priority == 2:
            names = sorted(licenses.forms(plain.removeprefix(f"{licenses.GRANT} ")), key=len)
            made = [f"{g} {n}" for g in grants for n in (names[0], names[-1])] + [f"{grants[0]} {n}" for n in names]
        else:
            made = licenses.forms(plain)
        for form in made:
            tokens = form.replace("\0", "a b").encode().split()
            folded = b" " + b" ".join(tokens) + b" "
            if pattern.search(folded):
                present = licenses.GATE.intersection(tokens)
                assert present.issuperset(gate) and not present.isdisjoint(licenses.OPENINGS[order]), (label, form)
            else:
                assert "  " in form or " " in (form[:1], form[-1:]), (label, form)
    for text, label in (("under the OpenRAIL-M license", "openrail"), ("Open RAIL license", "openrail"), ("CeCILL2.1", "cecill-2.1"), ("GPLv2", "gpl-2.0"), ("CC BY4.0", "cc-by-4.0")):
        assert licenses.scan_text(text)["labels"].split(",")[-1] == label


def test_contained_detections_are_dropped():
    assert oracles.GROUPS and licenses.scan_text("general public license version 3")["found"] != []
    for t in ("Licensed under the GNU Lesser General Public License v2.1 and the MIT License", "creative commons attribution share alike 4.0"):
        spans = [tuple(map(int, f.split(":")[:2])) for f in licenses.scan_text(t)["found"]]
        assert not any(a != b and b[0] <= a[0] and a[1] <= b[1] for a in spans for b in spans)
