"""Steps whose rows, bytes or pairs must not grow faster than the input."""

import random

import numpy as np
from pyspark.sql import functions as F

from dosewise.llm import partenum, syncmers


def test_texts_of_op3_travel_compressed(spark):
    """Each text crosses the shuffle once (guards twice) and compressed; before, as plain text."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    rows = [(i if i % 50 else None, " ".join(rng.choice(words) for _ in range(400))) for i in range(200)] + [(7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = syncmers.with_next(docs).cache()
    sums = dealt.agg(F.sum(F.length("body")), F.sum("size")).first()
    assert "text" not in dealt.columns and sums[0] < 0.6 * sums[1]
    parts = dealt.filter("guard").select("part").distinct().count()
    assert dealt.count() == len(rows) + dealt.filter("guard").count() and parts > 1
    place = dealt.select("part", F.spark_partition_id().alias("at")).distinct()
    assert place.groupBy("part").count().filter("count > 1").count() == 0
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"]) for r in syncmers.compare_with_next(docs).collect())
    assert got == sorted((a is not None, a or 0, len(t or "")) for a, t in rows)


def boilerplate(n, rng):
    """Unlike texts that share a line, some near copies of others, and exact copies."""
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(5000)]
    line = [rng.choice(words) for _ in range(14)]
    made = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(60, 90))]
        at = rng.randrange(len(own))
        made.append(own[:at] + line + own[at:])
        if i % 25 == 0:
            made += [[*made[-1][:30], rng.choice(words), *made[-1][31:]], list(made[-1])]
    return [(i, " ".join(t)) for i, t in enumerate(made)]


def test_a_common_line_makes_no_star(spark):
    """Pairs of a star grow with the square of the texts that share a line; all that share it were one star before."""
    rows = boilerplate(600, random.Random(8))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    told = partenum.profile_rows(docs, "doc_id", "text").cache()
    often = partenum.frequent(told)
    assert told.filter("shingle is null").count() == len(rows) and often[1].max() >= 500 and (np.diff(often[0].astype(object)) > 0).all()
    pairs = partenum.stars(partenum.signature_rows(docs, "doc_id", "text", often))
    largest = pairs.groupBy("rep").count().agg(F.max("count")).first()[0]
    assert largest <= 20 and pairs.count() <= len(rows)


def test_similar_sets_share_a_signature_whatever_the_counts():
    rng = np.random.default_rng(15)
    for _ in range(1500):
        n = int(rng.choice([1, 3, 5, 8, 13, 31, 64, 65, 120, 200, 700]))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        gone, fresh = int(rng.integers(0, n // 7 + 1)), rng.integers(0, 2**63, int(rng.integers(0, n // 7 + 1)), dtype=np.uint64)
        b, a = np.unique(np.concatenate([a[gone:], fresh])), np.unique(a)
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 75 * (len(a) + len(b) - common):
            known = np.unique(rng.choice(np.concatenate([a, b]), int(rng.integers(1, n + 1))))
            often = known, rng.integers(1, 50, len(known)).astype(np.int32)
            one, two = partenum.signatures(a, often), partenum.signatures(b, often)
            assert len(np.intersect1d(one, two))


def test_groups_without_a_list_of_ids_that_can_be_sent(spark, monkeypatch):
    """The same groups where the ids that stand for others are more than may be broadcast, and where their copies are too."""
    rows = boilerplate(80, random.Random(9)) + [(None, "no id at all here today"), (3, "a second text of one id is kept as well"), (500, None), (501, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(partenum.groups(docs).collect(), key=repr)
    taken = []
    joined = partenum.joined_by_id
    monkeypatch.setattr(partenum, "joined_by_id", lambda docs, ids, doc_id, how: taken.append(how) or joined(docs, ids, doc_id, how))
    for most, first in ((20, "left_anti"), (1, "left_semi")):
        taken.clear()
        monkeypatch.setattr(partenum, "BROADCAST_ROWS", most)
        assert sorted(partenum.groups(docs).collect(), key=repr) == whole and taken[0] == first
