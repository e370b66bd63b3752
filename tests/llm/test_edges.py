"""Every operator on nulls, empty and very long texts, ties, repeated rows, an empty table, and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dosewise.llm import bpe, html_diff, licenses, mixing, partenum, quality, sharding, syncmers, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} Other{i % 61}." for i in range(30000))
ROWS = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, LONG, "en", "b", len(LONG)), (4, "same words in here twice", "de", None, 24), (5, "same words in here twice", "de", None, 24),
    (5, "same words in here twice", "de", None, 24), (None, "a row without an id", None, "b", 19), (7, " \t\n ", None, "c", 4), (8, "x", "en", "c", 1), (9, "é" * 40 + " ünï \U0001f600", "fr", "a", 46),
]
LABELS = "doc_id long, quality int, toxic int"
PAGE = "page_id long, url string, html string"
PAGES = [(1, None, None), (2, "http://h.example/a", ""), (3, "http://h.example/a", "<p>" + LONG), (3, "http://h.example/a", "<p>" + LONG), (None, "no address at all", "<b>t"), (6, "http://[bad", "x < y & z")]

# Names that the operators use themselves, inside or in their results.
CLASH = ["size", "kept", "n_words", "score", "predicted", "id", "sig", "set", "part", "__part", "copies", "block", "drop", "key", "words", "n", "comp", "text_crc32", "ids", "__text", "rate"]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 1, 0), (8, 0, 1), (9, 1, None), (None, 1, 1)], LABELS)


DOCUMENT_OPS = {
    "mix_plan": lambda s, d: mixing.mix_plan(d),
    "judge": lambda s, d: quality.judge(d),
    "shards": lambda s, d: sharding.shuffle_into_shards(d, 3),
    "groups": lambda s, d: partenum.groups(d),
    "toxic": lambda s, d: toxicity.score(d, toxicity.train(d, labels(s))),
    "bpe": lambda s, d: bpe.round_trip(d),
    "licenses": lambda s, d: licenses.scan(d),
    "fingerprints": lambda s, d: syncmers.compare_with_next(d),
}
PAGE_OPS = {
    "extract": lambda s, p: html_diff.extract(p),
    "warc": lambda s, p: warc.round_trip(p).drop("path", "offset"),
}


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def with_clashes(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns])


@pytest.mark.parametrize("name", DOCUMENT_OPS)
def test_document_operators(spark, name):
    run = DOCUMENT_OPS[name]
    out = rows(run(spark, documents(spark)))
    assert len(out) == len(ROWS)
    # the shards and their order depend on the input partitions, which the extra columns leave as they are
    assert rows(run(spark, with_clashes(documents(spark)))) == out
    empty = run(spark, documents(spark, []))
    assert rows(empty) == [] and empty.columns == run(spark, documents(spark)).columns


@pytest.mark.parametrize("name", PAGE_OPS)
def test_page_operators(spark, name):
    run = PAGE_OPS[name]
    out = rows(run(spark, spark.createDataFrame(PAGES, PAGE)))
    assert len(out) == len(PAGES)
    assert rows(run(spark, with_clashes(spark.createDataFrame(PAGES, PAGE)))) == out
    assert rows(run(spark, spark.createDataFrame([], PAGE))) == []


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_pipeline_stages(spark, tmp_path, stage):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    name, run = corpus_pipeline.STAGES[stage]
    last = stage == len(corpus_pipeline.STAGES) - 1
    for df in (documents(spark), documents(spark, [])):
        out = run(spark, df, str(tmp_path))
        got = out.collect()
        assert last or out.columns == df.columns, name
        if not last:
            assert {tuple(r) for r in got} <= {tuple(r) for r in df.collect()}
    wide = run(spark, with_clashes(documents(spark)), str(tmp_path))
    assert last or wide.columns == with_clashes(documents(spark)).columns
    plain = run(spark, documents(spark), str(tmp_path))
    assert rows(wide.select("doc_id")) == rows(plain.select("doc_id"))


def test_defined_results(spark):
    groups = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.groups(documents(spark)).collect()}
    assert groups[1] == (0, 1) and groups[2] == (0, 2) and groups[4] == groups[5] == (1, 4) and groups[None] == (1, None)
    verdict = {r["doc_id"]: r for r in quality.judge(documents(spark)).collect()}
    assert verdict[1]["n_words"] == 0 and verdict[1]["base_failed"] and not verdict[1]["kept"]
    tokens = {r["doc_id"]: r for r in bpe.round_trip(documents(spark)).collect()}
    assert tokens[1]["n_tokens"] == 0 and tokens[1]["ids_sha256"] == tokens[2]["decoded_sha256"]
    warced = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(PAGES, PAGE)).collect()}
    assert warced[1]["payload_bytes"] == 0 and warced[1]["url"] is None and warced[3]["record_type"] == "response"
