"""Registered queries of this subpackage: each applies one operator to its whole table."""

from . import bpe, html_diff, licenses, mixing, oracles, packing, partenum, quality, sharding, spelling, syncmers, toxicity, warc, whitening

QUERIES = {}
ORACLE = {}


def query(oracle=None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE[fn.__name__] = oracle
        return fn
    return keep


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(oracles.MIX)
def op1_source_mix(spark, sf_dir):
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@query(oracles.QUALITY)
def op4_adaptive_quality(spark, sf_dir):
    verdicts = quality.judge(table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op5_hypergeometric_shards(spark, sf_dir):
    return sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), 40)


@query(oracles.WARC)
def op8_warc_round_trip(spark, sf_dir):
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op9_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query()
def op10_license_scan(spark, sf_dir):
    scanned = licenses.scan(table(spark, sf_dir, "documents"))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query()
def op7_toxic_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


@query(oracles.GROUPS)
def op6_partenum_groups(spark, sf_dir):
    return partenum.groups(table(spark, sf_dir, "documents"))


@query()
def op3_closed_syncmers(spark, sf_dir):
    return syncmers.compare_with_next(table(spark, sf_dir, "documents"))


@query()
def op2_page_differencing(spark, sf_dir):
    return html_diff.extract(table(spark, sf_dir, "pages"))


@query()
def op11_window_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query(oracles.SPELLING)
def op13_pivotal_variants(spark, sf_dir):
    return spelling.group_variants(spelling.word_counts(table(spark, sf_dir, "documents")))


@query()
def op12_sliced_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
