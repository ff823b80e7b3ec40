"""The filtering stages keep what they should: shared ids, missing labels, clashing names, empty tables."""

import samples
from pyspark.sql import functions as F

from pvflow.llm.langid import keep_known
from pvflow.llm.mixing import mixed_pieces
from pvflow.llm.secret_scan import redact
from pvflow.llm.simhash import keep_first

A, B = samples.prose(samples.EN, 300, 1), samples.prose(samples.DE, 300, 2)
C = samples.prose(samples.EN, 250, 77)


def texts(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect())


def test_unlike_texts_that_share_an_id_both_stay(llm):
    rows = [(1, A, "en", "s", 1), (1, B, "de", "s", 2), (1, B, "de", "s", 3), (2, A, "en", "s", 4), (3, B, "de", "s", 5), (4, C, "en", "s", 6), (None, A, None, None, None)]
    docs = samples.table(llm, rows).repartition(3)
    assert texts(keep_first(docs)) == texts(samples.table(llm, [rows[0], rows[1], rows[5], rows[6]]))
    more = samples.with_extras(docs, "fp", "root", "_row", "low", "component_id")
    got = keep_first(more)
    assert got.columns == more.columns and texts(got) == texts(keep_first(docs)) and {r.fp for r in got.collect()} == {"extra"}


def test_every_group_keeps_one(llm, docs):
    from pvflow.llm.simhash import near_duplicates

    kept = keep_first(docs).where("doc_id IS NOT NULL")
    groups = near_duplicates(docs).where("doc_id IS NOT NULL").select("component_id").distinct().count()
    assert kept.count() == groups and kept.select("doc_id").distinct().count() == groups
    assert keep_first(docs).where("doc_id IS NULL").count() == docs.where("doc_id IS NULL").count()


def test_without_labels_no_language_rejects(llm, docs):
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(map(str, keep_known(blank).collect())) == sorted(map(str, blank.collect()))


def test_known_languages_stay_and_clashing_columns_pass(llm, docs):
    more = samples.with_extras(docs, "held_out", "lang_pred", "score", "bits_per_byte")
    got = keep_known(more)
    assert got.columns == more.columns and {r.score for r in got.collect()} == {"extra"}
    kept = texts(got)
    assert kept == texts(keep_known(docs))
    prose = texts(docs.where("doc_id < 42"))
    assert all(t in kept for t in prose) and got.where("lang IS NULL").count() == 0
    assert got.where("doc_id IN (43, 44, 45, 46)").count() == 0  # no letter


def test_empty_tables(llm, empty):
    for stage in (keep_known, keep_first, redact, lambda d: mixed_pieces(d, 16).select(*d.columns)):
        got = stage(empty)
        assert got.count() == 0 and got.columns == empty.columns
