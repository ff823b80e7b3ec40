"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) with docs of the columns of ``documents`` and works on all rows its predecessor
kept; all but the last return these columns again. ``run`` writes each stage as Parquet below the shared
checkpoint folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pvflow.llm.common import documents, durable, tuned
from pvflow.llm.langid import keep_known
from pvflow.llm.mixing import mixed_pieces
from pvflow.llm.pieces import encode_documents
from pvflow.llm.secret_scan import redact
from pvflow.llm.simhash import keep_first

#: Words of a block of the mix.
BLOCK = 256
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are in no learned language (no letter, or no model codes them); a null lang is filled in."""
    tuned(spark)
    return keep_known(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: 4-word shingles, up to 4 differing bits."""
    tuned(spark)
    return keep_first(docs.select(*COLUMNS), size=4, radius=4)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the text; all documents stay."""
    tuned(spark)
    return redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that fill the slots of the mix, a row for each time a piece is taken."""
    tuned(spark)
    return mixed_pieces(docs.select(*COLUMNS), BLOCK).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_chars, and the sampled pieces of each row."""
    tuned(spark)
    return encode_documents(docs.select(*COLUMNS)).select("doc_id", "source", "n_chars", "n_pieces", "lossless", "pieces")


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scan", hide_secrets),
    ("source mix", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: No stage but the secret scan's base patterns can be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(tuned(spark), sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, name.replace(" ", "-"))
    return docs
