"""The queries opN_<name> over the whole sample tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvflow.llm.archives import archive_pages
from pvflow.llm.codes import compress
from pvflow.llm.common import documents, tuned
from pvflow.llm.fingerprints import fingerprint_documents
from pvflow.llm.langid import identify
from pvflow.llm.lm import score_documents
from pvflow.llm.mixing import mix
from pvflow.llm.pieces import encode_documents
from pvflow.llm.planes import cluster
from pvflow.llm.quality import judge
from pvflow.llm.secret_scan import find_secrets
from pvflow.llm.sharding import shard_documents
from pvflow.llm.simhash import near_duplicates
from pvflow.llm.vector_sql import CENTROIDS, CODES, NEIGHBOURS
from pvflow.llm.vectors import embeddings
from pvflow.llm.vptree import nearest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tuned(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


@_query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


@_query
def op4_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir).select("doc_id", "text"))


@_query
def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


@_query
def op9_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")


@_query
def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir).select("doc_id", "text"))


@_query
def op6_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0")
    return judge(documents(spark, sf_dir).select("doc_id", "text"), trusted)


@_query
def op5_multinomial_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "text", "source"))


@_query
def op7_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir).select("doc_id", "text"))


@_query
def op3_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_pieces", "lossless", "pieces")


@_query
def op11_trie_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress(embeddings(spark, sf_dir))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@_query
def op12_bitplane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(embeddings(spark, sf_dir))


@_query
def op13_vantage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(embeddings(spark, sf_dir), F.col("vec_id") % 20 == 0)


ORACLE |= {"op11_trie_codes": CODES, "op12_bitplane_clusters": CENTROIDS, "op13_vantage_neighbours": NEIGHBOURS}
