"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.ann import nearest
from scholia.llm.divergence import divergence
from scholia.llm.html_text import main_text
from scholia.llm.lexical_search import search
from scholia.llm.lm_score import lm_scores
from scholia.llm.mixing import mix
from scholia.llm.near_join import near_join
from scholia.llm.oracle import DIVERGENCE, LEXICAL_SEARCH, NEAR_JOIN, QUALITY_RULES, URL_FILTER
from scholia.llm.packing import pack
from scholia.llm.quality_rules import quality_rules
from scholia.llm.sharding import shard_in_arrivals
from scholia.llm.staging import new_path
from scholia.llm.substring_dedup import repeated_passages
from scholia.llm.token_counts import token_counts
from scholia.llm.url_filter import judge_urls

#: The rules that op11 judges by.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.pmod("vec_id", F.lit(50)) == 0)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words"
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document is after four arrivals, read back through the manifest."""
    docs = _table(spark, sf_dir, "documents")
    store = shard_in_arrivals(docs, new_path(spark, "shards"))
    if not store.versions():
        return spark.createDataFrame([], "doc_id long, n_bytes long, shard long, tier int, shard_rows long, shard_bytes long")
    live = store.manifest().select("shard", "tier", F.col("n_rows").alias("shard_rows"), F.col("n_bytes").alias("shard_bytes"))
    return store.rows().select("row.doc_id", F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("n_bytes"), "shard").join(live, "shard").select(
        "doc_id", "n_bytes", "shard", "tier", "shard_rows", "shard_bytes"
    )


def op9_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_nearest_vectors, op3_lm_scoring, op4_token_counts, op5_html_text, op6_quality_rules, op7_best_fit_packing,
        op8_sharding, op9_near_join, op10_mixing, op11_url_filters, op12_lexical_search, op13_source_divergence,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op6_quality_rules": QUALITY_RULES,
    "op9_near_join": NEAR_JOIN,
    "op11_url_filters": URL_FILTER,
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_source_divergence": DIVERGENCE,
}
