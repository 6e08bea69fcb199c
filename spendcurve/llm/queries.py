"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spendcurve.llm import sql
from spendcurve.llm.common import Stash, table
from spendcurve.llm.importance import importance_resample
from spendcurve.llm.minhash import near_duplicates
from spendcurve.llm.packing import pack_documents
from spendcurve.llm.pieces import default_pieces, encode_pieces
from spendcurve.llm.pitman_yor import pitman_yor_scores
from spendcurve.llm.quality_rules import quality_rules
from spendcurve.llm.substrings import repeated_passages
from spendcurve.llm.token_store import read_tokens, write_tokens
from spendcurve.llm.tokens import default_vocabulary
from spendcurve.llm.topk import exact_top_k
from spendcurve.llm.url_filter import filter_urls

#: The rules of op5.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_vocabulary(), with_ids=False)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), default_pieces(), with_ids=False, with_text=False)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that SQL can express."""
    return op5_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor_scores(table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Stash(spark, 'tokens').root}/shards"
    write_tokens(table(spark, sf_dir, "documents"), path, default_vocabulary())
    return read_tokens(spark, path, with_ids=False)


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), with_text=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_exact_top_k": op3_exact_top_k,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_url_filter": op5_url_filter,
        "op6_pitman_yor": op6_pitman_yor,
        "op7_token_output": op7_token_output,
        "op8_importance_resampling": op8_importance_resampling,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
        "op10_quality_rules": op10_quality_rules,
        "url_rules": url_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_top_k": sql.OP3,
        "op9_minhash_near_dedup": sql.OP9,
        "url_rules": sql.URL_RULES,
        "op10_quality_rules": sql.OP10,
    }
