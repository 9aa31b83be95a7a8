"""Registered queries of this subpackage, with production parameters, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.decontamination import contaminated
from textloom.llm.language_id import identify
from textloom.llm.pieces import encode_texts
from textloom.llm.quality import quality
from textloom.llm.secrets import secret_scan
from textloom.llm.simhash import near_duplicates
from textloom.llm.token_counts import token_counts
from textloom.llm.toxicity import toxicity
from textloom.llm.url_filter import filter_urls
from textloom.llm.vantage import nearest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and spans. Null and empty texts have none; repeated rows are kept."""
    return secret_scan(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from ids whose crc32 modulo 3 is not 1. Null texts score as empty ones; repeated rows are kept."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and byte-level tokens of every document. Null and empty texts have none; repeated rows are kept."""
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest others of each vector whose id 20 divides. Unusable vectors take no part; ties go to the smaller id."""
    return nearest(_table(spark, sf_dir, "embeddings"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items found in every document, one row a pair. Null and empty texts hold none; repeated rows repeat their pairs."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from ids whose crc32 modulo 4 is not 2. Texts without a letter are ``und``; repeated rows are kept."""
    return identify(_table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document as counts and digests. Null and empty texts are the begin and end ids; repeated rows are kept."""
    return encode_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and component of every document. Wordless texts have fingerprint zero; repeated rows are kept."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from ids whose crc32 modulo 4 is not 2. Null texts score as empty ones; repeated rows are kept."""
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page. URLs that are null or have no ``://`` have empty ones; repeated rows are kept."""
    return filter_urls(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_token_counts, op4_vantage_search, op5_decontamination, op6_language_id, op7_pieces, op8_simhash, op9_quality, op10_url_filter)
}
#: None of these can be expressed in SQL as a whole; tests/llm holds them against brute-force versions.
ORACLES: dict[str, str] = {}
