"""A training-corpus pipeline over ``documents``: quality, near duplicates, decontamination, secrets, piece encoding.

Each stage takes ``(spark, docs, sf_dir)``; its result is written and is the next stage's ``docs``. All but the last keep
the columns of ``documents``, whatever others there are. Empty tables give empty results; very long texts are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.batches import drop_stored, stored_alone
from textloom.llm.decontamination import drop_contaminated
from textloom.llm.pieces import encode_texts
from textloom.llm.quality import keep_good
from textloom.llm.secrets import redact_secrets
from textloom.llm.simhash import keep_first


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more; learned from the labelled ones among ``docs``.

    Null texts are judged as empty ones, equal texts alike; null ids and repeated rows are judged like any other.
    """
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each SimHash group.

    Null and empty texts are one group; rows with a null id all stay; of repeated rows one stays.
    """
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; null and empty texts hold none, repeated rows share their fate."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; null texts stay null, empty ones empty, repeated rows repeated."""
    return redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, as counts and digests; null and empty texts are the begin and end ids alone."""
    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", secrets),
    ("pieces", encode),
]
#: No stage but the encoding's counts could be put in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read back for the next.

    Each stage's own tables, and the result of the stage before, are deleted as soon as its result is written.
    """
    docs, before = _table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs, path = stored_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        drop_stored(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
