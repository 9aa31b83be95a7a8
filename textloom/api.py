"""The engine's functions under the names of a search service."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import DEFAULT, Config, view
from textloom.functions.text import without_reasoning
from textloom.plans import indexing, search
from textloom.sources import tables


def index(docs: DataFrame, folder: str) -> indexing.Index:
    """Build, store and load the BM25 index of ``docs`` (doc_id, text)."""
    indexing.save(indexing.build(docs), folder)
    return indexing.load(docs.sparkSession, folder)


def index_all(docs: DataFrame, folder: str, config: Config = DEFAULT, **more) -> tuple[indexing.Index, DataFrame]:
    """Build, store and load the BM25 index and the embedded chunks of ``docs`` (doc_id, title, text)."""
    return indexing.build_all(docs, folder, config, **more)


def retrieve(query: str, held: indexing.Index, spark: SparkSession, config: Config = DEFAULT) -> DataFrame:
    """Ranked documents of one query, by BM25 alone."""
    return search.index_search(held, spark.createDataFrame([(1, query)], "query_num int, query_text string"), config)


def find(query: str, held: indexing.Index, docs: DataFrame, chunks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The whole search of one query: retrieval, reranking, diversification, titles, snippets and topics, ranked."""
    asked = docs.sparkSession.createDataFrame([(1, query)], "query_num int, query_text string")
    return search.whole_search(held, docs, chunks, asked, config)


def answer_context(results: DataFrame, docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``query_num, documents, context``: results as JSON and the prompt context for a language model."""
    return search.responses(results, docs, config)


def summarised(contexts: DataFrame, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """``query_num, answer``: ``model`` (texts to texts, on the executors) over the contexts, without its reasoning."""
    return contexts.select("query_num", without_reasoning(F.pandas_udf(model, "string")(F.col("context"))).alias("answer"))


def config_view(config: Config = DEFAULT) -> dict[str, object]:
    """The settings, with secrets masked."""
    return view(config)


def batch(results: DataFrame, path: str) -> None:
    """Write results (query_num, rank, url, score) as a run file."""
    tables.write_run(results, path)


def health(held: indexing.Index) -> DataFrame:
    """One row: documents, terms, mean length."""
    return held.documents.agg(F.count("*").alias("documents"), F.avg("doc_length").alias("avg_doc_length")).crossJoin(held.terms.agg(F.count("*").alias("terms")))


def document(docs: DataFrame, doc_id: int) -> DataFrame:
    return docs.where(F.col("doc_id") == doc_id)


def document_ids(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id").distinct()


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def reload(spark: SparkSession, name: str) -> None:
    spark.catalog.refreshTable(name)
