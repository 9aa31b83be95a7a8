"""Search plans: one lazy plan over all queries, from text to ranked, diversified results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.config import DEFAULT, Config
from textloom.functions.text import prompt_context, rewritten_query, snippet
from textloom.functions.urls import domain, domain_topic
from textloom.functions.vectors import hash_embedder
from textloom.operators import bm25
from textloom.operators.rerank import reranked
from textloom.plans.indexing import Index


def batch_search(docs: DataFrame, queries: DataFrame, config: Config = DEFAULT, spellings: tuple[str, ...] = ()) -> DataFrame:
    """BM25 results of all queries (query_num, query_text): ``query_num, rank, doc_id, score``."""
    asked = queries.select("query_num", rewritten_query(F.col("query_text"), config.expansion_term, spellings).alias("query_text"))
    return bm25.search(docs, asked, config)


def index_search(index: Index, queries: DataFrame, config: Config = DEFAULT, spellings: tuple[str, ...] = ()) -> DataFrame:
    """``batch_search`` over a stored index."""
    asked = queries.select("query_num", rewritten_query(F.col("query_text"), config.expansion_term, spellings).alias("query_text"))
    return bm25.search_index(index.documents, index.postings, index.terms, index.stats, asked, config)


def presented(found: DataFrame, docs: DataFrame, chunks: DataFrame, query_vectors: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Retrieved rows (query_num, doc_id, score) reranked by chunk vectors, diversified and formatted.

    ``docs`` has doc_id, url, title, text; ``chunks`` chunk_id, doc_id, embedding; ``query_vectors`` query_num,
    query_vector. Texts are joined to the final rows alone.
    """
    rows = reranked(found, docs.select("doc_id", "url"), chunks, query_vectors, domain, config)
    final = rows.select("query_num", "rank", "doc_id", "url", F.col("final_score").alias("score"))
    return final.join(docs.select("doc_id", "title", "text"), "doc_id").select(
        "query_num", "rank", "url", "score", F.coalesce(F.nullif("title", F.lit("")), F.lit("No Title")).alias("title"), snippet(F.col("text"), config.snippet).alias("snippet"), domain_topic(F.col("url")).alias("domain"), "doc_id"
    )


def hybrid_search(docs: DataFrame, chunks: DataFrame, queries: DataFrame, query_vectors: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Retrieval straight from texts, reranking, diversification and formatting for all queries."""
    return presented(batch_search(docs, queries, config).drop("rank"), docs, chunks, query_vectors, config)


def whole_search(index: Index, docs: DataFrame, chunks: DataFrame, queries: DataFrame, config: Config = DEFAULT, spellings: tuple[str, ...] = ()) -> DataFrame:
    """The same over a stored index; queries (query_num, query_text) are embedded by the built-in embedder."""
    vectors = queries.select("query_num", hash_embedder(config.embedding_size)(F.col("query_text")).alias("query_vector"))
    return presented(index_search(index, queries, config, spellings).drop("rank"), docs, chunks, vectors, config)


def responses(results: DataFrame, texts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``query_num, documents`` (JSON) and ``context`` for a language model, one row a query.

    The results of a query are at most the rerank depth, so each array is bounded.
    """
    rows = results.join(texts.select("doc_id", F.col("text").alias("window")), "doc_id")
    held = rows.groupBy("query_num").agg(F.array_sort(F.collect_list(F.struct("rank", "url", "score", "title", "snippet", "domain", "doc_id", "window"))).alias("r"))
    windows = F.transform(F.slice("r", 1, config.llm_windows), lambda x: x["window"])
    documents = F.to_json(F.transform("r", lambda x: x.dropFields("window")))
    return held.select("query_num", documents.alias("documents"), prompt_context(windows, config.llm_windows, config.llm_window_chars).alias("context"))
