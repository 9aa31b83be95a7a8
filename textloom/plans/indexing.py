"""Index building: BM25 tables and embedded chunks, whole or for new documents only."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import DEFAULT, Config
from textloom.functions.vectors import hash_embedder
from textloom.operators import bm25
from textloom.operators.chunks import sliding_windows, with_chunk_ids
from textloom.session import ensure_checkpoint_dir


@dataclass
class Index:
    """The tables of an index."""

    documents: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def build(docs: DataFrame, title: str | None = None, spellings: Sequence[tuple[str, str]] = (), limit: int | None = None) -> Index:
    """All BM25 tables of ``docs`` (doc_id, text); ``title`` names a column indexed with the text, ``spellings`` are replaced."""
    words = bm25.words(docs, title_col=title, spellings=spellings, limit=limit)
    documents = bm25.word_lengths(words)
    stats = bm25.corpus_stats(documents)
    return Index(documents, bm25.word_postings(words), bm25.with_idf(bm25.word_counts(words), stats), stats)


def counted(docs: DataFrame, title: str | None = None, spellings: Sequence[tuple[str, str]] = (), limit: int | None = None) -> Index:
    """``build`` for an index that others are derived from: texts are read and tokenised once, here, for lengths and term counts.

    Both are written to the checkpoint folder; postings stay a plan over the texts.
    """
    words = bm25.words(docs, title_col=title, spellings=spellings, limit=limit)
    held = _written(bm25.word_stats(words))
    documents = held.where("doc_length is not null").select("doc_id", "doc_length")
    stats = bm25.corpus_stats(documents)
    terms = bm25.summed(held.where("term is not null").select("term", "doc_freq", "total_freq"))
    return Index(documents, bm25.word_postings(words), bm25.with_idf(terms, stats), stats)


def _written(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder and read back; it goes when the application ends, as a result still reads it."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}")
    df.write.parquet(path.toString())
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())


def extend(index: Index, docs: DataFrame, **more) -> Index:
    """``index`` with those of ``docs`` it lacks; only these are tokenised. ``more`` are settings of ``build``.

    ``index`` is best a stored or ``counted`` one: the ids of its documents are read to find the others.
    """
    fresh = counted(bm25.unindexed(docs, index.documents), **more)
    documents = index.documents.unionByName(fresh.documents)
    stats = bm25.corpus_stats(documents)
    terms = bm25.with_idf(bm25.merged(index.terms, fresh.terms), stats)
    return Index(documents, index.postings.unionByName(fresh.postings), terms, stats)


def save(index: Index, folder: str) -> None:
    """Write the tables; postings are ranged and sorted by term and document, so that a term's row groups can be picked.

    Ranges cut through the postings of a common term, so that no task holds them all.
    """
    index.documents.write.mode("overwrite").parquet(f"{folder}/documents")
    index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/postings")
    index.terms.write.mode("overwrite").parquet(f"{folder}/terms")
    index.stats.write.mode("overwrite").parquet(f"{folder}/stats")


def load(spark: SparkSession, folder: str) -> Index:
    return Index(*(spark.read.parquet(f"{folder}/{name}") for name in ("documents", "postings", "terms", "stats")))


def build_all(docs: DataFrame, folder: str, config: Config = DEFAULT, title: str | None = None, spellings: Sequence[tuple[str, str]] = ()) -> tuple[Index, DataFrame]:
    """Build, write and load the BM25 tables and the embedded chunks of ``docs``."""
    spark = docs.sparkSession
    save(build(docs, title, spellings), folder)
    embed_chunks(docs, config, title=title).write.mode("overwrite").parquet(f"{folder}/chunks")
    return load(spark, folder), spark.read.parquet(f"{folder}/chunks")


def load_streamed(spark: SparkSession, folder: str) -> Index:
    """The index that ``streaming.health.index_batch`` keeps: term counts of all batches added up, idf of all documents."""
    documents, postings, counted = (spark.read.parquet(f"{folder}/{name}").drop("batch") for name in ("documents", "postings", "terms"))
    stats = bm25.corpus_stats(documents)
    terms = bm25.with_idf(counted.groupBy("term").agg(F.sum("doc_freq").alias("doc_freq"), F.sum("total_freq").alias("total_freq")), stats)
    return Index(documents, postings, terms, stats)


def embed_chunks(docs: DataFrame, config: Config = DEFAULT, first: int = 0, title: str | None = None) -> DataFrame:
    """``chunk_id, doc_id, chunk_text, embedding`` of overlapping windows, by the built-in embedder."""
    chunks = with_chunk_ids(sliding_windows(docs, config.window, config.step, title_col=title), first)
    return chunks.select("chunk_id", "doc_id", "chunk_text", hash_embedder(config.embedding_size)(F.col("chunk_text")).alias("embedding"))
