"""Reranking: score fusion, positional weight, best chunk, domain cap, diversification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.config import DEFAULT, Config
from textloom.functions.urls import group_key
from textloom.functions.vectors import cosine
from textloom.operators.chunks import first_chunks


def representatives(docs: DataFrame, id_col: str = "doc_id", url_col: str = "url") -> DataFrame:
    """One row for each URL group: the smallest id, and the columns of that row."""
    rest = [c for c in docs.columns if c != id_col]
    held = docs.groupBy(group_key(F.col(url_col)).alias("url_key")).agg(F.min(F.struct(id_col, *rest)).alias("first"))
    return held.select("url_key", "first.*")


def candidates(scores: DataFrame, docs: DataFrame, chunks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """First chunks of the representatives of scored documents (query_num, doc_id, score).

    The ids are joined before chunks are numbered, so that only their chunks are sorted.
    """
    wanted = scores.select("doc_id").distinct()
    held = representatives(docs.join(wanted, "doc_id", "left_semi"))
    own = first_chunks(chunks.join(held.select("doc_id"), "doc_id", "left_semi"), config.chunks_per_document).drop("rn")
    return scores.join(held.select("doc_id", "url"), "doc_id").join(own, "doc_id")


def fused(rows: DataFrame, share: float = 0.15, query: str = "query_num") -> DataFrame:
    """``fused`` from ``similarity`` and ``lexical``, each scaled to 0..1 over the query's chunks (0 if all are equal).

    The extremes are partial aggregates joined back, so that no task gathers all chunks of a query.
    """
    names = ("similarity", "lexical")
    ends = rows.groupBy(query).agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("low", F.min), ("high", F.max))])

    def scaled(name: str):
        low, high = F.col(f"low_{name}"), F.col(f"high_{name}")
        return F.when(high > low, (F.col(name) - low) / (high - low)).otherwise(0.0)

    joined = rows.join(ends, query).withColumn("fused", scaled("similarity") * (1 - share) + scaled("lexical") * share)
    return joined.select(*rows.columns, "fused")


def positional(rows: DataFrame, query: str = "query_num", score: str = "fused") -> DataFrame:
    """``adjusted``: a document's best chunk gains up to 0.1 near its beginning and loses up to 0.05 near its end."""
    doc = Window.partitionBy(query, "doc_id")
    place = F.row_number().over(doc.orderBy("chunk_id")) - 1
    best = F.row_number().over(doc.orderBy(F.desc(F.round(score, 10)), "chunk_id"))
    rows = rows.withColumns({"place": place, "best": best, "chunks": F.count("*").over(doc)})
    moved = F.col(score) + 0.1 - 0.15 * F.col("place") / (F.col("chunks") - 1)
    value = F.when((F.col("best") == 1) & (F.col("chunks") > 1), F.least(F.lit(1.0), F.greatest(F.lit(0.0), moved))).otherwise(F.col(score))
    return rows.withColumn("adjusted", value).drop("place", "best", "chunks")


def best_chunk(rows: DataFrame, score: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The row of the highest score of each key, ties to the smaller chunk id."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round(score, 10)), "chunk_id")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def domain_cap(rows: DataFrame, most: int = 2, query: str | None = None) -> DataFrame:
    """At most ``most`` documents of each domain, the best first."""
    keys = [query, "domain"] if query else ["domain"]
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn")


def diversified(rows: DataFrame, top_k: int = 100, threshold: float = 0.8, query: str = "query_num") -> DataFrame:
    """``top_k`` of (query, doc_id, domain, score), one of each domain first.

    Domains with a document at ``threshold`` come first, then the others; what lacks is filled from further documents of
    domains already there, lowered so that the first of them is just below the last kept, not under zero. Beyond the first
    ``top_k + 1`` of a domain, and ``top_k`` of these groups, nothing can be kept: tasks cut there before they shuffle.
    """
    by_domain, whole = Window.partitionBy(query, "domain"), Window.partitionBy(query)
    order = (F.desc("score"), F.col("doc_id"))
    rows = rows.withColumn("nth", F.row_number().over(by_domain.orderBy(*order))).where(F.col("nth") <= top_k + 1)
    rows = rows.withColumn("is_high", F.max("score").over(by_domain) >= threshold)
    group = F.when(F.col("nth") > 1, 2).when(F.col("is_high"), 0).otherwise(1)
    rows = rows.withColumn("grp", group)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(query, "grp").orderBy(*order))).where(F.col("place") <= top_k)
    rows = rows.withColumns({"n_high": F.sum(F.when(F.col("grp") == 0, 1).otherwise(0)).over(whole), "n_other": F.sum(F.when(F.col("grp") == 1, 1).otherwise(0)).over(whole)})
    room = F.greatest(F.lit(0), F.lit(top_k) - F.col("n_high"))
    kept = ((F.col("grp") == 0) & (F.col("place") <= top_k)) | ((F.col("grp") == 1) & (F.col("place") <= room))
    lack = F.greatest(F.lit(0), room - F.col("n_other"))
    rows = rows.withColumns({"kept": kept, "filled": (F.col("grp") == 2) & (F.col("place") <= lack)}).where("kept or filled")
    last = F.min(F.when(F.col("kept"), F.col("score"))).over(whole)
    first = F.max(F.when(F.col("filled"), F.col("score"))).over(whole)
    value = F.when(F.col("kept"), F.col("score")).otherwise(F.greatest(F.lit(0.0), F.col("score") - (first - last + 1e-4)))
    return rows.select(*[c for c in rows.columns if c not in ("is_high", "nth", "grp", "place", "n_high", "n_other", "kept", "filled")], value.alias("final_score"))


def reranked(scores: DataFrame, docs: DataFrame, chunks: DataFrame, query_vectors: DataFrame, domain, config: Config = DEFAULT) -> DataFrame:
    """Scored documents (query_num, doc_id, score) reranked by their chunks' vectors; ``domain`` makes a column of a URL."""
    rows = candidates(scores.withColumnRenamed("score", "lexical"), docs, chunks, config).join(query_vectors, "query_num")
    rows = rows.withColumn("similarity", cosine(F.col("query_vector"), F.col("embedding"))).drop("query_vector", "embedding")
    rows = best_chunk(positional(fused(rows, config.lexical_share)), "adjusted", ("query_num", "doc_id"))
    rows = rows.select("query_num", "doc_id", "chunk_id", "url", domain(F.col("url")).alias("domain"), F.round("adjusted", 10).alias("score"))
    rows = diversified(rows, config.top_k_rerank, config.relevance_threshold)
    order = Window.partitionBy("query_num").orderBy(F.desc("final_score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top_k_rerank)
