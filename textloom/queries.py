"""Registered queries of the engine: name to function, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom import session
from textloom.config import Config
from textloom.functions import scores, text, urls
from textloom.functions.terms import TERMS
from textloom.functions.vectors import cosine, hash_embedder
from textloom.operators import analytics, bm25, chunks, cleaning, crawl, html, rerank
from textloom.plans import crawling, indexing, search
from textloom.sources import tables
from textloom.sources.tables import table
from textloom.streaming import health

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Pieces of SQL that several oracles share.
_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TOK = rf"list_filter(regexp_extract_all(lower(coalesce(@, '')), '\p{{L}}+'), lambda t: NOT list_contains([{_STOPS}], t))"


def _tok(column: str) -> str:
    return _TOK.replace("@", column)


_INDEX = f"""
toks AS (SELECT * FROM (SELECT doc_id, {_tok('text')} AS tokens FROM documents) WHERE len(tokens) > 0),
doc_stats AS (SELECT doc_id, len(tokens) AS doc_length FROM toks),
postings AS (SELECT doc_id, term, count(*) AS freq FROM (SELECT doc_id, unnest(tokens) AS term FROM toks) GROUP BY doc_id, term),
stats AS (SELECT CAST(avg(doc_length) AS REAL) AS avgdl, CAST(count(*) AS REAL) AS n FROM doc_stats),
terms AS (SELECT term, count(*) AS doc_freq, sum(freq) AS total_freq,
  CAST(log10((CAST((SELECT n FROM stats) AS DOUBLE) - count(*) + 0.5) / (count(*) + 0.5)) AS REAL) AS idf FROM postings GROUP BY term)
"""


def _scored(queries_sql: str) -> str:
    """CTEs up to ``scored`` (query_num, doc_id, score) for a select of query_num, query_text."""
    return f"""WITH {_INDEX},
queries AS ({queries_sql}),
asked AS (SELECT query_num, term, count(*) AS qtf FROM (SELECT query_num, unnest({_tok('query_text')}) AS term FROM queries) GROUP BY query_num, term),
scored AS (SELECT query_num, doc_id, sum(CAST(idf AS DOUBLE) * (freq * 2.2::DOUBLE) / (freq + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * doc_length / CAST((SELECT avgdl FROM stats) AS DOUBLE))) * qtf) AS score
  FROM asked JOIN terms USING (term) JOIN postings USING (term) JOIN doc_stats USING (doc_id) GROUP BY query_num, doc_id)"""


_RANKED = "SELECT query_num, row_number() OVER (PARTITION BY query_num ORDER BY round(score, 10) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM scored WHERE round(score, 10) >= 0"

#: What the single search asks for.
QUERY = "licensed under apache clown trash idiot"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _with_url(docs: DataFrame) -> DataFrame:
    return docs.withColumn("url", F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("?id="), "doc_id"))


_WITH_URL = "SELECT *, concat('https://', source, '.example.com/', lang, '?id=', doc_id) AS url FROM documents"


# ---- BM25 ----


@query(f"WITH {_INDEX} SELECT doc_id, term, freq FROM postings")
def bm25_term_freq(spark, sf):
    return bm25.term_freq(bm25.tokenized(_documents(spark, sf)))


@query(f"WITH {_INDEX} SELECT doc_id, doc_length FROM doc_stats")
def bm25_doc_stats(spark, sf):
    return bm25.document_stats(bm25.tokenized(_documents(spark, sf)))


@query(f"WITH {_INDEX} SELECT term, doc_freq, CAST(total_freq AS BIGINT) AS total_freq, round(CAST(idf AS DOUBLE), 5) AS idf FROM terms")
def bm25_term_stats(spark, sf):
    return indexing.build(_documents(spark, sf)).terms.withColumn("idf", F.round(F.col("idf").cast("double"), 5))


@query(f"WITH {_INDEX} SELECT 'avg_doc_length' AS stat_name, round(CAST(avgdl AS DOUBLE), 3) AS stat_value FROM stats UNION ALL SELECT 'total_docs', round(CAST(n AS DOUBLE), 3) FROM stats")
def bm25_corpus_stats(spark, sf):
    rows = bm25.corpus_stats_rows(bm25.document_stats(bm25.tokenized(_documents(spark, sf))))
    return rows.withColumn("stat_value", F.round(F.col("stat_value").cast("double"), 3))


@query(_scored(f"SELECT 1 AS query_num, '{QUERY}' AS query_text") + f", ranked AS ({_RANKED}) SELECT rank, doc_id, r.score, CASE WHEN length(text) > 200 THEN concat(substring(text, 1, 200), '...') ELSE text END AS snippet FROM ranked r JOIN documents USING (doc_id) WHERE rank <= 1000")
def bm25_search(spark, sf):
    docs = _documents(spark, sf)
    asked = spark.createDataFrame([(1, QUERY)], "query_num int, query_text string")
    found = search.batch_search(docs, asked)
    return F.broadcast(found).join(docs.select("doc_id", "text"), "doc_id").select("rank", "doc_id", F.round("score", 6).alias("score"), text.snippet(F.col("text")).alias("snippet"))


@query(_scored("SELECT item_id AS query_num, text AS query_text FROM benchmark") + f" SELECT * FROM ({_RANKED}) WHERE rank <= 100")
def bm25_batch_search(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_num"), F.col("text").alias("query_text"))
    found = search.batch_search(_documents(spark, sf), asked, Config(top_k_retrieval=100))
    return found.withColumn("score", F.round("score", 6))


@query(_scored("SELECT item_id AS query_num, text AS query_text FROM benchmark") + f" SELECT * FROM ({_RANKED}) WHERE rank <= 100")
def bm25_index_search(spark, sf):
    """The batch search over index tables instead of texts."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_num"), F.col("text").alias("query_text"))
    found = search.index_search(indexing.build(_documents(spark, sf)), asked, Config(top_k_retrieval=100))
    return found.withColumn("score", F.round("score", 6))


@query(f"WITH {_INDEX} SELECT term, doc_freq, CAST(total_freq AS BIGINT) AS total_freq, round(ln(((SELECT count(*) FROM doc_stats) - doc_freq + 0.5) / (doc_freq + 0.5)), 6) AS idf FROM terms WHERE term IN ('licensed', 'apache', 'clown', 'nothing')")
def bm25_term_lookup(spark, sf):
    tokenised = bm25.tokenized(_documents(spark, sf))
    found = bm25.term_lookup(bm25.term_freq(tokenised), bm25.document_stats(tokenised), ["licensed", "apache", "clown", "nothing"])
    return found.withColumn("idf", F.round("idf", 6))


@query(f"WITH {_INDEX} SELECT * FROM (SELECT doc_id, term, freq, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, term) AS rank FROM postings) WHERE rank <= 20")
def bm25_top_terms(spark, sf):
    return bm25.top_terms(bm25.term_freq(bm25.tokenized(_documents(spark, sf)))).select("doc_id", "term", "freq", "rank")


@query(f"WITH {_INDEX} SELECT (SELECT count(*) FROM doc_stats) AS indexed, (SELECT round(avg(doc_length), 4) FROM doc_stats) AS avg_doc_length, (SELECT count(DISTINCT term) FROM postings) AS terms, (SELECT count(*) FROM postings) AS postings, (SELECT count(*) FROM documents) AS documents, concat((SELECT count(*) FROM doc_stats), '/', (SELECT count(*) FROM documents)) AS coverage")
def bm25_index_stats(spark, sf):
    docs = _documents(spark, sf)
    tokenised = bm25.tokenized(docs)
    return bm25.index_stats(docs, bm25.document_stats(tokenised), bm25.term_freq(tokenised))


@query(f"WITH {_INDEX} SELECT term, doc_freq, CAST(total_freq AS BIGINT) AS total_freq, round(CAST(idf AS DOUBLE), 5) AS idf FROM terms")
def bm25_incremental_merge(spark, sf):
    """An index of the labelled documents, extended by all the others; the same as one built at once."""
    docs = _documents(spark, sf)
    first = docs.join(bm25.near(table(spark, sf, "labels").select("doc_id")), "doc_id", "left_semi")
    grown = indexing.extend(indexing.counted(first), docs)
    return grown.terms.select("term", "doc_freq", "total_freq", F.round(F.col("idf").cast("double"), 5).alias("idf"))


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unindexed_docs_anti(spark, sf):
    return bm25.unindexed(_documents(spark, sf), table(spark, sf, "labels")).select("doc_id", "lang", "source")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def docs_by_ids(spark, sf):
    ids = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return _documents(spark, sf).join(ids, "doc_id", "left_semi").select("doc_id", "lang", "n_chars")


# ---- chunks and vectors ----

_WINDOWS = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, words, list_sort(list_distinct(list_concat(CASE WHEN len(words) <= 512 THEN [0] ELSE generate_series(0, len(words) - 512, 450) END, CASE WHEN len(words) > 512 THEN [len(words) - 512] ELSE [] END))) AS starts FROM w WHERE len(words) > 0),
win AS (SELECT doc_id, words, unnest(starts) AS start, generate_subscripts(starts, 1) - 1 AS pos FROM s)"""


@query(f"WITH {_WINDOWS} SELECT doc_id, pos, start, len(words[start + 1 : start + 512]) AS n_words, md5(array_to_string(words[start + 1 : start + 512], ' ')) AS digest FROM win")
def sliding_windows(spark, sf):
    rows = chunks.sliding_windows(_documents(spark, sf))
    return rows.select("doc_id", "pos", "start", "n_words", F.md5(F.col("chunk_text").cast("binary")).alias("digest"))


@query(f"WITH {_WINDOWS} SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_id FROM win")
def chunk_ids(spark, sf):
    return chunks.with_chunk_ids(chunks.sliding_windows(_documents(spark, sf))).select("doc_id", "pos", "chunk_id")


@query()
def hash_embed(spark, sf):
    return _documents(spark, sf).select("doc_id", hash_embedder()(F.col("text")).alias("embedding"))


@query()
def embedded_chunks(spark, sf):
    return indexing.embed_chunks(_documents(spark, sf)).select("chunk_id", "doc_id", "embedding")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 5").alias("doc_id"), "embedding")


_COS = """q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0),
sims AS (SELECT vec_id AS chunk_id, vec_id // 5 AS doc_id, list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) AS similarity FROM embeddings, q)"""


def _similar(spark, sf):
    rows = _vectors(spark, sf)
    asked = rows.where("chunk_id = 0").select(F.col("embedding").alias("qv"))
    return rows.crossJoin(F.broadcast(asked)).withColumn("similarity", cosine(F.col("embedding"), F.col("qv"))).drop("qv", "embedding")


@query(f"WITH {_COS} SELECT chunk_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (ORDER BY round(similarity, 10) DESC, chunk_id) AS rn FROM sims) WHERE rn <= 100")
def cosine_topk(spark, sf):
    rows = _similar(spark, sf).withColumn("similarity", F.round("similarity", 10)).orderBy(F.desc("similarity"), "chunk_id").limit(100)
    return rows.select("chunk_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_COS} SELECT doc_id, chunk_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(similarity, 10) DESC, chunk_id) AS rn FROM sims) WHERE rn = 1")
def best_chunk_per_doc(spark, sf):
    return rerank.best_chunk(_similar(spark, sf), "similarity").select("doc_id", "chunk_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT doc_id, chunk_id FROM (SELECT vec_id // 5 AS doc_id, vec_id AS chunk_id, row_number() OVER (PARTITION BY vec_id // 5 ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 3")
def first_k_chunks(spark, sf):
    return chunks.first_chunks(_vectors(spark, sf), 3).select("doc_id", "chunk_id")


# ---- reranking ----


@query(f"WITH u AS ({_WITH_URL}) SELECT split_part(url, '?', 1) AS url_key, min(doc_id) AS doc_id, arg_min(url, doc_id) AS url, arg_min(n_chars, doc_id) AS n_chars FROM u GROUP BY 1")
def url_group_representative(spark, sf):
    return rerank.representatives(_with_url(_documents(spark, sf)).select("doc_id", "url", "n_chars"))


_CAND = f"""u AS ({_WITH_URL}),
reps AS (SELECT min(doc_id) AS doc_id, arg_min(url, doc_id) AS url, arg_min(n_chars, doc_id) AS n_chars FROM u GROUP BY split_part(url, '?', 1)),
numbered AS (SELECT vec_id AS chunk_id, vec_id // 5 AS doc_id, embedding, row_number() OVER (PARTITION BY vec_id // 5 ORDER BY vec_id) AS rn FROM embeddings),
cand AS (SELECT 1 AS query_num, r.doc_id, url, n_chars::DOUBLE AS lexical, chunk_id, embedding FROM reps r JOIN numbered USING (doc_id) WHERE rn <= 10)"""


@query(f"WITH {_CAND} SELECT doc_id, url, chunk_id, lexical FROM cand")
def candidate_fetch(spark, sf):
    docs = _with_url(_documents(spark, sf)).select("doc_id", "url", "n_chars")
    found = docs.select(F.lit(1).alias("query_num"), "doc_id", F.col("n_chars").cast("double").alias("lexical"))
    return rerank.candidates(found, docs, _vectors(spark, sf)).select("doc_id", "url", "chunk_id", "lexical")


_FUSED = f"""{_COS},
rows_ AS (SELECT chunk_id, s.doc_id, similarity, n_chars::DOUBLE AS lexical FROM sims s JOIN documents d ON d.doc_id = s.doc_id),
fused AS (SELECT *, CASE WHEN max(similarity) OVER () > min(similarity) OVER () THEN (similarity - min(similarity) OVER ()) / (max(similarity) OVER () - min(similarity) OVER ()) ELSE 0 END * 0.85::DOUBLE
 + CASE WHEN max(lexical) OVER () > min(lexical) OVER () THEN (lexical - min(lexical) OVER ()) / (max(lexical) OVER () - min(lexical) OVER ()) ELSE 0 END * 0.15::DOUBLE AS fused FROM rows_),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1 AS place, row_number() OVER (PARTITION BY doc_id ORDER BY round(fused, 10) DESC, chunk_id) AS best, count(*) OVER (PARTITION BY doc_id) AS chunks FROM fused),
adjusted AS (SELECT *, CASE WHEN best = 1 AND chunks > 1 THEN least(1.0, greatest(0.0, fused + 0.1::DOUBLE - 0.15::DOUBLE * place / (chunks - 1))) ELSE fused END AS adjusted FROM placed)"""


def _fused_rows(spark, sf):
    docs = _documents(spark, sf).select("doc_id", F.col("n_chars").cast("double").alias("lexical"))
    return rerank.fused(_similar(spark, sf).join(docs, "doc_id").withColumn("query_num", F.lit(1)))


@query(f"WITH {_FUSED} SELECT chunk_id, doc_id, round(fused, 6) AS fused FROM fused")
def score_fusion(spark, sf):
    return _fused_rows(spark, sf).select("chunk_id", "doc_id", F.round("fused", 6).alias("fused"))


@query(f"WITH {_FUSED} SELECT chunk_id, doc_id, round(adjusted, 6) AS adjusted FROM adjusted")
def positional_weight(spark, sf):
    return rerank.positional(_fused_rows(spark, sf)).select("chunk_id", "doc_id", F.round("adjusted", 6).alias("adjusted"))


def _domain_scores(spark, sf):
    """All documents of each language as one query's results."""
    score = F.round(F.expr("(doc_id * 37 % 1009) / 1009D"), 6)
    return _documents(spark, sf).select(F.col("lang").alias("query_num"), "doc_id", F.col("source").alias("domain"), score.alias("score"))


_DOMAIN_SCORES = "ds AS (SELECT lang AS query_num, doc_id, source AS domain, round((doc_id * 37 % 1009) / 1009::DOUBLE, 6) AS score FROM documents)"


@query(f"WITH {_DOMAIN_SCORES} SELECT query_num, doc_id, domain, score FROM (SELECT *, row_number() OVER (PARTITION BY query_num, domain ORDER BY score DESC, doc_id) AS rn FROM ds) WHERE rn <= 2")
def domain_cap(spark, sf):
    return rerank.domain_cap(_domain_scores(spark, sf), 2, "query_num")


def _diversified_sql(top_k: int, threshold: float) -> str:
    return f"""WITH {_DOMAIN_SCORES},
a AS (SELECT *, max(score) OVER (PARTITION BY query_num, domain) >= {threshold} AS is_high, row_number() OVER (PARTITION BY query_num, domain ORDER BY score DESC, doc_id) AS nth FROM ds),
b AS (SELECT *, CASE WHEN nth > 1 THEN 2 WHEN is_high THEN 0 ELSE 1 END AS grp FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY query_num, grp ORDER BY score DESC, doc_id) AS place, count(*) FILTER (grp = 0) OVER (PARTITION BY query_num) AS n_high, count(*) FILTER (grp = 1) OVER (PARTITION BY query_num) AS n_other FROM b),
d AS (SELECT *, (grp = 0 AND place <= {top_k}) OR (grp = 1 AND place <= greatest(0, {top_k} - n_high)) AS kept, grp = 2 AND place <= greatest(0, greatest(0, {top_k} - n_high) - n_other) AS filled FROM c),
e AS (SELECT *, min(CASE WHEN kept THEN score END) OVER (PARTITION BY query_num) AS last_kept, max(CASE WHEN filled THEN score END) OVER (PARTITION BY query_num) AS first_filled FROM d WHERE kept OR filled)
SELECT query_num, doc_id, domain, round(CASE WHEN kept THEN score ELSE greatest(0.0, score - (first_filled - last_kept + 1e-4::DOUBLE)) END, 6) AS final_score FROM e"""


@query(_diversified_sql(10, 0.999))
def hybrid_diversify_slice(spark, sf):
    return rerank.diversified(_domain_scores(spark, sf), 10, 0.999).select("query_num", "doc_id", "domain", F.round("final_score", 6).alias("final_score"))


@query(_diversified_sql(30, 0.8))
def hybrid_diversify_refill(spark, sf):
    return rerank.diversified(_domain_scores(spark, sf), 30, 0.8).select("query_num", "doc_id", "domain", F.round("final_score", 6).alias("final_score"))


_RERANKED = f"""WITH {_CAND}, qv AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0),
s1 AS (SELECT cand.*, list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]) AS similarity FROM cand, qv),
f1 AS (SELECT *, CASE WHEN max(similarity) OVER () > min(similarity) OVER () THEN (similarity - min(similarity) OVER ()) / (max(similarity) OVER () - min(similarity) OVER ()) ELSE 0 END * 0.85::DOUBLE + CASE WHEN max(lexical) OVER () > min(lexical) OVER () THEN (lexical - min(lexical) OVER ()) / (max(lexical) OVER () - min(lexical) OVER ()) ELSE 0 END * 0.15::DOUBLE AS fused FROM s1),
p1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1 AS place, row_number() OVER (PARTITION BY doc_id ORDER BY round(fused, 10) DESC, chunk_id) AS best, count(*) OVER (PARTITION BY doc_id) AS chunks FROM f1),
a1 AS (SELECT *, CASE WHEN best = 1 AND chunks > 1 THEN least(1.0, greatest(0.0, fused + 0.1::DOUBLE - 0.15::DOUBLE * place / (chunks - 1))) ELSE fused END AS adjusted FROM p1),
b1 AS (SELECT doc_id, url, round(adjusted, 10) AS score, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS domain FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(adjusted, 10) DESC, chunk_id) AS rn1 FROM a1) WHERE rn1 = 1),
a AS (SELECT *, max(score) OVER (PARTITION BY domain) >= 0.8 AS is_high, row_number() OVER (PARTITION BY domain ORDER BY score DESC, doc_id) AS nth FROM b1),
b AS (SELECT *, CASE WHEN nth > 1 THEN 2 WHEN is_high THEN 0 ELSE 1 END AS grp FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, doc_id) AS place, count(*) FILTER (grp = 0) OVER () AS n_high, count(*) FILTER (grp = 1) OVER () AS n_other FROM b),
d AS (SELECT *, (grp = 0 AND place <= 100) OR (grp = 1 AND place <= greatest(0, 100 - n_high)) AS kept, grp = 2 AND place <= greatest(0, greatest(0, 100 - n_high) - n_other) AS filled FROM c),
e AS (SELECT *, min(CASE WHEN kept THEN score END) OVER () AS last_kept, max(CASE WHEN filled THEN score END) OVER () AS first_filled FROM d WHERE kept OR filled),
final AS (SELECT doc_id, url, CASE WHEN kept THEN score ELSE greatest(0.0, score - (first_filled - last_kept + 1e-4::DOUBLE)) END AS final_score FROM e)"""


def _reranked(spark, sf):
    docs = _with_url(_documents(spark, sf)).select("doc_id", "url", F.col("n_chars").cast("double").alias("score"))
    found = docs.select(F.lit(1).alias("query_num"), "doc_id", "score")
    asked = _vectors(spark, sf).where("chunk_id = 0").select(F.lit(1).alias("query_num"), F.col("embedding").alias("query_vector"))
    return rerank.reranked(found, docs.select("doc_id", "url"), _vectors(spark, sf), asked, urls.domain)


@query(_RERANKED + " SELECT doc_id, url, round(final_score, 6) AS score FROM final")
def rerank_pipeline(spark, sf):
    return _reranked(spark, sf).select("doc_id", "url", F.round("final_score", 6).alias("score"))


@query(_scored("SELECT item_id AS query_num, text AS query_text FROM benchmark") + f", r AS ({_RANKED.replace('round(score, 6) AS score', 'score')}) SELECT concat(query_num, chr(9), rank, chr(9), 'https://', source, '.example.com/', lang, '?id=', doc_id, chr(9), printf('%.3f', r.score)) AS line FROM r JOIN documents USING (doc_id) WHERE rank <= 100")
def run_file(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_num"), F.col("text").alias("query_text"))
    found = search.batch_search(_documents(spark, sf), asked, Config(top_k_retrieval=100))
    return tables.run_lines(found.join(_with_url(_documents(spark, sf)).select("doc_id", "url"), "doc_id"))


@query()
def hybrid_search(spark, sf):
    """Benchmark items as queries over embedded document chunks."""
    docs = _with_url(_documents(spark, sf)).withColumn("title", F.lit(""))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_num"), F.col("text").alias("query_text"))
    vectors = items.select("query_num", hash_embedder()(F.col("query_text")).alias("query_vector"))
    return search.hybrid_search(docs, indexing.embed_chunks(docs), items, vectors)


# ---- text and URL scalars ----


@query("SELECT item_id, trim(CASE WHEN contains(q, 'castle') OR contains(q, 'fortress') THEN replace(q, 'fortress', 'castle') ELSE concat(q, ' castle') END) AS query FROM (SELECT item_id, lower(trim(text)) AS q FROM benchmark)")
def query_rewrite(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.rewritten_query(F.col("text"), "castle", ("fortress",)).alias("query"))


_BARE = "CASE WHEN starts_with(url, 'https://') THEN substring(url, 9) WHEN starts_with(url, 'http://') THEN substring(url, 8) END"


@query(f"SELECT page_id, coalesce({_BARE}, regexp_replace(split_part(url, '?', 1), '/$', '')) AS strict_url, regexp_replace(split_part(coalesce({_BARE}, url), '?', 1), '/$', '') AS url FROM pages")
def url_normalise(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.normalised_url(u, strict=True).alias("strict_url"), urls.normalised_url(u).alias("url"))


@query(f"WITH u AS ({_WITH_URL}) SELECT split_part(replace(url, 'https://', ''), '?', 1) AS key, min(doc_id) AS doc_id FROM u GROUP BY 1")
def url_dedup(spark, sf):
    rows = _with_url(_documents(spark, sf)).select("doc_id", urls.normalised_url(F.col("url")).alias("key"))
    return cleaning.first_by(rows, ["key"], "doc_id").select("key", "doc_id")


@query("SELECT page_id, nullif(regexp_extract(url, '//([^/:]+)', 1), '') AS crawl_domain, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS domain FROM pages")
def domain_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.crawl_domain(F.col("url")).alias("crawl_domain"), urls.domain(F.col("url")).alias("domain"))


@query(r"""WITH h AS (SELECT page_id, string_split(regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^www\.', ''), '.') AS l FROM pages)
SELECT page_id, coalesce(nullif(regexp_replace(CASE WHEN len(l) >= 2 THEN l[-2] ELSE l[1] END, '[^a-zA-Z0-9-]', '', 'g'), ''), 'unknown') AS topic FROM h""")
def domain_topic(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.domain_topic(F.col("url")).alias("topic"))


@query(r"SELECT url, regexp_matches(lower(url), 'sitemap.*\.xml$|/sitemap/?$|sitemap_index.*\.xml$') AS is_sitemap FROM (SELECT url FROM pages UNION ALL SELECT concat(url, '/sitemap') FROM pages UNION ALL SELECT concat(url, '/Sitemap_1.xml') FROM pages)")
def sitemap_filter(spark, sf):
    u = table(spark, sf, "pages").select("url")
    rows = u.unionByName(u.select(F.concat("url", F.lit("/sitemap")).alias("url"))).unionByName(u.select(F.concat("url", F.lit("/Sitemap_1.xml")).alias("url")))
    return rows.select("url", urls.is_sitemap(F.col("url")).alias("is_sitemap"))


_URL_SCORE = """least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN contains(lower(url), 'casino') OR contains(lower(url), 'blog') THEN 0.5::DOUBLE ELSE 0 END
 + CASE WHEN contains(lower(url), '/en/') OR ends_with(lower(url), '/en') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN contains(lower(url), '.example.org') THEN 0.2::DOUBLE ELSE 0 END
 - CASE WHEN length(url) - length(replace(url, '/', '')) > 6 THEN 0.1::DOUBLE * (length(url) - length(replace(url, '/', '')) - 6) ELSE 0 END))"""


def _url_score():
    return urls.url_score(F.col("url"), ("casino", "blog"), ".example.org")


@query(f"SELECT page_id, round({_URL_SCORE}, 6) AS score FROM pages")
def url_score(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.round(_url_score(), 6).alias("score"))


#: Term groups for the registered score: words that the corpus has.
_GROUPS = {"phrases": ["licensed under", "apache license"], "city": ["clown", "trash"], "university": ["the", "ation"], "faculty": ["version", "attribution"], "academic": ["license", "idiot", "password", "token"]}


def _hits_sql(terms: list[str]) -> str:
    return " + ".join(rf"CAST(regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){t}s?([^\p{{L}}\p{{N}}_]|$)') AS INT)" for t in terms)


_TEXT_SCORE = (
    "WITH hits AS (SELECT doc_id, lang, source, " + ", ".join(f"{_hits_sql(t)} AS {g}" for g, t in _GROUPS.items()) + f", {_hits_sql(['germany'])} AS region FROM documents), "
    "ts AS (SELECT doc_id, source, CASE WHEN lang = 'en' THEN least(1.0::DOUBLE, " + " + ".join(f"{w}::DOUBLE * least(1.0::DOUBLE, {g} / {n}::DOUBLE)" for g, (w, n) in scores.GROUPS.items()) + " + CASE WHEN phrases > 0 AND academic > 0 THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN region > 0 THEN 0.08::DOUBLE ELSE 0 END) ELSE 0 END AS text_score FROM hits)"
)


@query(_TEXT_SCORE + " SELECT doc_id, round(text_score, 6) AS score FROM ts")
def text_score(spark, sf):
    value = scores.text_score(F.col("text"), F.col("lang") == "en", _GROUPS, ["germany"])
    return _documents(spark, sf).select("doc_id", F.round(value, 6).alias("score"))


_SITE_SCORE = (
    "WITH hits AS (SELECT doc_id, lang, " + ", ".join(f"{_hits_sql(t)} AS {g}" for g, t in TERMS.items() if g in scores.GROUPS) + f", {_hits_sql(['germany', 'baden-württemberg'])} AS region FROM documents) "
    "SELECT doc_id, round(CASE WHEN lang = 'en' THEN least(1.0::DOUBLE, " + " + ".join(f"{w}::DOUBLE * least(1.0::DOUBLE, {g} / {n}::DOUBLE)" for g, (w, n) in scores.GROUPS.items()) + " + CASE WHEN phrases > 0 AND academic > 0 THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN region > 0 THEN 0.08::DOUBLE ELSE 0 END) ELSE 0 END, 6) AS score FROM hits"
)


@query(_SITE_SCORE)
def site_text_score(spark, sf):
    """The same score with the engine's own term lists."""
    value = scores.text_score(F.col("text"), F.col("lang") == "en", TERMS, ["germany", "baden-württemberg"])
    return _documents(spark, sf).select("doc_id", F.round(value, 6).alias("score"))


_DEPTHS = "doc_id % 7 AS link_depth, doc_id % 4 AS domain_depth, (doc_id % 5)::DOUBLE AS incoming, (doc_id % 6)::DOUBLE AS outgoing, (doc_id % 11) / 10::DOUBLE AS url_score"


def _score_inputs(spark, sf):
    value = scores.text_score(F.col("text"), F.col("lang") == "en", _GROUPS, ["germany"])
    rows = _documents(spark, sf).select("doc_id", value.alias("text_score"))
    return rows.selectExpr("*", "doc_id % 7 link_depth", "doc_id % 4 domain_depth", "cast(doc_id % 5 as double) incoming", "cast(doc_id % 6 as double) outgoing", "(doc_id % 11) / 10D url_score")


@query(_TEXT_SCORE + f""", x AS (SELECT *, {_DEPTHS} FROM ts), y AS (SELECT *, (0.6::DOUBLE * text_score + 0.25::DOUBLE * url_score + 0.1::DOUBLE * least(1.0::DOUBLE, incoming / 3)) * greatest(0.5::DOUBLE, 1 - 0.1::DOUBLE * greatest(link_depth, domain_depth)) AS base FROM x)
SELECT doc_id, round(CASE WHEN greatest(link_depth, domain_depth) > 5 THEN 0 ELSE least(1.0, greatest(0.0, CASE WHEN base < 0.4 AND least(1.0, incoming / 3) > 0.8 THEN least(1.0, base + 0.15::DOUBLE) ELSE base END)) END, 6) AS score FROM y""")
def page_score(spark, sf):
    args = (F.col(c) for c in ("text_score", "url_score", "incoming", "link_depth", "domain_depth"))
    return _score_inputs(spark, sf).select("doc_id", F.round(scores.page_score(*args), 6).alias("score"))


@query(_TEXT_SCORE + f""", x AS (SELECT *, {_DEPTHS}, least(doc_id % 7, doc_id % 4) AS d FROM ts), y AS (SELECT *, (0.45::DOUBLE * text_score + 0.25::DOUBLE * url_score + 0.15::DOUBLE * least(1.0::DOUBLE, incoming / 3) + 0.15::DOUBLE * least(1.0::DOUBLE, outgoing / 5)) * (1 - least(0.5::DOUBLE, 0.05::DOUBLE * greatest(0, d - 2))) AS base FROM x)
SELECT doc_id, round(least(1.0, greatest(0.0, CASE WHEN text_score < 0.3 AND url_score < 0.3 AND d > 6 THEN base * 0.5::DOUBLE ELSE base END)), 6) AS score FROM y""")
def offline_metric(spark, sf):
    args = (F.col(c) for c in ("text_score", "url_score", "incoming", "outgoing", "link_depth", "domain_depth"))
    return _score_inputs(spark, sf).select("doc_id", F.round(scores.offline_score(*args), 6).alias("score"))


_ENGLISH = "(" + " + ".join(f"CAST((length(lower(text)) - length(replace(lower(text), '{m}', ''))) / {len(m)} AS INT)" for m in (" the ", " and ", " of ", " to ", " in ")) + r") > len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) / 100"


@query(f"SELECT doc_id, {_ENGLISH} AS english FROM documents")
def english_heuristic(spark, sf):
    return _documents(spark, sf).select("doc_id", text.looks_english(F.col("text")).alias("english"))


@query("SELECT lang = 'en' AS english, count(*) AS n FROM documents GROUP BY 1")
def lang_counts(spark, sf):
    return cleaning.value_counts(_documents(spark, sf), F.col("lang") == "en", "english")


@query("""WITH old AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), fresh AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang = 'en' AND text NOT IN (SELECT text FROM old)),
firsts AS (SELECT text, min(doc_id) AS doc_id FROM fresh GROUP BY text)
SELECT doc_id, md5(text) AS digest FROM old UNION ALL SELECT (SELECT max(doc_id) FROM old) + row_number() OVER (ORDER BY doc_id), md5(text) FROM firsts""")
def clean_merge(spark, sf):
    docs = _documents(spark, sf)
    done = table(spark, sf, "labels").select("doc_id").distinct()
    merged = cleaning.clean_merge(docs.join(done, "doc_id", "left_semi"), docs.join(done, "doc_id", "left_anti"), F.col("text"), F.col("lang") == "en")
    return merged.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


_DROPPED = "script|style|noscript|aside|header|footer|nav"


@query(rf"""WITH a AS (SELECT page_id, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS body FROM pages)
SELECT page_id, trim(regexp_extract(replace(html, '&amp;', '&'), '<title[^>]*>([^<]*)</title>', 1)) AS title,
 trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(body, '(?s)<!--.*?-->|<({_DROPPED})[^>]*>.*?</({_DROPPED})>', '', 'g'), '<[^>]*>', chr(10), 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), '[\s\x{{A0}}\x{{85}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{3000}}\x1c-\x1f]+', ' ', 'g')) AS text,
 len(list_distinct(regexp_extract_all(regexp_replace(html, '(?s)<nav>.*?</nav>', '', 'g'), '<a href="((?:http|/)[^"]*)"', 1))) AS n_links FROM a""")
def html_extract(spark, sf):
    parsed = html.parsed_page(F.col("html"), F.col("url"), closed=True)
    return table(spark, sf, "pages").select("page_id", parsed.alias("p")).select("page_id", "p.title", "p.text", F.size("p.links").alias("n_links"))


@query()
def page_links(spark, sf):
    parsed = html.parsed_page(F.col("html"), F.col("url"))
    return table(spark, sf, "pages").select("page_id", F.explode(parsed["links"]).alias("link"))


def _unnavigated(spark, sf):
    """Pages whose navigation is plain content, so that its links count."""
    pages = table(spark, sf, "pages")
    return pages.withColumn("html", F.regexp_replace("html", "<(/?)nav>", "<$1div>"))


@query(r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT DISTINCT page_id, CASE WHEN starts_with(href, 'http') THEN href ELSE concat(regexp_extract(url, '^[^:/?#]+://[^/?#]*', 0), href) END AS link FROM l WHERE starts_with(href, 'http') OR starts_with(href, '/')""")
def content_links(spark, sf):
    """Links of pages whose navigation isn't left out."""
    parsed = html.parsed_page(F.col("html"), F.col("url"))
    return _unnavigated(spark, sf).select("page_id", F.explode(parsed["links"]).alias("link"))


@query(r"""SELECT page_id, trim(regexp_extract(replace(html, '&amp;', '&'), '<title[^>]*>([^<]*)</title>', 1)) AS title, length(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) > 0 AS headed FROM pages""")
def page_title(spark, sf):
    """Titles by the parser, beside whether the page has a heading that could stand in."""
    parsed = html.parsed_page(F.col("html"), F.col("url"), closed=True)
    return table(spark, sf, "pages").select("page_id", parsed["title"].alias("title"), (F.length(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)) > 0).alias("headed"))


@query(r"SELECT page_id, trim(regexp_extract(replace(html, '&amp;', '&'), '<h1>([^<]*)</h1>', 1)) AS title FROM pages WHERE html LIKE '%<article><h1>%'")
def heading_title(spark, sf):
    """Without a title element the first heading is the title."""
    bare = table(spark, sf, "pages").where("html like '%<article><h1>%'").withColumn("html", F.regexp_replace("html", "<title>[^<]*</title>", ""))
    return bare.select("page_id", html.parsed_page(F.col("html"), F.col("url"), closed=True)["title"].alias("title"))


_ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/1\nCrawl-delay: 3\n\nUser-agent: other\nDisallow: /\n"


@query("SELECT domain, ['/en/1'] AS allowed, ['/en/'] AS forbidden, 3.0::DOUBLE AS delay FROM (SELECT DISTINCT lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS domain FROM pages)")
def robots_rules(spark, sf):
    domains = table(spark, sf, "pages").select(urls.domain(F.col("url")).alias("domain"), F.lit(_ROBOTS).alias("robots")).distinct()
    return crawl.robots_rules(domains)


@query("SELECT page_id, CASE WHEN starts_with(p, '/en/1') THEN true WHEN starts_with(p, '/en/') THEN false ELSE true END AS allowed FROM (SELECT page_id, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)")
def robots_allowed(spark, sf):
    pages = table(spark, sf, "pages").withColumns({"domain": urls.domain(F.col("url")), "path": F.regexp_extract("url", "^[^:/?#]+://[^/?#]*([^?#]*)", 1)})
    return crawl.allowed_paths(pages, robots_rules(spark, sf), F.col("path")).select("page_id", "allowed")


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'No content available' WHEN length(text) > 200 THEN concat(substring(text, 1, 200), '...') ELSE text END AS snippet FROM documents")
def snippet(spark, sf):
    return _documents(spark, sf).select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("SELECT conv_id, string_agg(concat('Text Window ', rn, ':', chr(10), substring(text, 1, 4000)), concat(chr(10), chr(10)) ORDER BY rn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations) WHERE rn <= 10 GROUP BY conv_id")
def llm_context(spark, sf):
    """Windows of each conversation; only the first ten of each go into an array."""
    rows = table(spark, sf, "conversations").withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).where("rn <= 10")
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rn", "text"))).alias("w"))
    return held.select("conv_id", text.prompt_context(F.transform("w", lambda x: x["text"])).alias("context"))


@query("SELECT conv_id, turn, trim(text) AS answer FROM conversations")
def strip_reasoning(spark, sf):
    answer = F.concat(F.lit("<think>first\nthoughts</think> "), "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", text.without_reasoning(answer).alias("answer"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat('### Reply', chr(10), '**', role, '**', chr(10), '- ', text), '(?m)^### (.*)$', '<h3>\1</h3>', 'g'), '\*\*(.*?)\*\*', '<strong>\1</strong>', 'g'), '(?m)^- (.*)$', '<li>\1</li>', 'g'), '\n\n', '</p><p>', 'g'), '\n', '<br>', 'g') AS html FROM conversations""")
def markdown_html(spark, sf):
    source = F.concat(F.lit("### Reply\n**"), "role", F.lit("**\n- "), "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", text.markdown_html(source).alias("html"))


@query("SELECT event_id, round(epoch_us(ts) / 1000000.0::DOUBLE, 3) AS seconds FROM events")
def epoch_seconds(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 3).alias("seconds"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 1000")
def csv_export_last_n(spark, sf):
    return tables.last_rows(table(spark, sf, "events"), ["event_id", "user_id", "event_type"], 1000, "event_id")


# ---- crawl ----


def _seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


def _sorted_frontier(spark, sf):
    return table(spark, sf, "events").select(F.concat(F.lit("u"), "event_id").alias("url"), F.col("user_id").alias("domain"), _seconds().alias("schedule"))


@query("""WITH f AS (SELECT concat('u', event_id) AS url, user_id AS domain, epoch_us(ts) / 1000000.0::DOUBLE AS schedule FROM events), due AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY schedule, url) AS rn FROM f WHERE schedule <= 1.8e9)
SELECT url, domain, round(schedule, 3) AS schedule FROM due WHERE rn = 1 ORDER BY due.schedule, url LIMIT 99""")
def frontier_select(spark, sf):
    return crawl.select_due(_sorted_frontier(spark, sf), 1.8e9).withColumn("schedule", F.round("schedule", 3))


@query("WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS domain FROM pages), b AS (SELECT DISTINCT domain FROM u WHERE contains(domain, 'casino')) SELECT page_id, url, domain FROM u WHERE domain NOT IN (SELECT domain FROM b) AND NOT contains(url, 'page=2')")
def blocked_filter(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", "url", urls.domain(F.col("url")).alias("domain"))
    blocked = rows.where(F.col("url").contains("page=2"))
    return crawl.not_blocked(rows, blocked, rows.where(F.col("domain").contains("casino"))).select("page_id", "url", "domain")


@query("SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10")
def last_n_events(spark, sf):
    return crawl.last_events(table(spark, sf, "events"), "user_id", "ts", "event_id", 10).select("user_id", "event_id", "rn")


@query("""WITH a AS (SELECT event_id, user_id, event_type, ts, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS ch FROM events),
b AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM a) SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM b""")
def status_streak(spark, sf):
    return crawl.streaks(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id").select("event_id", "user_id", "streak")


#: Status codes that stand for the kinds of events.
_CODES = {"click": 200, "view": 301, "error": 404, "purchase": 503, "signup": 429}
_CODE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _CODES.items()) + " ELSE 0 END"


@query(f"""SELECT event_id, code, CASE code WHEN 404 THEN 2 WHEN 503 THEN 5 WHEN 429 THEN 10 WHEN 0 THEN 4 END AS ban_at, CASE code WHEN 404 THEN 1.0 WHEN 503 THEN 1.0 WHEN 429 THEN 0.5 WHEN 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS sample,
CASE WHEN code IN (404, 503, 429, 0) THEN 'backoff' ELSE 'none' END AS delay_kind FROM (SELECT event_id, {_CODE_SQL} AS code FROM events)""")
def status_policy(spark, sf):
    return table(spark, sf, "events").select("event_id", F.expr(_CODE_SQL).alias("code")).withColumns(crawl.status_policy(F.col("code")))


@query("SELECT event_id, round(greatest(CASE WHEN value > 3600 THEN 3600.0 ELSE value * 2 / 1.4::DOUBLE END, 1.5), 6) AS low, round(greatest(CASE WHEN value > 3600 THEN 3600.0 ELSE value * 2 END, 1.5), 6) AS high FROM events")
def backoff_bounds(spark, sf):
    bounds = crawl.backoff_bounds(F.col("value"), F.lit(1.5))
    return table(spark, sf, "events").select("event_id", F.round(bounds["low"], 6).alias("low"), F.round(bounds["high"], 6).alias("high"))


_DECAY = 1 / 86400
_UTEMA = "WITH s AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM events), l AS (SELECT user_id, max(t) AS last FROM s GROUP BY user_id)"


def _samples(spark, sf):
    return table(spark, sf, "events").select("user_id", _seconds().alias("t"), F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("v"))


@query(f"{_UTEMA} SELECT user_id, round(sum(exp(-(last - t) / 86400)), 6) AS n, round(sum(exp(-(last - t) / 86400) * v) / sum(exp(-(last - t) / 86400)), 6) AS average, count(*) AS samples FROM s JOIN l USING (user_id) GROUP BY user_id")
def utema_batch(spark, sf):
    rows = crawl.decayed_means(_samples(spark, sf), "user_id", "t", "v", _DECAY)
    return rows.withColumns({"n": F.round("n", 6), "average": F.round("average", 6)})


@query("SELECT event_id, used, greatest(0, 60 - used) AS remaining, round(100.0::DOUBLE * used / 60, 6) AS use_percent, reset FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS used, 3600 + min(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS reset FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events))")
def rate_window(spark, sf):
    rows = crawl.request_rates(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 3600)
    return rows.select("event_id", "used", "remaining", F.round("use_percent", 6).alias("use_percent"), "reset")


@query("""WITH RECURSIVE e AS (SELECT a.doc_id AS src, b.doc_id AS dst, a.source = b.source AS same FROM documents a JOIN documents b ON b.doc_id IN (2 * a.doc_id + 1, 2 * a.doc_id + 2)),
w AS (SELECT 0::BIGINT AS node, 0 AS l, 0 AS d UNION SELECT dst, CASE WHEN same THEN l ELSE l + 1 END, CASE WHEN same THEN d + 1 ELSE 0 END FROM w JOIN e ON src = node WHERE CASE WHEN same THEN l ELSE l + 1 END <= 5 AND CASE WHEN same THEN d + 1 ELSE 0 END <= 5)
SELECT node, min(l) AS link_depth, min(d) AS domain_depth FROM w GROUP BY node""")
def link_depths(spark, sf):
    docs = _documents(spark, sf).select("doc_id", "source")
    out = docs.select(F.col("doc_id").alias("src"), F.col("source").alias("from_source"), F.explode(F.array(F.expr("2 * doc_id + 1"), F.expr("2 * doc_id + 2"))).alias("dst"))
    edges = out.join(docs.select(F.col("doc_id").alias("dst"), F.col("source").alias("to_source")), "dst")
    return crawl.link_depths(spark.createDataFrame([(0,)], "node long"), edges.select("src", "dst", (F.col("from_source") == F.col("to_source")).alias("same_domain")))


@query("""WITH RECURSIVE m AS (SELECT event_id AS url, CASE WHEN event_id % 7 = 0 THEN event_id + 1 WHEN event_id % 7 = 1 THEN event_id + 1 WHEN event_id % 11 = 3 THEN event_id END AS location FROM events),
r AS (SELECT url, location FROM m WHERE location IS NOT NULL), w AS (SELECT url, location AS target, 1 AS hops FROM r UNION ALL SELECT w.url, r.location, hops + 1 FROM w JOIN r ON r.url = w.target WHERE hops < 5)
SELECT w.url, arg_max(w.target, hops) AS target, max(hops) AS hops, arg_max(w.target, hops) IN (SELECT url FROM r) AS is_loop FROM w GROUP BY w.url""")
def redirect_loops(spark, sf):
    moves = table(spark, sf, "events").selectExpr("event_id url", "case when event_id % 7 = 0 then event_id + 1 when event_id % 7 = 1 then event_id + 1 when event_id % 11 = 3 then event_id end location")
    return crawl.redirect_ends(moves)


# ---- analytics ----


@query(f"WITH {_DOMAIN_SCORES} SELECT domain, count(*) AS docs, round(sum(score), 4) AS total_score FROM ds GROUP BY domain")
def domain_clusters(spark, sf):
    return analytics.domain_clusters(_domain_scores(spark, sf)).withColumn("total_score", F.round("total_score", 4))


@query(f"""WITH {_DOMAIN_SCORES}, c AS (SELECT domain, sum(score) AS total FROM ds GROUP BY domain), m AS (SELECT min(score) AS least, max(score) AS most FROM ds)
SELECT doc_id, domain, round(18 + 32 * (score - least) / (most - least), 4) AS radius, round(30 + 220 * sqrt(total / (SELECT max(total) FROM c)), 4) AS cluster_radius FROM ds JOIN c USING (domain), m""")
def bubble_radius(spark, sf):
    return analytics.bubble_radii(_domain_scores(spark, sf)).select("doc_id", "domain", F.round("radius", 4).alias("radius"), F.round("cluster_radius", 4).alias("cluster_radius"))


@query(f"WITH {_DOMAIN_SCORES} SELECT query_num, doc_id, score, row_number() OVER (PARTITION BY query_num ORDER BY score DESC, concat(domain, doc_id)) AS rank FROM ds")
def exported_ranks(spark, sf):
    rows = _domain_scores(spark, sf).select(F.col("query_num").alias("query_id"), "doc_id", "score", F.concat("domain", "doc_id").alias("url"))
    return tables.exported_ranks(rows).select(F.col("query_id").alias("query_num"), "doc_id", "score", "rank")


@query("""WITH p AS (SELECT a.vec_id AS anchor_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 10) AS sim FROM embeddings a JOIN embeddings b ON a.label <> b.label WHERE a.vec_id % 50 = 0)
SELECT anchor_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY sim DESC, vec_id) AS rank FROM p) WHERE rank <= 5""")
def hard_negatives(spark, sf):
    """The stated anchors, every fiftieth vector, against all vectors."""
    rows = table(spark, sf, "embeddings")
    return analytics.hard_negatives(rows.where("vec_id % 50 = 0"), rows).select("anchor_id", "vec_id", "rank")


@query("SELECT vec_id, row_number() OVER (ORDER BY md5(concat('12:', vec_id)), vec_id) <= 100 AS is_test FROM embeddings")
def train_split(spark, sf):
    return analytics.train_split(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", 100).select("vec_id", "is_test")


@query("SELECT doc_id, CAST(quality AS DOUBLE) AS label FROM labels")
def labelled_pairs(spark, sf):
    pairs = analytics.labelled_pairs(table(spark, sf, "labels"), "doc_id", "toxic", "quality")
    return pairs.select(F.col("sentence1").alias("doc_id"), "label")


# ---- sources and sinks ----


@query("WITH old AS (SELECT doc_id, quality FROM labels) SELECT doc_id, quality FROM old UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM old)")
def insert_or_ignore(spark, sf):
    old = table(spark, sf, "labels").select("doc_id", "quality")
    return tables.insert_new(old, _documents(spark, sf).select("doc_id", F.lit(-1).alias("quality")), "doc_id")


@query("SELECT doc_id, CASE WHEN d.doc_id IS NOT NULL AND d.lang = 'en' THEN 9 ELSE quality END AS quality, CASE WHEN d.lang = 'en' AND l.doc_id IS NULL THEN NULL ELSE toxic END AS toxic FROM labels l FULL JOIN (SELECT doc_id, lang FROM documents WHERE lang = 'en') d USING (doc_id)")
def insert_or_replace(spark, sf):
    rows = _documents(spark, sf).where("lang = 'en'").select("doc_id", F.lit(9).alias("quality"))
    return tables.upsert(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), rows, "doc_id")


@query("SELECT max(event_id) + 1 AS next_id FROM events")
def next_id(spark, sf):
    return tables.next_id(table(spark, sf, "events"), "event_id")


@query("SELECT CAST(item_id AS VARCHAR) AS query_num, trim(split_part(trim(text), chr(9), 1)) AS query_text FROM benchmark")
def query_lines(spark, sf):
    """Query-file lines made of the benchmark, with a third field that is ignored."""
    lines = table(spark, sf, "benchmark").select(F.concat_ws("\t", F.col("item_id").cast("string"), "text", F.lit("extra")).alias("value"))
    return tables.parsed_queries(lines)


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'error'")
def read_where(spark, sf):
    return tables.read_columns(table(spark, sf, "events"), ["event_id", "event_type", "user_id"], ("event_type", "error"))


# ---- the index with titles, and kept by a stream ----

_TITLED = """toks AS (SELECT doc_id, """ + _tok("replace(substring(lower(concat_ws(' ', source, text)), 1, 1000000), 'licence', 'license')") + """ AS tokens FROM documents)"""


@query(f"WITH {_TITLED} SELECT term, count(DISTINCT doc_id) AS doc_freq, count(*) AS total_freq FROM (SELECT doc_id, unnest(tokens) AS term FROM toks) GROUP BY term")
def titled_term_counts(spark, sf):
    """Term counts of an index of title and text, lower-cased, with spellings replaced and cut to a million characters."""
    docs = _documents(spark, sf).select("doc_id", F.col("source").alias("title"), "text")
    return indexing.build(docs, "title", (("licence", "license"),), 1_000_000).terms.select("term", "doc_freq", "total_freq")


def _streamed(spark, sf: str, name: str, schema: str):
    """A table as a file stream; the pattern lets a single file be its folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/{name}.parque[t]")


def _ended(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives, written by batches to the checkpoint folder and read back with the batch's number."""
    spark = stream.sparkSession
    session.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{folder}/out").parquet(f"{folder}/out")


@query("SELECT user_id AS key, arg_max(event_type, epoch_us(ts) * 1000 + event_id % 1000) AS code FROM events GROUP BY user_id")
def stream_last_codes(spark, sf):
    """The code that each key's streak is of after the whole stream."""
    order = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("batch")))
    events = _streamed(spark, sf, "events", table(spark, sf, "events").schema)
    seq = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    runs = _ended(health.stream_streaks(events.select(F.col("user_id").cast("long").alias("key"), seq.alias("seq"), F.col("event_type").alias("code"))), "update")
    return runs.withColumn("rn", order).where("rn = 1").select("key", "code")


@query(f"{_UTEMA} SELECT user_id AS key, round(sum(exp(-(last - t) / 86400) * v) / sum(exp(-(last - t) / 86400)), 6) AS average FROM s JOIN l USING (user_id) GROUP BY user_id")
def stream_averages(spark, sf):
    """The decayed means of ``utema_batch``, kept by a stream."""
    order = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("batch")))
    events = _streamed(spark, sf, "events", table(spark, sf, "events").schema)
    samples = events.select(F.col("user_id").cast("long").alias("key"), _seconds().alias("t"), F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("v"))
    means = _ended(health.stream_decayed_means(samples, _DECAY), "update")
    return means.withColumn("rn", order).where("rn = 1").select("key", F.round("average", 6).alias("average"))


@query(f"WITH {_INDEX} SELECT term, doc_freq, total_freq FROM terms")
def stream_index(spark, sf):
    """Term counts of an index that a stream of documents keeps."""
    session.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    docs = _streamed(spark, sf, "documents", table(spark, sf, "documents").schema).select("doc_id", "text")
    docs.writeStream.foreachBatch(health.index_batch(f"{folder}/index")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return indexing.load_streamed(spark, f"{folder}/index").terms.select("term", "doc_freq", "total_freq")


@query("WITH RECURSIVE o AS (SELECT user_id AS domain, concat('u', lpad(CAST(event_id AS VARCHAR), 12, '0')) AS url, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events), r AS (SELECT domain, url, t AS release, rn FROM o WHERE rn = 1 UNION ALL SELECT o.domain, o.url, greatest(o.t, r.release + 3600), o.rn FROM r JOIN o ON o.domain = r.domain AND o.rn = r.rn + 1) SELECT domain, url, round(release, 3) AS release FROM r")
def stream_releases(spark, sf):
    """When each URL of a stream may be fetched, its domain's URLs an hour apart."""
    events = _streamed(spark, sf, "events", table(spark, sf, "events").schema)
    found = events.select(F.col("user_id").cast("string").alias("domain"), F.concat(F.lit("u"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("url"), _seconds().alias("t"))
    return _ended(health.stream_releases(found, 3600.0), "append").select(F.col("domain").cast("long").alias("domain"), "url", F.round("release", 3).alias("release"))


# ---- crawl upkeep, caches and requests ----


@query("WITH b AS (SELECT page_id, url, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS domain FROM pages WHERE contains(url, 'page=2')) SELECT page_id, url FROM b WHERE NOT contains(domain, 'casino')")
def blocked_cleanup(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", "url", urls.domain(F.col("url")).alias("domain"))
    return crawl.cleaned(rows.where(F.col("url").contains("page=2")), rows.where(F.col("domain").contains("casino"))).select("page_id", "url")


@query("WITH l AS (SELECT DISTINCT doc_id % 50 AS url, doc_id AS parent, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 7) / 10::DOUBLE END AS score FROM documents), p AS (SELECT doc_id AS parent, (doc_id % 11) / 10::DOUBLE AS stored FROM documents WHERE lang = 'en') SELECT CAST(url AS VARCHAR) AS url, round(sum(coalesce(score, stored, 0)), 6) AS incoming FROM l LEFT JOIN p USING (parent) GROUP BY url")
def incoming_lookup(spark, sf):
    """Incoming scores; links without one have their parent's, where it is an English document."""
    docs = _documents(spark, sf)
    links = docs.select((F.col("doc_id") % 50).cast("string").alias("url"), F.col("doc_id").alias("parent"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 7 / 10.0).alias("score"))
    pages = docs.where("lang = 'en'").select(F.col("doc_id").alias("url"), (F.col("doc_id") % 11 / 10.0).alias("score"))
    return crawl.incoming_scores(links, links, pages).select("url", F.round("incoming", 6).alias("incoming"))


@query("WITH p AS (SELECT doc_id, 'pending' AS lang FROM documents WHERE doc_id % 10 = 0) SELECT doc_id, coalesce(p.lang, d.lang) AS lang FROM documents d LEFT JOIN p USING (doc_id)")
def cache_overlay(spark, sf):
    docs = _documents(spark, sf).select("doc_id", "lang")
    return tables.overlay(docs.where("doc_id % 10 = 0").withColumn("lang", F.lit("pending")), docs, "doc_id")


@query("SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 'seen' ELSE source END AS source FROM documents")
def update_where(spark, sf):
    return tables.updated(_documents(spark, sf).select("doc_id", "lang", "source"), "lang", "en", source="seen")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 1000 WHEN event_id % 3 = 1 THEN CAST(greatest(0, floor(epoch(ts)) - 1700000000) AS BIGINT) END AS seconds FROM events")
def retry_after(spark, sf):
    """Retry headers made of events: seconds, HTTP dates and neither."""
    when = F.date_format(F.col("ts").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss")
    value = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 1000).cast("string")).when(F.col("event_id") % 3 == 1, F.concat(when, F.lit(" GMT"))).otherwise("soon")
    return table(spark, sf, "events").select("event_id", urls.retry_seconds(value, F.lit(1_700_000_000)).alias("seconds"))


@query("SELECT doc_id AS a_id, lang AS a_b_lang, n_chars FROM documents")
def flattened_rows(spark, sf):
    nested = F.struct(F.col("doc_id").alias("id"), F.struct("lang", "source").alias("b")).alias("a")
    return tables.flattened(_documents(spark, sf).select(nested, "n_chars"), skip=("source",))


@query("SELECT CAST(item_id AS VARCHAR) AS query_num, text AS query_text, 100 AS top_k FROM benchmark")
def json_requests(spark, sf):
    body = F.to_json(F.struct(F.col("text").alias("query"), F.col("item_id").cast("string").alias("query_id")))
    return tables.requests(table(spark, sf, "benchmark").select(body.alias("value")))


@query(f"WITH {_DOMAIN_SCORES} SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) <= 10 AS is_top FROM ds")
def top_highlight(spark, sf):
    return analytics.highlighted(_domain_scores(spark, sf).select("doc_id", "score")).select("doc_id", "is_top")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 500")
def training_load(spark, sf):
    return analytics.training_rows(_documents(spark, sf).select("doc_id", "lang"), 500, "doc_id")


@query("SELECT query_num, count(*) AS n, max(rank) AS last FROM (" + _scored("SELECT item_id AS query_num, text AS query_text FROM benchmark") + f" SELECT * FROM ({_RANKED}) WHERE rank <= 10) GROUP BY query_num")
def search_responses(spark, sf):
    """Results as JSON arrays, one row a query: how many each has, read back from the JSON."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_num"), F.col("text").alias("query_text"))
    docs = _documents(spark, sf)
    found = search.batch_search(docs, asked, Config(top_k_retrieval=10)).withColumns({c: F.lit("") for c in ("url", "title", "snippet", "domain")})
    held = F.from_json("documents", "array<struct<rank:int,doc_id:long>>")
    return search.responses(found, docs).select("query_num", F.size(held).cast("long").alias("n"), F.array_max(F.transform(held, lambda x: x["rank"])).cast("long").alias("last"))


@query("SELECT concat_ws(',', doc_id, quality, toxic) AS value FROM labels")
def csv_strings(spark, sf):
    """A CSV file of the labels, read back as strings."""
    session.ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/csv-{uuid.uuid4().hex}"
    tables.write_csv(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), path)
    return tables.csv_strings(spark, path)


@query("""WITH s AS (SELECT DISTINCT url, regexp_extract(url, '//([^/:]+)', 1) AS domain FROM pages), n AS (SELECT least(99, count(DISTINCT domain)) AS fetched FROM s)
SELECT (SELECT count(*) FROM s) - fetched AS frontier, fetched AS pages, 0 AS blocked_urls, 0 AS blocked_domains FROM n""")
def crawl_progress(spark, sf):
    """Counters after a round of a crawl whose seeds, and whose web, are the pages: one URL of each domain, 99 at most."""
    web = table(spark, sf, "pages").select("url", F.lit(200).alias("code"), "html").dropDuplicates(["url"])
    empty = crawling.CrawlState.seeded(spark, [], 0.0)
    seeds = web.select("url", urls.crawl_domain(F.col("url")).alias("domain"), F.lit(0.0).alias("schedule"), F.lit(1.5).alias("delay"), F.lit(0).alias("link_depth"), F.lit(0).alias("domain_depth"))
    state = replace(empty, frontier=seeds)
    return crawling.progress(crawling.crawl_round(state, lambda due: web.join(due, "url", "left_semi"), 1.0, _GROUPS))


@query("""WITH s AS (SELECT user_id AS key, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events)
SELECT a.key, round(a.t, 3) AS t, count(*) AS used, round(min(b.t) + 3600, 3) AS reset FROM s a JOIN s b ON a.key = b.key AND b.t > a.t - 3600 AND (b.t < a.t OR (b.t = a.t AND b.event_id <= a.event_id)) GROUP BY a.key, a.event_id, a.t""")
def stream_rates(spark, sf):
    """Requests within an hour, and when the oldest of them leaves, kept by a stream."""
    events = _streamed(spark, sf, "events", table(spark, sf, "events").schema)
    rates = _ended(health.stream_rates(events.select(F.col("user_id").cast("long").alias("key"), _seconds().alias("t")), 3600, 1_000_000), "append")
    return rates.select("key", F.round("t", 3).alias("t"), "used", F.round("reset", 3).alias("reset"))


@query("SELECT doc_id, ['de', 'en'] AS langs FROM documents WHERE lang IN ('de', 'en') UNION ALL SELECT doc_id, list_sort(['de', 'en', lang]) FROM documents WHERE lang NOT IN ('de', 'en')")
def sorted_insert(spark, sf):
    values = analytics.with_item(F.array(F.lit("de"), F.lit("en")), F.col("lang"))
    return _documents(spark, sf).select("doc_id", values.alias("langs"))
