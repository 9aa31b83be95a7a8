"""BM25, windows and reranking on worked cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.config import Config
from textloom.operators import bm25, chunks, rerank
from textloom.plans import indexing, search

DOCS = [(1, "old town castle castle"), (2, "river walk"), (3, "castle garden river river"), (4, "library hours"), (5, "garden library")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.mark.parametrize(
    ("query", "wanted"),
    [
        ("castle", [(1, 0.179312), (3, 0.124330)]),
        ("castle river", [(3, 0.303642), (1, 0.179312), (2, 0.165469)]),
        ("castle castle unknown", [(1, 0.358625), (3, 0.248660)]),
        ("unknown", []),
        ("the of", []),
    ],
)
def test_worked_scores(spark, docs, query, wanted):
    asked = spark.createDataFrame([("q", query)], "query_num string, query_text string")
    got = [(r.doc_id, r.score) for r in bm25.search(docs, asked).orderBy("rank").collect()]
    assert [g[0] for g in got] == [w[0] for w in wanted]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in wanted], abs=1e-6)


def test_common_terms_are_negative_and_dropped(spark, docs):
    more = docs.unionByName(spark.createDataFrame([(6, "castle"), (7, None), (8, "")], "doc_id long, text string"))
    asked = spark.createDataFrame([("q", "castle")], "query_num string, query_text string")
    scored = {r.doc_id: r.score for r in bm25.score(more, asked).collect()}
    assert set(scored) == {1, 3, 6}


def test_incremental_equals_rebuilt(spark, docs):
    whole = indexing.build(docs)
    grown = indexing.extend(indexing.build(docs.where("doc_id <= 2")), docs)
    for name, keys in (("documents", "doc_id"), ("postings", "term"), ("terms", "term"), ("stats", "total_docs")):
        a, b = getattr(whole, name), getattr(grown, name)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect())), (name, keys)


@pytest.mark.parametrize(
    ("n", "w", "s", "starts"),
    [(5, 10, 4, [0]), (10, 10, 4, [0]), (18, 10, 4, [0, 4, 8]), (19, 10, 4, [0, 4, 8, 9]), (513, 512, 450, [0, 1]), (962, 512, 450, [0, 450]), (1000, 512, 450, [0, 450, 488])],
)
def test_window_starts(spark, n, w, s, starts):
    assert spark.range(1).select(chunks.window_starts(F.lit(n), w, s)).first()[0] == starts


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(2, 12), st.integers(1, 12))
def test_windows_cover_all_words(spark, sizes, window, step):
    step = min(step, window)
    rows = [(k, " ".join(f"w{j}" for j in range(n))) for k, n in enumerate(sizes)]
    got = chunks.with_chunk_ids(chunks.sliding_windows(spark.createDataFrame(rows, "doc_id long, text string"), window, step), 7).collect()
    for k, n in enumerate(sizes):
        own = [r for r in got if r.doc_id == k]
        assert {w for r in own for w in r.chunk_text.split()} == {f"w{j}" for j in range(n)}
        assert all(r.n_words <= window for r in own)
    assert sorted(r.chunk_id for r in got) == list(range(7, 7 + len(got)))
    assert [(r.doc_id, r.pos) for r in sorted(got, key=lambda r: r.chunk_id)] == sorted((r.doc_id, r.pos) for r in got)


def test_fusion(spark):
    df = spark.createDataFrame([("q", 1, 0.9, 2.0), ("q", 2, 0.5, 8.0), ("q", 3, 0.1, 5.0), ("e", 4, 0.3, 1.0), ("e", 5, 0.3, 1.0)], "query_num string, chunk_id int, similarity double, lexical double")
    assert [r.fused for r in rerank.fused(df).orderBy("chunk_id").collect()] == pytest.approx([0.85, 0.575, 0.075, 0.0, 0.0])


@pytest.mark.parametrize(
    ("given_scores", "adjusted", "best"),
    [([0.9], [0.9], 0.9), ([0.5, 0.3], [0.6, 0.3], 0.6), ([0.3, 0.5], [0.3, 0.45], 0.45), ([0.2, 0.95, 0.1], [0.2, 0.975, 0.1], 0.975), ([0.48, 0.2, 0.5], [0.48, 0.2, 0.45], 0.48), ([0.98, 0.1], [1, 0.1], 1)],
)
def test_positional_weight(spark, given_scores, adjusted, best):
    df = spark.createDataFrame([("q", 1, k, float(s)) for k, s in enumerate(given_scores)], "query_num string, doc_id int, chunk_id int, fused double")
    rows = rerank.positional(df)
    assert [r.adjusted for r in rows.orderBy("chunk_id").collect()] == pytest.approx(adjusted)
    assert rerank.best_chunk(rows, "adjusted").first().adjusted == pytest.approx(best)


@pytest.mark.parametrize(
    ("top_k", "wanted"),
    [
        (1, [("a", 0.95)]),
        (3, [("a", 0.95), ("c", 0.85), ("d", 0.7)]),
        (4, [("a", 0.95), ("c", 0.85), ("d", 0.7), ("f", 0.4)]),
        (5, [("a", 0.95), ("c", 0.85), ("d", 0.7), ("f", 0.4), ("b", 0.3999)]),
        (7, [("a", 0.95), ("c", 0.85), ("d", 0.7), ("f", 0.4), ("b", 0.3999), ("e", 0.0999), ("g", 0.0)]),
    ],
)
def test_diversification(spark, top_k, wanted):
    rows = [("a", "x", 0.95), ("b", "x", 0.90), ("c", "y", 0.85), ("d", "z", 0.70), ("e", "z", 0.60), ("f", "w", 0.40), ("g", "x", 0.30)]
    df = spark.createDataFrame([("q", *r) for r in rows], "query_num string, doc_id string, domain string, score double")
    got = rerank.diversified(df, top_k, 0.8).orderBy(F.desc("final_score"), "doc_id").collect()
    assert [r.doc_id for r in got] == [w[0] for w in wanted]
    assert [r.final_score for r in got] == pytest.approx([w[1] for w in wanted])


def test_responses(spark, docs):
    results = spark.createDataFrame([("q", 1, "u1", 0.5, "t", "s", "d", 2), ("q", 2, "u2", 0.4, "t", "s", "d", 1)], "query_num string, rank int, url string, score double, title string, snippet string, domain string, doc_id long")
    row = search.responses(results, docs).first()
    assert row.context == "Text Window 1:\nriver walk\n\nText Window 2:\nold town castle castle"
    assert row.documents.startswith('[{"rank":1')


def test_stored_index_gives_the_same_results(spark, docs, tmp_path):
    asked = spark.createDataFrame([("q", "castle river"), ("r", "garden"), ("s", "unknown")], "query_num string, query_text string")
    indexing.save(indexing.build(docs), str(tmp_path))
    found = search.index_search(indexing.load(spark, str(tmp_path)), asked)
    a, b = (sorted((r.query_num, r["rank"], r.doc_id, round(r.score, 9)) for r in x.collect()) for x in (found, search.batch_search(docs, asked)))
    assert a == b and len(a) == 5


def test_search_plan(spark, tmp_path):
    """Query terms are broadcast, each task keeps its own top rows before the shuffle, and stored texts aren't read."""
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    asked = spark.createDataFrame([("q", "castle")], "query_num string, query_text string")
    indexing.save(indexing.build(docs), str(tmp_path / "index"))
    plan = search.index_search(indexing.load(spark, str(tmp_path / "index")), asked)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "WindowGroupLimit" in plan and "CartesianProduct" not in plan and ",text:string" not in plan


def test_queries_are_scored_where_documents_stand(spark, monkeypatch, tmp_path):
    """The best of each task, whatever the slices, are those of all scores; no document is shuffled for each of its queries."""
    words = ["castle", "wall", "tower", "the", "moat", "Gate"]
    rows = [(k, " ".join(words[(k * j + j * j) % 6] for j in range(k % 9))) for k in range(300)] + [(300, None), (301, "castle castle 7"), (302, "castle castle 7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(1, "castle wall wall"), (2, "moat the gate"), (None, "tower"), (4, "nothing"), (5, "")], "query_num int, query_text string")
    config = Config(top_k_retrieval=7, min_score=-2.0)
    want = {tuple(r) for r in bm25.ranked(bm25.score(docs, asked, config), 7, -2.0).select("query_num", "rank", "doc_id", F.round("score", 9)).collect()}
    assert len({q for q, *_ in want}) == 3
    for name, n in {"SLICE_HITS": 5, "SLICE_SCORES": 7}.items():
        monkeypatch.setattr(bm25, name, n)
    found = bm25.search(docs, asked, config)
    assert {tuple(r) for r in found.select("query_num", "rank", "doc_id", F.round("score", 9)).collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan
    indexing.save(indexing.build(docs), str(tmp_path))
    again = search.index_search(indexing.load(spark, str(tmp_path)), asked, config)
    assert {tuple(r) for r in again.select("query_num", "rank", "doc_id", F.round("score", 9)).collect()} == want
    monkeypatch.setattr(bm25, "ROW_TERMS", 2)  # more terms than tasks could hold are joined
    assert {tuple(r) for r in bm25.search(docs, asked, config).select("query_num", "rank", "doc_id", F.round("score", 9)).collect()} == want


def test_streamed_batches_keep_one_row_of_an_id(spark):
    """Repeated ids, null ones too, stand once; without any, no text is shuffled."""
    from textloom.streaming.health import _once

    rows = [(1, "a b"), (2, "c"), (1, "a b"), (None, "d"), (None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, _once(df).collect()), key=str) == [(1, "a b"), (2, "c"), (None, "d")]
    assert "Exchange" not in _once(df.where("doc_id = 2"))._jdf.queryExecution().executedPlan().toString()


def test_index_counts_batches_before_the_shuffle(spark, docs):
    """Terms are added up in Arrow batches, and are those of the postings."""
    index = indexing.build(docs)
    assert "MapInArrow" in index.terms._jdf.queryExecution().executedPlan().toString()
    want = {tuple(r) for r in index.postings.groupBy("term").agg(F.count("*"), F.sum("freq")).collect()}
    assert {tuple(r) for r in index.terms.select("term", "doc_freq", "total_freq").collect()} == want
    tokenised = bm25.tokenized(docs)
    assert sorted(map(tuple, index.postings.collect())) == sorted(map(tuple, bm25.term_freq(tokenised).collect()))
    assert sorted(map(tuple, index.documents.collect())) == sorted(map(tuple, bm25.document_stats(tokenised).collect()))


def test_words_of_batches_are_the_tokens(spark):
    """Every character is a letter or not, alone and beside others, as for ``tokens``; words don't cross rows."""
    rows = [(k, "".join(chr(c) + "-" * (c % 3) for c in range(4096 * k, 4096 * k + 4096) if not 0xD800 <= c < 0xE000)) for k in range(272)]
    rows += [(300, None), (301, ""), (302, "ab"), (303, "cd"), (304, "é"), (305, "éa"), (306, "7"), (307, "The İstanbul ΣΑΣ"), (308, "\U00010400\U00010401"), (None, "x x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokenised, words = bm25.tokenized(docs), bm25.words(docs)
    postings, lengths = ({tuple(r) for r in f(tokenised).collect()} for f in (bm25.term_freq, bm25.document_stats))
    assert {tuple(r) for r in bm25.word_postings(words).collect()} == postings and len(postings) > 80_000
    assert {tuple(r) for r in bm25.word_lengths(words).collect()} == lengths
    stats = bm25.word_stats(words)
    assert {tuple(r) for r in stats.where("doc_length is not null").select("doc_id", "doc_length").collect()} == lengths
    counts = {tuple(r) for r in bm25.summed(stats.where("term is not null")).collect()}
    assert counts == {tuple(r) for r in bm25.word_counts(words).collect()} and sum(c[2] for c in counts) == sum(n for _, n in lengths)


@pytest.mark.parametrize("few", [2_000_000, 0])
def test_extended_index_reads_texts_once(spark, monkeypatch, tmp_path, few):
    """Lengths, term counts and idf of a grown index read no text again; texts meet few ids without a shuffle."""
    monkeypatch.setattr(bm25, "BROADCAST_IDS", few)
    rows = [*DOCS, (6, None), (7, "the 12"), (8, "Moat moat gate"), (1, "tower"), (9, "wall"), (9, None), (None, "keep")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    whole, first = indexing.build(docs), docs.where("doc_id <= 2 or doc_id = 6")
    grown = indexing.extend(indexing.counted(first), docs)
    for name in ("documents", "postings", "terms", "stats"):
        a, b = getattr(whole, name), getattr(grown, name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect())), name
        if name != "postings":
            plan = b._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" not in plan and "text:string" not in plan
    lacked = bm25.unindexed(docs, grown.documents.where("doc_id < 3"))._jdf.queryExecution().analyzed().toString()
    assert ("strategy=broadcast" in lacked) == (few > 0)
