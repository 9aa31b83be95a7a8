"""Crawl operators, sources, cleaning, HTML and streams on worked cases."""

import time

import pytest
from pyspark.sql import functions as F

from textloom.operators import analytics, cleaning, crawl
from textloom.operators.html import parse_page
from textloom.sources import tables
from textloom.streaming import health


def test_decayed_mean(spark):
    df = spark.createDataFrame([("d", 0.0, 1.0), ("d", 5.0, 0.0), ("d", 6.0, 1.0), ("d", 30.0, 0.5), (None, 1.0, 1.0)], "k string, t double, v double")
    row = crawl.decayed_means(df, "k", "t", "v", 0.2).first()
    assert (row.n, row.average) == pytest.approx((1.017446, 0.501951), abs=1e-6)
    twice = crawl.decayed_means(df, "k", "t", "v", 0.2, count_first_twice=True).first()
    assert twice.average == pytest.approx(0.503162, abs=1e-6)


def test_streaks_reset_on_change(spark):
    df = spark.createDataFrame([("u", 1, 404), ("u", 2, 404), ("u", 3, 500), ("u", 4, 404)], "url string, seq int, code int")
    assert [r.streak for r in crawl.streaks(df, "url", "code", "seq").orderBy("seq").collect()] == [1, 2, 1, 1]


def test_frontier(spark):
    df = spark.createDataFrame([("u1", "a", 10.0), ("u2", "a", 20.0), ("u3", "b", 90.0), ("u4", "c", 150.0)], "url string, domain string, schedule double")
    assert [r.url for r in crawl.select_due(df, 100.0).collect()] == ["u1", "u3"]


def test_depths(spark):
    seeds = spark.createDataFrame([("s",)], "node string")
    edges = spark.createDataFrame([("s", "p", True), ("s", "q", False), ("p", "q", False), ("q", "s", False)], "src string, dst string, same_domain boolean")
    got = {r.node: (r.link_depth, r.domain_depth) for r in crawl.link_depths(seeds, edges).collect()}
    assert got == {"s": (0, 0), "p": (0, 1), "q": (1, 0)}


def test_depths_of_long_and_meeting_paths(spark):
    """All 35 hops that the limits allow; and a node's two depths from different paths don't make a path of their own."""

    def depths(edges):
        found, todo = set(), [("s", 0, 0)]
        while todo:
            if (state := todo.pop()) not in found and max(state[1:]) <= 5:
                found.add(state)
                todo += [(dst, state[1], state[2] + 1) if same else (dst, state[1] + 1, 0) for src, dst, same in edges if src == state[0]]
        return {n: (min(x for m, x, _ in found if m == n), min(x for m, _, x in found if m == n)) for n, _, _ in found}

    hops = ["s", *[f"p{k}" for k in range(1, 38)]]
    chain = [(a, b, k % 6 != 5) for k, (a, b) in enumerate(zip(hops, hops[1:], strict=False))]
    # m is 5 hops within the domain from s, or 1 link: n is one hop further, which only the link's path may go.
    meeting = [("s", "q1", True), *[(f"q{k}", f"q{k + 1}", True) for k in range(1, 4)], ("q4", "m", True), ("s", "m", False), ("m", "n", True)]
    seeds = spark.createDataFrame([("s",)], "node string")
    for edges, some in ((chain, {"p11": (1, 5), "p35": (5, 5)}), (meeting, {"m": (0, 0), "n": (1, 1)})):
        got = {r.node: (r.link_depth, r.domain_depth) for r in crawl.link_depths(seeds, spark.createDataFrame(edges, "src string, dst string, same_domain boolean")).collect()}
        assert got == depths(edges) and some.items() <= got.items() and "p36" not in got


def test_robots(spark):
    robots = "User-agent: *\nDisallow: /private # no\nAllow: /private/ok\nCrawl-delay: 2\n\nUser-agent: bad\nUser-agent: worse\nDisallow: /\n"
    df = spark.createDataFrame([("a", robots), ("b", None)], "domain string, robots string")
    got = {r.domain: (r.allowed, r.forbidden, r.delay) for r in crawl.robots_rules(df).collect()}
    assert got == {"a": (["/private/ok"], ["/private"], 2.0), "b": ([], [], 1.5)}


def test_redirects(spark):
    moves = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "x"), ("z", None)], "url string, location string")
    got = {r.url: (r.target, r.hops, r.is_loop) for r in crawl.redirect_ends(moves).collect()}
    assert got == {"a": ("c", 2, False), "b": ("c", 1, False), "x": ("x", 5, True)}


def test_status_policy(spark):
    df = spark.createDataFrame([(0,), (204,), (404,), (429,), (508,), (700,)], "code int")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in crawl.status_policy(F.col("code")).items()]).collect()]
    assert got == [(4, 1.0, "backoff"), (None, 0.0, "none"), (2, 1.0, "backoff"), (10, 0.5, "backoff"), (3, 0.75, "hour"), (3, 0.4, "backoff")]


def test_query_lines(spark):
    lines = spark.createDataFrame([("1\tcastle",), ("  ",), ("bad line",), ("2\ta b\textra",)], "value string")
    assert sorted(map(tuple, tables.parsed_queries(lines).collect())) == [("1", "castle"), ("2", "a b")]


def test_run_file_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", 1, "u", 0.12345), ("1", 2, "v", 0.1)], "query_num string, rank int, url string, score double")
    tables.write_run(rows, str(tmp_path / "run"))
    assert [r.value for r in spark.read.text(str(tmp_path / "run")).collect()] == ["1\t1\tu\t0.123", "1\t2\tv\t0.100"]
    tables.write_csv(rows.select("url", "rank"), str(tmp_path / "csv"))
    assert sorted(r.value for r in tables.csv_strings(spark, str(tmp_path / "csv")).collect()) == ["u,1", "v,2"]


def test_marked_json(spark):
    df = spark.createDataFrame([('jsonDumps[["u", 0.5]]',), ("plain",), (None,)], "x string")
    got = [r[0] for r in df.select(tables.from_marked_json(F.col("x"), "array<array<string>>")).collect()]
    assert got == [[["u", "0.5"]], None, None]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, n int")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, name string")
    assert sorted(map(tuple, tables.upsert(old, new, "id").collect())) == [(1, "a", 5), (2, "B", 6), (3, "C", None)]
    more = spark.createDataFrame([(2, "x", 0), (4, "y", 1), (4, "z", 2)], "id int, name string, n int")
    assert sorted(map(tuple, tables.insert_new(old, more, "id").collect())) == [(1, "a", 5), (2, "b", 6), (4, "y", 1)]
    assert [tuple(r) for r in tables.updated(old, "id", 1, name="q").orderBy("id").collect()] == [(1, "q", 5), (2, "b", 6)]


def test_clean_merge(spark):
    old = spark.createDataFrame([(3, "a")], "doc_id long, url string")
    new = spark.createDataFrame([(1, "a", 0), (2, "c", 0), (5, "b", 0), (6, "b", 0)], "doc_id long, url string, more int")
    got = cleaning.clean_merge(old, new, F.col("url"), F.lit(True)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(3, "a"), (4, "c"), (5, "b")]


def test_running_ids_are_numbered_in_many_ranges(spark):
    """Ranges stay many although their ids are small, so that no task gets all rows with their texts."""
    rows = spark.createDataFrame([(k * 7 % 501, "x" * 50) for k in range(501)], "doc_id long, text string")
    got = cleaning.with_running_ids(rows, "doc_id")
    assert sorted((r.doc_id, r.running, len(r.text)) for r in got.collect()) == [(k, k + 1, 50) for k in range(501)]
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_html():
    page = '<html><head><title> T </title></head><body><nav><a href="/n">n</a></nav><article><h1>H</h1><p>a&amp;b <a href="/x?y=1">l</a></p><div class="ad">no</div><br><a href="/sitemap.xml">s</a><a href="mailto:q">m</a></article><footer>f</footer></body></html>'
    assert parse_page(page, "https://h.de/p") == ("T", "H a&b l s m", ["https://h.de/x?y=1"])
    assert parse_page(None, None) == ("Untitled", "", [])
    assert parse_page("<p>x <b>y", "") == ("Untitled", "x y", [])


def test_html_references_of_the_sql(spark, tmp_path):
    """References that a cut left open, and those that the SQL doesn't decode in titles, give the rows of the SQL."""
    import duckdb

    from textloom.queries import ORACLES, QUERIES

    heads = ["a &amp;&amp", "b = &quot;c", "d &quot", "&lt;e &#x2", "f &amp;lt; &eacute;"]
    pages = [(k, f"https://h.de/{k}", f'<html><head><title>{h}</title></head><body><article><h1>{h}</h1><p>x &quot;y&quot; <a href="/z?p=1&amp;q={k}">l</a></p></article></body></html>') for k, h in enumerate(heads)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("heading_title", "html_extract", "page_title"):
        ours = [r.asDict() for r in QUERIES[name](spark, str(tmp_path)).orderBy("page_id").collect()]
        assert ours == sorted(con.execute(ORACLES[name]).to_arrow_table().to_pylist(), key=lambda r: r["page_id"]), name
    assert parse_page(pages[1][2], None)[0] == 'b = "c'  # the engine's own parsing still decodes as browsers do


def test_hard_negatives_and_split(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.8, 0.3], 2), (3, [0.0, 1.0], 2)], "vec_id int, embedding array<double>, label int")
    got = analytics.hard_negatives(df.where("vec_id = 0"), df, 1).collect()
    assert [(r.anchor_id, r.vec_id, r["rank"]) for r in got] == [(0, 2, 1)]
    assert analytics.train_split(df, "vec_id", 2).where("is_test").count() == 2


def test_hard_negatives_of_blocks(spark, monkeypatch):
    """Blocks of anchors and pool give the rows of a comparison by columns, with ties, zero, null and short vectors."""
    import numpy as np

    from textloom.functions.vectors import cosine

    some = np.random.default_rng(3).normal(size=(40, 8)).astype(np.float32)
    rows = [(k, [float(x) for x in some[k % 40]], k % 3) for k in range(200)]
    rows += [(200, [0.0] * 8, 1), (201, None, 2), (202, [1.0], 1), (203, rows[0][1], None), (204, [1.0, None] * 4, 0), (205, [float("nan")] * 8, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    anchors = df.where("vec_id % 5 = 0")
    pairs = anchors.selectExpr("vec_id anchor_id", "embedding av", "label al").join(df, F.expr("anchor_id <> vec_id and al <> label"))
    pairs = pairs.withColumn("similarity", F.round(cosine(F.col("av"), F.col("embedding")), 10)).selectExpr("*", "row_number() over (partition by anchor_id order by similarity desc, vec_id) place")
    want = {(r.anchor_id, r.vec_id, repr(r.similarity), r.place - 2) for r in pairs.where("place between 3 and 9").collect()}
    for name, n in {"BLOCK_ANCHORS": 17, "BLOCK_POOL": 33, "SLICE_ANCHORS": 5}.items():
        monkeypatch.setattr(analytics, name, n)
    got = analytics.hard_negatives(anchors, df, 7, (2, 100))
    assert {(r.anchor_id, r.vec_id, repr(r.similarity), r["rank"]) for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString()  # no pair of rows is a row of its own


def _drain(query):
    query.processAllAvailable()
    query.stop()


def test_streams_equal_batches(spark, tmp_path):
    rows = [(k % 3, float(k), float(k % 2)) for k in range(30)]
    (tmp_path / "in").mkdir()
    df = spark.createDataFrame(rows, "key long, t double, v double")
    df.where("t < 15").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    time.sleep(0.1)
    df.where("t >= 15").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got: dict = {}

    def keep(batch, _):
        got.update({r.key: (r.n, r.average) for r in batch.collect()})

    _drain(health.stream_decayed_means(stream, 0.1).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c1")).start())
    wanted = {r.key: (r.n, r.average) for r in crawl.decayed_means(df, "key", "t", "v", 0.1).collect()}
    assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k]) for k in got)

    docs = spark.createDataFrame([(k, f"word{'ab'[k % 2]} shared") for k in range(6)], "doc_id long, text string")
    (tmp_path / "docs").mkdir()
    docs.where("doc_id < 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs.where("doc_id >= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "docs"))
    _drain(stream.writeStream.foreachBatch(health.index_batch(str(tmp_path / "index"))).option("checkpointLocation", str(tmp_path / "c2")).start())
    assert spark.read.parquet(str(tmp_path / "index/documents")).count() == 6
    assert spark.read.parquet(str(tmp_path / "index/postings")).count() == 12


def test_overlay_and_seeds(spark):
    stored = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "url string, n int, t string")
    pending = spark.createDataFrame([("b", None, "z"), ("c", 3, None)], "url string, n int, t string")
    got = sorted(map(tuple, tables.overlay(pending, stored, "url").collect()))
    assert got == [("a", 1, "x"), ("b", 2, "z"), ("c", 3, None)]
    assert sorted(r.url for r in tables.seed_urls(spark, ["a", " a ", "", "b"]).collect()) == ["a", "b"]
