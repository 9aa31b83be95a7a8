"""Scalar columns on small literals."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import scores, text, urls


def values(spark, rows, kind, make):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, x {kind}")
    return [r.v for r in df.select("k", make(F.col("x")).alias("v")).orderBy("k").collect()]


def test_query_rewrite(spark):
    rows = ["food and drinks", "castle hohentubingen history", "", "  TUEBINGEN bus ", None]
    got = values(spark, rows, "string", lambda x: text.rewritten_query(x, "tübingen", ("tuebingen", "tubingen")))
    assert got == ["food and drinks tübingen", "castle hohentübingen history", "tübingen", "tübingen bus", "tübingen"]
    assert values(spark, [" A b "], "string", lambda x: text.rewritten_query(x, "")) == ["a b"]


def test_normalised_document(spark):
    got = values(spark, ["Die STADT Tuebingen", None], "string", lambda x: text.normalised(F.lit("T"), x, (("tuebingen", "tübingen"),), 12))
    assert got == ["t die stadt ", "t "]


def test_url_normal_forms(spark):
    rows = ["https://a.de/p?q=1", "a.de/p/?q=1", "https://a.de/p/?q=1", None]
    assert values(spark, rows, "string", lambda x: urls.normalised_url(x, strict=True)) == ["a.de/p?q=1", "a.de/p", "a.de/p/?q=1", None]
    assert values(spark, rows, "string", urls.normalised_url) == ["a.de/p", "a.de/p", "a.de/p", None]


def test_domains(spark):
    assert values(spark, ["https://WWW.A.de:80/p", "nothing"], "string", urls.crawl_domain) == ["WWW.A.de", None]
    assert values(spark, ["https://WWW.A.de:80/p", None], "string", urls.domain) == ["www.a.de:80", ""]
    rows = ["https://www.uni-tuebingen.de/en", "https://blog.a.co.uk/", "http://localhost:5000/x", "#", None]
    assert values(spark, rows, "string", urls.domain_topic) == ["uni-tuebingen", "co", "localhost5000", "unknown", "unknown"]


def test_url_score(spark):
    rows = ["https://uni-tuebingen.de/en/", "https://a.de/statue", "https://a.de/b/c/d/e/f/g/h/i", "https://a.de/en", "https://www.medizin.uni-tuebingen.de/en-de/x", None]
    got = values(spark, rows, "string", lambda x: urls.url_score(x, ("tuebingen", "tübingen", "uni-tuebingen", "tue"), ".uni-tuebingen.de"))
    assert got == pytest.approx([0.7, 0.5, 0.0, 0.2, 0.7, 0.0])


def test_page_score(spark):
    rows = [(1.0, 0.9, 3.0, 0, 0), (0.5, 0.5, 1.0, 1, 2), (0.2, 0.2, 3.0, 0, 3), (1.0, 1.0, 3.0, 6, 0), (1.0, 1.0, 3.0, 5, 5)]
    df = spark.createDataFrame(rows, "t double, u double, i double, l int, d int")
    got = [r[0] for r in df.select(scores.page_score(F.col("t"), F.col("u"), F.col("i"), F.col("l"), F.col("d"))).collect()]
    assert got == pytest.approx([0.925, 0.366667, 0.339, 0.0, 0.475], abs=1e-6)


def test_snippet_and_reasoning(spark):
    assert values(spark, ["x" * 200, "x" * 201, "", None], "string", text.snippet) == ["x" * 200, "x" * 200 + "...", "No content available", "No content available"]
    assert values(spark, ["<think>x</think> y", " z "], "string", text.without_reasoning) == ["y", "z"]


def test_terms_are_whole_words_in_any_script(spark):
    rows = ["a lab, two Labs", "ülab slab", "übung macht", None]
    assert values(spark, rows, "string", lambda x: text.term_hits(x, ["lab", "übung"])) == [1, 0, 1, 0]


def test_longest_prefix_and_retry(spark):
    rules = F.array(F.lit("/a"), F.lit("/a/b"), F.lit("/x"))
    assert values(spark, ["/a/b/c", "/q", None], "string", lambda x: urls.longest_prefix(x, rules)) == [4, 0, 0]
    rows = ["120", "Thu, 01 Jan 1970 00:02:00 GMT", "soon"]
    assert values(spark, rows, "string", lambda x: urls.retry_seconds(x, F.lit(60))) == [120, 60, None]


def test_site_score_lowers_a_text_once(spark):
    """Many terms neither lower the text for each of them nor outgrow a generated method."""
    from textloom.functions.terms import TERMS

    df = spark.createDataFrame([("The University of Tübingen and its lecture halls", True), (None, True), ("Tübingen", False)], "text string, english boolean")
    score = scores.text_score(F.col("text"), F.col("english"), TERMS, ["germany"])
    assert df.select(score.alias("s"))._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    got = [r.s for r in df.select(score.alias("s")).collect()]
    assert got[0] > 0 and got[1:] == [0.0, 0.0]
