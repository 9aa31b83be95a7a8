"""Crawl rounds over a small made-up web, and the service functions."""

from pyspark.sql import functions as F

from textloom import api
from textloom.operators.crawl import incoming_scores
from textloom.plans.crawling import TABLES, CrawlState, crawl_round, progress, run_crawl, snapshots

GROUPS = {"phrases": ["castle"], "city": ["town"], "university": ["school"], "faculty": ["science"], "academic": ["lab", "library", "study"]}
TEXT = "the castle of the town and the school of science, a lab, a library to study in the town"
WEB = {
    "https://a.de/": (200, f'<article>{TEXT}<a href="/one">1</a><a href="https://b.de/x">2</a></article>'),
    "https://a.de/one": (404, ""),
    "https://b.de/x": (200, "<article>nothing</article>"),
}


def fetched(spark, web):
    rows = [(u, c, h, m) for u, (c, h, m) in ((u, (*v, None)[:3]) for u, v in web.items())]
    table = spark.createDataFrame(rows, "url string, code int, html string, location string")
    return lambda due: table.join(due, "url", "left_semi")


def test_a_crawl_stops_and_goes_on(spark, tmp_path):
    """Rounds with a stop in between; links, failures, scores and what is left."""
    now = [0.0]

    def wait(seconds):
        now[0] += max(seconds, 1.0)

    def crawl(rounds=None, seeds=("https://a.de/", "no url")):
        return run_crawl(spark, str(tmp_path / "state"), seeds, fetched(spark, WEB), GROUPS, lambda: now[0], wait, rounds=rounds, url_names=("a.de",), site=".b.de")

    first = crawl(rounds=1)
    assert {r.url for r in first.pages.collect()} == {"https://a.de/"} and first.frontier.count() == 2
    assert {r.schedule for r in first.frontier.collect()} == {1.5}
    state = crawl(seeds=())
    pages = {r.url: r for r in state.pages.collect()}
    assert set(pages) == {"https://a.de/", "https://b.de/x"}
    assert pages["https://a.de/"].score > 0.5 and (pages["https://b.de/x"].link_depth, pages["https://b.de/x"].domain_depth) == (1, 0)
    assert pages["https://b.de/x"].incoming == pages["https://a.de/"].score
    assert [(r.url, r.reason) for r in state.blocked_urls.collect()] == [("https://a.de/one", "code 404")]
    assert progress(state).first().asDict() == {"frontier": 0, "pages": 2, "blocked_urls": 1, "blocked_domains": 0}
    assert len(snapshots(spark, str(tmp_path / "state"))) == 2


def test_redirects_bans_and_delays(spark):
    """A redirect's end takes its place, a loop is blocked, a domain that only fails is banned; each answer is asked once."""
    web = {"https://a.de/old": (301, "", "https://a.de/new"), "https://l.de/1": (302, "", "https://l.de/2"), "https://l.de/2": (302, "", "https://l.de/1"), "https://bad.de/1": (404, ""), "https://bad.de/2": (404, ""), "https://bad.de/3": (404, ""), "https://a.de/new": (200, "<p>new</p>")}
    asked = []

    def fetch(due):
        asked.extend((now, r.url) for r in due.collect())
        return fetched(spark, web)(due)

    state = CrawlState.seeded(spark, list(web)[:-1], 0.0)
    slow = spark.createDataFrame([("a.de", 7.0)], "domain string, delay double")
    for now in (0.0, 20.0, 40.0):
        state = crawl_round(state, fetch, now, GROUPS, delays=slow)
        state = CrawlState(*(spark.createDataFrame(getattr(state, n).collect(), kind) for n, kind in TABLES.items()))
        if now == 0.0:
            assert {r.url: r.schedule for r in state.frontier.collect() if r.domain == "a.de"} == {"https://a.de/new": 7.0}
    assert len(asked) == len(set(asked))
    assert {r.domain for r in state.blocked_domains.collect()} == {"bad.de"}
    assert {r.url for r in state.blocked_urls.collect() if r.reason == "redirect loop"} >= {"https://l.de/2"}
    assert not any(r.domain == "bad.de" for r in state.frontier.collect()) and not any(r.domain == "bad.de" for r in state.blocked_urls.collect())


def test_incoming_scores_are_looked_up(spark):
    links = spark.createDataFrame([("u", "p", 0.5), ("u", "p", 0.5), ("u", "q", None), ("u", "r", None), ("v", "p", 0.5)], "url string, parent string, score double")
    pages = spark.createDataFrame([("q", 0.25)], "url string, score double")
    got = incoming_scores(spark.createDataFrame([("u",), ("w",)], "url string"), links, pages)
    assert {r.url: r.incoming for r in got.collect()} == {"u": 0.75, "w": 0.0}


def test_service_functions(spark, tmp_path):
    docs = spark.createDataFrame([(1, "old town castle castle"), (2, "river walk")], "doc_id long, text string")
    held = api.index(docs, str(tmp_path / "index"))
    found = api.retrieve("walk", held, spark)
    assert [r.doc_id for r in found.collect()] == [2]
    assert api.health(held).first().documents == 2
    assert api.document(docs, 2).first().text == "river walk" and api.document_ids(docs).count() == 2
    api.batch(found.select("query_num", "rank", F.lit("u").alias("url"), "score"), str(tmp_path / "run"))
    assert not api.table_exists(spark, "nothing_here")
