"""One crawl round as a plan: due URLs, responses, status policy, parsing, scoring, links, new frontier.

Fetching itself is a callable from due URLs to responses, so a round runs alike over a live fetcher, a table of pages or a
stream's micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import DEFAULT, Config
from textloom.functions import scores, urls
from textloom.functions.text import looks_english
from textloom.operators import crawl
from textloom.operators.html import parsed_page
from textloom.session import ensure_checkpoint_dir

#: url, domain, schedule and delay (seconds), depths.
FRONTIER = "url string, domain string, schedule double, delay double, link_depth int, domain_depth int"
PAGES = "url string, domain string, title string, text string, fetched double, incoming double, link_depth int, domain_depth int, score double"
CODES = "domain string, url string, t double, code int"
TABLES = {
    "frontier": FRONTIER,
    "pages": PAGES,
    "blocked_urls": "url string, domain string, reason string, received double",
    "blocked_domains": "domain string, received double",
    "codes": CODES,
    "links": "url string, parent string, score double",
    "redirects": "url string, location string",
}


@dataclass
class CrawlState:
    """Tables of a crawl; written and reread between rounds, which also makes a crawl resumable."""

    frontier: DataFrame
    pages: DataFrame
    blocked_urls: DataFrame
    blocked_domains: DataFrame
    codes: DataFrame
    links: DataFrame
    redirects: DataFrame

    @staticmethod
    def seeded(spark: SparkSession, seeds: Sequence[str], now: float, config: Config = DEFAULT) -> CrawlState:
        rows = spark.createDataFrame([(u,) for u in seeds], "url string").distinct()
        frontier = rows.select(
            "url", urls.crawl_domain(F.col("url")).alias("domain"), F.lit(now).alias("schedule"), F.lit(config.default_delay).alias("delay"),
            F.lit(0).alias("link_depth"), F.lit(0).alias("domain_depth"),
        ).where("domain is not null")
        return CrawlState(frontier, *(spark.createDataFrame([], kind) for name, kind in TABLES.items() if name != "frontier"))

    def save(self, folder: str, number: int) -> CrawlState:
        """Write snapshot ``number`` and read it back; it counts once its last table is complete."""
        spark = self.frontier.sparkSession
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{number:08d}/{name}")
        return CrawlState.load(spark, folder, number)

    @staticmethod
    def load(spark: SparkSession, folder: str, number: int | None = None) -> CrawlState | None:
        """A snapshot, the latest complete one by default; none gives null."""
        number = max(snapshots(spark, folder), default=None) if number is None else number
        return None if number is None else CrawlState(*(spark.read.schema(kind).parquet(f"{folder}/{number:08d}/{name}") for name, kind in TABLES.items()))


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def snapshots(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete snapshots in a folder."""
    files, where = _files(spark, folder)
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    last = list(TABLES)[-1]
    return sorted(int(n) for n in names if n.isdigit() and files.exists(_files(spark, f"{folder}/{n}/{last}/_SUCCESS")[1]))


def admitted(state: CrawlState, links: DataFrame, now: float, config: Config = DEFAULT) -> DataFrame:
    """The frontier with ``links`` (url, link_depth, domain_depth) added.

    Blocked and stored URLs are left out; a URL already waiting keeps its schedule and the least depths.
    """
    rows = links.withColumn("domain", urls.crawl_domain(F.col("url"))).where("domain is not null")
    rows = crawl.not_blocked(rows, state.blocked_urls, state.blocked_domains).join(state.pages.select("url"), "url", "left_anti")
    fresh = rows.select("url", "domain", F.lit(now + config.default_delay).alias("schedule"), F.lit(config.default_delay).alias("delay"), "link_depth", "domain_depth")
    both = state.frontier.unionByName(fresh)
    return both.groupBy("url", "domain").agg(F.min("schedule").alias("schedule"), F.max("delay").alias("delay"), F.min("link_depth").alias("link_depth"), F.min("domain_depth").alias("domain_depth"))


def crawl_round(
    state: CrawlState,
    fetch: Callable[[DataFrame], DataFrame],
    now: float,
    terms: Mapping[str, Sequence[str]],
    url_names: Sequence[str] = (),
    site: str = "",
    config: Config = DEFAULT,
    delays: DataFrame | None = None,
) -> CrawlState:
    """State after one round; ``fetch`` gives (url, code, html) for due URLs, and ``location`` where it knows redirects.

    No row, or code 0, means no answer. Answers are fetched once and stored in the checkpoint folder. After a round the
    other URLs of its domains wait for the domain's delay, of ``delays`` (domain, delay) or the default.
    """
    ensure_checkpoint_dir(state.frontier.sparkSession)
    due = crawl.select_due(state.frontier, now, config.round_urls)
    found = fetch(due.select("url"))
    found = found if "location" in found.columns else found.withColumn("location", F.lit(None).cast("string"))
    answers = due.join(found.select("url", "code", "html", "location"), "url", "left").withColumns({"code": F.coalesce("code", F.lit(0)), "draw": F.rand(7)}).checkpoint()
    codes = state.codes.unionByName(answers.select("domain", "url", F.lit(now).alias("t"), "code"))
    # Failures in a row of one code ban a URL; a decayed mean over a domain's failures bans the domain.
    runs = crawl.streaks(codes.join(answers.select("url"), "url", "left_semi"), "url", "code", "t").where(F.col("t") == now)
    judged = runs.withColumns(crawl.status_policy(F.col("code")))
    banned = judged.where(F.col("streak") >= F.col("ban_at")).select("url", "domain", F.concat(F.lit("code "), F.col("code").cast("string")).alias("reason"), F.lit(now).alias("received"))
    sampled = codes.withColumns(crawl.status_policy(F.col("code")))
    means = crawl.decayed_means(sampled, "domain", "t", "sample", config.decay)
    bad = means.where((F.col("average") > config.ban_average) & (F.col("samples") >= config.ban_samples)).select("domain", F.lit(now).alias("received"))
    # Redirects: a chain that doesn't end is a loop, which bans its URL; the end of another takes its place.
    moved = answers.where("code between 300 and 399 and location is not null")
    redirects = state.redirects.unionByName(moved.select("url", "location")).dropDuplicates(["url"])
    ends = moved.select("url", "domain", "link_depth", "domain_depth").join(crawl.redirect_ends(redirects), "url")
    loops = ends.where("is_loop").select("url", "domain", F.lit("redirect loop").alias("reason"), F.lit(now).alias("received"))
    blocked_domains = state.blocked_domains.unionByName(bad.join(state.blocked_domains, "domain", "left_anti"))
    blocked_urls = crawl.cleaned(state.blocked_urls.unionByName(banned).unionByName(loops).dropDuplicates(["url"]).select(*state.blocked_urls.columns), blocked_domains).select(*state.blocked_urls.columns)

    good = answers.where("code between 200 and 299").withColumn("page", parsed_page(F.col("html"), F.col("url")))
    good = good.join(crawl.incoming_scores(answers, state.links, state.pages), "url")
    value = scores.page_score(
        scores.text_score(F.col("text"), looks_english(F.col("text")), terms), urls.url_score(F.col("url"), url_names, site) if site or url_names else F.lit(0.0),
        F.col("incoming"), F.col("link_depth"), F.col("domain_depth"), config.max_depth,
    )
    parsed = good.select("url", "domain", F.col("page.title").alias("title"), F.col("page.text").alias("text"), F.lit(now).alias("fetched"), "incoming", "link_depth", "domain_depth", F.col("page.links").alias("links"))
    parsed = parsed.withColumn("score", value).checkpoint()  # its pages, links and frontier are three tables of it
    expand = parsed.where((F.col("score") > config.expand_score) & (F.col("link_depth") < config.max_depth) & (F.col("domain_depth") < config.max_depth))
    links = expand.select(F.col("url").alias("parent"), "score", "domain", "link_depth", "domain_depth", F.explode("links").alias("url"))
    same = urls.crawl_domain(F.col("url")) == F.col("domain")
    links = links.select(
        "parent", "score", "url", F.when(same, F.col("link_depth")).otherwise(F.col("link_depth") + 1).alias("link_depth"),
        F.when(same, F.col("domain_depth") + 1).otherwise(0).alias("domain_depth"),
    )
    targets = links.select("url", "link_depth", "domain_depth").unionByName(ends.where("not is_loop").select(F.col("target").alias("url"), "link_depth", "domain_depth"))

    done = good.select("url").unionByName(banned.select("url")).unionByName(ends.select("url"))
    late = judged.where("delay_kind <> 'none'").join(answers.select("url", "draw"), "url").select("url", "delay_kind", "draw")
    waiting = state.frontier.join(done, "url", "left_anti").join(late, "url", "left")
    slower = F.when(F.col("delay_kind") == "hour", F.col("delay") + 3600).when(F.col("delay_kind") == "backoff", crawl.backoff(F.col("delay"), F.lit(config.default_delay), F.col("draw"))).otherwise(F.col("delay"))
    waiting = waiting.withColumn("delay", slower).withColumn("schedule", F.when(F.col("delay_kind").isNotNull(), now + F.col("delay")).otherwise(F.col("schedule"))).drop("delay_kind", "draw")
    all_links = state.links.unionByName(links.select("url", "parent", "score"))
    after = replace(state, frontier=waiting, pages=state.pages.unionByName(parsed.drop("links")), blocked_urls=blocked_urls, blocked_domains=blocked_domains, codes=codes, links=all_links, redirects=redirects)
    frontier = crawl.not_blocked(admitted(after, targets, now, config), blocked_urls, blocked_domains).select(*state.frontier.columns)
    return replace(after, frontier=spaced(frontier, answers.select("domain"), now, delays, config))


def spaced(frontier: DataFrame, fetched: DataFrame, now: float, delays: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """The frontier with URLs of domains just ``fetched`` not before the domain's delay has passed."""
    visited = fetched.select("domain").distinct()
    own = visited.join(delays.groupBy("domain").agg(F.max("delay").alias("pause")), "domain", "left") if delays is not None else visited.withColumn("pause", F.lit(None).cast("double"))
    pause = own.select("domain", (now + F.coalesce("pause", F.lit(config.default_delay))).alias("earliest"))
    return frontier.join(pause, "domain", "left").withColumn("schedule", F.greatest("schedule", "earliest")).select(*frontier.columns)


def run_crawl(
    spark: SparkSession,
    folder: str,
    seeds: Sequence[str],
    fetch: Callable[[DataFrame], DataFrame],
    terms: Mapping[str, Sequence[str]],
    clock: Callable[[], float],
    wait: Callable[[float], None],
    stop: Callable[[], bool] = lambda: False,
    rounds: int | None = None,
    **more,
) -> CrawlState:
    """Rounds until the frontier is empty, ``stop`` says so or ``rounds`` are over; each is a snapshot in ``folder``.

    A crawl that finds snapshots there goes on from the last complete one, so a stopped or failed crawl resumes by being
    started again. While nothing is due it waits for the earliest schedule. The two latest snapshots are kept.
    """
    held = snapshots(spark, folder)
    number = held[-1] if held else 0
    state = CrawlState.load(spark, folder) if held else CrawlState.seeded(spark, seeds, clock()).save(folder, 0)
    last = None if rounds is None else number + rounds
    while not stop() and number != last:
        earliest = state.frontier.agg(F.min("schedule")).first()[0]
        if earliest is None:
            break
        if earliest > clock():
            wait(earliest - clock())
            continue
        number += 1
        state = crawl_round(state, fetch, clock(), terms, **more).save(folder, number)
        for old in snapshots(spark, folder)[:-2]:
            files, where = _files(spark, f"{folder}/{old:08d}")
            files.delete(where, True)
    return state


def progress(state: CrawlState) -> DataFrame:
    """One row of counts of a crawl's tables."""
    counts = [getattr(state, n).agg(F.count("*").alias(n)) for n in ("frontier", "pages", "blocked_urls", "blocked_domains")]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)
    return out
