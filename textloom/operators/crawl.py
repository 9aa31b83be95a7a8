"""Crawl operators: frontier selection, blocking, link depths, redirects, status policy, backoff, averages, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.urls import longest_prefix
from textloom.session import ensure_checkpoint_dir

#: Fixed values: (first code, last code, failures in a row that ban a URL, sample for the domain's average, delay).
#: Code 0 is no response; the first row that fits counts. A null ban never bans.
STATUS_POLICY = (
    (0, 0, 4, 1.0, "backoff"),
    (200, 299, None, 0.0, "none"),
    (300, 399, None, 0.0, "none"),
    (400, 400, 3, 1.0, "backoff"),
    (429, 429, 10, 0.5, "backoff"),
    (401, 499, 2, 1.0, "backoff"),
    (999, 999, 10, 0.5, "backoff"),
    (500, 506, 5, 1.0, "backoff"),
    (599, 599, 5, 1.0, "backoff"),
    (507, 509, 3, 0.75, "hour"),
)
OTHER_POLICY = (3, 0.4, "backoff")


def status_policy(code: Column) -> dict[str, Column]:
    """Columns ``ban_at, sample, delay_kind`` of a status code."""
    ban, sample, delay = F.lit(OTHER_POLICY[0]), F.lit(OTHER_POLICY[1]), F.lit(OTHER_POLICY[2])
    for low, high, b, s, d in reversed(STATUS_POLICY):
        fits = code.between(low, high)
        ban = F.when(fits, F.lit(b).cast("int")).otherwise(ban)
        sample, delay = F.when(fits, F.lit(s)).otherwise(sample), F.when(fits, F.lit(d)).otherwise(delay)
    return {"ban_at": ban, "sample": sample, "delay_kind": delay}


def backoff_bounds(delay: Column, domain_delay: Column, most: float = 3600.0) -> dict[str, Column]:
    """Least and greatest next delay of a failing URL: up to twice the last, not under the domain's."""
    doubled = delay * 2
    low = F.when(delay > most, F.lit(most)).otherwise(doubled / 1.4)
    high = F.when(delay > most, F.lit(most)).otherwise(doubled)
    return {"low": F.greatest(low, domain_delay), "high": F.greatest(high, domain_delay)}


def backoff(delay: Column, domain_delay: Column, draw: Column, most: float = 3600.0) -> Column:
    """Next delay, ``draw`` (0 to 1) between its bounds."""
    b = backoff_bounds(delay, domain_delay, most)
    return b["low"] + (b["high"] - b["low"]) * draw


def select_due(frontier: DataFrame, now: Column | float, most: int = 99) -> DataFrame:
    """Up to ``most`` due URLs (url, domain, schedule), the earliest of each domain, by schedule."""
    due = frontier.where(F.col("schedule") <= now)
    order = Window.partitionBy("domain").orderBy("schedule", "url")
    return due.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn").orderBy("schedule", "url").limit(most)


def not_blocked(urls: DataFrame, blocked_urls: DataFrame, blocked_domains: DataFrame) -> DataFrame:
    """URLs (url, domain) that aren't blocked themselves and whose domain isn't."""
    return urls.join(blocked_urls.select("url").distinct(), "url", "left_anti").join(blocked_domains.select("domain").distinct(), "domain", "left_anti")


def cleaned(blocked_urls: DataFrame, blocked_domains: DataFrame) -> DataFrame:
    """Blocked URLs (url, domain) without those whose whole domain is blocked."""
    return blocked_urls.join(blocked_domains.select("domain").distinct(), "domain", "left_anti")


def incoming_scores(urls: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """``url, incoming``: sum of the scores of each URL's links (url, parent, score), a parent counting once.

    A link without a score has its parent's among ``pages`` (url, score), if it is there. Sums are partial aggregates, so a
    URL that very many pages link to is no row of its own.
    """
    own = links.join(urls.select("url").distinct(), "url", "left_semi").groupBy("url", "parent").agg(F.max("score").alias("score"))
    known = pages.select(F.col("url").alias("parent"), F.col("score").alias("stored"))
    sums = own.join(known, "parent", "left").groupBy("url").agg(F.sum(F.coalesce("score", "stored", F.lit(0.0))).alias("incoming"))
    return urls.select("url").distinct().join(sums, "url", "left").select("url", F.coalesce("incoming", F.lit(0.0)).alias("incoming"))


def allowed_paths(rows: DataFrame, rules: DataFrame, path: Column) -> DataFrame:
    """``allowed`` for rows (domain): whether the longest rule that the path starts with allows it; ties and no rule allow."""
    joined = rows.join(rules.select("domain", F.col("allowed").alias("may"), "forbidden"), "domain", "left")
    return joined.withColumn("allowed", F.coalesce(longest_prefix(path, F.col("may")) >= longest_prefix(path, F.col("forbidden")), F.lit(True))).drop("may", "forbidden")


def last_events(events: DataFrame, key: str, time: str, tie: str, most: int = 100) -> DataFrame:
    """The latest events of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(time), F.desc(tie))
    return events.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)


def streaks(events: DataFrame, key: str, code: str, *order: str) -> DataFrame:
    """``streak``: how many events in a row up to each one had its code."""
    by_key = Window.partitionBy(key).orderBy(*order)
    changed = F.when(F.col(code) != F.lag(code).over(by_key), 1).otherwise(0)
    rows = events.withColumn("change", changed)
    rows = rows.withColumn("island", F.sum("change").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("streak", F.row_number().over(Window.partitionBy(key, "island").orderBy(*order))).drop("change", "island")


def decayed_means(samples: DataFrame, key: str, time: str, value: str, decay: float = 0.2, count_first_twice: bool = False) -> DataFrame:
    """``key, n, average``: exponentially decayed mean of each key's samples (time in seconds), after the last one.

    Weights are relative to the key's last time, so they never exceed one, and are summed by partial aggregation: no array
    holds all samples of a key. With ``count_first_twice`` the earliest sample counts double.
    """
    seconds, v = F.col(time).cast("double"), F.col(value).cast("double")
    rows = samples.select(F.col(key).alias("key"), seconds.alias("t"), v.alias("v")).where("key is not null and t is not null and v is not null")
    latest = rows.groupBy("key").agg(F.max("t").alias("last"), F.min(F.struct("t", "v")).alias("first"), F.count("*").alias("samples"))
    weight = F.exp(-decay * (F.col("last") - F.col("t")))
    own = rows.join(latest.select("key", "last"), "key").groupBy("key").agg(F.sum(weight * F.col("v")).alias("s"), F.sum(weight).alias("w"))
    out = own.join(latest, "key")
    if count_first_twice:
        extra = F.exp(-decay * (F.col("last") - F.col("first.t")))
        out = out.withColumns({"s": F.col("s") + extra * F.col("first.v"), "w": F.col("w") + extra})
    return out.select(F.col("key").alias(key), F.col("w").alias("n"), (F.col("s") / F.col("w")).alias("average"), "samples")


def request_rates(requests: DataFrame, key: str, time: str, seconds: int = 60, most: int = 60) -> DataFrame:
    """Requests in the window up to each one, what remains, use in percent, and the second after which the oldest counts no more."""
    window = Window.partitionBy(key).orderBy(F.col(time).cast("long")).rangeBetween(-seconds, 0)
    held = {"used": F.count("*").over(window), "reset": F.min(F.col(time).cast("long")).over(window) + seconds}
    return requests.withColumns(held).withColumns({"remaining": F.greatest(F.lit(0), most - F.col("used")), "use_percent": 100.0 * F.col("used") / most})


def link_depths(seeds: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """``node, link_depth, domain_depth`` of nodes reached from ``seeds`` (node) over ``edges`` (src, dst, same_domain).

    Within a domain the domain depth grows; to another one the link depth grows and the domain depth starts at 0. Each
    depth is the least over all paths; paths end beyond ``most`` in either. One join and one aggregation a level.

    A path's two depths belong together, so that ``d0`` to ``dN`` hold the least domain depth of paths of that link depth,
    null if a smaller link depth has one as small. Paths have ``most`` links to other domains and as many hops within each.
    """
    ensure_checkpoint_dir(seeds.sparkSession)
    none = F.lit(None).cast("int")
    names = [f"d{k}" for k in range(most + 1)]
    state = seeds.select("node", F.lit(0).alias("d0"), *[none.alias(n) for n in names[1:]]).distinct()
    fresh = state
    for _ in range((most + 1) * most + most):
        across = [none, *[F.when(F.col(n).isNotNull(), 0) for n in names[:-1]]]
        within = [F.when(F.col(n) < most, F.col(n) + 1) for n in names]
        step = fresh.join(edges, fresh.node == edges.src).groupBy(F.col("dst").alias("node"))
        step = step.agg(*[F.min(F.when(F.col("same_domain"), w).otherwise(x)).alias(f"new_{n}") for n, w, x in zip(names, within, across, strict=True)])
        step = step.where(" or ".join(f"new_{n} is not null" for n in names))
        joined = step.join(state, "node", "full")
        columns, least = [], None
        for n in names:
            best = F.least(f"new_{n}", n)
            best, least = (best, best) if least is None else (F.when(least.isNull() | (best < least), best), F.least(least, best))
            columns += [best.alias(n), F.when(F.col(n).isNull() | (best < F.col(n)), best).alias(f"moved_{n}")]
        joined = joined.select("node", *columns).checkpoint()
        state = joined.select("node", *names)
        fresh = joined.select("node", *[F.col(f"moved_{n}").alias(n) for n in names]).where(" or ".join(f"{n} is not null" for n in names))
        if fresh.isEmpty():
            break
    link_depth = F.coalesce(*[F.when(F.col(n).isNotNull(), k) for k, n in enumerate(names)])
    return state.select("node", link_depth.alias("link_depth"), F.array_min(F.array(*names)).alias("domain_depth"))


def redirect_ends(redirects: DataFrame, most: int = 5) -> DataFrame:
    """``url, target, hops, is_loop``: where each redirect (url, location) ends; more than ``most`` hops is a loop."""
    moves = redirects.select("url", "location").where("location is not null")
    out = moves.select("url", F.col("location").alias("target"), F.lit(1).alias("hops"))
    step = moves.select(F.col("url").alias("target"), F.col("location").alias("next"))
    for _ in range(most - 1):
        out = out.join(step, "target", "left").select("url", F.coalesce("next", "target").alias("target"), (F.col("hops") + F.col("next").isNotNull().cast("int")).alias("hops"))
    ends = out.join(step.select("target", F.lit(True).alias("goes_on")), "target", "left")
    return ends.select("url", "target", "hops", F.coalesce("goes_on", F.lit(False)).alias("is_loop"))


def robots_rules(robots: DataFrame, agents: tuple[str, ...] = ("*",)) -> DataFrame:
    """``domain, allowed, forbidden, delay`` from (domain, robots): the rules of groups that name one of ``agents``."""
    lines = robots.select("domain", F.posexplode(F.split(F.coalesce("robots", F.lit("")), r"\r?\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where(F.col("line").contains(":"))
    lines = lines.select("domain", "line_no", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    order = Window.partitionBy("domain").orderBy("line_no")
    is_agent = F.col("field") == "user-agent"
    starts = is_agent & F.coalesce(F.lag("field").over(order) != "user-agent", F.lit(True))
    lines = lines.withColumn("grp", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ours = lines.where(is_agent).groupBy("domain", "grp").agg(F.max(F.lower("value").isin([a.lower() for a in agents])).alias("ours")).where("ours")
    rules = lines.where(~is_agent).join(ours, ["domain", "grp"], "left_semi")
    found = rules.groupBy("domain").agg(
        F.array_sort(F.collect_set(F.when((F.col("field") == "allow") & (F.col("value") != ""), F.col("value")))).alias("allowed"),
        F.array_sort(F.collect_set(F.when((F.col("field") == "disallow") & (F.col("value") != ""), F.col("value")))).alias("forbidden"),
        F.max(F.when(F.col("field") == "crawl-delay", F.expr("try_cast(value as double)"))).alias("delay"),
    )
    return robots.select("domain").distinct().join(found, "domain", "left").select("domain", F.coalesce("allowed", F.array().cast("array<string>")).alias("allowed"), F.coalesce("forbidden", F.array().cast("array<string>")).alias("forbidden"), F.coalesce("delay", F.lit(1.5)).alias("delay"))
