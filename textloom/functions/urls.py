"""URL columns: normal forms, domains, topics, prefixes and lexical scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised_url(url: Column, strict: bool = False) -> Column:
    """Without scheme, query and one trailing slash; ``strict`` leaves query and slash of URLs that have a scheme."""
    bare = F.when(url.startswith("https://"), F.substring(url, 9, 1 << 30)).when(url.startswith("http://"), F.substring(url, 8, 1 << 30))
    rest = F.coalesce(bare, url)
    cut = F.regexp_replace(F.substring_index(rest, "?", 1), "/$", "")
    return F.coalesce(bare, cut) if strict else cut


def group_key(url: Column) -> Column:
    """What stands before the first question mark."""
    return F.substring_index(url, "?", 1)


def crawl_domain(url: Column) -> Column:
    """Host with user part, without port, in its own letter case; null where there is none."""
    return F.nullif(F.regexp_extract(url, "//([^/:]+)", 1), F.lit(""))


def domain(url: Column) -> Column:
    """Lower-case network location with port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, "^[^:/?#]+://([^/?#]*)", 1)), F.lit(""))


def domain_topic(url: Column) -> Column:
    """The label that names a site, without www and endings, or ``unknown``."""
    host = F.regexp_replace(domain(url), r"^www\.", "")
    labels = F.split(host, r"\.")
    name = F.when(F.size(labels) >= 2, F.element_at(labels, -2)).otherwise(F.element_at(labels, 1))
    return F.coalesce(F.nullif(F.regexp_replace(name, "[^a-zA-Z0-9-]", ""), F.lit("")), F.lit("unknown"))


def is_sitemap(url: Column) -> Column:
    return F.lower(url).rlike(r"sitemap.*\.xml$|/sitemap/?$|sitemap_index.*\.xml$")


def longest_prefix(text: Column, rules: Column) -> Column:
    """Length of the longest of ``rules`` (an array) that ``text`` starts with; 0 for none."""
    fits = F.transform(rules, lambda r: F.when(F.startswith(text, r), F.length(r)).otherwise(0))
    return F.coalesce(F.array_max(fits), F.lit(0))


def retry_seconds(value: Column, now: Column) -> Column:
    """A retry header as seconds from ``now`` (epoch): digits as they are, else an HTTP date; null if neither."""
    date = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(value, r"^\w+,\s*| GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")))
    return F.when(value.rlike(r"^\d+$"), value.cast("long")).when(date.isNotNull(), F.greatest(date - now, F.lit(0)))


def url_score(url: Column, names: Sequence[str], site: str, path: str = "/en") -> Column:
    """0 to 1: half for any of ``names``, a fifth each for the language path and the site; deep paths cost a tenth a level."""
    low = F.lower(F.coalesce(url, F.lit("")))
    named = F.lit(False)
    for n in names:
        named = named | low.contains(n)
    depth = F.length(low) - F.length(F.replace(low, F.lit("/"), F.lit("")))
    total = (
        F.when(named, 0.5).otherwise(0.0)
        + F.when(low.contains(f"{path}/") | low.endswith(path), 0.2).otherwise(0.0)
        + F.when(low.contains(site), 0.2).otherwise(0.0)
        - F.when(depth > 6, 0.1 * (depth - 6)).otherwise(0.0)
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
