"""Page scores from term groups, URLs, incoming links and link depths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import lower_term_hits

#: Weight of each term group and the hits at which it is full. Fixed values.
GROUPS = {"phrases": (0.25, 2), "city": (0.16, 2), "university": (0.16, 2), "faculty": (0.11, 2), "academic": (0.32, 3)}


def _clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def text_score(text: Column, english: Column, terms: Mapping[str, Sequence[str]], region: Sequence[str] = ()) -> Column:
    """0 to 1 from how many different terms of each group occur; 0 for texts that aren't English."""
    # Lambdas bind the lower-case text, and then the hits, once; as plain columns every term would lower the text again.
    def counted(low: Column) -> Column:
        return F.struct(*[lower_term_hits(low, terms.get(g, ())).alias(g) for g in GROUPS], (lower_term_hits(low, region) > 0).alias("region"))

    def valued(hits: Column) -> Column:
        total = F.lit(0.0)
        for group, (weight, full) in GROUPS.items():
            total = total + weight * F.least(F.lit(1.0), hits[group] / float(full))
        total = total + F.when((hits["phrases"] > 0) & (hits["academic"] > 0), 0.10).otherwise(0.0)
        return _clamp(total + F.when(hits["region"], 0.08).otherwise(0.0))

    low = F.array(F.lower(F.coalesce(text, F.lit(""))))
    return F.when(F.coalesce(english, F.lit(False)), F.get(F.transform(F.transform(low, counted), valued), F.lit(0))).otherwise(0.0)


def incoming_score(incoming: Column) -> Column:
    """Sum of the scores of an array of links (url, score); unknown scores count nothing."""
    return F.aggregate(F.coalesce(incoming, F.array().cast("array<struct<url:string,score:double>>")), F.lit(0.0), lambda a, x: a + F.coalesce(x["score"], F.lit(0.0)))


def page_score(text: Column, url: Column, incoming: Column, link_depth: Column, domain_depth: Column, max_depth: int = 5) -> Column:
    """Crawl priority of a page; zero beyond ``max_depth``; a weak page with many links from good ones is lifted."""
    links = F.least(F.lit(1.0), incoming / 3)
    depth = F.greatest(link_depth, domain_depth)
    base = (0.6 * text + 0.25 * url + 0.1 * links) * F.greatest(F.lit(0.5), 1 - 0.1 * depth)
    lifted = F.when((base < 0.4) & (links > 0.8), F.least(F.lit(1.0), base + 0.15)).otherwise(base)
    return F.when(depth > max_depth, 0.0).otherwise(_clamp(lifted))


def offline_score(text: Column, url: Column, incoming: Column, outgoing: Column, link_depth: Column, domain_depth: Column) -> Column:
    """Page score with outgoing links: depth from two on costs, and weak deep pages are halved."""
    least = F.least(link_depth, domain_depth)
    total = 0.45 * text + 0.25 * url + 0.15 * F.least(F.lit(1.0), incoming / 3) + 0.15 * F.least(F.lit(1.0), outgoing / 5)
    total = total * (1 - F.least(F.lit(0.5), 0.05 * F.greatest(F.lit(0), least - 2)))
    return _clamp(F.when((text < 0.3) & (url < 0.3) & (least > 6), total * 0.5).otherwise(total))
