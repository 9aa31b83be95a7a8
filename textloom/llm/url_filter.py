"""URL filters: host and path rules, and gradient-boosted trees on lexical features for URLs that no rule names.

Features are DataFrame columns. The trees are trained on a bounded sample of URLs that rules label and are themselves
turned into column expressions, so scoring is one projection without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.batches import quoted

#: (host and path prefix, verdict); a rule also holds for subdomains, and the longest that fits wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Most rule-labelled URLs of each verdict that training takes: those of the smallest hash.
SAMPLE = 10_000
#: Most suffixes with a share of their own.
SUFFIXES = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features; all are finite, also for empty URLs."""
    url = F.coalesce(url, F.lit(""))
    size = F.length(url)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    letters = F.transform(F.array_distinct(F.split(F.lower(url), "")), lambda c: F.when(c != "", F.length(url) - F.length(F.replace(F.lower(url), c))).otherwise(0))
    total = F.greatest(size, F.lit(1)).cast("double")
    entropy = F.aggregate(letters, F.lit(0.0), lambda a, n: a + F.when(n > 0, -(n / total) * F.log2(F.greatest(n, F.lit(1)) / total)).otherwise(0.0))
    labels = F.split(host, r"\.")
    return {
        "length": size.cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": _count(path, "[^/]").cast("double") * -1 + F.length(path),
        "host_labels": F.size(labels).cast("double"),
        "hyphens": (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"),
        "digit_ratio": _count(url, "[0-9]") / total,
        "symbol_ratio": _count(url, "[^A-Za-z0-9]") / total,
        "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "[&;]")).cast("double")),
        "fragment": url.contains("#").cast("double"),
        "secure": F.lower(url).startswith("https:").cast("double"),
        "entropy": entropy,
        "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
        "file_ending": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
    }


def suffix_of(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


@dataclass
class Tree:
    """A regression tree: inner nodes hold (feature, threshold, low side, high side), leaves a value."""

    feature: int = -1
    threshold: float = 0.0
    low: Tree | None = None
    high: Tree | None = None
    value: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), self.value)
        side = x[:, self.feature] <= self.threshold
        return np.where(side, self.low.predict(x), self.high.predict(x))

    def column(self, columns: list[Column]) -> Column:
        if self.low is None:
            return F.lit(float(self.value))
        return F.when(columns[self.feature] <= float(self.threshold), self.low.column(columns)).otherwise(self.high.column(columns))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, ridge: float) -> Tree:
    leaf = Tree(value=float(-g.sum() / (h.sum() + ridge)))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    base, best = g.sum() ** 2 / (h.sum() + ridge), (1e-6, -1, 0.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, cg, ch = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
        ends = np.flatnonzero(v[1:] > v[:-1])
        ends = ends[(ends + 1 >= least) & (len(v) - ends - 1 >= least)]
        if len(ends):
            gain = cg[ends] ** 2 / (ch[ends] + ridge) + (cg[-1] - cg[ends]) ** 2 / (ch[-1] - ch[ends] + ridge) - base
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float((v[ends[k]] + v[ends[k] + 1]) / 2))
    if best[1] < 0:
        return leaf
    side = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], _grow(x[side], g[side], h[side], depth - 1, least, ridge), _grow(x[~side], g[~side], h[~side], depth - 1, least, ridge))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, least: int = 10, ridge: float = 1.0, held: np.ndarray | None = None) -> tuple[float, list[Tree]]:
    """Log-odds start and shrunken trees of a logistic gradient boosting; no labels give a neutral start.

    Rows marked ``held`` aren't learned from; trees end where these rows' loss is least, so what doesn't carry over to
    them isn't kept.
    """
    learn = np.ones(len(y), bool) if held is None else ~held
    if not learn.any():
        return 0.0, []
    p = np.clip(y[learn].mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    score, grown = np.full(len(y), start), []
    losses = [np.logaddexp(0, np.where(y == 1, -score, score))[~learn].sum()]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x[learn], (p - y)[learn], (p * (1 - p))[learn], depth, least, ridge)
        if tree.low is None:
            break
        score += rate * tree.predict(x)
        grown.append(tree)
        losses.append(np.logaddexp(0, np.where(y == 1, -score, score))[~learn].sum())
    return start, grown if learn.all() else grown[: int(np.argmin(losses))]


def suffix_shares(suffixes: list[str], y: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, dict[str, float]]:
    """Each row's share of blocked URLs of its suffix in the other folds, and each suffix's over all.

    Shares are drawn towards one half. A suffix that rules give one verdict only would stand for the rules themselves: it
    is hidden, as are all but the ``SUFFIXES`` most frequent ones, and has one half.
    """
    kinds, place = np.unique(np.array(suffixes, object).astype(str), return_inverse=True)
    seen, blocked = np.bincount(place, minlength=len(kinds)), np.bincount(place, y, len(kinds))
    known = (blocked > 0) & (blocked < seen)
    known &= np.isin(np.arange(len(kinds)), np.argsort(-seen, kind="stable")[:SUFFIXES])
    rows = np.full(len(y), 0.5)
    for k in np.unique(fold):
        rest = fold != k
        share = (np.bincount(place[rest], y[rest], len(kinds)) + 5) / (np.bincount(place[rest], minlength=len(kinds)) + 10)
        rows[~rest] = np.where(known, share, 0.5)[place[~rest]]
    return rows, {str(kinds[k]): float((blocked[k] + 5) / (seen[k] + 10)) for k in np.flatnonzero(known)}


@dataclass
class Judge:
    """Start, trees, their rate, the features' names and the suffix shares that the last feature takes."""

    start: float
    trees: list[Tree]
    rate: float
    names: list[str]
    shares: dict[str, float]

    def score(self) -> Column:
        """Chance of block from columns ``f_`` of the features and ``suffix``, without Python."""
        suffix = F.lit(0.5)
        for name, value in self.shares.items():
            suffix = F.when(F.col("suffix") == name, F.lit(value)).otherwise(suffix)
        columns = [*(F.col(f"f_{n}") for n in self.names), suffix]
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + tree.column(columns) * self.rate
        return 1 / (1 + F.exp(-total))


def learn(valued: DataFrame, names: list[str], sample: int = SAMPLE, rate: float = 0.3) -> Judge:
    """Trees from a bounded sample of rule-labelled URLs: of each verdict the ``sample`` distinct URLs of the smallest hash.

    A fifth of the sample, by hash, decides how many trees are kept; suffix shares are those of the other fifths.
    """
    found = []
    for says in ("block", "allow"):
        own = valued.where(F.col("ruled") == says).withColumn("h", F.xxhash64("url"))
        last = own.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
        if last is not None:
            found.append(own.where(F.col("h") <= last).select("ruled", "suffix", "h", *(f"f_{n}" for n in names)).dropDuplicates(["h"]).orderBy("h").toPandas())
    if not found:
        return Judge(0.0, [], rate, names, {})
    y = np.concatenate([(f["ruled"] == "block").to_numpy(float) for f in found])
    fold = np.concatenate([f["h"].to_numpy(np.int64) for f in found]) % 5
    rows, shares = suffix_shares([s for f in found for s in f["suffix"]], y, fold)
    x = np.column_stack([np.concatenate([f[[f"f_{n}" for n in names]].to_numpy(float) for f in found]), rows])
    return Judge(*boost(x, y, rate=rate, held=fold == 0), rate, names, shares)


def valued_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> tuple[DataFrame, list[str]]:
    """``page_id, url, host, path, rule, ruled, suffix`` and the features, as columns ``f_`` and their names."""
    url = F.col("url")
    ruled = pages.select(F.col(quoted(id_col)).cast("long").alias("page_id"), F.col(quoted(url_col)).cast("string").alias("url")).withColumns({"host": host_of(url), "path": path_of(url)})
    ruled = ruled.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for rule, says in rules:
        verdict = F.when(F.col("rule") == rule, says).otherwise(verdict)
    made = features(url, F.col("host"), F.col("path"))
    valued = ruled.withColumns({"ruled": verdict, "suffix": suffix_of(F.col("host")), **{f"f_{n}": c for n, c in made.items()}})
    return valued, list(made)


def filter_urls(pages: DataFrame, rules=RULES, sample: int = SAMPLE, rate: float = 0.3, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` of every row.

    ``verdict`` is the rule's, else block where the trees give a chance of 0.5 or more. A null URL or one without
    ``://`` has an empty host and path and is judged by the trees; so are URLs of any length, whole. Null ids and repeated
    rows are kept, equal URLs are judged alike, other columns are ignored, whatever their names. With no labelled URL at
    all, or where nothing carries over to held-out ones, there are no trees, which allows. An empty table gives no rows.
    """
    valued, names = valued_urls(pages, rules, id_col, url_col)
    judge = learn(valued, names, sample, rate)
    scored = valued.withColumn("block_score", judge.score())
    judged = F.when((F.col("block_score") >= 0.5) & F.lit(bool(judge.trees)), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "block_score")
