"""Toxicity by class-conditional Kneser-Ney word models.

A toxic and an ordinary bigram model are counted over all labelled training texts. Each backs off to its class's
continuation unigrams (in how many different contexts the class saw a word), and these to one distribution shared by both
classes: in how many different contexts a word was seen in either. Discounts are estimated from the numbers of ones and
twos. What a class has in up to ``RARE`` places is left wholly to the backoff, so rare expressions count alike for both
classes: with labels that are partly noise they are no evidence. A text counts each of its different bigrams once, so that
one that repeats itself can't rule a model or a score. The difference of the two log-likelihoods, and that of the
expressions clearly in favour of toxic, both normalised by length, are calibrated to a probability on a bounded sample, in
which a text's own counts are taken out of the models first.

Words are 64-bit hashes and bigrams pairs of them, counted in a written table that grows with the corpus. From it scoring
reads the bigrams seen more than ``RARE`` times, their left neighbours and words and the words of so many contexts: for all
others both classes' probabilities differ by the same factor, so that leaving them out changes no score. These tables are
as large as the corpus makes them, and a lookup compares the whole key; bigrams beyond ``PAIRS_AT_ONCE`` are scored in
further rounds over the texts, whose sums add up.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.batches import drop_stored, fold, id_and_text, map_rows, slices, smallest_hashes, stored, strings

#: Bigrams that a class has in up to this many texts, and words after up to this many, are left wholly to the backoff.
RARE = 3
#: Log-likelihood ratio of a place from which it is clearly in favour of toxic.
CLEAR = 1.5
#: Labelled texts of each label used for calibration: those of the smallest id hashes.
CALIBRATION = 1500
#: Characters of a calibration text at most; longer ones are counted and scored whole, but don't calibrate.
CALIBRATION_CHARS = 50_000
#: Label rows up to which they are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Bigrams that workers hold at a time.
PAIRS_AT_ONCE = 8_000_000
#: Words whose hashes a worker remembers, and bigrams that it gathers before it adds up equal ones.
REMEMBERED, GATHERED = 150_000, 500_000
_WORDS = re.compile(r"[^\W_]+").findall


class _Numbers(dict):
    """Word to 64-bit hash, cached; 0 stands before the first word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = number = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) or 1
        return number


_numbers = _Numbers()


def word_numbers(text: str) -> np.ndarray:
    tokens = _WORDS(text.lower())
    return np.fromiter(map(_numbers.__getitem__, tokens), np.int64, len(tokens))


def pair_keys(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each bigram."""
    mixed = left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = ((mixed ^ (mixed >> np.uint64(29))) + word.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).view(np.int64)


def bigrams(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's different bigrams: left neighbours, words and keys."""
    left = np.concatenate([np.zeros(1, np.int64), numbers[:-1]])[: len(numbers)]
    keys, at = np.unique(pair_keys(left, numbers), return_index=True)
    return left[at], numbers[at], keys


class Table:
    """Values by 64-bit key, as many buckets as keys; whole keys are compared, and others have the value ``default``."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default) -> None:
        order = np.argsort(keys.view(np.uint64))
        self.keys, self.values, self.default = keys[order], values[order], default
        self._shift = np.uint64(64 - max(1, len(keys).bit_length()))
        self._start = np.searchsorted(self.keys.view(np.uint64) >> self._shift, np.arange((1 << 64 - int(self._shift)) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's row, or -1."""
        bucket = (keys.view(np.uint64) >> self._shift).astype(np.int64)
        at, end, out = self._start[bucket], self._start[bucket + 1], np.full(len(keys), -1, np.int64)
        rest = np.flatnonzero(at < end)
        while len(rest):
            here = at[rest]
            hit = self.keys[here] == keys[rest]
            out[rest[hit]] = here[hit]
            rest = rest[~hit]
            at[rest] += 1
            rest = rest[at[rest] < end[rest]]
        return out

    def __getitem__(self, keys):
        at = self.find(np.atleast_1d(np.asarray(keys, np.int64)))
        if len(self.keys):
            out = self.values[at]
            out[at < 0] = self.default
        else:
            out = np.full((len(at), *self.values.shape[1:]), self.default, self.values.dtype)
        return out if np.ndim(keys) else out[0]


@dataclass
class Models:
    """Both classes' counts (column 0 ordinary, 1 toxic), discounts and the calibration."""

    words: Table  # different left neighbours of each word
    contexts: Table  # occurrences of each left neighbour
    held_back: Table  # share of each left neighbour's mass left to the backoff
    shared: Table  # shared backoff probability of each word
    totals: np.ndarray  # all continuation counts
    rest: np.ndarray  # share of them left to the shared backoff
    discounts: np.ndarray  # of continuation counts (row 0) and of bigrams (row 1)
    beta: np.ndarray

    def lower(self, word: np.ndarray, n: np.ndarray) -> np.ndarray:
        return discounted(n, self.discounts[0]) / np.maximum(self.totals, 1) + self.rest * self.shared[word][:, None]

    def ratios(self, left: np.ndarray, word: np.ndarray, pair: np.ndarray, own: int | None = None) -> np.ndarray:
        """Toxic less ordinary log-likelihood of bigrams seen ``pair`` times; with ``own``, those of one text, whose counts are taken out of that class."""
        n, context, pair = self.words[word], self.contexts[left], pair.astype(float)
        if own is not None:
            alone = pair[:, own] <= 1  # left neighbours that the class has from this text only
            pair[:, own] = np.maximum(pair[:, own] - 1, 0)
            for seen, table, weight in ((word, n, alone), (left, context, np.ones(len(left)))):
                _, place = np.unique(seen, return_inverse=True)
                table[:, own] = np.maximum(table[:, own] - np.bincount(place, weight)[place], 0)
        lower = self.lower(word, n)
        p = np.where(context > 0, discounted(pair, self.discounts[1]) / np.maximum(context, 1) + self.held_back[left] * lower, lower)
        logs = np.log(np.maximum(p, 1e-300))
        return logs[:, 1] - logs[:, 0]


def discounted(counts: np.ndarray, discount: np.ndarray) -> np.ndarray:
    """Counts less the discount; rare ones are nothing."""
    return np.where(counts > RARE, counts - discount, 0.0)


def discount_of(ones: float, twos: float) -> float:
    """Kneser and Ney's discount from the numbers of ones and twos."""
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


@dataclass
class Scorer:
    """What workers read: the parts of a bigram's ratio by its word and left neighbour, and whole ratios of frequent ones."""

    words: Table
    lefts: Table
    pairs: Table
    first: bool  # of the rounds; later ones give what their bigrams change

    @classmethod
    def of(cls, models: Models, pairs: Table, first: bool) -> Scorer:
        lower = np.log(models.lower(models.words.keys, models.words.values))
        held = np.log(models.held_back.values)
        unseen = np.log(models.rest)
        words = Table(models.words.keys, (lower[:, 1] - lower[:, 0]).astype(np.float32), np.float32(unseen[1] - unseen[0]))
        return cls(words, Table(models.held_back.keys, (held[:, 1] - held[:, 0]).astype(np.float32), np.float32(0)), pairs, first)

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's number of bigrams, sum of ratios and sum of what clear ones have beyond ``CLEAR``."""
        held = [bigrams(word_numbers(t)) for t in texts]
        sizes = np.array([len(k) for _, _, k in held], np.int64)
        left, word, keys = (np.concatenate(x) for x in zip(*held, strict=True))
        text = np.repeat(np.arange(len(texts)), sizes)
        ratios = (self.lefts[left] + self.words[word]).astype(float)
        at = self.pairs.find(keys)
        hit = np.flatnonzero(at >= 0)
        whole = self.pairs.values[at[hit]].astype(float)
        if self.first:
            ratios[hit] = whole
            return sizes, np.bincount(text, ratios, len(texts)), np.bincount(text, np.maximum(ratios - CLEAR, 0), len(texts))
        clear = np.maximum(whole - CLEAR, 0) - np.maximum(ratios[hit] - CLEAR, 0)
        return sizes, np.bincount(text[hit], whole - ratios[hit], len(texts)), np.bincount(text[hit], clear, len(texts))


def measures(ratios: np.ndarray) -> np.ndarray:
    """The ratio a bigram, that of clear bigrams each and by the square root of their number, beside a constant."""
    if not len(ratios):
        return np.array([0.0, 0.0, 0.0, 1.0])
    clear = np.maximum(ratios - CLEAR, 0).sum()
    return np.array([ratios.mean(), clear / len(ratios), clear / np.sqrt(len(ratios)), 1.0])


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Equal bigrams of (left, word, ordinary, toxic) added up; equal words side by side, which compresses."""
    left, word, *counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    near = word.view(np.uint64) >> np.uint64(40) << np.uint64(40) | pair_keys(left, word).view(np.uint64) >> np.uint64(24)
    order = np.argsort(near)
    left, word = left[order], word[order]
    starts = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (word[1:] != word[:-1])][: len(left)])
    return left[starts], word[starts], *(np.add.reduceat(c[order], starts, dtype=c.dtype) if len(starts) else c for c in counts)


def count_pairs(rows: DataFrame) -> DataFrame:
    """``left, word, ordinary, toxic`` over rows of (text, label): each bigram's counts. Tasks sum up before the shuffle."""
    names = ["left", "word", "ordinary", "toxic"]

    def run(batches):
        parts: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def pieces(held):
            for at in range(0, len(held[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in held], names=names)

        for batch in slices(batches, 0):
            for text, label in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                left, word, _ = bigrams(word_numbers(text))
                parts.append((left, word, np.full(len(left), 1 - label, np.int32), np.full(len(left), label, np.int32)))
                waiting += len(left)
                if waiting > GATHERED:
                    parts[:] = [_summed(parts)]
                    waiting = 0
                    if len(parts[0][0]) > 2 * GATHERED:
                        yield from pieces(parts.pop())
        if parts:
            yield from pieces(_summed(parts))

    counted = rows.select("text", "label").mapInArrow(run, "left long, word long, ordinary int, toxic int")
    return counted.groupBy("left", "word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def often(pairs: DataFrame) -> DataFrame:
    return pairs.where((F.col("ordinary") > RARE) | (F.col("toxic") > RARE))


def train(pairs: DataFrame, least: int = 0) -> Models:
    """Models from ``count_pairs``, of words with more than ``least`` contexts in a class, and of both words of bigrams seen so often."""
    both = ("ordinary", "toxic")
    top = F.greatest(*both)
    sums = [F.sum(c).alias(c) for c in both]
    made = []  # what a discount and the mass it leaves come from: ones, twos, the sum of rare counts and the number of others
    for c in both:
        n = F.col(c)
        made += [F.sum((n == 1).cast("long")).alias(f"ones_{c}"), F.sum((n == 2).cast("long")).alias(f"twos_{c}")]
        made += [F.sum(F.when(n <= RARE, n).otherwise(0)).alias(f"low_{c}"), F.sum((n > RARE).cast("long")).alias(f"high_{c}")]

    def columns(held: pa.Table, *names: str) -> np.ndarray:
        return np.column_stack([held[n].to_numpy() for n in names]).astype(float)

    def pair_of(held: dict, name: str) -> np.ndarray:
        return np.array([held[f"{name}_{c}"] for c in both], float)

    # Continuation counts: different left neighbours of each word, in each class and (the shared backoff) in either. All
    # words that aren't wanted are one row with the sums of theirs.
    words = pairs.groupBy("word").agg(*[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in both], F.count("*").alias("spread"), F.max(top).alias("most"))
    held = words.groupBy(F.when(F.greatest("most", top) > least, F.col("word")).alias("word")).agg(*sums, *made, F.sum("spread").alias("spread"), F.count("*").alias("n")).toArrow()
    whole = {c: float(pa.compute.sum(held[c]).as_py() or 0) for c in held.column_names if c != "word"}
    first = np.array([discount_of(whole[f"ones_{c}"], whole[f"twos_{c}"]) for c in both])
    totals = np.array([whole[c] for c in both])
    rest = np.where(totals > 0, (pair_of(whole, "low") + first * pair_of(whole, "high")) / np.maximum(totals, 1), 1.0)
    mass = whole["spread"] + 0.5 * (whole["n"] + 1)
    held = held.filter(pa.compute.is_valid(held["word"]))
    at = held["word"].to_numpy()
    tables = [Table(at, columns(held, *both), 0.0), Table(at, (columns(held, "spread")[:, 0] + 0.5) / mass, 0.5 / mass)]
    seen = pairs.agg(*made).first().asDict()
    second = np.array([discount_of(seen[f"ones_{c}"] or 0, seen[f"twos_{c}"] or 0) for c in both])
    held = pairs.groupBy("left").agg(*sums, *made, F.max(top).alias("top")).where(F.col("top") > least).select("left", *both, *(f"{x}_{c}" for x in ("low", "high") for c in both)).toArrow()
    at, contexts = held["left"].to_numpy(), columns(held, *both)
    back = columns(held, "low_ordinary", "low_toxic") + second * columns(held, "high_ordinary", "high_toxic")
    back = np.where(contexts > 0, back / np.maximum(contexts, 1), 1.0)
    return Models(tables[0], Table(at, contexts, 0.0), Table(at, back, 1.0), tables[1], totals, rest, np.array([first, second]), np.zeros(4))


def rated(pairs: DataFrame, models: Models) -> DataFrame:
    """``key, ratio`` of bigrams; what ``ratios`` gives for them."""
    held = pairs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            left, word, a, b = (c.to_numpy() for c in batch.columns)
            ratio = held.value.ratios(left, word, np.column_stack([a, b])).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(pair_keys(left, word)), pa.array(ratio)], names=["key", "ratio"])

    return pairs.mapInArrow(run, "key long, ratio float")


def counts_of(pairs: DataFrame, keys: np.ndarray) -> Table:
    """Both classes' counts of the bigrams with ``keys``."""
    wanted = pairs.sparkSession.sparkContext.broadcast(np.sort(keys))

    def run(batches):
        for batch in batches:
            key = pair_keys(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            at = np.minimum(np.searchsorted(wanted.value, key), max(0, len(wanted.value) - 1))
            kept = pa.array(wanted.value[at] == key if len(wanted.value) else np.zeros(len(key), bool))
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(2), batch.column(3)], names=["key", "ordinary", "toxic"]).filter(kept)

    held = pairs.mapInArrow(run, "key long, ordinary long, toxic long").toArrow()
    return Table(held["key"].to_numpy(), np.column_stack([held["ordinary"].to_numpy(), held["toxic"].to_numpy()]).astype(float), 0.0)


def calibrate(models: Models, pairs: DataFrame, sample: list[tuple[str, int]], sizes: dict[int, int]) -> None:
    """Logistic fit (Newton, with a little shrinkage) of labels on the ratio's measures; labels weigh as they occur."""
    held = [bigrams(word_numbers(t)) for t, _ in sample]
    counts = counts_of(pairs, np.unique(np.concatenate([keys for _, _, keys in held])))
    y = np.array([label for _, label in sample], float)
    x = np.array([measures(models.ratios(left, word, counts[keys], int(label))) for (left, word, keys), label in zip(held, y, strict=True)])
    w = np.where(y == 1, sizes.get(1, 0) / max(1, (y == 1).sum()), sizes.get(0, 0) / max(1, (y == 0).sum()))
    w = w / w.mean()
    scale = np.abs(x).mean(axis=0) + 1e-9
    x = x / scale
    beta, flips = np.zeros(4), 0.0
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        # Some ordinary texts carry the label 1 by mistake: its chance at q = 0 is ``flips``.
        clean = np.where(y == 1, q / np.maximum(q + flips * (1 - q), 1e-12), 0.0)
        flips = float(np.clip((w * (y - clean)).sum() / max(1e-9, (w * (1 - clean)).sum()), 0.0, 0.3))
        grad = x.T @ (w * (q - clean)) + 1e-2 * beta
        beta = beta - np.clip(np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(4), grad), -2, 2)
    models.beta = beta / scale


def fit(rows: DataFrame, labels: DataFrame) -> tuple[Models, DataFrame, str]:
    """Models from all of ``rows`` (doc_id, text) that ``labels`` (doc_id, label of 0 or 1) covers, the bigrams counted and their path."""
    known = labels.where("label in (0, 1)").distinct()
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    held = F.broadcast(known) if sum(sizes.values()) <= BROADCAST_LABELS else known
    pairs, path = stored(count_pairs(rows.join(held, "doc_id").select("text", "label")))
    models = train(pairs, RARE)
    sample: list[tuple[str, int]] = []
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= CALIBRATION_CHARS)
    for label in sizes:
        wanted = smallest_hashes(known.where(F.col("label") == label), CALIBRATION, "doc_id")
        wanted = rows.sparkSession.createDataFrame(wanted, "doc_id long")  # bounded by the sample
        # An id that repeats calibrates with its first text in order.
        found = short.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        sample += [(r.text or "", label) for r in found.toLocalIterator()]
    if len({label for _, label in sample}) == 2:
        calibrate(models, pairs, sample, sizes)
    else:
        models.beta = np.array([0.0, 0.0, 0.0, 3.0 if sample and sample[0][1] else -3.0])
    return models, pairs, path


def text_sums(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """``doc_id, held_out, digest, n, total, clear`` of rows (doc_id, text, held_out, digest) from one round's tables."""
    held = rows.sparkSession.sparkContext.broadcast(scorer)

    def start():
        scorer = held.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, total, clear = scorer.sums(strings(batch.column(1)))
            columns = [pa.array(n), pa.array(total, pa.float64()), pa.array(clear, pa.float64())]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *columns], names=["doc_id", "held_out", "digest", "n", "total", "clear"])

        return work

    return map_rows(rows.select("doc_id", "text", "held_out", "digest"), "doc_id long, held_out boolean, digest string, n long, total double, clear double", start)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    ``labels`` has doc_id and toxic; only ids whose crc32 modulo ``held_out[0]`` isn't ``held_out[1]`` are learned from.
    ``predicted`` is 1 if ``score`` is at least ``threshold``. Null and empty texts score the calibration's constant; null
    ids aren't held out; very long texts are counted and scored whole; equal texts score alike and repeated rows are kept;
    other columns are ignored, whatever their names. Without labels of both kinds every text scores alike; an empty table
    gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    rows = rows.withColumn("held_out", F.coalesce(fold("doc_id", held_out[0]) == held_out[1], F.lit(False)))
    known = labels.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) label").where(fold("doc_id", held_out[0]) != held_out[1])
    models, pairs, path = fit(rows.where("not held_out").select("doc_id", "text"), known)
    frequent = often(pairs)
    rounds = max(1, math.ceil(frequent.count() / PAIRS_AT_ONCE))
    rows = rows.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))) if rounds > 1 else F.lit(None).cast("string"))
    for k in range(rounds):
        part = rated(frequent.where(F.pmod(F.xxhash64("left", "word"), F.lit(rounds)) == k), models).toArrow()
        table = Table(part["key"].to_numpy(), part["ratio"].to_numpy(), np.float32(0))
        sums = text_sums(rows, Scorer.of(models, table, k == 0))
        if k == 0:
            out = sums
            continue
        # Equal texts have equal sums: one row each, written before the next round's tables are made.
        more, _ = stored(sums.select("digest", F.col("total").alias("more"), F.col("clear").alias("clearer")).dropDuplicates(["digest"]))
        out = out.join(more, "digest").withColumns({"total": F.col("total") + F.col("more"), "clear": F.col("clear") + F.col("clearer")}).drop("more", "clearer")
    drop_stored(docs.sparkSession, path)
    a, b, c, d = (F.lit(float(x)) for x in models.beta)
    n = F.greatest("n", F.lit(1))
    logit = a * F.col("total") / n + b * F.col("clear") / n + c * F.col("clear") / F.sqrt(n) + d
    out = out.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), logit)))))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
