"""Language identification by interpolated Kneser-Ney character models.

Each language has a trigram model over lower-case letters, all other characters being breaks, counted over all training
texts in a written table that grows with them. A trigram's key is its three code points side by side in 63 bits, so that no
two letters of any script fall together. A model is sorted arrays of n-gram keys with natural logs, looked up by binary
search. The language of the lowest length-normalised cross-entropy is chosen. The temperature that turns cross-entropies
into a score, and the cross-entropy beyond which a text is rejected, are calibrated on every training text, in which
trigrams that only the text itself has count as unseen.

Workers hold the models of as many languages as have ``KEYS_AT_ONCE`` trigrams; more languages make further rounds over
the texts, whose best languages and sums are merged.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.batches import drop_stored, fold, id_and_text, map_rows, slices, stored, strings

WIDTH = 21
SYMBOL, PAIR = (1 << WIDTH) - 1, (1 << 2 * WIDTH) - 1
UNKNOWN = "und"
#: Temperatures that calibration chooses from.
TEMPERATURES = np.geomspace(0.1, 10, 41).tolist()
#: The share of a language's texts that its rejection threshold keeps, in steps a nat of cross-entropy, and the nats beyond it.
KEPT, STEPS, BEYOND = 0.995, 1000, 0.5
#: Trigrams of the models that workers hold at a time; a language with more is held alone.
KEYS_AT_ONCE = 6_000_000


def _symbol_table() -> np.ndarray:
    """The lower-case letter of each code point of the basic plane; 0 for what isn't a letter."""
    table = np.zeros(0x10000, np.int32)
    for c in range(0x10000):
        if chr(c).isalpha():
            table[c] = ord(chr(c).lower()[0])
    return table


_TABLE = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """Letters of a text: runs of other characters are one 0, and a 0 stands at both ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _TABLE[np.minimum(codes, 0xFFFF)]
    if (far := codes >= 0x10000).any():
        kinds, place = np.unique(codes[far], return_inverse=True)
        out[far] = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in kinds], np.int32)[place]
    out = np.r_[0, out, 0]
    return out[np.r_[True, (out[1:] != 0) | (out[:-1] != 0)]].astype(np.int64)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram keys, sorted, and their counts; texts without a letter have none."""
    s = symbols(text)
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.r_[0, s]
    return np.unique((s[:-2] << 2 * WIDTH) | (s[1:-1] << WIDTH) | s[2:], return_counts=True)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each wanted key's place, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _discount(counts: np.ndarray) -> float:
    """Kneser and Ney's discount from the numbers of ones and twos."""
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5


def _summed(keys: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place, values, len(distinct))


@dataclass
class Model:
    """One language: sorted keys of each order with natural logs, and those of the mass left to the order below."""

    keys3: np.ndarray
    counts3: np.ndarray
    log3: np.ndarray
    contexts3: np.ndarray
    back3: np.ndarray
    keys2: np.ndarray
    log2: np.ndarray
    contexts2: np.ndarray
    back2: np.ndarray
    keys1: np.ndarray
    log1: np.ndarray
    floor: float  # of a letter that the language has never shown

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, alphabet: int) -> Model:
        """From distinct trigram keys (sorted) and counts; ``alphabet`` is the number of symbols, one of them for all unknown ones."""
        # Continuation counts: different left neighbours of each pair, then of each symbol.
        keys2, left2 = _summed(keys & PAIR)
        keys1, left1 = _summed(keys2 & SYMBOL)
        d1, total1 = _discount(left1), max(1, left1.sum())
        floor = d1 * len(keys1) / total1 / alphabet if len(keys1) else 1 / alphabet
        p1 = np.maximum(left1 - d1, 0) / total1 + floor
        d2 = _discount(left2)
        contexts2, sum2 = _summed(keys2 >> WIDTH, left2)
        own = np.searchsorted(contexts2, keys2 >> WIDTH)
        weight2 = d2 * np.bincount(own, minlength=len(contexts2)) / np.maximum(sum2, 1)
        p2 = np.maximum(left2 - d2, 0) / np.maximum(sum2[own], 1) + weight2[own] * p1[np.searchsorted(keys1, keys2 & SYMBOL)]
        d3 = _discount(counts)
        contexts3, sum3 = _summed(keys >> WIDTH, counts)
        own = np.searchsorted(contexts3, keys >> WIDTH)
        weight3 = d3 * np.bincount(own, minlength=len(contexts3)) / np.maximum(sum3, 1)
        p3 = np.maximum(counts - d3, 0) / np.maximum(sum3[own], 1) + weight3[own] * p2[np.searchsorted(keys2, keys & PAIR)]
        logs = [np.log(x).astype(np.float32) for x in (p3, weight3, p2, weight2, p1)]
        return cls(keys, counts, logs[0], contexts3, logs[1], keys2, logs[2], contexts2, logs[3], keys1, logs[4], float(np.log(floor)))

    def logs(self, keys: np.ndarray, less: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each trigram's last symbol; those counted no more than ``less`` are taken as unseen."""
        at, seen = _find(self.keys3, keys)
        if less is not None:
            seen[seen] = self.counts3[at[seen]] > less[seen]
        out = np.zeros(len(keys))
        out[seen] = self.log3[at[seen]]
        rest = np.flatnonzero(~seen)
        if len(rest):
            wanted = keys[rest]
            at, known = _find(self.contexts3, wanted >> WIDTH)
            out[rest[known]] = self.back3[at[known]]
            at, seen = _find(self.keys2, wanted & PAIR)
            out[rest[seen]] += self.log2[at[seen]]
            rest, wanted = rest[~seen], wanted[~seen]
            at, known = _find(self.contexts2, wanted >> WIDTH & SYMBOL)
            out[rest[known]] += self.back2[at[known]]
            at, seen = _find(self.keys1, wanted & SYMBOL)
            out[rest[seen]] += self.log1[at[seen]]
            out[rest[~seen]] += self.floor
        return out


@dataclass
class Calibration:
    """What turns cross-entropies into a score, and the cross-entropy beyond which each language's texts are rejected."""

    temperature: float
    reject: dict[str, float]


def entropies(models: dict[str, Model], found: list[tuple[np.ndarray, np.ndarray]], own: Sequence[str] = ()) -> np.ndarray:
    """Cross-entropy, in nats a character, of each text's trigrams (rows) in each language (columns).

    ``own`` are the languages that count the texts: there, trigrams that only the text itself has are unseen.
    """
    keys, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    text = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
    size = np.maximum(np.bincount(text, counts, len(found)), 1)

    def column(lang: str, model: Model) -> np.ndarray:
        less = np.where(np.array([x == lang for x in own])[text], counts, 0) if lang in own else None
        return -np.bincount(text, counts * model.logs(keys, less), len(found)) / size

    return np.column_stack([column(lang, m) for lang, m in models.items()])


def count_trigrams(docs: DataFrame) -> DataFrame:
    """``lang, key, n`` over all rows of (lang, text); every task sums up before the shuffle."""

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0

        def summed(parts):
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            return keys, counts.astype(np.int64)

        def release():
            for lang, parts in held.items():
                keys, counts = summed(parts)
                for at in range(0, len(keys), 100_000):
                    some = keys[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(counts[at : at + 100_000])], names=["lang", "key", "n"])

        for batch in slices(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                found = trigrams(text)
                held.setdefault(lang, []).append(found)
                waiting += len(found[0])
            if waiting > 1_000_000:
                held = {k: [summed(v)] for k, v in held.items()}
                waiting = 0
                if sum(len(v[0][0]) for v in held.values()) > 1_000_000:
                    yield from release()
                    held = {}
        yield from release()

    return docs.select("lang", "text").mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Trained:
    """The written counts of every language, and the groups of languages whose models are held together."""

    def __init__(self, docs: DataFrame) -> None:
        docs = docs.where("lang is not null")
        self.counts, self.path = stored(count_trigrams(docs))
        sizes = {r.lang: r["count"] for r in self.counts.groupBy("lang").count().orderBy("lang").collect()}
        self.alphabet = self.counts.select(F.col("key").bitwiseAND(SYMBOL).alias("s")).distinct().count() + 1
        self.groups: list[list[str]] = []
        held = 0
        for lang, n in sizes.items():
            if not self.groups or held + n > KEYS_AT_ONCE:
                self.groups.append([])
                held = 0
            self.groups[-1].append(lang)
            held += n
        self.held = [docs.sparkSession.sparkContext.broadcast(self.models(group)) for group in self.groups]
        self.calibration = calibrated(docs, self.held)

    def models(self, group: list[str]) -> dict[str, Model]:
        """Models of a group's languages, from their sorted trigram keys and counts."""
        rows = self.counts.where(F.col("lang").isin(group)).orderBy("lang", "key").toArrow().combine_chunks()
        lang, keys, n = rows["lang"].to_numpy(), rows["key"].to_numpy(), rows["n"].to_numpy()
        starts = np.r_[np.flatnonzero(np.r_[True, lang[1:] != lang[:-1]][: len(lang)]), len(lang)]
        return {str(lang[a]): Model.of(keys[a:b], n[a:b], self.alphabet) for a, b in zip(starts[:-1], starts[1:], strict=True)}


def training_odds(rows: DataFrame, held) -> DataFrame:
    """``lang, digest, letters, own, odds`` of training texts that have letters.

    ``own`` is the cross-entropy in the text's own language, null if that isn't among the models held; ``odds`` are, for
    each of ``TEMPERATURES``, what ``judged`` gives.
    """

    def start():
        models = held.value
        names = {lang: k for k, lang in enumerate(models)}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found = [trigrams(t) for t in strings(batch.column(1))]
            some = [k for k, (keys, _) in enumerate(found) if len(keys)]
            if not some:
                return None
            batch, found = batch.take(pa.array(some)), [found[k] for k in some]
            size, langs = np.array([c.sum() for _, c in found], np.int64), batch.column(0).to_pylist()
            h = entropies(models, found, langs)
            own = [float(h[k, names[x]]) if x in names else None for k, x in enumerate(langs)]
            best, sharp = h.min(axis=1), np.sqrt(size)
            odds = np.column_stack([np.log(np.exp(-(h - best[:, None]) * sharp[:, None] * t).sum(axis=1)) - best * sharp * t for t in TEMPERATURES])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(TEMPERATURES), pa.int32()), pa.array(odds.ravel()))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size), pa.array(own, pa.float64()), lists], names=["lang", "digest", "letters", "own", "odds"])

        return work

    return map_rows(rows.select("lang", "text", "digest"), "lang string, digest string, letters long, own double, odds array<double>", start)


def calibrated(docs: DataFrame, held: list) -> Calibration:
    """Temperature by maximum likelihood over all of (lang, text), rejection by all of each language's own texts.

    The sum of losses is of decimals, so that their order doesn't matter, and the threshold of a language is an order
    statistic of its texts' cross-entropies, rounded up to a step: both are alike in every run, and nothing is sampled.
    """
    if not held:
        return Calibration(1.0, {})
    rows = docs.withColumn("digest", F.md5("text") if len(held) > 1 else F.lit(None).cast("string"))
    out, paths = training_odds(rows, held[0]), []
    for models in held[1:]:
        # Equal texts of a language have equal results: one row each.
        more = training_odds(rows, models).select("lang", "digest", F.col("own").alias("own_"), F.col("odds").alias("odds_"))
        more, path = stored(more.dropDuplicates(["lang", "digest"]))
        paths.append(path)
        odds = F.zip_with("odds", "odds_", lambda a, b: F.greatest(a, b) + F.log1p(F.exp(F.least(a, b) - F.greatest(a, b))))
        out = out.join(more, ["lang", "digest"]).select("lang", "digest", "letters", F.coalesce("own", "own_").alias("own"), odds.alias("odds"))
    out, path = stored(out.drop("digest"))
    losses = [F.sum((F.col("odds")[k] + F.col("own") * F.sqrt("letters") * t).cast("decimal(38,9)")) for k, t in enumerate(TEMPERATURES)]
    total = out.agg(*losses).first()
    step = F.ceil(F.col("own") * STEPS)
    steps: dict[str, list[tuple[int, int]]] = {}
    for lang, at, n in out.groupBy("lang", step.alias("step")).count().orderBy("lang", "step").toLocalIterator():
        steps.setdefault(lang, []).append((at, n))
    drop_stored(docs.sparkSession, path, *paths)
    reject = {}
    for lang, found in steps.items():
        left = math.ceil(KEPT * sum(n for _, n in found))
        for at, n in found:
            left -= n
            if left <= 0:
                reject[lang] = at / STEPS + BEYOND
                break
    return Calibration(TEMPERATURES[min(range(len(TEMPERATURES)), key=lambda k: total[k])], reject)


def judged(rows: DataFrame, held, temperature: float) -> DataFrame:
    """``doc_id, held_out, digest, letters, best, h, odds``: each text's best of the languages held, and the sum of all their odds.

    ``odds`` is the logarithm of the sum of ``exp(-h * temperature * sqrt(letters))``, which adds up over languages.
    """

    def start():
        models = held.value
        names = list(models)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [trigrams(t) for t in strings(batch.column(1))]
            size = np.array([c.sum() for _, c in found], np.int64)
            h = entropies(models, found)
            at = h.argmin(axis=1)
            best = h[np.arange(len(h)), at]
            sharp = temperature * np.sqrt(size)
            odds = np.log(np.exp(-(h - best[:, None]) * sharp[:, None]).sum(axis=1)) - best * sharp
            columns = [pa.array(size), pa.array([names[k] for k in at]), pa.array(best), pa.array(odds)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *columns], names=["doc_id", "held_out", "digest", "letters", "best", "h", "odds"])

        return work

    return map_rows(rows.select("doc_id", "text", "held_out", "digest"), "doc_id long, held_out boolean, digest string, letters long, best string, h double, odds double", start)


def identify(docs: DataFrame, held_out: tuple[int, int] = (4, 2), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row.

    Models learn from rows whose language isn't null and whose crc32(id) modulo ``held_out[0]`` isn't ``held_out[1]``;
    rows with a null id are not held out. ``lang_pred`` is a language learned, the first in order on ties; ``und`` if the
    text is null, empty or has no letter, or nothing could be learned, with score 0. ``rejected`` marks texts whose
    cross-entropy is beyond what the chosen language's own texts show. Very long texts are taken whole; repeated rows are
    kept; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col, lang=lang_col)
    rows = rows.withColumn("held_out", F.coalesce(fold("doc_id", held_out[0]) == held_out[1], F.lit(False)))
    trained = Trained(rows.where("not held_out"))
    several = len(trained.groups) > 1
    rows = rows.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))) if several else F.lit(None).cast("string"))
    out = None
    for held in trained.held:
        found = judged(rows, held, trained.calibration.temperature)
        if out is None:
            out = found
            continue
        # Equal texts have equal results: one row each, written before the next group's models are held.
        more, _ = stored(found.select("digest", F.col("best").alias("best_"), F.col("h").alias("h_"), F.col("odds").alias("odds_")).dropDuplicates(["digest"]))
        better = F.col("h_") < F.col("h")
        high, low = F.greatest("odds", "odds_"), F.least("odds", "odds_")
        out = out.join(more, "digest").withColumns({"best": F.when(better, F.col("best_")).otherwise(F.col("best")), "h": F.least("h", "h_"), "odds": high + F.log1p(F.exp(low - high))}).drop("best_", "h_", "odds_")
    drop_stored(spark, trained.path)
    if out is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    none = F.col("letters") == 0
    chance = F.exp(-F.col("h") * trained.calibration.temperature * F.sqrt("letters") - F.col("odds"))
    reject = F.lit(float("inf"))
    for lang, most in trained.calibration.reject.items():
        reject = F.when(F.col("best") == lang, F.lit(most)).otherwise(reject)
    return out.select(
        "doc_id",
        "held_out",
        F.when(none, F.lit(UNKNOWN)).otherwise(F.col("best")).alias("lang_pred"),
        F.when(none, F.lit(0.0)).otherwise(F.least(F.lit(1.0), chance)).alias("score"),
        (none | (F.col("h") > reject)).alias("rejected"),
    )
