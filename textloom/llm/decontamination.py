"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

The index is of test items; every passage of every document is a query to it. An item's impacts are its BM25 weights
divided by its own score, so that a passage holding all of it scores at least one and one threshold suits all items.
Passages are windows of twice the longest item, a step of that length apart, so each item lies whole in one of them. Block
maxima rule out blocks of items whose bound stays below the threshold; the rest are walked item by item with pivots. All
items at or above the threshold are retrieved and then verified by word shingles of question and answer.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textloom.llm.batches import drop_stored, id_and_text, map_rows, quoted, stored

_WORDS = re.compile(r"[^\W_]+").findall
K1, B = 1.2, 0.75
#: Items of one block of the index.
BLOCK = 4
#: Characters of items indexed and broadcast at a time; more items make further passes.
INDEX_CHARS = 4_000_000
SHINGLE = 5


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


def shingles(tokens: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    """Word shingles; fewer words are one shingle, none give none."""
    if not tokens:
        return set()
    return {tuple(tokens[k : k + size]) for k in range(max(1, len(tokens) - size + 1))}


def question_and_answer(text: str) -> tuple[str, str]:
    """Split at an answer mark, else after the last question mark, else before the last sentence."""
    for pattern in (r"(?is)^(.*?\S)\s*\banswer\s*:\s*(\S.*)$", r"(?s)^(.*\?)\s*(\S.*)$", r"(?s)^(.*[.!])\s+(\S[^.!]*[.!]?\s*)$"):
        if found := re.match(pattern, text):
            return found[1], found[2]
    return text, text


@dataclass
class Item:
    item_id: int | None
    tokens: list[str]
    whole: set
    question: set
    answer: set


class ItemIndex:
    """Inverted index of some items, with statistics of all of them."""

    def __init__(self, items: list[tuple[int | None, str]], df: dict[str, int], total: int, mean: float) -> None:
        made = []
        for item_id, text in items:
            q, a = question_and_answer(text)
            if tokens := words(text):
                made.append(Item(item_id, tokens, shingles(tokens), shingles(words(q)), shingles(words(a))))
        # Items of alike words share blocks, which keeps the bounds tight.
        made.sort(key=lambda i: (Counter(i.tokens).most_common(1)[0][0], i.tokens))
        self.items = made
        self.longest = max((len(i.tokens) for i in made), default=0)
        self.blocks = -(-len(made) // BLOCK)
        self.term: dict[str, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for at, item in enumerate(made):
            tf = Counter(item.tokens)
            norm = K1 * (1 - B + B * len(item.tokens) / mean)
            weight = {t: math.log(1 + (total - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in tf.items()}
            own = sum(weight.values())
            for t, w in weight.items():
                k = self.term.setdefault(t, len(self.term))
                if k == len(postings):
                    postings.append([])
                postings[k].append((at, w / own))
        self.postings = [{at: w for at, w in p} for p in postings]
        self.best = np.array([max(w for _, w in p) for p in postings] or [0.0])
        # Rows of block maxima, one term after the other.
        rows: list[tuple[int, float]] = []
        ends = [0]
        for p in postings:
            most: dict[int, float] = {}
            for at, w in p:
                most[at // BLOCK] = max(w, most.get(at // BLOCK, 0.0))
            rows += most.items()
            ends.append(len(rows))
        self.block_of = np.array([b for b, _ in rows], np.int64)
        self.block_max = np.array([w for _, w in rows])
        self.ends = np.array(ends)

    def candidates(self, ids: np.ndarray, step: int, threshold: float) -> list[tuple[int, int, np.ndarray]]:
        """Blocks whose bound reaches ``threshold``: (window, block, distinct terms of the window), by window.

        Window k holds the words from ``k * step`` on, ``2 * step`` of them; ``ids`` are term numbers, -1 for words
        that no item has.
        """
        number, out = len(self.term), []
        windows = max(1, -(-(len(ids) - step) // step))
        for low in range(0, windows, 256):
            high = min(windows, low + 256)
            part = ids[low * step : (high + 1) * step]
            at = np.flatnonzero(part >= 0)
            own = at // step
            keys = np.r_[own * number + part[at], (own - 1) * number + part[at]]
            keys = np.unique(keys[(keys >= 0) & (keys < (high - low) * number)])
            window, term = np.divmod(keys, number)
            reach = np.bincount(window, self.best[term], high - low) >= threshold
            window, term = window[reach[window]], term[reach[window]]
            if not len(window):
                continue
            first, size = self.ends[term], self.ends[term + 1] - self.ends[term]
            rows = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            bound = np.bincount(np.repeat(window, size) * self.blocks + self.block_of[rows], self.block_max[rows], (high - low) * self.blocks)
            for hit in np.flatnonzero(bound >= threshold - 1e-9):
                k, block = divmod(int(hit), self.blocks)
                out.append((low + k, block, term[window == k]))
        return out

    def _walk(self, lists: list[dict[int, float]], first: int, last: int, threshold: float) -> list[tuple[int, float]]:
        """WAND inside a block: lists by their next item, the pivot is where summed block maxima reach the threshold."""
        live = []
        for p in lists:
            held = [(at, p[at]) for at in range(first, last) if at in p]
            if held:
                live.append([held[0][0], max(w for _, w in held), held, 0])
        found = []
        while live:
            live.sort(key=lambda c: c[0])
            total, pivot = 0.0, None
            for cursor in live:
                total += cursor[1]
                if total >= threshold:
                    pivot = cursor[0]
                    break
            if pivot is None:
                break
            if live[0][0] == pivot:
                score = sum(c[2][c[3]][1] for c in live if c[0] == pivot)
                if score >= threshold:
                    found.append((pivot, score))
                goal = pivot + 1
            else:
                goal = pivot
            for cursor in live:
                while cursor[3] < len(cursor[2]) and cursor[2][cursor[3]][0] < goal:
                    cursor[3] += 1
                cursor[0] = cursor[2][cursor[3]][0] if cursor[3] < len(cursor[2]) else -1
            live = [c for c in live if c[0] >= 0]
        return found

    def search(self, tokens: list[str], threshold: float, overlap: float) -> list[tuple[int | None, float, float, float, float]]:
        """Items verified in a text's words: (item_id, score, overlap, question overlap, answer overlap), the best of each."""
        get = self.term.get
        ids = np.fromiter((get(t, -1) for t in tokens), np.int64, len(tokens))
        best: dict[int | None, tuple[float, float, float, float]] = {}
        step, here = max(self.longest, 8), -1
        for window, block, terms in self.candidates(ids, step, threshold):
            first = block * BLOCK
            for at, score in self._walk([self.postings[t] for t in terms], first, first + BLOCK, threshold - 1e-9):
                if here != window:
                    here, passage = window, tokens[window * step : (window + 2) * step]
                    near, joined = shingles(passage), f" {' '.join(passage)} "
                item = self.items[at]
                row = (score, *(_share(wanted, near, joined) for wanted in (item.whole, item.question, item.answer)))
                if (row[1] >= overlap or min(row[2:]) >= overlap) and row > best.get(item.item_id, (0.0,)):
                    best[item.item_id] = row
        return [(k, *v) for k, v in sorted(best.items(), key=lambda x: (x[0] is None, x[0] or 0))]


def _share(wanted: set, near: set, joined: str) -> float:
    """The share of an item's shingles that a passage holds; parts of fewer words are looked for as they are."""
    held = sum(s in near if len(s) == SHINGLE else f" {' '.join(s)} " in joined for s in wanted)
    return held / len(wanted) if wanted else 1.0


def build_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", chars: int = INDEX_CHARS) -> Iterator[list[ItemIndex]]:
    """Indexes of ``chars`` of test items at a time, together all items; null and wordless ones are left out.

    Equal rows count once, and items with a null id like any other. The driver streams the items, once for the statistics
    and once for the indexes, and holds one part of them. Items of a part that differ in length by more than a factor of
    four have indexes of their own, so that a long item doesn't widen the passages of all.
    """
    rows = benchmark.select(F.col(quoted(id_col)).cast("long").alias("item_id"), F.col(quoted(text_col)).cast("string").alias("text")).where("text is not null").distinct()
    rows, path = stored(rows)
    df: Counter = Counter()
    length = total = 0
    for row in rows.select("text").toLocalIterator():
        tokens = words(row.text)
        df.update(set(tokens))
        length += len(tokens)
        total += bool(tokens)

    def made(part: list[tuple[int | None, str]]) -> list[ItemIndex]:
        zones: dict[int, list[tuple[int | None, str]]] = {}
        for item in part:
            zones.setdefault(max(0, len(words(item[1])).bit_length() - 6) // 2, []).append(item)
        indexes = [ItemIndex(own, df, total, length / max(1, total)) for _, own in sorted(zones.items())]
        return [i for i in indexes if i.items]

    part, size = [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        part.append((row.item_id, row.text))
        size += len(row.text)
        if size >= chars:
            yield made(part)
            part, size = [], 0
    if part:
        yield made(part)
    drop_stored(benchmark.sparkSession, path)


def matches(indexes: list[ItemIndex], text: str | None, threshold: float, overlap: float) -> list[tuple[int | None, float, float, float, float]]:
    tokens = words(text) if text else []
    return [hit for index in indexes for hit in index.search(tokens, threshold, overlap)] if tokens else []


_NAMES = ("item_id", "score", "overlap", "question_overlap", "answer_overlap")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, id_col: str = "doc_id", text_col: str = "text", chars: int = INDEX_CHARS) -> DataFrame:
    """``doc_id, item_id, score, overlap, question_overlap, answer_overlap`` of every verified pair.

    ``threshold`` is the share of an item's own BM25 score that a passage must reach to be retrieved. A pair is verified
    if ``overlap`` of the item's five-word shingles, or of those of question and of answer alike, stand in one passage.
    Repeated rows give repeated pairs; rows or items with a null id are reported with a null id; null and empty texts
    hold nothing; very long texts are searched whole. Other columns are ignored, whatever their names. An empty benchmark
    or an empty table gives no rows. Each index is searched in a pass of its own.
    """
    spark, docs = docs.sparkSession, id_and_text(docs, id_col, text_col)
    schema = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    kinds = [pa.int64()] * 2 + [pa.float64()] * 4

    def search(held) -> DataFrame:
        def start():
            def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                found = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in matches(held.value, text, threshold, overlap)]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["doc_id", *_NAMES]) if found else None

            return work

        return map_rows(docs, schema, start)

    parts = [search(spark.sparkContext.broadcast(indexes)) for indexes in build_indexes(benchmark, chars=chars)]
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, text_col: str = "text", chars: int = INDEX_CHARS) -> DataFrame:
    """The rows, all columns kept, in which no test item is verified.

    Null and empty texts, null ids and repeated rows stay, as do columns of any name; an empty benchmark drops nothing.
    Indexes are searched one after the other, each in what the one before has left, which is written in between. Whole rows
    go through Python in batches: for a function of the text alone Spark would keep every row that waits for its answer.
    """
    spark, names, before = docs.sparkSession, docs.columns, []
    text = names.index(text_col) if text_col in names else [c.lower() for c in names].index(text_col.lower())
    plain = [f"c{k}" for k in range(len(names))]  # mapInArrow takes no dots or backticks
    schema = StructType([StructField(c, f.dataType, f.nullable, f.metadata) for c, f in zip(plain, docs.schema, strict=True)])
    more = [] if schema[text].dataType == StringType() else [F.col(plain[text]).cast("string").alias("as_text")]
    at = len(names) if more else text

    def clean(rows: DataFrame, held) -> DataFrame:
        def start():
            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                kept = [not matches(held.value, t, threshold, overlap) for t in batch.column(at).to_pylist()]
                return batch.select(plain).filter(pa.array(kept, pa.bool_()))

            return work

        return map_rows(rows.toDF(*plain).select("*", *more), schema, start, at).toDF(*names)

    for number, indexes in enumerate(build_indexes(benchmark, chars=chars)):
        if number:
            docs, path = stored(docs)
            drop_stored(spark, *before)
            before = [path]
        docs = clean(docs, spark.sparkContext.broadcast(indexes))
    return docs
