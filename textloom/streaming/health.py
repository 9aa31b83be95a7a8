"""Crawl health as streams: decayed domain averages, status streaks, incremental indexing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators import bm25


def stream_decayed_means(samples: DataFrame, decay: float = 0.2) -> DataFrame:
    """Running decayed mean of samples (key long, t double, v double), one row a key and batch.

    State is three numbers a key: sum, weight and time. Rows older than the state's time count as of that time.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, weight, last = state.get if state.exists else (0.0, 0.0, -math.inf)
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        for t, v in zip(rows["t"], rows["v"], strict=True):
            t = max(t, last)
            fade = math.exp(-decay * (t - last)) if last > -math.inf else 0.0
            total, weight, last = total * fade + v, weight * fade + 1.0, t
        state.update((total, weight, last))
        yield pd.DataFrame({"key": [key[0]], "n": [weight], "average": [total / weight]})

    return samples.groupBy("key").applyInPandasWithState(step, "key long, n double, average double", "total double, weight double, last double", "update", GroupStateTimeout.NoTimeout)


def stream_streaks(events: DataFrame) -> DataFrame:
    """Running streak of equal codes of events (key long, seq long, code string), one row a key and batch."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        code, streak = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for c in rows["code"]:
            code, streak = c, streak + 1 if c == code else 1
        state.update((code, streak))
        yield pd.DataFrame({"key": [key[0]], "code": [code], "streak": [streak]})

    return events.groupBy("key").applyInPandasWithState(step, "key long, code string, streak long", "code string, streak long", "update", GroupStateTimeout.NoTimeout)


def stream_rates(requests: DataFrame, seconds: int = 60, most: int = 60) -> DataFrame:
    """Admission of requests (key long, t double), in order of time: ``key, t, used, allowed, reset``.

    ``used`` counts the requests admitted in the ``seconds`` up to one; over ``most`` it is refused, and ``reset`` is when
    the oldest of them leaves. State is the times of the admitted requests in the window, at most ``most`` a key.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for t in pd.concat(list(batches))["t"].sort_values():
            held = [h for h in held if h > t - seconds]
            allowed = len(held) < most
            if allowed:
                held.append(t)
            out.append((key[0], t, len(held), allowed, held[0] + seconds))
        state.update((held,))
        yield pd.DataFrame(out, columns=["key", "t", "used", "allowed", "reset"])

    return requests.groupBy("key").applyInPandasWithState(step, "key long, t double, used long, allowed boolean, reset double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def stream_releases(urls: DataFrame, delay: float = 1.5) -> DataFrame:
    """When each URL of a stream (domain string, url string, t double) may be fetched: ``domain, url, release``.

    A domain's URLs are at least ``delay`` seconds apart, in order of time and then of URL; state is one number a domain.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else -math.inf
        out = []
        for t, url in _in_order(batches):
            free = max(t, free)
            out.append((key[0], url, free))
            free += delay
        state.update((free,))
        yield pd.DataFrame(out, columns=["domain", "url", "release"])

    return urls.groupBy("domain").applyInPandasWithState(step, "domain string, url string, release double", "free double", "append", GroupStateTimeout.NoTimeout)


def _in_order(batches: Iterator[pd.DataFrame]) -> list[tuple[float, str]]:
    rows = pd.concat(list(batches))
    return sorted(zip(rows["t"], rows["url"], strict=True))


def index_batch(folder: str):
    """A ``foreachBatch`` function that appends postings, lengths and term counts of documents it hasn't seen.

    ``plans.indexing.load_streamed`` reads them as an index, with idf and mean length of all batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/documents")
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        fresh = _once(batch)
        if files.exists(where):
            fresh = bm25.unindexed(fresh, spark.read.schema("doc_id long, doc_length int, batch long").parquet(f"{folder}/documents").where(F.col("batch") != number))
        # A batch that is run again after a failure overwrites its own folders.
        postings = f"{folder}/postings/batch={number}"
        bm25.word_postings(bm25.words(fresh)).write.mode("overwrite").parquet(postings)
        held = spark.read.schema("doc_id long, term string, freq long").parquet(postings)
        held.groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum("freq").alias("total_freq")).write.mode("overwrite").parquet(f"{folder}/terms/batch={number}")
        held.groupBy("doc_id").agg(F.sum("freq").cast("int").alias("doc_length")).write.mode("overwrite").parquet(f"{folder}/documents/batch={number}")

    return write


def _once(batch: DataFrame) -> DataFrame:
    """One row of each id; only rows whose id repeats are shuffled with their texts."""
    twice = batch.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return batch
    same = batch.doc_id.eqNullSafe(twice.doc_id)
    return batch.join(twice, same, "left_anti").unionByName(batch.join(twice, same, "left_semi").dropDuplicates(["doc_id"]))
