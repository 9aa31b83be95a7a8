"""Overlapping text windows and chunk tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.cleaning import range_count


def window_starts(n: Column, window: int, step: int) -> Column:
    """Starts of full windows every ``step`` tokens, and of a last one that ends with the text."""
    regular = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)), F.lit(step))
    return F.when(n <= window, F.array(F.lit(0))).otherwise(F.array_union(regular, F.array(n - window)))


def sliding_windows(docs: DataFrame, window: int = 512, step: int = 450, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """``doc_id, pos, start, n_words, chunk_text`` of each window of words, of title and text if ``title_col`` is given; texts without words have none."""
    whole = F.concat_ws("\n", F.col(title_col), F.col(text_col)) if title_col else F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(whole, r"\s+"), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("words")).where(F.size("words") > 0)
    rows = rows.select("doc_id", "words", F.posexplode(window_starts(F.size("words"), window, step)).alias("pos", "start"))
    part = F.slice("words", F.col("start") + 1, window)
    return rows.select("doc_id", "pos", "start", F.size(part).alias("n_words"), F.array_join(part, " ").alias("chunk_text"))


def subword_windows(docs: DataFrame, vocabulary: str, window: int = 512, step: int = 450, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """``doc_id, pos, start, n_tokens, chunk_text`` of windows of a tokenizer's tokens, as slices of the text itself.

    ``vocabulary`` is a ``.json`` file of the tokenizers library, present on every machine. With ``title_col`` the title and
    a line break stand before the text. Texts without tokens have no window.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.concat(F.coalesce(F.col(title_col), F.lit("")), F.lit("\n"), text) if title_col else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(vocabulary)
        names = ["doc_id", "pos", "start", "n_tokens", "chunk_text"]
        for batch in batches:
            for doc, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = model.encode(whole, add_special_tokens=False).offsets
                starts = [*range(0, max(len(at) - window, 0) + 1, step)]
                starts += [len(at) - window] if len(at) > window and starts[-1] != len(at) - window else []
                rows = [(doc, k, s, min(window, len(at) - s), whole[at[s][0] : at[min(s + window, len(at)) - 1][1]]) for k, s in enumerate(starts) if at]
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, pos int, start int, n_tokens int, chunk_text string")


def with_chunk_ids(chunks: DataFrame, first: int = 0) -> DataFrame:
    """Chunks with contiguous ids by document and position: a running sum over documents, not a sort of all chunks.

    Documents are ranged by id; each range's offset is a sum over the few ranges before it.
    """
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    ranged = per.repartitionByRange(range_count(per), "doc_id").withColumn("range", F.spark_partition_id())
    sums = ranged.groupBy("range").agg(F.sum("n").alias("total"), F.min("doc_id").alias("low"))
    before = sums.select("low", (F.sum("total").over(Window.orderBy("low")) - F.col("total")).alias("offset"), F.lead("low").over(Window.orderBy("low")).alias("next"))
    within = per.join(F.broadcast(before), (per.doc_id >= before.low) & (before.next.isNull() | (per.doc_id < before.next)))
    running = F.sum("n").over(Window.partitionBy("low").orderBy("doc_id")) - F.col("n")
    starts = within.select("doc_id", (F.col("offset") + running + first).alias("base"))
    return chunks.join(starts, "doc_id").withColumn("chunk_id", F.col("base") + F.col("pos")).drop("base")


def first_chunks(chunks: DataFrame, most: int = 10) -> DataFrame:
    """Each document's first chunks by chunk id."""
    order = Window.partitionBy("doc_id").orderBy("chunk_id")
    return chunks.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)
