"""Cleaning of crawled documents: new URLs, duplicates, language filter, contiguous ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``: a partial minimum, not a sort of a key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    held = rows.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("first"))
    return held.select(*keys, "first.*").select(*rows.columns)


def clean_merge(existing: DataFrame, new: DataFrame, key: Column, keep: Column, id_col: str = "doc_id") -> DataFrame:
    """Existing rows and those new ones whose ``key`` is new, once each, that pass ``keep``; ids go on from the largest.

    Only columns that ``existing`` has are kept.
    """
    old = existing.withColumn("merge_key", key)
    fresh = new.withColumn("merge_key", key).join(old.select("merge_key"), "merge_key", "left_anti").where(keep)
    fresh = first_by(fresh, ["merge_key"], id_col)
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(-1)).alias("top"))
    fresh = with_running_ids(fresh, id_col).crossJoin(F.broadcast(top)).withColumn(id_col, F.col("top") + F.col("running"))
    return existing.unionByName(fresh.select(*existing.columns))


def with_running_ids(rows: DataFrame, order: str) -> DataFrame:
    """``running`` from 1 by a unique column, without a sort in one task: ranges are numbered, then offset."""
    ranged = rows.select(order).repartitionByRange(range_count(rows), order).withColumn("part", F.spark_partition_id())
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min(order).alias("low"))
    by_low = Window.orderBy("low")
    sizes = sizes.select("low", (F.sum("n").over(by_low) - F.col("n")).alias("offset"), F.lead("low").over(by_low).alias("next"))
    held = rows.join(F.broadcast(sizes), (F.col(order) >= F.col("low")) & (F.col("next").isNull() | (F.col(order) < F.col("next"))))
    return held.withColumn("running", F.col("offset") + F.row_number().over(Window.partitionBy("low").orderBy(order))).drop("low", "offset", "next")


def range_count(rows: DataFrame) -> int:
    """Ranges for numbering: a stated number isn't lowered for the ids alone being small, and so many hash evenly."""
    spark = rows.sparkSession
    return 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def value_counts(rows: DataFrame, flag: Column, name: str) -> DataFrame:
    return rows.groupBy(flag.alias(name)).agg(F.count("*").alias("n"))
