"""Readers and writers: tables, query files, run files, CSV, upserts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINK = T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("score", T.DoubleType())]))
URLS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("lastFetch", T.DoubleType()),
        T.StructField("incoming", LINK),
        T.StructField("domainLinkingDepth", T.ByteType()),
        T.StructField("linkingDepth", T.ByteType()),
        T.StructField("pageScore", T.DoubleType()),
    ]
)
FRONTIER = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("schedule", T.DoubleType()),
        T.StructField("delay", T.DoubleType()),
        T.StructField("url", T.StringType(), False),
        T.StructField("incomingLinks", LINK),
        T.StructField("domainLinkingDepth", T.ByteType()),
        T.StructField("linkingDepth", T.ByteType()),
    ]
)
CHUNKS = T.StructType([T.StructField("chunk_id", T.LongType(), False), T.StructField("doc_id", T.LongType()), T.StructField("chunk_text", T.StringType())])
EMBEDDINGS = T.StructType([T.StructField("chunk_id", T.LongType(), False), T.StructField("embedding", T.ArrayType(T.FloatType()))])
#: Prefix of nested values kept as JSON text. A fixed value.
JSON_MARK = "jsonDumps"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_columns(df: DataFrame, columns: Sequence[str] = (), where: tuple[str, object] | None = None) -> DataFrame:
    """Some columns of the rows whose ``where`` column has a value."""
    df = df.where(F.col(where[0]) == F.lit(where[1])) if where else df
    return df.select(*columns) if columns else df


def from_marked_json(value: Column, schema: str) -> Column:
    """A nested value kept as marked JSON text; null where the mark is missing."""
    return F.when(F.startswith(value, F.lit(JSON_MARK)), F.from_json(F.substring(value, len(JSON_MARK) + 1, 1 << 30), schema))


def to_marked_json(value: Column) -> Column:
    return F.concat(F.lit(JSON_MARK), F.to_json(value))


def parsed_queries(lines: DataFrame) -> DataFrame:
    """``query_num, query_text`` of tab-separated lines (value); blank and short lines are skipped, further fields too."""
    fields = F.split(F.trim("value"), "\t")
    return lines.where(F.trim("value") != "").where(F.size(fields) >= 2).select(F.trim(fields[0]).alias("query_num"), F.trim(fields[1]).alias("query_text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return parsed_queries(spark.read.text(path))


def run_lines(results: DataFrame) -> DataFrame:
    """``line`` of a run file: query, rank, URL and score with three digits, tab-separated."""
    return results.select(F.concat_ws("\t", F.col("query_num").cast("string"), F.col("rank").cast("string"), "url", F.format_string("%.3f", F.col("score").cast("double"))).alias("line"))


def write_run(results: DataFrame, path: str) -> None:
    """A run file in order of query and rank."""
    ordered = results.orderBy("query_num", "rank")
    run_lines(ordered).write.mode("overwrite").text(path)


def requests(bodies: DataFrame, top_k: int = 100) -> DataFrame:
    """``query_num, query_text, top_k`` of JSON search requests (value); what is missing gets a default, the id a random one."""
    held = F.from_json("value", "query string, top_k int, query_id string")
    return bodies.select(held.alias("r")).select(F.coalesce("r.query_id", F.replace(F.uuid(), F.lit("-"), F.lit(""))).alias("query_num"), F.coalesce("r.query", F.lit("")).alias("query_text"), F.coalesce("r.top_k", F.lit(top_k)).alias("top_k"))


def flattened(df: DataFrame, skip: Sequence[str] = (), separator: str = "_") -> DataFrame:
    """Nested structs as columns of their own, at any depth; arrays and maps as marked JSON; ``skip`` names are left out."""
    out: list[Column] = []

    def walk(kind: T.DataType, path: list[str]) -> None:
        if path and path[-1] in skip:
            return
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                walk(field.dataType, [*path, field.name])
            return
        value = F.col(".".join(f"`{p}`" for p in path))
        out.append((to_marked_json(value) if isinstance(kind, T.ArrayType | T.MapType) else value).alias(separator.join(path)))

    walk(df.schema, [])
    return df.select(*out)


def create(spark: SparkSession, name: str, schema: T.StructType | str) -> None:
    """An empty table, if there is none of this name."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.saveAsTable(name)


def create_as(df: DataFrame, name: str) -> None:
    """A table of a result, in place of any there was; readers see the old one or the new one whole."""
    df.write.mode("overwrite").saveAsTable(name)


def truncate(spark: SparkSession, name: str) -> None:
    """A table without its rows."""
    spark.createDataFrame([], spark.table(name).schema).write.mode("overwrite").saveAsTable(name)


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def append(rows: DataFrame | object, name: str, spark: SparkSession | None = None) -> None:
    """Add rows, of a DataFrame or a pandas frame, to a table; columns are matched by name."""
    df = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows)
    kinds = df.sparkSession.table(name).schema
    df.select(*[F.col(f.name).cast(f.dataType) for f in kinds]).write.mode("append").saveAsTable(name)


def committed(batches: Sequence[Callable[[], DataFrame]], folder: str) -> list[int]:
    """Write each batch as a folder of its own; those complete already are skipped, so a failed run goes on where it ended.

    A batch is there whole or not at all: readers take only folders with a success mark. Numbers of those written now.
    """
    done = []
    for number, batch in enumerate(batches):
        df = batch()
        spark = df.sparkSession
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={number}/_SUCCESS")
        if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            df.write.mode("overwrite").parquet(f"{folder}/batch={number}")
            done.append(number)
    return done


def last_rows(df: DataFrame, columns: Sequence[str], most: int, id_col: str = "id") -> DataFrame:
    """The ``most`` rows of the greatest ids, latest first."""
    return df.select(*columns).orderBy(F.desc(id_col)).limit(most)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV file with a header; nested columns are flattened or, if they repeat, written as marked JSON."""
    flattened(df).write.mode("overwrite").option("header", True).csv(path)


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file, without its header, as comma-joined strings ``value``."""
    df = spark.read.option("header", True).csv(path)
    return df.select(F.concat_ws(",", *df.columns).alias("value"))


def insert_new(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``existing`` and those ``rows`` whose key it lacks, the first of each key by the other columns."""
    fresh = rows.join(existing.select(key), key, "left_anti").select(*existing.columns)
    rest = [c for c in existing.columns if c != key]
    held = fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("first")) if rest else fresh.distinct()
    return existing.unionByName(held.select(key, "first.*").select(*existing.columns) if rest else held)


def upsert(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``existing`` with ``rows`` in place of those of the same key; columns that ``rows`` lacks keep their values."""
    given = [c for c in rows.columns if c != key]
    new = rows.select(F.col(key), F.struct(*given).alias("new_row"))
    joined = existing.join(new, key, "full")
    return joined.select(key, *[F.when(F.col("new_row").isNotNull(), F.col(f"new_row.{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in existing.columns if c != key])


def updated(df: DataFrame, key: str, value: object, **changes: object) -> DataFrame:
    """Rows whose key has ``value`` get the changed columns."""
    hit = F.col(key) == F.lit(value)
    return df.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})


def next_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    """One row ``next_id``: one more than the greatest id, 0 for none."""
    return df.agg((F.coalesce(F.max(id_col), F.lit(-1)) + 1).alias("next_id"))


def exported_ranks(results: DataFrame) -> DataFrame:
    """Results (query_id, url, score) ranked anew by score in each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "url")
    return results.withColumn("rank", F.row_number().over(order))


def overlay(pending: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of both, pending values before stored ones: what a point lookup through a cache would see."""
    new = pending.select(F.col(key), F.struct(*[c for c in stored.columns if c != key]).alias("new_row"))
    joined = stored.join(new, key, "full")
    return joined.select(key, *[F.coalesce(F.col(f"new_row.{c}"), F.col(c)).alias(c) for c in stored.columns if c != key])


def seed_urls(spark: SparkSession, seeds: Sequence[str]) -> DataFrame:
    """Seeds as a table, each once, blank ones left out."""
    return spark.createDataFrame([(s.strip(),) for s in seeds if s.strip()], "url string").distinct()


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by ``key``, so that joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
