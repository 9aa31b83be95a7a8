"""Arrow batch plumbing and shared-folder tables used by every operator here."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and characters turned into Python objects at a time; a single longer text is still taken whole.
SLICE_ROWS = 256
SLICE_CHARS = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that few rows and few text bytes are Python objects at once."""
    for batch in batches:
        if text is None:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield batch.slice(at, SLICE_ROWS)
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if row > start and (row - start >= SLICE_ROWS or held + size > SLICE_CHARS):
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def strings(column: pa.Array) -> list[str]:
    """Texts of a column, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def map_rows(
    df: DataFrame,
    schema: str,
    start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
    text: int | None = 1,
) -> DataFrame:
    """Run ``start()`` once a task and its result on every slice; ``text`` is the position of the long column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for part in slices(batches, text):
            if (out := work(part)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def fold(doc_id: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def quoted(name: str) -> str:
    """A column's name as SQL and ``F.col`` take it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def id_and_text(df: DataFrame, id_col: str, text_col: str, **more: str) -> DataFrame:
    """``doc_id, text`` and ``more`` string columns of a table, by whatever names it has them; nothing else of it is read."""
    named = {"text": text_col, **more}
    return df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), *(F.col(quoted(c)).cast("string").alias(n) for n, c in named.items()))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a variation of it that ``df`` doesn't have in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a private one only where none is configured and there is but one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
        where = context.getCheckpointDir()
    return where.rstrip("/")


#: Tables stored and not deleted yet.
_held: set[str] = set()


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written once to the shared folder and read back, with its path; lineage ends there.

    Tables that a result still reads go when the application ends, all others by ``drop_stored`` as soon as they are used.
    """
    path = f"{shared_folder(df.sparkSession)}/textloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _place(df.sparkSession, path)
    files.deleteOnExit(where)
    _held.add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_stored(spark: SparkSession, *paths: str) -> None:
    """Delete tables that ``stored`` wrote."""
    for path in paths:
        files, where = _place(spark, path)
        files.delete(where, True)
        _held.discard(path)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """What ``make`` gives, stored; tables that it stored meanwhile are deleted, as the result no longer reads them."""
    before = set(_held)
    out, path = stored(make())
    drop_stored(spark, *(_held - before - {path}))
    return out, path


def smallest_hashes(df: DataFrame, rows: int, column: str) -> list[tuple]:
    """The ``rows`` distinct values of ``column`` with the smallest hashes, ties by value: alike in every run. Nulls have none."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    return [(r.value,) for r in values.orderBy(F.xxhash64("value"), "value").limit(rows).collect()]
