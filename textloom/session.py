"""Session construction and the folder shared by driver and executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from textloom.config import SPARK


def get_session(name: str = "textloom", **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` overrides, with dots written as double underscores."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SPARK | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; set a private folder only where none is configured."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="textloom-"))
