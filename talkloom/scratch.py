"""Intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of `path`, and a function from text to its paths."""
    of: Callable = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()), of


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables made inside when the block ends; write or collect the results in it."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            fs, of = file_system(spark, path)
            fs.delete(of(path), True)


def scratch_root(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session, else the checkpoint folder set on its context."""
    root = spark.conf.get(_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError(f"set {_CONF} to a folder every executor can reach")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody else uses, below the shared scratch folder."""
    path = f"{scratch_root(spark)}/talkloom/{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back.

    Cuts the lineage before a frame is used several times: later uses are columnar scans with
    known sizes, and a lost executor re-reads files instead of recomputing the upstream plan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
