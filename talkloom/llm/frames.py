"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.scratch import scratch_path

_BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, limit: int = _BATCH_BYTES) -> None:
    """Keep the Arrow batches of Python tasks small in bytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder of `spark.checkpoint.dir` and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` as one struct `_row` next to own `columns`, so that no name of `df` can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                     *[c.alias(name) for name, c in columns.items()])


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    """The rows of `like` again, from `packed`."""
    return df.select(*[F.col("_row").getField(c).alias(c) for c in like.columns])


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply `fn` to every Arrow batch; batches share nothing, so lost tasks just run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)
