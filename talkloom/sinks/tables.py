"""Catalog tables written to parquet folders or over JDBC."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from talkloom.scratch import file_system, materialise
from talkloom.sources.tables import conform


def append_table(df: DataFrame, name: str, path: str) -> None:
    """Append rows in the table's schema; the committer makes a failed job leave nothing behind."""
    conform(df, name).write.mode("append").parquet(path)


def append_jdbc(df: DataFrame, name: str, url: str, table: str, connections: int = 16, **options: str) -> None:
    """Append over JDBC with a bounded number of connections."""
    conform(df, name).coalesce(connections).write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def replace_table(df: DataFrame, path: str) -> None:
    """Rewrite a table from a plan that may read it, by swapping folders.

    The new rows are complete beside the table before the old ones move away, so a lost job leaves one whole
    table: at `path`, or, between the two renames, at `path.old`, from where `restore_table` brings it back.
    """
    spark = df.sparkSession
    restore_table(spark, path)
    fresh = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    fs, of = file_system(spark, path)
    kept = of(f"{path.rstrip('/')}.old")
    if fs.exists(of(path)):
        fs.delete(kept, True)
        if not fs.rename(of(path), kept):
            raise OSError(f"could not move {path} aside")
    if not fs.rename(of(fresh), of(path)):
        raise OSError(f"could not move {fresh} to {path}")
    fs.delete(kept, True)


def restore_table(spark: SparkSession, path: str) -> None:
    """Bring a table back that a lost `replace_table` left aside."""
    fs, of = file_system(spark, path)
    kept = of(f"{path.rstrip('/')}.old")
    if fs.exists(kept) and not fs.exists(of(path)):
        fs.rename(kept, of(path))


# ---- tables in buckets: an edit rewrites the buckets of its keys only -------------------------------


def _bucket_column(buckets: int) -> str:
    return f"bucket_of_{buckets}"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """A new table, or more rows of one, in folders by the hash of `key`; choose `buckets` so that one fits a task."""
    rows = df.withColumn(_bucket_column(buckets), _bucket(key, buckets))
    rows.repartition(_bucket_column(buckets)).write.mode("append").partitionBy(_bucket_column(buckets)).parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: StructType, buckets: int, only: list[int] | None = None) -> DataFrame:
    """The rows of a table written by `write_buckets`; of the buckets `only`, other folders are not opened."""
    column = _bucket_column(buckets)
    rows = spark.read.schema(StructType([*schema.fields, StructField(column, IntegerType())])).parquet(path)
    return (rows if only is None else rows.filter(F.col(column).isin(only))).select(*schema.names)


def rewrite_buckets(
    spark: SparkSession, path: str, schema: StructType, key: str, buckets: int, touched: DataFrame, change: Callable[[DataFrame], DataFrame]
) -> list[int]:
    """Replace the rows of the buckets that hold the keys of `touched` by `change` of them; the numbers of these buckets.

    The new rows are written to the scratch folder first, then Spark's dynamic overwrite swaps whole buckets; one left without rows is removed. Edits
    by key may be repeated, so a job lost in between is simply run again.
    """
    column = _bucket_column(buckets)
    met = sorted(r[0] for r in touched.select(_bucket(key, buckets)).distinct().collect())  # at most `buckets` numbers
    if not met:
        return []
    old = read_buckets(spark, path, schema, buckets, met)
    new = materialise(change(old).select(*schema.names).withColumn(column, _bucket(key, buckets)), "buckets")
    left = {r[0] for r in new.select(column).distinct().collect()}
    if not left <= set(met):
        raise ValueError(f"the change moved rows into buckets {sorted(left - set(met))} that hold none of its keys")
    new.repartition(column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    fs, of = file_system(spark, path)
    for number in set(met) - left:
        fs.delete(of(f"{path}/{column}={number}"), True)
    return met
