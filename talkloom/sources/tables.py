"""Catalog tables from parquet or JDBC, in their fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.schemas import CATALOG


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(CATALOG[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast to the table's schema; columns the input lacks are null."""
    cols = []
    for field in schema_of(name):
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        cols.append(value.cast(field.dataType).alias(field.name))
    return df.select(*cols)


def scan_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.schema(schema_of(name)).parquet(path)


def scan_jdbc(
    spark: SparkSession, name: str, url: str, table: str, split: str | None = None,
    bounds: tuple[str, str] | None = None, partitions: int = 32, **options: str,
) -> DataFrame:
    """Read over JDBC; with `split` and its bounds as parallel range reads."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split and bounds:
        reader = reader.options(
            partitionColumn=split, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=str(partitions)
        )
    return conform(reader.load(), name)
