"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_once(df: DataFrame, keep: list, array: Column, pos: str, item: str) -> DataFrame:
    """`keep` columns with position and item of every element of a computed array.

    A plain explode makes the optimizer add a filter on the array's size below it, which evaluates a
    costly array a second time; the outer form does not, and its rows for empty arrays are dropped.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())
