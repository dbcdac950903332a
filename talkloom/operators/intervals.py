"""Interval and as-of joins without comparing all pairs of a transcript."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.operators.ordered import ordered_scan


def points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    width: float,
    reach: float = 0.0,
) -> DataFrame:
    """Pairs with `start <= at <= end + reach`, joined on (keys, time bucket).

    An interval is listed in every bucket it touches and a point in its own, so a task compares only
    what lies within `width` seconds of each other. Column names of the two sides must differ,
    except for `keys`. Buckets before the first and after the last point of a sequence are left out, so that an
    interval with a corrupt end is listed no longer than its recording. All pairs of a point share its bucket, kept as `_bucket`: grouping by (keys,
    bucket, point) afterwards needs no further shuffle.
    """
    extent = points.groupBy(*keys).agg((F.floor(F.min(at) / width)).cast("long").alias("_low"), F.floor(F.max(at) / width).cast("long").alias("_high"))
    first = F.greatest(F.floor(F.col(start) / width).cast("long"), F.col("_low"))
    last = F.least(F.floor((F.col(end) + reach) / width).cast("long"), F.col("_high"))
    spread = intervals.join(extent, [*keys]).filter(first <= last).withColumn(
        "_bucket",
        F.explode(F.sequence(first, last)),
    ).drop("_low", "_high")
    placed = points.withColumn("_bucket", F.floor(F.col(at) / width).cast("long"))
    return (
        placed.join(spread, [*keys, "_bucket"])
        .filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end) + reach))
    )


def first_at_or_after(
    points: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    point_cols: Sequence[str],
    at: str,
    row_start: str,
    row_no: str,
    block_seconds: float = 3600.0,
) -> DataFrame:
    """For each point the number of the first row whose start is at or after it, as `first_no`.

    In order of time, that is the smallest number among the rows from the point on, also where starts
    step back along the numbers: one scan over the merged sides instead of a range join.
    """
    nothing = {c: points.schema[c].dataType for c in point_cols}
    # A row sorts after a point of the same time, so that "at or after" includes equality.
    merged = points.select(
        *keys, F.col(at).alias("_t"), F.lit(-1).cast("long").alias("_no"), *point_cols
    ).unionByName(
        rows.select(
            *keys, F.col(row_start).alias("_t"), F.col(row_no).cast("long").alias("_no"),
            *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()],
        )
    )
    scanned = ordered_scan(
        merged, keys, ["_t", "_no"], F.floor(F.col("_t") / block_seconds),
        rest_min={"first_no": F.when(F.col("_no") >= 0, F.col("_no"))},
    )
    return scanned.filter("_no = -1").select(*keys, *point_cols, F.col("_t").alias(at), "first_no")
