"""Running values and islands over long ordered sequences.

A plain window over `transcript_id` sends a whole transcript to one task. Here a sequence is cut
into blocks (a non-decreasing integer function of the order, such as position // 4096): rows are
shuffled by (keys, block), each block is scanned on its own, one summary row per block is scanned
over the sequence, and its carry is joined back on (keys, block). The largest group any task sees
is one block of rows, or the block summaries of one sequence.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.scratch import materialise

_BLOCK = "_block"


def pair_number(high: Column, low: Column) -> Column:
    """Two whole numbers as one that orders like the pair (`low` below 10**15).

    Aggregates keep a number in place in a hash map, where a struct makes them sort their input first.
    """
    return high.cast("decimal(19,0)") * F.lit(10**15).cast("decimal(16,0)") + low.cast("decimal(15,0)")


RANGE_ROWS = 1 << 20  # rows of a block, about; the engine's sampling keeps blocks below three times that


def even_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = RANGE_ROWS) -> tuple[DataFrame, Column]:
    """`df` and a block column of about equally many rows per block, wherever the rows lie along the order.

    The engine sorts by (keys, order) into ranges whose edges it takes from a sample, so a hot key or a crowded hour becomes several blocks, and ties of the
    first order column are split by the others. The ranges are written, because they must not change between two reads; a table of one block is neither
    sorted nor written.
    """
    n = df.count()
    if n <= rows:
        return df, F.lit(0)
    parts = -(-n // rows)
    ranged = df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id().cast("long"))
    return materialise(ranged, "ranges"), F.col("_range")


def _order_key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    *,
    totals: dict[str, Column] | None = None,
    running_max: dict[str, Column] | None = None,
    rest_min: dict[str, Column] | None = None,
    forward: dict[str, Column] | None = None,
    backward: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running columns to `df`.

    totals: sum up to and including the row.      running_max: maximum up to and including the row.
    rest_min: minimum from the row on.
    forward: last non-null value up to the row.   backward: first non-null value from the row on.
    previous / following: value of the neighbouring row.
    """
    totals, running_max, rest_min = totals or {}, running_max or {}, rest_min or {}
    forward, backward = forward or {}, backward or {}
    previous, following = previous or {}, following or {}
    names = [*totals, *running_max, *rest_min, *forward, *backward, *previous, *following]

    # Evaluate the inputs once, under names that cannot clash with the outputs.
    inputs = {**totals, **running_max, **rest_min, **forward, **backward, **previous, **following}
    staged = df.select(
        "*", block.cast("long").alias(_BLOCK), *[e.alias(f"_in_{n}") for n, e in inputs.items()]
    )

    at = _order_key(order)
    aggs = []
    for n in names:
        v = F.col(f"_in_{n}")
        if n in totals:
            aggs.append(F.sum(v).alias(f"_b_{n}"))
        elif n in running_max:
            aggs.append(F.max(v).alias(f"_b_{n}"))
        elif n in rest_min:
            aggs.append(F.min(v).alias(f"_b_{n}"))
        elif n in forward:
            aggs.append(F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_b_{n}"))
        elif n in backward:
            aggs.append(F.min_by(v, F.when(v.isNotNull(), at)).alias(f"_b_{n}"))
        elif n in previous:
            aggs.append(F.max_by(v, at).alias(f"_b_{n}"))
        else:
            aggs.append(F.min_by(v, at).alias(f"_b_{n}"))
    blocks = staged.groupBy(*keys, _BLOCK).agg(*aggs)

    up = Window.partitionBy(*keys).orderBy(_BLOCK)
    down = Window.partitionBy(*keys).orderBy(F.desc(_BLOCK))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = down.rowsBetween(Window.unboundedPreceding, -1)
    carries = []
    for n in names:
        b = F.col(f"_b_{n}")
        if n in totals:
            c = F.coalesce(F.sum(b).over(before), F.lit(0))
        elif n in running_max:
            c = F.max(b).over(before)
        elif n in rest_min:
            c = F.min(b).over(after)
        elif n in forward:
            c = F.last(b, ignorenulls=True).over(before)
        elif n in backward:
            c = F.last(b, ignorenulls=True).over(after)
        elif n in previous:
            c = F.lag(b).over(up)
        else:
            c = F.lag(b).over(down)
        carries.append(c.alias(f"_c_{n}"))
    blocks = blocks.select(*keys, _BLOCK, *carries)

    rising = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    falling = Window.partitionBy(*keys, _BLOCK).orderBy(*[F.desc(c) for c in order])
    rising_rows = rising.rowsBetween(Window.unboundedPreceding, 0)
    falling_rows = falling.rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for n in names:
        v, c = F.col(f"_in_{n}"), F.col(f"_c_{n}")
        if n in totals:
            e = F.coalesce(F.sum(v).over(rising_rows), F.lit(0)) + c
        elif n in running_max:
            e = F.greatest(F.max(v).over(rising_rows), c)
        elif n in rest_min:
            e = F.least(F.min(v).over(falling_rows), c)
        elif n in forward:
            e = F.coalesce(F.last(v, ignorenulls=True).over(rising_rows), c)
        elif n in backward:
            e = F.coalesce(F.last(v, ignorenulls=True).over(falling_rows), c)
        elif n in previous:
            e = F.when(F.row_number().over(rising) == 1, c).otherwise(F.lag(v).over(rising))
        else:
            e = F.when(F.row_number().over(falling) == 1, c).otherwise(F.lag(v).over(falling))
        out.append(e.alias(n))
    joined = staged.join(blocks, [*keys, _BLOCK])
    return joined.select(*[F.col(c) for c in df.columns if c not in names], *out)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    compare: Sequence[str],
    starts: dict[str, Callable[[Callable[[str], Column], Callable[[str], Column]], Column]],
    origins: dict[str, tuple[str, str]] | None = None,
    before: dict[str, str] | None = None,
) -> DataFrame:
    """Number runs of rows from 0, one output column per entry of `starts`.

    `starts[name](prev, cur)` says whether a row opens a new run, given accessors for the columns in
    `compare` on the row before and on the row itself. The first row of a sequence always opens one.
    `origins[out] = (name, column)` adds the column's value on the row that opened the run;
    `before[out] = column` adds its value on the previous row. Both take columns of `compare`.
    """
    origins, before_cols = origins or {}, before or {}
    w = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    lagged = df.withColumn(_BLOCK, block.cast("long")).select(
        "*",
        F.row_number().over(w).alias("_rn"),
        *[F.lag(c).over(w).alias(f"_p_{c}") for c in compare],
    )

    def flag(fn, prev, cur):
        return F.coalesce(fn(prev, cur), F.lit(False)).cast("long")

    inner = {
        n: F.when(F.col("_rn") == 1, 0).otherwise(flag(fn, lambda c: F.col(f"_p_{c}"), F.col))
        for n, fn in starts.items()
    }
    lagged = lagged.select("*", *[e.alias(f"_f_{n}") for n, e in inner.items()])
    blocks = lagged.groupBy(*keys, _BLOCK).agg(
        *[F.sum(f"_f_{n}").alias(f"_t_{n}") for n in starts],
        *[F.min_by(c, "_rn").alias(f"_first_{c}") for c in compare],
        *[F.max_by(c, "_rn").alias(f"_last_{c}") for c in compare],
        *[
            F.max_by(c, F.when(F.col(f"_f_{n}") == 1, F.col("_rn"))).alias(f"_lo_{o}")
            for o, (n, c) in origins.items()
        ],
    )
    up = Window.partitionBy(*keys).orderBy(_BLOCK)
    blocks = blocks.select(
        "*",
        F.row_number().over(up).alias("_bn"),
        *[F.lag(f"_last_{c}").over(up).alias(f"_pl_{c}") for c in compare],
    )
    heads = {
        n: F.when(F.col("_bn") == 1, 1).otherwise(
            flag(fn, lambda c: F.col(f"_pl_{c}"), lambda c: F.col(f"_first_{c}"))
        )
        for n, fn in starts.items()
    }
    blocks = blocks.select("*", *[e.alias(f"_h_{n}") for n, e in heads.items()])
    earlier = up.rowsBetween(Window.unboundedPreceding, -1)
    head_origin = {
        o: F.when(F.col(f"_h_{n}") == 1, F.col(f"_first_{c}")) for o, (n, c) in origins.items()
    }
    blocks = blocks.select(
        *keys,
        _BLOCK,
        *[
            (
                F.coalesce(F.sum(F.col(f"_t_{n}") + F.col(f"_h_{n}")).over(earlier), F.lit(0))
                + F.col(f"_h_{n}")
                - 1
            ).alias(f"_c_{n}")
            for n in starts
        ],
        *[
            F.coalesce(
                e, F.last(F.coalesce(F.col(f"_lo_{o}"), e), ignorenulls=True).over(earlier)
            ).alias(f"_co_{o}")
            for o, e in head_origin.items()
        ],
        *[F.col(f"_pl_{c}").alias(f"_cb_{o}") for o, c in before_cols.items()],
    )
    joined = lagged.join(blocks, [*keys, _BLOCK])
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.sum(f"_f_{n}").over(rows) + F.col(f"_c_{n}")).alias(n) for n in starts],
        *[
            F.coalesce(
                F.last(F.when(F.col(f"_f_{n}") == 1, F.col(c)), ignorenulls=True).over(rows),
                F.col(f"_co_{o}"),
            ).alias(o)
            for o, (n, c) in origins.items()
        ],
        *[
            F.when(F.col("_rn") == 1, F.col(f"_cb_{o}")).otherwise(F.col(f"_p_{c}")).alias(o)
            for o, c in before_cols.items()
        ],
    )


def concat_parts(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    part: Column,
    piece: Column,
    separator: str = "",
    text: str = "text",
) -> DataFrame:
    """Join pieces in order into `(keys, part_no, text)` rows.

    Parts are bounded (the caller derives `part` from a dense position), so that one huge document
    becomes many rows spread over many tasks; joining the parts in order gives the whole text.
    """
    staged = df.select(*keys, part.cast("long").alias("part_no"), F.col(order).alias("_o"), piece.alias("_p"))
    ordered = F.array_sort(F.collect_list(F.struct("_o", "_p")))
    return staged.groupBy(*keys, "part_no").agg(
        F.array_join(F.transform(ordered, lambda s: s["_p"]), separator).alias(text)
    )
