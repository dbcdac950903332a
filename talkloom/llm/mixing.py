"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the key -ln(u) / weight, u fixed by a hash of its id, size and the seed. In order of
keys, a source's documents are a weighted sample without replacement. Whole epochs of a source come first; the
fraction left of its budget goes to the documents with the smallest keys.

The running sum of sizes along a source's keys is taken in steps: keys fall into bins of equal width on a logarithmic
scale, a bin is cut into ranges of equal width by the rows it holds, sizes are summed per range and per bin, and running sums over these find the one range of a
source that holds the cut. All other rows are decided by their key alone; only the rows of that range are sorted. Keys are smooth
inside a bin whatever the weights are, so ranges hold about equally many rows, and a source with a third of all rows is spread over its ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm.frames import stored

WEIGHTS = (5, 2, 1)
MOST = 3
RANGE_ROWS = 2000  # documents in a key range, about
BINS = 64  # bins of keys per doubling
BROADCAST_SOURCES = 100_000  # up to so many sources (10 MB) are sent to every executor
_TOP = 1 << 48


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, docs) -> with `target`: shares by weight, none above MOST times its source.

    Sharing the excess again by weight until no target is above its bound means target =
    min(bound, level * weight). Sources in order of bound / weight are bounded first, so the level follows from running sums.
    One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("bound", F.col("source_size") * MOST)
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (rows.withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
            .withColumn("bounds_upto", F.sum("bound").over(upto)).withColumn("weights_upto", F.sum("weight").over(upto)))
    # The source is bounded if the level of it and all later sources reaches its bound.
    open_words = F.col("total") - (F.col("bounds_upto") - F.col("bound"))
    open_weight = F.col("weights") - (F.col("weights_upto") - F.col("weight"))
    rows = rows.withColumn("bounded", open_words * F.col("weight") >= F.col("bound") * open_weight)
    used = F.sum(F.when(F.col("bounded"), F.col("bound")).otherwise(0)).over(every)
    free = F.sum(F.when(~F.col("bounded"), F.col("weight")).otherwise(0)).over(every)
    level = (F.col("total") - used).cast("double") / free.cast("double")
    target = F.when(F.col("bounded"), F.col("bound").cast("double")).otherwise(level * F.col("weight"))
    return rows.withColumn("target", target).select("source", "source_size", "docs", "target")


def _range(parts: str) -> Column:
    """The range of a key inside its bin, of `parts` equally wide ones."""
    low, high = F.pow(F.lit(2.0), F.col("bin") / BINS), F.pow(F.lit(2.0), (F.col("bin") + 1) / BINS)
    return F.greatest(F.lit(0), F.least(F.col(parts) - 1, F.floor((F.col("key") - low) / (high - low) * F.col(parts)))).cast("long")


def key_ranges(narrow: DataFrame) -> DataFrame:
    """(name, bin, range, parts, docs, in_range, before) of narrow(name, size, key, bin): ranges of about RANGE_ROWS rows, and the sizes before each along its source."""
    bins = narrow.groupBy("name", "bin").agg(F.count("*").alias("rows"), F.sum("size").alias("in_bin"))
    up = Window.partitionBy("name").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a source has some thousand bins
    bins = bins.select("name", "bin", F.ceil(F.col("rows") / RANGE_ROWS).cast("long").alias("parts"), F.coalesce(F.sum("in_bin").over(up), F.lit(0)).alias("before_bin"))
    bins = stored(bins, "bins")
    few = F.broadcast(bins) if bins.count() <= BROADCAST_SOURCES else bins
    ranges = narrow.join(few, ["name", "bin"]).withColumn("range", _range("parts")).groupBy("name", "bin", "range", "parts", "before_bin").agg(
        F.sum("size").alias("in_range"), F.count("*").alias("docs"))
    within = Window.partitionBy("name", "bin").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("before", F.col("before_bin") + F.coalesce(F.sum("in_range").over(within), F.lit(0))).drop("before_bin")


def _cut(narrow: DataFrame, goals: DataFrame) -> DataFrame:
    """(name, cut_bin, cut_range, parts, cut_before): the range of each source in which the running sum passes what is `left` to take."""
    ranges = key_ranges(narrow).join(goals.select("name", "left"), "name")
    held = ranges.filter((F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("in_range")))
    return held.groupBy("name").agg(F.min(F.struct("bin", "range", "parts", "before")).alias("c")).select(
        "name", F.col("c.bin").alias("cut_bin"), F.col("c.range").alias("cut_range"), "c.parts", F.col("c.before").alias("cut_before"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weight_col: str | None = None, size_col: str | None = None, seed: int = 1, split_last: bool = True) -> DataFrame:
    """`docs` with `_size`, `_source_size`, `_target` and `_taken` in a struct `_row` beside them.

    `_taken`: words the mix takes of the document, repeats counted: its size for every whole epoch, and again
    if its key lies below the source's last cut. The document at the cut is taken in part (`split_last`), or whole
    if that is nearer to the target. `size_col` names sizes already counted, so that the texts need not be moved; null ones are 0.

    Null texts have size 0, as have empty ones; they are never taken. A null source is a source of its own, last in
    order. Null, zero or negative weights count as very small. Null ids are documents like others. Equal rows draw equal keys and are told apart
    by position only, so the result as a whole does not depend on their order. An empty table gives an empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    weight = F.lit(1.0) if weight_col is None else F.coalesce(F.greatest(F.col(weight_col).cast("double"), F.lit(1e-9)), F.lit(1e-9))
    size = word_count(F.col(text_col)) if size_col is None else F.coalesce(F.col(size_col).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(row, F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), weight.alias("w"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size").cast("string"))), 1, 12), 16, 10).cast("double")
    rows = rows.withColumn("key", -F.log((drawn + 0.5) / F.lit(float(_TOP))) / F.col("w"))
    rows = rows.withColumn("bin", F.floor(F.log2("key") * BINS).cast("long"))
    narrow = rows.select("source", "size", "key", "bin")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goals = targets(sizes)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("left", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    goals = goals.withColumn("name", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"))).drop("source")
    goals = stored(goals, "goals")  # a row per source
    named = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source")).alias("name")
    cut = _cut(narrow.select(named, "size", "key", "bin"), goals)
    goals = stored(goals.join(cut, "name", "left"), "cuts")
    if goals.count() <= BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    rows = rows.withColumn("name", named).join(goals, "name").withColumn("range", _range("parts"))
    at = F.when(F.col("left") <= 0, F.lit(1)).when(F.col("cut_bin").isNull(), F.lit(-1)).when(F.col("bin") != F.col("cut_bin"), F.signum(F.col("bin") - F.col("cut_bin")))
    at = at.otherwise(F.signum(F.col("range") - F.col("cut_range")))
    rows = rows.withColumn("at", at.cast("int"))
    # Below the cut everything is taken, above it nothing; the rows of the range that holds the cut are sorted.
    decided = rows.filter("at != 0").withColumn("before", F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(F.col("left")))
    decided = decided.withColumn("left", F.when(F.col("at") < 0, F.col("size")).otherwise(F.col("left")))
    inside = Window.partitionBy("name").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sorted_rows = rows.filter("at = 0").withColumn("before", F.col("cut_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = decided.unionByName(sorted_rows)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before")))
    if not split_last:
        part = F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    return rows.select("_row", F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
                       (F.col("epochs") * F.col("size") + part).cast("long").alias("_taken"))


def mixed_documents(docs: DataFrame, **options: str | int | None) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of `docs`."""
    rows = mix(docs, split_last=False, **options)
    times = F.when(F.col("_size") > 0, (F.col("_taken") / F.col("_size")).cast("int")).otherwise(F.lit(0))
    rows = rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times)))
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
