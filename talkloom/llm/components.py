"""Connected components of a link table, without bringing links together anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.frames import stored


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """One star step over links (a > b): hang the neighbours of each node on its smallest one."""
    if larger:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = both.join(least, "a")
    if larger:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b")))
    return out.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component): the smallest node each linked node reaches.

    Alternates large-star and small-star steps until the links are stars, in about log2(nodes)
    rounds. A step is a minimum per node (summed before the shuffle) and a join that the engine
    splits where a node has many links. Nodes without links, and null ends, have no row.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stored(links.filter("a != b").distinct(), "links")
    mark = None
    while True:
        links = stored(_stars(_stars(links, True), False), "stars")
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (now.n, now.s) == mark:
            break
        mark = (now.n, now.s)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
