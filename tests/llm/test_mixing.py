import re

from pyspark.sql import functions as F

from talkloom.llm import mixing
from talkloom.llm.mixing import mix, mixed_documents, targets, word_count
from tests.llm import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_rounds(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[n] for n in capped)
        free = sum(weight[n] for n in names if n not in capped)
        over = {n for n in names if n not in capped and rest * weight[n] / free > 3 * sizes[n]}
        if not over:
            return {n: 3.0 * sizes[n] if n in capped else rest * weight[n] / free for n in names}
        capped |= over


def test_targets(spark):
    for sizes in ({"a": 10, "b": 100, "c": 4000, None: 3}, {"a": 5}, {"é": 50, "z": 50, "Z": 50, "": 7}, {"a": 0, "b": 9, None: 0}):
        frame = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, docs long")
        got = {r.source: r.target for r in targets(frame).collect()}
        want = by_rounds(sizes)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 37))) for i in range(3000)] + edge.ROWS
    docs = edge.documents(spark, rows)
    out = mix(docs).select(F.col("_row.doc_id").alias("id"), F.col("_row.text").alias("text"), F.col("_row.source").alias("source"), "_size", "_source_size", "_target", "_taken").collect()
    assert len(out) == len(rows)
    taken, size, target = {}, {}, {}
    for r in out:
        assert r._size == len(WORD.findall(r.text or "")) and 0 <= r._taken <= 3 * r._size
        taken[r.source] = taken.get(r.source, 0) + r._taken
        size[r.source] = size.get(r.source, 0) + r._size
        target[r.source] = r._target
    want = by_rounds(size)
    assert all(abs(target[k] - want[k]) < 1e-6 and abs(taken[k] - want[k]) <= 1 for k in want)
    again = mix(docs.repartition(7)).select("_row.doc_id", "_size", "_taken")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, mix(docs).select("_row.doc_id", "_size", "_taken").collect()))
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mix(edge.documents(spark, [])).count() == 0


def test_weights_favour(spark):
    docs = spark.createDataFrame([(i, "w w w w", s, 4.0 if i % 2 else 0.25) for i in range(4000) for s in "abc"], "doc_id long, text string, source string, weight double")
    rows = mix(docs, weight_col="weight").filter("_row.source = 'c'").groupBy((F.col("_row.doc_id") % 2).alias("heavy")).agg(F.sum("_taken").alias("n")).collect()
    got = {r.heavy: r.n for r in rows}
    assert got[1] > 5 * got[0]


def test_sizes_counted_before(spark):
    docs = edge.documents(spark, [(i, " ".join(["w"] * (i % 37))) for i in range(500)] + edge.ROWS)
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    of = lambda rows: sorted(map(repr, rows.select("_row.doc_id", "_size", "_target", "_taken").collect()))
    assert of(mix(sized, size_col="size")) == of(mix(docs))


def test_ranges_stay_even_for_all_weights(spark):
    for weight in (0.0, 0.05, 1.0, 20.0, None):
        n = 40_000
        rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(3).alias("size"), (F.col("id") % 3 == 0).cast("int").cast("string").alias("source"),
                                     (F.pow(F.lit(10.0), F.col("id") % 9 - 4) if weight is None else F.lit(weight)).alias("weight"))
        keyed = []
        held = mixing.key_ranges
        mixing.key_ranges = lambda narrow: keyed.append(narrow) or held(narrow)  # noqa: B023
        try:
            out = mix(rows, weight_col="weight", size_col="size")
        finally:
            mixing.key_ranges = held
        got = held(keyed[0]).agg(F.max("docs"), F.sum("docs"), F.count("*")).first()
        assert got[0] < 3 * mixing.RANGE_ROWS and got[1] == n
        taken = {r.source: (r.n, r.t) for r in out.groupBy("_row.source").agg(F.sum("_taken").alias("n"), F.max("_target").alias("t")).collect()}
        assert all(abs(k - t) <= 1 for k, t in taken.values())


def test_the_cut_is_where_a_sort_puts_it(spark):
    docs = edge.documents(spark, [(i, " ".join(["w"] * (i % 37))) for i in range(9000)] + edge.ROWS)
    whole = mixing.RANGE_ROWS
    of = lambda: sorted(map(repr, mix(docs).select("_row.doc_id", "_size", "_taken").collect()))
    many = of()
    mixing.RANGE_ROWS = 10**9
    try:
        assert of() == many
    finally:
        mixing.RANGE_ROWS = whole
