import random
import re

from pyspark.sql import functions as F

from talkloom.operators.intervals import first_at_or_after, points_in_intervals
from talkloom.operators.ordered import concat_parts, islands, ordered_scan


def _rows(seed, n=200):
    rng = random.Random(seed)
    return [(k, i, rng.choice([None, 1, 2, 3]), rng.choice("ab")) for k in range(3) for i in range(rng.randint(1, n))]


def test_scans_match_a_walk(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "k int, i long, v int, s string")
    out = ordered_scan(
        df, ["k"], ["i"], F.floor(F.col("i") / 7),
        totals={"total": F.coalesce("v", F.lit(0))}, running_max={"top": F.col("v")}, rest_min={"low": F.col("v")},
        forward={"fwd": F.col("v")}, backward={"bwd": F.col("v")}, previous={"prv": F.col("v")}, following={"nxt": F.col("v")},
    )
    got = {(r.k, r.i): r for r in out.collect()}
    assert len(got) == len(rows)
    for k in range(3):
        vs = [r[2] for r in rows if r[0] == k]
        for i in range(len(vs)):
            upto, rest = [v for v in vs[: i + 1] if v], [v for v in vs[i:] if v]
            r = got[(k, i)]
            assert r.total == sum(upto)
            assert r.top == (max(upto) if upto else None) and r.low == (min(rest) if rest else None)
            assert r.fwd == (upto[-1] if upto else None) and r.bwd == (rest[0] if rest else None)
            assert r.prv == (vs[i - 1] if i else None) and r.nxt == (vs[i + 1] if i + 1 < len(vs) else None)


def test_islands_across_blocks(spark):
    rows = _rows(2)
    df = spark.createDataFrame(rows, "k int, i long, v int, s string")
    out = islands(
        df, ["k"], ["i"], F.floor(F.col("i") / 5), ["s", "i"], {"run": lambda p, c: p("s") != c("s")},
        origins={"first": ("run", "i")}, before={"prev_s": "s"},
    )
    got = {(r.k, r.i): (r.run, r.first, r.prev_s) for r in out.collect()}
    for k in range(3):
        run, first, before = -1, 0, None
        for _, i, _, s in [r for r in rows if r[0] == k]:
            if s != before:
                run, first = run + 1, i
            assert got[(k, i)] == (run, first, before)
            before = s


def test_a_hot_sequence_is_spread_over_tasks(spark):
    df = spark.range(20000).selectExpr("CAST(id / 1000000 AS INT) AS k", "id AS i")
    out = ordered_scan(df, ["k"], ["i"], F.floor(F.col("i") / 100), totals={"n": F.lit(1)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(k#\d+, _block#", plan)
    sizes = out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(sizes) > 1 and out.filter("n <> i + 1").count() == 0


def test_points_in_intervals_are_exact(spark):
    rng = random.Random(3)
    points = [(t, i, rng.uniform(0, 100)) for t in range(2) for i in range(40)]
    spans = [(t, i, a, a + rng.choice([0.0, 1.0, 30.0])) for t in range(2) for i in range(40) for a in [rng.uniform(0, 90)]]
    out = points_in_intervals(
        spark.createDataFrame(points, "t int, p int, at double"), spark.createDataFrame(spans, "t int, s int, a double, b double"),
        ["t"], "at", "a", "b", 8.0, 0.5)
    want = {(t, p, s) for t, p, at in points for t2, s, a, b in spans if t == t2 and a <= at <= b + 0.5}
    got = [(r.t, r.p, r.s) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)


def test_an_interval_with_a_corrupt_end_is_listed_as_long_as_its_points(spark):
    points = spark.createDataFrame([(1, i, float(i)) for i in range(20)], "t int, p int, at double")
    spans = spark.createDataFrame([(1, 0, 5.0, 1e15), (1, 1, 30.0, 1e15), (2, 2, 0.0, 1e15), (1, 3, 9.0, 8.0)], "t int, s int, a double, b double")
    out = points_in_intervals(points, spans, ["t"], "at", "a", "b", 1.0)
    assert sorted((r.p, r.s) for r in out.collect()) == [(i, 0) for i in range(5, 20)]


def test_first_at_or_after_with_starts_that_step_back(spark):
    rng = random.Random(4)
    rows = [(t, i, rng.uniform(0, 50)) for t in range(3) for i in range(30)]
    points = [(t, i, rng.uniform(-5, 60)) for t in range(3) for i in range(15)]
    out = first_at_or_after(
        spark.createDataFrame(points, "t int, p long, at double"), spark.createDataFrame(rows, "t int, n long, start double"),
        ["t"], ["p"], "at", "start", "n", block_seconds=10.0)
    got = {(r.t, r.p): r.first_no for r in out.collect()}
    for t, p, at in points:
        assert got[(t, p)] == min((n for t2, n, s in rows if t2 == t and s >= at), default=None)


def test_parts_join_to_the_whole(spark):
    df = spark.createDataFrame([(1, i, f"w{i}") for i in range(25)], "k int, i long, w string")
    parts = concat_parts(df, ["k"], "i", F.floor(F.col("i") / 4), F.col("w"), "").orderBy("part_no").collect()
    assert len(parts) == 7 and "".join(p.text for p in parts) == "".join(f"w{i}" for i in range(25))
