import pytest
from pyspark.sql import functions as F

from talkloom.operators import tags
from talkloom.streaming import jobs

ITEMS = "video_id string, channel_id long, published_at timestamp"


def _write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_discovery_admits_once_over_batches_and_restarts(spark, tmp_path):
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    rows = [("a", 1, "2024-01-01 10:00:00"), ("a", 1, "2024-01-01 11:00:00"), ("known", 1, "2024-01-03 10:00:00"), ("b", 2, "2024-01-01 09:00:00")]
    as_rows = lambda rs: spark.createDataFrame(rs, "v string, c long, t string").select(
        F.col("v").alias("video_id"), F.col("c").alias("channel_id"), F.col("t").cast("timestamp").alias("published_at"))
    as_rows(rows).coalesce(1).write.mode("append").parquet(src)
    known = spark.createDataFrame([("known",)], "video_id string")
    schema = as_rows(rows).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        jobs.discover(stream, known, f"{out}/videos", f"{check}/videos").awaitTermination()
        jobs.advance_marks(stream, f"{out}/marks", f"{check}/marks").awaitTermination()
        marks = stream.select("channel_id", F.col("published_at").alias("mark")).schema
        return (sorted((r.video_id, r.channel_id, str(r.published_at)[:13]) for r in jobs.read_batches(spark, f"{out}/videos", schema).collect()),
                {r.channel_id: str(r.mark) for r in jobs.high_water_marks(spark, f"{out}/marks", marks).collect()})

    ids, marks = run()
    first = [("a", 1, "2024-01-01 10"), ("b", 2, "2024-01-01 09")]
    assert ids == first and marks[1].startswith("2024-01-03")
    # Later files repeat ids, one much later and one in an earlier form; neither comes back.
    as_rows([("a", 1, "2024-02-01 10:00:00"), ("c", 2, "2024-02-02 10:00:00")]).coalesce(1).write.mode("append").parquet(src)
    as_rows([("b", 2, "2023-01-01 10:00:00"), ("c", 1, "2024-02-02 11:00:00"), ("known", 9, "2024-02-02 10:00:00")]).coalesce(1).write.mode("append").parquet(src)
    ids, marks = run()
    assert ids == [*first, ("c", 2, "2024-02-02 10")] and marks[1].startswith("2024-02-02") and marks[9].startswith("2024-02-02")
    # Nothing new: nothing runs. Then one more batch over the same ids admits none, and reads no folder that was written before.
    assert run() == (ids, marks)
    as_rows([("a", 1, "2022-01-01 00:00:00")]).coalesce(1).write.mode("append").parquet(src)
    assert run() == (ids, marks)
    assert spark.read.parquet(f"{out}/videos/batch=3").count() == 0


def test_a_batch_reads_no_earlier_results(spark, tmp_path):
    src, out, check = str(tmp_path / "in"), tmp_path / "out", str(tmp_path / "check")
    schema = "item_id long, seq int, kind string, tag string"
    for i in range(4):
        _write(spark, src, [(i, 0, "manual", "A"), (i, 1, "manual", f"own{i}")], schema)
        jobs.tag_dictionary(spark.readStream.schema(schema).parquet(src), str(out), check).awaitTermination()
        # Only the spellings of the batch are written, with their totals; earlier rows may be unreadable by then.
        got = {r.tag: r.n for r in spark.read.parquet(f"{out}/batch={i}").collect()}
        assert got == {"a": i + 1, f"own{i}": 1}
        for f in out.glob(f"batch={i}/*.parquet"):
            f.write_bytes(b"broken")


def test_lost_state_is_noticed(spark, tmp_path):
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "check"
    schema = "item_id long, seq int, kind string, tag string"

    def run():
        _write(spark, src, [(1, 0, "manual", "A")], schema)
        jobs.tag_dictionary(spark.readStream.schema(schema).parquet(src), out, str(check)).awaitTermination()

    run()
    for f in check.glob("state/**/*"):
        if f.is_file() and f.suffix != ".crc" and "_metadata" not in f.parts:
            f.write_bytes(b"")
    spark._jvm.org.apache.spark.sql.execution.streaming.state.StateStore.stop()
    with pytest.raises(Exception):  # noqa: B017
        run()


def test_dictionary_over_batches_equals_the_batch_result(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, 0, "manual", t) for i, t in enumerate(["A", "a", "B", "A", "c", "b", "A"])]
    schema = "item_id long, seq int, kind string, tag string"
    for chunk in (rows[:3], rows[3:5], rows[5:]):
        _write(spark, src, chunk, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    running = jobs.tag_dictionary(stream, out, str(tmp_path / "check"))
    running.awaitTermination()
    got = sorted(tuple(r) for r in jobs.latest_dictionary(spark, out).collect())
    assert got == sorted(tuple(r) for r in tags.tag_stats(spark.createDataFrame(rows, schema)).collect())


def test_a_lost_dictionary_is_noticed(spark, tmp_path):
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "item_id string, seq int, kind string, tag string"

    def run(folder):
        _write(spark, src, [("x", 0, "manual", "A")], schema)
        jobs.tag_dictionary(spark.readStream.schema(schema).parquet(src), folder, check).awaitTermination()

    run(out)
    run(out)
    assert jobs.latest_dictionary(spark, out).first().frequency == 2
    with pytest.raises(Exception, match="no results of the batch before"):
        run(str(tmp_path / "other"))


def test_metrics_have_one_row_per_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "is_technical boolean, error string"
    _write(spark, src, [(True, None), (False, None)], schema)
    _write(spark, src, [(None, "x"), (True, None)], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.run_metrics(stream, out, str(tmp_path / "check")).awaitTermination()
    rows = jobs.read_batches(spark, out, jobs.METRICS).collect()
    assert len(rows) == 2 and sum(r.videos_approved for r in rows) == 2 and sum(r.n_errors for r in rows) == 1


def test_stream_classification_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, duration int, reply string"
    rows = [(1, 100, "x"), (2, 700, '{"is_technical": true, "confidence": 0.9}'), (3, 700, "junk"), (4, 9000, "x")]
    _write(spark, src, rows, schema)
    stream = spark.readStream.schema(schema).parquet(src)
    want = jobs.classify_columns(spark.createDataFrame(rows, schema))
    jobs.classify(stream, out, str(tmp_path / "check")).awaitTermination()
    assert sorted(map(tuple, spark.read.schema(want.schema).parquet(out).collect())) == sorted(map(tuple, want.collect()))
