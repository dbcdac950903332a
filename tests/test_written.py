"""Files and tables that are written back: commits, lost jobs, rewritten buckets, states compared before they are set."""

import json
import os

import pytest
from pyspark.sql import functions as F

from talkloom.operators import catalog, ingest
from talkloom.sinks import named
from talkloom.sinks.tables import append_table, read_buckets, rewrite_buckets, write_buckets
from talkloom.sources import saved
from talkloom.sources.tables import scan_table


def files_below(folder):
    return {os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc")}


def test_rows_that_can_not_be_files_are_rejected(spark, tmp_path):
    rows = [(1, "a/x.txt", "1"), (2, "a/y.txt", None), (3, "a/x.txt", "3"), (4, None, "4"), (5, "", "5"), (6, "../z", "6"), (7, "/z", "7"), (8, "a/./z", "8"), (9, "_staging/z", "9"), (10, "a//z", "10"), (11, "b/", "11")]
    frame = spark.createDataFrame([(i, p, c, "r") for i, p, c in rows], "id long, path string, content string, job string")
    rejected = named.write_files(frame, str(tmp_path))
    assert {(r.id, r.reason) for r in rejected.collect()} == {
        (1, "another row has this path"), (3, "another row has this path"), (4, "no path"), (5, "no path"),
        *((i, "path leaves the folder") for i in range(6, 12))}
    assert files_below(tmp_path) == {"a/y.txt"} and (tmp_path / "a/y.txt").read_text() == ""
    named.write_files(frame.limit(0), str(tmp_path))
    assert files_below(tmp_path) == {"a/y.txt"}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("f"), "id").alias("path"), F.when(F.col("id") < 39, "x").otherwise(F.raise_error(F.lit("lost"))).alias("content"))
    with pytest.raises(Exception, match="lost"):
        named.write_files(rows, str(tmp_path))
    assert all(f.startswith("_staging/") and not f.endswith("_committed") for f in files_below(tmp_path))  # a task that still ran may have staged
    named.publish(spark, str(tmp_path))
    assert all(f.startswith("_staging/") for f in files_below(tmp_path))


def test_a_committed_job_is_published_by_the_next_one(spark, tmp_path):
    stage = tmp_path / "_staging"
    for job, task, committed in (("one", "t1", ["t1"]), ("two", "t2", None), ("three", "t4", ["t3", "t4"])):
        (stage / job / task / "d").mkdir(parents=True)
        (stage / job / task / "d" / f"{job}.txt").write_text(job)
        if committed is not None:
            (stage / job / "_committed").write_text(json.dumps(committed))
    (stage / "three" / "lost" / "d").mkdir(parents=True)
    (stage / "three" / "lost" / "d" / "half.txt").write_text("of an attempt that failed")
    assert named.publish(spark, str(tmp_path)) == 2
    assert files_below(tmp_path) == {"d/one.txt", "d/three.txt", "_staging/two/t2/d/two.txt"}
    assert named.publish(spark, str(tmp_path)) == 0


def test_files_are_listed_and_read_in_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(named, "LIST_ROWS", 7)
    monkeypatch.setattr(named, "READ_BYTES", 20)
    rows = {f"{folder}{k} ü%20.txt": f"{folder}{k}é" * (k % 3) for folder in ("", "a/", "a/b c/", "_d/") for k in range(20)}
    base = str(tmp_path / "out")
    named.write_files(spark.createDataFrame(list(rows.items()), "path string, content string"), base)
    (tmp_path / "out" / "_staging" / "lost").mkdir(parents=True)
    (tmp_path / "out" / "_staging" / "lost" / "half.txt").write_text("of a job that failed")
    listed = named.list_files(spark, base)
    out = named.read_files(listed, base)
    assert out.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-len(rows) // 7))
    assert sorted((r.path, bytes(r.content).decode()) for r in out.collect()) == sorted(rows.items())
    (tmp_path / "out" / "a" / "other.bin").write_bytes(b"\xff\x00")  # what is there, not what was to be written
    assert named.read_files(named.list_files(spark, base), base).filter("path = 'a/other.bin'").first().content == b"\xff\x00"
    os.makedirs(tmp_path / "none")
    assert named.read_files(named.list_files(spark, str(tmp_path / "none")), str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="No such file|FileNotFound"):
        named.read_files(spark.createDataFrame([("gone",)], "path string"), base).collect()


def test_an_edit_rewrites_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "videos")
    rows = spark.range(500).select(F.concat(F.lit("v"), "id").alias("video_id"), F.lit("pending").alias("status"), (F.col("id") % 7).alias("n"))
    write_buckets(rows, path, "video_id", 16)

    def stamps():
        return {f: os.stat(os.path.join(path, f)).st_mtime_ns for f in files_below(path)}

    def held():
        return {r.video_id: (r.status, r.n) for r in read_buckets(spark, path, rows.schema, 16).collect()}

    before, plain = stamps(), held()
    assert len(plain) == 500
    edit = spark.createDataFrame([("v7", "queued"), ("v7", "skipped"), ("v9", "queued"), ("none", "x")], "video_id string, status string").withColumn("seq", F.monotonically_increasing_id())
    met = rewrite_buckets(spark, path, rows.schema, "video_id", 16, edit, lambda old: catalog.apply_updates(old, edit, "video_id", ["status"], "seq"))
    after = stamps()
    folders = lambda names: {n.split("/")[0] for n in names if "/" in n}
    assert folders(set(after) - set(before)) <= {f"bucket_of_16={b}" for b in met} and len(met) <= 3
    assert all(after[f] == before[f] for f in before if f.split("/")[0] not in {f"bucket_of_16={b}" for b in met} and "/" in f)
    assert held() == {**plain, "v7": ("skipped", 0), "v9": ("queued", 2)}
    # A bucket that loses all its rows goes; no keys, no work; a change may not move rows elsewhere.
    bucket = spark.createDataFrame([("v7",)], "video_id string")
    assert len(rewrite_buckets(spark, path, rows.schema, "video_id", 16, bucket, lambda old: old.limit(0))) == 1
    assert len(folders(files_below(path))) == 15 and len(held()) < 500
    assert rewrite_buckets(spark, path, rows.schema, "video_id", 16, bucket.limit(0), lambda old: old.limit(0)) == []
    with pytest.raises(ValueError, match="moved rows"):
        rewrite_buckets(spark, path, rows.schema, "video_id", 16, spark.createDataFrame([("v9",)], "video_id string"), lambda old: rows.select("video_id", "status", "n"))


def test_an_edit_takes_only_rows_still_in_the_state_it_read(spark):
    videos = spark.createDataFrame([(1, "pending", None), (2, "skipped", False), (3, "pending", None)], "id long, status string, is_technical boolean")
    judged = spark.createDataFrame([(1, True, "queued", None), (2, True, "queued", None), (3, True, "queued", "failed")], "id long, is_technical boolean, status string, error string")
    got = {r.id: (r.status, r.is_technical) for r in ingest.save_classification(videos, judged).collect()}
    assert got == {1: ("queued", True), 2: ("skipped", False), 3: ("pending", None)}
    requests = spark.createDataFrame([(1, "transcribed"), (2, "transcribed")], "id long, status string")
    queued = videos.withColumn("status", F.when(F.col("id") == 1, "queued").otherwise(F.col("status")))
    assert {r.id: r.status for r in ingest.save_submissions(queued, requests).collect()} == {1: "transcribed", 2: "skipped", 3: "pending"}


def test_marks_never_move_back(spark):
    day = lambda d: F.to_timestamp(F.lit(f"2024-01-{d:02d}"))
    channels = spark.range(3).select("id", F.when(F.col("id") > 0, day(10)).alias("last_scanned_at"))
    items = spark.range(3).select(F.col("id").alias("channel_id"), F.when(F.col("id") == 1, day(5)).otherwise(day(20)).alias("published_at"))
    got = {r.id: r.last_scanned_at.day for r in ingest.move_marks(channels, items).collect()}
    assert got == {0: 20, 1: 10, 2: 20}


def test_rollup_counts_every_step_and_keeps_errors(spark):
    found = spark.createDataFrame([(None,), ("unreadable",)], "error string")
    judged = spark.createDataFrame([(True, None), (False, None), (None, "no answer")], "is_technical boolean, error string")
    sent = spark.createDataFrame([(None,), (None,), ("refused",)], "error string")
    assert tuple(ingest.rollup(found, judged, sent).first()) == (1, 2, 1, 1, 2, 3)
    assert {tuple(r) for r in ingest.errors(found, judged, sent).collect()} == {("scan", "unreadable"), ("classify", "no answer"), ("submit", "refused")}
    nothing = [f.limit(0) for f in (found, judged, sent)]
    assert tuple(ingest.rollup(*nothing).first()) == (0, 0, 0, 0, 0, 0)


def test_only_the_newest_output_of_resumed_transcripts_is_read(spark, tmp_path):
    for folder, name, text in (("p/a", "deepgram_2.json", '{"a": 1}'), ("p/a", "deepgram_1.json", "old"), ("p/a", "whisper_9.json", "other"), ("p/b", "deepgram_1.json", "{broken"),
                               ("p/d", "whisper_1.json", "{}"), ("p/e", "deepgram_1.json", "never read")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    (tmp_path / "p/f").mkdir()
    (tmp_path / "p/f/deepgram_3.json").write_bytes(b"\xff\xfe")
    transcripts = spark.createDataFrame([("a", "p/a"), ("b", "p/b"), ("c", "p/none"), ("d", "p/d"), ("e", "p/e"), ("f", "p/f"), ("g", None)], "transcript_id string, folder string")
    state = spark.createDataFrame([(i, "transcription", "pending" if i == "e" else "completed") for i in "abcdefg"] + [("a", "export", "completed")], "transcript_id string, stage string, status string")
    outputs, status = saved.resume_transcripts(transcripts, state, str(tmp_path), "deepgram")
    assert [tuple(r) for r in outputs.collect()] == [("a", "deepgram", '{"a": 1}')]
    assert {r.transcript_id: (r.status, r.error) for r in status.collect()} == {
        "a": ("completed", None), "b": ("pending", "the file is no JSON"), "c": ("pending", None), "d": ("pending", None), "e": ("pending", None),
        "f": ("pending", "the file is not UTF-8"), "g": ("pending", None)}
    gone = spark.createDataFrame([("z", "p/a/missing.json")], "transcript_id string, path string")
    assert [tuple(r) for r in saved.read_saved(gone, str(tmp_path)).collect()] == [("z", None, "the file is gone")]


def test_catalog_tables_are_read_in_their_schema(spark, tmp_path):
    rows = spark.createDataFrame([("1", "UC1", 3)], "id string, channel_id string, priority long")
    append_table(rows, "channels", str(tmp_path / "channels"))
    append_table(rows, "channels", str(tmp_path / "channels"))
    got = scan_table(spark, "channels", str(tmp_path / "channels")).collect()
    assert len(got) == 2 and got[0].priority == 3 and got[0].category is None
