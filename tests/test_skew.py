"""Hot keys: crowded hours, one channel with half of everything, many rows of one time, mixed provider output."""

import pytest
from pyspark.sql import functions as F

from talkloom.operators import catalog, timeline
from talkloom.operators.ordered import even_blocks, ordered_scan
from talkloom.sources import providers


def hot_items(spark, n):
    """Half of all items in one channel, published in one second."""
    channel = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50 + 1)
    at = F.when(F.col("id") % 2 == 0, F.lit("2024-01-01 00:00:00")).otherwise(F.concat(F.lit("2024-01-01 00:00:"), F.lpad((F.col("id") % 60).cast("string"), 2, "0")))
    return spark.range(n).select("id", F.concat(F.lit("v"), "id").alias("video_id"), channel.cast("long").alias("channel_id"), at.cast("timestamp").alias("published_at"))


def test_blocks_stay_even_where_a_key_is_hot_and_times_are_equal(spark):
    n, rows = 40_000, 1000
    items = hot_items(spark, n)
    ranged, block = even_blocks(items, ["channel_id"], ["published_at", "id"], rows)
    sizes = [r[0] for r in ranged.groupBy("channel_id", block).agg(F.count("*").alias("n")).select("n").collect()]
    assert sum(sizes) == n and max(sizes) < 3 * rows
    scanned = ordered_scan(ranged, ["channel_id"], ["published_at", "id"], block, totals={"n": F.lit(1)})
    got = {(r.channel_id, r.id): r.n for r in scanned.filter("channel_id in (0, 2)").select("channel_id", "id", "n").collect()}
    for channel in (0, 2):
        order = sorted((r.published_at, r.id) for r in items.filter(F.col("channel_id") == channel).collect())
        assert all(got[(channel, i)] == k for k, (_, i) in enumerate(order, 1))
    small, block = even_blocks(items, ["channel_id"], ["published_at", "id"])
    assert small is items


def test_batches_of_a_crowded_hour(spark):
    items = hot_items(spark, 3000)
    plain = {(r.channel_id, r.batch_no): (r.ids, r.n_ids) for r in catalog.id_batches(items, 50).collect()}
    assert plain == {(r.channel_id, r.batch_no): (r.ids, r.n_ids) for r in catalog.id_batches(items, 50, block_rows=100).collect()}
    assert plain[(0, 0)][0].split(",")[:2] == ["v0", "v2"] and len([k for k in plain if k[0] == 0]) == 30


@pytest.mark.parametrize("n", [1, 50, 1500])
def test_newest_of_a_channel_with_half_of_all_items(spark, n):
    items = hot_items(spark, 8000)
    got = {}
    for r in catalog.newest_per_channel(items, n).collect():
        got.setdefault(r.channel_id, {})[r["rank"]] = r.id
    every = {}
    for r in items.collect():
        every.setdefault(r.channel_id, []).append((-r.published_at.timestamp(), r.id))
    assert got == {c: {k: i for k, (_, i) in enumerate(sorted(of)[:n], 1)} for c, of in every.items()}


def test_words_and_utterances_of_one_time_meet_without_all_pairs(spark):
    n = 100_000
    words = spark.range(n).select(F.lit(1).alias("transcript_id"), F.col("id").alias("pos"), F.lit(5.0).alias("start_s"), F.lit(5.2).alias("end_s"))
    utterances = spark.range(n).select(F.lit(1).alias("transcript_id"), F.col("id").alias("turn"), F.lit(4.9).alias("start_s"), F.lit(5.2).alias("end_s"))
    earlier = spark.createDataFrame([(1, 7, 4.0, 4.5)], "transcript_id int, turn long, start_s double, end_s double")
    out = timeline.words_in_utterances(words, utterances.filter("turn > 6").unionByName(earlier), "turn")
    assert tuple(out.agg(F.count("*"), F.min("turn"), F.max("turn")).first()) == (n, 7, 7)


def test_mixed_outputs_are_parsed_in_one_scan(spark, tmp_path):
    rows = [
        (1, "deepgram", '{"results": {"channels": [{"alternatives": [{"words": [{"speaker": 0, "start": 0.0, "end": 1.0, "punctuated_word": "A."}, {"speaker": 1, "start": 1.0, "end": 2.0, "punctuated_word": "B."}]}]}]}}'),
        (2, "smallestai", '{"utterances": [{"speaker": "speaker_3", "start": 0.5, "end": 1.0, "text": "hi"}]}'),
        (3, "smallestai", '{"transcription": "all of it", "words": [{"start": 2.0, "end": 3.0}]}'),
        (4, "whisper", '{"segments": [{"start": 0.0, "end": 2.0, "text": " x"}]}'), (5, "unknown", "{}"), (6, "whisper", "{broken"), (7, "deepgram", None),
    ]
    spark.createDataFrame(rows, "transcript_id long, provider string, output string").write.parquet(str(tmp_path / "outputs"))
    outputs = spark.read.parquet(str(tmp_path / "outputs"))
    got = sorted((r.transcript_id, r.provider, r.seg_no, r.speaker, r.start_s, r.end_s, r.text) for r in providers.normalise(outputs).collect())
    assert got == [(1, "deepgram", 0, 0, 0.0, 1.0, "A."), (1, "deepgram", 1, 1, 1.0, 2.0, "B."), (2, "smallestai", 0, 3, 0.5, 1.0, "hi"),
                   (3, "smallestai", 0, None, 2.0, 3.0, "all of it"), (4, "whisper", 0, None, 0.0, 2.0, " x")]
    plan = providers.elements_of(outputs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert str(tmp_path) not in providers.normalise(outputs)._jdf.queryExecution().executedPlan().toString()  # reads what the one pass wrote
