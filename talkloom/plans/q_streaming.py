"""Streaming jobs run to the end of the given tables; results are read from what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.plans import views
from talkloom.plans.q_tags import _CONTEXT, _SPELLINGS, _STATS
from talkloom.plans.registry import query
from talkloom.scratch import scratch_path
from talkloom.streaming import jobs


BATCHES = 4


def _arriving(spark, rows, arrival):
    """`rows` as a stream of BATCHES micro-batches: batch i holds the rows whose `arrival` is i.

    Each arrival is written as one file per core, and a batch reads as many files, oldest first.
    """
    path, files = scratch_path(spark, "arrivals"), spark.sparkContext.defaultParallelism
    for i in range(BATCHES):
        rows.filter(arrival == i).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _events_stream(spark, sf):
    """The events, every fourth one in a batch."""
    events = views.table(spark, sf, "events").withColumn("published_at", F.col("ts").cast("timestamp"))
    return _arriving(spark, events, F.col("event_id") % BATCHES)


# Two events share an id, and come in different batches; ids divisible by four are known already.
_ID = "concat('v', event_id // 2)"
_ARRIVAL = "event_id * 7 % 4"


def _discovery(spark, sf):
    half = F.floor(F.col("event_id") / 2)
    events = views.table(spark, sf, "events")
    items = events.select(
        F.concat(F.lit("v"), half).alias("video_id"), F.col("user_id").alias("channel_id"), F.col("ts").cast("timestamp").alias("published_at"),
        (F.col("event_id") * 7 % BATCHES).alias("arrival"))
    known = events.filter("event_id % 4 = 0").select(F.concat(F.lit("v"), half).alias("video_id"))
    return _arriving(spark, items, F.col("arrival")).drop("arrival"), known, scratch_path(spark, "discover")


@query("stream_discover", f"""SELECT {_ID} AS video_id, min_by(user_id, ({_ARRIVAL}, ts, user_id)) AS channel_id FROM events
WHERE {_ID} NOT IN (SELECT {_ID} FROM events WHERE event_id % 4 = 0) GROUP BY 1""")
def stream_discover(spark, sf):
    items, known, out = _discovery(spark, sf)
    jobs.discover(items, known, out, f"{out}-checkpoint").awaitTermination()
    return jobs.read_batches(spark, out, items.schema).select("video_id", "channel_id")


@query("stream_marks", """SELECT user_id AS channel_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS mark FROM events GROUP BY 1""")
def stream_marks(spark, sf):
    """High-water mark per channel after the run."""
    items, _, out = _discovery(spark, sf)
    schema = items.select("channel_id", F.col("published_at").alias("mark")).schema
    jobs.advance_marks(items, out, f"{out}-checkpoint").awaitTermination()
    marks = jobs.high_water_marks(spark, out, schema)
    return marks.select("channel_id", F.date_format("mark", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("mark"))


@query("stream_classify", """SELECT event_id AS id, CASE WHEN d > 0 AND (d < 600 OR d > 3000) THEN false ELSE tech END AS is_technical,
  CASE WHEN d > 0 AND (d < 600 OR d > 3000) THEN 1.0 WHEN event_id % 2 = 0 THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence,
  CASE WHEN d > 0 AND d < 600 THEN 'Too short (' || d || 's < 600s minimum)' WHEN d > 3000 THEN 'Too long (' || d || 's > 3000s maximum)'
    WHEN event_id % 3 = 0 THEN 'because ' || event_type ELSE 'No reason provided' END AS reason,
  CASE WHEN d > 0 AND (d < 600 OR d > 3000) THEN 'skipped' WHEN NOT tech THEN 'skipped' WHEN event_id % 2 = 1 THEN 'queued' ELSE 'classified' END AS status
FROM (SELECT event_id, event_type, event_type <> 'error' AS tech, floor(value * 10)::INT AS d FROM events) e""")
def stream_classify(spark, sf):
    tech = F.when(F.col("event_type") != "error", "true").otherwise("false")
    conf = F.when(F.col("event_id") % 2 == 0, "0.5").otherwise("0.9")
    reason = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "reason": "because '), F.col("event_type"), F.lit('"'))).otherwise("")
    items = _events_stream(spark, sf).select(
        F.col("event_id").alias("id"), F.floor(F.col("value") * 10).cast("int").alias("duration"),
        F.concat(F.lit('{"is_technical": '), tech, F.lit(', "confidence": '), conf, reason, F.lit("}")).alias("reply"))
    out = scratch_path(spark, "classify")
    schema = jobs.classify_columns(items).schema
    jobs.classify(items, out, f"{out}-checkpoint").awaitTermination()
    return spark.read.schema(schema).parquet(out)


def _tag_stream(spark, sf):
    return _arriving(spark, views.item_tags(spark, sf), F.pmod(F.hash("item_id"), F.lit(BATCHES)))


@query("stream_tags", f"""SELECT s.tag, frequency, variations, {_CONTEXT.replace("tag,", "s.tag,")} AS context, first_seen, last_seen
FROM ({_STATS}) s JOIN ({_SPELLINGS}) v ON v.tag = s.tag""", ["item_tags"])
def stream_tags(spark, sf):
    out = scratch_path(spark, "tags")
    running = jobs.tag_dictionary(_tag_stream(spark, sf), out, f"{out}-checkpoint")
    running.awaitTermination()
    stats = jobs.latest_dictionary(spark, out)
    return stats.select("tag", "frequency", F.array_join("variations", "|").alias("variations"), "context", "first_seen", "last_seen")


@query("stream_runs", """SELECT event_id % 4 AS batch_id, count(*) FILTER (event_id % 97 > 0) AS videos_classified,
  count(*) FILTER (event_id % 97 > 0 AND event_type <> 'error') AS videos_approved,
  count(*) FILTER (event_id % 97 > 0 AND event_type = 'error') AS videos_rejected, count(*) FILTER (event_id % 97 = 0) AS n_errors FROM events GROUP BY 1""")
def stream_runs(spark, sf):
    outcomes = _events_stream(spark, sf).select(
        (F.col("event_type") != "error").alias("is_technical"),
        F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("failed "), F.col("event_id"))).alias("error"))
    out = scratch_path(spark, "runs")
    jobs.run_metrics(outcomes, out, f"{out}-checkpoint").awaitTermination()
    return jobs.read_batches(spark, out, jobs.METRICS)
