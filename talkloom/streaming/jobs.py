"""Incremental discovery, classification, tag dictionary and run metrics as streaming jobs.

What a job knows from earlier batches is Spark's own streaming state, kept by key in the checkpoint folder: a batch
touches the keys it holds and reads nothing that was written before. Results go to one folder per micro-batch, overwritten if the batch
is repeated, so a restart after a lost driver or executor gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talkloom.functions import replies
from talkloom.operators import catalog, tags
from talkloom.scratch import file_system

# State on the executors' disks instead of their heaps, with change logs as checkpoints; a session that names a store of its own keeps it.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _exists(spark: SparkSession, path: str) -> bool:
    fs, of = file_system(spark, path)
    return fs.exists(of(path))


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows a job wrote below `path`."""
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def _run(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _run_by_batch(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what a batch changed to `out`/batch=N; keyed state continues from the checkpoint.

    A batch that does not find the one before it raises: state that goes on while its results are lost would go unnoticed.
    """
    spark = rows.sparkSession
    for name, value in STATE_STORE.items():
        if name not in spark.conf.getAll:
            spark.conf.set(name, value)

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id > 0 and not _exists(batch.sparkSession, f"{out}/batch={batch_id - 1}/_SUCCESS"):
            raise RuntimeError(f"batch {batch_id} found no results of the batch before it in {out}")
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _run(rows.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def discover(items: DataFrame, known: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Admit each `video_id` once, however late it comes again, into `out`.

    Its form is the earliest one of the batch it first came in. Known videos are left out by a join with the catalog. The state of an
    id is the span of batch times it was seen at, and its form: an id is new while both ends are the running batch's time.
    """
    now = F.current_timestamp()  # one value per micro-batch, the same if the batch is repeated
    rest = [c for c in items.columns if c != "video_id"]
    seen = catalog.unknown(items, known).withColumn("_now", now).groupBy("video_id").agg(
        F.min("_now").alias("_first"), F.max("_now").alias("_last"),
        F.min_by(F.struct(*rest), F.struct("published_at", "channel_id")).alias("_form"),
    )
    fresh = seen.filter((F.col("_first") == now) & (F.col("_last") == now))
    return _run_by_batch(fresh.select("video_id", "_form.*").select(*items.columns), out, checkpoint)


def advance_marks(items: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """High-water mark per channel over everything seen, known videos too; a batch writes the marks it moved or met."""
    marks = items.groupBy("channel_id").agg(F.max("published_at").alias("mark"))
    return _run_by_batch(marks, out, checkpoint)


def high_water_marks(spark: SparkSession, out: str, schema) -> DataFrame:
    return read_batches(spark, out, schema).groupBy("channel_id").agg(F.max("mark").alias("mark"))


def classify_columns(items: DataFrame) -> DataFrame:
    """Gate, parse and decide on rows with `duration` and `reply`; stateless, for batch and stream."""
    gate = replies.duration_gate(F.col("duration"))
    parsed = items.withColumn("_gate", gate).withColumn("_r", replies.parse_classification(F.col("reply")))
    gated = F.col("_gate").isNotNull()
    flag = F.when(gated, False).otherwise(F.col("_r.is_technical"))
    conf = F.when(gated, 1.0).otherwise(F.col("_r.confidence"))
    return parsed.select(
        "id", flag.alias("is_technical"), conf.alias("confidence"), F.coalesce("_gate", "_r.reason").alias("reason"),
        F.when(gated, "skipped").otherwise(replies.classification_status(flag, conf)).alias("status"),
    )


def classify(items: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    writer = classify_columns(items).writeStream.format("parquet").option("path", out).outputMode("append")
    return _run(writer, checkpoint)


def tag_dictionary(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running counts per (tag, spelling) as state; a batch writes the new totals of the spellings it holds."""
    return _run_by_batch(tags.spelling_counts(rows), out, checkpoint)


def latest_dictionary(spark: SparkSession, out: str) -> DataFrame:
    """One row per tag from what the batches below `out` wrote.

    Totals only grow, first uses only fall and last uses only rise, so the newest row of a spelling is an aggregate.
    """
    if not _exists(spark, out):
        raise RuntimeError(f"no dictionary in {out}")
    totals = spark.read.parquet(f"{out}/batch=*").groupBy("tag", "spelling").agg(
        F.max("n").alias("n"), F.min("first").alias("first"), F.max("last_seen").alias("last_seen")
    )
    return tags.fold_spellings(totals)


METRICS = "batch_id long, videos_classified long, videos_approved long, videos_rejected long, n_errors long"


def run_metrics(outcomes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """One summary row per micro-batch, keyed by the batch id."""

    def summarise(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        catalog.run_summary(keyed, "batch_id").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _run(outcomes.writeStream.foreachBatch(summarise), checkpoint)


def wait(query: StreamingQuery, then: Callable[[], DataFrame]) -> DataFrame:
    """Let an available-now query finish, then read its result."""
    query.awaitTermination()
    return then()
