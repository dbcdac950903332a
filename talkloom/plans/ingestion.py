"""One run of ingestion over catalog tables: discover, classify, submit, and write everything back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talkloom.operators import catalog, ingest
from talkloom.operators.model import Batch
from talkloom.scratch import materialise
from talkloom.sinks.tables import read_buckets, rewrite_buckets, write_buckets

RUNS = "run_id string, videos_discovered long, videos_classified long, videos_approved long, videos_rejected long, videos_queued long, n_errors long"
ERRORS = "run_id string, step string, error string"


@dataclass(frozen=True)
class CatalogTables:
    """Tables below `root`, in buckets: videos by `video_id`, channels by `id`, runs and their errors by `run_id`."""

    spark: SparkSession
    root: str
    video_schema: StructType
    channel_schema: StructType
    buckets: int = 64

    def table(self, name: str) -> DataFrame:
        schema, _ = self._layout(name)
        return read_buckets(self.spark, f"{self.root}/{name}", schema, self.buckets)

    def _layout(self, name: str) -> tuple[StructType, str]:
        return {
            "videos": (self.video_schema, "video_id"), "channels": (self.channel_schema, "id"),
            "runs": (StructType.fromDDL(RUNS), "run_id"), "errors": (StructType.fromDDL(ERRORS), "run_id"),
        }[name]

    def append(self, name: str, rows: DataFrame) -> None:
        schema, key = self._layout(name)
        write_buckets(rows.select(*schema.names), f"{self.root}/{name}", key, self.buckets)

    def edit(self, name: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Rewrite the buckets of `touched`; `change` sees their rows as they are now."""
        schema, key = self._layout(name)
        return rewrite_buckets(self.spark, f"{self.root}/{name}", schema, key, self.buckets, touched, change)


def create_tables(tables: CatalogTables, videos: DataFrame, channels: DataFrame) -> None:
    tables.append("videos", videos)
    tables.append("channels", channels)
    for name in ("runs", "errors"):
        schema, _ = tables._layout(name)
        tables.append(name, tables.spark.createDataFrame([], schema))
        tables.spark.createDataFrame([], schema).write.mode("append").parquet(f"{tables.root}/{name}")  # the folder, so that it can be read


def run_ingestion(tables: CatalogTables, items: DataFrame, factory: Callable[[], Batch], run_id: str, limit: int | None = None) -> None:
    """Discover, insert, classify, submit, move the marks, and write the run's row.

    Every write is by key and takes only rows still in the state they were read in, and the marks move after the new videos are stored. So a run that
    is lost anywhere is simply run again under its id: what was done is known, queued or submitted already, and its row is replaced.
    """
    channels = tables.table("channels")
    active = channels.filter("is_active").select(F.col("id").alias("channel_id"))
    seen = items.join(active, "channel_id", "left_semi")
    found = materialise(ingest.discover(items, channels, tables.table("videos")), "found")
    tables.edit("videos", found, lambda old: catalog.insert_videos(old, found))

    classified = ingest.classify_pending(tables.table("videos"), channels, factory, limit)
    tables.edit("videos", classified, lambda old: ingest.save_classification(old, classified, "video_id"))

    requests = materialise(ingest.submissions(tables.table("videos"), channels, limit), "requests")
    tables.edit("videos", requests, lambda old: ingest.save_submissions(old, requests, "video_id"))

    marks = materialise(seen.groupBy("channel_id").agg(F.max("published_at").alias("published_at")), "marks")
    tables.edit("channels", marks.withColumnRenamed("channel_id", "id"), lambda old: ingest.move_marks(old, marks))

    none = F.lit(None).cast("string").alias("error")
    sides = (found.select(none), classified.select("is_technical", "error"), requests.select(none))
    row = materialise(ingest.rollup(*sides).withColumn("run_id", F.lit(run_id)), "run")
    failed = materialise(ingest.errors(*sides).withColumn("run_id", F.lit(run_id)), "errors")
    for name, rows in (("runs", row), ("errors", failed)):
        tables.edit(name, row, lambda old, rows=rows: old.filter(F.col("run_id") != run_id).unionByName(rows.select(*old.columns)))
