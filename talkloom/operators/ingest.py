"""Discovery, classification and submission of videos, as one flow over tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.functions.text import watch_url
from talkloom.operators import catalog
from talkloom.operators.model import Batch, classify_videos
from talkloom.scratch import materialise


def _newest(videos: DataFrame, limit: int | None) -> DataFrame:
    return videos if limit is None else catalog.page(videos, "published_at", limit)


def submissions(videos: DataFrame, channels: DataFrame, limit: int | None = None, mark: str = "transcribed") -> DataFrame:
    """Queued videos as requests for transcription, with the status they then take; of a `limit` the newest."""
    queued = _newest(catalog.where(videos, status="queued"), limit)
    rows = catalog.with_channel(queued, channels, "category")
    return rows.select(
        "id", "video_id", watch_url(F.col("video_id")).alias("source"),
        F.coalesce("category", F.lit("misc")).alias("loc"), F.lit(True).alias("diarize"),
        F.lit(True).alias("markdown"), F.lit(True).alias("correct"), F.lit(mark).alias("status"),
    )


def discover(items: DataFrame, channels: DataFrame, videos: DataFrame) -> DataFrame:
    """Items of active channels after their high-water mark, not yet known.

    All of them: the mark then moves past them, so one left out would never be found again.
    """
    active = channels.filter("is_active")
    return catalog.unknown(catalog.after_high_water(items, active), videos)


def classify_pending(
    videos: DataFrame, channels: DataFrame, factory: Callable[[], Batch], limit: int | None = None
) -> DataFrame:
    """Classification of pending videos, of a `limit` the newest: id, flag, confidence, reason, status, error.

    Written once, so that saving the results asks nothing again.
    """
    pending = _newest(catalog.where(videos, status="pending"), limit)
    rows = catalog.with_channel(pending, channels, "channel_name", "category")
    classified = classify_videos(rows, factory).select(
        *[c for c in ("id", "video_id") if c in rows.columns], "title", "is_technical", "classification_confidence", "classification_reason", "status", "error"
    )
    return materialise(classified, "classified")


def _still(videos: DataFrame, rows: DataFrame, key: str, expected: str) -> DataFrame:
    """The rows whose video still has the status they were made from, so that an edit in between is not undone."""
    return rows.join(catalog.where(videos, status=expected).select(key), key, "left_semi")


def save_classification(videos: DataFrame, classified: DataFrame, key: str = "id") -> DataFrame:
    """Write results back to videos that are still pending; rows that failed keep what they had."""
    fine = _still(videos, classified.filter("error IS NULL"), key, "pending")
    columns = [c for c in ("is_technical", "classification_confidence", "classification_reason", "status") if c in videos.columns]
    return catalog.apply_updates(videos, fine, key, columns)


def save_submissions(videos: DataFrame, requests: DataFrame, key: str = "id") -> DataFrame:
    """Videos that are still queued take the status of their request."""
    return catalog.apply_updates(videos, _still(videos, requests, key, "queued"), key, ["status"])


def move_marks(channels: DataFrame, items: DataFrame) -> DataFrame:
    """Channels scanned up to the newest of `items`; a mark never moves back."""
    newest = items.groupBy("channel_id").agg(F.max("published_at").alias("_newest")).withColumnRenamed("channel_id", "id")
    moved = F.greatest("last_scanned_at", "_newest").alias("last_scanned_at")
    return channels.join(newest, "id", "left").select(*[moved if c == "last_scanned_at" else F.col(c) for c in channels.columns])


def rollup(found: DataFrame, classified: DataFrame, requests: DataFrame) -> DataFrame:
    """Scan, classification and submission of a run as one row; its errors stay rows, see `errors`.

    found(error), classified(is_technical, error), requests(error): one row per video each, `error` null where it went well.
    """
    fine = F.col("error").isNull()
    scanned = found.agg(F.count_if(fine).alias("videos_discovered"), F.count_if(~fine).alias("_scan"))
    judged = catalog.run_summary(classified.withColumn("_run", F.lit(0)), "_run").drop("_run").withColumnRenamed("n_errors", "_classify")
    sent = requests.agg(F.count_if(fine).alias("videos_queued"), F.count_if(~fine).alias("_submit"))
    one = scanned.withColumn("_k", F.lit(0)).join(judged.withColumn("_k", F.lit(0)), "_k", "left").join(sent.withColumn("_k", F.lit(0)), "_k")  # one row each
    total = F.col("_scan") + F.coalesce("_classify", F.lit(0)) + F.col("_submit")
    return one.select("videos_discovered", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("videos_classified", "videos_approved", "videos_rejected")],
                      "videos_queued", total.alias("n_errors"))


def errors(found: DataFrame, classified: DataFrame, requests: DataFrame) -> DataFrame:
    """`(step, error)` of everything that failed in a run."""
    out = None
    for step, rows in (("scan", found), ("classify", classified), ("submit", requests)):
        part = rows.filter("error IS NOT NULL").select(F.lit(step).alias("step"), "error")
        out = part if out is None else out.unionByName(part)
    return out
