"""Reads, joins and keyed changes over channels, videos, runs and transcripts.

No join is forced to broadcast: the optimizer broadcasts a side whose size it knows to be small, and
splits skewed partitions of the others at run time.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions.timing import iso_text
from talkloom.operators.ordered import RANGE_ROWS, even_blocks, ordered_scan


# ---- reads ---------------------------------------------------------------------------------------


def lookup(df: DataFrame, order: Sequence[Any] = ("id",), **equals: Any) -> DataFrame:
    """The first row whose columns equal the given values."""
    return where(df, **equals).orderBy(*order).limit(1)


def where(df: DataFrame, **equals: Any) -> DataFrame:
    """Conjunction of the supplied equality filters; None means not supplied."""
    for name, value in equals.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def page(df: DataFrame, newest: str, limit: int = 100, offset: int = 0, tie: str = "id") -> DataFrame:
    """One page, newest first: a top-k of limit + offset rows per task, no full sort."""
    return df.orderBy(F.desc(newest), F.asc(tie)).offset(offset).limit(limit)


def with_text(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is present and not empty, as the four listing columns."""
    return df.filter(F.col(column) != "").select("title", "loc", "status", column)


def with_channel(df: DataFrame, channels: DataFrame, *fields: str) -> DataFrame:
    """Left join to the channel; only the named fields are read and joined."""
    side = channels.select(F.col("id").alias("channel_id"), *fields)
    return df.join(side, "channel_id", "left")


def active_channels(channels: DataFrame) -> DataFrame:
    return channels.filter("is_active").orderBy("priority", "id")


def sources_of(df: DataFrame, loc: str = "all", coverage: str = "none") -> DataFrame:
    if loc != "all":
        df = df.filter(F.col("loc") == loc)
    if coverage != "none":
        df = df.filter(F.col("transcription_coverage") == coverage)
    return df


def video_listing(videos: DataFrame, channels: DataFrame) -> DataFrame:
    """Videos as served: empty tag list for null, ISO times, nested channel."""
    joined = with_channel(videos, channels, "channel_name", "category")
    tags = F.col("tags") if "tags" in videos.columns else F.lit(None).cast("array<string>")
    channel = F.when(F.col("channel_name").isNotNull(), F.struct("channel_name", "category"))
    return joined.select(
        F.col("id").cast("string").alias("id"), "video_id",
        F.col("channel_id").cast("string").alias("channel_id"), "title",
        iso_text(F.col("published_at")).alias("published_at"), "duration",
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
        "is_technical", "status", channel.alias("youtube_channels"),
    )


def channel_listing(channels: DataFrame) -> DataFrame:
    """Channels as served: text ids and ISO times, by name."""
    return channels.orderBy("channel_name").select(
        F.col("id").cast("string").alias("id"), "channel_id", "channel_name", "category", "priority", "is_active",
        iso_text(F.col("last_scanned_at")).alias("last_scanned_at"),
    )


def run_listing(runs: DataFrame, channels: DataFrame, limit: int = 50) -> DataFrame:
    """Latest runs as served, with the channel's name; the page is cut before the join."""
    latest = with_channel(page(runs, "started_at", limit), channels, "channel_name")
    channel = F.when(F.col("channel_name").isNotNull(), F.struct("channel_name"))
    return latest.select(
        F.col("id").cast("string").alias("id"), "run_type", F.col("channel_id").cast("string").alias("channel_id"),
        "videos_discovered", iso_text(F.col("started_at")).alias("started_at"),
        iso_text(F.col("completed_at")).alias("completed_at"), channel.alias("youtube_channels"),
    )


def transcript_listing(transcripts: DataFrame) -> DataFrame:
    """Transcripts as served: empty lists for null."""
    empty = F.array().cast("array<string>")
    lists = ("speakers", "tags", "categories", "topics")
    return transcripts.select(*[
        F.coalesce(F.col(c), empty).alias(c) if c in lists else F.col(c).cast("string").alias(c) if c == "id" else F.col(c)
        for c in transcripts.columns
    ])


# ---- discovery -----------------------------------------------------------------------------------


def known(items: DataFrame, videos: DataFrame, key: str = "video_id") -> DataFrame:
    return items.join(videos.select(key), key, "left_semi")


def unknown(items: DataFrame, videos: DataFrame, key: str = "video_id") -> DataFrame:
    return items.join(videos.select(key), key, "left_anti")


def after_high_water(items: DataFrame, channels: DataFrame) -> DataFrame:
    """Items published after their channel was last scanned; all of a channel never scanned."""
    marks = channels.select(F.col("id").alias("channel_id"), "last_scanned_at")
    fresh = F.col("last_scanned_at").isNull() | (F.col("published_at") > F.col("last_scanned_at"))
    return items.join(marks, "channel_id").filter(fresh).drop("last_scanned_at")


SALTS = 64


def newest_per_channel(items: DataFrame, n: int = 50) -> DataFrame:
    """At most `n` newest items per channel, ranked.

    A channel is ranked in SALTS parts first, whatever `n` is; what may still be among its newest, SALTS * n rows at most, is ranked again.
    """
    from pyspark.sql import Window

    order = [F.desc("published_at"), F.col("id")]
    parts = items.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    within = Window.partitionBy("channel_id", "_salt").orderBy(*order)
    kept = parts.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= n).drop("_salt", "rank")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("channel_id").orderBy(*order))).filter(F.col("rank") <= n)


def id_batches(items: DataFrame, size: int = 50, block_rows: int = RANGE_ROWS) -> DataFrame:
    """Ids of a channel, newest first, in comma-separated batches of `size`; a crowded hour is several blocks of the numbering."""
    aged = items.select("channel_id", "id", "video_id", (-F.unix_micros("published_at")).alias("_age"))
    rows, block = even_blocks(aged, ["channel_id"], ["_age", "id"], block_rows)
    numbered = ordered_scan(rows, ["channel_id"], ["_age", "id"], block, totals={"_n": F.lit(1)})
    batch = F.floor((F.col("_n") - 1) / size).cast("long").alias("batch_no")
    ordered = F.array_sort(F.collect_list(F.struct("_n", "video_id")))
    return numbered.groupBy("channel_id", batch).agg(
        F.array_join(F.transform(ordered, lambda x: x["video_id"]), ",").alias("ids"),
        F.count("*").alias("n_ids"),
    )


# ---- keyed changes -------------------------------------------------------------------------------


def apply_updates(
    df: DataFrame, updates: DataFrame, key: str, columns: Sequence[str], seq: str | None = None,
    supplied: str | None = None,
) -> DataFrame:
    """Set the supplied columns on matching rows; a supplied null is set, an absent column is kept.

    `supplied` names an array column listing the columns an update carries (all if it is missing);
    several updates of one row apply in the order of `seq`, folded before the join.
    """
    has = {c: F.array_contains(supplied, c) if supplied else F.lit(True) for c in columns}
    at = F.col(seq) if seq else F.lit(0)
    folded = updates.groupBy(key).agg(
        *[F.max_by(F.struct(F.col(c).alias("v")), F.when(has[c], at)).alias(f"_u_{c}") for c in columns]
    )
    joined = df.join(folded, key, "left")
    return joined.select(
        *[
            F.when(F.col(f"_u_{c}").isNotNull(), F.col(f"_u_{c}")["v"]).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in df.columns
        ]
    )


def manual_override(videos: DataFrame, overrides: DataFrame, at: Column) -> DataFrame:
    """Approve or reject by hand: `overrides(id, is_technical, classification_reason)`."""
    reason = F.coalesce(F.when(F.col("classification_reason") != "", F.col("classification_reason")), F.lit("Manual override"))
    rows = overrides.select(
        "id", "is_technical", reason.alias("classification_reason"),
        F.lit(1.0).alias("classification_confidence"),
        F.when(F.col("is_technical"), "queued").otherwise("skipped").alias("status"),
        at.alias("classified_at"),
    )
    columns = ["is_technical", "classification_reason", "classification_confidence", "status", "classified_at"]
    return apply_updates(videos, rows, "id", columns)


def delete_channels(
    channels: DataFrame, videos: DataFrame, runs: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove channels and their videos; their runs stay, without a channel. `doomed(id)`."""
    ids = doomed.select("id").distinct()
    by_channel = ids.select(F.col("id").alias("channel_id"))
    marked = runs.join(by_channel.withColumn("_gone", F.lit(True)), "channel_id", "left")
    kept_id = F.when(F.col("_gone").isNull(), F.col("channel_id")).alias("channel_id")
    return (
        channels.join(ids, "id", "left_anti"),
        videos.join(by_channel, "channel_id", "left_anti"),
        marked.select(*[kept_id if c == "channel_id" else F.col(c) for c in runs.columns]),
    )


def _first_of_each(new: DataFrame, key: str, seq: str) -> DataFrame:
    rest = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*rest), seq).alias("_r"))
    return first.select(key, "_r.*").select(*new.columns)


def add_channels(channels: DataFrame, new: DataFrame, seq: str = "id") -> DataFrame:
    """Append channels whose external id is not taken; priority 3 and active by default."""
    fresh = unknown(_first_of_each(new, "channel_id", seq), channels, "channel_id")
    filled = fresh.withColumn("priority", F.coalesce("priority", F.lit(3))).withColumn(
        "is_active", F.coalesce("is_active", F.lit(True))
    )
    return channels.unionByName(filled.select(*channels.columns))


def insert_videos(videos: DataFrame, found: DataFrame, seq: str = "id") -> DataFrame:
    """Append discovered videos as pending, unique on the external id."""
    fresh = unknown(_first_of_each(found, "video_id", seq), videos, "video_id")
    return videos.unionByName(fresh.withColumn("status", F.lit("pending")).select(*videos.columns))


def save_projection(finished: DataFrame) -> DataFrame:
    """Finished transcripts as catalog rows; missing lists are empty, a missing correction stays null."""
    empty = F.array().cast("array<string>")

    def listed(name: str) -> Column:
        return F.coalesce(F.col(name), empty).alias(name)

    return finished.select(
        "title", "loc", F.col("event_date").cast("string").alias("event_date"), listed("speakers"),
        listed("tags"), listed("categories"), F.coalesce("raw_text", F.lit("")).alias("raw_text"),
        "corrected_text", "summary", F.col("source_file").alias("media_url"), "status", "conference",
        listed("topics"), "channel_name",
    )


# ---- queue ---------------------------------------------------------------------------------------


def union_media(*sides: DataFrame) -> DataFrame:
    out = sides[0].select("media")
    for s in sides[1:]:
        out = out.union(s.select("media"))
    return out.filter("media IS NOT NULL").distinct()


def flag_existing(entries: DataFrame, taken: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """Flag entries whose media is taken or that are not strictly later than the cutoff."""
    marks = union_media(taken).withColumn("_taken", F.lit(True))
    late = F.lit(True) if cutoff is None else cutoff.isNull() | F.coalesce(F.col("date") > cutoff, F.lit(False))
    exist = F.col("_taken").isNotNull() | ~late
    # Entries without media cannot be taken; joined, they would all meet in one task.
    known = entries.filter("media IS NOT NULL").join(marks, "media", "left")
    rest = entries.filter("media IS NULL").withColumn("_taken", F.lit(None).cast("boolean"))
    return known.unionByName(rest).withColumn("exist", exist).drop("_taken")


def after_cutoff(entries: DataFrame, cutoff: Column) -> DataFrame:
    return entries.filter(F.col("date") > cutoff)


def enrich_from_cache(requests: DataFrame, cached: DataFrame, columns: Sequence[str], newest: str) -> DataFrame:
    """Fill blank columns from the newest cached metadata of the same place and source or media."""
    fields = F.struct(*[F.col(c) for c in columns])
    sides = [
        cached.select("loc", F.col(k).alias("source_file"), fields.alias("_m"), F.col(newest).alias("_at"))
        for k in ("source_file", "media")
    ]
    best = (
        sides[0].unionByName(sides[1]).filter("source_file IS NOT NULL")
        .groupBy("loc", "source_file").agg(F.max_by("_m", "_at").alias("_m"))
    )
    joined = requests.join(best, ["loc", "source_file"], "left")

    def filled(name: str) -> Column:
        own = F.col(name)
        kind = requests.schema[name].dataType.typeName()
        blank = (F.size(own) <= 0) if kind == "array" else (own == "")
        return F.when(own.isNull() | blank, F.col("_m")[name]).otherwise(own).alias(name)

    return joined.select(
        *[filled(c) if c in columns else F.col(c) for c in requests.columns],
        F.col("_m").isNotNull().alias("cache_hit"),
    )


def queue_duplicates(batch: DataFrame, queue: DataFrame, seq: str) -> DataFrame:
    """Requests whose (loc, title) is queued already or came earlier in the batch; untitled never."""
    titled = batch.filter("title IS NOT NULL")
    keys = ["loc", "title"]
    queued = queue.select(*keys).distinct().withColumn("_queued", F.lit(True))
    first = titled.groupBy(*keys).agg(F.min(seq).alias("_first"))
    marks = first.join(queued, keys, "left")
    return (
        titled.join(marks, keys)
        .filter(F.col("_queued").isNotNull() | (F.col(seq) > F.col("_first")))
        .select(*batch.columns)
    )


def _nth(df: DataFrame, seq: str) -> DataFrame:
    rows, block = even_blocks(df, ["loc", "title"], [seq])
    return ordered_scan(rows, ["loc", "title"], [seq], block, totals={"_nth": F.lit(1)})


def queue_remove(queue: DataFrame, requests: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """Each request takes its first match off the queue: (what is left, requests without a match)."""
    keys = ["loc", "title"]
    wanted = requests.groupBy(*keys).agg(F.count("*").alias("_wanted"))
    held = queue.groupBy(*keys).agg(F.count("*").alias("_held"))
    left = _nth(queue, seq).join(wanted, keys, "left").filter(
        F.col("_wanted").isNull() | (F.col("_nth") > F.col("_wanted"))
    )
    missing = _nth(requests, seq).join(held, keys, "left").filter(
        F.col("_held").isNull() | (F.col("_nth") > F.col("_held"))
    )
    return left.select(*queue.columns), missing.select(*requests.columns)


# ---- run summaries -------------------------------------------------------------------------------


def run_summary(outcomes: DataFrame, run: str = "run_id") -> DataFrame:
    """Counts per run from `(run, is_technical, error)` rows; the messages stay rows, see run_errors."""
    fine = F.col("error").isNull()
    technical = F.coalesce("is_technical", F.lit(False))
    return outcomes.groupBy(run).agg(
        F.count_if(fine).alias("videos_classified"),
        F.count_if(fine & technical).alias("videos_approved"),
        F.count_if(fine & ~technical).alias("videos_rejected"),
        F.count_if(~fine).alias("n_errors"),
    )


def scan_summary(found: DataFrame, run: str = "run_id") -> DataFrame:
    """Videos discovered per run, and how many failed to be read."""
    fine = F.col("error").isNull()
    return found.groupBy(run).agg(F.count_if(fine).alias("videos_discovered"), F.count_if(~fine).alias("n_errors"))


def run_errors(outcomes: DataFrame, run: str = "run_id") -> DataFrame:
    return outcomes.filter("error IS NOT NULL").select(run, "error")


def batch_status(rows: DataFrame, key: str) -> DataFrame:
    failed, done = F.col("status") == "failed", F.col("status") == "completed"
    return rows.groupBy(key).agg(
        F.when(F.bool_or(failed), "failed").when(F.bool_and(done), "completed").otherwise("in_progress").alias("status")
    )


def added_exist_counts(flagged: DataFrame, key: str) -> DataFrame:
    return flagged.groupBy(key).agg(
        F.count_if(~F.col("exist")).alias("n_added"), F.count_if("exist").alias("n_exist")
    )
