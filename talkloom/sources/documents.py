"""Lists, snapshots, feeds and saved state that arrive as JSON or XML documents."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom import schemas
from talkloom.functions.timing import iso_duration_seconds, parse_date
from talkloom.operators.rows import explode_once

# Audio types a feed entry may have.
AUDIO_TYPES = ["audio/mpeg", "audio/wav", "audio/x-m4a", "audio/mp4"]
PRIVATE_TITLE = "[Private video]"

_SOURCE = f"""source_file string, title string, speakers array<string>, categories array<string>,
tags array<string>, chapters array<array<string>>, loc string, date string, summary string,
episode int, additional_resources array<map<string,string>>, cutoff_date string,
youtube {schemas.PLATFORM}, media string, whisper_output string, deepgram_output string,
deepgram_chunks array<string>"""


def read_source_list(spark: SparkSession, path: str, excluded_key: str = "excluded") -> tuple[DataFrame, DataFrame]:
    """Sources of every file below `path` (one object or an array each): (accepted, rejected).

    Missing keys get their defaults; names of saved provider output are resolved against the list's folder. A source without a file, or with a date that does not parse, is
    rejected with a reason.
    """
    schema = f"{_SOURCE}, `{excluded_key}` array<struct<media:string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path, recursiveFileLookup=True)
    raw = raw.withColumn("_file", F.col("_metadata.file_path"))
    no_texts = F.array().cast("array<string>")

    def listed(name: str) -> Column:
        return F.coalesce(F.col(name), no_texts).alias(name)

    def bad_date(name: str) -> Column:
        return F.col(name).isNotNull() & parse_date(F.col(name)).isNull()

    folder = F.regexp_replace("_file", "/[^/]*$", "")

    def beside(c: Column) -> Column:
        return F.when(c.isNotNull(), F.concat_ws("/", folder, c))

    chapters = F.transform(
        F.coalesce("chapters", F.array().cast("array<array<string>>")),
        lambda c: F.struct(c[0].alias("idx"), c[1].try_cast("double").alias("start"), c[2].alias("title")),
    )
    filled = raw.select(
        "source_file", F.coalesce("title", F.lit("no-title")).alias("title"), listed("speakers"), listed("categories"),
        listed("tags"), chapters.alias("chapters"), F.coalesce("loc", F.lit("")).alias("loc"), "date", "summary", "episode",
        "additional_resources", "cutoff_date", "youtube", "media",
        F.coalesce(F.col(excluded_key)["media"], no_texts).alias("excluded_media"),
        beside(F.col("whisper_output")).alias("whisper_output"), beside(F.col("deepgram_output")).alias("deepgram_output"),
        F.transform(F.coalesce("deepgram_chunks", no_texts), beside).alias("deepgram_chunks"),
        F.when(F.col("source_file").isNull(), "source_file is required")
        .when(bad_date("date"), "date does not match yyyy-MM-dd")
        .when(bad_date("cutoff_date"), "cutoff_date does not match yyyy-MM-dd").alias("_reject"),
    )
    accepted = filled.filter("_reject IS NULL").drop("_reject").withColumn("date", parse_date(F.col("date"))).withColumn(
        "cutoff_date", parse_date(F.col("cutoff_date"))
    )
    return accepted, filled.filter("_reject IS NOT NULL").withColumnRenamed("_reject", "reason")


def _folder_below(root: str, path: Column) -> Column:
    """The folder of a file, from below `root` on."""
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", root).rstrip("/")
    roots = "|".join(dict.fromkeys(f"\\Q{r}\\E" for r in (plain, quote(plain))))
    return F.regexp_extract(path, f"^.*?(?:{roots})/(?:(.*)/)?[^/]*$", 1)


def read_saved_state(spark: SparkSession, path: str) -> DataFrame:
    """Newest saved state per folder below `path`, from `folder/metadata_<time>.json` files that hold one.

    A folder is named by its whole path below `path` (place and title), so equal titles of two places stay apart.
    """
    schema = f"pipeline_state {schemas.PIPELINE_STATE}, title string, source_file string"
    files = (
        spark.read.schema(schema).option("multiLine", True).json(path, recursiveFileLookup=True, pathGlobFilter="metadata_*.json")
        .select("pipeline_state", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"))
    )
    folder = _folder_below(path, F.col("path"))
    return (
        files.filter("pipeline_state IS NOT NULL").groupBy(folder.alias("folder"))
        .agg(F.max_by("pipeline_state", "file_name").alias("state"), F.max("file_name").alias("file_name"))
    )


def stage_rows(states: DataFrame, key: str = "folder") -> DataFrame:
    """Saved states as `(transcript_id, stage, status, error, attempts, completed_at)` rows."""
    return states.select(F.col(key).alias("transcript_id"), F.explode("state.stages").alias("stage", "s")).select(
        "transcript_id", "stage", "s.status", "s.error", "s.attempts", "s.completed_at"
    )


def list_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Files below `path` as `(folder, file_name)`, folders by their path below it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.select(
        _folder_below(path, F.col("path")).alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("file_name")
    )


_STATUS = """struct<existing:struct<media:array<string>,speakers:array<string>,tags:array<string>>,
needs:struct<transcript:array<string>>>"""


def flatten_status(df: DataFrame, column: str) -> DataFrame:
    """Site status snapshots as `(kind, value)` rows."""
    status = F.from_json(F.col(column), _STATUS)
    kinds = F.array(
        *[F.struct(F.lit(k).alias("kind"), status["existing"][k].alias("vs")) for k in ("media", "speakers", "tags")],
        F.struct(F.lit("backlog").alias("kind"), status["needs"]["transcript"].alias("vs")),
    )
    listed = explode_once(df, [], kinds, "_i", "k")
    return explode_once(listed, ["k.kind"], F.col("k.vs"), "_j", "value").select("kind", "value")


_ITEM = """title string, link string, description string, pubDate string,
enclosure struct<_url:string,_type:string>, episode string"""


def read_feed_items(spark: SparkSession, path: str, parent: dict[str, Column] | None = None) -> DataFrame:
    """Audio episodes of RSS feeds below `path`; other enclosures are left out.

    `parent` holds what every episode inherits from its feed, such as place, tags and speakers.
    """
    items = spark.read.format("xml").options(rowTag="item", ignoreNamespace="true").schema(_ITEM).load(path)
    at = F.regexp_extract("pubDate", "(\\d{1,2} \\w{3} \\d{4} \\d{2}:\\d{2}:\\d{2})", 1)
    zone = F.regexp_extract("pubDate", "([+-]\\d{4})\\s*$", 1)
    stamp = F.concat_ws(" ", at, F.when(zone == "", "+0000").otherwise(zone))
    return items.filter(F.col("enclosure._type").isin(AUDIO_TYPES)).select(
        F.col("enclosure._url").alias("source_file"), "title",
        F.try_to_timestamp(stamp, F.lit("d MMM yyyy HH:mm:ss Z")).cast("date").alias("date"),
        F.col("episode").try_cast("int").alias("episode"), F.col("link").alias("media"), "description",
        *[c.alias(n) for n, c in (parent or {}).items()],
    )


def explode_playlists(playlists: DataFrame, entries: str = "entries") -> DataFrame:
    """One source per playlist entry, with the parent's metadata; private videos are left out."""
    parent = [c for c in playlists.columns if c not in (entries, "title", "source_file")]
    return (
        playlists.select(*parent, F.explode(entries).alias("e"))
        .filter(F.col("e.title") != PRIVATE_TITLE)
        .select(*parent, F.col("e.url").alias("source_file"), F.col("e.title").alias("title"))
    )


def parse_video_items(df: DataFrame, column: str, channel_id: str) -> DataFrame:
    """Video items of the platform's API as rows of the videos table."""
    item = F.from_json(F.col(column), schemas.VIDEO_ITEM)
    rows = df.select(F.col(channel_id).alias("channel_id"), item.alias("i"))
    return rows.select(
        F.col("i.id").alias("video_id"), "channel_id", "i.snippet.title", "i.snippet.description",
        F.col("i.snippet.publishedAt").try_cast("timestamp").alias("published_at"),
        iso_duration_seconds(F.coalesce("i.contentDetails.duration", F.lit(""))).alias("duration"),
        F.coalesce("i.snippet.tags", F.array().cast("array<string>")).alias("tags"),
        F.col("i.snippet.thumbnails.high.url").alias("thumbnail_url"),
        F.coalesce(F.col("i.statistics.viewCount").try_cast("bigint"), F.lit(0)).alias("view_count"),
        F.lit("pending").alias("status"),
    )


def normalise_chapters(chapters: Column) -> Column:
    """Platform chapters `array<struct<start_time, title>>` as numbered chapters, without a leading
    placeholder chapter."""
    placeholder = F.get(chapters, F.lit(0))["title"] == "<Untitled Chapter 1>"
    kept = F.when(placeholder, F.slice(chapters, F.lit(2), F.greatest(F.size(chapters) - 1, F.lit(0)))).otherwise(chapters)
    return F.transform(
        kept,
        lambda c, i: F.struct(i.cast("string").alias("idx"), c["start_time"].alias("start"), c["title"].alias("title")),
    )
