"""Queries that write tables and files and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.operators import catalog
from talkloom.plans import views
from talkloom.plans.flows import finalise
from talkloom.plans.ingestion import CatalogTables, create_tables, run_ingestion
from talkloom.plans.q_render import flag_model
from talkloom.plans.q_sources import _BY, _JSON, _MARKDOWN, _TEXT, _finished, _place
from talkloom.plans.q_timeline import _render_sql
from talkloom.plans.registry import query
from talkloom.plans.sql_views import VIEWS
from talkloom.scratch import materialise, scratch_path
from talkloom.sinks import exports
from talkloom.sinks.named import list_files, read_files, write_files
from talkloom.sinks.tables import read_buckets, rewrite_buckets, write_buckets
from talkloom.sources.providers import words_of
from talkloom.sources.saved import resume_transcripts

BUCKETS = 16

_RENAMED = f"""WITH base AS ({VIEWS['transcripts'][1]}),
transcripts AS (SELECT id, CASE WHEN id % 40 = 0 THEN 'Same title' ELSE title END AS title, loc, lang, raw_text, corrected_text, summary FROM base),
files AS (SELECT path, content FROM ({_MARKDOWN}) m UNION ALL SELECT path, content FROM ({_JSON}) j UNION ALL SELECT path, content FROM ({_TEXT}) t)"""


@query("export_written", _RENAMED + """
SELECT path, md5(content) AS content_md5, CASE WHEN count(*) OVER (PARTITION BY path) > 1 THEN 'another row has this path' END AS reason FROM files""")
def export_written(spark, sf):
    """Every export of every transcript as a file of its name, read back; rows that share a name are rejected."""
    docs = _finished(spark, sf).withColumn("title", F.when(F.col("id") % 40 == 0, "Same title").otherwise(F.col("title")))
    rows = None
    for export in exports.create_exports({"markdown": True, "text_output": True}, _BY).values():
        part = export(docs).select("path", "content")
        rows = part if rows is None else rows.unionByName(part)
    base = scratch_path(spark, "exports")
    rejected = write_files(rows, base)
    path = F.when(F.contains("path", F.lit("/")), F.col("path")).otherwise(F.concat(F.lit("/"), "path"))  # a file at the top is one of the empty folder
    found = read_files(list_files(spark, base), base).select(path.alias("path"), F.md5("content").alias("content_md5"), F.lit(None).cast("string").alias("reason"))
    return found.unionByName(rejected.select("path", F.md5("content").alias("content_md5"), "reason"))


@query("catalog_written", """SELECT video_id, channel_id, CASE WHEN id % 100 = 7 THEN CASE WHEN id % 2 = 1 THEN 'queued' END WHEN id % 10 = 9 THEN 'pending' ELSE status END AS status,
  CASE WHEN id % 100 = 7 THEN true ELSE is_technical END AS is_technical FROM videos WHERE channel_id <> 3""", ["videos"])
def catalog_written(spark, sf):
    """Videos appended, inserted, overridden by hand and deleted with their channel; each edit rewrites its buckets."""
    videos = views.videos(spark, sf)
    path, schema = scratch_path(spark, "videos"), videos.schema
    write_buckets(videos.filter("id % 10 < 9"), path, "video_id", BUCKETS)

    def held():
        return read_buckets(spark, path, schema, BUCKETS)

    found = videos.filter("id % 10 >= 8")  # some are known
    rewrite_buckets(spark, path, schema, "video_id", BUCKETS, found, lambda old: catalog.insert_videos(old, found))
    by_hand = materialise(held().filter("id % 100 = 7").select("id", "video_id", F.lit(True).alias("is_technical"), F.lit("").alias("classification_reason")), "overrides")
    rewrite_buckets(spark, path, schema, "video_id", BUCKETS, by_hand, lambda old: catalog.manual_override(old, by_hand, F.current_timestamp()))
    doomed = views.channels(spark, sf).filter("id = 3")
    gone = materialise(held().join(doomed.select(F.col("id").alias("channel_id")), "channel_id", "left_semi"), "gone")
    rewrite_buckets(spark, path, schema, "video_id", BUCKETS, gone,
                    lambda old: catalog.delete_channels(views.channels(spark, sf), old, views.runs(spark, sf), doomed)[1])
    return held().select("video_id", "channel_id", "status", "is_technical")


def _saved_outputs(spark, sf):
    """Provider files of every third conversation: an old one, the newest, and one of another provider; some newest ones are broken."""
    w = views.words(spark, sf).filter("transcript_id % 3 = 2")
    word = F.struct(F.lower("punctuated_word").alias("word"), F.col("start_s").alias("start"), F.col("end_s").alias("end"), F.lit(0.5).alias("confidence"),
                    "speaker", "speaker_confidence", "punctuated_word")
    listed = w.groupBy(F.col("transcript_id").alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct("pos", word.alias("w")))).alias("ws"))
    words = F.transform("ws", lambda x: x["w"]).alias("words")
    output = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct(words)).alias("alternatives"))).alias("channels")).alias("results")))
    newest = F.when(F.col("conv_id") % 9 == 8, "{broken").otherwise(output)
    versions = F.array(F.struct(F.lit("deepgram_2024-01-01").alias("name"), F.lit("{}").alias("content")),
                       F.struct(F.lit("deepgram_2024-01-02").alias("name"), newest.alias("content")), F.struct(F.lit("whisper_2024-01-09").alias("name"), F.lit("{}").alias("content")))
    rows = listed.select("conv_id", F.explode(versions).alias("v"))
    base = scratch_path(spark, "provider-output")
    write_files(rows.select(F.concat(_place(), F.lit("/"), F.col("v.name"), F.lit("T000000Z.json")).alias("path"), "v.content"), base)
    return base


@query("resume_finalise", f"""SELECT c.transcript_id, CASE WHEN c.transcript_id % 3 = 2 AND c.transcript_id % 9 <> 8 THEN 'completed' ELSE 'pending' END AS status,
  CASE WHEN c.transcript_id % 9 = 8 THEN 'the file is no JSON' END AS error, r.part_no, r.text
FROM (SELECT DISTINCT conv_id AS transcript_id FROM conversations) c
LEFT JOIN ({_render_sql(True)}) r ON r.transcript_id = c.transcript_id AND c.transcript_id % 3 = 2 AND c.transcript_id % 9 <> 8""", ["words", "repaired", "placed"])
def resume_finalise(spark, sf):
    """Transcripts whose transcription is done go on from their newest saved output; the others wait."""
    base = _saved_outputs(spark, sf)
    conv = views.table(spark, sf, "conversations").select("conv_id").distinct()
    transcripts = conv.select(F.col("conv_id").alias("transcript_id"), _place().alias("folder"))
    state = conv.select(F.col("conv_id").alias("transcript_id"), F.lit("transcription").alias("stage"),
                        F.when(F.col("conv_id") % 3 > 0, "completed").otherwise("pending").alias("status"))
    outputs, status = resume_transcripts(transcripts, state, base, "deepgram")
    words = materialise(words_of(outputs), "resumed-words")
    chapters = views.chapters(spark, sf).join(outputs.select("transcript_id"), "transcript_id", "left_semi")
    return status.join(finalise(words, chapters).transcript(), "transcript_id", "left").select("transcript_id", "status", "error", "part_no", "text")


_FRESH = """SELECT v.* FROM videos v JOIN channels c ON c.id = v.channel_id WHERE v.id % 3 > 0 AND c.is_active AND (c.last_scanned_at IS NULL OR v.published_at > c.last_scanned_at)"""
_GATED = "(duration > 0 AND (duration < 600 OR duration > 3000) OR channel_id % 3 = 0)"
_FIRST_RUN = {
    "videos_discovered": "count(*) FILTER (fresh)", "videos_classified": "count(*) FILTER (s = 'pending')", "n_errors": "count(*) FILTER (false)",
    "videos_approved": f"count(*) FILTER (s = 'pending' AND NOT {_GATED})", "videos_rejected": f"count(*) FILTER (s = 'pending' AND {_GATED})",
    "videos_queued": f"count(*) FILTER (s = 'queued' OR s = 'pending' AND NOT {_GATED})",
}
_RUN_ROWS = " UNION ALL ".join(f"SELECT 'first', '{name}', ({n})::BIGINT FROM held UNION ALL SELECT 'second', '{name}', 0" for name, n in _FIRST_RUN.items())


@query("ingest_written", f"""WITH fresh AS ({_FRESH}), held AS (SELECT *, status AS s, false AS fresh FROM videos WHERE id % 3 = 0
  UNION ALL SELECT *, 'pending', true FROM fresh)
SELECT video_id AS key, CASE WHEN s = 'queued' OR s = 'pending' AND NOT {_GATED} THEN 'transcribed' WHEN s = 'pending' THEN 'skipped' ELSE s END AS name, channel_id::BIGINT AS n FROM held
UNION ALL {_RUN_ROWS}""", ["videos", "channels"])
def ingest_written(spark, sf):
    """Two runs over the same items: the videos as they then are, and the rows of both runs; the second finds nothing."""
    none = F.lit(None)
    videos = views.videos(spark, sf).withColumn("description", F.concat(F.lit("channel="), F.col("channel_id") % 3)).withColumn("tags", none.cast("array<string>"))
    channels = views.channels(spark, sf)
    tables = CatalogTables(spark, scratch_path(spark, "catalog"), videos.schema, channels.schema, BUCKETS)
    create_tables(tables, videos.filter("id % 3 = 0"), channels)
    for run in ("first", "second"):
        run_ingestion(tables, videos.filter("id % 3 > 0"), flag_model, run)
    rows = tables.table("runs").unpivot("run_id", ["videos_discovered", "videos_classified", "videos_approved", "videos_rejected", "videos_queued", "n_errors"], "name", "n")
    held = tables.table("videos").select(F.col("video_id").alias("key"), F.col("status").alias("name"), F.col("channel_id").cast("long").alias("n"))
    return held.unionByName(rows.select(F.col("run_id").alias("key"), "name", "n"))
