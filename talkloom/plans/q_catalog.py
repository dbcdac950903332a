"""Queries over the catalog: reads, joins, keyed changes, queue and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.functions import text as tx
from talkloom.functions.timing import iso_text
from talkloom.operators import catalog, ingest
from talkloom.plans import views
from talkloom.plans.q_sources import DOCUMENT, _finished
from talkloom.plans.registry import query
from talkloom.scratch import scratch_path
from talkloom.sinks import exports
from talkloom.sinks.tables import append_table
from talkloom.sources.tables import conform, scan_table

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({0}) % 1000000 = 0 THEN '' ELSE strftime({0}, '.%f') END || '+00:00'"


def iso_sql(col):
    return _ISO.format(col)


def _long(*cols):
    return [F.col(c).cast("long").alias(c) for c in cols]


def _iso(*cols):
    return [iso_text(F.col(c)).alias(c) for c in cols]


@query(
    "scan_catalog",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(id) AS n_ids FROM {t}"
                       for t in ("channels", "videos", "runs", "transcripts")),
    ["channels", "videos", "runs", "transcripts"],
)
def scan_catalog(spark, sf):
    """Each catalog table written in its schema and scanned back."""
    out = None
    for name in ("channels", "videos", "runs", "transcripts"):
        path = scratch_path(spark, name)
        append_table(getattr(views, name)(spark, sf), name, path)
        counted = scan_table(spark, name, path).agg(F.count("*").alias("n_rows"), F.count("id").alias("n_ids"))
        counted = counted.select(F.lit(name).alias("table_name"), "n_rows", "n_ids")
        out = counted if out is None else out.unionByName(counted)
    return out


@query(
    "lookup_by_key",
    f"""(SELECT 'video' AS kind, video_id AS key, title, {iso_sql('published_at')} AS at FROM videos WHERE video_id = 'v5' ORDER BY id LIMIT 1)
UNION ALL (SELECT 'channel', channel_id, channel_name, {iso_sql('last_scanned_at')} FROM channels WHERE channel_id = 'UC4' ORDER BY id LIMIT 1)
UNION ALL (SELECT 'channel_id', channel_id, channel_name, {iso_sql('last_scanned_at')} FROM channels WHERE id = 7 ORDER BY id LIMIT 1)
UNION ALL (SELECT 'transcript', loc, title, NULL FROM transcripts WHERE title = 'Doc_0 fr' AND loc = (SELECT min(loc) FROM transcripts WHERE title = 'Doc_0 fr') ORDER BY id LIMIT 1)
UNION ALL (SELECT 'transcript_id', loc, title, NULL FROM transcripts WHERE id = 11 ORDER BY id LIMIT 1)""",
    ["videos", "channels", "transcripts"],
)
def lookup_by_key(spark, sf):
    v, c, t = views.videos(spark, sf), views.channels(spark, sf), views.transcripts(spark, sf)
    loc = t.filter("title = 'Doc_0 fr'").agg(F.min("loc")).scalar()
    none = F.lit(None).cast("string").alias("at")

    def row(kind, df, key, title, at):
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(title).alias("title"), at)

    def seen(col):
        return iso_text(F.col(col)).alias("at")

    parts = [
        row("video", catalog.lookup(v, video_id="v5"), "video_id", "title", seen("published_at")),
        row("channel", catalog.lookup(c, channel_id="UC4"), "channel_id", "channel_name", seen("last_scanned_at")),
        row("channel_id", catalog.lookup(c, id=7), "channel_id", "channel_name", seen("last_scanned_at")),
        row("transcript", catalog.lookup(t.filter(F.col("loc") == loc), title="Doc_0 fr"), "loc", "title", none),
        row("transcript_id", catalog.lookup(t, id=11), "loc", "title", none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("channels_projection", f"""SELECT id::VARCHAR AS id, channel_id, channel_name, category, priority::BIGINT AS priority, is_active,
  {iso_sql('last_scanned_at')} AS last_scanned_at FROM channels""", ["channels"])
def channels_projection(spark, sf):
    return catalog.channel_listing(views.channels(spark, sf)).withColumn("priority", F.col("priority").cast("long"))


@query(
    "runs_projection",
    f"""SELECT r.id::VARCHAR AS id, run_type, r.channel_id::VARCHAR AS channel_id, videos_discovered, {iso_sql('started_at')} AS started_at,
  {iso_sql('completed_at')} AS completed_at, channel_name FROM runs r LEFT JOIN channels c ON c.id = r.channel_id ORDER BY r.started_at DESC, r.id LIMIT 50""",
    ["runs", "channels"],
)
def runs_projection(spark, sf):
    rows = catalog.run_listing(views.runs(spark, sf), views.channels(spark, sf))
    return rows.withColumn("channel_name", F.col("youtube_channels.channel_name")).drop("youtube_channels")


@query("transcripts_projection", """SELECT id::VARCHAR AS id, title, loc, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_tags, 0::BIGINT AS n_topics,
  md5(raw_text) AS raw_md5, summary FROM transcripts""", ["transcripts"])
def transcripts_projection(spark, sf):
    rows = views.transcripts(spark, sf).withColumn("tags", F.when(F.col("id") % 2 == 0, F.array("lang"))).withColumn(
        "topics", F.lit(None).cast("array<string>"))
    return catalog.transcript_listing(rows).select(
        "id", "title", "loc", F.size("tags").cast("long").alias("n_tags"), F.size("topics").cast("long").alias("n_topics"),
        F.md5("raw_text").alias("raw_md5"), "summary")


# The test transcripts have no creation time; a number spread over the ids stands in for it.
_CREATED = "id * 7919 % 1000003"


def _dated_transcripts(spark, sf):
    return views.transcripts(spark, sf).withColumn("created_at", F.expr(_CREATED))


def _page_sql(condition, offset, text):
    return f"""SELECT id, title, loc, length({text}) AS n_chars FROM transcripts WHERE {condition}
ORDER BY {_CREATED} DESC, id LIMIT 100 OFFSET {offset}"""


def _page(df, offset, text):
    return catalog.page(df, "created_at", 100, offset).select("id", "title", "loc", F.length(text).cast("long").alias("n_chars"))


@query("transcripts_page", _page_sql("true", 30, "raw_text"), ["transcripts"])
def transcripts_page(spark, sf):
    return _page(_dated_transcripts(spark, sf), 30, "raw_text")


@query("corrected_page", _page_sql("corrected_text IS NOT NULL", 10, "corrected_text"), ["transcripts"])
def corrected_page(spark, sf):
    return _page(_dated_transcripts(spark, sf).filter("corrected_text IS NOT NULL"), 10, "corrected_text")


@query("summaries_page", _page_sql("summary IS NOT NULL", 0, "summary"), ["transcripts"])
def summaries_page(spark, sf):
    return _page(_dated_transcripts(spark, sf).filter("summary IS NOT NULL"), 0, "summary")


_STATUS = "CASE id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'in_progress' ELSE 'failed' END"


def _with_status(spark, sf):
    return views.transcripts(spark, sf).withColumn("status", F.expr(_STATUS))


@query("corrected_view", f"""SELECT title, loc, {_STATUS} AS status, md5(corrected_text) AS text_md5
FROM transcripts WHERE corrected_text <> ''""", ["transcripts"])
def corrected_view(spark, sf):
    rows = catalog.with_text(_with_status(spark, sf), "corrected_text")
    return rows.select("title", "loc", "status", F.md5("corrected_text").alias("text_md5"))


@query("summary_view", f"""SELECT title, loc, {_STATUS} AS status, summary FROM transcripts WHERE summary <> ''""", ["transcripts"])
def summary_view(spark, sf):
    return catalog.with_text(_with_status(spark, sf), "summary")


@query("transcripts_by_loc", """SELECT id, title, loc FROM transcripts WHERE loc = (SELECT min(loc) FROM transcripts)""", ["transcripts"])
def transcripts_by_loc(spark, sf):
    t = views.transcripts(spark, sf)
    loc = t.agg(F.min("loc")).scalar()
    return catalog.where(t, loc=loc).select("id", "title", "loc")


@query("active_channels", """SELECT id, channel_name, priority::BIGINT AS priority FROM channels WHERE is_active""", ["channels"])
def active_channels(spark, sf):
    return catalog.active_channels(views.channels(spark, sf)).select("id", "channel_name", *_long("priority"))


@query("channels_sorted", "SELECT id, channel_id, channel_name, category FROM channels", ["channels"])
def channels_sorted(spark, sf):
    return views.channels(spark, sf).orderBy("channel_name").select("id", "channel_id", "channel_name", "category")


_VIDEO_COLS = f"id, video_id, channel_id, title, {iso_sql('published_at')} AS published_at, status, is_technical"


def _videos_out(df):
    return df.select("id", "video_id", "channel_id", "title", *_iso("published_at"), "status", "is_technical")


@query("videos_by_status", f"SELECT {_VIDEO_COLS} FROM videos WHERE status = 'pending' ORDER BY videos.published_at DESC, id LIMIT 500", ["videos"])
def videos_by_status(spark, sf):
    pending = catalog.where(views.videos(spark, sf), status="pending")
    return _videos_out(catalog.page(pending, "published_at", 500))


@query("videos_filtered", f"""SELECT {_VIDEO_COLS} FROM videos WHERE status = 'queued' AND is_technical AND channel_id = 3
ORDER BY videos.published_at DESC, id LIMIT 100""", ["videos"])
def videos_filtered(spark, sf):
    rows = catalog.where(views.videos(spark, sf), status="queued", is_technical=True, channel_id=3)
    return _videos_out(catalog.page(rows, "published_at", 100))


@query(
    "videos_projection",
    f"""SELECT v.id::VARCHAR AS id, video_id, v.channel_id::VARCHAR AS channel_id, title, {iso_sql('v.published_at')} AS published_at,
  duration::BIGINT AS duration, 0::BIGINT AS n_tags, is_technical, status, channel_name, category
FROM videos v LEFT JOIN channels c ON c.id = v.channel_id""",
    ["videos", "channels"],
)
def videos_projection(spark, sf):
    rows = catalog.video_listing(views.videos(spark, sf), views.channels(spark, sf))
    return rows.select(
        "id", "video_id", "channel_id", "title", "published_at", *_long("duration"),
        F.size("tags").cast("long").alias("n_tags"), "is_technical", "status",
        F.col("youtube_channels.channel_name").alias("channel_name"),
        F.col("youtube_channels.category").alias("category"),
    )


@query("videos_with_channel", """SELECT v.id, video_id, v.channel_id, channel_name, category
FROM videos v LEFT JOIN channels c ON c.id = v.channel_id""", ["videos", "channels"])
def videos_with_channel(spark, sf):
    rows = catalog.with_channel(views.videos(spark, sf), views.channels(spark, sf), "channel_name", "category")
    return rows.select("id", "video_id", "channel_id", "channel_name", "category")


@query(
    "runs_with_channel",
    f"""SELECT r.id::BIGINT AS id, run_type, r.channel_id::BIGINT AS channel_id, videos_discovered, {iso_sql('started_at')} AS started_at,
  {iso_sql('completed_at')} AS completed_at, channel_name
FROM runs r LEFT JOIN channels c ON c.id = r.channel_id ORDER BY r.started_at DESC, r.id LIMIT 50""",
    ["runs", "channels"],
)
def runs_with_channel(spark, sf):
    latest = catalog.page(views.runs(spark, sf), "started_at", 50)
    rows = catalog.with_channel(latest, views.channels(spark, sf), "channel_name")
    return rows.select(*_long("id"), "run_type", "channel_id", "videos_discovered", *_iso("started_at", "completed_at"), "channel_name")


# Discovered ids: every third known video and as many new ones.
_DISCOVERED = """SELECT CASE WHEN event_id % 2 = 0 THEN concat('v', event_id) ELSE concat('n', event_id) END AS video_id
FROM events WHERE event_id % 3 = 0"""


def _discovered(spark, sf):
    e = views.table(spark, sf, "events").filter("event_id % 3 = 0")
    prefix = F.when(F.col("event_id") % 2 == 0, "v").otherwise("n")
    return e.select(F.concat(prefix, F.col("event_id")).alias("video_id"))


@query("existing_ids", f"SELECT d.video_id FROM ({_DISCOVERED}) d WHERE d.video_id IN (SELECT video_id FROM videos)", ["videos"])
def existing_ids(spark, sf):
    return catalog.known(_discovered(spark, sf), views.videos(spark, sf))


@query("new_ids", f"SELECT d.video_id FROM ({_DISCOVERED}) d WHERE d.video_id NOT IN (SELECT video_id FROM videos)", ["videos"])
def new_ids(spark, sf):
    return catalog.unknown(_discovered(spark, sf), views.videos(spark, sf))


@query("hwm_filter", """SELECT v.id, v.channel_id FROM videos v JOIN channels c ON c.id = v.channel_id
WHERE c.last_scanned_at IS NULL OR v.published_at > c.last_scanned_at""", ["videos", "channels"])
def hwm_filter(spark, sf):
    return catalog.after_high_water(views.videos(spark, sf), views.channels(spark, sf)).select("id", "channel_id")


@query("newest_per_channel", """SELECT id, channel_id, rank FROM (SELECT id, channel_id,
  row_number() OVER (PARTITION BY channel_id ORDER BY published_at DESC, id) AS rank FROM videos) r WHERE rank <= 50""", ["videos"])
def newest_per_channel(spark, sf):
    return catalog.newest_per_channel(views.videos(spark, sf)).select("id", "channel_id", *_long("rank"))


@query("id_batches", """SELECT channel_id, (n - 1) // 50 AS batch_no, string_agg(video_id, ',' ORDER BY n) AS ids, count(*) AS n_ids
FROM (SELECT channel_id, video_id, row_number() OVER (PARTITION BY channel_id ORDER BY published_at DESC, id) AS n FROM videos) r
GROUP BY 1, 2""", ["videos"])
def id_batches(spark, sf):
    return catalog.id_batches(views.videos(spark, sf))


# ---- keyed changes


@query(
    "apply_updates",
    """SELECT c.id, c.channel_name || CASE WHEN c.id % 4 = 0 THEN ' (new)' ELSE '' END AS channel_name,
  CASE WHEN c.id % 4 = 0 AND c.id % 8 = 0 THEN NULL ELSE category END AS category,
  CASE WHEN c.id % 4 = 0 AND c.id % 3 = 0 THEN 9 ELSE priority END::BIGINT AS priority FROM channels c""",
    ["channels"],
)
def apply_updates(spark, sf):
    c = views.channels(spark, sf)
    empty = F.array().cast("array<string>")
    updates = c.filter("id % 4 = 0").select(
        "id",
        F.concat("channel_name", F.lit(" (new)")).alias("channel_name"),
        F.lit(None).cast("string").alias("category"),
        F.lit(9).alias("priority"),
        F.concat(
            F.array(F.lit("channel_name")),
            F.when(F.col("id") % 8 == 0, F.array(F.lit("category"))).otherwise(empty),
            F.when(F.col("id") % 3 == 0, F.array(F.lit("priority"))).otherwise(empty),
        ).alias("supplied"),
    )
    out = catalog.apply_updates(c, updates, "id", ["channel_name", "category", "priority"], supplied="supplied")
    return out.select("id", "channel_name", "category", *_long("priority"))


@query(
    "manual_override",
    """SELECT id, CASE WHEN id % 10 = 0 THEN id % 20 = 0 ELSE is_technical END AS is_technical,
  CASE WHEN id % 10 = 0 THEN CASE WHEN id % 30 = 0 THEN 'checked' ELSE 'Manual override' END END AS classification_reason,
  CASE WHEN id % 10 = 0 THEN 1.0::DOUBLE END AS classification_confidence,
  CASE WHEN id % 10 = 0 THEN CASE WHEN id % 20 = 0 THEN 'queued' ELSE 'skipped' END ELSE status END AS status,
  CASE WHEN id % 10 = 0 THEN '2024-02-01T00:00:00+00:00' END AS classified_at FROM videos""",
    ["videos"],
)
def manual_override(spark, sf):
    v = views.videos(spark, sf)
    none = F.lit(None)
    full = v.select(
        "*", none.cast("string").alias("classification_reason"),
        none.cast("double").alias("classification_confidence"), none.cast("timestamp").alias("classified_at"),
    )
    overrides = v.filter("id % 10 = 0").select(
        "id", (F.col("id") % 20 == 0).alias("is_technical"),
        F.when(F.col("id") % 30 == 0, "checked").alias("classification_reason"),
    )
    out = catalog.manual_override(full, overrides, F.lit("2024-02-01").cast("timestamp"))
    return out.select("id", "is_technical", "classification_reason", "classification_confidence", "status", *_iso("classified_at"))


def _deleted(spark, sf):
    c = views.channels(spark, sf)
    return catalog.delete_channels(c, views.videos(spark, sf), views.runs(spark, sf), c.filter("id % 7 = 1").select("id"))


@query("delete_cascade_videos", "SELECT id, channel_id FROM videos WHERE channel_id % 7 <> 1", ["videos"])
def delete_cascade_videos(spark, sf):
    return _deleted(spark, sf)[1].select("id", "channel_id")


@query("delete_channels", "SELECT id, channel_name FROM channels WHERE id % 7 <> 1", ["channels"])
def delete_channels(spark, sf):
    return _deleted(spark, sf)[0].select("id", "channel_name")


@query(
    "delete_setnull_runs",
    """SELECT id::BIGINT AS id, CASE WHEN channel_id % 7 = 1 AND channel_id IN (SELECT id FROM channels) THEN NULL
  ELSE channel_id END::BIGINT AS channel_id FROM runs""",
    ["runs", "channels"],
)
def delete_setnull_runs(spark, sf):
    return _deleted(spark, sf)[2].select(*_long("id"), "channel_id")


@query(
    "add_channels",
    """SELECT id, channel_id, channel_name, category, priority::BIGINT AS priority, is_active FROM channels
UNION ALL SELECT min(c_custkey) + 1000000, concat('UC', c_custkey // 2), min_by(c_name, c_custkey), NULL,
  CASE WHEN min(c_custkey) % 5 > 0 THEN min(c_custkey) % 5 ELSE 3 END::BIGINT, true
FROM customer WHERE c_custkey // 2 NOT IN (SELECT s_suppkey FROM supplier) GROUP BY c_custkey // 2""",
    ["channels"],
)
def add_channels(spark, sf):
    key = F.col("c_custkey")
    new = views.table(spark, sf, "customer").select(
        (key + 1000000).alias("id"),
        F.concat(F.lit("UC"), F.floor(key / 2)).alias("channel_id"),
        F.col("c_name").alias("channel_name"),
        F.lit(None).cast("string").alias("category"),
        F.when(key % 5 > 0, (key % 5).cast("int")).alias("priority"),
        F.lit(None).cast("boolean").alias("is_active"),
        F.lit(None).cast("timestamp").alias("last_scanned_at"),
    )
    out = catalog.add_channels(views.channels(spark, sf), new)
    return out.select("id", "channel_id", "channel_name", "category", *_long("priority"), "is_active")


@query(
    "insert_videos",
    """SELECT id, video_id, channel_id, title, status FROM videos
UNION ALL SELECT min(event_id) + 10000000, concat('n', event_id // 2), min_by(user_id, event_id),
  min_by(event_type, event_id), 'pending'
FROM events WHERE event_id % 3 = 0 GROUP BY event_id // 2""",
    ["videos"],
)
def insert_videos(spark, sf):
    v = views.videos(spark, sf)
    key = F.col("event_id")
    found = views.table(spark, sf, "events").filter("event_id % 3 = 0").select(
        (key + 10000000).alias("id"), F.concat(F.lit("n"), F.floor(key / 2)).alias("video_id"),
        F.col("user_id").alias("channel_id"), F.col("event_type").alias("title"),
        F.col("ts").cast("timestamp").alias("published_at"), F.lit(0).alias("duration"),
        F.lit("").alias("status"), F.lit(None).cast("boolean").alias("is_technical"),
    )
    again = v.filter("id % 9 = 0")  # already known ids must not come back
    return catalog.insert_videos(v, found.unionByName(again)).select("id", "video_id", "channel_id", "title", "status")


@query(
    "save_projection",
    f"""SELECT title, loc, '2024-01-01' AS event_date, 0::BIGINT AS n_speakers, 1::BIGINT AS n_tags, 0::BIGINT AS n_topics,
  md5(raw_text) AS raw_md5, md5(corrected_text) AS corrected_md5, summary, concat('media/', id) AS media_url, {_STATUS} AS status
FROM transcripts""",
    ["transcripts"],
)
def save_projection(spark, sf):
    none = F.lit(None).cast("array<string>")
    finished = _with_status(spark, sf).select(
        "title", "loc", F.lit("2024-01-01").cast("date").alias("event_date"), none.alias("speakers"),
        F.array("lang").alias("tags"), none.alias("categories"), "raw_text", "corrected_text", "summary",
        F.concat(F.lit("media/"), F.col("id")).alias("source_file"), "status",
        F.lit(None).cast("string").alias("conference"), none.alias("topics"), F.lit("").alias("channel_name"),
    )
    return catalog.save_projection(finished).select(
        "title", "loc", "event_date", F.size("speakers").cast("long").alias("n_speakers"),
        F.size("tags").cast("long").alias("n_tags"), F.size("topics").cast("long").alias("n_topics"),
        F.md5("raw_text").alias("raw_md5"), F.md5("corrected_text").alias("corrected_md5"), "summary",
        "media_url", "status",
    )


# ---- queue


_COVERED = "SELECT *, CASE page_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'none' END AS transcription_coverage FROM sources"


@query("sources_by_coverage", f"""SELECT page_id, loc, source_file FROM ({_COVERED}) s
WHERE loc = (SELECT min(loc) FROM sources) AND transcription_coverage = 'full'""", ["sources"])
def sources_by_coverage(spark, sf):
    s = views.sources(spark, sf)
    coverage = F.when(F.col("page_id") % 3 == 0, "full").when(F.col("page_id") % 3 == 1, "none")
    first = s.agg(F.min("loc")).scalar()
    rows = catalog.sources_of(s.withColumn("transcription_coverage", coverage), coverage="full")
    return rows.filter(F.col("loc") == first).select("page_id", "loc", "source_file")


_ENTRIES = """SELECT page_id, page_id // 50 AS list_id, coalesce(media, source_file) AS media,
  DATE '2024-01-01' + CAST(page_id % 60 AS INT) AS date,
  CASE WHEN page_id // 50 % 3 > 0 THEN DATE '2024-01-20' END AS cutoff FROM sources"""


def _entries(spark, sf):
    page = F.col("page_id")
    lists = F.floor(page / 50)
    return views.sources(spark, sf).select(
        "page_id", lists.alias("list_id"), F.coalesce("media", "source_file").alias("media"),
        F.date_add(F.lit("2024-01-01").cast("date"), (page % 60).cast("int")).alias("date"),
        F.when(lists % 3 > 0, F.lit("2024-01-20").cast("date")).alias("cutoff"),
    )


def _excluded(spark, sf):
    return views.table(spark, sf, "pages").filter("page_id % 7 = 0").select(
        F.regexp_replace("url", "[?].*$", "").alias("media"))


_TAKEN = """SELECT media FROM existing_media WHERE media IS NOT NULL
UNION SELECT regexp_replace(url, '[?].*$', '') FROM pages WHERE page_id % 7 = 0"""


@query("excluded_union", f"SELECT media FROM ({_TAKEN}) t", ["existing_media"])
def excluded_union(spark, sf):
    return catalog.union_media(views.existing_media(spark, sf), _excluded(spark, sf))


@query("cutoff_filter", f"SELECT page_id, date FROM ({_ENTRIES}) e WHERE date > DATE '2024-01-20'", ["sources"])
def cutoff_filter(spark, sf):
    return catalog.after_cutoff(_entries(spark, sf), F.lit("2024-01-20").cast("date")).select("page_id", "date")


_FLAGGED = f"""SELECT e.page_id, e.list_id, e.media, (t.media IS NOT NULL OR NOT (e.cutoff IS NULL OR e.date > e.cutoff)) AS exist
FROM ({_ENTRIES}) e LEFT JOIN ({_TAKEN}) t ON t.media = e.media"""


def _flagged(spark, sf):
    taken = catalog.union_media(views.existing_media(spark, sf), _excluded(spark, sf))
    return catalog.flag_existing(_entries(spark, sf), taken, F.col("cutoff"))


@query("added_exist_split", _FLAGGED, ["sources", "existing_media"])
def added_exist_split(spark, sf):
    return _flagged(spark, sf).select("page_id", "list_id", "media", "exist")


@query("added_exist_counts", f"""SELECT list_id, count(*) FILTER (NOT exist) AS n_added, count(*) FILTER (exist) AS n_exist
FROM ({_FLAGGED}) f GROUP BY list_id""", ["sources", "existing_media"])
def added_exist_counts(spark, sf):
    return catalog.added_exist_counts(_flagged(spark, sf), "list_id")


@query(
    "cache_enrich",
    """WITH cached AS (SELECT page_id, loc, source_file, media, 'cached ' || title AS title, 's' || page_id AS summary
  FROM sources WHERE page_id % 2 = 0),
keyed AS (SELECT loc, source_file AS k, title, summary, page_id FROM cached UNION ALL SELECT loc, media, title, summary, page_id FROM cached WHERE media IS NOT NULL),
best AS (SELECT loc, k, max_by(title, page_id) AS title, max_by(summary, page_id) AS summary FROM keyed GROUP BY loc, k),
req AS (SELECT page_id, loc, CASE WHEN page_id % 3 = 0 AND media IS NOT NULL THEN media ELSE source_file END AS source_file,
  CASE WHEN page_id % 4 > 0 THEN title ELSE '' END AS title FROM sources)
SELECT r.page_id, r.loc, r.source_file, CASE WHEN r.title = '' THEN b.title ELSE r.title END AS title, b.summary, b.k IS NOT NULL AS cache_hit
FROM req r LEFT JOIN best b ON b.loc = r.loc AND b.k = r.source_file""",
    ["sources"],
)
def cache_enrich(spark, sf):
    s = views.sources(spark, sf)
    cached = s.filter("page_id % 2 = 0").select(
        "page_id", "loc", "source_file", "media", F.concat(F.lit("cached "), F.col("title")).alias("title"),
        F.concat(F.lit("s"), F.col("page_id")).alias("summary"),
    )
    requests = s.select(
        "page_id", "loc",
        F.when((F.col("page_id") % 3 == 0) & F.col("media").isNotNull(), F.col("media")).otherwise(F.col("source_file")).alias("source_file"),
        F.when(F.col("page_id") % 4 > 0, F.col("title")).otherwise("").alias("title"),
        F.lit(None).cast("string").alias("summary"),
    )
    out = catalog.enrich_from_cache(requests, cached, ["title", "summary"], "page_id")
    # a blank title without a cache entry stays as it was, which is null here
    return out.select("page_id", "loc", "source_file", "title", "summary", "cache_hit")


# The queue and requests come from documents: languages as places, first words as titles.
_QUEUED = "SELECT doc_id AS seq, lang AS loc, split_part(text, ' ', 1) AS title FROM documents WHERE doc_id % 2 = 0"
_BATCH = "SELECT doc_id AS seq, lang AS loc, CASE WHEN doc_id % 11 > 0 THEN split_part(text, ' ', 1) END AS title FROM documents WHERE doc_id % 2 = 1"


def _queue_and_batch(spark, sf):
    d = views.table(spark, sf, "documents")
    title = F.split_part("text", F.lit(" "), F.lit(1))
    cols = [F.col("doc_id").alias("seq"), F.col("lang").alias("loc")]
    queue = d.filter("doc_id % 2 = 0").select(*cols, title.alias("title"))
    batch = d.filter("doc_id % 2 = 1").select(*cols, F.when(F.col("doc_id") % 11 > 0, title).alias("title"))
    return queue, batch


@query("queue_duplicates", f"""WITH q AS ({_QUEUED}), b AS ({_BATCH})
SELECT seq, loc, title FROM (SELECT *, row_number() OVER (PARTITION BY loc, title ORDER BY seq) AS n FROM b WHERE title IS NOT NULL) r
WHERE n > 1 OR (loc, title) IN (SELECT (loc, title) FROM q)""")
def queue_duplicates(spark, sf):
    queue, batch = _queue_and_batch(spark, sf)
    return catalog.queue_duplicates(batch, queue, "seq")


_REMOVAL = f"""WITH q AS (SELECT *, row_number() OVER (PARTITION BY loc, title ORDER BY seq) AS n FROM ({_QUEUED}) x),
b AS (SELECT *, row_number() OVER (PARTITION BY loc, title ORDER BY seq) AS n FROM ({_BATCH}) y WHERE title IS NOT NULL)
"""


def _removal(spark, sf):
    queue, batch = _queue_and_batch(spark, sf)
    return catalog.queue_remove(queue, batch.filter("title IS NOT NULL"), "seq")


@query("queue_remove", _REMOVAL + """SELECT q.seq, q.loc, q.title FROM q
LEFT JOIN b ON b.loc = q.loc AND b.title = q.title AND b.n = q.n WHERE b.seq IS NULL""")
def queue_remove(spark, sf):
    return _removal(spark, sf)[0]


@query("queue_remove_missing", _REMOVAL + """SELECT b.seq, b.loc, b.title FROM b
LEFT JOIN q ON b.loc = q.loc AND b.title = q.title AND b.n = q.n WHERE q.seq IS NULL""")
def queue_remove_missing(spark, sf):
    return _removal(spark, sf)[1]


# ---- run summaries


_OUTCOMES = """SELECT day(published_at)::BIGINT AS run_id, is_technical,
  CASE WHEN duration % 97 = 0 THEN concat('could not classify ', title) END AS error FROM videos WHERE status <> 'pending'"""


def _outcomes(spark, sf):
    v = views.videos(spark, sf).filter("status <> 'pending'")
    return v.select(
        F.dayofmonth("published_at").cast("long").alias("run_id"), "is_technical",
        F.when(F.col("duration") % 97 == 0, F.concat(F.lit("could not classify "), F.col("title"))).alias("error"),
    )


_SUMMARY = f"""SELECT run_id, count(*) FILTER (error IS NULL) AS videos_classified,
  count(*) FILTER (error IS NULL AND is_technical) AS videos_approved,
  count(*) FILTER (error IS NULL AND NOT coalesce(is_technical, false)) AS videos_rejected,
  count(error) AS n_errors FROM ({_OUTCOMES}) o GROUP BY run_id"""


@query("run_summary", _SUMMARY, ["videos"])
def run_summary(spark, sf):
    return catalog.run_summary(_outcomes(spark, sf))


@query("scan_summary", f"""SELECT run_id, count(*) FILTER (error IS NULL) AS videos_discovered, count(error) AS n_errors FROM ({_OUTCOMES}) o GROUP BY run_id""", ["videos"])
def scan_summary(spark, sf):
    return catalog.scan_summary(_outcomes(spark, sf))


@query("run_errors", f"SELECT run_id, error FROM ({_OUTCOMES}) o WHERE error IS NOT NULL", ["videos"])
def run_errors(spark, sf):
    return catalog.run_errors(_outcomes(spark, sf))


@query(
    "ingest_rollup",
    f"""SELECT (SELECT count(*) FROM videos) AS videos_discovered, sum(videos_classified)::BIGINT AS videos_classified,
  sum(videos_approved)::BIGINT AS videos_approved, sum(videos_rejected)::BIGINT AS videos_rejected,
  (SELECT count(*) FROM videos WHERE status = 'queued') AS videos_queued, sum(n_errors)::BIGINT AS n_errors FROM ({_SUMMARY}) s""",
    ["videos"],
)
def ingest_rollup(spark, sf):
    """Scan, classification and submission of all runs as one row."""
    return ingest.rollup(*_steps(spark, sf))


def _steps(spark, sf):
    v, none = views.videos(spark, sf), F.lit(None).cast("string").alias("error")
    return v.select(none), _outcomes(spark, sf), catalog.where(v, status="queued").select(none)


@query("ingest_errors", f"SELECT 'classify' AS step, error FROM ({_OUTCOMES}) o WHERE error IS NOT NULL", ["videos"])
def ingest_errors(spark, sf):
    return ingest.errors(*_steps(spark, sf))


@query(
    "batch_status",
    """SELECT lang, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'completed') THEN 'completed'
  ELSE 'in_progress' END AS status FROM (SELECT lang, CASE WHEN lang = (SELECT min(lang) FROM transcripts) THEN 'completed'
  WHEN lang = (SELECT max(lang) FROM transcripts) AND id % 3 = 0 THEN 'failed' ELSE 'in_progress' END AS status FROM transcripts) t GROUP BY lang""",
    ["transcripts"],
)
def batch_status(spark, sf):
    t = views.transcripts(spark, sf)
    low, high = t.agg(F.min("lang")).scalar(), t.agg(F.max("lang")).scalar()
    status = (
        F.when(F.col("lang") == low, "completed")
        .when((F.col("lang") == high) & (F.col("id") % 3 == 0), "failed")
        .otherwise("in_progress")
    )
    return catalog.batch_status(t.withColumn("status", status), "lang")


@query(
    "queue_view",
    f"""SELECT t.id, '{{"title":"' || t.title || '","loc":"' || t.loc || '","status":"' || {_STATUS.replace('id', 't.id')} || '"}}' AS entry, d.document
FROM transcripts t JOIN ({DOCUMENT}) d ON d.id = t.id""",
    ["transcripts"],
)
def queue_view(spark, sf):
    """The queue's entries, and the whole document of each source."""
    rows = _finished(spark, sf).withColumn("status", F.expr(_STATUS))
    return rows.select("id", F.to_json(F.struct("title", "loc", "status")).alias("entry"), exports.source_document(youtube=False).alias("document"))


@query(
    "source_kind",
    """WITH s AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN media || '.MP3' WHEN 1 THEN media || '/feed.rss' WHEN 2 THEN media || '.xml'
    WHEN 3 THEN media || '.webm' WHEN 4 THEN media || '.M4a' WHEN 5 THEN media || '/FEED.RSS' ELSE source_file END AS f FROM sources)
SELECT page_id, CASE WHEN regexp_matches(lower(f), '[.](mp3|wav|m4a|aac)$') THEN 'audio' WHEN regexp_matches(f, '(rss|[.]xml)$') THEN 'rss'
  WHEN page_id % 16 = 6 THEN 'known_video' WHEN regexp_matches(lower(f), '[.](mp4|webm|mov)$') THEN 'remote_video' ELSE 'lookup' END AS kind FROM s""",
    ["sources"],
)
def source_kind(spark, sf):
    n, media = F.col("page_id") % 8, F.col("media")
    name = F.col("source_file")
    for i, suffix in ((0, ".MP3"), (1, "/feed.rss"), (2, ".xml"), (3, ".webm"), (4, ".M4a"), (5, "/FEED.RSS")):
        name = F.when(n == i, F.concat(media, F.lit(suffix))).otherwise(name)
    rows = views.sources(spark, sf).select("page_id", name.alias("f"))
    return rows.select("page_id", tx.source_kind(F.col("f"), F.col("page_id") % 16 == 6).alias("kind"))
