"""Queries over documents read from files and JSON columns, stage state, exports and providers.

Input documents are derived from the given tables: written out where the operator reads files, built
as a column where it parses one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.operators import stages
from talkloom.plans import views
from talkloom.plans.registry import query
from talkloom.plans.q_text import slug_sql
from talkloom.scratch import scratch_path
from talkloom.sinks import exports
from talkloom.sinks.files import data_path, output_paths
from talkloom.sinks.named import write_files
from talkloom.sources import documents, providers


def _json_text(c):
    """A JSON string literal of a text column."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), '(?s)\\A\\{"v":(.*)\\}\\z', 1)


# ---- source lists


@query("source_defaults", """SELECT source_file, CASE WHEN page_id % 4 = 0 THEN 'no-title' ELSE title END AS title, loc,
  CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_tags, 0::BIGINT AS n_speakers, 1::BIGINT AS n_chapters, 2.5::DOUBLE AS chapter_start,
  CASE WHEN page_id % 5 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(page_id % 60 AS INT) END AS date, NULL::VARCHAR AS reason
FROM sources WHERE page_id % 17 <> 0 AND page_id % 19 <> 1
UNION ALL SELECT CASE WHEN page_id % 17 = 0 THEN NULL ELSE source_file END, CASE WHEN page_id % 4 = 0 THEN 'no-title' ELSE title END, loc, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END, 0, 1, 2.5,
  NULL, CASE WHEN page_id % 17 = 0 THEN 'source_file is required' ELSE 'date does not match yyyy-MM-dd' END
FROM sources WHERE page_id % 17 = 0 OR page_id % 19 = 1""", ["sources"])
def source_defaults(spark, sf):
    page = F.col("page_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (page % 60).cast("int")).cast("string")
    day = F.when(page % 19 == 1, "01/02/2024").when(page % 5 != 0, day)
    one = F.to_json(F.struct(
        F.when(page % 17 != 0, F.col("source_file")).alias("source_file"), F.when(page % 4 != 0, F.col("title")).alias("title"),
        "loc", F.when(page % 2 == 0, F.array(F.lit("tag"))).alias("tags"),
        F.array(F.array(F.lit("0"), F.lit("2.5"), F.lit("Intro"))).alias("chapters"), day.alias("date")))
    s = views.sources(spark, sf).select("page_id", one.alias("j"))
    single = s.filter("page_id % 10 = 9").select(F.concat(F.lit("single/"), page, F.lit(".json")).alias("path"), F.col("j").alias("content"))
    lists = s.filter("page_id % 10 <> 9").groupBy(F.floor(page / 50).alias("n")).agg(F.collect_list("j").alias("js")).select(
        F.concat(F.lit("lists/"), F.col("n"), F.lit(".json")).alias("path"), F.concat(F.lit("["), F.array_join("js", ",\n"), F.lit("]")).alias("content"))
    base = scratch_path(spark, "lists")
    write_files(single.unionByName(lists), base)
    accepted, rejected = documents.read_source_list(spark, base)

    def shown(df, day, reason):
        return df.select("source_file", "title", "loc", F.size("tags").cast("long").alias("n_tags"),
                         F.size("speakers").cast("long").alias("n_speakers"), F.size("chapters").cast("long").alias("n_chapters"),
                         F.col("chapters")[0]["start"].alias("chapter_start"), day.alias("date"), reason.alias("reason"))

    return shown(accepted, F.col("date"), F.lit(None).cast("string")).unionByName(
        shown(rejected, F.lit(None).cast("date"), F.col("reason")))


@query("status_flatten", """SELECT 'media' AS kind, url AS value FROM pages UNION ALL SELECT 'speakers', 'S' || page_id FROM pages
UNION ALL SELECT 'tags', loc FROM sources UNION ALL SELECT 'backlog', 'b' || page_id FROM pages WHERE page_id % 3 = 0""", ["sources"])
def status_flatten(spark, sf):
    page = F.col("page_id")
    lists = views.sources(spark, sf).groupBy(F.floor(page / 50).alias("n")).agg(
        F.collect_list("source_file").alias("media"), F.collect_list(F.concat(F.lit("S"), page)).alias("speakers"),
        F.collect_list("loc").alias("tags"), F.collect_list(F.when(page % 3 == 0, F.concat(F.lit("b"), page))).alias("transcript"))
    doc = F.to_json(F.struct(F.struct("media", "speakers", "tags").alias("existing"), F.struct("transcript").alias("needs")))
    return documents.flatten_status(lists.select(doc.alias("doc")), "doc")


@query("rss_entries", """SELECT 'https://cdn.example.com/' || page_id || '.mp3' AS source_file, 'Ep ' || page_id AS title,
  DATE '2024-01-01' + CAST(page_id % 60 AS INT) AS date, CASE WHEN page_id % 2 = 0 THEN page_id END::BIGINT AS episode, media
FROM sources WHERE page_id % 4 < 3""", ["sources"])
def rss_entries(spark, sf):
    page = F.col("page_id")
    kind = F.when(page % 4 == 0, "audio/mpeg").when(page % 4 == 1, "audio/wav").when(page % 4 == 2, "audio/mp4").otherwise("video/mp4")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (page % 60).cast("int")), "dd MMM yyyy")
    zone = F.when(page % 2 == 0, "GMT").otherwise("+0000")
    link = F.coalesce(F.concat(F.lit("<link>"), F.col("media"), F.lit("</link>")), F.lit(""))
    item = F.concat(
        F.lit("<item><title>Ep "), page, F.lit("</title>"), link, F.lit("<description>about</description><pubDate>Mon, "), day,
        F.lit(" 10:30:00 "), zone, F.lit('</pubDate><enclosure url="https://cdn.example.com/'), page, F.lit('.mp3" type="'), kind,
        F.lit('"/>'), F.when(page % 2 == 0, F.concat(F.lit("<itunes:episode>"), page, F.lit("</itunes:episode>"))).otherwise(""), F.lit("</item>"))
    head = '<rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel>'
    feeds = views.sources(spark, sf).groupBy(F.floor(page / 50).alias("n")).agg(F.collect_list(item).alias("items")).select(
        F.concat(F.lit("feed"), F.col("n"), F.lit(".xml")).alias("path"),
        F.concat(F.lit(head), F.array_join("items", "\n"), F.lit("</channel></rss>")).alias("content"))
    base = scratch_path(spark, "feed")
    write_files(feeds, base)
    out = documents.read_feed_items(spark, base)
    return out.select("source_file", "title", "date", F.col("episode").cast("long").alias("episode"), "media")


@query("playlist_explode", """SELECT page_id // 50 AS list_id, 'loc' || page_id // 50 AS loc, source_file, title FROM sources WHERE page_id % 9 > 0""", ["sources"])
def playlist_explode(spark, sf):
    page = F.col("page_id")
    entry = F.struct(F.when(page % 9 == 0, "[Private video]").otherwise(F.col("title")).alias("title"), F.col("source_file").alias("url"))
    lists = views.sources(spark, sf).groupBy(F.floor(page / 50).alias("list_id")).agg(F.collect_list(entry).alias("entries"))
    parent = lists.withColumn("loc", F.concat(F.lit("loc"), F.col("list_id"))).withColumn("title", F.lit("a list"))
    return documents.explode_playlists(parent).select("list_id", "loc", "source_file", "title")


@query("video_items", """SELECT video_id, channel_id, title, duration::BIGINT AS duration, CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS n_tags,
  CASE WHEN id % 5 > 0 THEN id * 10 ELSE 0 END AS view_count, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, 'pending' AS status FROM videos""", ["videos"])
def video_items(spark, sf):
    d = F.col("duration")
    iso = F.concat(F.lit("PT"), F.when(d >= 60, F.concat(F.floor(d / 60), F.lit("M"))).otherwise(""), d % 60, F.lit("S"))
    doc = F.to_json(F.struct(
        F.col("video_id").alias("id"),
        F.struct("title", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
                 F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("tags")).alias("snippet"),
        F.struct(iso.alias("duration")).alias("contentDetails"),
        F.struct(F.when(F.col("id") % 5 > 0, (F.col("id") * 10).cast("string")).alias("viewCount")).alias("statistics")))
    rows = documents.parse_video_items(views.videos(spark, sf).select("channel_id", doc.alias("doc")), "doc", "channel_id")
    return rows.select("video_id", "channel_id", "title", F.col("duration").cast("long").alias("duration"),
                       F.size("tags").cast("long").alias("n_tags"), F.col("view_count").cast("long").alias("view_count"),
                       F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "status")


@query("chapters_normalise", """SELECT conv_id, turn, (CASE WHEN turn % 2 = 0 THEN n ELSE n + 1 END)::BIGINT AS n_chapters,
  CASE WHEN turn % 2 = 1 THEN '<later>' WHEN n > 0 THEN 'c1' END AS first_title, CASE WHEN turn % 2 = 1 THEN 0.0 WHEN n > 0 THEN 1.0 END::DOUBLE AS first_start
FROM (SELECT conv_id, turn, length(text) % 4 AS n FROM conversations) x""")
def chapters_normalise(spark, sf):
    n = F.length("text") % 4
    rest = F.transform(F.filter(F.sequence(F.lit(1), n + 1), lambda i: i <= n),
                       lambda i: F.struct(i.cast("double").alias("start_time"), F.concat(F.lit("c"), i).alias("title")))
    head = F.array(F.struct(F.lit(0.0).alias("start_time"), F.when(F.col("turn") % 2 == 0, "<Untitled Chapter 1>").otherwise("<later>").alias("title")))
    rows = views.table(spark, sf, "conversations").select("conv_id", "turn", documents.normalise_chapters(F.concat(head, rest)).alias("c"))
    first = F.get(F.col("c"), F.lit(0))
    return rows.select("conv_id", "turn", F.size("c").cast("long").alias("n_chapters"), first["title"].alias("first_title"), first["start"].alias("first_start"))


# ---- stage state


def _state_json(status_of):
    """A saved state document; `status_of(i)` is the status of stage i."""
    pairs = [x for i, s in enumerate(stages.STAGES) for x in (F.lit(s), F.struct(status_of(i).alias("status"), F.lit(i).alias("attempts")))]
    return F.struct(F.lit("in_progress").alias("overall"), F.lit(None).cast("string").alias("failed_stage"), F.create_map(*pairs).alias("stages"))


# Folders of two places with equal titles.
def _place():
    return F.concat(F.lit("place"), F.col("conv_id") % 2, F.lit("/t"), F.floor(F.col("conv_id") / 2))


_PLACE_SQL = "concat('place', conv_id % 2, '/t', conv_id // 2)"


def _saved_states(spark, sf):
    """Per conversation three metadata files; the newest never holds a state, the middle one not always."""
    conv = views.table(spark, sf, "conversations").select("conv_id").distinct()
    versions = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(f"2024-01-0{v + 1}T000000Z").alias("at")) for v in range(3)])
    rows = conv.select("conv_id", F.explode(versions).alias("x")).select("conv_id", "x.*")

    def status(i):
        return F.when((F.col("conv_id") + F.col("v")) % (i + 2) == 0, "completed").otherwise("pending")

    has = (F.col("v") == 0) | ((F.col("v") == 1) & (F.col("conv_id") % 2 == 0))
    doc = F.to_json(F.struct(F.when(has, _state_json(status)).alias("pipeline_state"), F.concat(F.lit("T"), F.col("conv_id")).alias("title")))
    base = scratch_path(spark, "states")
    write_files(rows.select(F.concat(_place(), F.lit("/metadata_"), F.col("at"), F.lit(".json")).alias("path"), doc.alias("content")), base)
    return documents.read_saved_state(spark, base)


_VERSION = "CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END"
_SAVED = " UNION ALL ".join(
    f"SELECT conv_id, {i} AS stage_no, '{s}' AS stage, CASE WHEN (conv_id + {_VERSION}) % {i + 2} = 0 THEN 'completed' ELSE 'pending' END AS status FROM (SELECT DISTINCT conv_id FROM conversations) c"
    for i, s in enumerate(stages.STAGES))


@query("latest_state", f"""SELECT {_PLACE_SQL} AS transcript_id, 'metadata_2024-01-0' || ({_VERSION} + 1) || 'T000000Z.json' AS file_name, stage, status, stage_no::BIGINT AS attempts
FROM ({_SAVED}) s""")
def latest_state(spark, sf):
    states = _saved_states(spark, sf)
    rows = documents.stage_rows(states).select("transcript_id", "stage", "status", F.col("attempts").cast("long").alias("attempts"))
    return rows.join(states.select(F.col("folder").alias("transcript_id"), "file_name"), "transcript_id")


# Saved state without files: half of the documents, some stages.
_DOC_STATE = " UNION ALL ".join(
    f"SELECT doc_id AS transcript_id, {i} AS stage_no, '{s}' AS stage, CASE doc_id % {i + 3} WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'pending' END AS status FROM documents WHERE doc_id % 2 = 0 AND doc_id % {i + 2} > 0"
    for i, s in enumerate(stages.STAGES))


def _doc_state(spark, sf):
    doc = F.col("doc_id")
    rows = F.array(*[
        F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage"), (doc % (i + 2) > 0).alias("saved"),
                 F.when(doc % (i + 3) == 0, "completed").when(doc % (i + 3) == 1, "failed").otherwise("pending").alias("status"))
        for i, s in enumerate(stages.STAGES)])
    d = views.table(spark, sf, "documents").filter("doc_id % 2 = 0").select(doc.alias("transcript_id"), F.explode(rows).alias("r"))
    return d.select("transcript_id", "r.*").filter("saved").drop("saved")


def _doc_ids(spark, sf):
    return views.table(spark, sf, "documents").select(F.col("doc_id").alias("transcript_id"))


_STAGES_SQL = "(VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(stages.STAGES)) + ") g(stage_no, stage)"
_PLAN = f"""SELECT d.doc_id AS transcript_id, g.stage_no::BIGINT AS stage_no, g.stage, coalesce(s.status, 'pending') AS status
FROM documents d CROSS JOIN {_STAGES_SQL} LEFT JOIN ({_DOC_STATE}) s ON s.transcript_id = d.doc_id AND s.stage = g.stage"""


def _plan(spark, sf):
    return stages.stage_plan(_doc_ids(spark, sf), _doc_state(spark, sf))


@query("stage_plan", _PLAN)
def stage_plan(spark, sf):
    return _plan(spark, sf).withColumn("stage_no", F.col("stage_no").cast("long"))


_OUTCOME = f"""SELECT transcript_id, stage_no, stage, CASE WHEN stage_no > f THEN 'skipped' WHEN stage_no = f THEN 'failed'
  WHEN status = 'completed' THEN 'completed' WHEN stage = 'summarization' THEN 'skipped' ELSE 'completed' END AS status
FROM (SELECT *, min(CASE WHEN status <> 'completed' AND stage <> 'summarization' AND (transcript_id + stage_no) % 11 = 0 THEN stage_no END)
  OVER (PARTITION BY transcript_id) AS f FROM ({_PLAN}) p) q"""


def _outcome(spark, sf):
    fails = (F.col("transcript_id") + F.col("stage_no")) % 11 == 0
    return stages.stage_outcome(_plan(spark, sf), fails, F.col("stage") != "summarization")


@query("stage_outcome", _OUTCOME)
def stage_outcome(spark, sf):
    return _outcome(spark, sf).withColumn("stage_no", F.col("stage_no").cast("long"))


@query("stage_overall", f"""SELECT transcript_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'completed' END AS overall,
  max(stage) FILTER (status = 'failed') AS failed_stage FROM ({_OUTCOME}) o GROUP BY transcript_id""")
def stage_overall(spark, sf):
    return stages.overall(_outcome(spark, sf))


@query("stage_upsert", f"""WITH old AS ({_DOC_STATE}), fresh AS (SELECT doc_id AS transcript_id, 'correction' AS stage, 'completed' AS status FROM documents WHERE doc_id % 3 = 0)
SELECT transcript_id, stage, status, 2::BIGINT AS seq FROM fresh
UNION ALL SELECT transcript_id, stage, status, 1 FROM old WHERE (transcript_id, stage) NOT IN (SELECT (transcript_id, stage) FROM fresh)
UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE doc_id NOT IN (SELECT transcript_id FROM old) AND doc_id % 3 > 0""")
def stage_upsert(spark, sf):
    old = _doc_state(spark, sf).select("transcript_id", "stage", "status", F.lit(1).cast("long").alias("seq"))
    new = _doc_ids(spark, sf).filter("transcript_id % 3 = 0").select(
        "transcript_id", F.lit("correction").alias("stage"), F.lit("completed").alias("status"), F.lit(2).cast("long").alias("seq"))
    return stages.upsert_state(_doc_ids(spark, sf), old, new)


@query("resume_outputs", f"""SELECT {_PLACE_SQL} AS transcript_id, CASE WHEN conv_id % 3 > 0 AND conv_id % 2 = 1 THEN 'pending' WHEN conv_id % 3 > 0 THEN 'completed' ELSE 'pending' END AS status,
  CASE WHEN conv_id % 3 > 0 AND conv_id % 2 = 0 THEN 'deepgram_2024-01-0' || (2 + conv_id % 5) || 'T000000Z.json' END AS file_name
FROM (SELECT DISTINCT conv_id FROM conversations) c""")
def resume_outputs(spark, sf):
    conv = views.table(spark, sf, "conversations").select("conv_id").distinct()
    n = F.col("conv_id")
    files = conv.filter("conv_id % 2 = 0").select("conv_id", F.explode(F.array(
        F.lit("deepgram_2024-01-01"), F.concat(F.lit("deepgram_2024-01-0"), 2 + n % 5), F.lit("whisper_2024-01-09"))).alias("name"))
    base = scratch_path(spark, "outputs")
    write_files(files.select(F.concat_ws("/", _place(), F.concat("name", F.lit("T000000Z.json"))).alias("path"), F.lit("{}").alias("content")), base)
    found = documents.list_outputs(spark, base).select(F.col("folder").alias("transcript_id"), "file_name")
    state = conv.select(_place().alias("transcript_id"), F.lit("transcription").alias("stage"), F.when(n % 3 > 0, "completed").otherwise("pending").alias("status"))
    return stages.resume_outputs(state, found, "deepgram")


# ---- exports


def _finished(spark, sf):
    none = F.lit(None)
    return views.transcripts(spark, sf).select(
        "id", "title", "loc", "raw_text", "corrected_text", "summary",
        F.when(F.col("id") % 2 == 0, F.array("lang", F.lit("a: b"))).alias("tags"), F.array(F.lit("Ann Lee")).alias("speakers"),
        none.cast("array<string>").alias("categories"), none.cast("array<string>").alias("topics"),
        F.concat(F.lit("https://example.com/"), F.col("id")).alias("source_file"), F.concat(F.lit("https://example.com/"), F.col("id")).alias("media"),
        (F.col("id") % 3 == 0).alias("local"), F.when(F.col("id") % 2 == 0, F.lit("2024-03-01").cast("date")).alias("date"),
        F.when(F.col("id") % 5 == 0, F.lit(7)).alias("episode"), none.cast("string").alias("conference"),
        F.lit("audio").alias("type"), F.array().cast("array<string>").alias("chapters"), F.lit("").alias("description"),
        none.cast("array<map<string,string>>").alias("additional_resources"))


_BY = exports.attribution("user", "tool", "1.0.0", " --needs-review")
_YAML_SUMMARY = """CASE WHEN regexp_matches(summary, '^[A-Za-z][A-Za-z0-9 _./()''-]*$') AND NOT ends_with(summary, ' ') AND lower(summary) NOT IN ('true', 'false', 'null', 'yes', 'no', 'on', 'off', 'y', 'n')
  THEN summary ELSE to_json(summary)::VARCHAR END"""
_MARKDOWN = f"""SELECT id, loc || '/' || {slug_sql('title')} || '.md' AS path, '---' || chr(10) || 'title: ' || title || chr(10) || 'speakers:' || chr(10) || '  - Ann Lee' || chr(10)
  || CASE WHEN id % 2 = 0 THEN 'tags:' || chr(10) || '  - ' || lang || chr(10) || '  - "a: b"' || chr(10) ELSE 'tags: []' || chr(10) END
  || 'source_file: "https://example.com/' || id || '"' || chr(10) || 'media: "https://example.com/' || id || '"' || chr(10) || 'categories: []' || chr(10)
  || CASE WHEN id % 2 = 0 THEN 'date: ''2024-03-01''' || chr(10) ELSE '' END
  || CASE WHEN summary <> '' THEN 'summary: ' || {_YAML_SUMMARY} || chr(10) ELSE '' END
  || CASE WHEN id % 5 = 0 THEN 'episode: 7' || chr(10) ELSE '' END || 'transcript_by: {_BY}' || chr(10) || '---' || chr(10) || chr(10)
  || coalesce(corrected_text, raw_text) || chr(10) AS content FROM transcripts"""


@query("export_markdown", _MARKDOWN, ["transcripts"])
def export_markdown(spark, sf):
    return exports.markdown(_finished(spark, sf), _BY)


@query("export_markdown_plain", f"SELECT id, loc || '/' || {slug_sql('title')} || '-plain.md' AS path, raw_text AS content FROM transcripts".replace("-plain", "_plain"), ["transcripts"])
def export_markdown_plain(spark, sf):
    return exports.markdown(_finished(spark, sf), include_metadata=False)


_JSON = f"""SELECT id, loc || '/' || {slug_sql('title')} || '.json' AS path, '{{"title":' || to_json(title)
  || ',"categories":[]' || CASE WHEN id % 2 = 0 THEN ',"tags":["' || lang || '","a: b"]' ELSE ',"tags":[]' END || ',"speakers":["Ann Lee"],"loc":' || to_json(loc) || ',"body":' || to_json(raw_text)
  || CASE WHEN id % 3 > 0 THEN ',"media":"https://example.com/' || id || '"' ELSE '' END || CASE WHEN id % 2 = 0 THEN ',"date":"2024-03-01"' ELSE '' END
  || ',"transcript_by":"{_BY}"}}' AS content FROM transcripts"""


@query("export_json", _JSON, ["transcripts"])
def export_json(spark, sf):
    return exports.json_documents(_finished(spark, sf), _BY)


_TEXT = f"""SELECT id, kind, loc || '/' || {slug_sql('title')} || '_' || kind || '.txt' AS path, content FROM (
  SELECT id, loc, title, 'raw' AS kind, raw_text AS content FROM transcripts UNION ALL SELECT id, loc, title, 'corrected', corrected_text FROM transcripts
  UNION ALL SELECT id, loc, title, 'summary', summary FROM transcripts) t WHERE content <> ''"""


@query("export_text", _TEXT, ["transcripts"])
def export_text(spark, sf):
    return exports.texts(_finished(spark, sf))


DOCUMENT = f"""SELECT id, '{{"title":' || to_json(title) || ',"speakers":["Ann Lee"]' || CASE WHEN id % 2 = 0 THEN ',"tags":["' || lang || '","a: b"]' ELSE ',"tags":[]' END
  || ',"type":"audio","loc":' || to_json(loc) || ',"source_file":"https://example.com/' || id || '","media":"https://example.com/' || id || '","categories":[],"chapters":[]'
  || CASE WHEN id % 2 = 0 THEN ',"date":"2024-03-01"' ELSE '' END || CASE WHEN summary <> '' THEN ',"summary":' || to_json(summary) ELSE '' END
  || CASE WHEN id % 5 = 0 THEN ',"episode":7' ELSE '' END || '}}' AS document FROM transcripts"""


@query("source_document", DOCUMENT, ["transcripts"])
def source_document(spark, sf):
    return _finished(spark, sf).select("id", exports.source_document(youtube=False).alias("document"))


@query("output_paths", f"""SELECT id, 'out/' || loc || '/' || {slug_sql('title')} || '_raw_2024-02-01T000000Z.txt' AS path,
  'out/' || {slug_sql('title')} || '.json' AS bare_path, 'meta/' || loc || '/' || {slug_sql('title')} || '/deepgram_2024-02-01T000000Z.json' AS data_path FROM transcripts""", ["transcripts"])
def paths(spark, sf):
    t = views.transcripts(spark, sf).withColumn("nested", F.concat(F.lit("/"), F.col("loc"), F.lit("/"))).withColumn("none", F.lit(""))
    return t.select("id", output_paths("out/", "nested", "title", F.lit("_raw"), "txt", "2024-02-01T000000Z").alias("path"),
                    output_paths("out", "none", "title", F.lit(""), "json").alias("bare_path"),
                    data_path("meta", "nested", "title", "deepgram", "json", "2024-02-01T000000Z").alias("data_path"))


# ---- provider output: every turn of a conversation as one document


def _turn_words(spark, sf):
    return views.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("transcript_id"), "conv_id", "turn", "text",
        F.filter(F.split(F.trim("text"), "[ \\n\\t\\r]+"), lambda w: w != "").alias("ws"))


def _word(w, i):
    return F.struct(
        w.alias("word"), (i * F.lit(0.5)).alias("start"), (i * F.lit(0.5) + F.lit(0.25)).alias("end"), F.lit(0.5).alias("confidence"),
        F.floor(i / 7).cast("int").alias("speaker"), F.lit(0.75).alias("speaker_confidence"), w.alias("punctuated_word"))


def _word_json():
    alternative = F.struct(F.transform("ws", _word).alias("words"), F.array(F.struct(F.get(F.col("ws"), F.lit(0)).alias("summary"))).alias("summaries"))
    return F.to_json(F.struct(F.struct(F.array(F.struct(F.array(alternative).alias("alternatives"))).alias("channels")).alias("results")))


_TURN_WORDS = """SELECT conv_id * 1000 + turn AS transcript_id, conv_id, turn, text, w, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS pos
FROM (SELECT conv_id, turn, text, unnest(a) AS w, unnest(range(len(a))) AS i
  FROM (SELECT conv_id, turn, text, string_split_regex(trim(text), '[ \\n\\t\\r]+') AS a FROM conversations) s) x WHERE w <> ''"""


@query("asr_words", f"""SELECT transcript_id, pos, (pos // 7)::BIGINT AS speaker, pos * 0.5::DOUBLE AS start_s, pos * 0.5::DOUBLE + 0.25::DOUBLE AS end_s,
  0.75::DOUBLE AS speaker_confidence, w AS punctuated_word FROM ({_TURN_WORDS}) t""")
def asr_words(spark, sf):
    out = providers.words_of(_turn_words(spark, sf).select("transcript_id", _word_json().alias("output")))
    return out.select("transcript_id", "pos", F.col("speaker").cast("long").alias("speaker"), "start_s", "end_s", "speaker_confidence", "punctuated_word")


@query("normalise_providers", f"""WITH w AS MATERIALIZED ({_TURN_WORDS})
SELECT transcript_id, 'deepgram' AS provider, (pos // 7)::BIGINT AS seg_no, 0::BIGINT AS part_no, (pos // 7)::BIGINT AS speaker, min(pos) * 0.5::DOUBLE AS start_s,
  max(pos) * 0.5::DOUBLE + 0.25::DOUBLE AS end_s, string_agg(w, ' ' ORDER BY pos) AS text FROM w WHERE turn % 3 = 0 GROUP BY transcript_id, pos // 7
UNION ALL SELECT conv_id * 1000 + turn, 'smallestai', 0, 0, CASE WHEN turn % 2 = 0 THEN turn ELSE NULL END, CASE WHEN turn % 2 = 0 THEN 1.5 ELSE 0.5 END,
  CASE WHEN turn % 2 = 0 THEN 4.0 ELSE 0.75 END, text FROM conversations WHERE turn % 3 = 1
UNION ALL SELECT conv_id * 1000 + turn, 'whisper', 0, 0, NULL, 0.0, 2.0, text FROM conversations WHERE turn % 3 = 2""")
def normalise_providers(spark, sf):
    n = F.col("turn")
    utterances = F.when(n % 2 == 0, F.array(F.struct(
        F.concat(F.lit("speaker_"), n).alias("speaker"), F.lit(1.5).alias("start"), F.lit(4.0).alias("end"), F.col("text"))))
    word = F.array(F.struct(F.get(F.col("ws"), F.lit(0)).alias("word"), F.lit(0.5).alias("start"), F.lit(0.75).alias("end")))
    utterance_json = F.to_json(F.struct(F.col("text").alias("transcription"), utterances.alias("utterances"), word.alias("words")))
    segment_json = F.to_json(F.struct("text", F.array(F.struct(F.lit(0.0).alias("start"), F.lit(2.0).alias("end"), F.col("text"))).alias("segments")))
    rows = _turn_words(spark, sf).select(
        "transcript_id", F.when(n % 3 == 0, "deepgram").when(n % 3 == 1, "smallestai").otherwise("whisper").alias("provider"),
        F.when(n % 3 == 0, _word_json()).when(n % 3 == 1, utterance_json).otherwise(segment_json).alias("output"))
    out = providers.normalise(rows)
    return out.withColumn("speaker", F.col("speaker").cast("long"))


