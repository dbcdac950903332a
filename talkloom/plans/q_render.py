"""Queries that end in documents: subtitles, transcripts of other providers, paper edits, whole flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.operators import ingest, model, paper_edit, render, subtitles, timeline
from talkloom.operators.stages import Stage, run_stages
from talkloom.plans import views
from talkloom.plans.q_sources import _BY, _JSON, _MARKDOWN, _TEXT, _finished
from talkloom.plans.q_text import WS, editing_model, digest_model, srt_sql, strip_sql
from talkloom.plans.q_timeline import _hms_sql, finalised
from talkloom.plans.registry import query
from talkloom.scratch import materialise
from talkloom.sinks import exports

NL = "chr(10)"
_TOOL = "user via tool v1"


@query("export_srt", f"""SELECT transcript_id, turn // 256 AS part_no, string_agg((turn + 1) || {NL} || {srt_sql('start_s')} || ' --> ' || {srt_sql('end_s')} || {NL}
  || {strip_sql('text')} || {NL} || {NL}, '' ORDER BY turn) AS text
FROM (SELECT u.*, c.text FROM utterances u JOIN conversations c ON c.conv_id = u.transcript_id AND c.turn = u.turn) t GROUP BY 1, 2""", ["utterances"])
def export_srt(spark, sf):
    return render.render_srt(views.utterance_texts(spark, sf), "turn")


@query("srt_word_groups", """WITH RECURSIVE g AS (SELECT transcript_id, 0::BIGINT AS cue_no, 0::BIGINT AS lo,
    coalesce((SELECT min(pos) FROM words x WHERE x.transcript_id = d.transcript_id AND x.end_s >= 10), (SELECT max(pos) FROM words x WHERE x.transcript_id = d.transcript_id)) AS hi
  FROM (SELECT DISTINCT transcript_id FROM words) d
  UNION ALL SELECT g.transcript_id, g.cue_no + 1, g.hi + 1, coalesce((SELECT min(y.pos) FROM words y WHERE y.transcript_id = g.transcript_id AND y.pos > g.hi AND y.end_s - s.start_s >= 10),
      (SELECT max(y.pos) FROM words y WHERE y.transcript_id = g.transcript_id))
  FROM g JOIN words s ON s.transcript_id = g.transcript_id AND s.pos = g.hi + 1)
SELECT g.transcript_id, g.cue_no, min(w.start_s) AS start_s, max(w.end_s) AS end_s, string_agg(w.punctuated_word, ' ' ORDER BY w.pos) AS text
FROM g JOIN words w ON w.transcript_id = g.transcript_id AND w.pos BETWEEN g.lo AND g.hi GROUP BY 1, 2""", ["words"])
def srt_word_groups(spark, sf):
    return subtitles.whole_cues(subtitles.word_cues(materialise(views.words(spark, sf), "words")))


_PLACED_TURN = """placed_turn AS (SELECT p.transcript_id, p.title, p.turn FROM (
  SELECT transcript_id, title, chapter_no + max(first_no - chapter_no) OVER (PARTITION BY transcript_id ORDER BY chapter_no) AS turn
  FROM (SELECT c.transcript_id, c.chapter_no, c.title, coalesce(min(u.turn), 1000000000) AS first_no
    FROM chapters c LEFT JOIN utterances u ON c.transcript_id = u.transcript_id AND u.start_s >= c.start_s GROUP BY ALL) d) p
  JOIN (SELECT transcript_id, max(turn) AS last_no FROM utterances GROUP BY transcript_id) n ON n.transcript_id = p.transcript_id AND p.turn <= n.last_no)"""


@query("render_transcript_utt", f"""WITH {_PLACED_TURN},
pieces AS (SELECT u.transcript_id, u.turn, coalesce({NL} || {NL} || '## ' || p.title || {NL} || {NL}, '') || 'Speaker ' || u.speaker || ': ' || {_hms_sql('u.start_s')} || {NL} || {NL}
  || list_aggregate(list_transform(list_filter(list_transform(string_split(regexp_replace(c.text, '([.?!]){WS}+', '\\1' || chr(1), 'g'), chr(1)),
    lambda x: {strip_sql('x')}), lambda x: x <> ''), lambda x: x || {NL}), 'string_agg', '') || {NL} AS piece
  FROM utterances u JOIN conversations c ON c.conv_id = u.transcript_id AND c.turn = u.turn
  LEFT JOIN placed_turn p ON p.transcript_id = u.transcript_id AND p.turn = u.turn)
SELECT transcript_id, turn // 256 AS part_no, string_agg(CASE WHEN turn = hi THEN regexp_replace(t, '{WS}+$', '') ELSE t END, '' ORDER BY turn) AS text
FROM (SELECT *, CASE WHEN turn = min(turn) OVER w THEN regexp_replace(piece, '^{WS}+', '') ELSE piece END AS t, max(turn) OVER w AS hi
  FROM pieces WINDOW w AS (PARTITION BY transcript_id)) q GROUP BY 1, 2""", ["chapters", "utterances"])
def render_transcript_utt(spark, sf):
    rows = materialise(views.utterance_texts(spark, sf), "utterances")
    placed = timeline.place_chapters(views.chapters_of(rows), rows, "turn")
    return render.render_utterances(rows, placed, "turn")


@query("render_segments", f"""WITH due AS (SELECT transcript_id, chapter_no, title, max(first_no) OVER (PARTITION BY transcript_id ORDER BY chapter_no) AS turn
  FROM (SELECT c.transcript_id, c.chapter_no, c.title, coalesce(min(u.turn), 1000000000) AS first_no
    FROM chapters c LEFT JOIN utterances u ON c.transcript_id = u.transcript_id AND u.start_s >= c.start_s GROUP BY ALL) d),
heads AS (SELECT transcript_id, turn, string_agg({NL} || {NL} || '## ' || title || {NL} || {NL}, '' ORDER BY chapter_no) AS h FROM due GROUP BY 1, 2)
SELECT u.transcript_id, u.turn // 256 AS part_no, string_agg(coalesce(h.h, '') || c.text, '' ORDER BY u.turn) AS text
FROM utterances u JOIN conversations c ON c.conv_id = u.transcript_id AND c.turn = u.turn
LEFT JOIN heads h ON h.transcript_id = u.transcript_id AND h.turn = u.turn GROUP BY 1, 2""", ["chapters", "utterances"])
def render_segments(spark, sf):
    rows = materialise(views.utterance_texts(spark, sf), "utterances")
    placed = timeline.place_chapters(views.chapters_of(rows), rows, "turn", cascade=False)
    return render.render_segments(rows, placed, "turn")


@query("dpe_words", """SELECT transcript_id, pos AS id, start_s AS start, end_s AS end, punctuated_word AS text FROM words""", ["words"])
def dpe_words(spark, sf):
    return paper_edit.dpe_words(views.words(spark, sf))


_DPE = """WITH segs AS (SELECT transcript_id, seg_no, min(speaker) AS speaker, min(start_s) AS seg_start, max(end_s) AS seg_end FROM repaired GROUP BY 1, 2),
marks AS (SELECT transcript_id, seg_no, -1::BIGINT AS chapter_no, seg_start AS start_s, NULL AS title FROM segs
  UNION ALL SELECT p.transcript_id, r.seg_no, p.chapter_no, p.start_s, p.title FROM placed p JOIN repaired r ON r.transcript_id = p.transcript_id AND r.sent_no = p.sent_no),
spans AS (SELECT m.*, s.speaker, s.seg_end, lead(m.start_s) OVER (PARTITION BY m.transcript_id, m.seg_no ORDER BY m.chapter_no) AS next_in_seg, n.start_s AS next_start
  FROM marks m JOIN segs s ON s.transcript_id = m.transcript_id AND s.seg_no = m.seg_no
  LEFT JOIN snapped n ON n.transcript_id = m.transcript_id AND n.chapter_no = m.chapter_no + 1 AND m.chapter_no >= 0),
dpe AS (SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY seg_no, chapter_no) - 1 AS id, start_s AS start,
    coalesce(next_in_seg, seg_end) AS "end", 'Speaker ' || speaker AS speaker,
    CASE WHEN next_in_seg IS NOT NULL OR next_start IS NULL OR start_s < next_start THEN title END AS chapter
  FROM spans WHERE next_in_seg IS NULL OR start_s < next_in_seg)
"""


@query("dpe_paragraphs", _DPE + 'SELECT transcript_id, id, start, "end", speaker, chapter FROM dpe', ["placed", "snapped", "repaired"])
def dpe_paragraphs(spark, sf):
    done = finalised(spark, sf)
    return paper_edit.dpe_paragraphs(done.sentences, done.chapters, done.placed)


@query("export_dpe", _DPE.rstrip() + """,
pieces AS (SELECT transcript_id, pos // 4096 AS part_no, pos AS id, CASE WHEN pos = 0 THEN '{"words": [' ELSE ', ' END
    || '{"id":' || pos || ',"start":' || start_s || ',"end":' || end_s || ',"text":' || to_json(punctuated_word) || '}' AS piece FROM words
  UNION ALL SELECT transcript_id, id // 4096 + 1099511627776, id, CASE WHEN id = 0 THEN '], "paragraphs": [' ELSE ', ' END
    || '{"id":' || id || ',"start":' || start || ',"end":' || "end" || ',"speaker":"' || speaker || '"' || coalesce(',"chapter":' || to_json(chapter), '') || '}'
    || CASE WHEN id = max(id) OVER (PARTITION BY transcript_id) THEN ']}' ELSE '' END FROM dpe)
SELECT transcript_id, part_no, string_agg(piece, '' ORDER BY id) AS text FROM pieces GROUP BY 1, 2""", ["words", "placed", "snapped", "repaired"])
def export_dpe(spark, sf):
    done = finalised(spark, sf)
    return done.paper_edit()


# ---- whole flows


# The documents hold no blank lines, so a text over a chunk limit is one stripped chunk.
_FINISHED = f"""WITH corrected AS (SELECT *, CASE WHEN length(t) % 7 = 0 OR length(t) % 5 = 0 AND 10 < 0.7 * length(c) THEN c
    WHEN length(t) % 5 = 0 THEN substr(t, 1, 10) WHEN length(t) < 0.7 * length(c) THEN c ELSE replace(t, 'e', 'E') END AS fixed
  FROM (SELECT *, {strip_sql('c')} AS t FROM (SELECT id, title, loc, lang, raw_text, CASE WHEN length(raw_text) > 5000 THEN {strip_sql('raw_text')} ELSE raw_text END AS c FROM base) a) b),
transcripts AS (SELECT id, title, loc, lang, raw_text, fixed AS corrected_text, CASE WHEN length(s) % 4 = 0 THEN '' ELSE md5(s) END AS summary
  FROM (SELECT *, CASE WHEN length(fixed) > 30000 THEN {strip_sql('fixed')} ELSE fixed END AS s FROM corrected) d)
"""


@query("end_to_end", _FINISHED.replace("FROM base", "FROM (SELECT doc_id AS id, concat('Doc_', doc_id, ' ', lang) AS title, source AS loc, lang, text AS raw_text FROM documents) base")
       + f"""SELECT id, 'markdown' AS format, path, md5(content) AS content_md5 FROM ({_MARKDOWN.replace(_BY, _TOOL)}) m
UNION ALL SELECT id, 'json', path, md5(content) FROM ({_JSON.replace(_BY, _TOOL)}) j
UNION ALL SELECT id, 'text', path, md5(content) FROM ({_TEXT}) t""")
def end_to_end(spark, sf):
    """Correct, summarise and export every transcript, as a list of stages over all of them."""
    docs = _finished(spark, sf)
    none = F.lit(None).cast("array<string>")
    context = F.struct(*[none.alias(n) for n in (
        "frequent_tags", "technical_terms", "project_names", "common_speakers", "common_categories",
        "expertise_areas", "tag_variations", "domain_context", "video_count")])

    def correction(df):
        about = {"title": F.col("title"), "speakers": F.col("speakers"), "tags": F.col("tags"), "categories": F.col("categories"), "description": F.col("description")}
        fixed = model.correct_documents(df, "id", "raw_text", about, context, editing_model)
        return df.drop("corrected_text").join(fixed.withColumnRenamed("text", "corrected_text"), "id")

    def summarisation(df):
        short = model.summarise_documents(df, "id", "corrected_text", "raw_text", "title", digest_model)
        return df.drop("summary").join(short, "id")

    finished = run_stages(docs, [Stage("correction", correction, asks_model=True), Stage("summarization", summarisation, asks_model=True)])
    out = None
    for name, export in exports.create_exports({"markdown": True, "text_output": True}, _TOOL).items():
        rows = export(finished).select("id", F.lit(name).alias("format"), "path", F.md5("content").alias("content_md5"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("discover_new", """SELECT id, video_id, channel_id FROM (SELECT v.*
  FROM videos v JOIN channels c ON c.id = v.channel_id WHERE c.is_active AND (c.last_scanned_at IS NULL OR v.published_at > c.last_scanned_at)) r
WHERE id % 3 > 0""", ["videos", "channels"])
def discover_new(spark, sf):
    v = views.videos(spark, sf)
    return ingest.discover(v, views.channels(spark, sf), v.filter("id % 3 = 0")).select("id", "video_id", "channel_id")


@query("classify_pending", """SELECT id, CASE WHEN gated THEN false ELSE t END AS is_technical, CASE WHEN gated THEN 'skipped' WHEN t THEN 'queued' ELSE 'skipped' END AS status
FROM (SELECT id, duration > 0 AND (duration < 600 OR duration > 3000) AS gated, channel_id % 3 > 0 AS t FROM videos WHERE status = 'pending') v""", ["videos"])
def classify_pending(spark, sf):
    v, c = views.videos(spark, sf), views.channels(spark, sf)
    none = F.lit(None)
    v = v.withColumn("description", F.concat(F.lit("channel="), F.col("channel_id") % 3)).withColumn("tags", none.cast("array<string>"))
    return ingest.classify_pending(v, c, flag_model).select("id", "is_technical", "status")


def flag_model():
    """Technical unless the description says channel=0."""

    def run(batch):
        return ['{"is_technical": %s, "confidence": 0.9}' % ("false" if "channel=0" in p else "true") for p in batch]

    return run
