"""Queries over text, times, replies, prompts, chunks and the stages around a batch model."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from talkloom.functions import prompts, replies, text as tx, timing
from talkloom.operators import chunks, model, render, tags
from talkloom.operators.rows import explode_once
from talkloom.plans import views
from talkloom.plans.q_tags import _CONTEXT_ROWS, _context
from talkloom.plans.registry import query
from talkloom.scratch import materialise

WS = "[ \\t\\n\\v\\f\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
NL2 = "chr(10) || chr(10)"


def strip_sql(e):
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def _hms_sql(e):
    return f"printf('%02d:%02d:%02d', floor({e})::BIGINT // 3600, floor({e})::BIGINT // 60 % 60, floor({e})::BIGINT % 60)"


def srt_sql(e):
    return f"{_hms_sql(e)} || ',' || printf('%03d', floor(({e} - floor({e})) * 1000)::BIGINT)"


_SLUG = "lower(regexp_replace(regexp_replace(replace({0}, '_', '-'), '[^\\p{{L}}\\p{{N}}_]+', '-', 'g'), '^-+|-+$', '', 'g'))"


def slug_sql(e):
    return _SLUG.format(e)


@query("slugify", f"SELECT id, {slug_sql('title')} AS slug, {slug_sql('raw_text')} AS text_slug FROM transcripts", ["transcripts"])
def slugify(spark, sf):
    t = views.transcripts(spark, sf)
    return t.select("id", tx.slugify(F.col("title")).alias("slug"), tx.slugify(F.col("raw_text")).alias("text_slug"))


@query("hms", f"SELECT id, {_hms_sql('duration * 37')} AS hms FROM videos", ["videos"])
def hms(spark, sf):
    return views.videos(spark, sf).select("id", timing.hms(F.col("duration") * 37).alias("hms"))


@query("srt_time", f"SELECT transcript_id, pos, {srt_sql('start_s')} AS start_at, {srt_sql('end_s')} AS end_at FROM words", ["words"])
def srt_time(spark, sf):
    w = views.words(spark, sf)
    return w.select("transcript_id", "pos", timing.srt_time(F.col("start_s")).alias("start_at"), timing.srt_time(F.col("end_s")).alias("end_at"))


_DURATIONS = """SELECT id, duration::BIGINT AS duration, CASE id % 6 WHEN 0 THEN 'P1D' WHEN 1 THEN '' ELSE 'PT'
  || CASE WHEN duration >= 3600 THEN (duration // 3600) || 'H' ELSE '' END
  || CASE WHEN duration // 60 % 60 > 0 THEN (duration // 60 % 60) || 'M' ELSE '' END
  || CASE WHEN duration % 60 > 0 THEN (duration % 60) || 'S' ELSE '' END END AS iso FROM videos"""


def _durations(spark, sf):
    d = F.col("duration")
    h, m, s = F.floor(d / 3600), F.floor(d / 60) % 60, d % 60

    def unit(v, u):
        return F.when(v > 0, F.concat(v.cast("string"), F.lit(u))).otherwise("")

    iso = F.concat(F.lit("PT"), unit(h, "H"), unit(m, "M"), unit(s, "S"))
    return views.videos(spark, sf).select(
        "id", "duration", F.when(F.col("id") % 6 == 0, "P1D").when(F.col("id") % 6 == 1, "").otherwise(iso).alias("iso"))


@query("iso_duration", f"SELECT id, iso, CASE WHEN id % 6 > 1 THEN duration ELSE 0 END AS seconds FROM ({_DURATIONS}) d", ["videos"])
def iso_duration(spark, sf):
    return _durations(spark, sf).select("id", "iso", timing.iso_duration_seconds(F.col("iso")).cast("long").alias("seconds"))


@query("rfc3339", """SELECT id, t || CASE id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+00:00' ELSE 'Z' END AS stamp
FROM (SELECT id, strftime(published_at, '%Y-%m-%dT%H:%M:%S') AS t FROM videos) v""", ["videos"])
def rfc3339(spark, sf):
    base = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")
    given = F.concat(base, F.when(F.col("id") % 3 == 0, "Z").when(F.col("id") % 3 == 1, "+00:00").otherwise(""))
    return views.videos(spark, sf).select("id", timing.rfc3339(given).alias("stamp"))


@query("parse_date", """SELECT id, CASE WHEN id % 4 < 2 THEN published_at::DATE END AS day, id % 4 >= 2 AS rejected,
  published_at::DATE AS compact_day FROM videos""", ["videos"])
def parse_date(spark, sf):
    at, n = F.col("published_at"), F.col("id") % 4
    given = F.when(n < 2, F.date_format(at, "yyyy-MM-dd")).when(n == 2, F.date_format(at, "dd.MM.yyyy")).otherwise("2024-13-45")
    day = timing.parse_date(given)
    compact = timing.parse_compact_date(F.date_format(at, "yyyyMMdd"))
    return views.videos(spark, sf).select("id", day.alias("day"), day.isNull().alias("rejected"), compact.alias("compact_day"))


def _spread(df):
    """Rows dealt to the partitions of a shuffle: the given table may be one file, and the work on texts is costly."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@query("sentence_split", f"""SELECT doc_id, n AS sent_no, s AS sentence FROM (
  SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS n FROM (
    SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.?!]){WS}+', '\\1' || chr(1), 'g'), chr(1)),
      lambda x: {strip_sql('x')}), lambda x: x <> '') AS ss FROM documents) a) b""")
def sentence_split(spark, sf):
    d = _spread(views.table(spark, sf, "documents").select("doc_id", "text"))
    rows = explode_once(d, ["doc_id"], tx.split_sentences(F.col("text")), "n", "sentence")
    return rows.select("doc_id", F.col("n").cast("long").alias("sent_no"), "sentence")


_CANDIDATES = f"regexp_replace(text, '([.?…-])({WS})', '\\1' || chr(1) || '\\2', 'g')"
_GUARDED = f"""regexp_replace(regexp_replace({_CANDIDATES}, '([\\p{{L}}\\p{{N}}_][.][\\p{{L}}\\p{{N}}_][.?…-])\\x01', '\\1', 'g'), '([A-Z][a-z][.])\\x01', '\\1', 'g')"""


@query("sentence_split_abbrev", f"""SELECT doc_id, n AS sent_no, s AS sentence FROM (
  SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS n FROM (
    SELECT doc_id, string_split(regexp_replace({_GUARDED}, '\\x01{WS}', chr(1), 'g'), chr(1)) AS ss FROM documents) a) b""")
def sentence_split_abbrev(spark, sf):
    d = _spread(views.table(spark, sf, "documents").select("doc_id", "text"))
    rows = explode_once(d, ["doc_id"], tx.split_sentences_abbrev(F.col("text")), "n", "sentence")
    return rows.select("doc_id", F.col("n").cast("long").alias("sent_no"), "sentence")


_PARSED = """SELECT doc_id, CASE WHEN json_valid(j) THEN (j::JSON ->> 'is_technical') = 'true' ELSE false END AS is_technical,
  CASE WHEN json_valid(j) THEN least(greatest((j::JSON ->> 'confidence')::DOUBLE, 0.0), 1.0) ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN NOT json_valid(j) THEN 'Parse error: no JSON object with a numeric confidence'
    ELSE coalesce(nullif(trim(j::JSON ->> 'reason'), ''), 'No reason provided') END AS reason
FROM (SELECT doc_id, CASE WHEN contains(reply, '{"') THEN regexp_extract(reply, '(?s)\\{.*\\}') ELSE reply END AS j FROM replies) r"""


def _parsed(spark, sf):
    r = views.replies(spark, sf).withColumn("r", replies.parse_classification(F.col("reply")))
    return r.select("doc_id", "r.*")


@query("parse_classification", _PARSED, ["replies"])
def parse_classification(spark, sf):
    return _parsed(spark, sf)


@query("classification_status", f"""SELECT doc_id, CASE WHEN is_technical AND confidence >= 0.7 THEN 'queued' WHEN NOT is_technical THEN 'skipped'
  ELSE 'classified' END AS status FROM ({_PARSED}) p""", ["replies"])
def classification_status(spark, sf):
    return _parsed(spark, sf).select("doc_id", replies.classification_status(F.col("is_technical"), F.col("confidence")).alias("status"))


# Metadata replies over the labelled documents: plain, fenced, scalar fields, malformed.
_META = """SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN '' WHEN doc_id % 5 = 2 THEN 'Solo' ELSE 'Ann ' || doc_id || '|Bob' END AS speakers,
  CASE WHEN doc_id % 5 = 3 THEN '' ELSE 'Conf ' || quality END AS conference,
  CASE WHEN doc_id % 5 = 3 THEN '' ELSE 'T' || toxic END AS topics FROM labels"""


def _meta_reply():
    doc, n = F.col("doc_id"), F.col("doc_id") % 5
    names = F.when(n == 2, '" Solo "').otherwise(F.concat(F.lit('["Ann '), doc, F.lit('", "", 7, " Bob "]')))
    body = F.concat(F.lit('{"speakers": '), names, F.lit(', "conference": " Conf '), F.col("quality"),
                    F.lit('", "topics": ["T'), F.col("toxic"), F.lit('", "  "]}'))
    return F.when(n == 3, "this is not json {{").when(n == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)


@query("parse_metadata", _META)
def parse_metadata(spark, sf):
    rows = views.table(spark, sf, "labels").withColumn("m", replies.parse_metadata(_meta_reply()))
    return rows.select("doc_id", F.array_join("m.speakers", "|").alias("speakers"), "m.conference", F.array_join("m.topics", "|").alias("topics"))


@query("merge_metadata", f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Manual' ELSE speakers END AS speakers,
  CASE WHEN conference = '' THEN 'given' ELSE conference END AS conference, CASE WHEN topics = '' THEN 'old' ELSE topics END AS topics
FROM ({_META}) m""")
def merge_metadata(spark, sf):
    rows = views.table(spark, sf, "labels").withColumn("m", replies.parse_metadata(_meta_reply()))
    own = {"speakers": F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("Manual"))), "conference": F.lit("given"), "topics": F.array(F.lit("old"))}
    out = replies.merge_metadata(own, F.col("m"))
    return rows.select("doc_id", F.coalesce(F.array_join(out["speakers"], "|"), F.lit("")).alias("speakers"),
                       out["conference"].alias("conference"), F.array_join(out["topics"], "|").alias("topics"))


@query("length_guard", """SELECT id, md5(CASE WHEN summary IS NULL OR length(summary) < 0.7 * length(raw_text) THEN raw_text ELSE summary END) AS kept_md5
FROM transcripts""", ["transcripts"])
def length_guard(spark, sf):
    return views.transcripts(spark, sf).select("id", F.md5(tx.length_guard(F.col("raw_text"), F.col("summary"))).alias("kept_md5"))


@query("duration_gate", """SELECT id, CASE WHEN duration > 0 AND duration < 600 THEN 'Too short (' || duration || 's < 600s minimum)'
  WHEN duration > 3000 THEN 'Too long (' || duration || 's > 3000s maximum)' END AS reason FROM videos""", ["videos"])
def duration_gate(spark, sf):
    return views.videos(spark, sf).select("id", replies.duration_gate(F.col("duration")).alias("reason"))


@query("speaker_id", """SELECT transcript_id, turn, CASE turn % 4 WHEN 0 THEN turn WHEN 1 THEN turn WHEN 2 THEN 0 ELSE 0 END AS speaker_id
FROM utterances""", ["utterances"])
def speaker_id(spark, sf):
    n = F.col("turn")
    label = (F.when(n % 4 == 0, F.concat(F.lit("speaker_"), n)).when(n % 4 == 1, n.cast("string"))
             .when(n % 4 == 2, "guest"))
    return views.utterances(spark, sf).select("transcript_id", "turn", tx.speaker_id(label).cast("long").alias("speaker_id"))


@query("media_title", """SELECT page_id, coalesce(media, source_file) AS media, CASE WHEN page_id % 2 = 0 THEN title
  ELSE regexp_replace(regexp_extract(source_file, '([^/]*)$', 1), '([^.])[.][^.]*$', '\\1') END AS title FROM sources""", ["sources"])
def media_title(spark, sf):
    title = F.when(F.col("page_id") % 2 == 0, F.col("title"))
    return views.sources(spark, sf).select("page_id", tx.media_of(F.col("media"), F.col("source_file")).alias("media"),
                                           tx.title_or_stem(title, F.col("source_file")).alias("title"))


@query("watch_url", "SELECT id, 'https://www.youtube.com/watch?v=' || video_id AS url, video_id AS back FROM videos", ["videos"])
def watch_url(spark, sf):
    url = tx.watch_url(F.col("video_id"))
    return views.videos(spark, sf).select("id", url.alias("url"), tx.video_id_of(url).alias("back"))


@query("submission_rows", """SELECT v.id, 'https://www.youtube.com/watch?v=' || video_id AS source, coalesce(category, 'misc') AS loc,
  'transcribed' AS status FROM (SELECT * FROM videos WHERE status = 'queued') v
LEFT JOIN channels c ON c.id = v.channel_id""", ["videos", "channels"])
def submission_rows(spark, sf):
    from talkloom.operators.ingest import submissions

    return submissions(views.videos(spark, sf), views.channels(spark, sf)).select("id", "source", "loc", "status")


# ---- chunks


_DOC_TEXT = "replace(text, chr(10), chr(10) || chr(10))"


def packed_sql(source, limit):
    """CTEs ending in packed(doc_id, chunk_no, n_chunks, chunk); `source` yields (doc_id, text)."""
    return f"""WITH RECURSIVE docs AS MATERIALIZED ({source}),
paras AS MATERIALIZED (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (
  SELECT doc_id, string_split(text, {NL2}) AS ps FROM docs WHERE length(text) > {limit}) a),
walk AS (SELECT doc_id, i, 0::BIGINT AS c, length(p)::BIGINT AS size FROM paras WHERE i = 0
  UNION ALL SELECT w.doc_id, p.i, CASE WHEN w.size + length(p.p) + 2 > {limit} AND w.size > 0 THEN w.c + 1 ELSE w.c END,
    CASE WHEN w.size + length(p.p) + 2 > {limit} OR w.size = 0 THEN length(p.p) ELSE w.size + 2 + length(p.p) END
  FROM walk w JOIN paras p ON p.doc_id = w.doc_id AND p.i = w.i + 1),
cut AS (SELECT w.doc_id, w.c, string_agg(p.p, {NL2} ORDER BY w.i) AS t FROM walk w JOIN paras p USING (doc_id, i)
  GROUP BY w.doc_id, w.c HAVING sum(length(p.p)) > 0),
packed AS MATERIALIZED (SELECT doc_id, 0::BIGINT AS chunk_no, 1::BIGINT AS n_chunks, text AS chunk FROM docs WHERE length(text) <= {limit}
  UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1, count(*) OVER (PARTITION BY doc_id), {strip_sql('t')} FROM cut)
"""


def _docs(spark, sf):
    docs = _spread(views.table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))


_DOCS_SQL = f"SELECT doc_id, {_DOC_TEXT} AS text FROM documents"


@query("pack_paragraphs", packed_sql(_DOCS_SQL, 5000) + "SELECT doc_id, chunk_no, n_chunks, chunk FROM packed")
def pack_paragraphs(spark, sf):
    return chunks.pack_paragraphs(_docs(spark, sf), "text")


@query("reassemble_chunks", packed_sql(_DOCS_SQL, 2000)
       + f"SELECT doc_id, string_agg(chunk, {NL2} ORDER BY chunk_no) AS text FROM packed GROUP BY doc_id")
def reassemble_chunks(spark, sf):
    return chunks.reassemble(chunks.pack_paragraphs(_docs(spark, sf), "text", 2000), ["doc_id"])


# ---- prompts


def _lit(s):
    return "'" + s.replace("'", "''") + "'"


_DESC = "substr(d.text, 1, {0})"


@query("prompt_classify", f"""SELECT d.doc_id, {_lit(prompts.CLASSIFY_HEAD)} || 'Channel category: ' || coalesce(nullif(d.lang, 'fr'), 'unknown') || chr(10)
  || 'Title: ' || 'Doc ' || d.doc_id || chr(10) || 'Channel: ' || d.source || chr(10) || 'Tags: ' || CASE WHEN d.doc_id % 2 = 0 THEN 'None' ELSE d.lang || ', x' END
  || chr(10) || 'Description:' || chr(10) || {_DESC.format(1000)} || {_lit(prompts.CLASSIFY_TAIL)} AS prompt FROM documents d""")
def prompt_classify(spark, sf):
    d = views.table(spark, sf, "documents")
    title = F.concat(F.lit("Doc "), F.col("doc_id"))
    tag = F.when(F.col("doc_id") % 2 == 1, F.array(F.col("lang"), F.lit("x")))
    category = F.when(F.col("lang") != "fr", F.col("lang"))
    return d.select("doc_id", prompts.classify(title, F.col("text"), tag, F.col("source"), category).alias("prompt"))


@query("prompt_metadata", f"""SELECT d.doc_id, {_lit(prompts.METADATA_HEAD)} || 'Title: ' || 'Doc ' || d.doc_id || chr(10) || 'Channel: ' || d.source
  || chr(10) || 'Tags: None' || chr(10) || 'Description:' || chr(10) || {_DESC.format(800)} || {_lit(prompts.METADATA_TAIL)} AS prompt FROM documents d""")
def prompt_metadata(spark, sf):
    d = views.table(spark, sf, "documents")
    none = F.lit(None).cast("array<string>")
    return d.select("doc_id", prompts.metadata(F.concat(F.lit("Doc "), F.col("doc_id")), F.col("text"), F.col("source"), none).alias("prompt"))


def _section_sql(name, k, ranked=False, variations=False):
    order = "detail::BIGINT DESC, first, item" if ranked else "first, item"
    item = "item || ': ' || detail" if variations else "item"
    sep = "chr(10)" if variations else "', '"
    return f"(SELECT string_agg({item}, {sep} ORDER BY {order}) FROM (SELECT * FROM ctx WHERE section = '{name}' ORDER BY {order} LIMIT {k}) s)"


def _opt_sql(label, e, sep="': '"):
    return f"coalesce('{label}: ' || nullif({e}, '') || chr(10), '')"


_CONTEXT_LINES = "c.lines"
_CONTEXT_CTE = f"""ctx AS MATERIALIZED ({_CONTEXT_ROWS}),
c AS MATERIALIZED (SELECT {_opt_sql('Transcripts known', _section_sql('video_count', 1))} || {_opt_sql('Common topics', _section_sql('frequent_tags', 15, True))}
  || {_opt_sql('Terms', _section_sql('technical_terms', 20))} || {_opt_sql('Projects', _section_sql('project_names', 15))}
  || {_opt_sql('Frequent speakers', _section_sql('common_speakers', 10))} || {_opt_sql('Categories', _section_sql('common_categories', 8, True))}
  || {_opt_sql('Areas', _section_sql('expertise_areas', 8))} || {_opt_sql('Domain', _section_sql('domain_context', 1))}
  || coalesce('Spellings:' || chr(10) || {_section_sql('tag_variations', 5, variations=True)} || chr(10), '') AS lines)
"""


def _correct_sql(chunk, description):
    return f"""{_lit(prompts.CORRECT_HEAD)} || 'Title: Doc ' || p.doc_id || chr(10) || {_opt_sql('Description', description)}
  || {_CONTEXT_LINES} || {_lit(prompts.TEXT_START)} || {strip_sql(chunk)} || {_lit(prompts.TEXT_END)} || {_lit(prompts.CORRECT_TAIL)}"""


def _about():
    none = F.lit(None).cast("array<string>")
    return {"title": F.concat(F.lit("Doc "), F.col("doc_id")), "speakers": none, "tags": none, "categories": none,
            "description": F.col("text")}


def context_struct(spark, sf):
    """The bounded context as one struct: written once, then read by a one-row scalar subquery."""
    one = materialise(tags.prompt_context(_context(spark, sf)), "prompt-context")
    return one.select(F.struct(*one.columns).alias("context")).scalar()


@query("prompt_context", "WITH " + _CONTEXT_CTE + f"SELECT doc_id, {_CONTEXT_LINES} AS lines FROM documents, c", ["item_tags"])
def prompt_context(spark, sf):
    """Corpus context next to every document, from one scalar subquery."""
    docs = views.table(spark, sf, "documents").select("doc_id").withColumn("context", context_struct(spark, sf))
    return docs.select("doc_id", prompts.context_lines(F.col("context")).alias("lines"))


_CUT = "CASE WHEN length(d.text) > 200 THEN substr(d.text, 1, 200) || '...' ELSE d.text END"
_CHUNKED = packed_sql(_DOCS_SQL, 5000).rstrip() + ",\n" + _CONTEXT_CTE


@query("prompt_correct", _CHUNKED + f"""SELECT p.doc_id, p.chunk_no, md5({_correct_sql('p.chunk', _CUT)}) AS prompt_md5
FROM packed p JOIN ({_DOCS_SQL}) d ON d.doc_id = p.doc_id, c""", ["item_tags"])
def prompt_correct(spark, sf):
    shown = {**_about(), "description": prompts.shorten(F.col("text"))}
    rows = _docs(spark, sf).select("doc_id", "text", *[e.alias(f"_{n}") for n, e in shown.items()])
    packed = chunks.pack_paragraphs(rows, "text")
    about = {n: F.col(f"_{n}") for n in _about()}
    prompt = prompts.correct(F.col("chunk"), about, context_struct(spark, sf))
    return packed.select("doc_id", "chunk_no", F.md5(prompt).alias("prompt_md5"))


@query("prompt_summarize", packed_sql(_DOCS_SQL, 3000) + f"""SELECT p.doc_id, p.chunk_no, md5(CASE WHEN n_chunks > 1
  THEN {_lit(prompts.SUMMARY_PART)} || chr(10) ELSE {_lit(prompts.SUMMARY_WHOLE)} || chr(10) || 'Title: Doc ' || p.doc_id || chr(10) END
  || {_lit(prompts.TEXT_START)} || chunk || {_lit(prompts.TEXT_END)}) AS prompt_md5,
  md5({_lit(prompts.SUMMARY_FINAL)} || chr(10) || 'Title: Doc ' || p.doc_id || chr(10) || {_lit(prompts.TEXT_START)} || chunk || {_lit(prompts.TEXT_END)}) AS final_md5
FROM packed p""")
def prompt_summarize(spark, sf):
    packed = chunks.pack_paragraphs(_docs(spark, sf), "text", 3000)
    title, chunk = F.concat(F.lit("Doc "), F.col("doc_id")), F.col("chunk")
    prompt = F.when(F.col("n_chunks") > 1, prompts.summarise_part(chunk)).otherwise(prompts.summarise_whole(chunk, title))
    return packed.select("doc_id", "chunk_no", F.md5(prompt).alias("prompt_md5"), F.md5(prompts.summarise_final(chunk, title)).alias("final_md5"))


# ---- model stages, with deterministic functions in place of a model


START, END = prompts.TEXT_START, prompts.TEXT_END


def _inner(prompt):
    return prompt.split(START, 1)[1].rsplit(END, 1)[0]


def editing_model():
    """Replaces a letter; refuses some texts and cuts others short."""

    def run(batch):
        out = []
        for p in batch:
            t = _inner(p)
            if len(t) % 7 == 0:
                raise RuntimeError("refused")
            out.append(t[:10] if len(t) % 5 == 0 else t.replace("e", "E"))
        return out

    return run


def digest_model():
    """A digest of the whole text, nothing for some."""

    def run(batch):
        return ["" if len(_inner(p)) % 4 == 0 else hashlib.md5(_inner(p).encode()).hexdigest() for p in batch]

    return run


def naming_model():
    """A name from a digest of the whole prompt, no JSON for some."""

    def run(batch):
        marks = [ord(hashlib.md5(p.encode()).hexdigest()[0]) for p in batch]
        return ['{"speakers": ["S' + str(m % 3) + '"], "conference": "C", "topics": []}' if m % 5 else "oops" for m in marks]

    return run


@query("model_stage", f"""SELECT doc_id, CASE WHEN length(t) % 7 = 0 THEN NULL WHEN length(t) % 5 = 0 THEN substr(t, 1, 10) ELSE replace(t, 'e', 'E') END AS reply,
  CASE WHEN length(t) % 7 = 0 THEN 'RuntimeError: refused' END AS error FROM (SELECT doc_id, text AS t FROM ({_DOCS_SQL}) d) x""")
def model_stage(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.concat(F.lit(prompts.TEXT_START), F.col("text"), F.lit(prompts.TEXT_END)).alias("prompt"))
    return model.model_stage(rows, editing_model, "prompt").select("doc_id", "reply", "error")


@query("correct_documents", packed_sql(_DOCS_SQL, 5000) + f"""SELECT doc_id, string_agg(CASE WHEN length(t) % 7 = 0 OR length(t) % 5 = 0 AND 10 < 0.7 * length(chunk)
    THEN chunk WHEN length(t) % 5 = 0 THEN substr(t, 1, 10) WHEN length(t) < 0.7 * length(chunk) THEN chunk ELSE replace(t, 'e', 'E') END, {NL2} ORDER BY chunk_no) AS text
FROM (SELECT *, {strip_sql('chunk')} AS t FROM packed) p GROUP BY doc_id""")
def correct_documents(spark, sf):
    return model.correct_documents(_docs(spark, sf), "doc_id", "text", _about(), context_struct(spark, sf), editing_model)


_SUM_SRC = "SELECT id AS doc_id, replace(coalesce(corrected_text, raw_text), chr(10), chr(10) || chr(10)) AS text FROM transcripts"


@query("summarize_documents", packed_sql(_SUM_SRC, 3000) + """,
part AS (SELECT doc_id, chunk_no, CASE WHEN length(chunk) % 4 = 0 THEN '' ELSE md5(chunk) END AS r FROM packed),
merged AS (SELECT doc_id, count(*) FILTER (r <> '') AS n, string_agg(r, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_no) FILTER (r <> '') AS t FROM part GROUP BY doc_id)
SELECT doc_id AS id, CASE WHEN n = 0 THEN '' WHEN n = 1 THEN t WHEN length(t) % 4 = 0 THEN '' ELSE md5(t) END AS summary FROM merged""", ["transcripts"])
def summarize_documents(spark, sf):
    t = views.transcripts(spark, sf).select("id", "title", "raw_text", "corrected_text")
    docs = t.select("id", "title", *[F.regexp_replace(c, "\n", "\n\n").alias(c) for c in ("raw_text", "corrected_text")])
    return model.summarise_documents(docs, "id", "corrected_text", "raw_text", "title", digest_model, 3000)


_META_PROMPT = f"""{_lit(prompts.METADATA_HEAD)} || 'Title: ' || title || chr(10) || 'Channel: ' || loc || chr(10) || 'Tags: None' || chr(10)
  || 'Description:' || chr(10) || substr(raw_text, 1, 800) || {_lit(prompts.METADATA_TAIL)}"""


@query("extract_metadata", f"""SELECT id, CASE WHEN id % 4 = 0 THEN 'Manual' WHEN id % 3 = 0 OR n % 5 = 0 THEN '' ELSE 'S' || n % 3 END AS speakers,
  CASE WHEN id % 3 = 0 OR n % 5 = 0 THEN NULL ELSE 'C' END AS conference FROM (SELECT id, ascii(substr(md5({_META_PROMPT}), 1, 1)) AS n FROM transcripts) t""", ["transcripts"])
def extract_metadata(spark, sf):
    none = F.lit(None).cast("array<string>")
    platform = F.when(F.col("id") % 3 != 0, F.struct(F.col("raw_text").alias("description"), none.alias("tags"), F.col("loc").alias("channel_name")))
    docs = views.transcripts(spark, sf).select(
        "id", "title", platform.alias("youtube"), F.when(F.col("id") % 4 == 0, F.array(F.lit("Manual"))).alias("speakers"),
        F.lit(None).cast("string").alias("conference"), none.alias("topics"))
    out = model.extract_metadata(docs, "youtube", naming_model)
    return out.select("id", F.coalesce(F.array_join("speakers", "|"), F.lit("")).alias("speakers"), "conference")


# ---- time windows


@query("chunk_windows", """SELECT id, chunk_no, chunk_no * 1170.0::DOUBLE AS start_s, least(chunk_no * 1170.0 + 1200.0, dur)::DOUBLE AS end_s
FROM (SELECT id, duration * 2.5::DOUBLE AS dur, unnest(range(greatest(ceil((duration * 2.5 - 1200) / 1170), 0)::BIGINT + 1)) AS chunk_no
  FROM videos WHERE duration > 0) v""", ["videos"])
def chunk_windows(spark, sf):
    v = views.videos(spark, sf).select("id", (F.col("duration") * F.lit(2.5)).alias("dur"))
    return chunks.chunk_windows(v, "dur").select("id", "chunk_no", "start_s", "end_s")


@query("combine_chunks", """SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY chunk_no, pos) - 1 AS item_no, chunk_no, pos,
  start_s + chunk_no * 56.0::DOUBLE AS start_s, end_s + chunk_no * 56.0::DOUBLE AS end_s FROM chunk_words WHERE chunk_no = 0 OR end_s >= 8""", ["chunk_words"])
def combine_chunks(spark, sf):
    out = chunks.combine_chunks(views.chunk_words(spark, sf), views.CHUNK_SECONDS, views.CHUNK_OVERLAP)
    return out.select("transcript_id", "item_no", "chunk_no", "pos", "start_s", "end_s")


@query("global_speakers", """SELECT transcript_id, speaker::BIGINT AS speaker, row_number() OVER (PARTITION BY transcript_id ORDER BY f) - 1 AS global_speaker
FROM (SELECT transcript_id, speaker, min(chunk_no * 10000000 + pos) AS f FROM chunk_words GROUP BY 1, 2) x""", ["chunk_words"])
def global_speakers(spark, sf):
    out = chunks.global_speakers(views.chunk_words(spark, sf))
    return out.select("transcript_id", F.col("speaker").cast("long").alias("speaker"), F.col("global_speaker").cast("long").alias("global_speaker"))


@query("overlap_matches", """SELECT DISTINCT c.transcript_id, c.chunk_no, c.pos, c.speaker::BIGINT AS speaker, c.start_s + c.chunk_no * 56.0::DOUBLE AS start_s
FROM chunk_words c JOIN chunk_words p ON p.transcript_id = c.transcript_id AND p.chunk_no = c.chunk_no - 1 AND p.end_s > 56
  AND abs((p.start_s - 56) - c.start_s) < 8""", ["chunk_words"])
def overlap_matches(spark, sf):
    out = chunks.overlap_matches(views.chunk_words(spark, sf), views.CHUNK_SECONDS, views.CHUNK_OVERLAP)
    return out.withColumn("speaker", F.col("speaker").cast("long"))


@query("concat_summaries", """SELECT transcript_id, turn // 256 AS part_no, string_agg(CASE WHEN turn = 0 THEN '' ELSE ' ' END || s, '' ORDER BY turn) AS text
FROM (SELECT conv_id AS transcript_id, turn, trim(text) AS s FROM conversations) x GROUP BY 1, 2""")
def concat_summaries(spark, sf):
    parts = views.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("transcript_id"), "turn", F.trim("text").alias("s"))
    return render.concat_summaries(parts, "turn", "s")
