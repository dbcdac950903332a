"""Queries over timed words, sentences and chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.operators import timeline
from talkloom.plans import flows, views
from talkloom.plans.registry import query
from talkloom.scratch import materialise


def _ints(df, *cols):
    return df.select(*[F.col(c).cast("long").alias(c) if c in cols else F.col(c) for c in df.columns])


def repaired_sentences(spark, sf):
    split = timeline.sentences(timeline.mark_words(views.words(spark, sf)))
    return timeline.repair_sentences(materialise(split, "sentences"))


@query(
    "speaker_segments",
    """SELECT transcript_id, seg_no, (pos - seg_first) // 4096 AS part_no, min(speaker)::BIGINT AS speaker,
  min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_words, string_agg(punctuated_word, ' ' ORDER BY pos) AS text
FROM (SELECT *, min(pos) OVER (PARTITION BY transcript_id, seg_no) AS seg_first FROM marked) m GROUP BY 1, 2, 3""",
    ["marked"],
)
def speaker_segments(spark, sf):
    return _ints(timeline.speaker_segments(views.words(spark, sf)), "speaker")


@query(
    "sentence_align",
    """SELECT transcript_id, seg_no, sent_no, (pos - sent_first) // 4096 AS part_no, min(speaker)::BIGINT AS speaker,
  min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_words, string_agg(punctuated_word, ' ' ORDER BY pos) AS text
FROM (SELECT *, min(pos) OVER (PARTITION BY transcript_id, sent_no) AS sent_first FROM marked) m GROUP BY 1, 2, 3, 4""",
    ["marked"],
)
def sentence_align(spark, sf):
    return _ints(timeline.sentence_texts(views.words(spark, sf)), "speaker")


@query(
    "fix_broken",
    """SELECT transcript_id, sent_no, seg_no, seg_first, speaker::BIGINT AS speaker, start_s, end_s, first_pos, last_pos, n_joins
FROM repaired""",
    ["repaired"],
)
def fix_broken(spark, sf):
    return _ints(repaired_sentences(spark, sf), "speaker")


@query(
    "merge_speakers",
    """SELECT transcript_id, seg_no, min(speaker)::BIGINT AS speaker, min(start_s) AS start_s, max(end_s) AS end_s,
  count(*) AS n_rows
FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY transcript_id ORDER BY turn) - 1 AS BIGINT) AS seg_no
  FROM (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY transcript_id ORDER BY turn) = speaker THEN 0 ELSE 1 END AS n
    FROM utterances) a) b GROUP BY 1, 2""",
    ["utterances"],
)
def merge_speakers(spark, sf):
    return _ints(timeline.merge_speakers(views.utterances(spark, sf), "turn"), "speaker")


_CHAPTER_SENTENCE = """SELECT c.transcript_id, c.chapter_no, c.start_s, c.title, f.sent_no, s.start_s AS sent_start,
  s.end_s AS sent_end FROM chapters c LEFT JOIN (
  SELECT c.transcript_id, c.chapter_no, min(s.sent_no) AS sent_no FROM chapters c JOIN sents s
    ON c.transcript_id = s.transcript_id AND c.start_s BETWEEN s.start_s AND s.end_s
  GROUP BY c.transcript_id, c.chapter_no) f ON f.transcript_id = c.transcript_id AND f.chapter_no = c.chapter_no
LEFT JOIN sents s ON s.transcript_id = f.transcript_id AND s.sent_no = f.sent_no"""


@query("chapter_sentence", _CHAPTER_SENTENCE, ["chapters", "sents"])
def chapter_sentence(spark, sf):
    words = materialise(views.words(spark, sf), "words")
    chapters = materialise(views.chapters_of(views.utterances_of(words)), "chapters")
    return timeline.chapter_sentence(chapters, timeline.sentences(timeline.mark_words(words)))


@query("snap_chapters", "SELECT transcript_id, chapter_no, start_s, title FROM snapped", ["snapped"])
def snap_chapters(spark, sf):
    done = finalised(spark, sf)
    return done.chapters


@query(
    "chapter_asof",
    """SELECT p.*, CAST(CASE WHEN first_no < 1000000000 THEN first_no END AS BIGINT) AS first_turn
FROM (SELECT transcript_id, chapter_no, start_s, title, CAST(max(first_no) OVER w AS BIGINT) AS shared_turn,
    CAST(chapter_no + max(first_no - chapter_no) OVER w AS BIGINT) AS cascade_turn, first_no
  FROM (SELECT c.transcript_id, c.chapter_no, c.start_s, c.title, coalesce(min(u.turn), 1000000000) AS first_no
    FROM chapters c LEFT JOIN utterances u ON c.transcript_id = u.transcript_id AND u.start_s >= c.start_s GROUP BY ALL) d
  WINDOW w AS (PARTITION BY transcript_id ORDER BY chapter_no)) p
JOIN (SELECT transcript_id, max(turn) AS last_no FROM utterances GROUP BY transcript_id) n
  ON n.transcript_id = p.transcript_id AND p.cascade_turn <= n.last_no""".replace(
        "SELECT p.*, CAST(CASE WHEN first_no < 1000000000 THEN first_no END AS BIGINT) AS first_turn",
        "SELECT p.transcript_id, p.chapter_no, p.start_s, p.title, p.shared_turn, p.cascade_turn",
    ),
    ["chapters", "utterances"],
)
def chapter_asof(spark, sf):
    rows = materialise(views.utterances(spark, sf), "utterances")
    chapters = views.chapters_of(rows)
    one = timeline.place_chapters(chapters, rows, "turn").withColumnRenamed("turn", "cascade_turn")
    shared = timeline.place_chapters(chapters, rows, "turn", cascade=False)
    return one.join(
        shared.select("transcript_id", "chapter_no", F.col("turn").alias("shared_turn")),
        ["transcript_id", "chapter_no"],
    )


@query(
    "words_in_utterances",
    """SELECT w.transcript_id, w.pos, min(u.turn) AS turn FROM words w JOIN utterances u
  ON w.transcript_id = u.transcript_id AND w.start_s >= u.start_s AND w.end_s <= u.end_s + 0.5 GROUP BY 1, 2""",
    ["words", "utterances"],
)
def words_in_utterances(spark, sf):
    return timeline.words_in_utterances(views.words(spark, sf), views.utterances(spark, sf), "turn")


@query("has_diarization", """SELECT transcript_id, bool_or(speaker IS NOT NULL) AS has_diarization
FROM words GROUP BY 1""", ["words"])
def has_diarization(spark, sf):
    return timeline.has_diarization(views.words(spark, sf))


@query(
    "confidence_runs",
    """SELECT transcript_id, sent_no, run_no, part_no, confidence, count(*) AS n_words,
  string_agg(punctuated_word, ' ' ORDER BY pos) || CASE WHEN part_no = max(part_no) OVER (PARTITION BY transcript_id, run_no)
    THEN '[' || confidence || ']' ELSE '' END AS text
FROM (SELECT *, (pos - min(pos) OVER (PARTITION BY transcript_id, run_no)) // 4096 AS part_no
  FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY transcript_id ORDER BY pos) - 1 AS BIGINT) AS run_no
    FROM (SELECT *, CASE WHEN lag(sent_no) OVER o = sent_no AND lag(confidence) OVER o = confidence THEN 0 ELSE 1 END AS n
      FROM (SELECT *, round_even(speaker_confidence, 3) AS confidence FROM marked) c
      WINDOW o AS (PARTITION BY transcript_id ORDER BY pos)) a) b) d
GROUP BY transcript_id, sent_no, run_no, part_no, confidence""",
    ["marked"],
)
def confidence_runs(spark, sf):
    return timeline.confidence_runs(views.words(spark, sf))


_HMS = "printf('%02d:%02d:%02d', ({0})::BIGINT // 3600, ({0})::BIGINT // 60 % 60, ({0})::BIGINT % 60)"


def _hms_sql(col):
    return _HMS.format(f"floor({col})")


def _render_sql(per_line):
    stamp = "'Speaker ' || speaker || ': ' || {} || chr(10) || chr(10)"
    gap = "chr(10)" if per_line else "' '"
    return f"""WITH heads AS (
  SELECT r.transcript_id, r.first_pos AS pos, CASE WHEN r.sent_no = r.seg_first
    THEN CASE WHEN r.sent_no = 0 THEN '' ELSE chr(10) || chr(10) END
      || coalesce('## ' || p.title || chr(10) || chr(10), '') || {stamp.format(_hms_sql('r.start_s'))}
    WHEN p.title IS NOT NULL THEN chr(10) || chr(10) || '## ' || p.title || chr(10) || chr(10)
      || {stamp.format(_hms_sql('p.start_s'))}
    ELSE {gap} END AS head
  FROM repaired r LEFT JOIN placed p ON p.transcript_id = r.transcript_id AND p.sent_no = r.sent_no)
SELECT w.transcript_id, w.pos // 4096 AS part_no, string_agg(coalesce(h.head, ' ') || w.punctuated_word, '' ORDER BY w.pos) AS text
FROM words w LEFT JOIN heads h ON h.transcript_id = w.transcript_id AND h.pos = w.pos GROUP BY 1, 2"""


def finalised(spark, sf):
    # Words and chapters are views here; a job over stored tables passes those.
    words = materialise(views.words(spark, sf), "words")
    chapters = materialise(views.chapters_of(views.utterances_of(words)), "chapters")
    return flows.finalise(words, chapters)


def finished_transcript(spark, sf, per_line=True):
    return finalised(spark, sf).transcript(per_line)


@query("render_transcript", _render_sql(True), ["words", "repaired", "placed"])
def render_transcript(spark, sf):
    return finished_transcript(spark, sf)


@query("render_transcript_flow", _render_sql(False), ["words", "repaired", "placed"])
def render_transcript_flow(spark, sf):
    return finished_transcript(spark, sf, per_line=False)
