"""The domain views as SQL over the plain tables (see views.py for the Spark side)."""

from __future__ import annotations

from collections.abc import Sequence

# name -> (views it needs, SELECT)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "channels": (
        (),
        """SELECT s_suppkey AS id, concat('UC', s_suppkey) AS channel_id, s_name AS channel_name,
  CASE s_nationkey % 4 WHEN 0 THEN 'conference' WHEN 1 THEN 'podcast' WHEN 2 THEN 'education' END AS category,
  s_nationkey % 5 + 1 AS priority, s_acctbal >= 0 AS is_active,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-15 00:00:00' END AS last_scanned_at
FROM supplier""",
    ),
    "videos": (
        (),
        """SELECT event_id AS id, concat('v', event_id) AS video_id,
  user_id % (SELECT count(*) FROM supplier) AS channel_id, concat(event_type, ' ', user_id) AS title,
  CAST(ts AS TIMESTAMP) AS published_at, CAST(floor(value * 10) AS INT) AS duration,
  CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'classified' WHEN 'signup' THEN 'queued'
    WHEN 'purchase' THEN 'transcribed' ELSE 'skipped' END AS status,
  CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN false ELSE true END AS is_technical
FROM events""",
    ),
    "runs": (
        ("videos",),
        """SELECT CAST(day(published_at) AS INT) AS id, 'classify' AS run_type,
  CASE WHEN day(published_at) % 5 > 0 THEN day(published_at) % 100 END AS channel_id,
  count(*) AS videos_discovered, min(published_at) AS started_at, max(published_at) AS completed_at
FROM videos GROUP BY day(published_at)""",
    ),
    "transcripts": (
        (),
        """SELECT d.doc_id AS id, concat('Doc_', d.doc_id, ' ', d.lang) AS title, d.source AS loc, d.lang,
  d.text AS raw_text, CASE WHEN l.quality = 1 THEN replace(d.text, 'e', 'E') END AS corrected_text,
  CASE WHEN l.toxic = 1 THEN md5(d.text) END AS summary
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "sources": (
        (),
        """SELECT page_id, url AS source_file, regexp_extract(html, 'lang="([a-z]+)"', 1) AS loc,
  regexp_extract(html, '<title>([^<]*)', 1) AS title,
  CASE WHEN page_id % 3 > 0 THEN regexp_replace(url, '[?].*$', '') END AS media
FROM pages""",
    ),
    "existing_media": ((), "SELECT url AS media FROM pages WHERE page_id % 5 = 0"),
    "replies": (
        (),
        """SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN concat('```json', chr(10), '{"is_technical": ', CASE quality WHEN 1 THEN 'true' ELSE 'false' END,
    ', "confidence": 0.75, "reason": "ok"}', chr(10), '```')
  WHEN 1 THEN concat('Sure: {"is_technical": ', CASE quality WHEN 1 THEN 'true' ELSE 'false' END, ', "confidence": 1.5}')
  WHEN 2 THEN 'not json {{'
  ELSE '{"is_technical": true, "confidence": 0.5, "reason": " low "}' END AS reply
FROM labels""",
    ),
    "item_tags": (
        (),
        """SELECT p_partkey AS item_id, 0 AS seq, 'manual' AS kind,
  CASE p_partkey % 3 WHEN 0 THEN lower(p_type) ELSE p_type END AS tag FROM part
UNION ALL SELECT p_partkey, 1, 'platform', p_brand FROM part
UNION ALL SELECT p_partkey, 2, 'category', split_part(p_name, ' ', 2) FROM part
UNION ALL SELECT p_partkey, 3, 'speaker', split_part(p_name, ' ', 1) FROM part""",
    ),
    "words": (
        (),
        """SELECT conv_id AS transcript_id, turn, CASE WHEN turn % 4 < 2 THEN 0 ELSE 1 END AS speaker, pos,
  w AS punctuated_word, pos * 0.375::DOUBLE AS start_s, pos * 0.375::DOUBLE + 0.25::DOUBLE AS end_s,
  ((pos % 8) + 1) / 16.0::DOUBLE AS speaker_confidence
FROM (SELECT conv_id, turn, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS pos
  FROM (SELECT conv_id, turn, unnest(a) AS w, unnest(range(len(a))) AS i
    FROM (SELECT conv_id, turn, string_split_regex(trim(text), '[ \\n\\t\\r]+') AS a FROM conversations) s) x
  WHERE w <> '') y""",
    ),
    "utterances": (
        ("words",),
        """SELECT transcript_id, turn, min(speaker) AS speaker, min(start_s) AS start_s, max(end_s) AS end_s
FROM words GROUP BY transcript_id, turn""",
    ),
    "chapters": (
        ("utterances",),
        """SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY turn) - 1 AS chapter_no,
  start_s + 0.125 * (turn % 4) AS start_s, concat('Topic ', turn) AS title
FROM utterances WHERE turn % 3 = 1""",
    ),
    "chunk_words": (
        ("words",),
        """SELECT w.transcript_id, k.chunk_no, w.pos, w.speaker, w.punctuated_word,
  w.start_s - k.chunk_no * 56 AS start_s, w.end_s - k.chunk_no * 56 AS end_s
FROM words w
JOIN (SELECT transcript_id, max(end_s) AS dur FROM words GROUP BY transcript_id) m ON w.transcript_id = m.transcript_id
JOIN (SELECT range AS chunk_no FROM range((SELECT CAST(floor(max(end_s) / 56) AS BIGINT) + 1 FROM words))) k
  ON w.start_s >= k.chunk_no * 56 AND w.start_s < k.chunk_no * 56 + 64
WHERE k.chunk_no = 0 OR k.chunk_no * 56 + 8 < m.dur""",
    ),
    # Words with their segment and sentence number.
    "marked": (
        ("words",),
        """SELECT * EXCLUDE (nseg, nsent), CAST(sum(nseg) OVER o - 1 AS BIGINT) AS seg_no,
  CAST(sum(nsent) OVER o - 1 AS BIGINT) AS sent_no
FROM (SELECT *, CASE WHEN lag(pos) OVER o IS NULL OR speaker <> lag(speaker) OVER o THEN 1 ELSE 0 END AS nseg,
    CASE WHEN lag(pos) OVER o IS NULL OR speaker <> lag(speaker) OVER o OR (
      regexp_matches(lag(punctuated_word) OVER o, '[.?…-]$')
      AND NOT regexp_matches(lag(punctuated_word) OVER o, '[\\p{L}\\p{N}_]\\.[\\p{L}\\p{N}_].$')
      AND NOT regexp_matches(lag(punctuated_word) OVER o, '[A-Z][a-z]\\.$')) THEN 1 ELSE 0 END AS nsent
  FROM words WINDOW o AS (PARTITION BY transcript_id ORDER BY pos)) f
WINDOW o AS (PARTITION BY transcript_id ORDER BY pos)""",
    ),
    "sents": (
        ("marked",),
        """SELECT transcript_id, sent_no, min(seg_no) AS seg_no, min(speaker) AS speaker,
  min_by(start_s, pos) AS start_s, max_by(end_s, pos) AS end_s, min(pos) AS first_pos, max(pos) AS last_pos,
  max_by(regexp_matches(punctuated_word, '[.?,…]$'), pos) AS closed,
  min_by(speaker_confidence, pos) AS first_conf, max_by(speaker_confidence, pos) AS last_conf
FROM marked GROUP BY transcript_id, sent_no""",
    ),
    # Sentences with their unit, the run of sentences joined into one.
    "sent_runs": (
        ("sents",),
        """SELECT *, min(start_s) OVER (PARTITION BY transcript_id, unit_no) AS run_start,
  lag(end_s) OVER (PARTITION BY transcript_id, unit_no ORDER BY sent_no) AS run_prev_end
FROM (SELECT *, CAST(sum(opens) OVER (PARTITION BY transcript_id ORDER BY sent_no) - 1 AS BIGINT) AS unit_no
  FROM (SELECT *, CASE WHEN lag(seg_no) OVER o <> seg_no AND NOT lag(closed) OVER o
      AND abs(lag(last_conf) OVER o - first_conf) > 0 THEN 0 ELSE 1 END AS opens
    FROM sents WINDOW o AS (PARTITION BY transcript_id ORDER BY sent_no)) b) u""",
    ),
    "repaired": (
        ("sent_runs",),
        """SELECT * EXCLUDE (opens, nseg), min(sent_no) OVER (PARTITION BY transcript_id, seg_no) AS seg_first
FROM (SELECT *, CAST(sum(nseg) OVER (PARTITION BY transcript_id ORDER BY sent_no) - 1 AS BIGINT) AS seg_no
  FROM (SELECT *, 1 AS opens, CASE WHEN lag(speaker) OVER (PARTITION BY transcript_id ORDER BY sent_no) = speaker
      THEN 0 ELSE 1 END AS nseg
    FROM (SELECT transcript_id, unit_no AS sent_no,
        max_by(speaker, sent_no) FILTER (run_prev_end IS NULL OR end_s - start_s >= run_prev_end - run_start) AS speaker,
        min(run_start) AS start_s, max_by(end_s, sent_no) AS end_s, min(first_pos) AS first_pos,
        max(last_pos) AS last_pos, count(*) - 1 AS n_joins
      FROM sent_runs GROUP BY transcript_id, unit_no) g) h) k""",
    ),
    "snapped": (
        ("chapters", "repaired"),
        """SELECT c.transcript_id, c.chapter_no, c.title, CASE WHEN s.sent_no IS NULL THEN c.start_s
  WHEN c.start_s >= (s.start_s + s.end_s) / 2 THEN s.end_s ELSE s.start_s END AS start_s
FROM chapters c LEFT JOIN (
  SELECT c.transcript_id, c.chapter_no, min(s.sent_no) AS sent_no FROM chapters c JOIN repaired s
    ON c.transcript_id = s.transcript_id AND c.start_s BETWEEN s.start_s AND s.end_s
  GROUP BY c.transcript_id, c.chapter_no) f ON f.transcript_id = c.transcript_id AND f.chapter_no = c.chapter_no
LEFT JOIN repaired s ON s.transcript_id = f.transcript_id AND s.sent_no = f.sent_no""",
    ),
    # Chapters with the sentence they go before, one chapter per sentence.
    "placed": (
        ("snapped", "repaired"),
        """SELECT p.* FROM (SELECT transcript_id, chapter_no, start_s, title, chapter_no + max(first_no - chapter_no)
    OVER (PARTITION BY transcript_id ORDER BY chapter_no) AS sent_no
  FROM (SELECT c.transcript_id, c.chapter_no, c.start_s, c.title,
      coalesce(min(s.sent_no), 1000000000) AS first_no
    FROM snapped c LEFT JOIN repaired s ON c.transcript_id = s.transcript_id AND s.start_s >= c.start_s
    GROUP BY ALL) d) p
JOIN (SELECT transcript_id, max(sent_no) AS last_no FROM repaired GROUP BY transcript_id) n
  ON n.transcript_id = p.transcript_id AND p.sent_no <= n.last_no""",
    ),
}


def with_views(names: Sequence[str], sql: str) -> str:
    """Put the views, and what they need, in front of `sql` (which may start with WITH itself)."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            needs, select = VIEWS[name]
            for n in needs:
                add(n)
            done[name] = f"{name} AS MATERIALIZED (\n{select})"

    for n in names:
        add(n)
    body = sql.strip()
    ctes = list(done.values())
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE"):].strip()
    if body.upper().startswith("WITH"):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[len("WITH"):].strip()
    return "WITH " + ",\n".join(ctes) + "\n" + body
