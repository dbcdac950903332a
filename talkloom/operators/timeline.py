"""Timed words to speaker segments, sentences, repaired sentences and placed chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions.text import WHITE
from talkloom.operators.intervals import first_at_or_after, points_in_intervals
from talkloom.operators.ordered import islands, ordered_scan

KEY = ["transcript_id"]
BLOCK_ROWS = 4096  # rows per block of a long sequence, and words per text part

# A sentence may end after these; a sentence ending in none of the second set, with
# a different speaker confidence on the other side, runs on into the next speaker's segment.
SENTENCE_END = [".", "?", "…", "-"]
ABBREVIATION = "[\\p{L}\\p{N}_]\\.[\\p{L}\\p{N}_].\\z"
SHORT_TITLE = "[A-Z][a-z]\\.\\z"
CLOSED_END = [".", "?", ",", "…"]


def row_block(no: str = "pos") -> Column:
    return F.floor(F.col(no) / BLOCK_ROWS)


def ends_sentence(word: Column) -> Column:
    """Whether text may be split after `word`: the whitespace split pattern, seen from one word."""
    # The cheap test first: patterns are tried only on words that end like a sentence.
    return F.substring(word, -1, 1).isin(SENTENCE_END) & ~word.rlike(ABBREVIATION) & ~word.rlike(SHORT_TITLE)


def _flagged(words: DataFrame, diarize: bool) -> DataFrame:
    speaker = F.col("speaker") if diarize else F.lit(None).cast("int")
    return words.withColumn("speaker", speaker).withColumn("_ends", ends_sentence(F.col("punctuated_word")))


def _new_segment(prev, cur) -> Column:
    return ~prev("speaker").eqNullSafe(cur("speaker"))


def _new_sentence(prev, cur) -> Column:
    return _new_segment(prev, cur) | prev("_ends")


def mark_words(words: DataFrame, diarize: bool = True) -> DataFrame:
    """Number the segment and sentence of every word in one scan.

    Segments change with the speaker; a sentence ends with its segment or after a closing word, which
    is what splitting the joined text at whitespace gives, since words hold none.
    """
    marked = islands(
        _flagged(words, diarize),
        KEY,
        ["pos"],
        row_block(),
        ["speaker", "_ends", "pos"],
        {"seg_no": _new_segment, "sent_no": _new_sentence},
        origins={"seg_first": ("seg_no", "pos"), "sent_first": ("sent_no", "pos")},
    )
    return marked.drop("_ends")


def _texts(marked: DataFrame, no: list[str], first: str) -> DataFrame:
    """Text of every run in parts of at most BLOCK_ROWS words, with the times of the part."""
    part = F.floor((F.col("pos") - F.col(first)) / BLOCK_ROWS).cast("long").alias("part_no")
    grouped = marked.groupBy(*KEY, *no, part).agg(
        F.first("speaker").alias("speaker"),
        F.min_by("start_s", "pos").alias("start_s"),
        F.max_by("end_s", "pos").alias("end_s"),
        F.count("*").alias("n_words"),
        F.array_sort(F.collect_list(F.struct("pos", "punctuated_word"))).alias("_ws"),
    )
    text = F.array_join(F.transform("_ws", lambda w: w["punctuated_word"]), " ")
    return grouped.withColumn("text", text).drop("_ws")


def speaker_segments(words: DataFrame, diarize: bool = True) -> DataFrame:
    """Segments with text; an ordinary segment is one row with part_no 0."""
    return _texts(mark_words(words, diarize), ["seg_no"], "seg_first")


def sentence_texts(words: DataFrame, diarize: bool = True) -> DataFrame:
    """Sentences with text, numbered through the transcript."""
    return _texts(mark_words(words, diarize), ["seg_no", "sent_no"], "sent_first")


def sentences(marked: DataFrame) -> DataFrame:
    """One numeric row per sentence; the words stay where they are, as a position range."""
    w = F.col("punctuated_word")
    return marked.groupBy(*KEY, "sent_no").agg(
        F.min("seg_no").alias("seg_no"),
        F.min("speaker").alias("speaker"),
        F.min_by("start_s", "pos").alias("start_s"),
        F.max_by("end_s", "pos").alias("end_s"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.max_by(F.substring(w, -1, 1).isin(CLOSED_END), "pos").alias("closed"),
        F.min_by("speaker_confidence", "pos").alias("first_conf"),
        F.max_by("speaker_confidence", "pos").alias("last_conf"),
    )


def repair_sentences(sents: DataFrame) -> DataFrame:
    """Join sentences broken over speakers and merge neighbouring segments of one speaker.

    Walking the segments in order, a broken sentence is joined with the next segment's first one and
    goes to whichever was longer. Whether a boundary is broken depends only on the two original
    sentences, so broken boundaries form runs; the joined sentence always spans its run, and its
    owner is the last member at least as long as everything before it in the run. That makes the
    walk a matter of runs and running values, with no per-transcript task.
    """

    def broken(prev, cur):
        gap = F.abs(prev("last_conf") - cur("first_conf"))
        return (prev("seg_no") != cur("seg_no")) & ~prev("closed") & (gap > 0.0)

    runs = islands(
        sents, KEY, ["sent_no"], row_block("sent_no"),
        ["seg_no", "closed", "last_conf", "first_conf", "start_s", "end_s"],
        {"unit_no": lambda p, c: ~broken(p, c)},
        origins={"run_start": ("unit_no", "start_s")},
        before={"_prev_end": "end_s", "_prev_seg": "seg_no", "_prev_closed": "closed", "_prev_conf": "last_conf"},
    )
    joined = F.coalesce(
        broken(
            lambda c: F.col({"last_conf": "_prev_conf", "seg_no": "_prev_seg", "closed": "_prev_closed"}[c]),
            F.col,
        ),
        F.lit(False),
    )
    kept = joined & (F.col("_prev_end") - F.col("run_start") > F.col("end_s") - F.col("start_s"))
    units = (
        runs.withColumn("_owner", F.when(~kept, F.col("sent_no")))
        .groupBy(*KEY, "unit_no")
        .agg(
            F.max_by("speaker", "_owner").alias("speaker"),
            F.min("run_start").alias("start_s"),
            F.max_by("end_s", "sent_no").alias("end_s"),
            F.min("first_pos").alias("first_pos"),
            F.max("last_pos").alias("last_pos"),
            (F.count("*") - 1).alias("n_joins"),
        )
    )
    return islands(
        units, KEY, ["unit_no"], row_block("unit_no"), ["speaker", "unit_no"],
        {"seg_no": lambda p, c: ~p("speaker").eqNullSafe(c("speaker"))},
        origins={"seg_first": ("seg_no", "unit_no")},
    ).withColumnRenamed("unit_no", "sent_no")


def merge_speakers(rows: DataFrame, no: str) -> DataFrame:
    """Merge consecutive rows of one speaker (`no` is the dense row number)."""
    numbered = islands(
        rows, KEY, [no], row_block(no), ["speaker"],
        {"seg_no": lambda p, c: ~p("speaker").eqNullSafe(c("speaker"))},
    )
    return numbered.groupBy(*KEY, "seg_no").agg(
        F.first("speaker").alias("speaker"),
        F.min_by("start_s", no).alias("start_s"),
        F.max_by("end_s", no).alias("end_s"),
        F.count("*").alias("n_rows"),
    )


def chapter_sentence(chapters: DataFrame, sents: DataFrame, width: float = 8.0) -> DataFrame:
    """Chapters with the first sentence whose [start, end] holds the chapter start."""
    spans = sents.select(
        *KEY, "sent_no", F.col("start_s").alias("sent_start"), F.col("end_s").alias("sent_end")
    )
    found = points_in_intervals(
        chapters.select(*KEY, "chapter_no", "start_s"), spans, KEY, "start_s", "sent_start", "sent_end", width
    )
    first = found.groupBy(*KEY, "_bucket", "chapter_no").agg(
        F.min("sent_no").alias("sent_no"),
        F.min_by("sent_start", "sent_no").alias("sent_start"),
        F.min_by("sent_end", "sent_no").alias("sent_end"),
    ).drop("_bucket")
    return chapters.join(first, [*KEY, "chapter_no"], "left")


def snap_chapters(chapters: DataFrame, sents: DataFrame) -> DataFrame:
    """Move a chapter inside a sentence to the sentence's nearer edge; others stay."""
    middle = (F.col("sent_start") + F.col("sent_end")) / 2
    snapped = (
        F.when(F.col("sent_no").isNull(), F.col("start_s"))
        .when(F.col("start_s") >= middle, F.col("sent_end"))
        .otherwise(F.col("sent_start"))
    )
    return chapter_sentence(chapters, sents).select(*KEY, "chapter_no", snapped.alias("start_s"), "title")


def place_chapters(chapters: DataFrame, rows: DataFrame, no: str, cascade: bool = True) -> DataFrame:
    """Give each chapter the row it goes before, as column `no`; chapters after the last row drop out.

    `no` counts the rows of a transcript without gaps. With `cascade` a row takes one chapter, so the
    k-th chapter goes to k + max over j <= k of (first row of chapter j - j); otherwise all chapters
    due at a row share it.
    """
    due = first_at_or_after(chapters, rows, KEY, ["chapter_no", "title"], "start_s", "start_s", no)
    never = F.lit(2**62)
    first = F.coalesce(F.col("first_no"), never)
    score = first - F.col("chapter_no") if cascade else first
    placed = ordered_scan(
        due, KEY, ["chapter_no"], row_block("chapter_no"), running_max={"_max": score}
    )
    at = F.col("_max") + (F.col("chapter_no") if cascade else F.lit(0))
    last = rows.groupBy(*KEY).agg(F.max(no).alias("_last"))
    return (
        placed.withColumn(no, at)
        .join(last, KEY)
        .filter(F.col(no) <= F.col("_last"))
        .select(*KEY, "chapter_no", "start_s", "title", no)
    )


def words_in_utterances(
    words: DataFrame, utterances: DataFrame, no: str, slack: float = 0.5, width: float = 8.0
) -> DataFrame:
    """Words contained in [start, end + slack] of an utterance; the first such utterance wins.

    Of utterances with equal times only the first can win, so they meet the words as one row however many there are.
    """
    spans = utterances.groupBy(*KEY, F.col("start_s").alias("_us"), F.col("end_s").alias("_ue")).agg(F.min(no).alias(no))
    inside = points_in_intervals(
        words.select(*KEY, "pos", "start_s", "end_s"), spans, KEY, "start_s", "_us", "_ue", width, slack
    ).filter(F.col("end_s") <= F.col("_ue") + slack)
    return inside.groupBy(*KEY, "_bucket", "pos").agg(F.min(no).alias(no)).drop("_bucket")


def unplaced_words(words: DataFrame, placed: DataFrame) -> DataFrame:
    """Words no utterance contains."""
    return words.join(placed.select(*KEY, "pos"), [*KEY, "pos"], "left_anti")


def spaced_words(words: DataFrame) -> DataFrame:
    """Words holding white space, which sentence splitting does not allow: rejects to look at."""
    return words.filter(F.col("punctuated_word").rlike(f"[{WHITE}]"))


def has_diarization(words: DataFrame) -> DataFrame:
    return words.groupBy(*KEY).agg(F.bool_or(F.col("speaker").isNotNull()).alias("has_diarization"))


def confidence_runs(words: DataFrame, diarize: bool = True) -> DataFrame:
    """Runs of words of a sentence with one rounded speaker confidence, as annotated text parts."""
    from pyspark.sql import Window

    def new_run(prev, cur):
        return _new_sentence(prev, cur) | ~prev("_conf").eqNullSafe(cur("_conf"))

    rounded = _flagged(words, diarize).withColumn("_conf", F.bround("speaker_confidence", 3))
    runs = islands(
        rounded, KEY, ["pos"], row_block(), ["speaker", "_ends", "_conf", "pos"],
        {"sent_no": _new_sentence, "run_no": new_run}, origins={"run_first": ("run_no", "pos")},
    )
    part = F.floor((F.col("pos") - F.col("run_first")) / BLOCK_ROWS).cast("long")
    grouped = runs.groupBy(*KEY, "sent_no", "run_no", part.alias("part_no")).agg(
        F.first("_conf").alias("confidence"),
        F.count("*").alias("n_words"),
        F.array_sort(F.collect_list(F.struct("pos", "punctuated_word"))).alias("_ws"),
    )
    text = F.array_join(F.transform("_ws", lambda w: w["punctuated_word"]), " ")
    mark = F.concat(F.lit("["), F.col("confidence").cast("string"), F.lit("]"))
    # Only the last part of a run carries its confidence; a window sees the parts of one run.
    last = F.col("part_no") == F.max("part_no").over(Window.partitionBy(*KEY, "run_no"))
    return grouped.select(
        *KEY, "sent_no", "run_no", "part_no", "confidence", "n_words",
        F.when(last, F.concat(text, mark)).otherwise(text).alias("text"),
    )
