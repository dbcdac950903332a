"""Ordered rows to transcript and subtitle text.

Every renderer returns `(transcript_id, part_no, text)`: bounded parts whose texts, joined in order
without separator, are the document. Ordinary transcripts have few parts; a huge one is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions.text import lstrip, rstrip, split_sentences, strip
from talkloom.functions.timing import hms, srt_time
from talkloom.operators.ordered import concat_parts
from talkloom.operators.timeline import BLOCK_ROWS, KEY, row_block

PART_ROWS = 256  # utterances, segments or cues per text part


def _stamp(at: Column) -> Column:
    return F.concat(F.lit("Speaker "), F.col("speaker"), F.lit(": "), hms(at), F.lit("\n\n"))


def sentence_heads(sents: DataFrame, placed: DataFrame, per_line: bool = True) -> DataFrame:
    """What goes before each sentence: line breaks, chapter heading, speaker stamp."""
    heading = placed.select(
        *KEY, "sent_no", F.col("start_s").alias("chapter_start"), F.col("title").alias("chapter")
    )
    rows = sents.join(heading, [*KEY, "sent_no"], "left")
    opens = F.col("sent_no") == F.col("seg_first")
    many, has_chapter = F.col("speaker").isNotNull(), F.col("chapter").isNotNull()
    title = F.concat(F.lit("## "), F.col("chapter"), F.lit("\n\n"))
    at_open = F.concat(
        F.when(F.col("sent_no") == 0, "").otherwise("\n\n"),
        F.when(has_chapter, title).otherwise(""),
        F.when(many, _stamp(F.col("start_s"))).otherwise(""),
    )
    # A heading inside a segment repeats the speaker at the chapter time.
    restart = F.when(many, _stamp(F.col("chapter_start"))).otherwise("" if per_line else " ")
    inside = F.when(has_chapter, F.concat(F.lit("\n\n"), title, restart)).otherwise(
        "\n" if per_line else " "
    )
    return rows.select(*KEY, F.col("first_pos").alias("pos"), F.when(opens, at_open).otherwise(inside).alias("head"))


def render_sentences(words: DataFrame, sents: DataFrame, placed: DataFrame, per_line: bool = True) -> DataFrame:
    """Transcript from words and (repaired) sentences; one shuffle of the words."""
    pieces = sentence_heads(sents, placed, per_line).select(
        *KEY, "pos", F.lit(0).alias("kind"), F.col("head").alias("piece")
    ).unionByName(words.select(*KEY, "pos", F.lit(1).alias("kind"), F.col("punctuated_word").alias("piece")))
    grouped = pieces.groupBy(*KEY, row_block().cast("long").alias("part_no")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "kind", "piece"))).alias("_a")
    )

    def spaced(x, i):
        after_head = F.coalesce(F.get(F.col("_a"), i - 1)["kind"] == 0, F.lit(False))
        return F.when((x["kind"] == 0) | after_head, x["piece"]).otherwise(F.concat(F.lit(" "), x["piece"]))

    return grouped.select(*KEY, "part_no", F.array_join(F.transform("_a", spaced), "").alias("text"))


def _stripped_parts(pieces: DataFrame, no: str, left=lstrip, right=rstrip) -> DataFrame:
    """Join pieces into parts, without white space at the ends of the whole document."""
    solid = F.when(left(F.col("piece")) != "", F.col(no))
    ends = pieces.groupBy(*KEY).agg(F.min(solid).alias("_lo"), F.max(solid).alias("_hi"))
    kept = pieces.join(ends, KEY).filter(F.col(no).between(F.col("_lo"), F.col("_hi")))
    piece = F.when(F.col(no) == F.col("_lo"), left(F.col("piece"))).otherwise(F.col("piece"))
    piece = F.when(F.col(no) == F.col("_hi"), right(piece)).otherwise(piece)
    return concat_parts(kept, KEY, no, F.floor(F.col(no) / PART_ROWS), piece)


def render_utterances(utterances: DataFrame, placed: DataFrame, no: str, per_line: bool = True) -> DataFrame:
    """Transcript from utterances with text: heading, stamp, then one sentence per line or the text."""
    heading = placed.select(*KEY, no, F.col("title").alias("chapter"))
    rows = utterances.join(heading, [*KEY, no], "left")
    lines = F.array_join(F.transform(split_sentences(F.col("text")), lambda s: F.concat(s, F.lit("\n"))), "")
    body = F.concat(lines if per_line else F.col("text"), F.lit("\n"))
    piece = F.concat(
        F.when(F.col("chapter").isNotNull(), F.concat(F.lit("\n\n## "), F.col("chapter"), F.lit("\n\n"))).otherwise(""),
        F.when(F.col("speaker").isNotNull(), _stamp(F.col("start_s"))).otherwise(""),
        body,
    )
    return _stripped_parts(rows.select(*KEY, no, piece.alias("piece")), no)


def render_segments(segments: DataFrame, placed: DataFrame, no: str) -> DataFrame:
    """Transcript from segments without speakers; all chapters due at a segment precede it."""
    headings = placed.groupBy(*KEY, no).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("chapter_no", "title"))),
                lambda c: F.concat(F.lit("\n\n## "), c["title"], F.lit("\n\n")),
            ),
            "",
        ).alias("headings")
    )
    rows = segments.join(headings, [*KEY, no], "left")
    piece = F.concat(F.coalesce("headings", F.lit("")), F.col("text"))
    return concat_parts(rows, KEY, no, F.floor(F.col(no) / PART_ROWS), piece)


def render_srt(cues: DataFrame, no: str) -> DataFrame:
    """Numbered subtitle cues; `no` counts them from 0 without gaps."""
    cue = F.concat(
        (F.col(no) + 1).cast("string"), F.lit("\n"), srt_time(F.col("start_s")), F.lit(" --> "),
        srt_time(F.col("end_s")), F.lit("\n"), strip(F.col("text")), F.lit("\n\n"),
    )
    return concat_parts(cues, KEY, no, F.floor(F.col(no) / PART_ROWS), cue)


def concat_summaries(summaries: DataFrame, no: str, text: str) -> DataFrame:
    """A provider's summaries in order, separated by spaces, without spaces at the ends."""
    pieces = summaries.select(*KEY, no, F.concat(F.lit(" "), F.col(text)).alias("piece"))
    return _stripped_parts(pieces, no, F.ltrim, F.rtrim)


__all__ = ["BLOCK_ROWS", "PART_ROWS", "render_segments", "render_sentences", "render_srt", "render_utterances"]
