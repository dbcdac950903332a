"""Words and paragraphs in digital-paper-edit form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.operators.ordered import concat_parts, ordered_scan
from talkloom.operators.timeline import BLOCK_ROWS, KEY, row_block

_PARAGRAPH_PARTS = 2**40  # paragraph parts sort after all word parts


def dpe_words(words: DataFrame) -> DataFrame:
    """Words with a running id from 0."""
    numbered = ordered_scan(words, KEY, ["pos"], row_block(), totals={"_n": F.lit(1)})
    return numbered.select(
        *KEY, (F.col("_n") - 1).alias("id"), F.col("start_s").alias("start"), F.col("end_s").alias("end"),
        F.col("punctuated_word").alias("text"),
    )


def dpe_paragraphs(sents: DataFrame, chapters: DataFrame, placed: DataFrame) -> DataFrame:
    """Segments split at the chapters placed inside them, with running ids.

    A segment's first paragraph ends at its first chapter and is dropped if empty; a chapter's
    paragraph runs to the next chapter of the segment, or to the segment's end.
    """
    segs = sents.groupBy(*KEY, "seg_no").agg(
        F.min("speaker").alias("speaker"), F.min_by("start_s", "sent_no").alias("seg_start"),
        F.max_by("end_s", "sent_no").alias("seg_end"),
    )
    inside = placed.join(sents.select(*KEY, "sent_no", "seg_no"), [*KEY, "sent_no"]).select(
        *KEY, "seg_no", "chapter_no", "start_s", "title"
    )
    # The next chapter in the list (placed or not) and, where placed, its segment.
    following = chapters.select(*KEY, (F.col("chapter_no") - 1).alias("chapter_no"), F.col("start_s").alias("next_start"))
    following_seg = inside.select(*KEY, (F.col("chapter_no") - 1).alias("chapter_no"), F.col("seg_no").alias("next_seg"))
    joined = (
        inside.join(following, [*KEY, "chapter_no"], "left")
        .join(following_seg, [*KEY, "chapter_no"], "left")
        .join(segs, [*KEY, "seg_no"])
    )
    same = F.coalesce(F.col("next_seg") == F.col("seg_no"), F.lit(False))
    ahead = F.col("next_start").isNull() | (F.col("start_s") < F.col("next_start"))
    from_chapters = joined.filter(~same | ahead).select(
        *KEY, "seg_no", "chapter_no", F.col("start_s").alias("start"),
        F.when(same, F.col("next_start")).otherwise(F.col("seg_end")).alias("end"), "speaker",
        F.when(same | ahead, F.col("title")).alias("chapter"),
    )
    first = inside.groupBy(*KEY, "seg_no").agg(F.min_by("start_s", "chapter_no").alias("_first"))
    from_segments = segs.join(first, [*KEY, "seg_no"], "left").filter(
        F.col("_first").isNull() | (F.col("seg_start") < F.col("_first"))
    ).select(
        *KEY, "seg_no", F.lit(-1).cast("long").alias("chapter_no"), F.col("seg_start").alias("start"),
        F.coalesce("_first", "seg_end").alias("end"), "speaker", F.lit(None).cast("string").alias("chapter"),
    )
    rows = from_segments.unionByName(from_chapters)
    numbered = ordered_scan(rows, KEY, ["seg_no", "chapter_no"], row_block("seg_no"), totals={"_n": F.lit(1)})
    speaker = F.concat(F.lit("Speaker "), F.coalesce(F.col("speaker").cast("string"), F.lit("single_speaker")))
    return numbered.select(*KEY, (F.col("_n") - 1).alias("id"), "start", "end", speaker.alias("speaker"), "chapter")


def dpe_document(words: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The JSON document `{"words": [...], "paragraphs": [...]}` of every transcript, in bounded parts."""
    last = paragraphs.groupBy(*KEY).agg(F.max("id").alias("_last"))
    word = F.concat(F.when(F.col("id") == 0, '{"words": [').otherwise(", "), F.to_json(F.struct("id", "start", "end", "text")))
    para = F.concat(
        F.when(F.col("id") == 0, '], "paragraphs": [').otherwise(", "),
        F.to_json(F.struct("id", "start", "end", "speaker", "chapter")),
        F.when(F.col("id") == F.col("_last"), "]}").otherwise(""),
    )
    block = F.floor(F.col("id") / BLOCK_ROWS).cast("long")
    pieces = words.select(*KEY, "id", block.alias("_part"), word.alias("piece")).unionByName(
        paragraphs.join(last, KEY).select(*KEY, "id", (block + _PARAGRAPH_PARTS).alias("_part"), para.alias("piece"))
    )
    return concat_parts(pieces, KEY, "id", F.col("_part"), F.col("piece"))
