"""Texts to bounded chunks at paragraph breaks and back, and time windows over recordings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions.text import strip
from talkloom.operators.ordered import ordered_scan, pair_number
from talkloom.operators.rows import explode_once
from talkloom.operators.timeline import KEY

CORRECTION_CHARS, SUMMARY_CHARS = 5000, 30000  # fixed values
BREAK = "\n\n"


def _cuts(lengths: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of paragraphs packed together, from the paragraphs' lengths.

    A chunk begins to count at its first paragraph with text. With running sums, the paragraph that no longer fits is one binary search
    away, so the work is one jump per chunk.
    """
    reach = np.concatenate([[0], np.cumsum(lengths + len(BREAK))])
    filled = np.flatnonzero(lengths > 0)
    cuts, at = [], 0
    while True:
        k = int(np.searchsorted(filled, at))
        if k == len(filled):
            return cuts
        first = int(filled[k])
        end = max(first + 1, int(np.searchsorted(reach, reach[first] + limit + len(BREAK), "right")) - 1)
        cuts.append((first, end))
        at = end


def _packed(limit: int):
    @F.pandas_udf("array<string>")
    def pack(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str] | None:
            if text is None:
                return None
            paragraphs = text.split(BREAK)
            lengths = np.fromiter(map(len, paragraphs), np.int64, len(paragraphs))
            return [BREAK.join(paragraphs[a:b]) for a, b in _cuts(lengths, limit)]

        return texts.map(one)

    return pack


def pack_paragraphs(df: DataFrame, text: str, max_chars: int = CORRECTION_CHARS) -> DataFrame:
    """One row per chunk: `chunk_no`, `n_chunks`, `chunk`, next to the other columns of `df`.

    Paragraphs are packed greedily: one that would take the chunk over the limit starts the next, and
    an oversized one stays whole. A text within the limit is one chunk, unchanged, and never leaves the JVM; a longer one without any text has none.
    Longer ones are packed in time linear in their length, however short their paragraphs are.
    """
    others = [c for c in df.columns if c != text]
    long = F.length(text) > max_chars
    packed = _packed(max_chars)(F.when(long, F.col(text)))
    rows = df.filter(F.col(text).isNotNull()).withColumn("_long", long).withColumn("_chunks", packed)
    chunks = F.when(F.col("_long"), F.transform("_chunks", strip)).otherwise(F.array(text))
    listed = explode_once(rows.withColumn("_listed", chunks), [*others, F.size("_listed").alias("n_chunks")], F.col("_listed"), "chunk_no", "chunk")
    return listed.select(*others, F.col("chunk_no").cast("long").alias("chunk_no"), F.col("n_chunks").cast("long").alias("n_chunks"), "chunk")


def reassemble(chunks: DataFrame, keys: Sequence[str], chunk: str = "chunk", separator: str = BREAK) -> DataFrame:
    """Chunks of a text joined in order. The chunks of one text came from one cell, so a group is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", F.col(chunk).alias("_c"))))
    return chunks.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda c: c["_c"]), separator).alias("text"))


def chunk_windows(recordings: DataFrame, duration: str, length: float = 1200.0, overlap: float = 30.0) -> DataFrame:
    """Overlapping windows [start, min(start + length, duration)], the last one reaching the end."""
    step = length - overlap
    last = F.greatest(F.ceil((F.col(duration) - length) / step), F.lit(0)).cast("long")
    numbers = recordings.filter(F.col(duration) > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("chunk_no") * F.lit(float(step))
    return numbers.withColumn("start_s", start).withColumn(
        "end_s", F.least(F.col("start_s") + F.lit(float(length)), F.col(duration))
    )


def combine_chunks(items: DataFrame, length: float, overlap: float, order: str = "pos") -> DataFrame:
    """Chunk-local items to one timeline: shift, drop what the previous chunk covered, renumber.

    A chunk lasts `length` seconds, so numbering in blocks of one chunk keeps every task small.
    """
    offset = F.col("chunk_no") * F.lit(float(length - overlap))
    shifted = items.withColumn("start_s", F.col("start_s") + offset).withColumn("end_s", F.col("end_s") + offset)
    kept = shifted.filter((F.col("chunk_no") == 0) | (F.col("end_s") >= offset + F.lit(float(overlap))))
    numbered = ordered_scan(kept, KEY, ["chunk_no", order], F.col("chunk_no"), totals={"_n": F.lit(1)})
    return numbered.withColumn("item_no", F.col("_n") - 1).drop("_n")


def global_speakers(items: DataFrame, order: str = "pos") -> DataFrame:
    """Local speaker ids to ids in order of first appearance over all chunks."""
    first = items.groupBy(*KEY, "speaker").agg(F.min(pair_number(F.col("chunk_no"), F.col(order))).alias("_first"))
    from pyspark.sql import Window

    # One row per speaker of a transcript is left here.
    w = Window.partitionBy(*KEY).orderBy("_first")
    return first.select(*KEY, "speaker", (F.row_number().over(w) - 1).alias("global_speaker"))


def overlap_matches(items: DataFrame, length: float, overlap: float) -> DataFrame:
    """Words of a chunk that lie within `overlap` seconds of a word in the end of the chunk before.

    The earlier words are reduced to the first and last start per bucket of `overlap` seconds: any
    word of the same bucket matches, and of the neighbouring buckets only the nearest word matters.
    """
    step = float(length - overlap)
    shifted = items.withColumn("_t", F.col("start_s") + F.col("chunk_no") * F.lit(step)).withColumn(
        "_b", F.floor(F.col("_t") / overlap).cast("long")
    )
    tail = shifted.filter(F.col("end_s") > step).groupBy(*KEY, (F.col("chunk_no") + 1).alias("chunk_no"), "_b").agg(
        F.min("_t").alias("lo"), F.max("_t").alias("hi")
    )
    near = tail.select(
        *KEY, "chunk_no", F.explode(F.array(*[
            F.struct((F.col("_b") + d).alias("_b"),
                     (F.lit(None).cast("double") if d <= 0 else F.col("hi")).alias("below"),
                     (F.lit(None).cast("double") if d >= 0 else F.col("lo")).alias("above"),
                     F.lit(d == 0).alias("same"))
            for d in (-1, 0, 1)
        ])).alias("r")
    ).select(*KEY, "chunk_no", "r.*").groupBy(*KEY, "chunk_no", "_b").agg(
        F.max("below").alias("below"), F.min("above").alias("above"), F.bool_or("same").alias("same")
    )
    matched = F.col("same") | (F.col("_t") - F.col("below") < overlap) | (F.col("above") - F.col("_t") < overlap)
    return (
        shifted.join(near, [*KEY, "chunk_no", "_b"])
        .filter(F.coalesce(matched, F.lit(False)))
        .select(*KEY, "chunk_no", "pos", "speaker", F.col("_t").alias("start_s"))
    )
