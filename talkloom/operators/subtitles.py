"""Greedy grouping of timed words into subtitle cues."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.operators.ordered import ordered_scan
from talkloom.operators.timeline import KEY
from talkloom.scratch import materialise


def closing_words(start: np.ndarray, end: np.ndarray, seconds: float) -> np.ndarray:
    """Of every word the first one from it on that ends `seconds` or more after its start; the number of words where none does.

    Maxima of ends over runs of doubling length; all words walk them together, longest runs first, so ends may step back.
    """
    n = len(start)
    runs = [end]
    while 2 << (len(runs) - 1) <= n:
        half, last = 1 << (len(runs) - 1), runs[-1]
        runs.append(np.maximum(last[:len(last) - half], last[half:]))
    at = np.arange(n)
    for level in range(len(runs) - 1, -1, -1):
        inside = at + (1 << level) <= n
        skip = np.zeros(n, bool)
        skip[inside] = runs[level][at[inside]] - start[inside] < seconds
        at = np.where(skip, at + (1 << level), at)
    return at


def _left_open(closing: np.ndarray) -> np.ndarray:
    """Of every word the start of the cue still open at the end of the block if a cue starts there; -1 where none is. Index n: nothing starts."""
    n = len(closing)
    to = np.append(np.where(closing < n, closing + 1, np.arange(n)), n)  # an open cue leads to itself
    for _ in range(max(n, 1).bit_length()):
        to = to[to]
    return np.where(to < n, to, -1)


def _entries(timed: DataFrame, seconds: float, id_type: str) -> DataFrame:
    """The group still open at the start of a block, as `(in_pos, in_start)`; -1 for none.

    What a block makes of an open group depends only on the word that closes it, so each block is
    summarised on its own and the summaries, some numbers per block, are chained per transcript.
    Transcripts of one block take no part.
    """
    # No group open at the start of a block began after the latest start of the blocks before.
    peaks = timed.groupBy(*KEY, "_b").agg(F.max("start_s").alias("_peak"))
    order = Window.partitionBy(*KEY).orderBy("_b")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    followed = peaks.select(
        *KEY, "_b", F.max("_peak").over(before).alias("latest"), F.lead("_b").over(order).alias("_next")
    ).filter("_next IS NOT NULL")

    def summarise(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        pos, start, end = (table[c].to_numpy() for c in ("pos", "start_s", "end_s"))
        latest = table["latest"][0].as_py()
        bound = start[0] if latest is None else max(start[0], latest)
        # Entries: index 0 for "nothing open", then one per word that may close an incoming group: a later word with a smaller end never closes first.
        peak = np.maximum.accumulate(end)
        rises = np.flatnonzero(np.append(True, peak[1:] > peak[:-1]))
        rises = rises[:int(np.searchsorted(peak[rises] - bound, seconds)) + 1]
        ends = end[rises].tolist()
        outs = _left_open(closing_words(start, end, seconds))[np.append(0, rises + 1)]
        one = table.select(["transcript_id", "_b", "_next"]).slice(0, 1)
        one = one.append_column("ends", pa.array([ends], pa.list_(pa.float64())))
        one = one.append_column("out_pos", pa.array([[int(pos[o]) if o >= 0 else -1 for o in outs]], pa.list_(pa.int64())))
        return one.append_column("out_start", pa.array([[float(start[o]) if o >= 0 else 0.0 for o in outs]], pa.list_(pa.float64())))

    blocks = timed.drop("punctuated_word").join(followed, [*KEY, "_b"]).groupBy(*KEY, "_b").applyInArrow(
        summarise,
        f"transcript_id {id_type}, _b long, _next long, ends array<double>, out_pos array<long>, out_start array<double>",
    )

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("_b")
        opened, in_pos, in_start = None, [], []
        for row in table.select(["ends", "out_pos", "out_start"]).to_pylist():
            at = 0
            if opened is not None:
                at = next((k + 1 for k, e in enumerate(row["ends"]) if e - opened[1] >= seconds), None)
            if at is not None:
                opened = None if row["out_pos"][at] < 0 else (row["out_pos"][at], row["out_start"][at])
            in_pos.append(-1 if opened is None else opened[0])
            in_start.append(0.0 if opened is None else opened[1])
        return pa.table({
            "transcript_id": table["transcript_id"], "_b": table["_next"],
            "in_pos": pa.array(in_pos, pa.int64()), "in_start": pa.array(in_start, pa.float64()),
        })

    return blocks.groupBy(*KEY).applyInArrow(chain, f"transcript_id {id_type}, _b long, in_pos long, in_start double")


def _pieces(seconds: float):
    """The cues of a block, given the group open at its start: one row per cue or piece of one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        pos, start, end = (table[c].to_numpy() for c in ("pos", "start_s", "end_s"))
        closing = closing_words(start, end, seconds)
        opened, n = table["in_pos"][0].as_py(), len(pos)
        at, firsts, groups = 0, [], []
        if opened is not None and opened >= 0:
            firsts, groups = [0], [opened]
            closes = np.flatnonzero(end - table["in_start"][0].as_py() >= seconds)
            at = int(closes[0]) + 1 if len(closes) else n
        while at < n:  # one jump per cue
            firsts.append(at)
            groups.append(int(pos[at]))
            at = int(closing[at]) + 1
        lasts = [*firsts[1:], n]
        words = table["punctuated_word"].to_pylist()
        k = len(firsts)
        return pa.table({
            "transcript_id": table["transcript_id"].combine_chunks().take(pa.array([0] * k)), "_b": table["_b"].combine_chunks().take(pa.array([0] * k)),
            "group_pos": pa.array(groups, pa.int64()), "_s": pa.array(start[firsts]), "_e": pa.array(end[np.array(lasts) - 1]),
            "text": pa.array([" ".join(w for w in words[a:b] if w is not None) for a, b in zip(firsts, lasts, strict=True)]),
        })

    return run


def word_cues(words: DataFrame, seconds: float = 10.0, block_rows: int = 16384) -> DataFrame:
    """Subtitle cues `(cue_no, part_no, start_s, end_s, text)` from words alone.

    A cue closes with the first word that ends `seconds` or more after the cue's start, so each cue depends on the one before. The word that
    closes is looked up for all words of a block at once; a block's cues are then jumps, given the group open at its start. A cue that goes on
    over the edges of blocks comes in parts, one per block, so that no row grows with the words of a cue that never closes; its times are those of the whole cue.
    """
    timed = words.select(
        *KEY, "pos", F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"), "punctuated_word",
        F.floor(F.col("pos") / block_rows).cast("long").alias("_b"),
    )
    id_type = words.schema["transcript_id"].dataType.simpleString()
    entry = _entries(timed, seconds, id_type)
    pieces = timed.join(entry, [*KEY, "_b"], "left").groupBy(*KEY, "_b").applyInArrow(
        _pieces(seconds), f"transcript_id {id_type}, _b long, group_pos long, _s double, _e double, text string")
    kept = materialise(pieces, "cues")  # numbering reads the cues twice
    spans = kept.groupBy(*KEY, "group_pos").agg(
        F.min("_b").alias("_first"), F.min_by("_s", "_b").alias("start_s"), F.max_by("_e", "_b").alias("end_s"))
    numbered = ordered_scan(spans, KEY, ["group_pos"], F.floor(F.col("group_pos") / 65536), totals={"_n": F.lit(1)})
    return kept.select(*KEY, "group_pos", "_b", "text").join(numbered, [*KEY, "group_pos"]).select(
        *KEY, (F.col("_n") - 1).alias("cue_no"), (F.col("_b") - F.col("_first")).alias("part_no"), "start_s", "end_s", "text")


def whole_cues(parts: DataFrame) -> DataFrame:
    """The cues of `word_cues` with their whole texts: `(cue_no, start_s, end_s, text)`, one row per cue; a part without words adds nothing.

    Only the parts of one cue meet in a row, so a row is as long as its cue.
    """
    ordered = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("part_no", "text"))))
    return parts.groupBy(*KEY, "cue_no").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.array_join(F.transform(ordered, lambda p: p["text"]), " ").alias("text"))
