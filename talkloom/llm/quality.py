"""Quality classifier: an additive model with pairwise interactions over features of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm import gam
from talkloom.llm.frames import arrow_map, bounded_batches, packed, stored, unpacked
from talkloom.llm.words import LOWER, chunks, codepoints, lines, repeated_lines, repeated_windows, span_hash, sums_by_text, window_hash, words

FIT_ROWS = 20_000  # labelled rows the model is fitted on, at most; the smallest by a hash of their id
KEEP_FROM = 0.7
HELD_OUT = 2

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_LOWERS = np.isin(np.arange(256), list(range(97, 123)))
_DIGITS = np.isin(np.arange(256), list(range(48, 58)))
_STOPS = np.isin(np.arange(256), list(b".,;:?"))
_ALNUM = _UPPER | _LOWERS | _DIGITS | (np.arange(256) >= 128)

FEATURES = (
    "log words", "letters per word", "upper-case share", "digit share", "symbol share", "sentence marks per word", "exclamation marks per word",
    "words without letters", "words in capitals", "words that end in a symbol", "words equal to the one before", "distinct words", "distinct word pairs",
    "words in repeated windows", "repeated lines", "words per line", "words of three letters at most", "share of the commonest word", "capitalised words",
    "share of non-ASCII characters",
)


def features(chunk) -> np.ndarray:
    """One row of FEATURES per text of the chunk; an empty text has zeros."""
    data, bounds = chunk.data, chunk.bounds
    w, ls = words(chunk), lines(chunk)
    hashes = span_hash(data, w.starts, w.ends, LOWER)
    line_hashes = span_hash(data, ls.starts, ls.ends)
    size = w.ends - w.starts
    zero = np.zeros(len(data) + 1, np.int64)

    def per_word(mask: np.ndarray) -> np.ndarray:
        total = zero.copy()
        np.cumsum(mask, out=total[1:])
        return total[w.ends] - total[w.starts]

    def share(values: np.ndarray, ranges: np.ndarray, by: np.ndarray) -> np.ndarray:
        return sums_by_text(values, ranges) / by

    chars = codepoints(data)
    n = np.diff(w.bounds)
    per = np.maximum(n, 1)
    length = np.maximum(sums_by_text(chars, bounds), 1)
    upper, alnum = per_word(_UPPER[data]), per_word(_ALNUM[data])
    letters = np.maximum(per_word(chars), 1)
    last = data[w.ends - 1] if len(size) else np.zeros(0, np.uint8)
    first = data[w.starts] if len(size) else np.zeros(0, np.uint8)
    again = np.zeros(len(size), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[w.bounds[:-1][w.bounds[:-1] < len(again)]] = False
    pairs = window_hash(hashes, 2)
    loops = np.zeros((chunk.texts, 5))
    for t, (a, b, c, d) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), ls.bounds[:-1].tolist(), ls.bounds[1:].tolist(), strict=True)):
        if b > a:
            _, counts = np.unique(hashes[a:b], return_counts=True)
            two = pairs[a:b - 1]
            loops[t] = (len(counts) / (b - a), len(np.unique(two)) / max(len(two), 1), repeated_windows(hashes[a:b], 8) / (b - a),
                        repeated_lines(line_hashes[c:d]) / (d - c), counts.max() / (b - a))
    return np.stack([
        np.log1p(n), share(letters, w.bounds, per), share(_UPPER[data], bounds, length), share(_DIGITS[data], bounds, length),
        share(_SYMBOLS[data], bounds, length), share(_STOPS[data], bounds, per), share(data == 33, bounds, per), share(alnum == 0, w.bounds, per),
        share((upper >= 2) & (upper * 2 >= size), w.bounds, per), share(_SYMBOLS[last], w.bounds, per), share(again, w.bounds, per), loops[:, 0], loops[:, 1], loops[:, 2],
        loops[:, 3], n / np.maximum(np.diff(ls.bounds), 1), share(letters <= 3, w.bounds, per), loops[:, 4], share(_UPPER[first], w.bounds, per),
        share(data >= 0xC0, bounds, length),
    ], 1).astype(np.float32)


def _features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batch.column(1)):
        rows = features(chunk)
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)
        ids = batch.column(0).slice(chunk.first, chunk.texts)
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))], names=["doc_id", "x"])


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the rows a model may learn from: one per id, never of the held-out remainder."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    rows = rows.filter((remainder(F.col("doc_id")) != HELD_OUT) & F.col("label").isin(0, 1))
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def fit_model(table: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> gam.Model:
    """Fit on at most `fit_rows` labelled rows of table(doc_id, x); only these reach the driver."""
    rows = table.join(training_labels(labels), "doc_id").withColumn("draw", F.xxhash64("doc_id"))
    rows = rows.orderBy("draw", "doc_id", "x").limit(fit_rows).select("x", "label").toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return gam.fit(x.astype(float), rows.column("label").to_numpy())


def _scored(model: gam.Model):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(float)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text).

    Null and empty texts have all features 0 and the score of such a text. A null id is never held out nor learned
    from. Labels other than 0 and 1, and of unknown ids, are left out; an id labelled both ways counts as 1. Without labels of both
    kinds every score is the smoothed share of label 1. Rows with one id are scored each. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = stored(arrow_map(rows, _features, "doc_id long, x array<float>"), "features")
    scored = arrow_map(table, _scored(fit_model(table, labels, fit_rows)), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of `docs` the classifier keeps, all columns as they are; scored in the pass that filters."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learn = training_labels(labels).withColumn("draw", F.xxhash64("doc_id")).orderBy("draw", "doc_id").limit(fit_rows).select("doc_id")
    sample = arrow_map(rows.join(F.broadcast(learn), "doc_id", "leftsemi"), _features, "doc_id long, x array<float>")  # at most fit_rows ids
    model = fit_model(sample, labels, fit_rows)

    @F.pandas_udf("double")
    def score(texts):
        out = np.zeros(len(texts))
        for chunk in chunks(pa.array(texts, pa.large_string(), from_pandas=True)):
            out[chunk.first:chunk.first + chunk.texts] = model.score(features(chunk).astype(float))
        import pandas as pd

        return pd.Series(out)

    whole = packed(docs, text=F.col("text"))
    return unpacked(whole.filter(score("text") >= KEEP_FROM), docs)
