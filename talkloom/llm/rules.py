"""Quality rules: counts of whole texts, and a logistic regression over hashed word and character n-grams.

Features of a text: its 3-byte sequences, words and word pairs, hashed to DIMENSIONS columns; a word equal
to the one before it is hashed as a repeat whatever it is. A column's value is the root of its count over the root of all counts, so that
texts of any length have length 1. The regression is fitted on labelled rows, its margin is turned into a
probability by a logistic curve fitted on rows left out of the fit, and the probability is compared with a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.frames import arrow_map, bounded_batches
from talkloom.llm.gam import sigmoid
from talkloom.llm.quality import training_labels
from talkloom.llm.words import BYTES, Chunk, chunks, codepoints, lines, mix, repeated_lines, repeated_windows, span_hash, stream, sums_by_text, window_hash, words

DIMENSIONS = 1 << 15
FIT_ROWS = 4000  # labelled rows the regression is fitted on, at most
KEEP_FROM = 0.5
_U = np.uint64
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_TRIPLE = [stream(256, seed) for seed in (21, 22, 23)]
_BITS = _U(64 - 15)


def ngram_columns(chunk: Chunk, w, hashes: np.ndarray) -> Iterator[np.ndarray]:
    """Of each text the columns of its n-grams, repeats kept."""
    data = chunk.data
    triples = mix(_TRIPLE[0][data[:-2]] + _TRIPLE[1][data[1:-1]] + _TRIPLE[2][data[2:]]) >> _BITS if len(data) > 2 else np.zeros(0, _U)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    single = np.where(again, mix(np.full(1, 5, _U))[0], mix(hashes + _U(1))) >> _BITS
    double = np.where(again[1:], mix(np.full(1, 6, _U))[0], window_hash(hashes, 2)) >> _BITS if len(hashes) > 1 else np.zeros(0, _U)
    for i, j, a, b in zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist(), w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        yield np.concatenate([triples[i:max(i, j - 2)], single[a:b], double[a:max(a, b - 1)]]).astype(np.int64)


def _sample(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batch.column(1)):
        w = words(chunk)
        which, counts = [], []
        for columns in ngram_columns(chunk, w, span_hash(chunk.data, w.starts, w.ends, BYTES)):
            c, n = np.unique(columns, return_counts=True)
            which.append(c.astype(np.uint16).tobytes())
            counts.append(n.astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.texts), pa.array(which, pa.binary()), pa.array(counts, pa.binary())],
                                         names=["doc_id", "columns", "counts"])


def _logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, n: int, rounds: int = 80, ridge: float = 3e-4) -> np.ndarray:
    """Weights (the last is the intercept) by accelerated gradient steps over sparse rows."""
    w = np.zeros(DIMENSIONS + 1)
    ahead, momentum = w.copy(), 1.0
    for _ in range(rounds):
        margin = np.bincount(rows, values * ahead[columns], n) + ahead[-1]
        rest = sigmoid(margin) - y
        grad = np.empty_like(w)
        grad[:-1] = np.bincount(columns, values * rest[rows], DIMENSIONS) / n + ridge * ahead[:-1]
        grad[-1] = rest.mean()
        new = ahead - 2.0 * grad
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    return w


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to probabilities, by Newton steps on smoothed labels."""
    ones, n = y.sum(), len(y)
    soft = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (n - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margin + b)
        g = np.array([((p - soft) * margin).sum() + 1e-3 * (a - 1), (p - soft).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margin**2).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
    return a, b


def fit_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights of the calibrated regression; zeros but for the intercept without labels of both kinds."""
    learn = training_labels(labels).withColumn("draw", F.xxhash64("doc_id", F.lit(4))).orderBy("draw", "doc_id").limit(fit_rows).drop("draw")
    kept = docs.join(F.broadcast(learn.select("doc_id")), "doc_id", "leftsemi")  # at most fit_rows ids
    rows = arrow_map(kept, _sample, "doc_id long, columns binary, counts binary").join(learn, "doc_id").toArrow()
    out = np.zeros(DIMENSIONS + 1)
    order = np.lexsort((rows.column("columns").combine_chunks().to_pylist(), rows.column("doc_id").to_numpy())) if rows.num_rows else np.zeros(0, int)
    rows = rows.take(pa.array(order)).slice(0, fit_rows)
    y = rows.column("label").to_numpy()
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        out[-1] = np.log(share / (1 - share))
        return out
    columns = [np.frombuffer(b.as_py(), np.uint16) for b in rows.column("columns")]
    counts = [np.frombuffer(b.as_py(), np.uint32) for b in rows.column("counts")]
    values = np.concatenate([np.sqrt(c / max(c.sum(), 1)) for c in counts])
    which = np.repeat(np.arange(len(y)), [len(c) for c in columns])
    flat = np.concatenate(columns).astype(np.int64)
    test = np.arange(len(y)) % 5 == 0
    inner = ~test[which]
    place = np.cumsum(~test) - 1
    first = _logistic(place[which[inner]], flat[inner], values[inner], y[~test], int((~test).sum()))
    margin = np.bincount(which, values * first[flat], len(y)) + first[-1]
    a, b = _curve(margin[test], y[test]) if len(np.unique(y[test])) == 2 else (1.0, 0.0)
    out = first * a
    out[-1] += b
    return out


def _ruled(weights: np.ndarray, keep_from: float):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batch.column(1)):
            data, w, ls = chunk.data, words(chunk), lines(chunk)
            hashes = span_hash(data, w.starts, w.ends, BYTES)
            first_word = np.searchsorted(w.starts, ls.starts)
            with_word = np.searchsorted(w.starts, ls.ends) > first_word
            kept_lines = np.concatenate([[0], np.cumsum(with_word)])
            line_hashes = span_hash(data, ls.starts, ls.ends)[with_word]
            line_bounds = kept_lines[ls.bounds]
            n = np.diff(w.bounds)
            chars = sums_by_text(codepoints(data) & ~np.isin(data, [9, 10, 11, 12, 13, 32]), chunk.bounds)
            symbols = sums_by_text(_SYMBOLS[data], chunk.bounds)
            repeats, twice, score = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.full(len(n), weights[-1])
            for t, columns in enumerate(ngram_columns(chunk, w, hashes)):
                repeats[t] = repeated_windows(hashes[w.bounds[t]:w.bounds[t + 1]], 8)
                twice[t] = repeated_lines(line_hashes[line_bounds[t]:line_bounds[t + 1]])
                if len(columns):
                    score[t] += np.sqrt(np.bincount(columns, minlength=DIMENSIONS)) @ weights[:-1] / np.sqrt(len(columns))
            probability = sigmoid(score)
            failed = (n < 20) | (100 * repeats > 30 * n)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(chunk.first, chunk.texts), *[pa.array(x.astype(np.int64)) for x in (n, chars, symbols, twice, repeats)],
                pa.array(failed), pa.array(~failed & (probability >= keep_from)), pa.array(probability),
            ], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"])

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """Counts, base rules, verdict and probability of every row of docs(doc_id, text).

    Null and empty texts have no words and fail the base rules. Rows with one id are judged each; null ids are judged and
    never learned from. Labels are used as in `quality.training_labels`. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(docs, _ruled(fit_rules(docs, labels, fit_rows), keep_from), "doc_id long, n_words long, word_chars long, n_symbols long, "
                     "n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")
