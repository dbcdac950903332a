"""Toxicity by compression distance: windows of a text against two zstandard dictionaries.

Both dictionaries hold the same base, trained on windows of ordinary text, and then what sets their class apart: the words
whose byte sequences stand in more texts of that class than of the other (by the normal approximation of a difference of shares),
picked greedily so that a sequence counts once. A window is a few words of a text; its distance is its compressed length with the
ordinary dictionary minus that with the toxic one. Windows are too short to be compressed by themselves, so each begins with
the same few bytes, which end both dictionaries: then every further match shows in the length. A text is described by how many of
its windows reach each threshold; a logistic regression on labelled texts the dictionaries have not seen turns that into a probability.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.frames import bounded_batches
from talkloom.llm.gam import sigmoid
from talkloom.llm.quality import HELD_OUT, remainder
from talkloom.llm.words import SEPARATOR, Chunk, chunks, words

FIT_ROWS = 3000  # labelled texts of each class the model is fitted on, at most; the smallest by a hash of their id
FIT_CHARS = 20_000  # longer texts are not fitted on (but scored whole)
TOXIC_FROM = 0.3
WINDOW = 24  # bytes: a window ends with the word that starts before its end
LONGEST = 64  # longer words are cut into windows of their own
LEVEL = 3
BASE_BYTES, CLASS_BYTES = 16_384, 2_048
SEQUENCE = 5  # bytes of the sequences compared between the classes
LEAST_Z = 4.0
THRESHOLDS = (2, 3, 4, 5, 6, 8, 10)

_PRIMER = np.concatenate([np.arange(1, 9), np.arange(200, 224)]).astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Model(NamedTuple):
    """Two dictionaries, and weights over the standardised features; the last weight is the intercept."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def windows(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a chunk one after the other, (offset, length) of each, and the range of windows of every text."""
    data = _LOWER[chunk.data]
    w = words(chunk)
    size = w.ends - w.starts
    pieces = np.maximum(1, -(-size // LONGEST))
    of = np.repeat(np.arange(len(size)), pieces)  # the word of every piece
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = w.starts[of] + nth * LONGEST
    size = np.minimum(size[of] - nth * LONGEST, LONGEST)
    bounds = np.concatenate([[0], np.cumsum(pieces)])[w.bounds]
    if not len(size):
        return np.zeros(0, np.uint8), np.zeros((0, 2), np.uint64), np.zeros(chunk.texts + 1, np.int64)
    text = np.repeat(np.arange(chunk.texts), np.diff(bounds))
    at = np.cumsum(size + 1) - (size + 1)
    bucket = (at - at[bounds[:-1][text]]) // WINDOW
    new = np.ones(len(size), bool)
    new[1:] = (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1])
    first = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    place = at + len(_PRIMER) * (number + 1)
    before = np.cumsum(size) - size
    out = np.full(int(size.sum() + len(size) + len(_PRIMER) * len(first)), 32, np.uint8)
    letters = np.arange(int(size.sum()))
    out[letters + np.repeat(place + 1 - before, size)] = data[letters + np.repeat(starts - before, size)]
    offsets = place[first] - len(_PRIMER)
    out[offsets[:, None] + np.arange(len(_PRIMER))] = _PRIMER
    lengths = np.diff(np.concatenate([offsets, [len(out)]]))
    return out, np.stack([offsets, lengths], 1).astype(np.uint64), np.concatenate([[0], np.cumsum(new)])[bounds]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    options = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False,
                                                             format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=options)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=options)


def _lengths(by: zstandard.ZstdCompressor, data: np.ndarray, spans: np.ndarray) -> np.ndarray:
    packed = by.multi_compress_to_buffer(zstandard.BufferWithSegments(data.tobytes(), spans.tobytes()), threads=0)
    return np.fromiter((len(packed[i]) for i in range(len(packed))), np.int64, len(packed))


def features(chunk: Chunk, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> np.ndarray:
    """Of every text: counts and shares of windows at each threshold, the number of windows, and the largest distance."""
    data, spans, bounds = windows(chunk)
    out = np.zeros((chunk.texts, 2 * len(THRESHOLDS) + 2))
    if not len(spans):
        return out
    distance = _lengths(ordinary, data, spans) - _lengths(toxic, data, spans)
    n = np.diff(bounds)
    for k, t in enumerate(THRESHOLDS):
        total = np.concatenate([[0], np.cumsum(distance >= t)])
        reached = total[bounds[1:]] - total[bounds[:-1]]
        out[:, k] = np.log1p(reached)
        out[:, len(THRESHOLDS) + k] = 10 * reached / np.maximum(n, 1)
    out[:, -2] = np.log1p(n)
    some = n > 0
    out[some, -1] = np.maximum.reduceat(distance, bounds[:-1][some])
    return out


def _sequences(data: np.ndarray) -> np.ndarray:
    """Of every position the SEQUENCE bytes from there as a number; 0 where a word's end lies inside."""
    n = len(data) - SEQUENCE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, inside = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(SEQUENCE):
        part = data[k:k + n]
        out = (out << np.uint64(8)) | part.astype(np.uint64)
        if 0 < k < SEQUENCE - 1:
            inside &= part != 32
    return np.where(inside, out, np.uint64(0))


def _plain(text: str) -> np.ndarray:
    data = _LOWER[np.frombuffer(b" " + text.encode() + b" ", np.uint8)]
    return np.where(SEPARATOR[data], np.uint8(32), data)


def _spread(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences, and in how many of the texts each stands."""
    each = [np.unique(_sequences(_plain(t))) for t in texts]
    found, n = np.unique(np.concatenate([*each, np.zeros(1, np.uint64)]), return_counts=True)
    return found[found > 0], n[found > 0]


def _typical(own: list[str], other: list[str]) -> bytes:
    """The words that set `own` apart from `other`, the most telling one last; at most CLASS_BYTES."""
    mine, a = _spread(own)
    theirs, b = _spread(other)
    if not len(mine):
        return b""
    at = np.minimum(np.searchsorted(theirs, mine), max(len(theirs) - 1, 0))
    b = np.where(theirs[at] == mine, b[at], 0) if len(theirs) else np.zeros(len(mine))
    share = (a + b + 1) / (len(own) + len(other) + 2)
    z = (a / len(own) - b / len(other)) / np.sqrt(share * (1 - share) * (1 / len(own) + 1 / len(other)))
    weight = {int(s): float(x) for s, x in zip(mine[z >= LEAST_Z], z[z >= LEAST_Z], strict=True)}
    seen: dict[bytes, int] = {}
    for text in own:
        for word in set(_plain(text).tobytes().split()):
            if len(word) <= LONGEST:
                seen[word] = seen.get(word, 0) + 1
    often = [word for word, n in seen.items() if n > 1]
    joined = np.frombuffer(b" " + b" ".join(often) + b" ", np.uint8)
    sequences = _sequences(joined)
    hits = np.flatnonzero(np.isin(sequences, mine[z >= LEAST_Z]))
    starts = np.cumsum([0, *[len(word) + 1 for word in often]])
    held: dict[bytes, set[int]] = {}
    for at, s in zip((np.searchsorted(starts, hits, "right") - 1).tolist(), sequences[hits].tolist(), strict=True):
        held.setdefault(often[at], set()).add(s)

    def gain(word: bytes) -> float:
        return sum(sorted(weight[s] for s in held[word])) / (len(word) + 1)

    queue = [(-gain(word), word) for word in held]
    heapq.heapify(queue)
    picked, size = [], 0
    while queue and size < CLASS_BYTES:
        _, word = heapq.heappop(queue)
        now = gain(word)
        if now <= 0:
            continue
        if queue and now < -queue[0][0] - 1e-12:
            heapq.heappush(queue, (-now, word))
            continue
        picked.append(b" " + word)
        size += len(word) + 1
        for s in held[word]:
            weight[s] = 0.0
    return b"".join(reversed(picked))[-CLASS_BYTES:]


def _base(texts: list[str]) -> bytes:
    """The common base: a dictionary zstandard trains on pieces of ordinary text; the texts themselves where they are too few for that."""
    joined = b"".join(_plain(t).tobytes() for t in texts)
    pieces = [joined[i:i + 16 * WINDOW] for i in range(0, min(len(joined), 400 * BASE_BYTES), 16 * WINDOW)]
    try:
        return zstandard.train_dictionary(BASE_BYTES + 2048, pieces, k=64, d=8, level=LEVEL).as_bytes()[-BASE_BYTES:]
    except zstandard.ZstdError:
        return joined[-BASE_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and intercept of a ridge-penalised logistic regression, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    ridge = np.full(x.shape[1], 1e-3)
    ridge[-1] = 1e-9
    weight = weight / weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
    return w


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int) -> tuple[list[str], list[int], float]:
    """Texts and labels to fit on, at most `fit_rows` of each class, in a fixed order; and the share of toxic labels."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    rows = rows.filter((remainder(F.col("doc_id")) != HELD_OUT) & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    drawn = rows.withColumn("draw", F.xxhash64("doc_id", F.lit(11)))
    learn = [drawn.filter(F.col("label") == k).orderBy("draw", "doc_id").limit(fit_rows) for k in (0, 1)]
    learn = F.broadcast(learn[0].unionByName(learn[1]))  # at most 2 * fit_rows ids
    found = docs.filter(F.length("text") <= FIT_CHARS).join(learn, "doc_id").toArrow().to_pylist() if ones and ones < n else []
    found.sort(key=lambda r: (r["draw"], r["doc_id"], r["text"]))
    return [r["text"] for r in found], [r["label"] for r in found], (ones + 1) / (n + 2)


def fit_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Two of three sampled texts make the dictionaries, the third ones the regression, weighted to the share of toxic labels."""
    texts, marks, share = training_rows(docs, labels, fit_rows)
    n = 2 * len(THRESHOLDS) + 2
    constant = Model(b"", b"", np.zeros(n), np.ones(n), np.concatenate([np.zeros(n), [np.log(share / (1 - share))]]))
    learn = [[t for i, (t, m) in enumerate(zip(texts, marks, strict=True)) if m == k and i % 3] for k in (0, 1)]
    rest = [i for i in range(len(texts)) if i % 3 == 0]
    y = np.array([marks[i] for i in rest], float)
    if not all(learn) or len(np.unique(y)) < 2:
        return constant
    base = _base(learn[0])
    own = [_typical(learn[0], learn[1]), _typical(learn[1], learn[0])]
    size = min(map(len, own)) or max(map(len, own))
    primer = _PRIMER.tobytes()
    contents = [base + part[-size:] + primer for part in own]
    by = [compressor(c) for c in contents]
    x = np.concatenate([features(c, *by) for c in chunks(pa.array([texts[i] for i in rest], pa.large_string()))])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(contents[0], contents[1], mean, scale, _logistic((x - mean) / scale, y, weight))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [compressor(c) for c in (model.ordinary, model.toxic)] if model.toxic else []
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                x = features(chunk, *by) if by else np.zeros((chunk.texts, len(model.mean)))
                total = np.full(chunk.texts, model.weights[-1])
                for value, weight in zip(((x - model.mean) / model.scale).T, model.weights, strict=False):
                    total += value * weight  # in one order, so that a text's score does not depend on its neighbours
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.texts), pa.array(sigmoid(total))], names=["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text); labels(doc_id, toxic).

    Whole texts are scored; null and empty ones have no windows and the score of such a text. A null id is never held out nor learned
    from. Labels other than 0 and 1, and of unknown ids, are left out; an id labelled both ways counts as toxic. Without labels of both
    kinds every score is the smoothed share of toxic labels. Rows with one id are scored each; other columns are ignored. Empty tables give no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(_scored(fit_model(rows, labels, fit_rows)), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
