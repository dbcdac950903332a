"""Line dedup over content-defined chunks of lines.

Lines are hashed and counted over the corpus. A line that occurs once cannot be part of a repeated chunk and ends one.
Inside runs of repeated lines a rolling hash over the last two lines chooses further boundaries, so the same passage is cut alike
wherever it starts. A line of at least LONG words is a chunk of its own, and where a line is over STEP times as frequent as its neighbour
(a stock phrase next to a copied passage) lies a boundary too: both depend on the lines alone, so a passage among other repeated lines is cut out
alike everywhere. A chunk counts if it has several lines, or one of at least LONG words. Of each chunk that occurs again the first occurrence,
by document and place, stays; the others are removed after their bytes were compared with it.

Boundaries depend on the lines around a passage, so two copies of it may be cut differently. Therefore every pair of adjacent repeated lines is
looked for as well, at each line: any passage of several lines is made of such pairs, wherever the boundaries lie. A copy that overlaps
the first occurrence of its pair (a line three times in a row) stays. The first occurrence of a line in the corpus always stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.frames import arrow_map, bounded_batches, stored
from talkloom.llm.words import chunks, lines, mix, span_hash, stream, words

LEAST, MOST = 2, 32  # lines of a chunk: no boundary before, a boundary at the latest
CUT_BITS = 2  # a boundary after one line in four
LONG = 50  # words from which a single line is a chunk
STEP = 4  # a boundary between lines of which one is more than so many times as frequent
BROADCAST_KEYS = 500_000  # documents with repeated chunks (about 24 MB) that may be sent to every executor
_U = np.uint64
_KEY = ["doc_id", "text_hash"]
_STEPS = (stream(MOST, 31), stream(MOST, 32))


def _line_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Lines with a word: their place among those, their place among all lines, hash and words."""
    for chunk in chunks(batch.column(2)):
        w, ls = words(chunk), lines(chunk)
        n = np.searchsorted(w.starts, ls.ends) - np.searchsorted(w.starts, ls.starts)
        text = np.repeat(np.arange(chunk.texts), np.diff(ls.bounds))
        line = np.arange(len(text)) - ls.bounds[text]
        full = np.flatnonzero(n > 0)
        before = np.concatenate([[0], np.cumsum(n > 0)])
        rows = pa.array(text[full] + chunk.first)
        yield pa.RecordBatch.from_arrays([
            batch.column(0).take(rows), batch.column(1).take(rows), pa.array((before[full] - before[ls.bounds[text[full]]]).astype(np.int64)),
            pa.array(line[full].astype(np.int64)), pa.array(span_hash(chunk.data, ls.starts[full], ls.ends[full]).view(np.int64)), pa.array(n[full].astype(np.int64)),
        ], names=[*_KEY, "at", "line", "hash", "n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of repeated lines, sorted by document and place, to chunks and pairs (…, first line, last line, two hashes).

    A pair's two hashes are those of its lines.
    """
    names = [*_KEY, "at", "line", "hash", "n", "k"]
    chunk: list[tuple[int, int, int]] = []  # line, hash, words
    key: tuple = ()
    last_at, last_hash, last_k, last_line, last_value = -2, 0, 0, 0, 0
    out: list[tuple] = []

    def close() -> None:
        if chunk and (len(chunk) >= LEAST or sum(c[2] for c in chunk) >= LONG):
            hashes = np.array([c[1] for c in chunk], np.int64).view(_U)
            marks = [int(mix(hashes + s[: len(chunk)]).sum(dtype=_U).astype(np.int64)) for s in _STEPS]
            out.append((*key, chunk[0][0], chunk[-1][0], *marks))
        chunk.clear()

    def batch_of() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[*_KEY, "first", "last", "c1", "c2"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_pylist() for c in names]
        for doc_id, text_hash, at, line, value, n, k in zip(*columns, strict=True):
            now = (doc_id, text_hash)
            if now == key and at == last_at:
                continue  # the same document twice
            if now != key or at != last_at + 1 or n >= LONG or k > STEP * last_k or last_k > STEP * k:
                close()
                last_hash = 0
            if now == key and at == last_at + 1:
                out.append((*key, last_line, line, last_value, value))
            key, last_at, last_k, last_line, last_value = now, at, k, line, value
            chunk.append((line, value, n))
            rolling = int(mix(np.array([(last_hash * 0x9E3779B97F4A7C15 + value) & (1 << 64) - 1], _U))[0])
            last_hash = value
            if n >= LONG or len(chunk) >= MOST or len(chunk) >= LEAST and rolling & ((1 << CUT_BITS) - 1) == 0:
                close()
        if len(out) > 10_000:
            yield batch_of()
    close()
    if out:
        yield batch_of()


def _texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Of each document the text of its chunks."""
    rows = []
    for row in batch.to_pylist():
        own = (row["text"] or "").split("\n")
        for c in row["chunks"]:
            rows.append({"doc_id": row["doc_id"], "text_hash": row["text_hash"], **c, "body": "\n".join(x for x in own[c["first"]:c["last"] + 1] if x.strip(" \t\n\v\f\r"))})
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*[(k, pa.int64()) for k in (*_KEY, "first", "last", "c1", "c2")], ("stays", pa.bool_()), ("body", pa.string())]))


def _removed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    out = []
    for row in batch.to_pylist():
        own, gone = (row["text"] or "").split("\n"), set()
        for c in row["spans"] or []:
            gone.update(range(c["first"], c["last"] + 1))
        kept = [x for i, x in enumerate(own) if i not in gone]
        out.append({"doc_id": row["doc_id"], "n_lines": len(own), "n_removed": len(gone), "text": "\n".join(kept) if gone else row["text"]})
    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())]))


def _same(a: DataFrame, b: DataFrame):
    return a.doc_id.eqNullSafe(b.k_id) & (a.text_hash == b.k_hash)


def _keys(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"doc_id": "k_id", "text_hash": "k_hash"})


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every row of docs(doc_id, text): the texts without repeated chunks.

    Lines are split at \\n and compared byte by byte; lines without a word neither count nor part a chunk, and go with the chunk around them. Null texts stay null
    and have one line, as empty ones. Rows that share id and text are one document and keep the same lines; rows that share the id only are documents in the
    order of a hash of their text. Null ids come first. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = stored(arrow_map(docs, _line_rows, "doc_id long, text_hash long, at long, line long, hash long, n long"), "lines")
    again = stored(rows.groupBy("hash").agg(F.count("*").alias("k")).filter("k > 1"), "again")
    repeated = rows.join(again, "hash").select(*_KEY, "at", "line", "hash", "n", "k").repartition(*_KEY).sortWithinPartitions(*_KEY, "at")
    found = stored(repeated.mapInArrow(_cut, "doc_id long, text_hash long, first long, last long, c1 long, c2 long"), "chunks")
    place = F.struct("doc_id", "text_hash", "first", "last")
    groups = found.groupBy("c1", "c2").agg(F.min(place).alias("keeper"), F.max(place).alias("other")).filter("keeper != other").drop("other")
    groups = stored(groups, "groups")  # so that the engine can split a hot chunk in the join
    kept = F.col("keeper")
    overlaps = F.col("doc_id").eqNullSafe(kept["doc_id"]) & (F.col("text_hash") == kept["text_hash"]) & (F.col("first") > kept["first"]) & (F.col("first") <= kept["last"])
    found = stored(found.join(groups, ["c1", "c2"]).filter(~overlaps).withColumn("stays", place == kept).drop("keeper"), "repeated")
    by_doc = _keys(found.groupBy(*_KEY).agg(F.collect_list(F.struct("first", "last", "c1", "c2", "stays")).alias("chunks")))
    marked = stored(found.select(*_KEY).distinct(), "marked")
    few = marked.count() <= BROADCAST_KEYS
    marked = _keys(F.broadcast(marked) if few else marked)
    some = docs.join(marked, _same(docs, marked), "leftsemi")
    once = some.dropDuplicates(_KEY)
    bodies = arrow_map(once.join(by_doc, _same(once, by_doc)).select(*_KEY, "text", "chunks"), _texts, "doc_id long, text_hash long, first long, last long, c1 long, c2 long, stays boolean, body string")
    bodies = stored(bodies, "bodies")
    keepers = bodies.filter("stays").select("c1", "c2", F.col("body").alias("kept_body")).dropDuplicates(["c1", "c2"])
    equal = bodies.filter("not stays").join(keepers, ["c1", "c2"]).filter("body = kept_body").select(*_KEY, "first", "last").distinct()
    spans = _keys(equal.groupBy(*_KEY).agg(F.collect_list(F.struct("first", "last")).alias("spans")))
    out = "doc_id long, n_lines long, n_removed long, text string"
    touched = arrow_map(some.join(spans, _same(some, spans), "left").select("doc_id", "text", "spans"), _removed, out)
    rest = docs.join(marked, _same(docs, marked), "leftanti")
    rest = rest.select("doc_id", (F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
                       F.lit(0).cast("long").alias("n_removed"), "text")
    return touched.unionByName(rest)
