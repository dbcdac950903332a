"""Phrases mined from the corpus: exact n-gram counts in counting quotient filters, then the weakest cut of every frequent phrase.

Words of a language that occur often enough get ids; phrases of rarer words can not be frequent. Texts become runs of ids, and level by
level (2 to 5 words) every task counts packed ids in filters, one per block of the permuted keys. Filters of a block are merged,
and what reaches the least count is unpacked. From 3 words on only phrases both of whose shorter parts were frequent are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm import quotient
from talkloom.llm.frames import bounded_batches, stored
from talkloom.llm.words import SEPARATOR, chunks, mix, words

LONGEST = 5
LEAST = 100
KEEP = 2000
VOCABULARY_ROWS, VOCABULARY_BYTES = 2_000_000, 64 << 20  # frequent words sent to every task; beyond it the words are joined
PRUNE_ROWS = 4_000_000  # frequent phrases whose hashes are sent to every task; beyond it the next level counts all phrases
BLOCK_ENTRIES = 1 << 20  # phrases of a block, about, if all were different
TOGETHER = 1 << 22  # phrases a task counts before it writes their filters
RUN = 1 << 14  # ids in a row of the encoded texts
SALTS = 64

_U = np.uint64
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", 10, 11, 12, 13]] = True
_CUT = SEPARATOR | _PIECE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _tokens(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Of some texts at a time: their words in lower case, whether each begins a piece, and the text each belongs to."""
    for chunk in chunks(column):
        w = words(chunk, _CUT)
        inside = ~_CUT[chunk.data]
        size = w.ends - w.starts
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        found = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(_LOWER[chunk.data[inside]].tobytes()))
        pieces = np.concatenate([[0], np.cumsum(_PIECE[chunk.data])])[w.starts]
        text = np.repeat(np.arange(chunk.texts), np.diff(w.bounds))
        begins = np.ones(len(size), bool)
        begins[1:] = (pieces[1:] != pieces[:-1]) | (text[1:] != text[:-1])
        yield found, begins, text + chunk.first


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    langs = batch.column(0).cast(pa.large_string()).dictionary_encode()
    for code, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, batch.column(1).filter(pc.equal(langs.indices, code))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) per batch, and with a null word the sum of all."""
    for batch in batches:
        for lang, texts in _by_language(batch):
            for found, _, _ in _tokens(texts):
                if not len(found):
                    continue
                coded = found.dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                names = pa.concat_arrays([coded.dictionary, pa.nulls(1, pa.large_string())])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), names.cast(pa.string()), pa.array(np.append(n, n.sum()))], names=["lang", "word", "n"])


def numbered(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """`rows` with an `id` from 1 on in the order of columns; written, so that ids stay what they are. Part sizes go over the driver."""
    spark = rows.sparkSession
    parts = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = sorted(parts.groupBy(part.alias("part")).count().collect())
    before, total = [], 0
    for r in sizes:
        before.append((r[0], total))
        total += r[1]
    starts = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))
    return parts.join(starts, part == starts["_part"]).withColumn("id", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")


def vocabulary(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, lang, word, f, n) of every word with f >= least occurrences in its language; n counts all words of the language. texts(lang, text)."""
    parts = texts.mapInArrow(_word_counts, "lang string, word string, n long")
    counts = stored(parts.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("word").isNull() | (F.col("f") >= least)), "words")
    totals = counts.filter("word is null").select("lang", F.col("f").alias("n"))
    rows = counts.filter("word is not null").join(totals, "lang")
    return stored(numbered(rows.select("lang", "word", "f", "n"), "vocabulary", ["lang", "word"]).select("id", "lang", "word", "f", "n"), "numbered")


def _runs(ids: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, int]]:
    """Rows of at most RUN + overlap ids, and how many of their positions may begin a phrase."""
    for a in range(0, len(ids), RUN):
        yield ids[a:a + RUN + overlap], min(RUN, len(ids) - a)


def _run_batch(rows: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32)
    flat = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64())), pa.array([r[1] for r in rows], pa.int32())], names=["ids", "starts"])


def _encoded(held, longest: int):
    """Texts to rows of ids; 0 stands for a rare word and for the end of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            for lang, texts in _by_language(batch):
                if lang not in table:
                    continue
                first, known = table[lang]
                for found, begins, _ in _tokens(texts):
                    coded = found.dictionary_encode()
                    at = pc.index_in(coded.dictionary, value_set=known).fill_null(-first).to_numpy().astype(np.int64) + first
                    ids = at[coded.indices.to_numpy()] if len(at) else np.zeros(0, np.int64)
                    place = np.arange(len(ids)) + np.cumsum(begins)
                    flat = np.zeros(int(place[-1]) + 1 if len(place) else 0, np.int64)
                    flat[place] = ids
                    zero = flat == 0  # runs of zeros say no more than one
                    if len(flat):
                        flat = flat[np.concatenate([[True], ~(zero[1:] & zero[:-1])])]
                        yield _run_batch(list(_runs(flat, longest - 1)))

    return run


def _places(longest: int):
    """(lang, word, run, pos) of every word; positions of different pieces lie too far apart for a phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lang, texts in _by_language(batch):
                for found, begins, _ in _tokens(texts):
                    if len(found):
                        pos = np.arange(len(found)) + longest * np.cumsum(begins)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), found.cast(pa.string()), pa.array(np.full(len(found), number)), pa.array(pos)],
                                                         names=["lang", "word", "run", "pos"])
                        number += 1

    return run


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, at: list of (pos, id)) to rows of ids with zeros in the gaps."""
    for batch in batches:
        rows = []
        for block, pos, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            at = np.array(pos) - block * RUN
            flat = np.zeros(at.max() + 1, np.int64)
            flat[at] = ids
            rows.append((flat, min(RUN, len(flat))))
        yield _run_batch(rows)


def encode(texts: DataFrame, known: DataFrame, *, longest: int = LONGEST, rows_limit: int = VOCABULARY_ROWS, bytes_limit: int = VOCABULARY_BYTES) -> DataFrame:
    """(ids, starts): the texts as rows of word ids. The vocabulary goes to every task while it is small, else words are joined with it."""
    spark = texts.sparkSession
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("word") + 16), F.lit(0)).alias("bytes")).first()
    if size.n <= rows_limit and size.bytes <= bytes_limit:
        rows = known.select("lang", "word", "id").orderBy("id").toArrow().combine_chunks()
        langs = rows.column("lang").to_pylist()
        cuts = [0, *[i for i in range(1, len(langs)) if langs[i] != langs[i - 1]], len(langs)] if langs else []
        names = rows.column("word").combine_chunks().cast(pa.large_string()) if langs else None
        table = {langs[a]: (a + 1, pa.concat_arrays([names.slice(a, b - a)])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}
        return stored(texts.mapInArrow(_encoded(spark.sparkContext.broadcast(table), longest), "ids array<long>, starts int"), "encoded")
    found = texts.mapInArrow(_places(longest), "lang string, word string, run long, pos long").join(known.select("lang", "word", "id"), ["lang", "word"])
    block = F.floor(F.col("pos") / RUN)
    again = F.when((F.col("pos") % RUN < longest - 1) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))  # a block sees the words behind its end
    at = found.select("run", F.explode(again).alias("block"), "pos", "id").groupBy("run", "block").agg(F.collect_list(F.struct("pos", "id")).alias("at"))
    return stored(at.select("block", F.col("at.pos").alias("pos"), F.col("at.id").alias("ids")).mapInArrow(_dense, "ids array<long>, starts int"), "encoded")


def _gram_hash(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(len(at), _U)
    for k in range(size):
        total = mix(total + ids[at + k].astype(_U) + _U(1))
    return total


def _candidates(batch: pa.RecordBatch, size: int, frequent: np.ndarray | None) -> np.ndarray:
    """The ids of all phrases of `size` words of a batch whose shorter parts are frequent, one phrase a row."""
    column = batch.column(0)
    ids = column.flatten().to_numpy(zero_copy_only=False)
    length = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    start = np.cumsum(length) - length
    row = np.repeat(np.arange(len(length)), length)
    begins = np.arange(len(ids)) - start[row] < batch.column(1).to_numpy(zero_copy_only=False)[row]
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros((0, size), np.int64)
    ok = begins[:n] & (row[:n] == row[size - 1:])
    for k in range(size):
        ok &= ids[k:k + n] > 0
    at = np.flatnonzero(ok)
    if frequent is not None and len(at):
        for shift in (0, 1):
            hashes = _gram_hash(ids, at + shift, size - 1)
            near = np.minimum(np.searchsorted(frequent, hashes), max(len(frequent) - 1, 0))
            at = at[frequent[near] == hashes] if len(frequent) else at[:0]
    return np.stack([ids[at + k] for k in range(size)], 1)


_FILTER = "block long, entries long, quotient_bits int, occupied binary, run_ends binary, remainders binary, counters binary, large binary"


def _filter_batch(ids: list[np.ndarray], layout: quotient.Layout) -> pa.RecordBatch:
    limbs, counts = quotient.counted(quotient.permute(quotient.pack(np.concatenate(ids), layout), layout), None, layout)
    rows = list(quotient.filters(limbs, counts, layout))
    columns = [[b for b, _ in rows], *[[f[i] for _, f in rows] for i in range(7)]]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _FILTER.split(", ")])


def _counting(layout: quotient.Layout, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        known = None if frequent is None else frequent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                ids = _candidates(batch.slice(i, 64), layout.words, known)
                waiting.append(ids)
                n += len(ids)
                if n >= TOGETHER:
                    yield _filter_batch(waiting, layout)
                    waiting, n = [], 0
        if n:
            yield _filter_batch(waiting, layout)

    return run


def _merging(layout: quotient.Layout, least: int):
    def run(rows: pa.Table) -> pa.Table:
        parts = [quotient.entries(r["block"], quotient.Filter(*[r[f] for f in quotient.Filter._fields]), layout) for r in rows.to_pylist()]
        limbs, counts = quotient.merged(parts, layout)
        kept = np.flatnonzero(counts >= least)
        ids = quotient.unpack(quotient.restore([limb[kept] for limb in limbs], layout), layout)
        offsets = np.arange(len(kept) + 1, dtype=np.int32) * layout.words
        return pa.table([pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.reshape(-1))), pa.array(counts[kept])], names=["ids", "f"])

    return run


def frequent_grams(runs: DataFrame, size: int, bits: int, expected: int, frequent=None, least: int = LEAST) -> DataFrame:
    """(ids, f) of the phrases of `size` words that occur `least` times; `expected` bounds how many phrases there are to count."""
    spark = runs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block_bits = max(expected // BLOCK_ENTRIES, 4 * tasks).bit_length()
    layout = quotient.Layout(size, bits, 0)
    layout = layout._replace(block_bits=min(block_bits, layout.widths[0]))
    filters = runs.mapInArrow(_counting(layout, frequent), _FILTER)
    return stored(filters.groupBy("block").applyInArrow(_merging(layout, least), "ids array<long>, f long"), f"grams{size}")


def _hashes(grams: DataFrame, size: int) -> np.ndarray:
    ids = grams.select("ids").toArrow().column("ids").combine_chunks().flatten().to_numpy().reshape(-1, size)
    return np.sort(_gram_hash(ids.reshape(-1), np.arange(len(ids)) * size, size))


def all_grams(texts: DataFrame, known: DataFrame, *, longest: int = LONGEST, least: int = LEAST, prune_rows: int = PRUNE_ROWS, **limits: int) -> DataFrame:
    """(ids, f) of every phrase of 1 to `longest` words with f >= least occurrences."""
    spark = texts.sparkSession
    runs = encode(texts, known, longest=longest, **limits)
    size = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n"), F.coalesce(F.sum("f"), F.lit(0)).alias("f")).first()
    out, frequent = known.select(F.array("id").alias("ids"), "f"), None
    for k in range(2, longest + 1):
        grams = frequent_grams(runs, k, max(1, int(size.n).bit_length()), int(size.f), frequent, least)
        out = out.unionByName(grams)
        n = grams.count()
        if not n:
            break
        frequent = spark.sparkContext.broadcast(_hashes(grams, k)) if n <= prune_rows else None  # equal hashes only let more phrases be counted
    return out


def collocations(docs: DataFrame, *, longest: int = LONGEST, least: int = LEAST, keep: int = KEEP, prune_rows: int = PRUNE_ROWS, **limits: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `keep` phrases of every language of docs(text, lang).

    Null texts are empty, a null lang is `und`; rows are counted each, repeated ones too; other columns are ignored. Texts without words, and an empty
    table, add nothing. Ties are settled by score, a, and the phrase's bytes. Products are decimals of 38 digits, exact below 10**38.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    known = vocabulary(texts, least)
    grams = stored(all_grams(texts, known, longest=longest, least=least, prune_rows=prune_rows, **limits), "grams")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.size("ids") - k + 1), lambda i: F.slice("ids", i, k))))
    within = grams.filter(F.size("ids") > 2).select(F.explode(F.array_distinct(inner)).alias("ids"), F.col("f").alias("longer"))
    covered = stored(within.groupBy("ids").agg(F.max("longer").alias("longer")), "covered")
    phrases = grams.filter(F.size("ids") > 1).withColumnRenamed("f", "a")
    phrases = phrases.join(covered, "ids", "left").filter("longer is null or 100 * longer < 100 * a").drop("longer")

    cuts = F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda k: F.array(
        F.struct(k.alias("cut"), F.lit(0).alias("side"), F.slice("ids", 1, k).alias("part")),
        F.struct(k.alias("cut"), F.lit(1).alias("side"), F.slice("ids", k + 1, F.size("ids")).alias("part"))))
    parts = phrases.select("ids", "a", F.explode(F.flatten(cuts)).alias("c")).select("ids", "a", "c.cut", "c.side", "c.part")
    sides = parts.join(grams.select(F.col("ids").alias("part"), "f"), "part")
    both = sides.groupBy("ids", "a").agg(F.sort_array(F.collect_list(F.struct("cut", "side", "f"))).alias("f"))  # at most 2 * (longest - 1) entries
    both = both.join(known.select(F.array("id").alias("first"), "lang", "n"), F.slice("ids", 1, 1) == F.col("first"))
    both = both.select("ids", "a", "f", "lang", "n", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    l, r = (F.element_at("f", 2 * F.col("k") - side)["f"] for side in (1, 0))
    scored = both.select("ids", "a", "lang", "n", "k", l.alias("l"), r.alias("r"))
    scored = scored.withColumn("score", F.expr("(1000 * cast(a AS decimal(19,0)) * cast(n AS decimal(19,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"))
    weakest = scored.groupBy("ids", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("w")).select("ids", "a", "lang", "n", "w.score", "w.l", "w.r")

    # Phrases of a hot language are ranked in salted parts first; the words of those left are joined once to tell ties apart.
    spelled = stored(weakest, "weakest").select("*", F.posexplode("ids").alias("pos", "id")).join(known.select("id", "word"), "id")
    spelled = spelled.groupBy("ids", "a", "lang", "n", "score", "l", "r").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
    spelled = stored(spelled.select("lang", F.array_join(F.col("w.word"), " ").alias("phrase"), "a", "l", "r", "n", "score"), "spelled")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = spelled.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= keep).drop("salt", "rank")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= keep)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
