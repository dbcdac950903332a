"""Token ids of whole texts, written as Huffman-coded blocks and read back.

File format, below one folder: `codebook` has (id, length) of the canonical code; `blocks` has one
row per block: `part` and `block` (their order is the order of documents), `start` (ids before the block
in its part), `doc_ids` and `sizes` of its whole documents, `checkpoints` (bit offsets, one per 256 ids)
and `payload` (bits). A block decodes without any other block, and a run of 256 ids without the rest of its block.
Blocks are rows of Parquet, so Spark commits each task's output once, on any store.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.llm.frames import arrow_map, bounded_batches, stored
from talkloom.llm.huffman import Decoder, canonical, code_lengths, pack
from talkloom.llm.words import Chunk, chunks
from talkloom.scratch import scratch_path

END_ID = 0
CODE_BITS = 18
BLOCK_IDS = 1 << 19
_KEEP_UNITS = 500_000  # distinct units a worker remembers; beyond it the older half goes
_STOPS = np.isin(np.arange(256), list(b".,;:!?"))
_ALNUM = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)])
_COUNTED = 1 << 20  # ids counted in one go
_JOINED = 1 << 16  # characters of new units encoded in one call

# Unicode White_Space, which is what \s means to the tokenizer's own splitter: single bytes, and longer UTF-8 sequences.
_SPACE_BYTES = np.isin(np.arange(256), [*range(9, 14), 32])
_SPACE_RUNS = [s.encode() for s in ["\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]]


def _spaces(data: np.ndarray) -> np.ndarray:
    """True at every byte of a white-space character."""
    out = _SPACE_BYTES[data]
    lead = {byte: np.flatnonzero(data == byte) for byte in {run[0] for run in _SPACE_RUNS}}
    for run in _SPACE_RUNS:
        at = lead[run[0]]
        at = at[at <= len(data) - len(run)]
        for k in range(1, len(run)):
            at = at[data[at + k] == run[k]]
        for k in range(len(run)):
            out[at + k] = True
    return out


class UnitEncoder:
    """Encodes texts by the tokenizers library, each distinct unit once.

    A unit is white space and the run of other characters behind it, without the stop behind a letter or digit, which begins one of its
    own. The byte-level splitter never forms a piece from other characters followed by white space, nor from a letter or digit and a
    stop behind it, so the ids of a text are those of its units in order.
    New units are encoded many in one call, joined, and the ids are cut where the bytes of the tokens reach a unit's end; where they
    do not meet it, and for units that are white space alone or begin without it, every unit is a call of its own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plain = self.tokenizer.get_vocab(with_added_tokens=False)
        known = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(known.values(), default=0) + 1, np.int64)
        for token, number in known.items():  # a byte-level token has one character per byte
            self.bytes[number] = len(token) if token in plain else len(token.encode())
        self.known: dict[str, bytes] = {}

    def _call(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, units: list[str]) -> list[bytes]:
        """Ids of units that begin with white space and end without."""
        raw = self._call(["".join(units)])[0]
        reached = np.cumsum(self.bytes[np.frombuffer(raw, np.uint32)])
        ends = np.cumsum([len(u.encode()) for u in units])
        at = np.searchsorted(reached, ends)
        if len(reached) and at[-1] == len(reached) - 1 and (reached[np.minimum(at, len(reached) - 1)] == ends).all():
            cuts = [0, *(4 * (at + 1)).tolist()]
            return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return self._call(units)

    def _learn(self, units: list[str]) -> None:
        alone = [u for u in units if not u[0].isspace() or u.isspace()]
        rest = [u for u in units if u[0].isspace() and not u.isspace()]
        self.known.update(zip(alone, self._call(alone), strict=True))
        a = 0
        for b, reached in enumerate(accumulate(map(len, rest)), 1):
            if reached // _JOINED != (reached - len(rest[b - 1])) // _JOINED or b == len(rest):
                self.known.update(zip(rest[a:b], self._joined(rest[a:b]), strict=True))
                a = b

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of a chunk, one after the other, and the bounds of each text's ids."""
        if not len(chunk.data):
            return np.zeros(0, np.uint32), np.zeros(chunk.texts + 1, np.int64)
        space = _spaces(chunk.data)
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[1:] |= _STOPS[chunk.data[1:]] & _ALNUM[chunk.data[:-1]]
        begins[chunk.bounds[:-1][np.diff(chunk.bounds) > 0]] = True
        starts = np.flatnonzero(begins)
        offsets = np.append(starts, len(chunk.data)).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(chunk.data.tobytes())).dictionary_encode()
        names, which = units.dictionary.to_pylist(), units.indices.to_numpy()
        self._learn([u for u in names if u not in self.known])
        blobs = [self.known[u] for u in names]
        if len(self.known) > _KEEP_UNITS:
            for u in list(islice(self.known, len(self.known) // 2)):
                del self.known[u]
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(blobs), np.uint32)
        sizes = size[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(first[which] - ends[:-1], sizes) + np.arange(int(ends[-1]))]
        return ids, ends[np.searchsorted(starts, chunk.bounds)]


_ENCODERS: dict[str, UnitEncoder] = {}


def _tokenised(path: str):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(path, None) or UnitEncoder(path)
        _ENCODERS[path] = encoder
        squeeze = zstandard.ZstdCompressor(level=1)
        for chunk in chunks(batch.column(1), 1 << 23):
            ids, bounds = encoder.encode(chunk)
            parts = [np.append(ids[a:b], np.uint32(END_ID)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            wide = [bool(x.max() >= 65536) for x in parts]
            blobs = [squeeze.compress(x.astype(np.uint32 if w else np.uint16).tobytes()) for x, w in zip(parts, wide, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.texts), pa.array([len(x) for x in parts], pa.int64()), pa.array(wide), pa.array(blobs, pa.binary())],
                                             names=["doc_id", "n", "wide", "ids"])

    return run


def _ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    expand = zstandard.ZstdDecompressor()
    for wide, blob in zip(batch.column("wide").to_pylist(), batch.column("ids"), strict=True):
        yield np.frombuffer(expand.decompress(blob.as_py()), np.uint32 if wide else np.uint16)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        waiting, n = [], 0
        for ids in [*_ids(batch), None]:
            if ids is not None:
                waiting.append(ids)
                n += len(ids)
            if waiting and (ids is None or n >= _COUNTED):
                got = np.bincount(np.concatenate(waiting), minlength=len(total))
                got[: len(total)] += total
                total, waiting, n = got, [], 0
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], names=["id", "n"])


def _encoded(lengths: np.ndarray, block_ids: int):
    codes = canonical(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, start = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, start
            if not docs:
                return
            flat = np.concatenate(held)
            payload, checkpoints = pack(flat, lengths, codes)
            yield pa.RecordBatch.from_pylist([{
                "part": part, "block": block, "start": start, "n": len(flat), "doc_ids": list(docs), "sizes": [len(h) for h in held],
                "checkpoints": checkpoints.astype("<u8").tobytes(), "payload": payload,
            }], schema=_BLOCK)
            block, start = block + 1, start + len(flat)
            docs.clear()
            held.clear()

        waiting = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), _ids(batch), strict=True):
                docs.append(doc_id)
                held.append(ids)
                waiting += len(ids)
                if waiting >= block_ids:
                    yield from flush()
                    waiting = 0
        yield from flush()

    return run


_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("sizes", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("payload", pa.binary())])
_BLOCK_SQL = "part int, block int, start long, n long, doc_ids array<long>, sizes array<long>, checkpoints binary, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
                 code_bits: int = CODE_BITS, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text and write `path`/codebook and `path`/blocks in ascending id order.

    `tokenizer` is a file of the tokenizers library with a byte-level splitter, readable on every
    executor. Each document ends with id 0. Null and empty texts are the end id alone. Null ids come first; rows with
    one id are documents of their own, ordered by size and ids. Other columns are ignored. An empty table gives no block.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = stored(arrow_map(docs, _tokenised(tokenizer), "doc_id long, n long, wide boolean, ids binary"), "ids")
    counts = ids.mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    table = np.zeros(max([1, *(r.id + 1 for r in counts)]), np.int64)
    for r in counts:
        table[r.id] = r.n
    lengths = code_lengths(table, code_bits)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n", "ids")
    ordered.mapInArrow(_encoded(lengths, block_ids), _BLOCK_SQL).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _decoded(lengths: np.ndarray):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for row in batch.to_pylist():
            ids = decoder.unpack(row["payload"], np.frombuffer(row["checkpoints"], "<u8"), row["n"]).astype("<u4")
            ends = np.cumsum(row["sizes"])
            starts = ends - row["sizes"]
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array([row["part"]] * len(crc), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                pa.array(starts + row["start"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(crc, pa.int64()),
            ], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    return run


def _code(spark: SparkSession, path: str) -> np.ndarray:
    book = spark.read.parquet(f"{path}/codebook").collect()  # at most the vocabulary
    lengths = np.zeros(max([1, *(r.id + 1 for r in book)]), np.uint8)
    for r in book:
        lengths[r.id] = r.length
    return lengths


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files below `path`."""
    blocks = spark.read.schema(_BLOCK_SQL).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("own"))  # a row per written file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    docs = arrow_map(blocks, _decoded(_code(spark, path)), "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(parts, "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document: the ids themselves."""
    lengths = _code(spark, path)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for row in batch.to_pylist():
            ids = decoder.unpack(row["payload"], np.frombuffer(row["checkpoints"], "<u8"), row["n"])
            cuts = np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int64)))],
                                             names=["doc_id", "ids"])

    return arrow_map(spark.read.schema(_BLOCK_SQL).parquet(f"{path}/blocks"), run, "doc_id long, ids array<long>")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the ids of `docs` to a new folder of the shared scratch space and read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(spark, path)
