"""N-gram Jaccard join: blocked product of the document by n-gram incidence.

The product A * A^T counts the n-grams two documents share. It is never formed whole:

1. *Column blocks.* The n-grams of a document of size class c fall by hash into k(c) blocks. Two
   documents with Jaccard >= t differ in at most D = (a + b)(1 - t)/(1 + t) n-grams, so with
   k = D + 1 + s blocks at least 1 + s blocks hold equal n-grams. A block's digest is one
   signature; the s blocks to spare let a document leave out its nearly empty blocks, which are
   not selective. Documents meet only where a signature is equal. No frequency cut is needed and no
   link is lost.
2. *Stars.* In each list of equal signatures every document is paired with one hub.
   Pairs beyond the size bound, or whose parity sketches differ in more than D bits, are discarded.
   The rest are multiplied block by block: the overlap accumulates over ranges of n-gram hashes,
   and a pair goes as soon as what is left cannot reach the bound.
3. *The rest.* Lists whose documents are still in several components are taken again, in tiles of
   bounded size: pairs across components that pass the sketch bound are verified the same way. A tile
   with more such pairs than documents first gives the pairs of a forest over its components; where
   these do not join them all, it gives every pair still across components.

So a group of thousands of near copies costs one pair per copy, not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.components import components
from talkloom.llm.frames import arrow_map, bounded_batches, stored
from talkloom.llm.words import chunks, distinct_shingles, mix

_U = np.uint64
SKETCH_WORDS = 16  # parity sketch: 1024 bits
WIDE_FROM = 512  # sets from this size on have a second sketch of two to four bits per n-gram; the short one tells long sets apart no more
SIGN_BITS = 48  # of a block digest; equal digests only propose, so fewer bits cost pairs to discard and lose no link
BLOCKS = 4  # ranges of the verifying product
BATCH_BYTES = 2 << 20  # of texts handed to Python at once; the JVM's heap is full of digests meanwhile
TILE = 1024  # documents on one side of a tile
BROADCAST_IDS = 1_000_000  # up to so many candidate ids (16 MB) are sent to every executor


@lru_cache(maxsize=None)
def size_classes(num: int, den: int, upto: int) -> list[tuple[int, int, int, int, int]]:
    """(smallest size, largest size that can meet it, blocks, blocks to spare, least block size) per class."""
    out, low = [], 1
    while low <= upto:
        last = max(low, math.ceil(low * 1.25) - 1)
        most = last * den // num
        differ = (last + most) * (den - num) // (den + num)
        plan = (differ + 1, 0, 0)
        for least in (3, 2, 1):
            fits = None
            for spare in range(int(0.3 * (differ + 1)) + 2):
                k = differ + 1 + spare
                rate = low / k
                few = k * sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(least))
                if spare >= few + 2 * math.sqrt(few):
                    fits = (k, spare, least)
                    break
            if fits:
                plan = fits
                break
        out.append((low, most, *plan))
        low = last + 1
    return out


def _class_of(n: int, num: int, den: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    upto = 1 << max(10, n.bit_length())
    classes = size_classes(num, den, upto)
    lo, hi = 0, len(classes)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if classes[mid][0] <= n else (lo, mid)
    return classes, lo


def signatures(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """Block digests of a sorted n-gram set, in its own size class and the one below where they can meet."""
    n = len(grams)
    if not n:
        return np.zeros(0, _U)
    classes, own = _class_of(n, num, den)
    sums = np.zeros(n + 1, _U)
    np.cumsum(mix(grams ^ _U(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    high, out = grams >> _U(32), []
    for c in (own, own - 1):
        if c < 0 or n > classes[c][1]:
            continue
        _, _, k, spare, least = classes[c]
        edges = np.searchsorted((high * _U(k)) >> _U(32), np.arange(k + 1, dtype=_U))
        sizes = np.diff(edges)
        marks = mix(np.arange(k, dtype=_U) + _U(c << 32)) + sizes.astype(_U)
        digests = mix((sums[edges[1:]] - sums[edges[:-1]]) ^ mix(marks))
        weak = sizes < least
        out.append(digests[~weak] if weak.sum() <= spare else digests)
    return np.concatenate(out) >> _U(64 - SIGN_BITS)


def _int64(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == _U else values.astype(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, _U)
    return pa.ListArray.from_arrays(pa.array(offsets), _int64(flat))


def _parity(grams: np.ndarray, bits: int) -> np.ndarray:
    """Per value of the lowest bits of the n-grams whether their count is odd; halves of a sketch xored are the one of half the bits."""
    odd = np.bincount((grams & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(_U)


def _wide(grams: np.ndarray) -> np.ndarray:
    return _parity(grams, 2 << len(grams).bit_length()) if len(grams) >= WIDE_FROM else np.zeros(0, _U)


def _rows(num: int, den: int, size: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batch.column(1)):
            n, d1, d2, sketches, wide, signs = [], [], [], [], [], []
            for grams in distinct_shingles(chunk, size):
                n.append(len(grams))
                d1.append(mix(grams).sum(dtype=_U))
                d2.append(mix(grams + _U(0x5851F42D4C957F2D)).sum(dtype=_U))
                sketches.append(_parity(grams, SKETCH_WORDS * 64))
                wide.append(_wide(grams))
                signs.append(signatures(grams, num, den))
            ids = batch.column(0).slice(chunk.first, chunk.texts)
            yield pa.RecordBatch.from_arrays(
                [ids, _int64(np.array(n)), _int64(np.array(d1, _U)), _int64(np.array(d2, _U)), _lists(sketches), _lists(wide), _lists(signs)],
                names=["doc_id", "n", "d1", "d2", "sketch", "wide", "signs"])

    return run


def _sets(size: int):
    """Of each document its n-gram set in BLOCKS arrays, cut by the highest bits of the hash."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batch.column(1)):
            n, d1, d2 = [], [], []
            blocks: list[list[np.ndarray]] = [[] for _ in range(BLOCKS)]
            step = (1 << 64) // BLOCKS
            marks = np.array([i * step for i in range(1, BLOCKS)], _U)
            for grams in distinct_shingles(chunk, size):
                n.append(len(grams))
                d1.append(mix(grams).sum(dtype=_U))
                d2.append(mix(grams + _U(0x5851F42D4C957F2D)).sum(dtype=_U))
                for k, part in enumerate(np.split(grams, np.searchsorted(grams, marks))):
                    blocks[k].append(part)
            yield pa.RecordBatch.from_arrays(
                [_int64(np.array(n)), _int64(np.array(d1, _U)), _int64(np.array(d2, _U)), *[_lists(b) for b in blocks]],
                names=["n", "d1", "d2", *[f"b{k}" for k in range(BLOCKS)]])

    return run


def _need(num: int, den: int) -> Column:
    """Overlap from which den * overlap >= num * union, for sizes n and m."""
    return F.ceil((F.col("n") + F.col("m")) * F.lit(num) / F.lit(num + den)).cast("long")


def _folded(sketch: str, other: str) -> Column:
    """A wide sketch in the bits of another one, which has as many, or half or twice as many where the two may link."""
    half = F.floor(F.size(sketch) / 2).cast("int")
    xored = F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(sketch) > F.size(other), xored).otherwise(F.col(sketch))


def _may_link(num: int, den: int) -> Column:
    """The size bound and the sketch bounds: differing parity bits never exceed differing n-grams."""

    def within(a: Column | str, b: Column | str) -> Column:
        differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return differ * F.lit(num + den) <= (F.col("n") + F.col("m")) * F.lit(den - num)

    close = F.least("n", "m") * F.lit(den) >= F.greatest("n", "m") * F.lit(num)
    fits = F.greatest(F.size("wide"), F.size("wide_b")) <= 2 * F.least(F.size("wide"), F.size("wide_b"))  # else one has none
    return close & within("sketch", "sketch_b") & (~fits | within(_folded("wide", "wide_b"), _folded("wide_b", "wide")))


def _verified(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """pairs(d1, d2, n, e1, e2, m) of n-gram sets -> the linked ones as (d1, d2, e1, e2).

    Each factor's rows are read again from the texts of the candidates; overlaps accumulate block
    by block, and a filter after each block discards what cannot reach the bound any more.
    """
    wanted = stored(pairs.select(F.col("id_a").alias("doc_id")).unionByName(pairs.select(F.col("id_b").alias("doc_id"))).distinct(), "candidates")
    few = wanted.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "leftsemi")
    sets = arrow_map(kept, _sets(size), "n long, d1 long, d2 long, " + ", ".join(f"b{k} array<long>" for k in range(BLOCKS)))
    left = sets.select("d1", "d2", *[F.col(f"b{k}").alias(f"a{k}") for k in range(BLOCKS)])
    right = sets.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), *[f"b{k}" for k in range(BLOCKS)])
    rows = pairs.join(right, ["e1", "e2"]).join(left, ["d1", "d2"])
    rows = rows.withColumn("need", _need(num, den)).withColumn("seen", F.lit(0)).withColumn("rest_a", F.col("n")).withColumn("rest_b", F.col("m"))
    for k in range(BLOCKS):
        rows = (rows.withColumn("seen", F.col("seen") + F.size(F.array_intersect(f"a{k}", f"b{k}")))
                .withColumn("rest_a", F.col("rest_a") - F.size(f"a{k}")).withColumn("rest_b", F.col("rest_b") - F.size(f"b{k}"))
                .filter(F.col("seen") + F.least("rest_a", "rest_b") >= F.col("need")).drop(f"a{k}", f"b{k}"))
    return rows.select("id_a", "id_b").distinct()


def _forest(comps: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Of pairs of components, places of those that join what they reach without a circle, pairs that differ least first."""
    names, ends = np.unique(comps, return_inverse=True)
    parent, taken = list(range(len(names))), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    ends = ends.reshape(comps.shape)
    order = np.argsort(differ, kind="stable")
    keys = np.minimum(ends[0], ends[1])[order] * len(names) + np.maximum(ends[0], ends[1])[order]
    first = np.sort(np.unique(keys, return_index=True)[1])  # one pair for each two components
    for k in order[first].tolist():
        a, b = find(int(ends[0][k])), find(int(ends[1][k]))
        if a != b:
            parent[a] = b
            taken.append(k)
    return np.array(taken, np.int64)


def _tiles(num: int, den: int, every: bool):
    """Pairs across components in runs of equal (sign, i, j); rows arrive sorted by these.

    Unless `every` is set, a tile with more pairs than rows gives a forest of them and a row with its `sign`.
    """

    def pairs(cols: list[np.ndarray], sketches: np.ndarray) -> Iterator[np.ndarray]:
        row, comp, hub, n, d1, d2, side, same = cols
        _, first = np.unique(np.stack([d1, d2, side], 1), axis=0, return_index=True)
        row, comp, hub, n, d1, side, sketches = row[first], comp[first], hub[first], n[first], d1[first], side[first], sketches[first]
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same[0] else 1))
        for a in one.tolist():
            other = two[row[two] > row[a]] if same[0] else two
            ok = (comp[other] != comp[a]) & (d1[other] != d1[a]) & (row[other] != hub[a]) & (row[a] != hub[a])
            ok &= np.minimum(n[other], n[a]) * den >= np.maximum(n[other], n[a]) * num
            other = other[ok]
            if not len(other):
                continue
            differ = np.bitwise_count(sketches[other] ^ sketches[a]).sum(1, dtype=np.int64)
            near = differ * (num + den) <= (n[other] + n[a]) * (den - num)
            other, differ = other[near], differ[near]
            if len(other):
                yield np.stack([np.minimum(row[other], row[a]), np.maximum(row[other], row[a]), comp[other], np.full(len(other), comp[a]), differ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        key = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                block = np.concatenate([h[0] for h in held], 1)
                got = list(pairs(list(block), np.concatenate([h[1] for h in held])))
                held.clear()
                if got:
                    found = np.concatenate(got, 1)
                    part = not every and found.shape[1] > block.shape[1]
                    both = found[:2, _forest(found[2:4], found[4])] if part else found[:2]
                    none = [None] * both.shape[1]
                    yield pa.RecordBatch.from_arrays([
                        pa.concat_arrays([_int64(both[0]), pa.nulls(int(part), pa.int64())]), pa.concat_arrays([_int64(both[1]), pa.nulls(int(part), pa.int64())]),
                        pa.array(none + [key[0]] * part, pa.int64())], names=["row_a", "row_b", "sign"])

        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
            keys = np.stack([get("sign"), get("i"), get("j")], 1)
            block = np.stack([get(c) for c in ("row", "comp", "hub", "n", "d1", "d2", "side")] + [(keys[:, 1] == keys[:, 2]).astype(np.int64)])
            sketch = batch.column("sketch").flatten().to_numpy(zero_copy_only=False).view(_U).reshape(-1, SKETCH_WORDS)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            edges = [0, *cuts.tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                now = tuple(keys[a].tolist())
                if now != key:
                    yield from flush()
                    key = now
                held.append((block[:, a:b], sketch[a:b]))
        yield from flush()

    return run


def ngram_jaccard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`.

    Words are lower-cased in A-Z. Two documents link when den * |intersection| >= num * |union| of
    their sets of `words`-word shingles; component_id is the smallest id reachable by links.

    Null and empty texts have no shingles and link with nothing. Rows with one id are one
    document, linked where any of its texts is. Rows without an id keep their size, have a null component and take no part
    in links. Other columns are ignored. An empty table gives an empty result. Ids are integers.
    """
    spark = docs.sparkSession
    bounded_batches(spark, BATCH_BYTES)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = arrow_map(docs, _rows(num, den, words), "doc_id long, n long, d1 long, d2 long, sketch array<long>, wide array<long>, signs array<long>")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "incidence")
    named = rows.filter("doc_id is not null and n > 0")

    # Equal sets: every document is linked with the smallest id of its set.
    reps = named.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("far")).filter("rep != far").drop("far")
    reps = stored(reps, "equal-sets")  # so that the engine can split a hot set in the join
    copies = named.select("doc_id", "d1", "d2").join(reps, ["d1", "d2"]).filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()

    # Lists of equal signatures; only lists of two and more go on.
    signed = named.select("row", F.explode("signs").alias("sign"))
    lists = signed.groupBy("sign").agg(F.min("row").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    members = stored(signed.join(lists, "sign"), "lists")

    meta = named.select("row", "doc_id", "n", "d1", "d2", "sketch", "wide")
    other = meta.select(F.col("row").alias("row_b"), F.col("doc_id").alias("id_b"), F.col("n").alias("m"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("sketch").alias("sketch_b"), F.col("wide").alias("wide_b"))

    def candidates(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.join(meta.withColumnsRenamed({"row": "row_a", "doc_id": "id_a"}), "row_a").join(other, "row_b")
        both = both.filter("id_a != id_b and not (d1 = e1 and d2 = e2)").filter(_may_link(num, den))
        return stored(both.select("id_a", "id_b", "n", "m", "d1", "d2", "e1", "e2").dropDuplicates(["d1", "d2", "e1", "e2"]), name)

    stars = members.filter("row != hub").select(F.col("hub").alias("row_a"), F.col("row").alias("row_b")).distinct()
    linked = _verified(candidates(stars, "star-pairs"), docs, words, num, den)
    links = stored(copies.unionByName(linked.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))), "first-links")
    found = stored(components(links), "components")

    # Lists with documents of several components.
    def across(lists: DataFrame, found: DataFrame, every: bool) -> DataFrame:
        place = meta.join(found, meta.doc_id == found.node, "left").select("row", "n", "d1", "d2", "sketch", F.coalesce("component", "doc_id").alias("comp"))
        placed = stored(lists.join(place.select("row", "comp"), "row"), "placed")
        split = placed.groupBy("sign").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("sign")
        open_ = placed.join(split, "sign").withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
        open_ = open_.withColumn("own", F.pmod(F.hash("row"), "tiles"))
        tiled = open_.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        tiled = tiled.select("sign", "row", "hub", "comp", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).cast("long").alias("side"))
        tiled = tiled.join(place.drop("comp"), "row").repartition("sign", "i", "j").sortWithinPartitions("sign", "i", "j")
        return stored(tiled.mapInArrow(_tiles(num, den, every), "row_a long, row_b long, sign long"), "rest")

    left = members
    for every in (False, True):
        rest = across(left, found, every)
        more = _verified(candidates(rest.filter("sign is null").select("row_a", "row_b").distinct(), "rest-pairs"), docs, words, num, den)
        more = stored(more.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), "more-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            found = stored(components(links), "components")
        again = rest.filter("sign is not null").select("sign").distinct()
        if again.isEmpty():
            break
        left = members.join(again, "sign")  # lists whose forest may have left a link out
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(found, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
