"""Words, lines and 64-bit hashes of whole texts, computed over the bytes of Arrow string columns.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. These bytes never occur inside a
longer UTF-8 sequence, so byte runs are character runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_CHUNK = 1 << 20  # bytes handled at a time; a longer text is a chunk of its own
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor-shift and multiply rounds)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """`n` fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
BYTES = stream(256, 11)
LOWER = BYTES.copy()
LOWER[65:91] = LOWER[97:123]
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, extended by doubling."""
    for name, base in (("up", _BASE), ("down", _INVERSE)):
        have = _POWERS.get(name)
        if have is None or len(have) < n:
            size, out = 1, np.ones(1, _U)
            while size < n:
                out = np.concatenate([out, out * _U(pow(base, size, 1 << 64))])
                size *= 2
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """64-bit hash of each span; spans are sorted and do not overlap. Equal bytes have equal hashes."""
    out, i = np.zeros(len(starts), _U), 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        part = data[base:int(ends[j - 1])]
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(table[part] * up[: len(part)], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(_U) * _U(0xD1B54A32D192ED03))
        i = j
    return out


class Chunk(NamedTuple):
    """Some texts: `first` row in the batch, their bytes, and `bounds` of each text in `data`."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1


def chunks(column: pa.Array, limit: int = _CHUNK) -> Iterator[Chunk]:
    """Cut a string column (null: empty text) into runs of whole texts of about `limit` bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield Chunk(i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        i = j


class Words(NamedTuple):
    """Spans of the words of a chunk, and of each text the range of its words."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def words(chunk: Chunk, separator: np.ndarray = SEPARATOR) -> Words:
    inside = ~separator[chunk.data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = chunk.bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return Words(starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, chunk.bounds))


def lines(chunk: Chunk) -> Words:
    """Spans of the \\n-split lines of each text; an empty text has one empty line."""
    newline = np.flatnonzero(chunk.data == 10)
    texts = np.searchsorted(chunk.bounds[1:], newline, "right")  # the text each newline belongs to
    starts = np.sort(np.concatenate([chunk.bounds[:-1], newline + 1]), kind="stable")
    ends = np.sort(np.concatenate([newline, chunk.bounds[1:]]), kind="stable")
    counts = np.bincount(texts, minlength=chunk.texts) + 1
    return Words(starts, ends, np.concatenate([[0], np.cumsum(counts)]))


def window_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` consecutive values; windows may cross texts, the caller drops those."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    weights, total = stream(size, 77), np.zeros(n, _U)
    for k in range(size):
        total += hashes[k:k + n] * weights[k]
    return mix(total)


def sums_by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of `values` over each range of `bounds`."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def distinct_shingles(chunk: Chunk, size: int, table: np.ndarray = LOWER) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its `size`-word shingles.

    A text of fewer words has the whole sequence as its one shingle; a text without words has none.
    """
    w = words(chunk)
    hashes = span_hash(chunk.data, w.starts, w.ends, table)
    windows = window_hash(hashes, size)
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= size:
            part = np.sort(windows[a:b - size + 1])
            keep = np.ones(len(part), bool)
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            yield part[keep]
        elif b > a:
            yield mix(window_hash(hashes[a:b], b - a) + _U(b - a))
        else:
            yield np.zeros(0, _U)


def repeated_windows(hashes: np.ndarray, size: int) -> int:
    """Words of one text inside `size`-word windows that occur twice or more in it."""
    windows = window_hash(hashes, size)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(windows) + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + size, -1)
    return int((np.cumsum(steps) > 0).sum())


def repeated_lines(hashes: np.ndarray) -> int:
    """Lines of one text that equal an earlier one."""
    return len(hashes) - len(np.unique(hashes))


def codepoints(data: np.ndarray) -> np.ndarray:
    """True at the first byte of every character."""
    return (data & 0xC0) != 0x80
