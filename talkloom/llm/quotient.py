"""Counting quotient filters: sorted, lossless and compact counters of packed keys.

A key is `words` ids of `bits` bits, kept as two or more limbs of at most 64 bits. An invertible permutation (rounds that xor one limb
with a hash of its neighbour) spreads keys evenly. The leading `block_bits` bits of a permuted key name its block, the next ones are its quotient and all others its
remainder, so nothing is lost. A filter of one block holds a bitmap of the quotients in use, one bit per entry that ends the run of a
quotient, the remainders in order, and a byte per counter (255: the value stands in a list of its own).
Filters of one block are in key order whatever their quotient bits are, so they merge as sorted runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from talkloom.llm.words import mix, stream

_U = np.uint64
_ROUNDS = 3


class Layout(NamedTuple):
    """Keys of `words` ids below 2**bits, cut into blocks by the leading bits."""

    words: int
    bits: int
    block_bits: int

    @property
    def widths(self) -> list[int]:
        total = max(2, self.words * self.bits)
        n = max(2, -(-total // 64))
        return [total // n + (i < total % n) for i in range(n)]


class Filter(NamedTuple):
    """The entries of one block: how many, quotient bits, bitmap of quotients, run ends, remainders, counters, large counters."""

    entries: int
    quotient_bits: int
    occupied: bytes
    run_ends: bytes
    remainders: bytes
    counters: bytes
    large: bytes


def _mask(width: int) -> np.uint64:
    return _U((1 << width) - 1)


def _places(layout: Layout) -> Iterator[tuple[int, int, int]]:
    """(limb, id, shift): a limb holds an id shifted left by `shift` bits, right where that is negative."""
    end = sum(layout.widths)
    for limb, width in enumerate(layout.widths):
        end -= width
        for i in range(layout.words):
            shift = (layout.words - 1 - i) * layout.bits - end
            if -layout.bits < shift < width:
                yield limb, i, shift


def pack(ids: np.ndarray, layout: Layout) -> list[np.ndarray]:
    """Limbs of the keys of the rows of `ids`, the first id in the leading bits."""
    out = [np.zeros(len(ids), _U) for _ in layout.widths]
    for limb, i, shift in _places(layout):
        part = ids[:, i].astype(_U)
        out[limb] |= (part << _U(shift) if shift >= 0 else part >> _U(-shift)) & _mask(layout.widths[limb])
    return out


def unpack(limbs: list[np.ndarray], layout: Layout) -> np.ndarray:
    out = np.zeros((len(limbs[0]), layout.words), _U)
    for limb, i, shift in _places(layout):
        out[:, i] |= limbs[limb] >> _U(shift) if shift >= 0 else limbs[limb] << _U(-shift)
    return (out & _mask(layout.bits)).astype(np.int64)


def _steps(layout: Layout) -> list[tuple[int, np.uint64]]:
    n = len(layout.widths)
    return [(i % n, salt) for i, salt in enumerate(stream(_ROUNDS * n, 131))]


def permute(limbs: list[np.ndarray], layout: Layout) -> list[np.ndarray]:
    limbs = list(limbs)
    for i, salt in _steps(layout):
        limbs[i] = limbs[i] ^ (mix(limbs[i - 1] + salt) >> _U(64 - layout.widths[i]))
    return limbs


def restore(limbs: list[np.ndarray], layout: Layout) -> list[np.ndarray]:
    """The inverse of `permute`."""
    limbs = list(limbs)
    for i, salt in reversed(_steps(layout)):
        limbs[i] = limbs[i] ^ (mix(limbs[i - 1] + salt) >> _U(64 - layout.widths[i]))
    return limbs


def counted(limbs: list[np.ndarray], counts: np.ndarray | None, layout: Layout) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct keys in order, and the sum of the counts (1 each) of every one."""
    if not len(limbs[0]):
        return limbs, np.zeros(0, np.int64)
    widths = layout.widths
    if sum(widths) <= 64:
        joined = (limbs[0] << _U(widths[1])) | limbs[1]
        if counts is None:
            joined = np.sort(joined)
        else:
            order = np.argsort(joined, kind="stable")
            joined, counts = joined[order], counts[order]
        limbs = [joined >> _U(widths[1]), joined & _mask(widths[1])]
        new = np.ones(len(joined), bool)
        np.not_equal(joined[1:], joined[:-1], out=new[1:])
    else:
        order = np.lexsort(limbs[::-1])
        limbs = [limb[order] for limb in limbs]
        counts = None if counts is None else counts[order]
        new = np.zeros(len(order), bool)
        new[0] = True
        for limb in limbs:
            new[1:] |= limb[1:] != limb[:-1]
    first = np.flatnonzero(new)
    total = np.diff(np.concatenate([first, [len(new)]])) if counts is None else np.add.reduceat(counts, first)
    return [limb[first] for limb in limbs], total.astype(np.int64)


def _bytes(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest bytes of every value that hold `width` bits."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :-(-width // 8)]


def _values(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data), 8), np.uint8)
    out[:, :data.shape[1]] = data
    return out.reshape(-1).view("<u8").astype(_U)


def filters(limbs: list[np.ndarray], counts: np.ndarray, layout: Layout) -> Iterator[tuple[int, Filter]]:
    """(block, filter) of distinct permuted keys in order."""
    widths, s = layout.widths, layout.block_bits
    blocks = limbs[0] >> _U(widths[0] - s) if s else np.zeros(len(limbs[0]), _U)
    cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]])) if len(blocks) else np.zeros(1, int)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        q = min(max(b - a - 1, 0).bit_length(), widths[0] - s)
        lead = limbs[0][a:b] & _mask(widths[0] - s)
        rest = widths[0] - s - q
        quotient = (lead >> _U(rest)).astype(np.int64) if q else np.zeros(b - a, np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        ends = np.ones(b - a, bool)
        np.not_equal(quotient[1:], quotient[:-1], out=ends[:-1])
        parts = [_bytes(lead & _mask(rest), rest), *[_bytes(limb[a:b], w) for limb, w in zip(limbs[1:], widths[1:], strict=True)]]
        n = counts[a:b]
        yield int(blocks[a]), Filter(b - a, q, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), np.concatenate(parts, 1).tobytes(),
                                     np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].astype("<i8").tobytes())


def entries(block: int, held: Filter, layout: Layout) -> tuple[list[np.ndarray], np.ndarray]:
    """Permuted keys in order, and counts, of a filter."""
    widths, s, n, q = layout.widths, layout.block_bits, held.entries, held.quotient_bits
    rest = widths[0] - s - q
    ends = np.unpackbits(np.frombuffer(held.run_ends, np.uint8), count=n)
    used = np.flatnonzero(np.unpackbits(np.frombuffer(held.occupied, np.uint8), count=1 << q)).astype(_U)
    quotient = used[np.cumsum(ends) - ends]
    sizes = [-(-w // 8) for w in (rest, *widths[1:])]
    data = np.frombuffer(held.remainders, np.uint8).reshape(n, sum(sizes))
    parts = [_values(p) for p in np.split(data, np.cumsum(sizes)[:-1], 1)]
    lead = parts[0] | (quotient << _U(rest)) if q else parts[0]
    if s:
        lead = lead | (_U(block) << _U(widths[0] - s))
    counts = np.frombuffer(held.counters, np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(held.large, "<i8")
    return [lead, *parts[1:]], counts


def merged(parts: list[tuple[list[np.ndarray], np.ndarray]], layout: Layout) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted runs of several filters as one, the counts of equal keys added."""
    limbs = [np.concatenate([p[0][i] for p in parts]) for i in range(len(layout.widths))]
    return counted(limbs, np.concatenate([p[1] for p in parts]), layout)
