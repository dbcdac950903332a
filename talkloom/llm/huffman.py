"""Canonical length-limited Huffman codes: lengths, packing, table-driven unpacking from checkpoints."""

from __future__ import annotations

import numpy as np

EVERY = 256  # tokens between two checkpoints


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return out
    if len(used) == 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    weights = counts[order].astype(np.float64)
    merged, leaf, levels = weights, np.ones(len(order), bool), []
    for _ in range(limit - 1):
        levels.append(leaf)
        even = merged[: len(merged) // 2 * 2]
        both = np.concatenate([weights, even[::2] + even[1::2]])
        place = np.argsort(both, kind="stable")
        merged, leaf = both[place], place < len(weights)
    levels.append(leaf)
    take, lengths = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id: by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    own = lengths[order].astype(np.int64)
    if len(order):
        top = int(own.max())
        starts = np.concatenate([[0], np.cumsum(np.int64(1) << (top - own))[:-1]])
        codes[order] = (starts >> (top - own)).astype(np.uint64)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of `ids`, first bit highest, and the bit offset of every EVERY-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    value = codes[ids]
    out = np.zeros((int(ends[-1]) if len(ids) else 0) // 64 + 2, np.uint64)
    word, shift = at >> 6, 64 - (at & 63) - size
    inside = shift >= 0
    high = np.where(inside, value << np.where(inside, shift, 0).astype(np.uint64), value >> np.where(inside, 0, -shift).astype(np.uint64))
    if len(ids):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.add.reduceat(high, first)
        over = np.flatnonzero(~inside)
        out[word[over] + 1] += value[over] << (64 + shift[over]).astype(np.uint64)
    return out.astype(">u8").tobytes(), at[::EVERY]


class Decoder:
    """A table over the next `top` bits gives the id and its length; all checkpoint runs advance together."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.top = int(lengths.max()) if len(used) else 1
        codes = canonical(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        spans = np.int64(1) << (self.top - lengths[order].astype(np.int64))
        self.symbol = np.zeros(1 << self.top, np.uint32)
        self.size = np.ones(1 << self.top, np.int64)
        at = (codes[order] << (self.top - lengths[order].astype(np.int64)).astype(np.uint64)).astype(np.int64)
        where = np.repeat(at - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(int(spans.sum()))
        self.symbol[where] = np.repeat(order, spans)
        self.size[where] = np.repeat(lengths[order], spans)

    def unpack(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        raw = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint32)
        four = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at, out = checkpoints.astype(np.int64).copy(), np.zeros((EVERY, len(checkpoints)), np.uint32)
        mask, last = np.uint32((1 << self.top) - 1), len(four) - 1
        for step in range(EVERY):
            look = (four[np.minimum(at >> 3, last)] >> (32 - self.top - (at & 7)).astype(np.uint32)) & mask
            out[step] = self.symbol[look]
            at += self.size[look]
        return out.T.reshape(-1)[:n]
