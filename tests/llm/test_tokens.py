import zlib

import numpy as np
import pytest

from talkloom.llm import huffman
from talkloom.llm.tokens import read_ids, read_tokens, write_tokens
from tests.llm import edge

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_50k.json")


def expected(texts):
    from tokenizers import Tokenizer

    return [e.ids + [0] for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n, limit", [(1, 18), (2, 3), (300, 9), (5000, 14)])
def test_codes_round_trip(n, limit):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.zipf(1.3, 20_000), n) - 1
    lengths = huffman.code_lengths(np.bincount(ids, minlength=n), limit)
    assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths[lengths > 0]) <= 1
    payload, checkpoints = huffman.pack(ids, lengths, huffman.canonical(lengths))
    assert (huffman.Decoder(lengths).unpack(payload, checkpoints, len(ids)) == ids).all()


def test_lengths_are_optimal():
    # Without a tight limit package-merge gives Huffman's cost.
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 1, 1, 2])
    heap = counts.tolist()
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((huffman.code_lengths(counts, 12) * counts).sum()) == cost


TEXTS = ["", "a  b", " lead\n\n\ttail  ", "x\x85y z\x1cw", "don't  stop!!\r\n\r\nNow 12 345", "été ß   　 end ", "<|endoftext|> a<|endoftext|>", "ZZ" * 5000]


def test_files(spark, tmp_path):
    rows = [(i, t) for i, t in edge.ROWS if i is not None and i != 2] + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(-5, "first")]
    write_tokens(edge.documents(spark, rows), str(tmp_path / "t"), PATH, block_ids=1000)
    rows.sort(key=lambda r: r[0])
    want, start = [], 0
    ids = expected([t or "" for _, t in rows])
    for (i, _), own in zip(rows, ids, strict=True):
        want.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(map(tuple, read_tokens(spark, str(tmp_path / "t")).collect())) == want
    assert {r.doc_id: r.ids for r in read_ids(spark, str(tmp_path / "t")).collect()} == dict(zip([i for i, _ in rows], ids, strict=True))


def test_empty_and_repeated(spark, tmp_path):
    write_tokens(edge.documents(spark, []), str(tmp_path / "e"), PATH)
    assert read_tokens(spark, str(tmp_path / "e")).count() == 0
    write_tokens(edge.documents(spark), str(tmp_path / "r"), PATH)
    out = sorted(map(tuple, read_tokens(spark, str(tmp_path / "r")).select("start", "n_tokens").collect()))
    assert len(out) == len(edge.ROWS) and all(a + n == b for (a, n), (b, _) in zip(out, out[1:], strict=False))
