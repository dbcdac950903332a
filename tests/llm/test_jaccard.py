import random
import re

import numpy as np
import pyarrow as pa
import pytest

from talkloom.llm import jaccard
from talkloom.llm.components import components
from talkloom.llm.jaccard import ngram_jaccard
from tests.llm import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, num, den):
    """(doc_id, sizes) and the smallest reachable id, over all pairs."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if a is not None and b is not None and s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def near_copies(seed):
    rnd = random.Random(seed)
    rows = []
    for group in range(12):
        base = [f"g{group}x{rnd.randrange(500)}" for _ in range(rnd.choice([12, 40, 90, 300, 1500]))]
        for _ in range(rnd.choice([1, 2, 5, 25])):
            words = list(base)
            for _ in range(rnd.randrange(0, max(2, len(words) // 25))):
                words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    common = " ".join(f"c{i}" for i in range(30))
    rows += [(len(rows) + i, common + " " + " ".join(f"r{rnd.randrange(10**6)}" for _ in range(25))) for i in range(40)]
    return rows


@pytest.mark.parametrize("size, num, den, seed", [(3, 90, 100, 1), (5, 8, 10, 2)])
def test_against_all_pairs(spark, size, num, den, seed):
    rows = near_copies(seed)
    out = ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), words=size, num=num, den=den).collect()
    assert sorted(map(tuple, out), key=repr) == brute(rows, size, num, den)


def test_edges_and_empty(spark):
    out = ngram_jaccard(edge.documents(spark), words=3, num=90, den=100).collect()
    assert sorted(map(tuple, out), key=repr) == brute(edge.ROWS, 3, 90, 100)
    assert ngram_jaccard(edge.documents(spark, [])).count() == 0


def swarm(seed):
    """Copies of one text with a change each, which link with each other; before them forty texts with seven changes, which link with none."""
    rnd = random.Random(seed)
    rows = []
    for i in range(100):
        words = [f"b{k}" for k in range(200)]
        for at in rnd.sample(range(200), 7 if i < 40 else 1):
            words[at] = f"e{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_a_group_without_links_to_its_hubs(spark, monkeypatch, seed):
    seen, tiles = [], jaccard._tiles
    monkeypatch.setattr(jaccard, "_tiles", lambda num, den, every: seen.append(every) or tiles(num, den, every))
    rows = swarm(seed)
    out = ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), words=5, num=8, den=10).collect()
    assert sorted(map(tuple, out), key=repr) == brute(rows, 5, 8, 10)
    assert seen == [False, True]  # a forest, then every pair still across components


def test_a_tile_gives_a_forest_and_its_sign():
    n = 40
    zeros = np.zeros(n, np.int64)
    columns = {"row": np.arange(n) + 100, "sign": zeros + 7, "hub": zeros, "comp": np.arange(n) // 2, "i": zeros, "j": zeros, "side": zeros, "n": zeros + 500,
               "d1": np.arange(n), "d2": np.arange(n)}
    sketch = pa.array([[0] * jaccard.SKETCH_WORDS] * n, pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns.values()), sketch], names=[*columns, "sketch"])
    part, = jaccard._tiles(8, 10, False)(iter([batch]))
    assert part.num_rows == n // 2 and part.column("sign").to_pylist() == [None] * (n // 2 - 1) + [7]
    links = {(a - 100) // 2 * 100 + (b - 100) // 2 for a, b in zip(part.column(0).to_pylist()[:-1], part.column(1).to_pylist()[:-1], strict=True)}
    assert len(links) == n // 2 - 1
    whole, = jaccard._tiles(8, 10, True)(iter([batch]))
    assert whole.num_rows == n * (n - 1) // 2 - n // 2 and whole.column("sign").null_count == whole.num_rows


def test_wide_sketches_fold_and_keep_linked_sets(spark):
    rnd = np.random.default_rng(5)
    rows, want = [], []
    for n in (600, 1000, 1050, 3000, 5000):
        grams = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        for cut, fits in ((n // 10, True), (n // 3, False)):
            other = np.unique(np.concatenate([grams[cut:], rnd.integers(0, 1 << 63, cut // 2, dtype=np.uint64)]))
            differ = len(np.setxor1d(grams, other))
            rows.append((len(grams), len(other), *([int(x) for x in f(g).view(np.int64)] for f in (lambda g: jaccard._parity(g, 1024), jaccard._wide) for g in (grams, other))))
            want.append(fits)
            assert (differ * 18 <= (len(grams) + len(other)) * 2) is fits
    frame = spark.createDataFrame(rows, "n long, m long, sketch array<long>, sketch_b array<long>, wide array<long>, wide_b array<long>")
    assert [r.ok for r in frame.select(jaccard._may_link(8, 10).alias("ok")).collect()] == want


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)]
    out = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
