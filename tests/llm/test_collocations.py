import random
import re
from collections import Counter

import numpy as np
import pytest

from talkloom.llm import collocations as c
from talkloom.llm import quotient
from tests.llm import edge


@pytest.mark.parametrize("words, bits, block_bits", [(2, 1, 0), (2, 1, 1), (2, 5, 3), (3, 13, 4), (2, 32, 0), (5, 13, 7), (5, 25, 0), (5, 31, 9), (4, 33, 20)])
def test_filters_keep_every_key_and_count(words, bits, block_bits):
    rnd = np.random.default_rng(words * bits)
    layout = quotient.Layout(words, bits, block_bits)
    ids = rnd.integers(0, min(1 << bits, 1 << 62), (3000, words))
    ids[1000:2500] = ids[rnd.integers(0, 5, 1500)]
    limbs = quotient.pack(ids, layout)
    assert (quotient.unpack(limbs, layout) == ids).all()
    mixed = quotient.permute(limbs, layout)
    assert all((a == b).all() for a, b in zip(quotient.restore(mixed, layout), limbs, strict=True))
    parts = {}
    for a, b in ((0, 1200), (1200, 1201), (1201, 3000)):
        keys, counts = quotient.counted([limb[a:b] for limb in mixed], None, layout)
        for block, held in quotient.filters(keys, counts, layout):
            parts.setdefault(block, []).append(quotient.entries(block, held, layout))
    found = Counter()
    for part in parts.values():
        keys, counts = quotient.merged(part, layout)
        for row, n in zip(quotient.unpack(quotient.restore(keys, layout), layout).tolist(), counts.tolist(), strict=True):
            assert tuple(row) not in found
            found[tuple(row)] = n
    assert found == Counter(map(tuple, ids.tolist()))
    assert list(quotient.filters(*quotient.counted([limb[:0] for limb in mixed], None, layout), layout)) == []


def brute(rows, least, keep, longest=5):
    grams, total = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            grams.update((lang, *ws[i:i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    grams = {g: n for g, n in grams.items() if n >= least}
    inside = {}
    for (lang, *p), n in grams.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[(lang, *p[i:i + k])] = max(n, inside.get((lang, *p[i:i + k]), 0))
    found = {}
    for (lang, *p), a in grams.items():
        if len(p) > 1 and 100 * inside.get((lang, *p), -1) < 100 * a:
            cuts = [(1000 * a * total[lang] // (l * r), l, r) for k in range(1, len(p)) for l, r in [(grams[(lang, *p[:k])], grams[(lang, *p[k:])])]]
            score, l, r = cuts[min(range(len(cuts)), key=lambda k: (cuts[k][0], k))]
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, total[lang], -s) for lang, of in found.items() for rank, (s, a, p, l, r) in enumerate(sorted(of)[:keep], 1))


def rows(n=300):
    rnd = random.Random(8)
    names = ["The", "the", "of", "new", "York", "é", "ÉTÉ", "to", "be", "or", "not", "\x00x", "日本"] + [f"r{i}" for i in range(200)]
    fixed = ["new York city hall to", "to be or not to be", "日本 é 日本"]
    out = []
    for _ in range(n):
        parts = [rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(names) for _ in range(rnd.randrange(60))]
        text = "".join(p + rnd.choice([" ", " ", " ", " \t", ", ", ".\n", "!"]) for p in parts)
        out.append((text, rnd.choice(["en", "en", "fr", None, "und", "x\x00y"])))
    return [*out, (None, "en"), ("", None), (" \t\n.,", "de"), ("to be or not to be " * 9000, "long"), *[("same words again and again", "fr")] * 12]


@pytest.mark.parametrize("limits", [{}, {"rows_limit": 0}, {"prune_rows": 0}])
def test_phrases_equal_plain_counting(spark, monkeypatch, limits):
    monkeypatch.setattr(c, "RUN", 64)
    monkeypatch.setattr(c, "TOGETHER", 2000)
    given = rows()
    frame = spark.createDataFrame([(t, lang, 1, "w", 2) for t, lang in given], "text string, lang string, id int, word string, n int").repartition(3)
    for least, keep in ((5, 10), (40, 2000)):
        got = c.collocations(frame, least=least, keep=keep, **limits).collect()
        assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute(given, least, keep)


def test_edges(spark):
    assert c.collocations(edge.documents(spark, [])).count() == 0
    assert c.collocations(edge.documents(spark), least=2).count() > 0
    assert c.collocations(edge.documents(spark)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
