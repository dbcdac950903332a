import random

import numpy as np
import pyarrow as pa

from talkloom.llm import toxicity
from talkloom.llm.toxicity import LONGEST, WINDOW, toxicity_scores
from talkloom.llm.words import chunks
from tests.llm import edge
from tests.llm.test_quality import held

INSULTS = ["grobian", "schuft", "lump", "halunke", "trottel"]


def corpus(spark, n=600):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(2, 9))) for _ in range(3000)]
    rows, marks = [], []
    for i in range(n):
        bad = rnd.random() < 0.2
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(40, 160))]
        if bad:
            for _ in range(rnd.randrange(3, 7)):
                words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {m[0]: m[2] for m in marks}


def brute_windows(text):
    """The same windows, word by word."""
    out, at, bucket = [], 0, None
    for word in (text or "").encode().lower().split():
        for k in range(0, len(word), LONGEST):
            piece = word[k:k + LONGEST]
            if at // WINDOW != bucket:
                bucket = at // WINDOW
                out.append(toxicity._PRIMER.tobytes())
            out[-1] += b" " + piece
            at += len(piece) + 1
    return out


def test_windows_equal_a_walk_over_words():
    texts = ["", "one", None, " \n\t", "x" * 1000 + " y", "Ärger über ÉTÉ " * 9, "a b c d e f g h i j k l m n o p q r s t u v", "tail " * 50 + "z" * 64]
    column = pa.array(texts, pa.large_string())
    for limit in (1 << 20, 1):
        got = []
        for chunk in chunks(column, limit):
            data, spans, bounds = toxicity.windows(chunk)
            whole = data.tobytes()
            parts = [whole[a:a + n] for a, n in spans.tolist()]
            got += [parts[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        assert got == [brute_windows(t) for t in texts]


def test_counts_equal_single_compressions():
    by = [toxicity.compressor(c) for c in (b"plain words are here" * 20, b"grobian schuft lump trottel" * 20 + toxicity._PRIMER.tobytes())]
    texts = ["you grobian and lump and schuft", "quite plain words are here", "", "schuft " * 100]
    x = toxicity.features(next(chunks(pa.array(texts, pa.large_string()))), *by)
    for row, text in zip(x, texts, strict=True):
        distance = [len(by[0].compress(w)) - len(by[1].compress(w)) for w in brute_windows(text)]
        want = [sum(d >= t for d in distance) for t in toxicity.THRESHOLDS]
        n = max(len(distance), 1)
        assert np.allclose(row, [*np.log1p(want), *[10 * k / n for k in want], np.log1p(len(distance)), max(distance, default=0)])


def test_held_out_rows_are_told_apart(spark):
    docs, labels, truth = corpus(spark)
    out = toxicity_scores(docs, labels).collect()
    assert len(out) == len(truth) and all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    rows = [r for r in out if r.held_out]
    assert np.mean([r.predicted for r in rows if truth[r.doc_id]]) > 0.9 and np.mean([r.predicted for r in rows if not truth[r.doc_id]]) < 0.05
    # Labels of held-out rows are never used, and a rerun agrees.
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    assert {r.doc_id: r.score for r in toxicity_scores(docs.repartition(7), turned).collect()} == {r.doc_id: r.score for r in out}


def test_edges(spark):
    docs = edge.documents(spark)
    scores = toxicity_scores(docs, edge.labels(spark)).collect()
    assert len(scores) == len(edge.ROWS) and all(0 <= r.score <= 1 for r in scores)
    assert not any(r.held_out for r in scores if r.doc_id is None)
    none = edge.labels(spark, [])
    assert {r.score for r in toxicity_scores(docs, none).collect()} == {0.5}
    assert toxicity_scores(edge.documents(spark, []), none).count() == 0
    both = edge.labels(spark, [(1, 1, 1), (4, 0, 0), (3, 0, 0), (8, 0, 1), (11, 0, 0), (9, 1, 1), (10, 1, 0), (2, 1, 1), (2, 1, 0)])
    assert toxicity_scores(docs, both).count() == len(edge.ROWS)
