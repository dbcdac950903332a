import collections
import random
import re
import zlib

import numpy as np

from talkloom.llm import gam
from talkloom.llm.quality import keep_quality, quality_scores
from talkloom.llm.rules import quality_rules
from tests.llm import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(spark, n=400):
    rnd = random.Random(3)
    rows, marks = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        words = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(30, 120))]
        rows.append((i, " ".join(words) + "." if good else " ".join(w + rnd.choice(["###", "***", "%%%"]) for w in words)))
        marks.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), dict(m[:2] for m in marks)


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_additive_model_learns_an_interaction():
    rnd = np.random.default_rng(1)
    x = rnd.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_classifier_on_held_out_rows(spark):
    docs, labels, truth = corpus(spark)
    out = quality_scores(docs, labels).collect()
    assert len(out) == len(truth) and all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in out)
    assert np.mean([r.predicted == truth[r.doc_id] for r in out if r.held_out]) > 0.97
    # Labels of held-out rows are never used.
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    assert {r.doc_id: r.score for r in quality_scores(docs, turned).collect()} == {r.doc_id: r.score for r in out}


def test_rules_counts_and_verdicts(spark):
    docs, labels, truth = corpus(spark)
    out = quality_rules(docs, labels).collect()
    assert np.mean([r.kept == truth[r.doc_id] for r in out if held(r.doc_id)]) > 0.97


def test_edges(spark):
    docs, labels = edge.documents(spark), edge.labels(spark)
    scores = quality_scores(docs, labels).collect()
    assert len(scores) == len(edge.ROWS) and all(0 <= r.score <= 1 for r in scores)
    assert keep_quality(docs, labels).columns == docs.columns
    none = edge.labels(spark, [])
    assert {r.score for r in quality_scores(docs, none).collect()} == {0.5}
    rules = quality_rules(docs, none).collect()
    want = []
    for _, text in edge.ROWS:
        text = text or ""
        words, seen, twice = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                twice += line in seen
                seen.add(line)
        counts = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        marked = {i + k for i in range(len(words) - 7) if counts[tuple(words[i:i + 8])] > 1 for k in range(8)}
        want.append((len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(marked), len(words) < 20 or 100 * len(marked) > 30 * len(words)))
    got = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules]
    assert sorted(got) == sorted(want) and not any(r.kept and r.base_failed for r in rules)
    for fn in (quality_scores, quality_rules, keep_quality):
        assert fn(edge.documents(spark, []), none).count() == 0
