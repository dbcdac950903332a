import itertools
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.operators import chunks, paper_edit, render, subtitles, timeline
from talkloom.plans import flows, q_render
from tests import walk


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of a few rows, so that every carry between blocks is exercised."""
    monkeypatch.setattr(timeline, "BLOCK_ROWS", 5)
    monkeypatch.setattr(paper_edit, "BLOCK_ROWS", 5)
    monkeypatch.setattr(render, "PART_ROWS", 2)


def by_transcript(rows):
    return {t: list(g) for t, g in itertools.groupby(sorted(rows), key=lambda r: r[0])}


def chapters_for(rows, seed=0):
    out = []
    for t, ws in by_transcript(rows).items():
        picks = sorted({ws[(seed + 7 * k) % len(ws)][3] + (0.1 * (k % 3)) for k in range(4)})
        out += [(t, k, at, f"C{k}") for k, at in enumerate(picks + [ws[-1][4] + 100])]
    return out


def whole(df, spark=None):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.transcript_id, r.part_no)):
        got[r.transcript_id] = got.get(r.transcript_id, "") + r.text
    return got


def expected(rows):
    return {t: walk.repair([(s[0], walk.sentences_of(s)) for s in walk.segments_of(ws)]) for t, ws in by_transcript(rows).items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_finished_transcript_equals_the_walk(spark, small_blocks, seed):
    rows = walk.random_words(seed, transcripts=12)
    chapters = chapters_for(rows, seed)
    done = flows.finalise(spark.createDataFrame(rows, walk.WORDS),
                          spark.createDataFrame(chapters, "transcript_id long, chapter_no long, start_s double, title string"))
    segments = expected(rows)
    got = {(r.transcript_id, r.seg_no, r.sent_no): r for r in done.sentences.collect()}
    for t, segs in segments.items():
        n = 0
        for i, (speaker, ss) in enumerate(segs):
            for s in ss:
                r = got.pop((t, i, n))
                assert (r.speaker, r.start_s, r.end_s, r.first_pos, r.last_pos) == (speaker, s[0][3], s[-1][4], s[0][1], s[-1][1])
                n += 1
    assert not got
    snapped = {t: walk.snap(segs, [c[1:] for c in chapters if c[0] == t]) for t, segs in segments.items()}
    assert {(r.transcript_id, r.chapter_no): r.start_s for r in done.chapters.collect()} == {
        (t, no): at for t, cs in snapped.items() for no, at, _ in cs}
    for per_line in (True, False):
        texts = whole(done.transcript(per_line))
        assert texts == {t: walk.text_of(segs, snapped[t], per_line) for t, segs in segments.items()}
    paras = paper_edit.dpe_paragraphs(done.sentences, done.chapters, done.placed).collect()
    for t, segs in segments.items():
        mine = sorted((r.id, r.start, r.end, r.speaker, r.chapter) for r in paras if r.transcript_id == t)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert [m[1:] for m in mine] == walk.paragraphs(segs, snapped[t])
    for t, text in whole(done.paper_edit()).items():
        doc = json.loads(text)
        assert [w["text"] for w in doc["words"]] == [w[6] for w in by_transcript(rows)[t]]
        assert len(doc["paragraphs"]) == len(walk.paragraphs(segments[t], snapped[t]))


def test_without_diarization_there_is_one_segment(spark, small_blocks):
    rows = walk.random_words(5, transcripts=3)
    single = {t: [("x", walk.sentences_of(("x", ws)))] for t, ws in by_transcript(rows).items()}
    none = spark.createDataFrame([], "transcript_id long, chapter_no long, start_s double, title string")
    chapters = chapters_for(rows)
    done = flows.finalise(spark.createDataFrame(rows, walk.WORDS), spark.createDataFrame(chapters, none.schema), diarize=False)
    for per_line in (True, False):
        want = {t: walk.text_of(s, walk.snap(s, [c[1:] for c in chapters if c[0] == t]), per_line, single=True) for t, s in single.items()}
        assert whole(done.transcript(per_line)) == want
    parts = timeline.speaker_segments(spark.createDataFrame(rows, walk.WORDS), diarize=False).collect()
    for t, ws in by_transcript(rows).items():
        mine = sorted((r.part_no, r.text) for r in parts if r.transcript_id == t)
        assert " ".join(x for _, x in mine) == " ".join(w[6] for w in ws)
        assert all(len(x.split()) <= 5 for _, x in mine)


def test_every_word_is_in_one_segment_and_repair_keeps_the_order(spark, small_blocks):
    rows = walk.random_words(6, transcripts=6)
    marked = timeline.mark_words(spark.createDataFrame(rows, walk.WORDS))
    assert marked.count() == len(rows)
    fixed = timeline.repair_sentences(timeline.sentences(marked)).orderBy("transcript_id", "sent_no").collect()
    for t, ws in by_transcript(rows).items():
        covered = [p for r in fixed if r.transcript_id == t for p in range(r.first_pos, r.last_pos + 1)]
        assert covered == [w[1] for w in ws]


@pytest.mark.parametrize("case,owner", [("first longer", 0), ("second longer", 1), ("tie", 1), ("equal confidence", None)])
def test_owner_of_a_broken_sentence(spark, case, owner):
    first = 5.0 if case == "first longer" else 2.0
    second = 5.0 if case == "second longer" else 2.0
    conf = 0.5 if case == "equal confidence" else 0.75
    rows = [(1, 0, 0, 0.0, first, 0.5, "and"), (1, 1, 1, 10.0, 10.0 + second, conf, "then."), (1, 2, 1, 20.0, 21.0, 0.5, "ok.")]
    out = timeline.repair_sentences(timeline.sentences(timeline.mark_words(spark.createDataFrame(rows, walk.WORDS))))
    got = [(r.speaker, r.first_pos, r.last_pos) for r in out.orderBy("sent_no").collect()]
    assert got == ([(0, 0, 0), (1, 1, 1), (1, 2, 2)] if owner is None else [(owner, 0, 1), (1, 2, 2)])


@pytest.mark.parametrize("seconds", [4.0, 10.0])
def test_word_groups_over_blocks(spark, seconds):
    rows = walk.random_words(7, transcripts=10, n=120, steps_back=True)
    out = subtitles.word_cues(spark.createDataFrame(rows, walk.WORDS).drop("speaker"), seconds, block_rows=9)
    got = {}
    for r in out.orderBy("transcript_id", "cue_no", "part_no").collect():
        key = (r.transcript_id, r.cue_no)
        assert r.part_no == (got[key][3] + 1 if key in got else 0)
        got[key] = (r.start_s, r.end_s, f"{got[key][2]} {r.text}" if key in got else r.text, r.part_no)
    got = {key: cue[:3] for key, cue in got.items()}
    for t, ws in by_transcript(rows).items():
        want = [(g[0][3], g[-1][4], " ".join(w[6] for w in g)) for g in walk.cues(ws, seconds)]
        assert [got[(t, k)] for k in range(len(want))] == want and (t, len(want)) not in got


def test_a_cue_that_never_closes_comes_in_parts(spark):
    n, block = 100_000, 4096
    words = spark.range(n).select(F.lit(1).alias("transcript_id"), F.col("id").alias("pos"), F.lit(5.0).alias("start_s"), F.lit(5.0).alias("end_s"), F.lit("w").alias("punctuated_word"))
    out = subtitles.word_cues(words, 10.0, block_rows=block).select("cue_no", "part_no", F.length("text").alias("n")).orderBy("part_no").collect()
    assert {r.cue_no for r in out} == {0} and [r.part_no for r in out] == list(range(-(-n // block))) and max(r.n for r in out) < 2 * block
    every = words.withColumn("end_s", F.lit(50.0))  # every word closes its own cue
    assert subtitles.word_cues(every, 10.0, block_rows=block).agg(F.countDistinct("cue_no"), F.max("part_no")).first() == (n, 0)


def test_cues_over_blocks_are_whole_in_the_query(spark, tmp_path):
    n = 40_000  # of 16384 words a block
    turns = spark.range(40).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.expr("array_join(transform(sequence(id * 1000, id * 1000 + 999), x -> 'w' || x), ' ')").alias("text"))
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    times = [(0.375 * k, 0.375 * k + 0.25) for k in range(n)]
    want, first = [], 0
    for k, (_, end) in enumerate(times):
        if end - times[first][0] >= 10 or k == n - 1:
            want.append((1, len(want), times[first][0], end, " ".join(f"w{i}" for i in range(first, k + 1))))
            first = k + 1
    out = q_render.srt_word_groups(spark, str(tmp_path))
    assert out.columns == ["transcript_id", "cue_no", "start_s", "end_s", "text"]
    assert sorted(map(tuple, out.collect())) == want


def test_parts_of_a_cue_are_joined_in_order(spark):
    rows = [(1, 0, 2, 0.0, 9.0, "c"), (1, 0, 10, 0.0, 9.0, "d"), (1, 0, 1, 0.0, 9.0, ""), (1, 0, 0, 0.0, 9.0, "a b"), (1, 1, 0, 9.0, 9.5, "")]
    out = subtitles.whole_cues(spark.createDataFrame(rows, "transcript_id long, cue_no long, part_no long, start_s double, end_s double, text string"))
    assert sorted(map(tuple, out.collect())) == [(1, 0, 0.0, 9.0, "a b c d"), (1, 1, 9.0, 9.5, "")]


@pytest.mark.parametrize("seed", range(4))
def test_closing_words_equal_a_search(seed):
    rnd = np.random.default_rng(seed)
    n = int(rnd.integers(1, 90))
    start = np.round(np.cumsum(rnd.random(n)), 1)
    end = start + np.round(rnd.normal(0.5, 3, n), 1)
    want = [next((j for j in range(i, n) if end[j] - start[i] >= 2.0), n) for i in range(n)]
    assert subtitles.closing_words(start, end, 2.0).tolist() == want


def test_a_million_short_paragraphs_pack_in_linear_time(spark):
    texts = {n: "\n\n".join(["ab"] * n) for n in (250_000, 1_000_000)}
    took = {}
    for n, text in texts.items():
        begin = time.perf_counter()
        cuts = chunks._cuts(np.full(n, 2), 1000)
        took[n] = time.perf_counter() - begin
        assert cuts[0] == (0, 250) and len(cuts) == n // 250
    assert took[1_000_000] < 12 * took[250_000] + 0.5
    out = chunks.pack_paragraphs(spark.createDataFrame([(1, texts[1_000_000])], "id long, text string"), "text", 5000)
    assert out.agg(F.count("*"), F.max("n_chunks"), F.max(F.length("chunk"))).first() == (800, 800, 4998)


def test_two_chapters_due_at_once_cascade_or_share(spark):
    rows = spark.createDataFrame([(1, i, 10.0 * i) for i in range(4)], "transcript_id long, n long, start_s double")
    chapters = spark.createDataFrame([(1, 0, 5.0, "a"), (1, 1, 6.0, "b"), (1, 2, 25.0, "c"), (1, 3, 99.0, "late")],
                                     "transcript_id long, chapter_no long, start_s double, title string")
    one = {r.title: r.n for r in timeline.place_chapters(chapters, rows, "n").collect()}
    all_due = {r.title: r.n for r in timeline.place_chapters(chapters, rows, "n", cascade=False).collect()}
    assert one == {"a": 1, "b": 2, "c": 3} and all_due == {"a": 1, "b": 1, "c": 3}


def test_segment_text_with_headings_keeps_the_text_as_it_is(spark):
    segments = spark.createDataFrame([(1, i, 10.0 * i, f" s{i}") for i in range(3)], "transcript_id long, n long, start_s double, text string")
    chapters = spark.createDataFrame([(1, 0, 0.0, "a"), (1, 1, 5.0, "b"), (1, 2, 6.0, "c")], "transcript_id long, chapter_no long, start_s double, title string")
    out = render.render_segments(segments, timeline.place_chapters(chapters, segments, "n", cascade=False), "n")
    assert whole(out) == {1: "\n\n## a\n\n s0\n\n## b\n\n\n\n## c\n\n s1 s2"}


def test_utterances_strip_only_the_ends(spark):
    rows = [(1, 0, None, 0.0, "  "), (1, 1, None, 1.0, " One. Two? "), (1, 2, None, 2.0, ""), (1, 3, None, 3.0, "Three"), (1, 4, None, 4.0, " ")]
    df = spark.createDataFrame(rows, "transcript_id long, n long, speaker int, start_s double, text string")
    none = spark.createDataFrame([], "transcript_id long, chapter_no long, start_s double, title string, n long")
    assert whole(render.render_utterances(df, none, "n")) == {1: "One.\nTwo?\n\n\nThree"}
    assert whole(render.render_utterances(df, none, "n", per_line=False)) == {1: "One. Two? \n\nThree"}


def test_first_containing_utterance_wins(spark):
    words = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 4.9, 5.4), (1, 2, 4.0, 5.6), (1, 3, 5.2, 5.5)], "transcript_id long, pos long, start_s double, end_s double")
    utts = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 4.0, 9.0)], "transcript_id long, u long, start_s double, end_s double")
    got = {r.pos: r.u for r in timeline.words_in_utterances(words, utts, "u").collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0}
    assert timeline.unplaced_words(words, timeline.words_in_utterances(words, utts.filter("u = 1"), "u")).count() == 1


def test_summaries_are_joined_by_spaces(spark):
    df = spark.createDataFrame([(1, 0, " a "), (1, 1, "b\n"), (1, 2, "")], "transcript_id long, n long, s string")
    assert whole(render.concat_summaries(df, "n", "s")) == {1: (" " + " a " + " b\n" + " ").strip(" ")}


def test_overlap_matches_equal_all_pairs(spark):
    rows = [(1, c, p, 0, 0.7 * p, 0.7 * p + 0.4) for c in range(3) for p in range(12)] + [(1, 2, 50, 1, 9.9, 10.0)]
    df = spark.createDataFrame(rows, "transcript_id long, chunk_no long, pos long, speaker int, start_s double, end_s double")
    length, overlap = 8.0, 2.0
    step = length - overlap
    want = {(c[1], c[2]) for c in rows for p in rows
            if p[1] == c[1] - 1 and p[5] > step and abs(p[4] + p[1] * step - c[4] - c[1] * step) < overlap}
    assert {(r.chunk_no, r.pos) for r in chunks.overlap_matches(df, length, overlap).collect()} == want


@pytest.mark.parametrize("dur,n", [(100.0, 1), (1200.0, 1), (1200.5, 2), (2370.0, 2), (2371.0, 3)])
def test_windows_of_a_recording(spark, dur, n):
    out = chunks.chunk_windows(spark.createDataFrame([(1, dur)], "id int, d double"), "d").orderBy("chunk_no").collect()
    assert len(out) == n and out[-1].end_s == dur and all(r.start_s == 1170.0 * r.chunk_no for r in out)


@pytest.mark.parametrize("limit", [10, 25, 60])
def test_packing_equals_the_walk(spark, limit):
    texts = ["", "short", "\n\n".join(["a" * 9] * 5), "x" * 70 + "\n\nend", "\n\n\n\nlead\n\n\n\n" + "b" * 30, "one\n\n  two  \n\nthree\n\n" * 6, "\n\n" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in chunks.pack_paragraphs(df, "text", limit).orderBy("id", "chunk_no").collect():
        got.setdefault(r.id, []).append(r.chunk)
    assert got == {i: p for i, t in enumerate(texts) if (p := walk.pack(t, limit))}
    joined = {r.id: r.text for r in chunks.reassemble(chunks.pack_paragraphs(df, "text", limit), ["id"]).collect()}
    assert joined[3] == texts[3]


def test_confidence_annotation(spark, small_blocks):
    rows = [(1, i, 0, float(i), i + 0.5, c, w) for i, (c, w) in enumerate([(0.5, "a"), (0.5, "b"), (0.25, "c."), (0.25, "d")] + [(0.25, "e")] * 9)]
    out = timeline.confidence_runs(spark.createDataFrame(rows, walk.WORDS)).orderBy("run_no", "part_no").collect()
    assert [r.text for r in out] == ["a b[0.5]", "c.[0.25]", "d e e e e", "e e e e e[0.25]"]


def test_has_diarization(spark):
    df = spark.createDataFrame([(1, None), (1, 3), (2, None)], "transcript_id long, speaker int")
    assert {r.transcript_id: r.has_diarization for r in timeline.has_diarization(df).collect()} == {1: True, 2: False}
