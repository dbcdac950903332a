"""Decontamination, line dedup and the pipeline."""

import random

import corpus_pipeline
from talkloom.llm import decontaminate
from talkloom.llm.decontaminate import drop_leaks, find_leaks
from talkloom.llm.lines import line_dedup
from tests.llm import edge

QUESTION = "a train leaves the station with 40 passengers and, said Maria Lopez, another 25 board after 3 hours so how many people does Maria count at the end"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def leaks(spark, texts, items=((1, QUESTION),)):
    out = find_leaks(edge.documents(spark, list(enumerate(texts))), bench(spark, list(items))).collect()
    return {(r.doc_id, r.item_id): r.verbatim for r in out}


def test_reparameterised_questions(spark):
    other = QUESTION.replace("40", "77").replace("25", "1,312").replace("Maria", "Hans").replace("hours", "minutes")
    mixed = QUESTION.replace("Maria Lopez", "Hans Lopez")  # the second Maria stays: her windows do not fit together
    got = leaks(spark, [f"intro words. {QUESTION} and more", f"x {other} y", f"x {QUESTION.upper()} y", "nothing of the kind is here at all, really nothing", mixed, None, "", QUESTION.lower()])
    assert got[0, 1] is True and got[1, 1] is False and (2, 1) in got and (7, 1) in got
    assert {k[0] for k in got} <= {0, 1, 2, 4, 7}


def test_placeholders_alone_do_not_match(spark):
    assert leaks(spark, ["1 2 3 4 5 6 7 8 9 10 11 12"], [(1, "9 8 7 6 5 4 3 2 1 0 9 8"), (2, None), (3, "short one"), (None, "")]) == {}


def test_leak_edges(spark):
    docs, items = edge.documents(spark), bench(spark, [(1, edge.text(100, 180)), (1, edge.text(100, 180)), (None, edge.text(0, 30))])
    found = {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()}
    assert found == {(4, 1), (11, 1), (12, 1), (1, None), (2, None), (3, None), (None, None), (12, None)}
    left = drop_leaks(docs, items)
    assert left.columns == docs.columns and left.count() == len(edge.ROWS) - 8
    assert find_leaks(edge.documents(spark, []), items).count() == 0 and drop_leaks(docs, bench(spark, [])).count() == len(edge.ROWS)


def passage(name, lines=12):
    return "\n".join(f"{name} line {i} has several words in it" for i in range(lines))


def test_line_dedup(spark):
    rnd = random.Random(1)
    own = lambda: "\n".join(f"own {rnd.random()}" for _ in range(3))
    rows = [(i, own() + "\n" + passage("p") + "\n" + own()) for i in range(20, 25)] + [(30, own()), (31, own())] + edge.ROWS[:2]
    out = {r.doc_id: r for r in line_dedup(edge.documents(spark, rows)).collect()}
    texts = dict(rows)
    assert out[20].text == texts[20] and out[30].text == texts[30] and out[30].n_removed == 0
    for i in range(21, 25):
        assert out[i].n_removed >= 8
        kept = out[i].text.split("\n")
        assert len(kept) == out[i].n_lines - out[i].n_removed and kept[:3] == texts[i].split("\n")[:3] and kept[-3:] == texts[i].split("\n")[-3:]
    assert out[2].text == "" and out[2].n_removed == 1  # a repeated line of 60 words


def test_passages_among_other_repeated_lines(spark):
    """A long line and a passage are cut out alike whatever repeated lines stand around them."""
    stock = [f"stock phrase {i}" for i in range(6)]
    filler = [(100 + i, "\n".join(f"own {i} {k}\n{s}" for k, s in enumerate(stock))) for i in range(40)]
    rows = [(i, f"{stock[i]}\n{edge.text(0, 60)}\n{stock[5 - i]}") for i in range(3)]
    rows += [(10 + i, f"{stock[i]}\n{passage('q', 3)}\n{stock[5 - i]}") for i in range(3)]
    out = {r.doc_id: r for r in line_dedup(edge.documents(spark, rows + filler)).collect()}
    texts = dict(rows)
    assert out[0].text == texts[0] and out[10].text == texts[10] and all(out[i].n_removed == 0 for i, _ in filler)
    for i in (1, 2):
        assert out[i].text == f"{stock[i]}\n{stock[5 - i]}"
        assert 2 <= out[10 + i].n_removed <= 3 and out[10 + i].text.split("\n")[0] == stock[i] and out[10 + i].text.split("\n")[-1] == stock[5 - i]


def test_line_dedup_edges(spark):
    out = line_dedup(edge.documents(spark)).collect()
    assert len(out) == len(edge.ROWS)
    assert [r.text for r in out if r.doc_id == 5] == [None] and {(r.n_lines, r.n_removed) for r in out if r.doc_id == 6} == {(1, 0)}
    assert line_dedup(edge.documents(spark, [])).count() == 0
    # Everything that is gone stands somewhere in what is left.
    left = "\n".join(r.text or "" for r in out)
    assert all(line in left for _, t in edge.ROWS for line in (t or "").split("\n") if line.strip())


def test_pipeline_stages(spark, tmp_path):
    rows = [(i, " ".join(f"d{i}x{k}" for k in range(40 + i))) for i in range(30)] + [(50, " ".join(f"d3x{k}" for k in range(43))), (60, edge.text(100, 180)), (70, None), (71, "")]
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark, [(1, edge.text(100, 180))]).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        path = str(tmp_path / name.split()[0])
        out.write.parquet(path)
        before, now = now, spark.read.parquet(path)
        ids[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == before.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(ids[names[0]]) == len(rows)
    assert ids[names[0]] - ids[names[1]] == {50}
    assert ids[names[1]] - ids[names[2]] == {60}
    assert ids[names[4]] == ids[names[3]] <= ids[names[2]] - {70, 71}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


TOM = "Tom has 5 apples and buys 3 more. Tom gives 2 to Ann today. Tom sells 4 of them to a man. How many apples are left?"


def test_names_at_the_start_of_sentences(spark):
    other = TOM.replace("Tom", "Bob").replace("Ann", "Sue").replace("5", "9").replace("3", "6").replace("2", "8").replace("4", "1")
    quoted = '"' + other.replace(". Bob", '."\n"Bob')
    mixed = TOM.replace("Tom has", "Bob has").replace("Tom sells", "Max sells").replace("many", "few").replace("today", "then")
    got = leaks(spark, [f"Before it. {other} After it.", quoted, TOM, mixed.replace("buys", "sells")], [(1, TOM)])
    assert {k for k in got} == {(0, 1), (1, 1), (2, 1)} and got[2, 1] is True and got[0, 1] is False


def test_copies_with_different_values(spark):
    """A worksheet asks the question several times; each copy alone counts."""
    def asked(name, friend, *numbers):
        out = TOM.replace("Tom", name).replace("Ann", friend)
        for old, new in zip("5324", numbers, strict=True):
            out = out.replace(old, f"<{new}>")
        return out.replace("<", "").replace(">", "")

    copies = [asked("Bob", "Sue", 9, 16, 8, 1), asked("Eve", "Joe", 7, 12, 11, 6), asked("Max", "Kim", 10, 15, 13, 17)]
    got = leaks(spark, ["\n".join(copies[:2]), "\n".join(copies), copies[0] + " " + "Between them is other text. " * 30 + copies[2], "\n".join([*copies, TOM])], [(1, TOM)])
    assert got == {(0, 1): False, (1, 1): False, (2, 1): False, (3, 1): True}


def test_passage_of_a_long_item(spark):
    item = edge.text(0, 300)
    got = leaks(spark, [f"before it {edge.text(50, 75)} and behind", f"before it {edge.text(50, 62)} and behind", " or ".join(edge.text(k, k + 9) for k in range(0, 90, 9))], [(1, item)])
    assert got == {(0, 1): True}


def test_no_boundary_hides_a_passage(spark):
    """Every pair of adjacent lines that stood earlier goes, whatever stands around it; against brute force."""
    rnd = random.Random(3)
    body = lambda name, k: " ".join(f"{name}{k}w{i}" for i in range(25))
    filler = [(1000 + i, f"own {i} a\nstock line\nown {i} b\n{body('p', 2)}\nown {i} c") for i in range(30)]
    rows = [(i, f"mine {i}\n{body('p', 1)}\nstock line\n\n{body('p', 2)}\n{body('p', 3)}\nyours {i}") for i in range(6)] + filler
    rows += [(100 + i, "\n".join(rnd.choice([f"line {k}" for k in range(12)] + [f"only {i}"]) for _ in range(rnd.randrange(1, 15)))) for i in range(60)]
    out = {r.doc_id: r for r in line_dedup(edge.documents(spark, rows)).collect()}
    first = {}
    for i, text in sorted(rows):
        lines = [x for x in text.split("\n") if x]
        gone = set()
        for k, pair in enumerate(zip(lines, lines[1:], strict=False)):
            doc, at = first.setdefault(pair, (i, k))
            if (doc, at) != (i, k) and not (doc == i and k == at + 1):
                gone |= {k, k + 1}
        assert [x for x in out[i].text.split("\n") if x] == [x for k, x in enumerate(lines) if k not in gone], i
    assert all(out[i].text == f"mine {i}\nyours {i}" for i in range(1, 6)) and out[0].text == rows[0][1]


def test_pipeline_mixes_by_quality(spark, tmp_path):
    docs = spark.createDataFrame([(i, "w w w w", "en", "abc"[i % 3], 7, 3.0) for i in range(6000)], "doc_id long, text string, lang string, source string, n_chars long, weight double")
    spark.createDataFrame([(i, i // 3 % 2, 0) for i in range(6000)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.mixing(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    rows = out.filter("source = 'c'").collect()
    good = sum(r.doc_id // 3 % 2 for r in rows)
    assert good > 2 * (len(rows) - good) and {r.weight for r in rows} == {3.0}


def test_pipeline_leaves_only_its_result(spark, tmp_path):
    import os

    from talkloom.scratch import scratch_root

    root = f"{scratch_root(spark).removeprefix('file:')}/talkloom"
    edge.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    edge.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, edge.text(100, 180))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(os.listdir(root)) - before) == 1 and out.count() > 0


def test_stages_of_empty_tables(spark, tmp_path):
    edge.labels(spark, []).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    none = edge.documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == none.columns


def joins_planned(monkeypatch, run):
    """Broadcast joins and merge joins in the plans of the tables `run` stores and of the frame it returns, with nothing counted small; and the frame."""
    plans, stored = {}, decontaminate.stored
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()

    def seen(df, name):
        plans[name] = plan(df)
        return stored(df, name)

    monkeypatch.setattr(decontaminate, "stored", seen)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    out = run()
    plans["out"] = plan(out)
    return {name: (p.count("BroadcastHashJoin"), p.count("SortMergeJoin")) for name, p in plans.items()}, out


def with_hits(spark):
    other = TOM.replace("Tom", "Bob").replace("Ann", "Sue").replace("5", "9").replace("3", "6").replace("2", "8")
    docs = edge.documents(spark, [*edge.ROWS, (20, TOM), (21, f"Before it. {other}"), (21, f"Before it. {other}"), (21, TOM), (None, other)])
    return docs, bench(spark, [(1, edge.text(100, 180)), (2, TOM), (None, edge.text(0, 30)), (3, None)])


def test_hits_are_not_broadcast_for_small_files(spark, monkeypatch):
    """Files of a few MB hold more rows than the driver can: the engine must not broadcast a side because of its files' size."""
    docs, items = with_hits(spark)
    found = sorted(map(str, find_leaks(docs, items).collect()))
    joins, out = joins_planned(monkeypatch, lambda: find_leaks(docs, items))
    assert joins["hits"] == (0, 1) and joins["values"] == (0, 2)
    assert joins["out"] == (1, 2)  # the broadcast one is with the number of windows, a row per item
    assert sorted(map(str, out.collect())) == found and len(found) > 10


def test_leaks_are_not_broadcast_for_small_files(spark, monkeypatch):
    docs, items = with_hits(spark)
    left = sorted(map(str, drop_leaks(docs, items).collect()))
    joins, out = joins_planned(monkeypatch, lambda: drop_leaks(docs, items))
    assert joins["out"] == (0, 1) and joins["values"] == (0, 2)
    assert sorted(map(str, out.collect())) == left and 0 < len(left) < docs.count()
