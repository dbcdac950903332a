"""Sources, exports, queue, stages and model stages on small hand-made inputs."""

import json

import pytest
from pyspark.sql import functions as F

from talkloom.operators import catalog, model, stages, tags
from talkloom.sinks import exports
from talkloom.sinks.files import write_parts
from talkloom.sinks.named import write_files
from talkloom.sources import documents, providers
from talkloom.sources.tables import conform

DOC = """id long, title string, loc string, raw_text string, corrected_text string, summary string, tags array<string>, speakers array<string>,
categories array<string>, topics array<string>, source_file string, media string, local boolean, date date, episode int, conference string"""


def docs(spark, **over):
    import datetime as dt

    row = dict(id=1, title="Test Transcript", loc="test/location", raw_text="This is a test transcript.\n\nIt has multiple paragraphs.", corrected_text=None,
               summary=None, tags=["tag1", "tag2"], speakers=["Speaker 1", "Speaker 2"], categories=["category1"], topics=None,
               source_file="f.mp3", media="https://example.com/m", local=False, date=dt.date(2024, 1, 1), episode=None, conference=None)
    row.update(over)
    return spark.createDataFrame([tuple(row.values())], DOC)


def test_markdown(spark):
    by = exports.attribution("Test User", "tool", "1.0.0", " --needs-review")
    r = exports.markdown(docs(spark), by).first()
    assert r.path == "test/location/test-transcript.md"
    assert "title: Test Transcript" in r.content and "transcript_by: Test User via tool v1.0.0 --needs-review" in r.content
    head = r.content.split("---\n")[1]
    for dropped in ("type:", "loc:", "chapters:", "description:"):
        assert dropped not in head
    assert r.content.endswith("---\n\nThis is a test transcript.\n\nIt has multiple paragraphs.\n")
    plain = exports.markdown(docs(spark), include_metadata=False).first()
    assert plain.path.endswith("_plain.md") and plain.content == "This is a test transcript.\n\nIt has multiple paragraphs."
    fixed = docs(spark, corrected_text="Fixed.")
    assert exports.markdown(fixed).first().content.endswith("\n\nFixed.\n")
    assert exports.markdown(fixed, body="raw").first().content.endswith("paragraphs.\n")
    empty = docs(spark, raw_text=None)
    assert exports.markdown(empty).count() == 0 and exports.missing_text(empty).first().error


def test_json_with_and_without_attribution(spark):
    plain = json.loads(exports.json_documents(docs(spark)).first().content)
    assert plain["title"] == "Test Transcript" and plain["tags"] == ["tag1", "tag2"] and plain["date"] == "2024-01-01" and "transcript_by" not in plain
    signed = json.loads(exports.json_documents(docs(spark, local=True, date=None), "U via tool v1").first().content)
    assert signed["transcript_by"] == "U via tool v1" and "media" not in signed and "date" not in signed


def test_front_matter_of_a_video(spark):
    df = docs(spark).withColumn("type", F.lit("video")).withColumn(
        "additional_resources", F.array(F.create_map(F.lit("title"), F.lit("Slides"), F.lit("url"), F.lit("https://x/s"))))
    y = F.struct(F.lit("about it").alias("description"), F.array(F.lit("a")).alias("tags"), F.array().cast("array<string>").alias("categories"), F.lit("Chan").alias("channel_name"))
    head = exports.markdown(df.withColumn("youtube", y)).first().content.split("---\n")[1]
    assert "additional_resources:\n  - title: Slides\n    url: \"https://x/s\"\n" in head
    assert head.endswith("youtube:\n  description: about it\n  tags:\n    - a\n  categories: []\n  channel_name: Chan\n")
    none = exports.markdown(df.withColumn("youtube", F.lit(None).cast(y_type()))).first().content
    assert "youtube: null\n" in none


def y_type():
    from talkloom import schemas

    return schemas.PLATFORM


def test_source_document_of_a_video(spark):
    df = docs(spark).withColumn("type", F.lit("video")).withColumn("chapters", F.array().cast("array<string>")).withColumn("description", F.lit(""))
    df = df.withColumn("additional_resources", F.lit(None).cast("array<map<string,string>>")).withColumn("youtube", F.lit(None).cast(y_type()))
    doc = json.loads(df.select(exports.source_document()).first()[0])
    assert doc["youtube"] is None and doc["chapters"] == [] and "description" not in doc and "episode" not in doc and doc["categories"] == ["category1"]


def test_texts_skip_what_is_absent(spark):
    rows = exports.texts(docs(spark, corrected_text="", summary="S")).collect()
    assert {(r.kind, r.path) for r in rows} == {("raw", "test/location/test-transcript_raw.txt"), ("summary", "test/location/test-transcript_summary.txt")}


def test_export_registry():
    assert list(exports.create_exports({})) == ["json"]
    assert list(exports.create_exports({"markdown": True, "text_output": True, "json": False})) == ["markdown", "text"]


def test_named_files_and_parts(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", "é"), ("a/c.txt", "x\ny")], "path string, content string")
    write_files(rows, str(tmp_path))
    write_files(rows, str(tmp_path))  # a repeated job overwrites
    assert (tmp_path / "a/b.txt").read_text() == "é" and (tmp_path / "a/c.txt").read_text() == "x\ny"
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["b.txt", "c.txt"]
    parts = spark.createDataFrame([(1, i, f"{i};") for i in range(9)], "transcript_id long, part_no long, text string")
    write_parts(parts, ["transcript_id"], str(tmp_path / "parts"))
    assert "".join(r.text for r in spark.read.parquet(str(tmp_path / "parts")).orderBy("part_no").collect()) == "".join(f"{i};" for i in range(9))


def test_source_lists_fill_defaults_and_reject(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"source_file": "a.mp3", "excluded": [{"media": "m1"}], "chapters": [["0", 1.5, "Intro"]], "deepgram_output": "dg.json", "youtube": {"tags": ["x"]}}))
    (tmp_path / "many.json").write_text(json.dumps([{"title": "no file"}, {"source_file": "b", "date": "2024-1-1x"}, {"source_file": "c", "date": "2024-01-02", "tags": ["t"]}]))
    good, bad = documents.read_source_list(spark, str(tmp_path))
    rows = {r.source_file: r for r in good.collect()}
    assert set(rows) == {"a.mp3", "c"} and rows["a.mp3"].title == "no-title" and rows["a.mp3"].speakers == [] and rows["a.mp3"].loc == ""
    assert rows["a.mp3"].excluded_media == ["m1"] and rows["a.mp3"].chapters[0].start == 1.5 and str(rows["c"].date) == "2024-01-02"
    assert rows["a.mp3"].deepgram_output.endswith(f"{tmp_path}/dg.json") and rows["c"].deepgram_chunks == []
    assert {r.reason for r in bad.collect()} == {"source_file is required", "date does not match yyyy-MM-dd"}


def test_unknown_provider_lists_the_known_ones():
    with pytest.raises(ValueError, match="deepgram.*smallestai.*whisper"):
        providers.normaliser("nonexistent")
    assert providers.normaliser("whisper")


def test_utterance_output_without_utterances_is_one_segment(spark):
    doc = json.dumps({"transcription": "all of it", "words": [{"word": "all", "start": 1, "end": 2}, {"word": "it", "start": 3, "end": 4}]})
    df = spark.createDataFrame([(1, doc), (2, json.dumps({"transcription": "none"}))], "transcript_id long, output string")
    got = {r.transcript_id: (r.speaker, r.start_s, r.end_s, r.text) for r in providers.utterances_of(df).collect()}
    assert got == {1: (None, 1.0, 4.0, "all of it"), 2: (None, 0.0, 0.0, "none")}


def test_conform_adds_missing_columns(spark):
    df = conform(spark.createDataFrame([(1, "v1")], "id long, video_id string"), "videos")
    assert df.first().id == "1" and "classified_at" in df.columns and df.first().tags is None


def test_queue_takes_one_match_per_request(spark):
    queue = spark.createDataFrame([(1, "l", "a"), (2, "l", "a"), (3, "l", "b"), (4, "m", "a")], "seq long, loc string, title string")
    asked = spark.createDataFrame([(1, "l", "a"), (2, "l", "b"), (3, "l", "b"), (4, "x", "a")], "seq long, loc string, title string")
    left, missing = catalog.queue_remove(queue, asked, "seq")
    assert sorted(r.seq for r in left.collect()) == [2, 4] and sorted(r.seq for r in missing.collect()) == [3, 4]


def test_duplicates_in_queue_and_batch(spark):
    batch = spark.createDataFrame([(1, "l", "a"), (2, "l", "b"), (3, "l", "b"), (4, "l", None), (5, "l", None)], "seq long, loc string, title string")
    queue = spark.createDataFrame([(9, "l", "a")], "seq long, loc string, title string")
    assert sorted(r.seq for r in catalog.queue_duplicates(batch, queue, "seq").collect()) == [1, 3]


def test_updates_fold_in_order_and_may_set_null(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, name string, n int")
    ups = spark.createDataFrame([(1, None, 5, ["n"], 1), (1, None, None, ["name", "n"], 2), (1, "z", 7, ["name"], 3)], "id int, name string, n int, supplied array<string>, seq int")
    got = {r.id: (r.name, r.n) for r in catalog.apply_updates(table, ups, "id", ["name", "n"], "seq", "supplied").collect()}
    assert got == {1: ("z", None), 2: ("b", 2)}


def test_outcome_after_a_failure(spark):
    ids = spark.createDataFrame([(1,), (2,)], "transcript_id long")
    saved = spark.createDataFrame([(1, "media_processing", "completed"), (1, "export", "completed"), (1, "transcription", "failed")], "transcript_id long, stage string, status string")
    plan = stages.stage_plan(ids, saved)
    assert plan.count() == 12
    out = stages.stage_outcome(plan, (F.col("transcript_id") == 1) & (F.col("stage") == "correction"), F.col("stage") != "metadata_extraction")
    got = {t: [r.status for r in out.filter(F.col("transcript_id") == t).orderBy("stage_no").collect()] for t in (1, 2)}
    assert got[1] == ["completed", "completed", "skipped", "failed", "skipped", "skipped"]
    assert got[2] == ["completed", "completed", "skipped", "completed", "completed", "completed"]
    assert {(r.transcript_id, r.overall, r.failed_stage) for r in stages.overall(out).collect()} == {(1, "failed", "correction"), (2, "completed", None)}


def counting():
    """Fails as a batch, and for one prompt alone."""

    def run(batch):
        if len(batch) > 1 or batch[0] == "bad":
            raise RuntimeError("no")
        return [batch[0].upper()]

    return run


def test_a_failing_row_does_not_fail_the_job(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "d")], "id int, p string").coalesce(1)
    got = {r.id: (r.reply, r.error) for r in model.model_stage(df, counting, "p").collect()}
    assert got == {1: ("A", None), 2: (None, "RuntimeError: no"), 3: (None, None), 4: ("D", None)}


def failing():
    raise_it = True

    def run(batch):
        assert not raise_it

    return run


def test_metadata_extraction_cases(spark):
    reply = {"speakers": ["Bob"], "conference": "Conf", "topics": ["a", "b", "c"]}
    text = json.dumps(reply)
    schema = "id int, title string, youtube struct<description:string,tags:array<string>,channel_name:string>, speakers array<string>, conference string, topics array<string>"
    rows = [(1, "t", ("d", ["x"], "c"), [], None, []), (2, "t", None, ["Manual"], None, []), (3, "t", ("d", None, "c"), ["Manual"], None, [])]
    df = spark.createDataFrame(rows, schema)

    def good():
        return lambda batch: [text for _ in batch]

    def bad():
        return lambda batch: ["not valid json {{" for _ in batch]

    out = {r.id: (r.speakers, r.conference, r.topics) for r in model.extract_metadata(df, "youtube", good).collect()}
    assert out == {1: (["Bob"], "Conf", ["a", "b", "c"]), 2: (["Manual"], None, []), 3: (["Manual"], "Conf", ["a", "b", "c"])}
    for factory in (bad, failing):
        kept = {r.id: (r.speakers, r.conference, r.topics) for r in model.extract_metadata(df, "youtube", factory).collect()}
        assert kept == {1: ([], None, []), 2: (["Manual"], None, []), 3: (["Manual"], None, [])}


def test_summaries_of_short_long_and_failing_texts(spark):
    df = spark.createDataFrame([(1, "t", "short", None), (2, "t", "a" * 20 + "\n\n" + "b" * 20, None), (3, "t", "raw", "better")],
                               "id int, title string, raw string, corrected string")

    def echo():
        return lambda batch: [p.split("--- text ---\n")[1].split("\n--- end")[0] for p in batch]

    out = {r.id: r.summary for r in model.summarise_documents(df, "id", "corrected", "raw", "title", echo, max_chars=25).collect()}
    assert out == {1: "short", 2: "a" * 20 + "\n\n---\n\n" + "b" * 20, 3: "better"}
    none = {r.id: r.summary for r in model.summarise_documents(df, "id", "corrected", "raw", "title", failing, max_chars=25).collect()}
    assert none == {1: "", 2: "", 3: ""}


def test_tag_dictionary_rules(spark):
    rows = [(1, 0, "manual", "Lightning"), (1, 1, "platform", " lightning "), (1, 2, "category", "Podcast"), (1, 3, "speaker", "Ann"),
            (2, 0, "manual", "OP_RETURN"), (2, 1, "platform", "1234"), (2, 2, "category", "podcast"), (2, 3, "speaker", "Bob"), (3, 0, "manual", "BOLT12"), (3, 1, "manual", "  ")]
    df = spark.createDataFrame(rows, "item_id long, seq int, kind string, tag string")
    texts = spark.createDataFrame([(1, ""), (2, "all about btc"), (3, "cooking")], "item_id long, text string")
    stats = {r.tag: r for r in tags.tag_stats(df).collect()}
    assert stats["lightning"].frequency == 2 and stats["lightning"].variations == ["Lightning", "lightning"] and stats["lightning"].context == "payments"
    assert stats["podcast"].frequency == 2 and "" not in stats
    assert {r.term for r in tags.technical_terms(df, texts).collect()} == {"op_return"}
    assert {r.project for r in tags.project_names(df).collect()} == {"Lightning", " lightning ", "Podcast", "OP_RETURN", "BOLT12"}
    assert {r.area for r in tags.expertise_areas(df).collect()} == {"payments", "podcast"}
    assert [r.speaker for r in tags.recent_speakers(df, 1).collect()] == ["Bob"]
    text = tags.domain_context(tags.category_stats(df), tags.expertise_areas(df)).first()[0]
    assert text == "Bitcoin discussion and interviews, Bitcoin payments and Lightning Network"
    one = tags.prompt_context(tags.correction_context(df, texts)).collect()
    assert len(one) == 1 and one[0].frequent_tags[:2] == ["lightning", "podcast"] and one[0].video_count == ["3"]


def test_tag_dictionary_takes_text_ids(spark):
    rows = [("zz", 0, "manual", "Ring", 1), ("zz", 1, "category", "Gear", 1), ("b", 0, "manual", "ring", 2), ("b", 1, "platform", "Bolt", 2),
            ("b", 2, "speaker", "Ann", 2), ("c", 0, "speaker", "Bob", 3)]
    df = spark.createDataFrame(rows, "item_id string, seq int, kind string, tag string, arrival long")
    texts = spark.createDataFrame([("b", "about gear"), ("c", "")], "item_id string, text string")
    for given, first in ((df, "zz"), (df.drop("arrival"), "b")):
        for source in (given, tags.usage(given)):
            ring = {r.tag: r for r in tags.tag_stats(source).collect()}["ring"]
            assert (ring.frequency, ring.first_seen) == (2, first) and ring.last_seen == ("b" if first == "zz" else "zz")
            assert [r.speaker for r in tags.recent_speakers(source, 1).collect()] == ["Bob"]
            areas = tags.expertise_areas(source, {"a": ["gear"], "b": ["bolt"]}).orderBy("first").collect()
            assert [r.area for r in areas] == (["a", "b"] if first == "zz" else ["b", "a"])
        one = tags.prompt_context(tags.correction_context(given, texts, ["gear"], ["ring"], ["bolt"], {"b": ["bolt"]})).first()
        assert one.technical_terms == ["ring", "bolt"] and one.expertise_areas == ["b"] and set(one.project_names) == {"Ring", "Gear", "Bolt"}
        counts = tags.statistics(given, texts, ["gear"], ["ring"], ["bolt"], {"b": ["bolt"]}).first()
        assert (counts.technical_terms_count, counts.expertise_areas_count, counts.total_unique_tags) == (2, 1, 3)


def test_stub_row_for_a_transcript_without_state(spark):
    ids = spark.createDataFrame([(1,), (2,)], "transcript_id long")
    old = spark.createDataFrame([(1, "export", "pending", 1)], "transcript_id long, stage string, status string, seq long")
    new = spark.createDataFrame([(1, "export", "completed", 2)], old.schema)
    got = {(r.transcript_id, r.stage, r.status) for r in stages.upsert_state(ids, old, new).collect()}
    assert got == {(1, "export", "completed"), (2, None, None)}
