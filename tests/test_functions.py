import json

import pytest
from pyspark.sql import functions as F

from talkloom.functions import prompts, replies, text as tx, timing
from talkloom.sources.documents import normalise_chapters

NONE = "cast(null as string)"


def one(spark, column, schema="x string", value=(None,)):
    return spark.createDataFrame([tuple(value)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("given,want", [
    ("PT1H2M3S", 3723), ("PT45S", 45), ("PT10M", 600), ("PT2H", 7200), ("PT1H5S", 3605), ("P1D", 0), ("", 0), (None, 0)])
def test_iso_durations(spark, given, want):
    assert one(spark, timing.iso_duration_seconds(F.col("x")), value=[given]) == want


@pytest.mark.parametrize("given,want", [
    ("Hello, World!", "hello-world"), ("a_b__c", "a-b-c"), ("  --x--  ", "x"), ("Ünïcode & Ço", "ünïcode-ço"), ("№ 5²", "5²"), ("___", "")])
def test_slugs(spark, given, want):
    assert one(spark, tx.slugify(F.col("x")), value=[given]) == want


@pytest.mark.parametrize("given,hms,srt", [(0.0, "00:00:00", "00:00:00,000"), (3661.5, "01:01:01", "01:01:01,500"), (360000.125, "100:00:00", "100:00:00,125")])
def test_clock_texts(spark, given, hms, srt):
    assert one(spark, timing.hms(F.col("x")), "x double", [given]) == hms
    assert one(spark, timing.srt_time(F.col("x")), "x double", [given]) == srt


@pytest.mark.parametrize("given,want", [("2024-01-01T00:00:00", "2024-01-01T00:00:00Z"), ("2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z"),
                                        ("2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00+00:00")])
def test_rfc3339(spark, given, want):
    assert one(spark, timing.rfc3339(F.col("x")), value=[given]) == want


def test_strict_dates(spark):
    assert str(one(spark, timing.parse_date(F.col("x")), value=["2024-02-29"])) == "2024-02-29"
    assert str(one(spark, timing.parse_compact_date(F.col("x")), value=["20240229"])) == "2024-02-29"
    for bad in ("2023-02-29", "29.02.2024", "2024-02-29x", ""):
        assert one(spark, timing.parse_date(F.col("x")), value=[bad]) is None


def test_strip_takes_every_kind_of_white_space(spark):
    given = " \t\x1c a b　\x85\n"
    assert one(spark, tx.strip(F.col("x")), value=[given]) == given.strip() == "a b"


@pytest.mark.parametrize("text", ["One. Two? Three", "See e.g. this. Dr. No left… then - and-\nmore.", "No end"])
def test_abbreviation_split_equals_the_pattern(spark, text):
    from tests.walk import SPLIT

    assert one(spark, tx.split_sentences_abbrev(F.col("x")), value=[text]) == SPLIT.split(text)


@pytest.mark.parametrize("given,want", [("speaker_3", 3), ("speaker_x_12", 12), ("4", 4), ("guest", 0), (None, 0)])
def test_speaker_ids(spark, given, want):
    assert one(spark, tx.speaker_id(F.col("x")), value=[given]) == want


@pytest.mark.parametrize("name,known,want", [
    ("https://x/a.MP3", False, "audio"), ("https://x/feed.xml", True, "rss"), ("https://x/rss", False, "rss"), ("https://x/RSS", False, "lookup"),
    ("https://x/v", True, "known_video"), ("https://x/v.mp4", True, "known_video"), ("https://x/v.MOV", False, "remote_video"), ("https://x/v", False, "lookup")])
def test_source_kinds(spark, name, known, want):
    assert one(spark, tx.source_kind(F.col("x"), F.lit(known)), value=[name]) == want


def test_titles_and_links(spark):
    assert one(spark, tx.title_or_stem(F.expr(NONE), F.col("x")), value=["/a/b/talk.final.mp3"]) == "talk.final"
    assert one(spark, tx.title_or_stem(F.lit("T"), F.col("x")), value=["/a/b.mp3"]) == "T"
    assert one(spark, tx.video_id_of(F.col("x")), value=["https://www.youtube.com/watch?t=1&v=abc_-1&x=2"]) == "abc_-1"


def test_leading_placeholder_chapter_is_dropped(spark):
    schema = "c array<struct<start_time:double,title:string>>"
    kept = one(spark, normalise_chapters(F.col("c")), schema, [[(0.0, "<Untitled Chapter 1>"), (5.0, "A"), (9.0, "B")]])
    assert [(c.idx, c.start, c.title) for c in kept] == [("0", 5.0, "A"), ("1", 9.0, "B")]
    same = one(spark, normalise_chapters(F.col("c")), schema, [[(0.0, "A"), (5.0, "<Untitled Chapter 1>")]])
    assert [c.title for c in same] == ["A", "<Untitled Chapter 1>"]


@pytest.mark.parametrize("reply,want", [
    ('{"is_technical": true, "confidence": 0.9, "reason": " ok "}', (True, 0.9, "ok")),
    ('```json\n{"is_technical": true, "confidence": 2}\n```', (True, 1.0, "No reason provided")),
    ('Sure! {"is_technical": false, "confidence": -1, "reason": ""} Bye.', (False, 0.0, "No reason provided")),
    ('{"is_technical": "no"}', (True, 0.5, "No reason provided")),
    ('{"is_technical": 0, "confidence": "0.25", "reason": null}', (False, 0.25, "None")),
    ('{"is_technical": [], "reason": 7}', (False, 0.5, "7")),
    ("{}", (False, 0.5, "No reason provided")),
])
def test_classification_replies(spark, reply, want):
    assert tuple(one(spark, replies.parse_classification(F.col("x")), value=[reply])) == want


@pytest.mark.parametrize("reply", ["not json {{", '{"is_technical": true', '{"a": 1} tail', "", '{"confidence": "high"}', '{"confidence": null}', "[1]", '{"a": 1}, {"a": 2}'])
def test_bad_classification_replies(spark, reply):
    got = one(spark, replies.parse_classification(F.col("x")), value=[reply])
    assert (got.is_technical, got.confidence) == (False, 0.0) and got.reason.startswith("Parse error")


@pytest.mark.parametrize("reply,want", [
    ('{"speakers": ["Ann"], "conference": "Conf", "topics": ["a", "b", "c"]}', (["Ann"], "Conf", ["a", "b", "c"])),
    ('```json\n{"speakers": [" Ann ", "", 3], "conference": " C ", "topics": []}\n```', (["Ann"], "C", [])),
    ('{"speakers": "Ann", "conference": 5, "topics": null}', (["Ann"], "5", [])),
    ('{"speakers": 4, "conference": ""}', ([], "", [])),
    ("this is not json", ([], "", [])), ("not valid json {{", ([], "", [])), ("[]", ([], "", []))])
def test_metadata_replies(spark, reply, want):
    assert tuple(one(spark, replies.parse_metadata(F.col("x")), value=[reply])) == want


@pytest.mark.parametrize("seconds,want", [(None, None), (0, None), (599, "Too short (599s < 600s minimum)"), (600, None), (3000, None), (3001, "Too long (3001s > 3000s maximum)")])
def test_duration_gate(spark, seconds, want):
    assert one(spark, replies.duration_gate(F.col("x")), "x int", [seconds]) == want


@pytest.mark.parametrize("flag,conf,want", [(True, 0.7, "queued"), (True, 0.69, "classified"), (False, 0.99, "skipped")])
def test_status(spark, flag, conf, want):
    assert one(spark, replies.classification_status(F.col("a"), F.col("b")), "a boolean, b double", [flag, conf]) == want


def test_prompts_hold_their_fields_and_cut_long_ones(spark):
    row = {"title": "A talk", "description": "d" * 2000, "tags": [f"t{i}" for i in range(30)], "channel": "Chan"}
    df = spark.createDataFrame([tuple(row.values())], "title string, description string, tags array<string>, channel string")
    c = {n: F.col(n) for n in row}
    meta = df.select(prompts.metadata(c["title"], c["description"], c["channel"], c["tags"])).first()[0]
    assert "A talk" in meta and "Chan" in meta and "t0, t1" in meta and "t20" not in meta and meta.count("d" * 800) == 1 and "d" * 801 not in meta
    asked = df.select(prompts.classify(c["title"], c["description"], F.expr("cast(null as array<string>)"), c["channel"], F.expr(NONE))).first()[0]
    assert "Tags: None" in asked and "unknown" in asked and "d" * 1000 in asked and "d" * 1001 not in asked


def test_length_guard(spark):
    def kept(given, returned):
        return one(spark, tx.length_guard(F.col("a"), F.col("b")), "a string, b string", [given, returned])

    assert kept("x" * 10, "y" * 7) == "y" * 7 and kept("x" * 10, "y" * 6) == "x" * 10 and kept("x", None) == "x"


def test_unicode_json_quotes(spark):
    from talkloom.sinks.exports import _yaml_text

    assert one(spark, _yaml_text(F.col("x")), value=["Plain title"]) == "Plain title"
    for odd in ("a: b", "- x", "true", 'say "hi"', "line\nbreak", "", "12", "é"):
        assert json.loads(one(spark, _yaml_text(F.col("x")), value=[odd])) == odd
