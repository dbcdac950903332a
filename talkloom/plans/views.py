"""Domain views over the given tables: channels, videos, transcripts, timed words and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.operators.ordered import ordered_scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def channels(spark: SparkSession, sf: str) -> DataFrame:
    nation = F.col("s_nationkey")
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("UC"), F.col("s_suppkey")).alias("channel_id"),
        F.col("s_name").alias("channel_name"),
        F.when(nation % 4 == 0, "conference").when(nation % 4 == 1, "podcast")
        .when(nation % 4 == 2, "education").alias("category"),
        (nation % 5 + 1).alias("priority"),
        (F.col("s_acctbal") >= 0).alias("is_active"),
        F.when(F.col("s_suppkey") % 3 != 0, F.lit("2024-01-15").cast("timestamp")).alias("last_scanned_at"),
    )


def videos(spark: SparkSession, sf: str) -> DataFrame:
    n_channels = table(spark, sf, "supplier").agg(F.count("*")).scalar()
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("v"), F.col("event_id")).alias("video_id"),
        (F.col("user_id") % n_channels).alias("channel_id"),
        F.concat_ws(" ", kind, F.col("user_id")).alias("title"),
        F.col("ts").cast("timestamp").alias("published_at"),
        F.floor(F.col("value") * 10).cast("int").alias("duration"),
        F.when(kind == "view", "pending").when(kind == "click", "classified")
        .when(kind == "signup", "queued").when(kind == "purchase", "transcribed")
        .otherwise("skipped").alias("status"),
        F.when(kind != "view", kind != "error").alias("is_technical"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    day = F.dayofmonth("published_at")
    return (
        videos(spark, sf).groupBy(day.alias("id"))
        .agg(
            F.count("*").alias("videos_discovered"),
            F.min("published_at").alias("started_at"),
            F.max("published_at").alias("completed_at"),
        )
        .select(
            "id", F.lit("classify").alias("run_type"),
            F.when(F.col("id") % 5 > 0, (F.col("id") % 100).cast("long")).alias("channel_id"),
            "videos_discovered", "started_at", "completed_at",
        )
    )


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("Doc_"), F.col("doc_id"), F.lit(" "), F.col("lang")).alias("title"),
        F.col("source").alias("loc"),
        "lang",
        F.col("text").alias("raw_text"),
        F.when(F.col("quality") == 1, F.regexp_replace("text", "e", "E")).alias("corrected_text"),
        F.when(F.col("toxic") == 1, F.md5("text")).alias("summary"),
    )


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id",
        F.col("url").alias("source_file"),
        F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("loc"),
        F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"),
        F.when(F.col("page_id") % 3 > 0, F.regexp_replace("url", "[?].*$", "")).alias("media"),
    )


def existing_media(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").filter("page_id % 5 = 0").select(F.col("url").alias("media"))


def replies(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.when(F.col("quality") == 1, "true").otherwise("false")
    return table(spark, sf, "labels").select(
        "doc_id",
        F.when(
            F.col("doc_id") % 4 == 0,
            F.concat(F.lit('```json\n{"is_technical": '), flag, F.lit(', "confidence": 0.75, "reason": "ok"}\n```')),
        )
        .when(
            F.col("doc_id") % 4 == 1,
            F.concat(F.lit('Sure: {"is_technical": '), flag, F.lit(', "confidence": 1.5}')),
        )
        .when(F.col("doc_id") % 4 == 2, "not json {{")
        .otherwise('{"is_technical": true, "confidence": 0.5, "reason": " low "}')
        .alias("reply"),
    )


def item_tags(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (item, tag): the four tags of a part, unpivoted in one scan."""
    name = F.split("p_name", " ")
    manual = F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).otherwise(F.col("p_type"))
    kinds = [("manual", manual), ("platform", F.col("p_brand")),
             ("category", F.get(name, F.lit(1))), ("speaker", F.get(name, F.lit(0)))]
    rows = F.array(*[
        F.struct(F.lit(i).alias("seq"), F.lit(k).alias("kind"), t.alias("tag"))
        for i, (k, t) in enumerate(kinds)
    ])
    return (
        table(spark, sf, "part")
        .select(F.col("p_partkey").alias("item_id"), F.explode(rows).alias("r"))
        .select("item_id", "r.*")
    )


def words(spark: SparkSession, sf: str) -> DataFrame:
    """Timed words of every conversation; positions come from a running word count over turns."""
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("transcript_id"),
        "turn",
        F.filter(F.split(F.trim("text"), "[ \\n\\t\\r]+"), lambda w: w != "").alias("ws"),
    )
    counted = ordered_scan(
        turns, ["transcript_id"], ["turn"], F.floor(F.col("turn") / 512),
        totals={"upto": F.size("ws").cast("long")},
    )
    pos = F.col("upto") - F.size("ws") + F.col("i")
    return (
        counted.select("transcript_id", "turn", "upto", "ws", F.posexplode("ws").alias("i", "punctuated_word"))
        .withColumn("pos", pos)
        .select(
            "transcript_id",
            "turn",
            F.when(F.col("turn") % 4 < 2, 0).otherwise(1).alias("speaker"),
            "pos",
            "punctuated_word",
            (F.col("pos") * F.lit(0.375)).alias("start_s"),
            (F.col("pos") * F.lit(0.375) + F.lit(0.25)).alias("end_s"),
            ((F.col("pos") % 8 + 1) / F.lit(16.0)).alias("speaker_confidence"),
        )
    )


def utterances(spark: SparkSession, sf: str) -> DataFrame:
    return utterances_of(words(spark, sf))


def utterances_of(timed: DataFrame) -> DataFrame:
    return timed.groupBy("transcript_id", "turn").agg(
        F.min("speaker").alias("speaker"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")
    )


def utterance_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Utterances with their text, one per turn."""
    texts = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("transcript_id"), "turn", "text"
    )
    return utterances(spark, sf).join(texts, ["transcript_id", "turn"])


def chapters(spark: SparkSession, sf: str) -> DataFrame:
    return chapters_of(utterances(spark, sf))


def chapters_of(rows: DataFrame) -> DataFrame:
    """A chapter near the start of every third utterance."""
    heads = rows.filter("turn % 3 = 1")
    numbered = ordered_scan(
        heads, ["transcript_id"], ["turn"], F.floor(F.col("turn") / 512), totals={"n": F.lit(1)}
    )
    return numbered.select(
        "transcript_id",
        (F.col("n") - 1).alias("chapter_no"),
        (F.col("start_s") + F.lit(0.125) * (F.col("turn") % 4)).alias("start_s"),
        F.concat(F.lit("Topic "), F.col("turn")).alias("title"),
    )


CHUNK_SECONDS, CHUNK_OVERLAP = 64, 8


def chunk_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words as overlapping chunks hold them, with chunk-local times."""
    w = words(spark, sf)
    step = CHUNK_SECONDS - CHUNK_OVERLAP
    durations = w.groupBy("transcript_id").agg(F.max("end_s").alias("dur"))
    last = F.floor(F.col("start_s") / step)
    first = F.greatest(F.lit(0), F.floor((F.col("start_s") - CHUNK_SECONDS) / step) + 1)
    spread = w.withColumn("chunk_no", F.explode(F.sequence(first, last)))
    shift = F.col("chunk_no") * step
    return (
        spread.join(durations, "transcript_id")
        .filter((F.col("chunk_no") == 0) | (shift + CHUNK_OVERLAP < F.col("dur")))
        .select(
            "transcript_id", "chunk_no", "pos", "speaker", "punctuated_word",
            (F.col("start_s") - shift).alias("start_s"), (F.col("end_s") - shift).alias("end_s"),
        )
    )
