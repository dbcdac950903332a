"""Speech-to-text output in its three shapes, to words, utterances and one segment schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom import schemas
from talkloom.functions.text import speaker_id
from talkloom.operators.rows import explode_once
from talkloom.operators.timeline import speaker_segments
from talkloom.scratch import materialise

KEY = ["transcript_id"]


def words_of(df: DataFrame, column: str = "output") -> DataFrame:
    """Word-style output: one row per word."""
    doc = F.from_json(F.col(column), schemas.WORD_OUTPUT)
    words = doc["results"]["channels"][0]["alternatives"][0]["words"]
    return explode_once(df, KEY, words, "pos", "w").select(
        *KEY, F.col("pos").cast("long").alias("pos"), "w.speaker", F.col("w.start").alias("start_s"), F.col("w.end").alias("end_s"),
        "w.confidence", "w.speaker_confidence", "w.punctuated_word",
    )


def summaries_of(df: DataFrame, column: str = "output") -> DataFrame:
    doc = F.from_json(F.col(column), schemas.WORD_OUTPUT)
    found = doc["results"]["channels"][0]["alternatives"][0]["summaries"]
    return explode_once(df, KEY, found, "n", "s").select(*KEY, "n", F.col("s.summary").alias("summary"))


def _utterances(doc: Column) -> tuple[Column, Column]:
    """The utterances of a document, or its whole text as one, and how many it has itself."""
    ws = F.coalesce(doc["words"], F.array().cast("array<struct<word:string,text:string,start:double,`end`:double,confidence:double>>"))
    zero = F.lit(0.0)
    whole = F.array(F.struct(
        F.lit(None).cast("string").alias("speaker"), F.coalesce(F.get(ws, F.lit(0))["start"], zero).alias("start"),
        F.coalesce(F.get(ws, F.size(ws) - 1)["end"], zero).alias("end"), F.coalesce(doc["transcription"], F.lit("")).alias("text"),
    ))
    n = F.size(doc["utterances"])
    return F.when(n > 0, doc["utterances"]).otherwise(whole), n


def utterances_of(df: DataFrame, column: str = "output", diarize: bool = True) -> DataFrame:
    """Utterance-style output; without utterances the whole transcription is one, without a speaker."""
    listed, n = _utterances(F.from_json(F.col(column), schemas.UTTERANCE_OUTPUT))
    rows = explode_once(df, [*KEY, n.alias("n")], listed, "utt_no", "u")
    return rows.select(
        *KEY, F.col("utt_no").cast("long").alias("utt_no"),
        F.when((F.col("n") > 0) & F.lit(diarize), speaker_id(F.coalesce("u.speaker", F.lit("speaker_0")))).alias("speaker"),
        F.col("u.start").alias("start_s"), F.col("u.end").alias("end_s"), F.coalesce("u.text", F.lit("")).alias("text"),
    )


def utterance_words_of(df: DataFrame, column: str = "output") -> DataFrame:
    doc = F.from_json(F.col(column), schemas.UTTERANCE_OUTPUT)
    return explode_once(df, KEY, doc["words"], "pos", "w").select(
        *KEY, F.col("pos").cast("long").alias("pos"), F.col("w.start").alias("start_s"), F.col("w.end").alias("end_s"),
        F.coalesce("w.confidence", F.lit(1.0)).alias("speaker_confidence"),
        F.coalesce("w.word", "w.text", F.lit("")).alias("punctuated_word"),
    )


def segments_of(df: DataFrame, column: str = "output") -> DataFrame:
    """Segment-style output: no speakers, text kept as it is."""
    doc = F.from_json(F.col(column), schemas.SEGMENT_OUTPUT)
    return explode_once(df, KEY, doc["segments"], "seg_no", "s").select(
        *KEY, F.col("seg_no").cast("long").alias("seg_no"), F.lit(None).cast("int").alias("speaker"),
        F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), "s.text",
    )


_COMMON = [*KEY, "seg_no", "part_no", "speaker", "start_s", "end_s", "text"]


def _element(speaker: Column, start: Column, end: Column, speaker_confidence: Column, text: Column) -> Column:
    return F.struct(speaker.cast("int").alias("speaker"), start.cast("double").alias("start_s"), end.cast("double").alias("end_s"),
                    speaker_confidence.cast("double").alias("speaker_confidence"), text.cast("string").alias("text"))


def _word_elements(output: Column) -> Column:
    words = F.from_json(output, schemas.WORD_OUTPUT)["results"]["channels"][0]["alternatives"][0]["words"]
    return F.transform(words, lambda w: _element(w["speaker"], w["start"], w["end"], w["speaker_confidence"], w["punctuated_word"]))


def _utterance_elements(output: Column) -> Column:
    listed, n = _utterances(F.from_json(output, schemas.UTTERANCE_OUTPUT))
    none = F.lit(None)
    return F.transform(listed, lambda u: _element(
        F.when(n > 0, speaker_id(F.coalesce(u["speaker"], F.lit("speaker_0")))), u["start"], u["end"], none, F.coalesce(u["text"], F.lit(""))))


def _segment_elements(output: Column) -> Column:
    none = F.lit(None)
    return F.transform(F.from_json(output, schemas.SEGMENT_OUTPUT)["segments"], lambda s: _element(none, s["start"], s["end"], none, s["text"]))


@dataclass(frozen=True)
class Provider:
    """How a provider's document becomes elements, and whether these are words, to be grouped into segments."""

    elements: Callable[[Column], Column]
    words: bool = False


PROVIDERS: dict[str, Provider] = {
    "deepgram": Provider(_word_elements, words=True),
    "smallestai": Provider(_utterance_elements),
    "whisper": Provider(_segment_elements),
}


def available_providers() -> list[str]:
    return list(PROVIDERS)


def elements_of(outputs: DataFrame) -> DataFrame:
    """`(transcript_id, provider, pos, speaker, start_s, end_s, speaker_confidence, text)` of mixed outputs, in one pass.

    A row's document is parsed once, in its own provider's shape; rows of unknown providers are left out.
    """
    listed = None
    for name, provider in PROVIDERS.items():
        mine = F.col("provider") == name
        listed = F.when(mine, provider.elements(F.col("output"))) if listed is None else listed.when(mine, provider.elements(F.col("output")))
    return explode_once(outputs, [*KEY, "provider"], listed, "pos", "e").select(*KEY, "provider", F.col("pos").cast("long").alias("pos"), "e.*")


def normaliser(provider: str) -> Callable[[DataFrame], DataFrame]:
    """The segments of outputs that are all of one provider."""
    if provider not in PROVIDERS:
        raise ValueError(f"no provider is named {provider!r}; known are {', '.join(available_providers())}")
    return lambda outputs: normalise(outputs.withColumn("provider", F.lit(provider))).drop("provider")


def normalise(outputs: DataFrame) -> DataFrame:
    """`(transcript_id, provider, output)` of any known provider to one segment schema; the outputs are read once."""
    parsed = materialise(elements_of(outputs), "elements")
    spoken = [name for name, provider in PROVIDERS.items() if provider.words]
    ready = parsed.filter(~F.col("provider").isin(spoken)).withColumnRenamed("pos", "seg_no").withColumn("part_no", F.lit(0).cast("long"))
    out = ready.select(*_COMMON, "provider")
    for name in spoken:
        words = parsed.filter(F.col("provider") == name).drop("provider").withColumnRenamed("text", "punctuated_word")
        out = speaker_segments(words).select(*_COMMON).withColumn("provider", F.lit(name)).unionByName(out)
    return out
