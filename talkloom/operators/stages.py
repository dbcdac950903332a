"""Per-transcript stage state: plan, resume, outcome, update; and the stage and format registries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.scratch import materialise

# The stages in order.
STAGES = ["media_processing", "transcription", "metadata_extraction", "correction", "summarization", "export"]
KEY = ["transcript_id"]


@dataclass(frozen=True)
class Stage:
    """A named step over all transcripts at once; add a step by appending to the list."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    enabled: bool = True
    asks_model: bool = False  # its result is written once, so later stages never ask again


def run_stages(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    for s in stages:
        if s.enabled:
            df = df.transform(s.run)
            if s.asks_model:
                df = materialise(df, s.name)
    return df


def stage_plan(transcripts: DataFrame, saved: DataFrame) -> DataFrame:
    """Every transcript with its six stages and their saved status, pending where there is none."""
    listed = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage")) for i, s in enumerate(STAGES)])
    every = transcripts.select("transcript_id", F.explode(listed).alias("s")).select("transcript_id", "s.*")
    state = saved.select("transcript_id", "stage", "status")
    return every.join(state, ["transcript_id", "stage"], "left").select(
        "transcript_id", "stage_no", "stage", F.coalesce("status", F.lit("pending")).alias("status")
    )


def stage_outcome(plan: DataFrame, fails: Column, enabled: Column) -> DataFrame:
    """Status of each stage after a run in which `fails` marks the stages that would fail.

    Completed stages are not run again, disabled ones are skipped, and everything after the first
    failure is skipped. A transcript has six rows here.
    """
    runs = (F.col("status") != "completed") & enabled
    w = Window.partitionBy(*KEY)
    failed_at = F.min(F.when(runs & fails, F.col("stage_no"))).over(w)
    out = (
        F.when(F.col("stage_no") > F.col("_f"), "skipped")
        .when(F.col("stage_no") == F.col("_f"), "failed")
        .when(F.col("_done"), "completed")
        .when(~F.col("_on"), "skipped")
        .otherwise("completed")
    )
    rows = plan.select("*", failed_at.alias("_f"), (F.col("status") == "completed").alias("_done"), enabled.alias("_on"))
    return rows.select("transcript_id", "stage_no", "stage", out.alias("status"))


def overall(outcome: DataFrame) -> DataFrame:
    failed = F.col("status") == "failed"
    return outcome.groupBy(*KEY).agg(
        F.when(F.bool_or(failed), "failed").otherwise("completed").alias("overall"),
        F.max(F.when(failed, F.col("stage"))).alias("failed_stage"),
    )


def upsert_state(transcripts: DataFrame, old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Newest state row per (transcript, stage); a transcript without any state gets a stub row."""
    fields = [c for c in old.columns if c not in ("transcript_id", "stage")]
    newest = (
        old.unionByName(new).groupBy("transcript_id", "stage")
        .agg(F.max_by(F.struct(*fields), seq).alias("_s")).select("transcript_id", "stage", "_s.*")
    )
    stubs = transcripts.select("transcript_id").join(newest.select("transcript_id"), "transcript_id", "left_anti")
    empty = [F.lit(None).cast(newest.schema[c].dataType).alias(c) for c in newest.columns if c != "transcript_id"]
    return newest.unionByName(stubs.select("transcript_id", *empty))


def resume_outputs(state: DataFrame, outputs: DataFrame, provider: str) -> DataFrame:
    """Transcription state with the newest saved output of the provider; none found is pending again.

    `outputs(transcript_id, file_name)`; only completed transcriptions look for one.
    """
    newest = outputs.filter(F.col("file_name").startswith(f"{provider}_")).groupBy(*KEY).agg(F.max("file_name").alias("file_name"))
    rows = state.filter("stage = 'transcription'").select("transcript_id", "status").join(newest, KEY, "left")
    done = F.col("status") == "completed"
    return rows.select(
        "transcript_id", F.when(done & F.col("file_name").isNull(), "pending").otherwise(F.col("status")).alias("status"),
        F.when(done, F.col("file_name")).alias("file_name"),
    )
