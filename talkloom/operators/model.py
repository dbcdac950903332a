"""A user's batch function over a column of prompts, and the stages built around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions import prompts, replies
from talkloom.functions.text import length_guard
from talkloom.operators.chunks import CORRECTION_CHARS, SUMMARY_CHARS, pack_paragraphs, reassemble
from talkloom.scratch import materialise

Batch = Callable[[Sequence[str]], Sequence[str | None]]
PART_BREAK = "\n\n---\n\n"


def _answers(run: Batch, batch: Sequence[str]) -> list[str | Exception | None]:
    """Replies in order; a part that fails is halved, a single prompt that fails is its exception."""
    if not batch:
        return []
    try:
        out = list(run(batch))
        if len(out) == len(batch):
            return out
        raise ValueError(f"{len(out)} replies for {len(batch)} prompts")
    except Exception as e:
        if len(batch) == 1:
            return [e]
    middle = len(batch) // 2
    return _answers(run, batch[:middle]) + _answers(run, batch[middle:])


def model_column(factory: Callable[[], Batch], prompt: Column) -> Column:
    """struct(reply, error) per prompt. `factory` runs once per task and returns the batch function.

    Only the prompt travels to Python. A null prompt is not sent. A batch that raises is halved until the failing rows are
    alone; those get a null reply and their error text, so no row fails a job. A batch function that answers a
    row with an exception in its place marks that row as failed without a second call.
    """

    @F.pandas_udf("reply string, error string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = factory()
        for batch in batches:
            sent = [p for p in batch if p is not None]
            answers = iter(_answers(run, sent))
            given = [next(answers) if p is not None else None for p in batch]
            failed = [isinstance(a, Exception) for a in given]
            yield pd.DataFrame({
                "reply": pd.Series([None if f else a for a, f in zip(given, failed)], dtype=object),
                "error": pd.Series([f"{type(a).__name__}: {a}" if f else None for a, f in zip(given, failed)], dtype=object),
            })

    return call.asNondeterministic()(prompt)


def model_stage(df: DataFrame, factory: Callable[[], Batch], prompt: str, tasks: int | None = None) -> DataFrame:
    """Add `reply` and `error`; the costly calls are spread over `tasks` partitions, those of a shuffle unless given, however the rows are stored."""
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks).withColumn("_m", model_column(factory, F.col(prompt))).select(
        *df.columns, F.col("_m.reply").alias("reply"), F.col("_m.error").alias("error")
    )


def classify_videos(videos: DataFrame, factory: Callable[[], Batch]) -> DataFrame:
    """Gate by duration, ask the model about the rest, decide the status.

    Needs title, description, tags, channel_name, category and duration. Gated rows have a null prompt,
    so they never reach the model and no branch of the plan is computed twice.
    """
    gate = replies.duration_gate(F.col("duration"))
    prompt = prompts.classify(*[F.col(c) for c in ("title", "description", "tags", "channel_name", "category")])
    asked = model_stage(
        videos.withColumn("_gate", gate).withColumn("_prompt", F.when(F.col("_gate").isNull(), prompt)), factory, "_prompt"
    )
    parsed = asked.withColumn("_r", replies.parse_classification(F.col("reply")))
    gated = F.col("_gate").isNotNull()
    flag = F.when(gated, False).otherwise(F.col("_r.is_technical"))
    conf = F.when(gated, 1.0).otherwise(F.col("_r.confidence"))
    decided = F.when(gated, "skipped").otherwise(replies.classification_status(flag, conf))
    failed = F.col("error").isNotNull()
    added = {
        "is_technical": F.when(~failed, flag),
        "classification_confidence": F.when(~failed, conf),
        "classification_reason": F.when(~failed, F.coalesce("_gate", "_r.reason")),
        "status": F.when(failed, "pending").otherwise(decided),
    }
    kept = [c for c in videos.columns if c not in added]
    return parsed.select(*kept, *[e.alias(n) for n, e in added.items()], "error")


def correct_documents(
    docs: DataFrame, key: str, text: str, about: dict[str, Column], context: Column,
    factory: Callable[[], Batch], max_chars: int = CORRECTION_CHARS, keywords: Column | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Pack, prompt, call, guard and reassemble: `(key, text)`.

    `context` is a struct column, such as the scalar of prompt_context, evaluated once for the job.
    """
    shown = {**about, "description": prompts.shorten(about["description"])}
    rows = docs.select(key, text, *[c.alias(f"_{n}") for n, c in shown.items()])
    chunks = pack_paragraphs(rows, text, max_chars)
    prompt = prompts.correct(F.col("chunk"), {n: F.col(f"_{n}") for n in about}, context, keywords)
    asked = model_stage(chunks.withColumn("_prompt", prompt).select(key, "chunk_no", "chunk", "_prompt"), factory, "_prompt", tasks)
    guarded = asked.select(key, "chunk_no", length_guard(F.col("chunk"), F.col("reply")).alias("chunk"))
    return reassemble(guarded, [key])


def summarise_documents(
    docs: DataFrame, key: str, corrected: str, raw: str, title: str, factory: Callable[[], Batch],
    max_chars: int = SUMMARY_CHARS, tasks: int | None = None,
) -> DataFrame:
    """Summaries `(key, summary)`: short texts directly, long ones by part and then once more.

    The replies of both rounds are written out before they are used, so no call is repeated, however often the result is read.
    """
    rows = docs.select(key, F.col(title).alias("_title"), F.coalesce(corrected, raw).alias("_text"))
    chunks = pack_paragraphs(rows, "_text", max_chars)
    prompt = F.when(
        F.col("n_chunks") > 1, prompts.summarise_part(F.col("chunk"))
    ).otherwise(prompts.summarise_whole(F.col("chunk"), F.col("_title")))
    asked = model_stage(
        chunks.select(key, "_title", "chunk_no", "n_chunks", prompt.alias("_prompt")), factory, "_prompt", tasks
    )
    first = materialise(asked.select(key, "_title", "chunk_no", "n_chunks", "reply"), "summaries")
    useful = F.when(F.coalesce("reply", F.lit("")) != "", F.struct("chunk_no", "reply"))
    ordered = F.array_sort(F.collect_list(useful))
    merged = first.groupBy(key).agg(
        F.first("_title").alias("_title"),
        F.transform(ordered, lambda c: c["reply"]).alias("_parts"),
    )
    joined = F.array_join("_parts", PART_BREAK)
    again = F.when(F.size("_parts") > 1, prompts.summarise_final(joined, F.col("_title")))
    final = materialise(model_stage(merged.withColumn("_prompt", again), factory, "_prompt", tasks), "final-summaries")
    summary = F.when(F.size("_parts") > 1, F.col("reply")).otherwise(F.get("_parts", F.lit(0)))
    return final.select(key, F.coalesce(summary, F.lit("")).alias("summary"))


def extract_metadata(docs: DataFrame, platform: str, factory: Callable[[], Batch]) -> DataFrame:
    """Fill speakers, conference and topics from the platform metadata of rows that have any."""
    p = F.col(platform)
    prompt = prompts.metadata(F.col("title"), p["description"], p["channel_name"], p["tags"])
    asked = model_stage(docs.withColumn("_prompt", F.when(p.isNotNull(), prompt)), factory, "_prompt")
    found = asked.withColumn("_found", F.when(F.col("reply").isNotNull(), replies.parse_metadata(F.col("reply"))))
    own = {c: F.col(c) for c in ("speakers", "conference", "topics")}
    merged = replies.merge_metadata(own, F.col("_found"))
    return found.select(*[merged[c].alias(c) if c in merged else F.col(c) for c in docs.columns], "error")
