"""Saved provider output, found and read by the tasks that need it.

Only the folders of transcripts that are to be resumed are listed, in tasks; the newest file of each is chosen by name before any
content is read; and only the chosen files are opened. Nothing is listed or read on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.sinks.named import open_folder

_BATCH_BYTES = 16 << 20


def _listed(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = open_folder(base)
        for batch in batches:
            keys, names = [], []
            for key, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = system.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True))
                files = [f.base_name for f in found if f.type == fs.FileType.File]
                keys += [key] * len(files)
                names += files
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema[0].type), pa.array(names, pa.string())], names=["transcript_id", "file_name"])

    return run


def list_saved(transcripts: DataFrame, base: str) -> DataFrame:
    """`(transcript_id, file_name)` of the files in the folder below `base` of every row of transcripts(transcript_id, folder).

    A folder that does not exist holds none. Folders are dealt out evenly, so a task lists its share only.
    """
    rows = transcripts.filter("folder IS NOT NULL").select("transcript_id", "folder").repartition("transcript_id")
    kind = rows.schema["transcript_id"].dataType.simpleString()
    return rows.mapInArrow(_listed(base), f"transcript_id {kind}, file_name string")


def _read(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(base)
        for batch in batches:
            held: list[tuple] = []
            size = 0

            def flush() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays(
                    [pa.array([h[0] for h in held], batch.schema[0].type), pa.array([h[1] for h in held], pa.string()), pa.array([h[2] for h in held], pa.string())],  # noqa: B023
                    names=["transcript_id", "output", "error"])
                held.clear()  # noqa: B023
                return out

            for key, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with system.open_input_stream(f"{root}/{path}") as stream:
                        text, error = stream.read().decode("utf-8"), None
                except FileNotFoundError:
                    text, error = None, "the file is gone"
                except UnicodeDecodeError:
                    text, error = None, "the file is not UTF-8"
                held.append((key, text, error))
                size += len(text or "")
                if size >= _BATCH_BYTES:
                    yield flush()
                    size = 0
            if held:
                yield flush()

    return run


def read_saved(chosen: DataFrame, base: str) -> DataFrame:
    """`(transcript_id, output, error)` of chosen(transcript_id, path); a file that is gone or unreadable has an error instead."""
    kind = chosen.schema["transcript_id"].dataType.simpleString()
    rows = chosen.select("transcript_id", "path").repartition("transcript_id")
    return rows.mapInArrow(_read(base), f"transcript_id {kind}, output string, error string")


def resumable(transcripts: DataFrame, state: DataFrame, base: str, provider: str) -> DataFrame:
    """`(transcript_id, status, file_name, path)` per transcription in `state`, with its newest saved output of `provider`.

    transcripts(transcript_id, folder), state(transcript_id, stage, status). Only completed transcriptions look for a file;
    those that find none are pending again.
    """
    from talkloom.operators.stages import resume_outputs

    done = state.filter("stage = 'transcription' AND status = 'completed'").select("transcript_id")
    folders = transcripts.join(done, "transcript_id", "left_semi")
    found = resume_outputs(state, list_saved(folders, base), provider)
    return found.join(folders, "transcript_id", "left").select(
        "transcript_id", "status", "file_name", F.when(F.col("file_name").isNotNull(), F.concat_ws("/", "folder", "file_name")).alias("path"))


def resume_transcripts(transcripts: DataFrame, state: DataFrame, base: str, provider: str) -> tuple[DataFrame, DataFrame]:
    """`(transcript_id, provider, output)` of what can go on without transcribing again, and `(transcript_id, status, error)` of all.

    A transcript whose chosen file is gone or can not be parsed is pending again, with the error. The files are read once.
    """
    from talkloom.scratch import materialise

    known = materialise(resumable(transcripts, state, base, provider), "resumable")
    read = read_saved(known.filter("path IS NOT NULL"), base)
    bad = F.col("output").isNotNull() & F.try_parse_json("output").isNull()
    read = materialise(read.withColumn("error", F.when(bad, "the file is no JSON").otherwise(F.col("error"))), "saved-output")
    fine = read.filter("error IS NULL").select("transcript_id", F.lit(provider).alias("provider"), "output")
    status = known.join(read.select("transcript_id", "error"), "transcript_id", "left").select(
        "transcript_id", F.when(F.col("error").isNotNull(), "pending").otherwise(F.col("status")).alias("status"), "error")
    return fine, status
