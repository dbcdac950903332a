"""A Spark data source that writes `(path, content)` rows as files of these names, committed as a whole.

Every task stages its files in a folder of its own attempt. The commit, which runs once on the driver after all tasks, only writes
down which attempts count; so what the driver handles is one name per task, not one per file. `publish` then moves the
staged files of committed jobs to their places, in tasks again. It may be repeated: a job whose driver is lost before or while it
publishes is finished by the next one, and files of attempts that failed are never seen. `list_files` and `read_files` read them back
in tasks too: Spark's own file sources hold every name on the driver.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from talkloom.scratch import materialise

STAGING = "_staging"
COMMITTED = "_committed"
LIST_ROWS = 4096  # names in one batch of a listing, and files read by one task
READ_BYTES = 8 << 20  # of files handed on at once


def open_folder(base: str) -> tuple:
    """The pyarrow file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(base if "://" in base else f"file://{base.removeprefix('file:')}")
    return system, root.rstrip("/")


@dataclass
class StagedTask(WriterCommitMessage):
    folder: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, base: str, job: str):
        self.base, self.job = base, job

    def _stage(self) -> tuple:
        system, root = open_folder(self.base)
        return system, f"{root}/{STAGING}/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, stage = self._stage()
        folder, made = uuid.uuid4().hex, set()
        for batch in iterator:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                target = f"{stage}/{folder}/{path.as_py()}"
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(target) as out:
                    out.write(content.as_py().encode("utf-8"))
        return StagedTask(folder if made else "")

    def commit(self, messages: list) -> None:
        system, stage = self._stage()
        folders = sorted(m.folder for m in messages if m is not None and m.folder)
        system.create_dir(stage, recursive=True)
        with system.open_output_stream(f"{stage}/{COMMITTED}.part") as out:
            out.write(json.dumps(folders).encode())
        system.move(f"{stage}/{COMMITTED}.part", f"{stage}/{COMMITTED}")

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, stage = self._stage()
        if system.get_file_info(stage).type == fs.FileType.Directory:
            system.delete_dir(stage)


class NamedFiles(DataSource):
    """`df.write.format("named_files").option("base", …).option("job", …)`, for rows `(path string, content string)`."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["base"], self.options["job"])


def _move(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = open_folder(base)
        moved = 0
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                if system.get_file_info(folder).type != fs.FileType.Directory:
                    continue
                made = set()
                for found in system.get_file_info(fs.FileSelector(folder, recursive=True)):
                    if found.type != fs.FileType.File:
                        continue
                    target = f"{root}/{found.path[len(folder) + 1:]}"
                    parent = target.rsplit("/", 1)[0]
                    if parent not in made:
                        system.create_dir(parent, recursive=True)
                        made.add(parent)
                    system.move(found.path, target)
                    moved += 1
        yield pa.RecordBatch.from_arrays([pa.array([moved], pa.int64())], names=["moved"])

    return run


def publish(spark: SparkSession, base: str) -> int:
    """Move the files of every committed job below `base` to their places; how many were moved."""
    from pyarrow import fs

    system, root = open_folder(base)
    moved = 0
    jobs = system.get_file_info(fs.FileSelector(f"{root}/{STAGING}", allow_not_found=True))
    for job in sorted(j.path for j in jobs):
        if system.get_file_info(f"{job}/{COMMITTED}").type != fs.FileType.File:
            continue  # still running, or never committed
        with system.open_input_stream(f"{job}/{COMMITTED}") as held:
            folders = json.loads(held.read())
        if folders:
            tasks = spark.createDataFrame([(f"{job}/{f}",) for f in folders], "folder string").repartition(len(folders), "folder")
            moved += tasks.mapInArrow(_move(base), "moved long").agg(F.sum("moved")).first()[0] or 0
        system.delete_dir(job)
    return moved


def split_paths(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be written, and the others with a `reason`: no path, one outside of the folder, or one that another row has too."""
    path = F.col("path")
    bad = F.when(path.isNull() | (path == ""), "no path").when(
        path.startswith("/") | path.contains("://") | path.rlike(f"(^|/)\\.\\.?(/|$)|//|/$|^{STAGING}(/|$)"), "path leaves the folder")
    marked = df.withColumn("reason", bad)
    shared = marked.filter("reason IS NULL").groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").select("path")
    fine = marked.filter("reason IS NULL").drop("reason").join(shared, "path", "left_anti").select(*df.columns)
    rejected = marked.filter("reason IS NOT NULL").unionByName(
        marked.filter("reason IS NULL").join(shared, "path", "left_semi").withColumn("reason", F.lit("another row has this path")))
    return fine, rejected.select(*df.columns, "reason")


def write_files(df: DataFrame, base: str) -> DataFrame:
    """Write `(…, path, content)` rows to `base`/path; the rows that were not written, with a reason each.

    A file that is there already is replaced. A null content is an empty file. Nothing of a job that fails is left at a path.
    """
    spark = df.sparkSession
    spark.dataSource.register(NamedFiles)
    fine, rejected = split_paths(df)
    rows = fine.select("path", F.coalesce("content", F.lit("")).alias("content"))
    rows.write.format("named_files").option("base", base).option("job", uuid.uuid4().hex).mode("append").save()
    publish(spark, base)
    return rejected


def _listed(base: str):
    """Of folders below `base`, named as `path`, what they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = open_folder(base)

        def entries(folder: str) -> Iterator[tuple[str, bool]]:
            if isinstance(system, fs.LocalFileSystem):  # one by one; other stores give the list of a folder at once
                with os.scandir(folder) as found:
                    yield from ((e.name, e.is_dir()) for e in found)
            else:
                yield from ((e.base_name, e.type == fs.FileType.Directory) for e in system.get_file_info(fs.FileSelector(folder)))

        for batch in batches:
            for below in batch.column(0).to_pylist():
                found = entries(f"{root}/{below}" if below else root)
                while some := list(islice(found, LIST_ROWS)):
                    names = [f"{below}/{name}" if below else name for name, _ in some]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([folder for _, folder in some], pa.bool_())], names=["path", "is_folder"])

    return run


def list_files(spark: SparkSession, base: str) -> DataFrame:
    """`(path)` below `base` of every file there but staged ones.

    The folders of a level are listed in tasks and the names written to the scratch folder, so the driver holds none of them.
    """
    folders, files = spark.createDataFrame([("",)], "path string"), []
    while n := folders.count():
        found = materialise(folders.repartition(min(n, LIST_ROWS)).mapInArrow(_listed(base), "path string, is_folder boolean"), "listing")
        files.append(found.filter("not is_folder").select("path"))
        folders = found.filter(F.col("is_folder") & (F.col("path") != STAGING)).select("path")
    return reduce(DataFrame.unionByName, files)


def read_files(paths: DataFrame, base: str) -> DataFrame:
    """`(path, content)` of the files at `base`/path, with the bytes as content; a file that is not there is an error.

    `paths` are dealt to tasks by number, a few thousand each, and every file is read in the task of its row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(base)
        names: list[str] = []
        contents: list[bytes] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
            names.clear()
            contents.clear()
            return out

        held = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{path}") as file:
                    contents.append(file.read())
                names.append(path)
                held += len(contents[-1])
                if held >= READ_BYTES:
                    yield flush()
                    held = 0
            if names:
                yield flush()
                held = 0

    spark = paths.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-paths.count() // LIST_ROWS))
    return paths.select("path").repartition(tasks).mapInArrow(run, "path string, content binary")
