"""Paths of documents, and documents in parts. Files of given names are written by `sinks.named`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions.text import slugify


PARTS_TOGETHER = 1024


def _folder(base: str, *parts: Column) -> Column:
    kept = [F.when(p != "", p) for p in parts]
    return F.concat_ws("/", F.lit(base.rstrip("/")), *kept)


def _place(loc: str) -> Column:
    return F.regexp_replace(F.col(loc), "\\A/+|/+\\z", "")


def data_path(base: str, loc: str, title: str, name: str, extension: str, stamp: str | None = None) -> Column:
    """`base/loc/slug/name[_stamp].extension`, where working data of a transcript is kept."""
    return _folder(base, _place(loc), slugify(F.col(title)), F.lit(f"{name}{f'_{stamp}' if stamp else ''}.{extension}"))


def output_paths(base: str, loc: str, title: str, suffix: Column, extension: str, stamp: str | None = None) -> Column:
    """`base/loc/slug<suffix>[_stamp].extension`; the time stamp is given, not taken from a clock."""
    name = F.concat(slugify(F.col(title)), suffix, F.lit(f"_{stamp}" if stamp else ""), F.lit(f".{extension}"))
    return _folder(base, _place(loc), name)


def write_parts(parts: DataFrame, keys: list[str], path: str) -> None:
    """Documents that come as `(…, part_no, text)`: one row per part, sorted within files.

    Runs of PARTS_TOGETHER parts of a document stay in one file, in order; no task holds a document.
    """
    run = F.floor(F.col("part_no") / PARTS_TOGETHER)
    parts.repartition(*keys, run).sortWithinPartitions(*keys, "part_no").write.parquet(path)
