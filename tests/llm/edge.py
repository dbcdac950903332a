"""Rows every operator has to live with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, component_id string, _row string, spans int, hash string, key int, row int"


def text(a: int, b: int) -> str:
    return " ".join(WORDS[a:b])


ROWS = [
    (1, text(0, 60)), (2, text(0, 60)), (2, text(0, 60)), (3, text(0, 59) + " other"), (4, text(100, 180)), (5, None), (6, ""), (7, " \n\t "), (None, text(0, 60)), (None, None),
    (8, "one"), (9, "ONE"), (10, "two words"), (11, text(200, 260) + "\n" + text(100, 180)), (12, text(0, 400) + "\n" + " ".join(f"long{i}" for i in range(30_000))),
    (13, "Ärger über ÉTÉ | x@y.de 5 kg, called Anna\nBerlin met Anna."), (14, "a b c d e f g h a b c d e f g h"), (15, "same line here\nsame line here\nsame line here"),
]


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """(doc_id, text) rows with further columns whose names clash with those the operators use; some are null."""
    rows = ROWS if rows is None else rows
    full = [(i, t, None, None if k % 5 == 0 else "ab"[k % 2], None, 7, None, "c", "r", 1, "h", 2, 3) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def labels(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    rows = [(1, 1, 0), (4, 0, None), (None, 1, 0), (4, 0, 0), (13, None, 0), (99, 1, 0), (11, 1, 0)] if rows is None else rows
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
