"""Transcripts as Markdown, JSON and text documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions.text import blank_to_null, slugify

LISTS = ["speakers", "tags", "categories", "topics"]


def attribution(user: str, tool: str, version: str, review_flag: str = "") -> str:
    return f"{user} via {tool} v{version}{review_flag}"


def _yaml_text(c: Column) -> Column:
    """Plain where that is safe, else double-quoted (JSON strings are YAML)."""
    plain = c.rlike("\\A[A-Za-z][A-Za-z0-9 _./()'-]*\\z") & ~c.endswith(" ") & ~F.lower(c).isin(
        "true", "false", "null", "yes", "no", "on", "off", "y", "n"
    )
    quoted = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), "(?s)\\A\\{\"v\":(.*)\\}\\z", 1)
    return F.when(c.isNull(), "null").when(plain, c).otherwise(quoted)


def _yaml_list(name: str, c: Column) -> Column:
    items = F.array_join(F.transform(c, lambda x: F.concat(F.lit("  - "), _yaml_text(x), F.lit("\n"))), "")
    empty = F.size(F.coalesce(c, F.array().cast("array<string>"))) <= 0
    return F.when(empty, f"{name}: []\n").otherwise(F.concat(F.lit(f"{name}:\n"), items))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\n"))


def _maybe(present: Column, line: Column) -> Column:
    return F.when(F.coalesce(present, F.lit(False)), line).otherwise("")


def _indent(lines: Column) -> Column:
    return F.regexp_replace(lines, "(?m)^(?=.)", "  ")


def _platform_yaml() -> Column:
    """The platform's metadata as a nested mapping; present for videos, null if there is none."""
    y = F.col("youtube")
    nested = F.concat(
        _line("description", _yaml_text(y["description"])), _yaml_list("tags", y["tags"]),
        _yaml_list("categories", y["categories"]), _line("channel_name", _yaml_text(y["channel_name"])),
    )
    block = F.when(y.isNull(), "youtube: null\n").otherwise(F.concat(F.lit("youtube:\n"), _indent(nested)))
    return _maybe(F.col("type") == "video", block)


def _resources_yaml() -> Column:
    def entry(m: Column) -> Column:
        lines = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(": "), _yaml_text(e["value"]), F.lit("\n")))
        return F.concat(F.lit("  - "), F.regexp_replace(F.array_join(lines, ""), "\n(?=.)", "\n    "))

    listed = F.array_join(F.transform("additional_resources", entry), "")
    return _maybe(F.size("additional_resources") > 0, F.concat(F.lit("additional_resources:\n"), listed))


def front_matter(columns: list[str], transcript_by: str | None) -> Column:
    """Source metadata as YAML lines, without type, place, chapters and description.

    `columns` are those of the table: platform metadata and resources are shown where it has them.
    """

    def filled(name: str) -> Column:
        return F.col(name) != ""

    resources = _resources_yaml() if "additional_resources" in columns else F.lit("")
    platform = _platform_yaml() if {"youtube", "type"} <= set(columns) else F.lit("")
    return F.concat(
        _line("title", _yaml_text(F.col("title"))), _yaml_list("speakers", F.col("speakers")), _yaml_list("tags", F.col("tags")),
        _line("source_file", _yaml_text(F.col("source_file"))), _line("media", _yaml_text(F.col("media"))),
        _yaml_list("categories", F.col("categories")),
        _maybe(F.col("date").isNotNull(), _line("date", F.concat(F.lit("'"), F.col("date").cast("string"), F.lit("'")))),
        _maybe(filled("summary"), _line("summary", _yaml_text(F.col("summary")))),
        resources,
        _maybe(F.col("episode") != 0, _line("episode", F.col("episode").cast("string"))),
        _maybe(filled("conference"), _line("conference", _yaml_text(F.col("conference")))),
        _maybe(F.size("topics") > 0, _yaml_list("topics", F.col("topics"))),
        platform,
        _line("transcript_by", _yaml_text(F.lit(transcript_by))) if transcript_by else F.lit(""),
    )


def markdown(docs: DataFrame, transcript_by: str | None = None, include_metadata: bool = True, body: str = "corrected") -> DataFrame:
    """`(…, path, content)` per transcript with raw text; `body='raw'` ignores corrections.

    The plain variant is the raw text alone. Transcripts without raw text are errors: see missing_text.
    """
    text = F.col("raw_text") if body == "raw" else F.coalesce("corrected_text", "raw_text")
    content = F.col("raw_text")
    if include_metadata:
        content = F.concat(F.lit("---\n"), front_matter(docs.columns, transcript_by), F.lit("---\n\n"), text, F.lit("\n"))
    name = F.concat(slugify(F.col("title")), F.lit("" if include_metadata else "_plain"), F.lit(".md"))
    return docs.filter("raw_text IS NOT NULL").select("id", F.concat_ws("/", "loc", name).alias("path"), content.alias("content"))


def missing_text(docs: DataFrame) -> DataFrame:
    return docs.filter("raw_text IS NULL").select("id", F.lit("this transcript has no raw text").alias("error"))


def _filled_list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>")).alias(name)


def json_documents(docs: DataFrame, transcript_by: str | None = None) -> DataFrame:
    """`(id, path, content)`; absent media, date and attribution are left out."""
    fields = ["title", *[_filled_list(c) for c in ("categories", "tags", "speakers")], "loc"]
    doc = F.struct(
        *fields, F.col("raw_text").alias("body"), F.when(~F.col("local"), F.col("media")).alias("media"),
        F.col("date").cast("string").alias("date"), F.lit(transcript_by).cast("string").alias("transcript_by"),
    )
    path = F.concat_ws("/", "loc", F.concat(slugify(F.col("title")), F.lit(".json")))
    return docs.select("id", path.alias("path"), F.to_json(doc).alias("content"))


def texts(docs: DataFrame) -> DataFrame:
    """Up to three `(id, kind, path, content)` rows per transcript: raw, corrected and summary."""
    rows = docs.select("id", "loc", "title", F.col("raw_text").alias("raw"), F.col("corrected_text").alias("corrected"), "summary").unpivot(
        ["id", "loc", "title"], ["raw", "corrected", "summary"], "kind", "content"
    )
    name = F.concat(slugify(F.col("title")), F.lit("_"), F.col("kind"), F.lit(".txt"))
    return rows.filter("content <> ''").select("id", "kind", F.concat_ws("/", "loc", name).alias("path"), "content")


def source_document(youtube: bool = True) -> Column:
    """The JSON document of a source: empty optional fields are left out.

    A video's platform metadata is always there, as null if there is none.
    """
    doc = F.to_json(F.struct(
        "title", _filled_list("speakers"), _filled_list("tags"), "type", "loc", "source_file", "media",
        _filled_list("categories"), "chapters", blank_to_null(F.col("description")).alias("description"),
        F.col("date").cast("string").alias("date"), blank_to_null(F.col("summary")).alias("summary"),
        F.when(F.size("additional_resources") > 0, F.col("additional_resources")).alias("additional_resources"),
        F.when(F.col("episode") != 0, F.col("episode")).alias("episode"), blank_to_null(F.col("conference")).alias("conference"),
        F.when(F.size("topics") > 0, F.col("topics")).alias("topics"),
        *([F.col("youtube")] if youtube else []),
    ))
    if not youtube:
        return doc
    return F.when(F.col("youtube").isNull(), F.concat(F.regexp_replace(doc, "\\}\\z", ""), F.lit(',"youtube":null}'))).otherwise(doc)


EXPORTS = {"markdown": markdown, "json": json_documents, "text": lambda docs, transcript_by=None: texts(docs)}


def create_exports(config: dict[str, bool], transcript_by: str | None = None) -> dict:
    """Exports switched on by format flags; JSON is on unless switched off."""
    flags = {"markdown": config.get("markdown", False), "text": config.get("text_output", False), "json": config.get("json", True)}
    return {n: (lambda docs, fn=EXPORTS[n]: fn(docs, transcript_by=transcript_by)) for n, on in flags.items() if on}
