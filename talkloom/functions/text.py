"""Text column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip and \s treat as white space.
WHITE = "\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SENTENCE_GAP = f"(?<=[.?!])[{WHITE}]+"
LETTER = "[\\p{L}\\p{N}_]"
SENTENCE_GAP_ABBREV = f"(?<!{LETTER}\\.{LETTER}.)(?<![A-Z][a-z]\\.)(?<=[.?…-])[{WHITE}]"


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"\\A[{WHITE}]+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WHITE}]+\\z", "")


def strip(c: Column) -> Column:
    """Remove all white space at both ends, not only spaces."""
    return F.regexp_replace(c, f"\\A[{WHITE}]+|[{WHITE}]+\\z", "")


def slugify(c: Column) -> Column:
    """Underscores and runs of non-word characters to one hyphen, trimmed, lower case."""
    hyphened = F.regexp_replace(F.regexp_replace(c, "_", "-"), "[^\\p{L}\\p{N}_]+", "-")
    return F.lower(F.regexp_replace(hyphened, "\\A-+|-+\\z", ""))


def split_sentences(c: Column) -> Column:
    """Non-empty stripped sentences, split after . ? or !"""
    return F.filter(F.transform(F.split(c, SENTENCE_GAP), strip), lambda s: s != "")


def split_sentences_abbrev(c: Column) -> Column:
    """Split after . ? … or -, but not after abbreviations such as e.g. or Dr."""
    return F.split(c, SENTENCE_GAP_ABBREV)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def length_guard(given: Column, returned: Column, ratio: float = 0.7) -> Column:
    """Keep `given` when `returned` is missing or much shorter."""
    short = returned.isNull() | (F.length(returned) < F.length(given) * F.lit(ratio))
    return F.when(short, given).otherwise(returned)


def media_of(link: Column, source_file: Column) -> Column:
    return F.coalesce(link, source_file)


def title_or_stem(title: Column, source_file: Column) -> Column:
    """The title, else the file name without folders and extension."""
    base = F.regexp_extract(source_file, "([^/]*)\\z", 1)
    stem = F.regexp_replace(base, "(?<=[^.])\\.[^.]*\\z", "")
    return F.coalesce(title, stem)


def watch_url(video_id: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id)


def video_id_of(url: Column) -> Column:
    return F.regexp_extract(url, "[?&]v=([^&#]+)", 1)


def speaker_id(label: Column) -> Column:
    """`speaker_3` or a plain number to 3, anything else to 0."""
    digits = F.coalesce(blank_to_null(F.regexp_extract(label, "^speaker_(?:.*_)?(\\d+)$", 1)), label)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def source_kind(source_file: Column, has_metadata: Column) -> Column:
    """Media kind by suffix, in this order of precedence."""
    low = F.lower(source_file)

    def ends(c, *suffixes):
        hit = F.lit(False)
        for s in suffixes:
            hit = hit | c.endswith(s)
        return hit

    return (
        F.when(ends(low, ".mp3", ".wav", ".m4a", ".aac"), "audio")
        .when(ends(source_file, "rss", ".xml"), "rss")
        .when(has_metadata, "known_video")
        .when(ends(low, ".mp4", ".webm", ".mov"), "remote_video")
        .otherwise("lookup")
    )
