"""Times and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(c: Column) -> Column:
    return F.format_string("%02d", c.cast("long"))


def hms(seconds: Column) -> Column:
    """Seconds as HH:MM:SS; hours grow beyond two digits."""
    whole = F.floor(seconds).cast("long")
    return F.concat_ws(":", _two(F.floor(whole / 3600)), _two(F.floor(whole / 60) % 60), _two(whole % 60))


def srt_time(seconds: Column) -> Column:
    """Seconds as HH:MM:SS,mmm with truncated milliseconds."""
    millis = F.floor((seconds % 1) * 1000).cast("long")
    return F.concat(hms(seconds), F.lit(","), F.format_string("%03d", millis))


def iso_duration_seconds(text: Column) -> Column:
    """`PT1H2M3S` as seconds; anything that does not start with PT is 0."""

    def part(unit: str) -> Column:
        digits = F.regexp_extract(text, rf"^PT(?:\d+[HM])*?(\d+){unit}", 1)
        return F.coalesce(digits.try_cast("int"), F.lit(0))

    total = part("H") * 3600 + part("M") * 60 + part("S")
    return F.when(F.coalesce(text.startswith("PT"), F.lit(False)), total).otherwise(0)


def rfc3339(text: Column) -> Column:
    """Append Z unless the text ends in Z or carries an offset with a plus sign."""
    return F.when(text.endswith("Z") | text.contains("+"), text).otherwise(F.concat(text, F.lit("Z")))


def parse_date(text: Column, fmt: str = "yyyy-M-d") -> Column:
    """Strict date with one or two digits of month and day, null on mismatch (callers turn a null into a rejected row)."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("date")


def parse_compact_date(text: Column) -> Column:
    return parse_date(text, "yyyyMMdd")


def iso_text(ts: Column) -> Column:
    """UTC timestamp as ISO text with offset; microseconds only when there are any."""
    micros = F.date_format(ts, ".SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == ".000000", "").otherwise(micros),
        F.lit("+00:00"),
    )
