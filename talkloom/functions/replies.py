"""Model replies to typed columns, and the decisions taken on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkloom.functions.text import WHITE, strip

# Durations outside the range are not classified; approval needs this confidence.
MIN_SECONDS, MAX_SECONDS = 600, 3000
APPROVAL_CONFIDENCE = 0.7


def _document(text: Column) -> Column:
    """The one JSON value `text` consists of, null if malformed or followed by anything else."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    items = F.try_variant_get(wrapped, "$", "array<variant>")
    return F.when(F.size(items) == 1, F.get(items, F.lit(0)))


def _field(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", "variant")


def _kind(v: Column) -> Column:
    """Type name of a JSON value; null where the value is missing."""
    return F.when(v.isNotNull(), F.schema_of_variant(v))


def _is_object(doc: Column) -> Column:
    return F.coalesce(_kind(doc).startswith("OBJECT"), F.lit(False))


def _truthy(v: Column) -> Column:
    kind, text = _kind(v), F.try_variant_get(v, "$", "string")
    return F.coalesce(
        F.when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(kind == "VOID", False)
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(text.try_cast("double") != 0),
        F.lit(False),
    )


def json_of_reply(reply: Column) -> Column:
    """The JSON text inside a reply: fenced block first, else the outermost braces."""
    text = strip(reply)
    fenced = F.regexp_extract(text, f"(?s)```(?:json)?[{WHITE}]*\\n?(.*?)\\n?[{WHITE}]*```", 1)
    inner = F.when(text.rlike(f"(?s)```(?:json)?[{WHITE}]*\\n?(.*?)\\n?[{WHITE}]*```"), strip(fenced)).otherwise(text)
    braces = F.regexp_extract(inner, "(?s)\\{.*\\}", 0)
    return F.when(~inner.startswith("{") & (braces != ""), braces).otherwise(inner)


def parse_classification(reply: Column) -> Column:
    """struct(is_technical, confidence in [0, 1], reason); a bad reply is (false, 0.0, message)."""
    doc = _document(json_of_reply(reply))
    conf = _field(doc, "confidence")
    number = F.when(conf.isNull(), 0.5).otherwise(F.try_variant_get(conf, "$", "string").try_cast("double"))
    reason = _field(doc, "reason")
    said = strip(F.when(_kind(reason) == "VOID", "None").otherwise(F.try_variant_get(reason, "$", "string")))
    ok = _is_object(doc) & number.isNotNull()
    return F.struct(
        F.when(ok, _truthy(_field(doc, "is_technical"))).otherwise(False).alias("is_technical"),
        F.when(ok, F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("confidence"),
        F.when(~ok, "Parse error: no JSON object with a numeric confidence")
        .when(F.coalesce(said, F.lit("")) == "", "No reason provided")
        .otherwise(said).alias("reason"),
    )


def _names(v: Column) -> Column:
    """Strings of a list, or a single string, stripped and without blanks."""
    listed = F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    texts = F.transform(listed, lambda x: F.when(_kind(x) == "STRING", strip(F.try_variant_get(x, "$", "string"))))
    return F.coalesce(F.filter(texts, lambda t: t.isNotNull() & (t != "")), F.array().cast("array<string>"))


def parse_metadata(reply: Column) -> Column:
    """struct(speakers, conference, topics) of a plain or fenced JSON reply; empties on failure."""
    text = strip(reply)
    lines = F.split(text, "\n")
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    doc = _document(F.when(text.startswith("```"), inner).otherwise(text))
    event = _field(doc, "conference")
    said = F.when(_truthy(event), strip(F.try_variant_get(event, "$", "string"))).otherwise("")
    return F.struct(
        F.when(_is_object(doc), _names(_field(doc, "speakers"))).otherwise(F.array().cast("array<string>")).alias("speakers"),
        F.when(_is_object(doc), said).otherwise("").alias("conference"),
        F.when(_is_object(doc), _names(_field(doc, "topics"))).otherwise(F.array().cast("array<string>")).alias("topics"),
    )


def merge_metadata(own: dict[str, Column], found: Column) -> dict[str, Column]:
    """Speakers given by hand win; conference and topics are set only where something was found."""
    by_hand = F.size(F.coalesce(own["speakers"], F.array().cast("array<string>"))) > 0
    return {
        "speakers": F.when(by_hand | found.isNull() | (F.size(found["speakers"]) <= 0), own["speakers"]).otherwise(found["speakers"]),
        "conference": F.when(found.isNull() | (found["conference"] == ""), own["conference"]).otherwise(found["conference"]),
        "topics": F.when(found.isNull() | (F.size(found["topics"]) <= 0), own["topics"]).otherwise(found["topics"]),
    }


def duration_gate(seconds: Column, low: int = MIN_SECONDS, high: int = MAX_SECONDS) -> Column:
    """Reason to skip classification, null for a duration in range, zero or unknown."""
    known = F.coalesce(seconds, F.lit(0)) > 0
    return F.when(known & (seconds < low), F.format_string(f"Too short (%ds < {low}s minimum)", seconds)).when(
        known & (seconds > high), F.format_string(f"Too long (%ds > {high}s maximum)", seconds)
    )


def classification_status(is_technical: Column, confidence: Column, threshold: float = APPROVAL_CONFIDENCE) -> Column:
    return F.when(is_technical & (confidence >= threshold), "queued").when(~is_technical, "skipped").otherwise("classified")
