"""Prompt texts as column expressions. The wording is ours; limits on lists and lengths are fixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkloom.functions.text import strip

# How much of a long field a prompt shows.
CLASSIFY_CHARS, METADATA_CHARS, CORRECT_CHARS, TAGS_SHOWN = 1000, 800, 200, 20
# How many entries of each section of the corpus context a correction prompt shows.

CLASSIFY_HEAD = """Decide whether a recording belongs in a technical archive.
Accept talks, workshops, reviews and discussions with technical substance.
Reject market talk, news, promotion, teasers and lifestyle content.
"""
CLASSIFY_TAIL = """
Answer with one JSON object: {"is_technical": true or false, "confidence": 0.0 to 1.0, "reason": "short text"}
"""
METADATA_HEAD = """Read the description of a recording and name the people speaking, the event and its topics.
Leave a field empty when it cannot be known; give two to five specific topics.
"""
METADATA_TAIL = """
Answer with one JSON object: {"speakers": [], "conference": "", "topics": []}
"""
CORRECT_HEAD = """Correct recognition errors in the transcript below: spelling, misheard words, terms and names.
Keep wording, order, speaker labels and time stamps. Change nothing else.
"""
CORRECT_TAIL = "\nReturn the whole corrected transcript.\n"
TEXT_START, TEXT_END = "\n--- text ---\n", "\n--- end of text ---\n"
SUMMARY_WHOLE = "Summarise this transcript, its main topics and arguments."
SUMMARY_PART = "Summarise the key points of this part of a transcript."
SUMMARY_FINAL = "Combine these summaries of the parts of one transcript into a single summary."


def _line(label: str, value: Column) -> Column:
    """`label: value`, or nothing for a missing or empty value."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label + ": "), value, F.lit("\n"))).otherwise("")


def _listed(items: Column, k: int) -> Column:
    return F.array_join(F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, k), ", ")


def _shown_tags(tags: Column) -> Column:
    listed = _listed(tags, TAGS_SHOWN)
    return F.when(listed == "", "None").otherwise(listed)


def _about(title: Column, channel: Column, tags: Column, description: Column, chars: int) -> list[Column]:
    return [
        F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\nChannel: "), F.coalesce(channel, F.lit("")),
        F.lit("\nTags: "), _shown_tags(tags), F.lit("\nDescription:\n"),
        F.substring(F.coalesce(description, F.lit("")), 1, chars),
    ]


def classify(title: Column, description: Column, tags: Column, channel: Column, category: Column) -> Column:
    return F.concat(
        F.lit(CLASSIFY_HEAD), F.lit("Channel category: "), F.coalesce(category, F.lit("unknown")), F.lit("\n"),
        *_about(title, channel, tags, description, CLASSIFY_CHARS), F.lit(CLASSIFY_TAIL),
    )


def metadata(title: Column, description: Column, channel: Column, tags: Column) -> Column:
    return F.concat(
        F.lit(METADATA_HEAD), *_about(title, channel, tags, description, METADATA_CHARS), F.lit(METADATA_TAIL)
    )


def shorten(description: Column) -> Column:
    """What a correction prompt shows of a description; cut before a text is split into chunks, so
    that its rows do not each carry the whole."""
    cut = F.concat(F.substring(description, 1, CORRECT_CHARS), F.lit("..."))
    return F.when(F.length(description) > CORRECT_CHARS, cut).otherwise(description)


def context_lines(context: Column) -> Column:
    """The corpus context as lines of a prompt; how many entries a section has is up to `tags.prompt_context`."""
    labels = {"Common topics": "frequent_tags", "Terms": "technical_terms", "Projects": "project_names",
              "Frequent speakers": "common_speakers", "Categories": "common_categories", "Areas": "expertise_areas"}
    variations = F.array_join(context["tag_variations"], "\n")
    return F.concat(
        _line("Transcripts known", F.array_join(context["video_count"], "")),
        *[_line(label, F.array_join(context[name], ", ")) for label, name in labels.items()],
        _line("Domain", F.array_join(context["domain_context"], "")),
        F.when(variations != "", F.concat(F.lit("Spellings:\n"), variations, F.lit("\n"))).otherwise(""),
    )


def correct(chunk: Column, about: dict[str, Column], context: Column, keywords: Column | None = None) -> Column:
    """`about` holds title, speakers, tags, categories and the shortened description; `context` is one
    struct."""
    extra = F.lit("") if keywords is None else F.coalesce(
        F.when(F.size(keywords) > 0, F.concat(F.lit("Priority keywords:\n- "), F.array_join(keywords, "\n- "), F.lit("\n"))), F.lit("")
    )
    return F.concat(
        F.lit(CORRECT_HEAD), _line("Title", about["title"]), _line("Speakers", F.array_join(about["speakers"], ", ")),
        _line("Tags", F.array_join(about["tags"], ", ")), _line("Categories", F.array_join(about["categories"], ", ")),
        _line("Description", about["description"]),
        context_lines(context), extra, F.lit(TEXT_START), strip(chunk), F.lit(TEXT_END), F.lit(CORRECT_TAIL),
    )


def summarise_whole(text: Column, title: Column) -> Column:
    return F.concat(F.lit(SUMMARY_WHOLE + "\n"), _line("Title", title), F.lit(TEXT_START), text, F.lit(TEXT_END))


def summarise_part(text: Column) -> Column:
    return F.concat(F.lit(SUMMARY_PART + "\n"), F.lit(TEXT_START), text, F.lit(TEXT_END))


def summarise_final(text: Column, title: Column) -> Column:
    return F.concat(F.lit(SUMMARY_FINAL + "\n"), _line("Title", title), F.lit(TEXT_START), text, F.lit(TEXT_END))
