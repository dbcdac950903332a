"""Chat formatting with DataFrame functions only: event logs folded into messages, rendered by a template.

An event log has (conv_id, seq, message, kind, role, text). `delta` appends to its message, `edit` puts new text in
place of all before it, `regenerate` drops what a message had and starts it again. A message's place in its conversation is that of
its first event. The fold needs no running state: what counts of a message are the events from its last edit or regeneration on,
in order. Groups are messages; a conversation of any length is spread over its messages.

The template marks turns as <|im_start|>role, newline, text, <|im_end|>, newline. Inside roles and texts a backslash is doubled and
<| becomes <\\|, so no mark can stand there; in a role a newline gets a backslash as well. A backslash before a character is dropped on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
_PIECE = r"(?s)^<\|im_start\|>((?:[^\\\n]++|(?:\\.)++)*+)\n(.*)$"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """events -> (conv_id, place, message, role, text), one row per message.

    Null texts are empty, null roles the empty role; of several roles the one of the first event counts. Kinds other than the three count
    as `delta`. Events that tie in `seq` are ordered by kind (resets first), then text. Null sequence numbers come first. A null conversation is one of its own.
    """
    reset = F.col("kind").isin("edit", "regenerate")
    order = F.struct(F.col("seq").isNotNull().alias("known"), F.coalesce("seq", F.lit(0)).alias("seq"), (~F.coalesce(reset, F.lit(False))).alias("later"), F.coalesce("text", F.lit("")).alias("text"))
    rows = events.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(reset, F.lit(False)).alias("reset"),
                         (F.col("kind") == "regenerate").alias("again"), order.alias("o"))
    said = F.struct("o", F.when(F.coalesce("again", F.lit(False)), F.lit("")).otherwise(F.col("o.text")).alias("said"))
    rows = rows.groupBy("conv_id", "message").agg(
        F.min(F.struct("o.known", "o.seq", "o.later", "role")).alias("first"), F.max(F.when(F.col("reset"), F.col("o"))).alias("from"), F.sort_array(F.collect_list(said)).alias("log"))
    kept = F.filter("log", lambda e: F.col("from").isNull() | (e["o"] >= F.col("from")))
    return rows.select("conv_id", F.struct("first.known", "first.seq").alias("place"), "message", F.col("first.role").alias("role"),
                       F.array_join(F.transform(kept, lambda e: e["said"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """messages with `formatted`, the part of the document each message is, and `loss`: where in it, in code points, an assistant's text stands."""
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    text = escape(F.col("text"))
    loss = F.when(F.col("role") == "assistant", F.struct(F.length(head).alias("start"), (F.length(head) + F.length(text)).alias("end")))
    return messages.withColumn("formatted", F.concat(head, text, F.lit(END))).withColumn("loss", loss)


def documents(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): whole documents, with the loss spans of each in code points.

    The one step that brings a conversation together: its document is a single string, of at most 2 GB.
    """
    order = F.struct("place", "message", "role", "formatted", "loss")
    rows = rendered.groupBy("conv_id").agg(F.sort_array(F.collect_list(order)).alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def step(state: Column, part: Column) -> Column:
        moved = F.struct((state["at"] + part["loss"]["start"]).alias("start"), (state["at"] + part["loss"]["end"]).alias("end"))
        return F.struct((state["at"] + F.length(part["formatted"])).alias("at"),
                        F.when(part["loss"].isNotNull(), F.concat(state["loss"], F.array(moved))).otherwise(state["loss"]).alias("loss"))

    return rows.select("conv_id", F.array_join(F.transform("parts", lambda p: p["formatted"]), "").alias("formatted"), F.aggregate("parts", start, step, lambda s: s["loss"]).alias("loss"))


def read_back(rows: DataFrame) -> DataFrame:
    """(conv_id, turns(role, text), loss_text) from documents alone: the inverse of the template."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, _PIECE, 1)).alias("role"), unescape(F.regexp_extract(p, _PIECE, 2)).alias("text")))
    masked = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    return rows.select("conv_id", "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))


def conversation_events(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as a log in which every row is one delta.

    Rows that repeat a turn are messages of their own, told apart by role, text and count.
    """
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("k"))
    same = same.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "k")))
    digest = F.sha2(F.concat_ws("\x01", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    message = F.struct(F.coalesce("role", F.lit("")).alias("role"), digest.alias("digest"), F.col("role").isNull().alias("no_role"), F.col("text").isNull().alias("no_text"), F.col("turn").alias("turn"), "copy")
    return same.select("conv_id", F.col("turn").alias("seq"), message.alias("message"), F.lit("delta").alias("kind"), "role", "text")


def digest(rows: DataFrame) -> DataFrame:
    """Counts and digests of documents()'s rows, from what is read back."""
    back = read_back(rows)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
