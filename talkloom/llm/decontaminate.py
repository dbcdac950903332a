"""Benchmark decontamination by templates, with DataFrame functions only.

Texts become token templates: numbers, units behind numbers and capitalised names inside sentences are
typed placeholders, other words stand in lower case. A wider template makes every capitalised word a name, so that names
at the start of a text, sentence, line or quote are placeholders too. Windows of WINDOW tokens are hashed and joined with the
windows of the benchmark's templates. Where a matching window has slots, the values must fit together: in one alignment of document and item,
an item's value always stands for one value of the document. So a question asked again with other
numbers or names is found, and a chance match of placeholders is not. Alignments are one offset between document and item, ranges of
offsets (words were put in or left out) and the whole document; the best one counts, so copies with different values do not disturb each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm.frames import packed, stored, unpacked

WINDOW = 8
LEAST_WORDS = 4  # words that are no placeholders, in a benchmark window worth looking for
LEAST_SHARE = 0.4  # of an item's windows found in a document
LEAST_RUN = 13  # or so many windows of the item one after the other at one offset: 20 tokens, however long the item is
RANGE = 32  # offsets of a range; ranges overlap by half
BROADCAST_ROWS = 500_000  # benchmark windows or marked documents (about 40 MB) that may be sent to every executor

_NAME = r"\p{Lu}(?<=[\p{L}\p{N},;]\x20\p{Lu})\p{Ll}+(?!\p{L})"
_ANY_NAME = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?!\p{L})"
_NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"
_UNIT = "km|cm|mm|m|kg|g|mg|lb|lbs|oz|l|ml|miles?|feet|ft|inch(?:es)?|hours?|hrs?|minutes?|min|seconds?|sec|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?"
_UNITS = rf"(\x02[\p{{N}}.,]*\p{{N}})\x20?({_UNIT})(?![\p{{L}}\p{{N}}])"
_BETWEEN = r"(?:[^\p{L}\p{N}\x01-\x03.,]|[.,](?!\p{N}))+"


def tokens(text: Column, names: str | None = _NAME) -> Column:
    """Tokens in lower case; a placeholder is a mark (1 name, 2 number, 3 unit) and its value. Places are the same whatever `names` matches."""
    marked = F.regexp_replace(text, names, "\x01$0") if names else text
    marked = F.regexp_replace(F.regexp_replace(marked, _NUMBER, "\x02$0"), f"(?i){_UNITS}", "$1 \x03$2")
    return F.split(F.lower(marked), _BETWEEN)


def _hashes(df: DataFrame, tokens: str = "tokens", windows: str = "windows") -> DataFrame:
    """Add `windows`: the hash of the WINDOW template tokens from each place on, by doubling.

    Places near the end have hashes over fewer tokens, which equal no full window's.
    """
    of = F.transform(tokens, lambda t: F.xxhash64(F.when(t < "\x04", F.substr(t, F.lit(1), F.lit(1))).otherwise(t)))
    df = df.withColumn(windows, of)
    step = 1
    while step < WINDOW:
        df = df.withColumn(windows, F.zip_with(windows, F.slice(windows, step + 1, F.greatest(F.size(windows), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    return df


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, at, window, slots(place, value)) of benchmark(item_id, text); names as placeholders, as words, and every capitalised word as a name."""
    def of(names: str | None) -> DataFrame:
        rows = benchmark.filter("text is not null").select("item_id", F.filter(tokens(F.col("text"), names), lambda t: t != "").alias("tokens"))
        rows = _hashes(rows).select("item_id", "tokens", F.posexplode_outer("windows").alias("at", "window")).filter(F.col("at") <= F.size("tokens") - WINDOW)
        rows = rows.withColumn("own", F.slice("tokens", F.col("at") + 1, WINDOW))
        placed = F.zip_with("own", F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda t, i: F.struct(i.alias("place"), t.alias("value")))
        return rows.withColumn("slots", F.filter(placed, lambda s: s["value"] < "\x04")).filter(WINDOW - F.size("slots") >= LEAST_WORDS).select("item_id", "at", "window", "slots")

    return of(_NAME).unionByName(of(None)).unionByName(of(_ANY_NAME)).distinct()


def _small(df: DataFrame) -> DataFrame:
    """Broadcast `df` if it is counted to be small, else join it by a shuffle.

    The engine would go by the size of the compressed files, a small part of what their rows take on the driver.
    """
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def _alignments() -> Column:
    """The alignments a hit at `pos` of the document and `at` of the item counts in; kind 0 is the exact offset."""
    offset = F.col("pos") - F.col("at")
    kinds = (offset, F.floor(offset / RANGE), F.floor((offset + RANGE // 2) / RANGE), F.lit(0))
    return F.array(*[F.struct(F.lit(i).alias("kind"), k.cast("long").alias("place")) for i, k in enumerate(kinds)])


def _longest_run(places: Column) -> Column:
    """Length of the longest run of whole numbers without a gap in an array of distinct ones."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state: Column, p: Column) -> Column:
        run = F.when(p == state["last"] + 1, state["run"] + 1).otherwise(F.lit(1))
        return F.struct(p.alias("last"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(F.array_sort(places), start, step, lambda s: s["best"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, least_share: float = LEAST_SHARE, least_run: int = LEAST_RUN) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, item_windows, share, verbatim): pairs of a document and an item it holds, by the best alignment:
    a share of the item's windows from `least_share` on, or `least_run` windows in a row.

    docs(doc_id, text), benchmark(item_id, text). Null and empty texts hold nothing and are found nowhere, as are items of fewer than
    WINDOW tokens. Rows with one id are looked at each by their text; equal rows are one. Null ids match like others. `verbatim`: no slot differs.
    """
    key = ["doc_id", "text_hash", "item_id"]
    docs = docs.filter("text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    bench = stored(benchmark_windows(benchmark.select("item_id", "text")), "benchmark")
    # The outer form: for the other one the optimizer tests the array's size first, which would compute it twice over at every doubling.
    rows = docs.select("doc_id", "text_hash", tokens(F.col("text")).alias("tokens"), tokens(F.col("text"), _ANY_NAME).alias("wide_tokens"))
    rows = _hashes(_hashes(rows), "wide_tokens", "wide")
    both = F.zip_with("windows", "wide", lambda a, b: F.when(a == b, F.array(a)).otherwise(F.array(a, b)))
    places = rows.select("doc_id", "text_hash", F.posexplode_outer(both).alias("pos", "both")).select("doc_id", "text_hash", "pos", F.explode_outer("both").alias("window"))
    hits = stored(places.join(_small(bench), "window").select(*key, "pos", "at", "slots"), "hits")
    plain = hits.filter(F.size("slots") == 0).select(*key, F.explode(_alignments()).alias("alignment"), "at", F.lit(False).alias("changed"))
    slotted = hits.filter(F.size("slots") > 0)
    if not slotted.isEmpty():
        some = stored(slotted.select("doc_id", "text_hash").distinct(), "slotted")
        same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
        near = docs.alias("d").join(_small(some).alias("s"), same({c: F.col(f"d.{c}") for c in key[:2]}, {c: F.col(f"s.{c}") for c in key[:2]}), "leftsemi")
        near = near.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), tokens(F.col("text"), _ANY_NAME).alias("tokens")).dropDuplicates(["id", "hash"])
        slots = slotted.join(near.hint("merge"), slotted.doc_id.eqNullSafe(near.id) & (slotted.text_hash == near.hash))
        values = F.transform("slots", lambda s: F.struct(s["value"].alias("item_value"), F.get(F.col("tokens"), F.col("pos") + s["place"]).alias("doc_value")))
        slots = stored(slots.select(*key, F.explode(_alignments()).alias("alignment"), "at", values.alias("values")), "values")
        # An item's value stands for the document's value it meets most often in the alignment; windows that say otherwise do not count.
        votes = slots.select(*key, "alignment", F.explode("values").alias("v")).groupBy(*key, "alignment", "v").agg(F.count("*").alias("k"))
        chosen = votes.groupBy(*key, "alignment", F.col("v.item_value").alias("item_value")).agg(F.max(F.struct("k", "v.doc_value")).alias("best"))
        right = F.map_from_entries(F.collect_list(F.struct("item_value", "best.doc_value"))).alias("right")
        chosen = chosen.groupBy(*[F.col(c).alias(f"c_{c}") for c in [*key, "alignment"]]).agg(right)
        joined = slots.join(chosen.hint("merge"), [slots[c].eqNullSafe(chosen[f"c_{c}"]) for c in [*key, "alignment"]])
        fits = joined.filter(F.forall("values", lambda v: F.element_at("right", v["item_value"]) == v["doc_value"]))
        plain = plain.unionByName(fits.select(*key, "alignment", "at", F.exists("values", lambda v: v["doc_value"] != v["item_value"]).alias("changed")))
    nth = bench.select(F.col("item_id").alias("item"), "at").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy("at")))
    nth = stored(nth.withColumnRenamed("at", "item_at"), "places")
    plain = plain.join(_small(nth), plain.item_id.eqNullSafe(nth.item) & (plain["at"] == nth.item_at))
    found = plain.groupBy(*key, "alignment").agg(F.collect_set("nth").alias("nths"), (~F.max("changed")).alias("verbatim"))
    run = F.when(F.col("alignment.kind") == 0, _longest_run(F.col("nths"))).otherwise(0)  # elsewhere, windows in a row need not be neighbours in the document
    found = found.select(*key, F.size("nths").cast("long").alias("n_windows"), "verbatim", run.alias("run"))
    found = found.groupBy(*key).agg(F.max(F.struct("n_windows", "verbatim")).alias("best"), F.max("run").alias("run")).select(*key, "best.*", "run")
    totals = bench.groupBy(F.col("item_id").alias("item")).agg(F.countDistinct("at").alias("item_windows"))
    found = found.join(totals, found.item_id.eqNullSafe(totals.item)).withColumn("share", F.col("n_windows") / F.col("item_windows"))
    return found.filter((F.col("share") >= least_share) | (F.col("run") >= least_run)).select(*key, "n_windows", "item_windows", "share", "verbatim")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows of `docs` that hold no item of the benchmark, all columns as they are."""
    marked = stored(find_leaks(docs.select("doc_id", "text"), benchmark, least_share=least_share).select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash")).distinct(), "leaks")
    rows = packed(docs, doc_id=F.col("doc_id"), text_hash=F.xxhash64("text"))
    clean = rows.join(_small(marked), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "leftanti")
    return unpacked(clean, docs)
