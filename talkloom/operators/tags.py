"""Corpus-wide dictionary of tags, terms, names and areas, derived from `(item_id, seq, kind, tag)` rows.

`kind` is manual, platform, category or speaker. Everything here is an aggregation with partial sums
before the shuffle, so a tag carried by a third of all items costs one row per task.

Ids may have any type that has an order. They order the items, unless the rows carry a whole number `arrival`,
which then does. Where `rows` is asked for, `usage(rows)` serves as well: several sections then share one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from talkloom.functions.text import strip
from talkloom.operators.ordered import pair_number
from talkloom.operators.rows import explode_once
from talkloom.scratch import materialise

# Substrings and prefixes the dictionary rules test for.
TOPIC_INDICATORS = ["bitcoin", "btc", "blockchain", "crypto", "lightning", "ln"]
TERM_INDICATORS = ["network", "protocol", "script", "sig", "key", "hash", "node", "chain", "block", "tx", "vault", "channel"]
TERM_PREFIXES = ["op_", "bip", "bolt"]
TERM_WORDS = ["taproot", "segwit", "multisig", "htlc"]
PROJECT_WORDS = ["core", "lightning", "btc", "wallet", "pay"]
AREAS = {
    "development": ["development", "dev", "programming", "coding", "technical"],
    "podcast": ["podcast", "interview", "discussion"],
    "conference": ["conference", "talk", "presentation", "summit"],
    "education": ["education", "tutorial", "learning", "teaching"],
    "mining": ["mining", "miner", "hashrate", "pool"],
    "security": ["security", "privacy", "cryptography", "audit"],
    "payments": ["payments", "lightning", "channel", "transaction"],
    "trading": ["trading", "exchange", "market", "price"],
}
CONTEXTS = {
    "development": ["script", "bdk", "core", "node", "api", "rpc", "development"],
    "payments": ["lightning", "payment", "channel", "invoice", "bolt"],
    "security": ["multisig", "signature", "key", "seed", "private", "security"],
    "mining": ["mining", "hash", "difficulty", "block", "pow"],
}
DOMAIN_BY_CATEGORY = {
    "development": "Bitcoin development and technical implementation",
    "technical": "Bitcoin development and technical implementation",
    "education": "Bitcoin education and learning",
    "tutorial": "Bitcoin education and learning",
    "podcast": "Bitcoin discussion and interviews",
    "interview": "Bitcoin discussion and interviews",
    "conference": "Bitcoin conferences and presentations",
    "presentation": "Bitcoin conferences and presentations",
}
DOMAIN_BY_AREA = {
    "payments": "Bitcoin payments and Lightning Network",
    "security": "Bitcoin security and cryptography",
    "mining": "Bitcoin mining and network",
}
DOMAIN_FALLBACK = "Bitcoin and blockchain technology"

TAG_KINDS = ["manual", "platform", "category"]
SPEAKERS_KEPT, SPEAKERS_SHOWN = 50, 20


def contains_any(c: Column, parts: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | c.contains(p)
    return hit


def _valid(rows: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return rows.filter(F.col("kind").isin(list(kinds)) & (strip(F.col("tag")) != ""))


def usage(rows: DataFrame) -> DataFrame:
    """`(kind, tag, n, first, last_seen)`: all that most sections need of the rows, in one pass."""
    return rows.groupBy("kind", "tag").agg(_uses(rows), _first_use(rows), _last_use(rows))


def _counted(rows: DataFrame) -> bool:
    return "first" in rows.columns


def _uses(rows: DataFrame) -> Column:
    return (F.sum("n") if _counted(rows) else F.count("*")).alias("n")


def _place(rows: DataFrame) -> list[str]:
    """The columns that order the rows."""
    return [c for c in ("arrival", "item_id", "seq") if c in rows.columns]


def _first_use(rows: DataFrame) -> Column:
    """Aggregate: struct((arrival,) item_id, seq) of the first use.

    Whole-number ids without an arrival are a minimum over one number, which a hash map keeps in place.
    """
    if _counted(rows):
        return F.min("first").alias("first")
    if "arrival" in rows.columns or not isinstance(rows.schema["item_id"].dataType, IntegralType):
        return F.min(F.struct(*_place(rows))).alias("first")
    first = F.min(pair_number(F.col("item_id"), F.col("seq")))
    width = F.lit(10**15).cast("decimal(16,0)")
    return F.struct(
        F.floor(first / width).cast("long").alias("item_id"), (first % width).cast("int").alias("seq")
    ).alias("first")


def _last_use(rows: DataFrame) -> Column:
    """Aggregate: the last item, with its arrival in front where there is one."""
    if _counted(rows):
        return F.max("last_seen").alias("last_seen")
    last = F.struct("arrival", "item_id") if "arrival" in rows.columns else F.col("item_id")
    return F.max(last).alias("last_seen")


def all_tags(manual: Column, platform: Column, categories: Column) -> Column:
    """Manual, platform and category tags of an item in this order, duplicates kept."""
    empty = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(c, empty) for c in (manual, platform, categories)])


def tag_context(tag: Column) -> Column:
    out = F.lit("general")
    for name, parts in reversed(CONTEXTS.items()):
        out = F.when(contains_any(tag, parts), name).otherwise(out)
    return out


def spelling_counts(rows: DataFrame) -> DataFrame:
    spelled = _valid(rows, TAG_KINDS).withColumn("spelling", strip(F.col("tag")))
    return spelled.groupBy(F.lower("spelling").alias("tag"), "spelling").agg(
        _uses(rows), _first_use(rows), _last_use(rows)
    )


def tag_stats(rows: DataFrame) -> DataFrame:
    """Per case-folded tag: count, spellings in order of first use, first and last item, context."""
    return fold_spellings(spelling_counts(rows))


def fold_spellings(per_spelling: DataFrame) -> DataFrame:
    """`(tag, spelling, n, first, last_seen)` to one row per tag."""
    ordered = F.array_sort(F.collect_list(F.struct("first", "spelling")))
    last = "last_seen.item_id" if isinstance(per_spelling.schema["last_seen"].dataType, StructType) else "last_seen"
    return per_spelling.groupBy("tag").agg(
        F.sum("n").alias("frequency"),
        F.transform(ordered, lambda s: s["spelling"]).alias("variations"),
        F.min("first").alias("first"),
        F.max("last_seen").alias("last_seen"),
    ).select(
        "tag", "frequency", "variations", tag_context(F.col("tag")).alias("context"),
        F.col("first.item_id").alias("first_seen"), F.col(last).alias("last_seen"), "first",
    )


def category_stats(rows: DataFrame) -> DataFrame:
    named = _valid(rows, ["category"])
    return named.groupBy(F.lower(strip(F.col("tag"))).alias("category")).agg(
        _uses(rows).alias("frequency"), _first_use(rows)
    )


def top(stats: DataFrame, k: int) -> DataFrame:
    """Most frequent first; equal counts in order of first appearance."""
    return stats.orderBy(F.desc("frequency"), "first").limit(k)


def tag_variations(stats: DataFrame) -> DataFrame:
    return stats.filter(F.size("variations") > 1)


def on_topic_items(rows: DataFrame, texts: DataFrame, indicators: Sequence[str] = TOPIC_INDICATORS) -> DataFrame:
    """Ids of items with an indicator in a tag or in `texts(item_id, text)`."""
    by_tag = rows.filter(F.col("kind").isin(TAG_KINDS) & contains_any(F.lower("tag"), indicators)).select("item_id")
    by_text = texts.filter(contains_any(F.lower("text"), indicators)).select("item_id")
    return by_tag.union(by_text).distinct()


def technical_terms(
    rows: DataFrame, texts: DataFrame, topic: Sequence[str] = TOPIC_INDICATORS,
    indicators: Sequence[str] = TERM_INDICATORS,
) -> DataFrame:
    """Distinct lower-case tags of on-topic items that look technical, with their first use.

    The one section that needs the rows themselves, not their usage.
    """
    low = F.lower("tag")
    looks = contains_any(low, indicators) | low.isin(TERM_WORDS)
    for p in TERM_PREFIXES:
        looks = looks | low.startswith(p)
    tags = rows.filter(F.col("kind").isin(TAG_KINDS) & (F.length("tag") > 3) & ~F.col("tag").rlike("^\\p{Nd}+$") & looks)
    # Fold repeats inside an item before the join, which is then on distinct ids.
    rest = [c for c in _place(rows) if c != "item_id"]
    per_item = tags.groupBy("item_id", low.alias("term")).agg(*[F.min(c).alias(c) for c in rest])
    kept = per_item.join(on_topic_items(rows, texts, topic), "item_id", "left_semi")
    return kept.groupBy("term").agg(_first_use(kept))


def project_names(rows: DataFrame, words: Sequence[str] = PROJECT_WORDS) -> DataFrame:
    """Distinct tags longer than two characters that start upper case or hold a project word."""
    looks = F.col("tag").rlike("^\\p{Lu}") | contains_any(F.lower("tag"), words)
    tags = rows.filter(F.col("kind").isin(TAG_KINDS) & (F.length("tag") > 2) & looks)
    return tags.groupBy(F.col("tag").alias("project")).agg(_first_use(rows))


def expertise_areas(rows: DataFrame, areas: dict[str, list[str]] | None = None) -> DataFrame:
    """Areas whose keywords occur in a tag or category, with their first use (categories first)."""
    areas = areas or AREAS
    low = F.lower("tag")
    hits = F.array(*[F.when(contains_any(low, ks), F.struct(F.lit(i).alias("no"), F.lit(a).alias("area")))
                     for i, (a, ks) in enumerate(areas.items())])
    def order(seq: Column) -> Column:
        return F.when(F.col("kind") == "category", 0).otherwise(seq + 1)

    kept = rows.filter(F.col("kind").isin(TAG_KINDS))
    if _counted(rows):
        kept = kept.withColumn("first", F.col("first").withField("seq", order(F.col("first.seq"))))
        place = ["first"]
    else:
        kept, place = kept.withColumn("seq", order(F.col("seq"))), _place(rows)
    found = explode_once(kept, place, F.filter(hits, lambda h: h.isNotNull()), "_i", "h")
    seen = found.groupBy(F.col("h.area").alias("area")).agg(_first_use(found), F.min("h.no").alias("no"))
    names = seen.schema["first"].dataType.names
    return seen.select("area", F.struct(*[F.col(f"first.{n}") for n in names], "no").alias("first"))


def recent_speakers(rows: DataFrame, keep: int = SPEAKERS_KEPT) -> DataFrame:
    """The last `keep` distinct speakers in order of first appearance."""
    seen = _valid(rows, ["speaker"]).groupBy(strip(F.col("tag")).alias("speaker")).agg(_first_use(rows))
    return seen.orderBy(F.desc("first")).limit(keep)


def domain_context(categories: DataFrame, areas: DataFrame) -> DataFrame:
    """One row: phrases of the top three categories, then of the first three areas."""

    def phrases(rows: DataFrame, name: str, by: dict[str, str], rank: Column) -> DataFrame:
        text = F.lit(None).cast("string")
        for key, phrase in by.items():
            text = F.when(F.col(name) == key, phrase).otherwise(text)
        listed = F.array_sort(F.collect_list(F.struct(rank.alias("r"), text.alias("t"))))
        return rows.agg(F.filter(F.transform(listed, lambda x: x["t"]), lambda t: t.isNotNull()).alias("t"))

    first_cats = top(categories, 3)
    first_areas = areas.orderBy("first").limit(3)
    by_cat = phrases(first_cats, "category", DOMAIN_BY_CATEGORY, F.struct(-F.col("frequency"), F.col("first")))
    by_area = phrases(first_areas, "area", DOMAIN_BY_AREA, F.col("first"))
    parts = F.concat("t", by_area.scalar())
    joined = F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(DOMAIN_FALLBACK)
    return by_cat.select(joined.alias("domain_context"))


def statistics(
    rows: DataFrame, texts: DataFrame, topic: Sequence[str] = TOPIC_INDICATORS, indicators: Sequence[str] = TERM_INDICATORS,
    words: Sequence[str] = PROJECT_WORDS, areas: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One row of counts with the ten most frequent tags and five categories."""
    used = materialise(usage(rows), "tag-usage")
    stats, cats = tag_stats(used), category_stats(used)

    def size_of(df: DataFrame) -> Column:
        return df.agg(F.count("*")).scalar()

    def listed(df: DataFrame, name: str, k: int) -> Column:
        entry = F.concat_ws("=", F.col(name), F.col("frequency"))
        ordered = F.array_sort(F.collect_list(F.struct(-F.col("frequency"), F.col("first"), entry.alias("e"))))
        return top(df, k).agg(F.transform(ordered, lambda x: x["e"])).scalar()

    totals = stats.agg(F.count("*").alias("total_unique_tags"), F.sum("frequency").alias("total_tag_occurrences"))
    return totals.select(
        texts.agg(F.count("*")).scalar().alias("videos_processed"),
        "total_unique_tags", "total_tag_occurrences",
        size_of(technical_terms(rows, texts, topic, indicators)).alias("technical_terms_count"),
        size_of(project_names(used, words)).alias("project_names_count"),
        size_of(recent_speakers(used)).alias("speakers_count"),
        size_of(cats).alias("categories_count"),
        size_of(expertise_areas(used, areas)).alias("expertise_areas_count"),
        listed(stats, "tag", 10).alias("most_frequent_tags"),
        listed(cats, "category", 5).alias("most_common_categories"),
    )


def correction_context(
    rows: DataFrame, texts: DataFrame, topic: Sequence[str] = TOPIC_INDICATORS, indicators: Sequence[str] = TERM_INDICATORS,
    words: Sequence[str] = PROJECT_WORDS, areas: dict[str, list[str]] | None = None, speakers_shown: int = SPEAKERS_SHOWN,
) -> DataFrame:
    """The whole correction context as `(section, first, item, detail)` rows.

    Terms, projects and variations grow with the corpus, so they stay rows; `prompt_context` is the
    bounded one-row extract a prompt uses.
    """
    # Read by all sections but the terms: aggregate the corpus once, then scan the result.
    used = materialise(usage(rows), "tag-usage")
    stats, cats, found = tag_stats(used), category_stats(used), expertise_areas(used, areas)
    none = F.lit(None).cast("string")
    place = [(f.name, "int" if f.name == "seq" else f.dataType) for f in used.schema["first"].dataType]
    plain = F.struct(*[F.col(f"first.{name}").cast(kind).alias(name) for name, kind in place])
    start = F.struct(*[F.lit(0).cast(kind).alias(name) for name, kind in place])

    def section(name: str, df: DataFrame, item: str, detail: Column = none) -> DataFrame:
        return df.select(F.lit(name).alias("section"), plain.alias("first"), F.col(item).alias("item"), detail.alias("detail"))

    def one(name: str, value: DataFrame) -> DataFrame:
        column = value.columns[0]
        return value.select(
            F.lit(name).alias("section"), start.alias("first"),
            F.col(column).cast("string").alias("item"), none.alias("detail"),
        )

    count = F.col("frequency").cast("string")
    shown = recent_speakers(used).orderBy("first").limit(speakers_shown)
    parts = [
        section("frequent_tags", top(stats, 30), "tag", count),
        section("tag_variations", tag_variations(stats), "tag", F.array_join("variations", ", ")),
        section("technical_terms", technical_terms(rows, texts, topic, indicators), "term"),
        section("project_names", project_names(used, words), "project"),
        section("common_speakers", shown, "speaker"),
        section("common_categories", top(cats, 10), "category", count),
        section("expertise_areas", found, "area"),
        one("domain_context", domain_context(cats, found)),
        one("video_count", texts.agg(F.count("*").alias("n"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# How many entries of each section a correction prompt shows.
PROMPT_LIMITS = {
    "frequent_tags": 15, "technical_terms": 20, "project_names": 15, "common_speakers": 10,
    "common_categories": 8, "expertise_areas": 8, "tag_variations": 5, "domain_context": 1, "video_count": 1,
}


def prompt_context(context: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """One row with the bounded lists a prompt shows, from correction_context rows; `limits` replaces PROMPT_LIMITS by section."""
    limited = None
    for name, k in (PROMPT_LIMITS | (limits or {})).items():
        ranked = name in ("frequent_tags", "common_categories")
        order = [F.desc(F.col("detail").cast("long")), F.col("first"), F.col("item")] if ranked else [F.col("first"), F.col("item")]
        part = context.filter(F.col("section") == name).orderBy(*order).limit(k)
        part = part.withColumn("_freq", F.when(F.lit(ranked), -F.col("detail").try_cast("long")).otherwise(0))
        limited = part if limited is None else limited.unionByName(part)
    shown = F.when(F.col("section") == "tag_variations", F.concat_ws(": ", "item", "detail")).otherwise(F.col("item"))
    entry = F.struct("_freq", "first", shown.alias("shown"))
    return limited.agg(*[
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("section") == name, entry))), lambda e: e["shown"]
        ).alias(name)
        for name in PROMPT_LIMITS
    ])
