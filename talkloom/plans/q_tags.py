"""Queries over the tag dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.operators import tags
from talkloom.plans import views
from talkloom.plans.registry import query

# The catalog of parts stands in for items; its words never mention the real topics, so the queries
# pass their own indicator lists.
TOPIC = ["economy", "ring", "brand#2"]
TERMS = ["gear", "ring", "promo", "brand#1"]
AREAS = {"tools": ["bolt", "gear"], "luxury": ["ring"], "brands": ["brand#"], "sizes": ["small", "large", "medium"]}


def _likes(col, parts):
    return "(" + " OR ".join(f"contains({col}, '{p}')" for p in parts) + ")"


_TAGS = "SELECT * FROM item_tags WHERE kind IN ('manual', 'platform', 'category') AND trim(tag) <> ''"
_STATS = f"""SELECT lower(trim(tag)) AS tag, count(*) AS frequency, min(item_id * 10 + seq) AS first, min(item_id) AS first_seen,
  max(item_id) AS last_seen FROM ({_TAGS}) t GROUP BY 1"""
_SPELLINGS = f"""SELECT tag, string_agg(spelling, '|' ORDER BY f) AS variations, count(*) AS n_spellings FROM (
  SELECT lower(trim(tag)) AS tag, trim(tag) AS spelling, min(item_id * 10 + seq) AS f FROM ({_TAGS}) t GROUP BY 1, 2) s GROUP BY 1"""
_CATS = """SELECT lower(trim(tag)) AS category, count(*) AS frequency, min(item_id * 10 + seq) AS first
FROM item_tags WHERE kind = 'category' AND trim(tag) <> '' GROUP BY 1"""
_CONTEXT = "CASE " + " ".join(f"WHEN {_likes('tag', ps)} THEN '{n}'" for n, ps in tags.CONTEXTS.items()) + " ELSE 'general' END"
_TITLES = "SELECT p_partkey AS item_id, p_name AS text FROM part"


def _terms_sql(topic, terms):
    looks = _likes("lower(tag)", terms) + " OR lower(tag) IN ('taproot', 'segwit', 'multisig', 'htlc')" + "".join(
        f" OR starts_with(lower(tag), '{p}')" for p in tags.TERM_PREFIXES)
    return f"""SELECT lower(tag) AS term, min(item_id * 10 + seq) AS first FROM item_tags WHERE kind <> 'speaker' AND length(tag) > 3
  AND NOT regexp_matches(tag, '^[0-9]+$') AND ({looks}) AND item_id IN (
    SELECT item_id FROM item_tags WHERE kind <> 'speaker' AND {_likes('lower(tag)', topic)}
    UNION SELECT item_id FROM ({_TITLES}) x WHERE {_likes('lower(text)', topic)}) GROUP BY 1"""


_PROJECTS = f"""SELECT tag AS project, min(item_id * 10 + seq) AS first FROM item_tags WHERE kind <> 'speaker' AND length(tag) > 2
  AND (regexp_matches(tag, '^\\p{{Lu}}') OR {_likes('lower(tag)', tags.PROJECT_WORDS)}) GROUP BY 1"""
_SPEAKERS = """SELECT trim(tag) AS speaker, min(item_id * 10 + seq) AS first FROM item_tags
  WHERE kind = 'speaker' AND trim(tag) <> '' GROUP BY 1 ORDER BY first DESC LIMIT 50"""


def _areas_sql(areas):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS area, min(item_id * 1000 + (CASE WHEN kind = 'category' THEN 0 ELSE seq + 1 END) * 100 + {i}) AS first "
        f"FROM item_tags WHERE kind <> 'speaker' AND {_likes('lower(tag)', ks)} HAVING count(*) > 0"
        for i, (a, ks) in enumerate(areas.items()))


def _rows(spark, sf):
    return views.item_tags(spark, sf)


def _titles(spark, sf):
    return views.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("text"))


def _first():
    return (F.col("first.item_id") * 10 + F.col("first.seq")).alias("first")


@query("tag_frequency", f"""SELECT s.tag, frequency, variations, {_CONTEXT.replace("tag,", "s.tag,")} AS context, first_seen, last_seen
FROM ({_STATS}) s JOIN ({_SPELLINGS}) v ON v.tag = s.tag""", ["item_tags"])
def tag_frequency(spark, sf):
    stats = tags.tag_stats(_rows(spark, sf))
    return stats.select("tag", "frequency", F.array_join("variations", "|").alias("variations"), "context", "first_seen", "last_seen")


@query("tag_frequency_text_ids", f"""SELECT s.tag, frequency, variations, 'v' || first_seen AS first_seen, 'v' || last_seen AS last_seen
FROM ({_STATS}) s JOIN ({_SPELLINGS}) v ON v.tag = s.tag""", ["item_tags"])
def tag_frequency_text_ids(spark, sf):
    """Text ids, ordered by the arrival number of their items."""
    rows = _rows(spark, sf).withColumn("arrival", F.col("item_id")).withColumn("item_id", F.concat(F.lit("v"), F.col("item_id")))
    stats = tags.tag_stats(rows)
    return stats.select("tag", "frequency", F.array_join("variations", "|").alias("variations"), "first_seen", "last_seen")


@query("category_frequency", f"SELECT category, frequency FROM ({_CATS}) c", ["item_tags"])
def category_frequency(spark, sf):
    return tags.category_stats(_rows(spark, sf)).select("category", "frequency")


@query("technical_terms", _terms_sql(TOPIC, TERMS), ["item_tags"])
def technical_terms(spark, sf):
    return tags.technical_terms(_rows(spark, sf), _titles(spark, sf), TOPIC, TERMS).select("term", _first())


@query("project_names", _PROJECTS, ["item_tags"])
def project_names(spark, sf):
    return tags.project_names(_rows(spark, sf)).select("project", _first())


@query("expertise_areas", _areas_sql(AREAS), ["item_tags"])
def expertise_areas(spark, sf):
    first = F.col("first")
    at = first["item_id"] * 1000 + first["seq"] * 100 + first["no"]
    return tags.expertise_areas(_rows(spark, sf), AREAS).select("area", at.alias("first"))


@query("recent_speakers", _SPEAKERS, ["item_tags"])
def recent_speakers(spark, sf):
    return tags.recent_speakers(_rows(spark, sf)).select("speaker", _first())


@query("tag_variations", f"SELECT tag, variations FROM ({_SPELLINGS}) s WHERE n_spellings > 1", ["item_tags"])
def tag_variations(spark, sf):
    rows = tags.tag_variations(tags.tag_stats(_rows(spark, sf)))
    return rows.select("tag", F.array_join("variations", "|").alias("variations"))


@query("top_tags", f"SELECT tag, frequency FROM ({_STATS}) s ORDER BY frequency DESC, first LIMIT 30", ["item_tags"])
def top_tags(spark, sf):
    return tags.top(tags.tag_stats(_rows(spark, sf)), 30).select("tag", "frequency")


@query("top_categories", f"SELECT category, frequency FROM ({_CATS}) s ORDER BY frequency DESC, first LIMIT 10", ["item_tags"])
def top_categories(spark, sf):
    return tags.top(tags.category_stats(_rows(spark, sf)), 10).select("category", "frequency")


def _domain_sql():
    by_cat = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tags.DOMAIN_BY_CATEGORY.items()) + " END"
    by_area = "CASE area " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tags.DOMAIN_BY_AREA.items()) + " END"
    return f"""SELECT coalesce(string_agg(t, ', ' ORDER BY g, f, first), '{tags.DOMAIN_FALLBACK}') AS domain_context FROM (
  SELECT 0 AS g, -frequency AS f, first, {by_cat} AS t FROM (SELECT * FROM ({_VCATS}) c ORDER BY frequency DESC, first LIMIT 3) c3
  UNION ALL SELECT 1, 0, first, {by_area} FROM (SELECT * FROM ({_VAREAS}) a ORDER BY first LIMIT 3) a3) x"""


# Domain text needs the real category names: channel categories serve, in order of the videos.
_VCATS = """SELECT category, count(*) AS frequency, min(v.id) AS first FROM videos v JOIN channels c ON c.id = v.channel_id
WHERE category IS NOT NULL GROUP BY category"""
_VAREAS = " UNION ALL ".join(
    f"SELECT '{a}' AS area, min(v.id * 1000 + {i}) AS first FROM videos v JOIN channels c ON c.id = v.channel_id "
    f"WHERE {_likes('category', ks)} HAVING count(*) > 0" for i, (a, ks) in enumerate(tags.AREAS.items()))


def _video_categories(spark, sf):
    c = views.channels(spark, sf).select(F.col("id").alias("channel_id"), "category")
    v = views.videos(spark, sf).select("channel_id", F.col("id").alias("item_id"))
    return v.join(c, "channel_id").select("item_id", F.lit(0).alias("seq"), F.lit("category").alias("kind"), F.col("category").alias("tag")).filter("tag IS NOT NULL")


@query("domain_context", _domain_sql(), ["videos", "channels"])
def domain_context(spark, sf):
    rows = _video_categories(spark, sf)
    return tags.domain_context(tags.category_stats(rows), tags.expertise_areas(rows))


def _count_sql(sql):
    return f"(SELECT count(*) FROM ({sql}) q)"


@query(
    "tag_statistics",
    f"""SELECT (SELECT count(*) FROM part) AS videos_processed, count(*) AS total_unique_tags,
  sum(frequency)::BIGINT AS total_tag_occurrences, {_count_sql(_terms_sql(TOPIC, TERMS))} AS technical_terms_count,
  {_count_sql(_PROJECTS)} AS project_names_count, {_count_sql(_SPEAKERS)} AS speakers_count, {_count_sql(_CATS)} AS categories_count,
  {_count_sql(_areas_sql(AREAS))} AS expertise_areas_count,
  (SELECT string_agg(tag || '=' || frequency, ', ' ORDER BY frequency DESC, first) FROM (SELECT * FROM ({_STATS}) s ORDER BY frequency DESC, first LIMIT 10) t) AS most_frequent_tags,
  (SELECT string_agg(category || '=' || frequency, ', ' ORDER BY frequency DESC, first) FROM (SELECT * FROM ({_CATS}) s ORDER BY frequency DESC, first LIMIT 5) t) AS most_common_categories
FROM ({_STATS}) s""",
    ["item_tags"],
)
def tag_statistics(spark, sf):
    out = tags.statistics(_rows(spark, sf), _titles(spark, sf), TOPIC, TERMS, areas=AREAS)
    return out.withColumn("most_frequent_tags", F.array_join("most_frequent_tags", ", ")).withColumn(
        "most_common_categories", F.array_join("most_common_categories", ", "))


_CONTEXT_ROWS = f"""SELECT 'frequent_tags' AS section, first, tag AS item, frequency::VARCHAR AS detail FROM (SELECT * FROM ({_STATS}) s ORDER BY frequency DESC, first LIMIT 30) t
UNION ALL SELECT 'tag_variations', s.first, s.tag, replace(variations, '|', ', ') FROM ({_STATS}) s JOIN ({_SPELLINGS}) v ON v.tag = s.tag WHERE n_spellings > 1
UNION ALL SELECT 'technical_terms', first, term, NULL FROM ({_terms_sql(TOPIC, TERMS)}) t
UNION ALL SELECT 'project_names', first, project, NULL FROM ({_PROJECTS}) p
UNION ALL SELECT 'common_speakers', first, speaker, NULL FROM (SELECT * FROM ({_SPEAKERS}) s ORDER BY first LIMIT 20) s
UNION ALL SELECT 'common_categories', first, category, frequency::VARCHAR FROM (SELECT * FROM ({_CATS}) c ORDER BY frequency DESC, first LIMIT 10) c
UNION ALL SELECT 'expertise_areas', first // 1000 * 10 + first % 1000 // 100, area, NULL FROM ({_areas_sql(AREAS)}) a
UNION ALL SELECT 'domain_context', 0, '{tags.DOMAIN_FALLBACK}', NULL
UNION ALL SELECT 'video_count', 0, count(*)::VARCHAR, NULL FROM part"""


def _context(spark, sf):
    return tags.correction_context(_rows(spark, sf), _titles(spark, sf), TOPIC, TERMS, areas=AREAS)


@query("correction_context", _CONTEXT_ROWS, ["item_tags"])
def correction_context(spark, sf):
    return _context(spark, sf).select("section", _first(), "item", "detail")


@query("all_tags", """SELECT p_partkey AS item_id, concat_ws('|', CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE p_type END,
  CASE WHEN p_partkey % 5 > 0 THEN p_brand END, split_part(p_name, ' ', 2), split_part(p_name, ' ', 1)) AS tags FROM part""")
def all_tags(spark, sf):
    part, key = views.table(spark, sf, "part"), F.col("p_partkey")
    manual = F.array(F.when(key % 3 == 0, F.lower("p_type")).otherwise(F.col("p_type")))
    platform = F.when(key % 5 > 0, F.array("p_brand"))
    name = F.split("p_name", " ")
    joined = tags.all_tags(manual, platform, F.array(name[1], name[0]))
    return part.select(key.alias("item_id"), F.array_join(joined, "|").alias("tags"))


@query("tag_context", f"SELECT item_id, seq::BIGINT AS seq, {_CONTEXT} AS context FROM item_tags", ["item_tags"])
def tag_context(spark, sf):
    return _rows(spark, sf).select("item_id", F.col("seq").cast("long").alias("seq"), tags.tag_context(F.col("tag")).alias("context"))
