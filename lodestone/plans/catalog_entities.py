"""Queries on entity records and their resolution, each with its SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..functions import vector as V
from ..operators import assembly, models, resolve
from ..operators.lineage import spread
from .registry import query
from .tables import normal, read

EVERY = 50
# parts as entities: names as labels, types and brands as aliases, the name as the title of an article
ENTITIES = """(SELECT p_partkey AS ord, p_name AS label, 'https://en.wikipedia.org/wiki/' || replace(p_name, ' ', '%20') || '_' || p_partkey AS link, p_type AS zh, p_brand AS en FROM part)"""
# queries of five kinds: labels, brands, other spellings, words and links
QUERIES = f"""(SELECT p_partkey AS q, CASE (p_partkey // {EVERY}) % 5 WHEN 0 THEN ' ' || p_name WHEN 1 THEN p_brand WHEN 2 THEN upper(p_name) WHEN 3 THEN split_part(p_name, ' ', 2) ELSE '--' END AS query,
  CASE (p_partkey // {EVERY}) % 5 WHEN 4 THEN 'https://zh.wikipedia.org/wiki/' || replace(p_name, ' ', '%20') || '_' || p_partkey || '#x' ELSE '' END AS link FROM part WHERE p_partkey % {EVERY} = 0)"""


def entities(spark, d):
    link = F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("_"), F.col("p_partkey").cast("string"))
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_name").alias("label"), link.alias("link"), F.array("p_type").alias("aliases_zh"), F.array("p_brand").alias("aliases_en"))


def queries(spark, d):
    kind, name = F.floor(F.col("p_partkey") / EVERY) % 5, F.col("p_name")
    link = F.concat(F.lit("https://zh.wikipedia.org/wiki/"), F.replace(name, F.lit(" "), F.lit("%20")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit("#x"))
    text = F.when(kind == 0, F.concat(F.lit(" "), name)).when(kind == 1, F.col("p_brand")).when(kind == 2, F.upper(name)).when(kind == 3, F.get(F.split(name, " "), F.lit(1))).otherwise("--")
    return read(spark, d, "part").where(F.col("p_partkey") % EVERY == 0).select(F.col("p_partkey").alias("q"), text.alias("query"), F.when(kind == 4, link).otherwise("").alias("link"))


def _similar(a: str, b: str) -> str:
    return f"""CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN lower({a}) = lower({b}) THEN 1.0
  WHEN contains(lower({a}), lower({b})) OR contains(lower({b}), lower({a})) THEN least(length({a}), length({b})) / greatest(length({a}), length({b})) ELSE 0 END"""


CANDIDATES = f"""(WITH e AS {ENTITIES}, q AS (SELECT q, trim(query) AS text, link AS raw, {normal('link', 2)} AS n FROM {QUERIES}),
k AS (SELECT 'label' AS kind, trim(label) AS key, min(ord) AS ord, min(ord) AS place FROM e GROUP BY ALL UNION ALL
  SELECT 'alias', key, min(ord), min(ord) FROM (SELECT zh AS key, ord FROM e UNION ALL SELECT en, ord FROM e) GROUP BY ALL UNION ALL
  SELECT 'title', key, min(ord), min(ord) FROM (SELECT {normal('link', 2)} AS key, ord FROM e) GROUP BY ALL UNION ALL
  SELECT 'link', key, max(ord), min(ord) FROM (SELECT {normal('link', 2)} AS key, ord FROM e UNION ALL SELECT link, ord FROM e) GROUP BY ALL),
t AS (
  SELECT q, ord, 1 AS tier, 1.0 AS sim, place FROM q JOIN k ON kind = 'label' AND key = text UNION ALL
  SELECT q, ord, 2, 1.0, place FROM q JOIN k ON kind = 'alias' AND key = text UNION ALL
  SELECT q, ord, 3, 1.0, place FROM q JOIN k ON kind = 'title' AND key = n AND n <> '' UNION ALL
  SELECT q, ord, 4, 1.0, place FROM q JOIN k ON kind = 'link' AND key = n AND n <> '' UNION ALL
  SELECT q, ord, CASE kind WHEN 'label' THEN 5 WHEN 'alias' THEN 6 ELSE 7 END, {_similar('text', 'key')}, place FROM q JOIN k ON kind <> 'link' AND (kind <> 'title' OR n <> '') AND {_similar('text', 'key')} > 0.3 UNION ALL
  SELECT q, ord, 8, 0, place FROM q JOIN k ON kind = 'link' AND raw <> '' AND (contains(n, {normal('key', 2)}) OR contains({normal('key', 2)}, n) OR contains(raw, key) OR contains(key, raw)))
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY q, ord ORDER BY tier, sim DESC, place) = 1)"""


@query(f"SELECT q, ord, tier, round(sim, 6) AS similarity, place FROM {CANDIDATES}")
def tiered_match(spark, d):
    """Every entity that one of the eight tiers offers for a query, by its best tier."""
    return resolve.candidates(queries(spark, d), entities(spark, d)).select("q", "ord", "tier", F.round("similarity", 6).alias("similarity"), "place")


@query()
def greedy_one_to_one(spark, d):
    """The assignment depends on the order of the queries, which SQL can't follow; a test holds it against a loop."""
    return resolve.match(queries(spark, d), entities(spark, d)).select("q", "query", "ord", "method")


@query()
def match_methods(spark, d):
    return resolve.method_shares(resolve.match(queries(spark, d), entities(spark, d)))


@query(f"SELECT p_partkey AS q FROM part WHERE p_partkey % (2 * {EVERY}) = 0 UNION SELECT q FROM {QUERIES} WHERE q % (2 * {EVERY}) > 0 AND q NOT IN (SELECT q FROM {CANDIDATES})")
def unmatched_queries(spark, d):
    """Queries for which no tier offers anything; every other one is made so."""
    odd = F.col("q") % (2 * EVERY) > 0
    asked = queries(spark, d).withColumns({"query": F.when(odd, F.col("query")).otherwise("zz?"), "link": F.when(odd, F.col("link")).otherwise("")})
    return asked.select("q").join(resolve.candidates(asked, entities(spark, d)).select("q"), "q", "left_anti")


@query("SELECT p_partkey, p_brand || '|' || p_type || '|' || p_name AS links FROM part")
def reconciled_links(spark, d):
    """Ranked lines of a model's reply against the links that were asked: equal, contained, and left over."""
    ranked = F.array(F.concat(F.lit("1. "), "p_brand"), F.concat(F.lit("选项3："), "p_type", F.lit(" (the type)")), F.lit("--"))
    originals = F.array("p_name", "p_brand", "p_type")
    return spread(read(spark, d, "part")).select("p_partkey", F.array_join(resolve.reconciled_links(ranked, originals), "|").alias("links"))


@query("""SELECT p_partkey, p_name AS label, 'u' || p_partkey AS link, p_type AS zh, p_brand AS en, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS described FROM part""")
def canonical_entity(spark, d):
    """Records that spell their fields in different ways."""
    i, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    raw = read(spark, d, "part").select(
        "p_partkey", F.when(i % 2 == 0, F.col("p_name")).otherwise("").alias("label"), F.struct(F.col("p_name").alias("value")).alias("itemLabel"),
        F.lit("").alias("wikipedia"), F.concat(F.lit("u"), s).alias("wikipediaLink_zh"), F.when(i % 3 == 0, F.array("p_type")).alias("zh_aliases"), F.array("p_type").alias("aliases_zh"),
        F.col("p_brand").alias("en_aliases"), F.when(i % 2 == 0, F.col("p_type")).alias("zh_description"), F.col("p_brand").alias("descriptions_zh"))
    out = assembly.canonical(raw.withColumn("content", F.col("p_partkey").cast("string")))
    return out.select(
        F.col("content").cast("long").alias("p_partkey"), "label", "link", F.array_join("aliases_zh", "|").alias("zh"), F.array_join("aliases_en", "|").alias("en"),
        F.col("descriptions_zh").alias("described"))


ZH_EN = {"ECONOMY": "cheap", "STANDARD": "plain", "bad": T.ARTEFACT}
EN_ZH = {"red widget": "红", "cheap": "便宜", "plain": "普通"}


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([p_brand, p_name, CASE p_type WHEN 'ECONOMY' THEN 'cheap' WHEN 'STANDARD' THEN 'plain' END], lambda x: x IS NOT NULL))), '|') AS en,
  array_to_string(list_sort(list_distinct(list_filter([p_type, 'bad', CASE p_name WHEN 'red widget' THEN '红' END, CASE p_type WHEN 'ECONOMY' THEN '便宜' WHEN 'STANDARD' THEN '普通' END], lambda x: x IS NOT NULL))), '|') AS zh FROM part""")
def complete_aliases(spark, d):
    rows = read(spark, d, "part").withColumns({"zh_aliases": F.array("p_type", F.lit("bad")), "en_aliases": F.array("p_brand")})
    out = assembly.complete_aliases(rows, F.col("p_name"), ZH_EN, EN_ZH)
    return out.select("p_partkey", F.array_join(F.array_sort("en_aliases"), "|").alias("en"), F.array_join(F.array_sort("zh_aliases"), "|").alias("zh"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type WHEN p_name = 'red widget' THEN '红' ELSE '' END AS zh FROM part""")
def backfill_aliases(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.array("p_type")).alias("zh_aliases"), F.array("p_name").alias("en_aliases"))
    return assembly.backfill_zh(rows, EN_ZH).select("p_partkey", F.array_join("zh_aliases", "|").alias("zh"))


@query("""SELECT p_partkey, array_to_string(list_filter([p_type, p_name, CASE p_name WHEN 'red widget' THEN '红' END], lambda x: x IS NOT NULL), '|') AS zh, 'page' AS content, '国' || p_brand AS description_zh FROM part""")
def complete_record(spark, d):
    rows = read(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.array("p_type").alias("zh_aliases"), F.array("p_name").alias("en_aliases"))
    out = assembly.complete_record(rows, F.col("p_name"), F.lit("page"), F.concat(F.lit("國"), "p_brand"), ZH_EN, EN_ZH)
    return out.select("p_partkey", F.array_join("zh_aliases", "|").alias("zh"), "content", "description_zh")


DIM = 32


def _records(spark, d):
    i = F.col("p_partkey")
    return read(spark, d, "part").select(
        "p_partkey", F.when(i % 4 > 0, F.col("p_name")).otherwise("").alias("label"), F.concat(F.lit("u"), i.cast("string")).alias("link"), F.array("p_type").alias("aliases_zh"), A.no_strings().alias("aliases_en"),
        F.when(i % 3 == 0, "short").otherwise(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("descriptions_zh"), F.lit(None).cast("string").alias("descriptions_en"),
        F.lit("").alias("content"), F.when(i % 5 == 0, F.array("p_brand", "p_type")).alias("entity_words_zh"), A.no_strings().alias("entity_words_en"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN 1.0::DOUBLE END AS label_vector, 1.0::DOUBLE AS label_zh_vector, CASE WHEN p_partkey % 4 > 0 THEN 1.0::DOUBLE END AS label_en_vector,
  CASE WHEN p_partkey % 3 > 0 THEN 1.0::DOUBLE END AS descriptions_zh_vector, NULL::DOUBLE AS descriptions_en_vector, CASE WHEN p_partkey % 5 = 0 THEN 1.0::DOUBLE END AS entity_words_zh_vector, NULL::DOUBLE AS entity_words_en_vector FROM part""")
def entity_documents(spark, d):
    """Which of the seven vectors an index document has: their lengths."""
    make = lambda: models.HashingEmbedder(DIM)
    out = assembly.entity_document(_records(spark, d), models.embed(make, dim=DIM), models.embed_words(make), DIM)
    return out.select("p_partkey", *[F.round(V.norm(F.col(c)), 4).alias(c) for c in out.columns if c.endswith("_vector")])


@query("""SELECT doc_id, length(text) AS length, left(text, 500) AS described, lang AS label, CASE WHEN length(trim(text)) > 10 THEN 1.0::DOUBLE END AS content_vector FROM documents WHERE coalesce(trim(text), '') <> ''""")
def page_documents(spark, d):
    """Index documents from page texts."""
    rows = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("link"), F.col("lang").alias("query"), F.col("text").alias("content"))
    out = assembly.page_document(rows, models.embed(lambda: models.HashingEmbedder(DIM), dim=DIM), DIM)
    return out.select(
        F.col("link").cast("long").alias("doc_id"), F.char_length("content").cast("long").alias("length"), F.col("descriptions_zh").alias("described"), "label", F.round(V.norm(F.col("content_vector")), 4).alias("content_vector"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '国' ELSE '' END || p_name AS label, 1.0::DOUBLE AS zh, NULL::DOUBLE AS en FROM part""")
def first_documents(spark, d):
    """The early index document: simplified where there is Chinese, vectors of both descriptions."""
    rows = read(spark, d, "part").select(
        F.concat(F.when(F.col("p_partkey") % 2 == 0, "國").otherwise(""), "p_name").alias("label"), F.col("p_partkey").cast("string").alias("link"), F.col("p_type").alias("zh_description"))
    out = assembly.first_document(rows, models.embed(lambda: models.HashingEmbedder(DIM), dim=DIM))
    return out.select(F.col("link").cast("long").alias("p_partkey"), "label", *[F.round(V.norm(F.col(f"descriptions_{x}_vector")), 4).alias(x) for x in ("zh", "en")])


@query("""SELECT n_name AS label, 'https://zh/' || n_nationkey AS link, 'zh' AS lang FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, 'https://en/' || n_nationkey, 'en' FROM nation WHERE n_nationkey % 3 > 0""")
def download_tasks(spark, d):
    """One row per article link that an entity has."""
    i = F.col("n_nationkey")
    s = i.cast("string")
    rows = read(spark, d, "nation").select(
        F.col("n_name").alias("label"), F.when(i % 2 == 0, F.concat(F.lit("https://zh/"), s)).otherwise("").alias("wikipediaLink_zh"), F.when(i % 3 > 0, F.concat(F.lit("https://en/"), s)).alias("wikipediaLink_en"))
    return assembly.download_tasks(rows)


@query("""SELECT DISTINCT link FROM (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'https://en.wikipedia.org/wiki/N' || n_regionkey WHEN 1 THEN 'https://zh.wikipedia.org/wiki/N' || n_nationkey END AS link, n_nationkey FROM nation) WHERE link IS NOT NULL AND n_nationkey <> 5""")
def pages_to_fetch(spark, d):
    """Special pages, images, other hosts and what is done are left out."""
    i, s = F.col("n_nationkey"), F.col("n_nationkey").cast("string")
    en, zh = F.lit("https://en.wikipedia.org/wiki/"), F.lit("https://zh.wikipedia.org/wiki/")
    link = F.when(i % 4 == 0, F.concat(en, F.lit("N"), F.col("n_regionkey").cast("string"))).when(i % 4 == 1, F.concat(zh, F.lit("N"), s)).when(
        i % 8 == 2, F.concat(en, F.lit("File:"), s)).when(i % 8 == 6, F.concat(en, F.lit("Help:"), s)).otherwise(F.concat(F.lit("https://other/"), s))
    links = read(spark, d, "nation").select(link.alias("link"), "n_nationkey")
    return assembly.pages_to_fetch(links.select("link"), links.where("n_nationkey = 5").select("link"))
