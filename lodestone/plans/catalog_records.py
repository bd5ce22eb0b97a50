"""Queries on record operators, profiles, sources and sinks, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import links as L
from ..operators import lexical_index, profile, records
from ..operators.lineage import cut
from ..sources import keyed, readers, writers
from ..sources import page_files as sink
from ..streaming import ingest
from . import runner
from .registry import query
from .tables import read

CUT = "regexp_extract(url, '^[^#?]*')"
HREFS = """regexp_extract_all(html, '<a href="([^"]*)"', 1)"""


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder where all executors can write."""
    cut(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY {CUT} ORDER BY page_id) = 1")
def dedupe_first_by_link(spark, d):
    return records.first_by(read(spark, d, "pages").select("page_id", "url"), L.cut_url(F.col("url")), "page_id")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def dedupe_last(spark, d):
    return records.last_by(read(spark, d, "conversations").select("conv_id", "turn", "role"), F.col("conv_id"), "turn")


@query("""SELECT doc_id, coalesce(c.text, '') AS text FROM documents LEFT JOIN (SELECT 'c' || conv_id AS k, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id) c ON c.k = 'c' || doc_id""")
def description_join(spark, d):
    """The last page of a link describes its entity; none is an empty description."""
    docs = read(spark, d, "documents").select("doc_id", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("link"))
    pages = read(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("page"), "turn", "text")
    return records.lookup_last(docs, "link", pages, "page", "text", "turn").select("doc_id", "text")


@query(f"SELECT DISTINCT href AS link FROM (SELECT unnest({HREFS}) AS href FROM pages) WHERE href NOT IN (SELECT coalesce(regexp_extract(url, '://[^/]*(/[^#?]*)', 1), '') FROM pages)")
def anti_join_frontier(spark, d):
    pages = read(spark, d, "pages")
    done = pages.select(F.regexp_extract("url", r"://[^/]*(/[^#?]*)", 1).alias("link"))
    return pages.select(F.explode(H.hrefs(F.col("html"))).alias("link")).distinct().join(done, "link", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_existing(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT page_id FROM pages)")
def semi_join_listed(spark, d):
    return read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "pages").select(F.col("page_id").alias("doc_id")), "doc_id", "left_semi")


@query(f"""WITH e AS (SELECT regexp_extract(url, '://[^/]*(/[^#?]*)', 1) AS link, unnest({HREFS}) AS target FROM pages), s AS (SELECT DISTINCT link FROM e WHERE link < '/e')
SELECT link, 0 AS depth FROM s UNION ALL SELECT DISTINCT target, 1 FROM e JOIN s USING (link) WHERE target NOT IN (SELECT link FROM s)""")
def crawl_one_hop(spark, d):
    edges = read(spark, d, "pages").select(F.regexp_extract("url", r"://[^/]*(/[^#?]*)", 1).alias("link"), F.explode(H.hrefs(F.col("html"))).alias("target"))
    return records.crawl(edges.where("link < '/e'"), edges, "link", "target")


@query("""SELECT page_id, md5(CASE WHEN page_id % 3 = 0 THEN replace(html, '<nav>', '<img src="data:image/jpeg;base64,QUJD' || page_id || '"><img src="/gone.jpg"><nav>')
  ELSE replace(html, '<nav>', '<img src="//img/' || page_id || '.jpg"><img src="/gone.jpg"><nav>') END) AS html FROM pages""")
def inline_images(spark, d):
    """Images are known for every third page."""
    i = F.col("page_id").cast("string")
    html = F.replace("html", F.lit("<nav>"), F.concat(F.lit('<img src="//img/'), i, F.lit('.jpg"><img src="/gone.jpg"><nav>')))
    pages = read(spark, d, "pages").select("page_id", html.alias("html"))
    images = pages.where("page_id % 3 = 0").select(F.concat(F.lit("https://img/"), i, F.lit(".jpg")).alias("image_url"), F.concat(F.lit("QUJD"), i).alias("image_data"))
    return records.inline_images(pages, "page_id", "html", images, "image_url", "image_data").select("page_id", F.md5(F.col("html").cast("binary")).alias("html"))


PAGE_SQL = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'K' || p_partkey WHEN 1 THEN 'x/K' || p_partkey || '/y' ELSE 'https://en.wikipedia.org/wiki/%4B' || p_partkey END AS page FROM part"


@query(f"""WITH p AS ({PAGE_SQL}), q AS (SELECT DISTINCT p_partkey, 'https://en.wikipedia.org/wiki/%4B' || p_partkey AS link, 'K' || p_partkey AS n FROM part WHERE p_partkey % 50 = 0)
SELECT link, coalesce(e.p_partkey, c.p_partkey, r.p_partkey) AS p_partkey, CASE WHEN e.p_partkey IS NOT NULL THEN 'normal' WHEN c.p_partkey IS NOT NULL THEN 'contains' ELSE 'raw' END AS how
FROM q LEFT JOIN (SELECT page, min(p_partkey) AS p_partkey FROM p GROUP BY page) e ON e.page = q.n
LEFT JOIN (SELECT n, min(p.p_partkey) AS p_partkey FROM q JOIN p ON contains(p.page, q.n) GROUP BY n) c ON c.n = q.n LEFT JOIN p r ON r.page = q.link WHERE coalesce(e.p_partkey, c.p_partkey, r.p_partkey) IS NOT NULL""")
def find_by_link(spark, d):
    """The page with the normal form, else one that contains it, else the raw link."""
    i = F.col("p_partkey")
    s = i.cast("string")
    raw = F.concat(F.lit("https://en.wikipedia.org/wiki/%4B"), s)
    part = read(spark, d, "part")
    pages = part.select("p_partkey", F.when(i % 3 == 0, F.concat(F.lit("K"), s)).when(i % 3 == 1, F.concat(F.lit("x/K"), s, F.lit("/y"))).otherwise(raw).alias("page"))
    wanted = part.where("p_partkey % 50 = 0").select(raw.alias("link"))
    return records.find_by_link(wanted, pages, "link", L.normalize_v2(F.col("link")), "page", "p_partkey")


@query("SELECT page_id, url FROM pages WHERE url = (SELECT min(url) FROM pages) ORDER BY page_id LIMIT 1")
def page_lookup(spark, d):
    """The first page of one link."""
    pages = read(spark, d, "pages").select("page_id", "url")
    one = pages.agg(F.min("url").alias("url"))
    return pages.join(F.broadcast(one), "url").orderBy("page_id").limit(1).select("page_id", "url")


@query("SELECT min(page_id) AS page_id, count(*) AS hits FROM pages WHERE contains(url, '.com/fr/')")
def wildcard_lookup(spark, d):
    return read(spark, d, "pages").where(F.col("url").contains(".com/fr/")).agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("hits"))


@query("""SELECT p.page_id, q.page_id AS relink FROM pages p JOIN (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) q ON q.url = p.url""")
def relink_lookup(spark, d):
    """By equality of the address."""
    pages = read(spark, d, "pages").select("page_id", "url")
    return pages.join(pages.groupBy("url").agg(F.min("page_id").alias("relink")), "url").select("page_id", "relink")


@query("""SELECT p_name, word, round(least(length(word), length(p_name)) / greatest(length(word), length(p_name)), 6) AS similarity FROM (SELECT DISTINCT p_name FROM part), (SELECT DISTINCT unnest(list_concat(string_split(p_name, ' '), [substr(p_name, 2, 4), upper(p_name)])) AS word FROM part)
WHERE word <> '' AND (contains(lower(p_name), lower(word)) OR contains(lower(word), lower(p_name))) AND least(length(word), length(p_name)) / greatest(length(word), length(p_name)) >= 0.4""")
def fuzzy_containment_join(spark, d):
    """Names against their words, parts of words, and names in capitals."""
    names = read(spark, d, "part").select("p_name").distinct()
    items = F.concat(F.split("p_name", " "), F.array(F.substring("p_name", 2, 4), F.upper("p_name")))
    out = records.fuzzy_join(names, names.select(F.explode(items).alias("word")), "p_name", "word", 0.4)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("SELECT doc_id, coalesce(b.n, a.n) AS n FROM (SELECT doc_id, n_chars AS n FROM documents) a FULL JOIN (SELECT doc_id, quality::BIGINT AS n FROM labels) b USING (doc_id)")
def upsert_by_key(spark, d):
    base = read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("n"))
    return records.upsert(base, read(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("n")), "doc_id", "n")


UPSERTED = """SELECT coalesce(o.k, n.k) AS link, CASE WHEN o.k IS NULL THEN n.content ELSE coalesce(n.content, o.content) END AS content, CASE WHEN o.k IS NULL THEN n.label ELSE o.label END AS label,
  CASE WHEN o.k IS NULL THEN 'created' WHEN n.k IS NOT NULL THEN 'updated' ELSE 'kept' END AS action
FROM (SELECT doc_id AS k, source AS content, lang AS label FROM documents WHERE doc_id % 3 > 0) o
FULL JOIN (SELECT doc_id AS k, CASE WHEN doc_id % 4 > 0 THEN 'new' || doc_id END AS content, 'L' AS label FROM documents WHERE doc_id % 2 = 0) n ON o.k = n.k"""


def _old_and_new(spark, d):
    docs, i = read(spark, d, "documents"), F.col("doc_id")
    old = docs.where(i % 3 > 0).select(i.alias("link"), F.col("source").alias("content"), F.col("lang").alias("label"))
    new = docs.where(i % 2 == 0).select(i.alias("link"), F.when(i % 4 > 0, F.concat(F.lit("new"), i.cast("string"))).alias("content"), F.lit("L").alias("label"))
    return old, new


@query(UPSERTED)
def upsert_documents(spark, d):
    """Content is updated where there is some; labels of known links stay."""
    old, new = _old_and_new(spark, d)
    return records.upsert_rows(old, new, "link", ["content"])


@query(f"SELECT action, count(*) AS n, round(100.0 * sum(CASE WHEN action <> 'kept' THEN count(*) ELSE 0 END) OVER () / sum(count(*)) OVER (), 6) AS success_percent FROM ({UPSERTED}) GROUP BY action")
def upload_outcomes(spark, d):
    old, new = _old_and_new(spark, d)
    return profile.outcome_rates(records.upsert_rows(old, new, "link", ["content"]), "action", ["created", "updated"])


@query("SELECT n_nationkey, field, value FROM (SELECT n_nationkey, n_name AS name, n_regionkey::VARCHAR AS region FROM nation) UNPIVOT (value FOR field IN (name, region))")
def unpivot_links(spark, d):
    wide = read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region"))
    return wide.unpivot("n_nationkey", ["name", "region"], "field", "value")


@query("SELECT o_orderkey, ceil(row_number() OVER (ORDER BY o_orderkey) / 1000)::BIGINT AS batch FROM orders")
def batch_split(spark, d):
    return records.batches(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(0.8 * (SELECT count(*) FROM documents)) THEN 'train' ELSE 'dev' END AS split FROM documents")
def train_dev_split(spark, d):
    return records.train_dev_split(read(spark, d, "documents").select("doc_id"), "doc_id")


# the eleven switched sources, by the number of a document's source
NUMBERED = ", ".join(f"({i}, '{s}')" for i, s in enumerate(runner.SOURCES))
CONFIGS = ", ".join(f"('{c}', '{s}')" for c, on in runner.CONFIGURATIONS.items() for s in on)
SOURCED = f"(SELECT doc_id, lang, s.name AS source FROM documents JOIN (VALUES {NUMBERED}) s(i, name) ON documents.source = 'src' || s.i)"


def _sourced(spark, d):
    names = F.create_map(*[x for i, s in enumerate(runner.SOURCES) for x in (F.lit(f"src{i}"), F.lit(s))])
    return read(spark, d, "documents").select("doc_id", "lang", F.try_element_at(names, F.col("source")).alias("source")).where("source IS NOT NULL")


@query(f"SELECT source, 'train' AS split, count(*) AS n FROM {SOURCED} WHERE source IN (SELECT s FROM (VALUES {CONFIGS}) c(c, s) WHERE c = 'config_4_traindata_ccks') GROUP BY source")
def source_switch_union(spark, d):
    docs = _sourced(spark, d)
    parts = {s: docs.where(F.col("source") == s).drop("source") for s in runner.SOURCES}
    on = runner.CONFIGURATIONS["config_4_traindata_ccks"]
    return records.switched_union(parts, {s: s in on for s in runner.SOURCES}).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


COUNTED = f"SELECT c AS config, lang AS mode, count(*) AS n FROM {SOURCED} JOIN (VALUES {CONFIGS}) v(c, s) ON s = source GROUP BY c, lang"


@query(f"SELECT config, max(CASE WHEN mode = 'en' THEN n END) AS en, max(CASE WHEN mode = 'de' THEN n END) AS de FROM ({COUNTED}) GROUP BY config")
def dataset_comparison(spark, d):
    """One row per configuration of the sources, one column per language."""
    from ..operators import evaluate

    rows = runner.per_configuration(_sourced(spark, d), "source", lambda df: df.groupBy(F.col("lang").alias("mode")).agg(F.count(F.lit(1)).alias("n")), runner.CONFIGURATIONS)
    return evaluate.pivot_modes(rows, "config", "mode", "n", ["en", "de"])


@query(f"""SELECT c.config, s.name AS source, EXISTS (SELECT 1 FROM (VALUES {CONFIGS}) v(c, s) WHERE v.c = c.config AND v.s = s.name) AS enabled, n.n AS documents
FROM (SELECT DISTINCT c AS config FROM (VALUES {CONFIGS}) v(c, s)) c, (VALUES {NUMBERED}) s(i, name) JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) n ON n.source = 'src' || s.i""")
def source_switches(spark, d):
    """Every configuration's switch of every source that has documents, and how many it has."""
    counts = _sourced(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    return runner.switches(spark).join(counts, "source").select("config", "source", "enabled", "documents")


@query(f"SELECT DISTINCT item FROM (SELECT unnest({HREFS}) AS item FROM pages UNION ALL SELECT url FROM pages) WHERE item <> ''")
def images_union(spark, d):
    """Distinct items of two array columns."""
    rows = read(spark, d, "pages").select(H.hrefs(F.col("html")).alias("a"), F.array("url", F.lit(""), F.lit(None)).alias("b"))
    return records.distinct_items(rows, ["a", "b"])


@query("SELECT count(*) AS rows, count(DISTINCT url) AS links, count(DISTINCT regexp_extract(url, '^[^#?]*')) AS pages FROM pages")
def distinct_counts(spark, d):
    return read(spark, d, "pages").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("url").alias("links"), F.count_distinct(L.cut_url(F.col("url"))).alias("pages"))


@query("SELECT name FROM (SELECT n_name AS name FROM nation UNION SELECT 'NATION_0' UNION SELECT r_name FROM region)")
def type_set_union(spark, d):
    return read(spark, d, "nation").select(F.col("n_name").alias("name")).union(spark.createDataFrame([("NATION_0",)], "name string")).union(read(spark, d, "region").select("r_name")).distinct()


FIELDS = ("text", "lang", "source", "words", "toxic")
FILLED = """(SELECT count(*) AS n, count_if(trim(text) <> '') AS text, count_if(lang <> 'en') AS lang, count(source) AS source, count_if(doc_id % 5 > 1) AS words, count(toxic) AS toxic FROM documents LEFT JOIN labels USING (doc_id))"""


def _with_gaps(spark, d):
    i = F.col("doc_id")
    rows = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    words = F.when(i % 5 == 0, F.array().cast("array<string>")).when(i % 5 > 1, F.array("source"))
    return rows.withColumns({"lang": F.when(F.col("lang") == "en", " ").otherwise(F.col("lang")), "words": words})


@query(f"SELECT field, filled, n - filled AS empty, round(100.0 * filled / n, 2) AS percent FROM (UNPIVOT {FILLED} ON text, lang, source, words, toxic INTO NAME field VALUE filled)")
def field_completeness(spark, d):
    """Blank strings, empty arrays and nulls are empty."""
    return profile.completeness(_with_gaps(spark, d), FIELDS).orderBy(F.desc("percent"), "field")


@query(f"""SELECT n AS documents, (SELECT count_if(lang <> 'en' OR doc_id % 5 > 1 OR toxic IS NOT NULL) FROM documents LEFT JOIN labels USING (doc_id)) AS any, lang + words + toxic AS total FROM {FILLED}""")
def index_status(spark, d):
    out = profile.status(_with_gaps(spark, d), ["lang", "words", "toxic"])
    return out.select("documents", "any", F.aggregate(F.map_values("fields"), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT (SELECT count(*) FROM labels) AS before, (SELECT count(*) FROM documents) AS after, (SELECT count(*) FROM documents) - (SELECT count(*) FROM labels) AS added")
def count_delta(spark, d):
    return profile.count_delta(read(spark, d, "labels"), read(spark, d, "documents"))


@query("""SELECT "check", failed, failed = 0 AS passed FROM (UNPIVOT (SELECT count_if(text IS NULL OR length(text) < 20) AS long_text, count_if(coalesce(lang, '') NOT IN ('en', 'de')) AS known_lang, 0::BIGINT AS rows, (count(doc_id) - count(DISTINCT doc_id))::BIGINT AS "unique" FROM documents)
  ON long_text, known_lang, rows, "unique" INTO NAME "check" VALUE failed)""")
def quality_checks(spark, d):
    docs = read(spark, d, "documents")
    return profile.quality_checks(docs, {"long_text": F.char_length("text") >= 20, "known_lang": F.col("lang").isin("en", "de")}, key="doc_id", least_rows=100)


@query("""SELECT * FROM (VALUES (0, 'warning', 'data size'), (1, 'warning', 'extraction'), (2, 'info', 'validation'), (3, 'info', 'model')) v(place, level, category)
WHERE (SELECT count(*) FROM nation) = 25""")
def recommendations(spark, d):
    """Few rows, few of them for validation, a good model, a poor extraction."""
    facts = read(spark, d, "nation").agg(F.count(F.lit(1)).alias("train_samples"), F.lit(2).alias("dev_samples"), F.lit(0.96).alias("f1"), F.lit(5).alias("epochs"), F.lit(9).alias("tests"), F.lit(4).alias("extracted"))
    return profile.recommendations(facts)


@query("SELECT (max(o_orderkey) / 1000000.0)::DOUBLE AS f1, NULL::DOUBLE AS accuracy, 3::BIGINT AS epochs, 12.5::DOUBLE AS seconds FROM orders")
def training_log(spark, d):
    i = F.col("o_orderkey")
    line = F.when(i % 2 == 0, F.concat(F.lit("INFO {'eval_f1': "), (i / 1000000.0).cast("decimal(20,6)").cast("string"), F.lit(", 'epoch': 3.0}"))).otherwise(F.concat(F.lit("{'eval_f1': "), (i / 1000000.0).cast("decimal(20,6)").cast("string"), F.lit(", 'epoch': 2.9}")))
    lines = read(spark, d, "orders").select(line.alias("value")).unionByName(spark.createDataFrame([("{'train_runtime': 12.5}",), ("{'loss': 9}",), ("no dict",)], "value string"))
    return profile.log_summary(spark, lines)


@query("SELECT count(*) AS categories, sum(n)::BIGINT AS task, sum(m)::BIGINT AS ent FROM (SELECT count(*) AS n, min(n_nationkey) AS m FROM nation GROUP BY n_regionkey)")
def category_totals(spark, d):
    from .catalog_text import map_rows

    return profile.category_totals(map_rows(spark, d), ["task", "ent"])


@query("SELECT source, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, source))::INT AS place FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def top_sources(spark, d):
    """The first five by count, ties by name."""
    rows = read(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(5)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "source")))


# sources and sinks: tables are written in a format, read back, and must be the same
@query("SELECT doc_id, text, lang FROM documents")
def jsonl_round_trip(spark, d):
    path = scratch(spark, "jsonl")
    writers.write_jsonl(read(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return readers.jsonl(spark, path, "doc_id long, text string, lang string")


@query("SELECT 'good' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'bad', count(*) FROM region")
def jsonl_bad_lines(spark, d):
    path = scratch(spark, "lines")
    good = read(spark, d, "nation").select(F.to_json(F.struct("n_nationkey")).alias("value"))
    good.unionByName(read(spark, d, "region").select(F.concat(F.lit("{broken "), "r_name").alias("value"))).write.text(path)
    schema = "n_nationkey long"
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n(readers.jsonl(spark, path, schema), "good").unionByName(n(readers.bad_lines(spark, path, schema), "bad"))


@query("SELECT batch, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, ceil(row_number() OVER (ORDER BY o_orderkey) / 400)::INT AS batch FROM orders) GROUP BY batch")
def numbered_files(spark, d):
    path = scratch(spark, "numbered")
    writers.write_numbered(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 400, path)
    files = spark.read.json(path)
    return files.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


@query("SELECT n_name AS query, 'https://x/' || n_nationkey AS link, 'line of ' || n_name || chr(10) || 'two' AS content FROM nation")
def header_files(spark, d):
    """Texts with a commented header, a file each; blank lines vanish in the strict form."""
    path, i = scratch(spark, "texts"), F.col("n_nationkey")
    text = F.concat(F.lit("# 查询词: "), "n_name", F.lit("\n# 链接:https://x/"), i.cast("string"), F.lit("\n# ====\n\nline of "), "n_name", F.lit("\n\ntwo\n"))
    read(spark, d, "nation").select(text.alias("value"), i.alias("file")).repartition("file").write.partitionBy("file").text(path)
    return readers.header_files(spark, f"{path}/*").select("query", "link", "content")


@query(f"SELECT action, count(*) AS n FROM ({UPSERTED}) GROUP BY action")
def upsert_index(spark, d):
    """Into a table, twice: the second time nothing is created."""
    old, new = _old_and_new(spark, d)
    name = f"documents_{uuid.uuid4().hex[:8]}"
    writers.create_index(spark, name, "link long, content string, label string")
    writers.index_rows(old, name, F.col("link").isNotNull())
    out = writers.upsert_index(spark, name, new, "link", ["content"])
    spark.sql(f"DROP TABLE {name}")
    return out


@query(f"SELECT link, content, label FROM ({UPSERTED})")
def keyed_upsert(spark, d):
    """Old rows, then new ones, into a table by key whose upserts write touched buckets only; the table as it is read afterwards."""
    old, new = _old_and_new(spark, d)
    table = keyed.KeyedTable(spark, scratch(spark, "keyed"), "link long, content string, label string", "link", buckets=32)
    table.upsert(old, ["content"])
    table.upsert(new, ["content"])
    return table.read()


@query("SELECT 'page ' || p.page_id AS query, 'https://en.wikipedia.org/wiki/P' || p.page_id AS link, 't' || p.page_id AS download_time, repeat('x', 40) || p.url AS content FROM pages p WHERE length(p.url) >= 10")
def page_files(spark, d):
    """A file for each page, read back; the first half is written, then all, and names that exist stay."""
    i = F.col("page_id").cast("string")
    pages = read(spark, d, "pages").where("length(url) >= 10").select(
        "page_id", F.concat(F.lit("page "), i).alias("query"), F.concat(F.lit("https://en.wikipedia.org/wiki/P"), i).alias("link"), F.concat(F.lit("t"), i).alias("download_time"),
        F.concat(F.lit("x" * 40), "url").alias("content"))
    path = scratch(spark, "pages").removeprefix("file:")
    sink.write_page_files(pages.where("page_id % 2 = 0"), path)
    sink.write_page_files(pages, path)
    return readers.header_files(spark, path).select("query", "link", "download_time", "content")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, d):
    """The table form of the streaming count by windows."""
    out = ingest.event_counts(read(spark, d, "events"), "ts", "event_type", "1 hour", "10 minutes")
    return out.withColumn("total", F.round("total", 4))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def entity_type_topn(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("SELECT query_id, p_name, id FROM (SELECT q.p_partkey AS query_id, q.p_name, p.p_partkey AS id, row_number() OVER (PARTITION BY q.p_partkey ORDER BY p.p_partkey) AS n FROM part q JOIN part p USING (p_name) WHERE q.p_partkey % 50 = 0) WHERE n = 1")
def best_label_hit(spark, d):
    """The first of equally scored best hits on a label: a name against the names with the same words."""
    part = read(spark, d, "part").select("p_partkey", "p_name")
    asked = part.where("p_partkey % 50 = 0")
    index = lexical_index.GroupedIndex(part, "p_partkey", {"label": F.col("p_name")}, scratch(spark, "index"))
    best = index.search(asked, "p_partkey", F.col("p_name"), 1)
    return best.join(asked.select(F.col("p_partkey").alias("query_id"), "p_name"), "query_id").select("query_id", "p_name", "id")
