"""Queries on string, link, HTML, array, JSON and vector functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import dictionary
from ..functions import html as H
from ..functions import links as L
from ..functions import text as T
from ..functions import vector as V
from ..operators import evaluate, lexical_index, records
from ..operators.lineage import scratch
from .registry import query
from .tables import ARTICLE, TOKENS, article, normal, read


def _links(spark, d):
    return read(spark, d, "pages").select("page_id", article(F.col("page_id"), F.col("url")).alias("link"))


LINKS_SQL = f"(SELECT page_id, {ARTICLE} AS link FROM pages)"


@query(f"SELECT page_id, {normal('link', 1)} AS link FROM {LINKS_SQL}")
def normalize_url_v1(spark, d):
    return _links(spark, d).select("page_id", L.normalize_v1(F.col("link")).alias("link"))


@query(f"SELECT page_id, {normal('link', 2)} AS link FROM {LINKS_SQL}")
def normalize_url_v2(spark, d):
    return _links(spark, d).select("page_id", L.normalize_v2(F.col("link")).alias("link"))


@query(f"SELECT page_id, CASE WHEN page_id % 7 = 0 THEN NULL ELSE {normal('link', 2)} END AS title FROM {LINKS_SQL}")
def title_from_url(spark, d):
    return _links(spark, d).select("page_id", L.title_from_url(F.when(F.col("page_id") % 7 == 0, "").otherwise(F.col("link"))).alias("title"))


@query("SELECT page_id, url AS link FROM pages")
def clean_link(spark, d):
    """Every kind of prefix in front of the plain links."""
    prefixes = ["3. ", "12)", "选项2：", "选项10: ", "LINK: ", "link：", " 4. 选项1：Link: ", ""]
    chosen = F.element_at(F.array(*[F.lit(p) for p in prefixes]), (F.col("page_id") % len(prefixes) + 1).cast("int"))
    return read(spark, d, "pages").select("page_id", L.clean_link(F.concat(chosen, "url")).alias("link"))


@query(rf"""SELECT page_id, regexp_extract(link, '([^/]*)$', 1) AS last_part, nullif(regexp_extract('see ' || link || ' Q' || page_id, 'Q\d+'), '') AS qid,
  regexp_extract('see ' || link || ' or https://other.org', 'https?://[^\s]+') AS first_url,
  CASE WHEN starts_with(link, 'https://zh.wikipedia.org/wiki/') THEN 'zh' WHEN starts_with(link, 'https://en.wikipedia.org/wiki/') THEN 'en' END AS lang,
  regexp_matches(kind || link, '/(Special|Template|Help):') AS special, contains(kind || link, '/File:') AS image
FROM (SELECT *, CASE page_id % 4 WHEN 0 THEN '/Help:' WHEN 1 THEN '/File:' WHEN 2 THEN '/Special' ELSE '' END AS kind FROM {LINKS_SQL})""")
def link_parts(spark, d):
    i, link = F.col("page_id"), F.col("link")
    kind = F.when(i % 4 == 0, "/Help:").when(i % 4 == 1, "/File:").when(i % 4 == 2, "/Special").otherwise("")
    text = F.concat(F.lit("see "), link)
    return _links(spark, d).select(
        "page_id", L.entity_id(link).alias("last_part"), L.qid(F.concat(text, F.lit(" Q"), i.cast("string"))).alias("qid"),
        L.first_url(F.concat(text, F.lit(" or https://other.org"))).alias("first_url"), L.page_language(link).alias("lang"),
        L.is_special_page(F.concat(kind, link)).alias("special"), L.is_image_page(F.concat(kind, link)).alias("image"))


HREFS = """regexp_extract_all(html, '<a href="([^"]*)"', 1)"""
MARKED = f"list_transform({HREFS}, lambda h, i: CASE i % 3 WHEN 0 THEN '/wiki' || h WHEN 1 THEN '/wiki/File:' || h ELSE '/' || h END)"


@query(f"""SELECT page_id, array_to_string(list_filter(h, lambda x: starts_with(x, '/wiki/') AND NOT starts_with(x, '/wiki/File:')), ' ') AS articles,
  array_to_string(list_filter(h, lambda x: starts_with(x, '//')), ' ') AS images FROM (SELECT page_id, {MARKED} AS h FROM pages)""")
def article_hrefs(spark, d):
    marked = F.transform(H.hrefs(F.col("html")), lambda h, i: F.when((i + 1) % 3 == 0, F.concat(F.lit("/wiki"), h)).when(
        (i + 1) % 3 == 1, F.concat(F.lit("/wiki/File:"), h)).otherwise(F.concat(F.lit("/"), h)))
    pages = read(spark, d, "pages").select("page_id", marked.alias("h"))
    return pages.select("page_id", F.array_join(L.article_hrefs(F.col("h")), " ").alias("articles"), F.array_join(L.remote_images(F.col("h")), " ").alias("images"))


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(replace(replace(html, '<a href="/', '<a href="/wiki/'), '<nav>', '<img srcset="a 1x, b 2x"><nav>'), '<a href="(/wiki/[^"]*)"([^>]*)>([^<]+)</a>', '<a href="https://en.wikipedia.org\1"\2>\3</a>', 'g'),
    '\s+srcset="[^"]*"', '', 'g')) AS html, CASE page_id % 3 WHEN 0 THEN 'https://img/' WHEN 1 THEN 'https://en.wikipedia.org/i/' ELSE 'data:' END || page_id AS src,
  'https://en.wikipedia.org/wiki/ikea' || page_id AS article FROM pages""")
def absolute_links(spark, d):
    marked = F.replace("html", F.lit('<a href="/'), F.lit('<a href="/wiki/'))
    marked = F.replace(marked, F.lit("<nav>"), F.lit('<img srcset="a 1x, b 2x"><nav>'))
    i = F.col("page_id")
    src = F.concat(F.when(i % 3 == 0, "//img/").when(i % 3 == 1, "/i/").otherwise("data:"), i.cast("string"))
    return read(spark, d, "pages").select(
        "page_id", F.md5(H.strip_srcset(H.rewrite_anchors(marked)).cast("binary")).alias("html"), L.absolute_src(src).alias("src"),
        L.article_url(F.concat(F.lit("/wiki/ikea"), i.cast("string"))).alias("article"))


SAFE = r"""left(regexp_replace(regexp_replace({}, '[<>:"/\\|?*]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g'), 200)"""


@query(rf"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'unknown.txt' WHEN contains(link, 'wikipedia.org/wiki/') THEN {SAFE.format(normal('link', 2))} || '.txt'
  WHEN page_id % 2 = 0 THEN {SAFE.format("' q?: ' || page_id || '. '")} || '.txt'
  ELSE CASE WHEN p = '' THEN 'unknown.txt' ELSE {SAFE.format("regexp_extract(p, '([^/]*)$', 1)")} || '.txt' END END AS filename
FROM (SELECT *, regexp_replace(regexp_extract(trim(link), '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS p FROM {LINKS_SQL})""")
def file_names(spark, d):
    i = F.col("page_id")
    asked = F.when(i % 2 == 0, F.concat(F.lit(" q?: "), i.cast("string"), F.lit(". ")))
    link = F.when(i % 5 == 0, "").otherwise(F.trim("link"))
    return _links(spark, d).select("page_id", L.filename_from_link(link, asked).alias("filename"))


def _unescaped(text: str) -> str:
    for name, char in H.ENTITIES.items():
        text = "replace({}, '{}', '{}')".format(text, name, char.replace("'", "''"))
    return text


# full stops become ideographic ones, so that there are sentences to cut
VARIED = "replace(html, '. ', '。')"
FOUND = r"regexp_matches({0}, '(?is)<p(?:\s[^>]*)?>(.*?)</p>')"
PARAGRAPH = "CASE WHEN " + FOUND + " THEN " + _unescaped(r"regexp_replace(regexp_extract({0}, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), '<[^>]*>', '', 'g')") + " END"
STRIPPED = r"regexp_replace({}, '^[\s\x{{00a0}}\x{{3000}}]+|[\s\x{{00a0}}\x{{3000}}]+$', '', 'g')"


def _one_line(text: str) -> str:
    return STRIPPED.format(f"replace(replace({text}, chr(10), ''), chr(13), '')")


@query(f"SELECT page_id, {_one_line(PARAGRAPH.format('html'))} AS paragraph FROM pages")
def html_first_paragraph(spark, d):
    return read(spark, d, "pages").select("page_id", H.first_paragraph(F.col("html")).alias("paragraph"))


SENTENCE = f"regexp_extract({PARAGRAPH.format(VARIED)}, '^[^。？！' || chr(10) || ']*')"


@query(f"SELECT page_id, coalesce(nullif({STRIPPED.format(SENTENCE)}, ''), 'N/A') AS sentence FROM pages")
def html_first_sentence(spark, d):
    return read(spark, d, "pages").select("page_id", H.first_sentence(F.replace("html", F.lit(". "), F.lit("。"))).alias("sentence"))


TABLED = "CASE WHEN page_id % 2 = 0 THEN replace(html, '<body>', '<body><table><tr><td><p>cell</p></td></tr></table>') ELSE replace(html, '<body>', '<body><p> </p>') END"
NO_TABLES = f"regexp_replace({TABLED}, '(?is)<table.*?</table>', '', 'g')"


@query(f"SELECT page_id, CASE WHEN x = '' THEN 'none' ELSE x END AS description FROM (SELECT page_id, {_one_line(PARAGRAPH.format(NO_TABLES))} AS x FROM pages)")
def html_description(spark, d):
    html = F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit("<body>"), F.lit("<body><table><tr><td><p>cell</p></td></tr></table>"))).otherwise(
        F.replace("html", F.lit("<body>"), F.lit("<body><p> </p>")))
    return read(spark, d, "pages").select("page_id", H.description(html, F.lit("none")).alias("description"))


def _flat(html: str) -> str:
    html = f"regexp_replace({html}, '<!--.*?-->', ' ', 'gs')"
    for tag in H.HIDDEN:
        html = rf"regexp_replace({html}, '(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({html}, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"


@query(f"SELECT page_id, {_flat('html')} AS body FROM pages")
def html_to_text(spark, d):
    return read(spark, d, "pages").select("page_id", H.html_to_text(F.col("html")).alias("body"))


@query()
def html_visible_text(spark, d):
    """The tree parser's text; no SQL can follow nesting."""
    return read(spark, d, "pages").select("page_id", H.visible_text("html").alias("body"))


@query(f"SELECT page_id, unnest({HREFS}) AS href FROM pages")
def page_links_explode(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(H.hrefs(F.col("html"))).alias("href"))


@query(f"""SELECT href, count(*) AS links, min(page_id) AS first_page FROM (SELECT page_id, 'https://en.wikipedia.org' || h AS href FROM
  (SELECT page_id, unnest({HREFS}) AS h FROM pages) WHERE starts_with(h, '/')) GROUP BY href""")
def absolute_link_dedupe(spark, d):
    links = page_links_explode(spark, d).where(F.col("href").startswith("/"))
    return links.groupBy(L.absolute_src(F.col("href")).alias("href")).agg(F.count(F.lit(1)).alias("links"), F.min("page_id").alias("first_page"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, regexp_matches(text, '[\x{4e00}-\x{9fff}]') AS cjk FROM conversations")
def preprocess_query(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.preprocess_query(F.col("text")).alias("text"), T.has_cjk(F.col("text")).alias("cjk"))


@query(rf"""SELECT conv_id, turn, coalesce(length({STRIPPED.format('text')}) >= 50, false) AS long_enough, length({STRIPPED.format('text')}) > 10 AS described, left(text, 500) AS head, md5(text) AS digest,
  list_reduce(list_concat([0], list_transform(list_filter({TOKENS.format('text')}, lambda w: length(trim(w)) >= 3), lambda w: 1)), lambda a, b: a + b) AS long_words,
  coalesce(nullif(CASE WHEN turn % 2 = 0 THEN '' ELSE role END, ''), 'none') AS filled FROM conversations""")
def text_predicates(spark, d):
    t = F.col("text")
    return read(spark, d, "conversations").select(
        "conv_id", "turn", T.min_length(t, 50).alias("long_enough"), T.min_length(t, 11).alias("described"), T.head(t, 500).alias("head"), F.md5(t.cast("binary")).alias("digest"),
        F.size(A.long_words(T.tokens(t), 3)).alias("long_words"), T.first_truthy(F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("role")), default="none").alias("filled"))


@query("""SELECT p_partkey, '国家' || p_name AS label, '飞机|' || p_brand AS aliases, p_partkey % 2 = 0 AS traditional, p_partkey % 2 = 1 AS chinese FROM part""")
def simplified_chinese(spark, d):
    """Labels and alias lists turned simplified; aliases that become equal melt."""
    i = F.col("p_partkey")
    aliases = F.array(F.lit("飛機"), F.lit("飞机"), F.col("p_brand"))
    table = dict(T.SIMPLIFIED, **{"機": "机", "飛": "飞", "國": "国"})
    return read(spark, d, "part").select(
        "p_partkey", T.to_simplified(F.concat(F.lit("國家"), "p_name"), table).alias("label"), F.array_join(T.simplified_aliases(aliases, table), "|").alias("aliases"),
        T.is_traditional(F.when(i % 2 == 0, "國").otherwise("国"), table).alias("traditional"),
        T.is_chinese(F.when(i % 2 == 0, "ascii").otherwise("中"), F.lit("zh")).alias("chinese"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN round(length(split_part(p_name, ' ', 1)) / length(p_name), 6) WHEN 2 THEN 0.0 ELSE 0.0 END AS similarity,
  p_name || ' ' || p_brand AS embedded FROM part""")
def containment_similarity(spark, d):
    i, name = F.col("p_partkey"), F.col("p_name")
    other = F.when(i % 4 == 0, F.upper(name)).when(i % 4 == 1, F.upper(F.split(name, " ")[0])).when(i % 4 == 2, "").otherwise("#")
    return read(spark, d, "part").select("p_partkey", F.round(T.containment(name, other), 6).alias("similarity"), T.embedding_text(name, F.array(F.lit(""), F.col("p_brand"))).alias("embedded"))


@query("""SELECT DISTINCT '{"a":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS record FROM events""")
def canonical_json_dedupe(spark, d):
    """The same records with their keys in either order, and with spaces."""
    k = F.get_json_object("props", "$.k")
    a = F.concat(F.lit('"a": "'), "event_type", F.lit('"'))
    b = F.concat(F.lit('"k":'), k)
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("{"), a, F.lit(", "), b, F.lit("}"))).otherwise(F.concat(F.lit("{ "), b, F.lit(","), a, F.lit("}")))
    return records.distinct_json(read(spark, d, "events").select(text.alias("record")), "record")


@query("""SELECT p_partkey, trim(p_name) AS aliases_zh, p_brand AS aliases_en, 'none' AS definition, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'none' END AS described FROM part""")
def reply_fields(spark, d):
    i = F.col("p_partkey")
    reply = F.concat(F.lit("好的\n中文别名： "), "p_name", F.lit(" \n英文别名:"), "p_brand", F.lit("\n中文定义：\n\n"), F.when(i % 2 == 0, F.concat(F.lit("中文详细描述："), F.col("p_type"))).otherwise(""))
    field = lambda f, default="": T.reply_field(reply, f, default)
    return read(spark, d, "part").select(
        "p_partkey", field("中文别名").alias("aliases_zh"), field("英文别名").alias("aliases_en"), field("中文定义", "none").alias("definition"), field("中文详细描述", "none").alias("described"))


@query("""SELECT p_partkey, 'Rank the options by how well their descriptions fit the query. Source of the options: vector search.' || chr(10) || 'Query: ' || p_name || chr(10)
  || '选项1：' || chr(10) || 'label: ' || p_name || chr(10) || 'aliases_zh: ' || p_type || ', x' || chr(10) || 'aliases_en: 无' || chr(10) || 'descriptions_zh: ' || p_brand || chr(10)
  || 'descriptions_en: （无描述信息）' || chr(10) || 'link: l' || p_partkey || chr(10) || 'Answer with all 1 links, each once, one a line, best first, nothing else.' AS prompt FROM part""")
def ranking_prompts(spark, d):
    option = F.struct(
        F.col("p_name").alias("label"), F.array(F.col("p_type"), F.lit("x")).alias("aliases_zh"), A.no_strings().alias("aliases_en"), F.col("p_brand").alias("descriptions_zh"),
        F.lit("").alias("descriptions_en"), F.concat(F.lit("l"), F.col("p_partkey").cast("string")).alias("link"))
    return read(spark, d, "part").select("p_partkey", T.ranking_prompt(F.col("p_name"), F.array(option), from_vectors=True).alias("prompt"))


@query("""SELECT o_orderkey, (o_orderkey * 1234)::DOUBLE AS samples, o_orderkey::BIGINT AS done, 9::BIGINT AS total, o_orderkey % 3 = 0 AS progress FROM orders""")
def log_metrics(spark, d):
    i = F.col("o_orderkey")
    log = F.concat(F.lit("x\n训练样本数："), F.format_number(i * 1234, 0), F.lit(" 条\n成功提取实体: "), i.cast("string"), F.lit("/9\n"))
    bar = F.when(i % 3 == 0, " 12%|##  | 3/25 [00:01]").when(i % 3 == 1, " 12%|##  | 3/25 loss=0.1").otherwise("step 3/25")
    return read(spark, d, "orders").select(
        "o_orderkey", T.log_number(log, "训练样本数").alias("samples"), T.log_ratio(log, "成功提取实体")["done"].alias("done"), T.log_ratio(log, "成功提取实体")["total"].alias("total"),
        T.is_progress_line(bar).alias("progress"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, epoch(date_trunc('second', ts))::BIGINT AS epoch FROM events")
def time_stamps(spark, d):
    ts = F.col("ts")
    epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("second", ts).cast("timestamp_ntz"))
    return read(spark, d, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format(ts, "yyyyMMdd_HHmmss").alias("stamp"), epoch.alias("epoch"))


# arrays, maps, JSON
@query(rf"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_concat({TOKENS.format('text')}, [role]))), ' ') AS words FROM conversations")
def array_union_distinct(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(F.array_union(T.tokens(F.col("text")), F.array("role"))), " ").alias("words"))


@query(rf"""WITH t AS (SELECT conv_id, turn, {TOKENS.format('text')} AS t FROM conversations), w AS (SELECT conv_id, turn, word, min(i) AS i FROM (
  SELECT conv_id, turn, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM t) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM w)
SELECT conv_id, turn, coalesce(string_agg(word, ' ' ORDER BY n) FILTER (n <= 5), '') AS first_words, coalesce(string_agg(word, ' ' ORDER BY n) FILTER (n > 5), '') AS leftovers, count(word) AS counted
FROM t LEFT JOIN r USING (conv_id, turn) GROUP BY conv_id, turn""")
def ordered_distinct(spark, d):
    """Order-keeping distinct, its first items, what is left over, and the map of counts."""
    words = F.array_distinct(T.tokens(F.col("text")))
    return read(spark, d, "conversations").select(
        "conv_id", "turn", F.array_join(F.slice(words, 1, 5), " ").alias("first_words"), F.array_join(A.leftovers(words, F.slice(words, 1, 5)), " ").alias("leftovers"),
        F.aggregate(F.map_values(A.presence_counts(words)), F.lit(0), lambda s, x: s + x).cast("long").alias("counted"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || '|x' WHEN 1 THEN event_type ELSE '' END AS items, CASE WHEN event_id % 4 = 2 THEN '' ELSE event_type END AS listed FROM events""")
def scalar_to_array(spark, d):
    i, e = F.col("event_id"), F.col("event_type")
    text = F.when(i % 4 == 0, F.concat(F.lit('["'), e, F.lit('", "x"]'))).when(i % 4 == 1, F.concat(F.lit('"'), e, F.lit('"'))).when(i % 4 == 2, "").otherwise("{}")
    return read(spark, d, "events").select("event_id", F.array_join(A.list_from_json(text), "|").alias("items"), F.array_join(A.list_of(F.when(i % 4 == 2, "").otherwise(e)), "|").alias("listed"))


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total, len(embedding) = 64 AS sized FROM embeddings")
def flat_vectors(spark, d):
    flat = A.flat_vector(F.array("embedding"))
    return read(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(V.as_double(flat), F.lit(0.0), lambda s, x: s + x), 6).alias("total"), V.has_dim(flat, 64).alias("sized"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'en,zh' WHEN 1 THEN 'zh' END AS languages, CASE WHEN p_partkey % 3 < 2 THEN p_name || '|' || p_type END AS zh FROM part""")
def alias_maps(spark, d):
    i = F.col("p_partkey")
    zh, en = F.when(i % 3 < 2, F.array("p_name", "p_type")), F.when(i % 3 == 0, F.array("p_brand")).otherwise(A.no_strings())
    m = A.alias_map({"zh": zh, "en": en})
    return read(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.map_keys(m)), ",").alias("languages"), F.array_join(F.try_element_at(m, F.lit("zh")), "|").alias("zh"))


@query("""SELECT label, (row_number() OVER (ORDER BY t, o) - 1)::INT AS id FROM (SELECT '' AS t, 0 AS o, 'O' AS label UNION ALL
  SELECT event_type, o, CASE o WHEN 1 THEN 'B-' ELSE 'I-' END || event_type FROM (SELECT DISTINCT event_type FROM events), (VALUES (1), (2)) v(o))""")
def label_id_map(spark, d):
    return A.label_ids(read(spark, d, "events"), "event_type")


@query("""SELECT 'r' || n_regionkey AS key, count(*)::INT AS task, min(n_nationkey)::INT AS ent FROM nation GROUP BY n_regionkey""")
def map_rows(spark, d):
    """A JSON object of objects as rows."""
    each = read(spark, d, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("task"), F.min("n_nationkey").alias("ent"))
    item = F.concat(F.lit('"r'), F.col("n_regionkey").cast("string"), F.lit('": '), F.to_json(F.struct("task", "ent")))
    one = each.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(item)), ", "), F.lit("}")).alias("text"))
    return A.map_rows(one, "text", "struct<task:int,ent:int>")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, 'Q' || event_id AS item, event_type AS label FROM events")
def nested_json(spark, d):
    """Parsing, nested ``.value`` access and serialising again."""
    text = F.to_json(F.struct(F.struct(F.concat(F.lit("http://e/Q"), F.col("event_id").cast("string")).alias("value")).alias("item"), F.struct(F.col("event_type").alias("value")).alias("itemLabel")))
    parsed = F.from_json(text, "item struct<value:string>, itemLabel struct<value:string>")
    return read(spark, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), L.entity_id(parsed["item"]["value"]).alias("item"), parsed["itemLabel"]["value"].alias("label"))


# vectors
NORM = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"
V64 = "embedding::DOUBLE[]"


@query(f"""SELECT vec_id, pos, round(x / n, 6) AS value FROM (SELECT vec_id, unnest({V64}) AS x, generate_subscripts(embedding, 1) - 1 AS pos, {NORM.format(V64)} AS n FROM embeddings WHERE vec_id % 5 > 0)
UNION ALL SELECT vec_id, NULL, NULL FROM embeddings WHERE vec_id % 5 = 0""")
def vector_l2_normalize(spark, d):
    """All components; every fifth vector is turned into zeros and has no direction."""
    v = F.when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.transform("embedding", lambda x: x * 1))
    return read(spark, d, "embeddings").select("vec_id", F.posexplode_outer(V.l2_normalize(v)).alias("pos", "value")).withColumn("value", F.round("value", 6))


CUT16 = "embedding[1:16]::DOUBLE[]"


@query(f"""SELECT vec_id, 'cut' AS kind, generate_subscripts(embedding[1:16], 1) - 1 AS pos, round(unnest({CUT16}) / {NORM.format(CUT16)}, 6) AS value FROM embeddings
UNION ALL SELECT vec_id, 'padded', p, round(coalesce(({V64})[p + 1], 0), 6) FROM embeddings, range(70) r(p)""")
def vector_pad_truncate(spark, d):
    v = F.col("embedding")
    both = F.explode(F.array(F.struct(F.lit("cut").alias("kind"), V.fit_dim(v, 16).alias("v")), F.struct(F.lit("padded").alias("kind"), V.fit_dim(v, 70).alias("v"))))
    rows = read(spark, d, "embeddings").select("vec_id", both.alias("b")).select("vec_id", "b.kind", F.posexplode("b.v").alias("pos", "value"))
    return rows.withColumn("value", F.round("value", 6))


@query("""SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine,
  round((1 + list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_scores(spark, d):
    emb = read(spark, d, "embeddings")
    # lengths must not matter
    longer = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") * 3).alias("next"))
    cos = V.cosine(F.col("embedding"), F.col("next"))
    return emb.join(longer, "vec_id").select("vec_id", F.round(cos, 6).alias("cosine"), F.round(V.search_score(cos), 6).alias("score"))


def _merge(how: str) -> None:
    sql = f"""SELECT label, pos, round({how}(x), 6) AS value FROM (
      SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos"""

    def run(spark, d):
        return V.merge(read(spark, d, "embeddings"), "label", "embedding", getattr(F, how)).select("label", "pos", F.round("value", 6).alias("value"))

    query(sql, f"vector_merge_{'mean' if how == 'avg' else how}")(run)


for _how in ("avg", "max", "sum"):
    _merge(_how)


@query("""WITH m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos)
SELECT label, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS value FROM m""")
def vector_merge_unit(spark, d):
    merged = V.merged_unit(read(spark, d, "embeddings"), "label", "embedding")
    return merged.select("label", F.posexplode("vector").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("""SELECT vec_id, round(x / n, 6) AS first, round(y / n, 6) AS second FROM (SELECT *, sqrt(x * x + y * y) AS n FROM (
  SELECT vec_id, embedding[1]::DOUBLE + embedding[3]::DOUBLE AS x, embedding[2]::DOUBLE + embedding[4]::DOUBLE AS y FROM embeddings))""")
def vector_merge_list(spark, d):
    v = V.merge_list(F.array(F.slice("embedding", 1, 2), F.slice("embedding", 3, 2)))
    return read(spark, d, "embeddings").select("vec_id", F.round(v[0], 6).alias("first"), F.round(v[1], 6).alias("second"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:5]::DOUBLE[], lambda x: exp(x)) AS e FROM embeddings), p AS (
  SELECT vec_id, unnest([e[1] + e[2], e[3] + e[4], e[5]]) / list_sum(e) AS p, unnest(['A', 'B', 'C']) AS g FROM e)
SELECT vec_id, arg_max(g, p) AS likeliest, round(max(p), 6) AS p FROM p GROUP BY vec_id""")
def group_probabilities(spark, d):
    best = evaluate.group_probabilities(V.as_double(F.slice("embedding", 1, 5)), ["A", "A", "B", "B", "C"])[0]
    return read(spark, d, "embeddings").select("vec_id", best["group"].alias("likeliest"), F.round(best["p"], 6).alias("p"))


@query("""SELECT label, round(100.0 * count(*) / (SELECT count(*) FROM embeddings), 6) AS percent,
  round(CASE WHEN label > 0 THEN (5.0 - label) / label * 100 ELSE 100 END, 6) AS improvement FROM embeddings GROUP BY label""")
def rates(spark, d):
    """Shares with a guard against nothing, and relative improvements, also from zero."""
    emb = read(spark, d, "embeddings")
    total = emb.agg(F.count(F.lit(1)).alias("n"))
    each = emb.groupBy("label").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(total))
    better = evaluate.relative_improvement(F.col("label").cast("double"), F.lit(5.0))
    return each.select("label", F.round(F.coalesce(F.try_divide(F.col("c") * 100.0, "n"), F.lit(0.0)), 6).alias("percent"), F.round(better, 6).alias("improvement"))


#: Letters without spaces between words, for texts that have lost theirs.
LETTERS = r"[^\W\d_]+"


def _spaceless(spark, d):
    """Whole documents and benchmark items in lower case without white space, and the words of the items with their counts as dictionary."""
    joined = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    items = read(spark, d, "benchmark")
    words = items.select(F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    docs = read(spark, d, "documents").select("doc_id", joined("text").alias("text"))
    return docs, items.select("item_id", joined("text").alias("text")), words


@query()
def word_segmentation(spark, d):
    """Index and search side of dictionary segmentation on whole texts that have lost their spaces. The tests hold it against plain loops."""
    docs, _, words = _spaceless(spark, d)
    sides = {side: dictionary.segmenter(words, side, script=LETTERS)(F.col("text")) for side in ("index", "search")}
    found = docs.select("doc_id", *[c.alias(side) for side, c in sides.items()])
    return found.select("doc_id", *[x for side in sides for x in (F.size(side).alias(f"{side}_words"), F.md5(F.array_join(side, " ")).alias(f"{side}_md5"))])


@query()
def bm25_segmented(spark, d):
    """Items without spaces searched in documents without spaces: all dictionary words in the index, the best path in the query."""
    docs, items, words = _spaceless(spark, d)
    both = {side: dictionary.segmenter(words, side, script=LETTERS) for side in ("index", "search")}
    index = lexical_index.build(docs, "doc_id", {"text": F.col("text")}, scratch(spark, "index"), analyzers={"text": both["index"]})
    hits = index.search(items, "item_id", F.col("text"), 10, search_analyzers={"text": both["search"]})
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query()
def phrase_conversion(spark, d):
    """Whole documents with the benchmark's word pairs and some letters converted, pairs first. The tests hold it against a plain loop."""
    words = T.tokens(F.col("text"))
    pairs = read(spark, d, "benchmark").select(F.explode(F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))).alias("source"))
    table = pairs.where("source IS NOT NULL").distinct().select("source", F.upper("source").alias("target"))
    table = table.unionByName(spark.createDataFrame([("e", "3"), ("th", "þ"), (" ", "_")], "source string, target string"))
    return read(spark, d, "documents").select("doc_id", F.md5(F.coalesce(dictionary.converter(table)(F.col("text")), F.lit(""))).alias("converted_md5"))
