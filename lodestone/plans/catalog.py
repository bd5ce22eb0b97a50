"""Retrieval and evaluation queries over the driver's tables, each with its SQL. Importing this module registers the whole catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import evaluate, lexical_index, prompts, search, vector_index
from ..operators.lineage import cut, scratch
from . import catalog_entities, catalog_ner, catalog_records, catalog_text  # noqa: F401
from .registry import query
from .tables import STANDARD, TOKENS, read

#: Searches ask with every row whose id is divisible by this.
EVERY = 50
COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12)"


def knn_sql(k: int, every: int = EVERY) -> str:
    return f"""SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, {COS} AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % {every} = 0)) WHERE rank <= {k}"""


def asked(emb: DataFrame, every: int = EVERY) -> DataFrame:
    return emb.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _knn(spark: SparkSession, d: str, k: int = 10, every: int = EVERY) -> DataFrame:
    emb = read(spark, d, "embeddings")
    return search.knn(asked(emb, every), emb, id_col="vec_id", vector_col="embedding", k=k)


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(knn_sql(10))
def knn_topk(spark, d):
    return _rounded(_knn(spark, d))


@query(knn_sql(5, 10))
def knn_join_batch(spark, d):
    """A kNN join: a tenth of the vectors against all, in query blocks."""
    emb = read(spark, d, "embeddings")
    hits = search.fused_knn(
        asked(emb, 10), emb, id_col="vec_id", fields={"vector": F.col("embedding")}, query_fields={"vector": F.col("query")}, k=5, block=64)
    return _rounded(hits)


@query(knn_sql(10))
def knn_index_whole(spark, d):
    """The stored vector index asked for as many candidates as there are rows, built of half of them and appended to: exact."""
    emb = read(spark, d, "embeddings")
    index = vector_index.build(emb.where("vec_id % 2 = 1"), "vec_id", "embedding", scratch(spark, "vectors"))
    index.append(emb.where("vec_id % 2 = 0"), "vec_id", "embedding")
    return _rounded(index.search(asked(emb), "query_id", F.col("query"), 10, num_candidates=emb.count(), exclude_self=True))


@query()
def knn_index(spark, d):
    """The stored vector index as measured when it was built; the tests hold its recall against brute force."""
    emb = read(spark, d, "embeddings")
    index = vector_index.build(emb, "vec_id", "embedding", scratch(spark, "vectors"))
    return _rounded(index.search(asked(emb), "query_id", F.col("query"), 10, exclude_self=True))


def ranks_sql(knn: str) -> str:
    return f"""(SELECT q.vec_id AS query_id, min(CASE WHEN e.label = q.label THEN k.rank END) AS rank
  FROM embeddings q JOIN ({knn}) k ON k.query_id = q.vec_id JOIN embeddings e ON e.vec_id = k.id GROUP BY q.vec_id)"""


HIT = "round(avg(CASE WHEN rank <= {0} THEN 1.0 ELSE 0 END), 6) AS hit_{0}"
METRICS_SQL = "count(*) AS queries, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, " + ", ".join(HIT.format(k) for k in (1, 5, 10))


def _relevant(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """(query_id, rank) of the first hit with the query's label."""
    label = read(spark, d, "embeddings").select("vec_id", "label")
    both = hits.join(label.select(F.col("vec_id").alias("id"), F.col("label").alias("found")), "id")
    both = both.join(label.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return both.groupBy("query_id").agg(F.min(F.when(F.col("found") == F.col("label"), F.col("rank"))).alias("rank"))


@query(f"SELECT {METRICS_SQL} FROM {ranks_sql(knn_sql(10))}")
def mrr_hit_at_k(spark, d):
    return evaluate.ranking_metrics(_relevant(spark, d, _knn(spark, d)))


RUNNING = "round(avg({0}) OVER (ORDER BY query_id), 6) AS {1}"


@query("SELECT query_id, " + ", ".join(RUNNING.format(e, m) for e, m in (
    ("coalesce(1.0 / rank, 0)", "mrr"), *((f"CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END", f"hit_{k}") for k in (1, 5, 10)))) + f" FROM {ranks_sql(knn_sql(10))}")
def running_metrics(spark, d):
    return evaluate.running_metrics(_relevant(spark, d, _knn(spark, d)), "query_id")


HALF = "round(list_cosine_similarity(q.embedding[{0}:{1}]::DOUBLE[], e.embedding[{0}:{1}]::DOUBLE[]), 12)"


def fused_sql(k: int) -> str:
    a, b = HALF.format(1, 32), HALF.format(33, 64)
    return f"""SELECT query_id, id, round(score, 6) AS score, field, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, greatest(x, y) AS score, CASE WHEN x >= y THEN 'head' ELSE 'tail' END AS field FROM (
    SELECT q.vec_id AS query_id, e.vec_id AS id, {a} AS x, {b} AS y FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % {EVERY} = 0))) WHERE rank <= {k}"""


def _fused(spark, d, k=10):
    emb = read(spark, d, "embeddings")
    halves = lambda c: {"head": F.slice(c, 1, 32), "tail": F.slice(c, 33, 32)}
    return search.fused_knn(asked(emb), emb, id_col="vec_id", fields=halves("embedding"), query_fields=halves("query"), k=k)


@query(fused_sql(10))
def knn_fused_multifield(spark, d):
    return _fused(spark, d).select("query_id", "id", F.round("score", 6).alias("score"), "field", "rank")


MODE_SQL = f"""SELECT mode, {METRICS_SQL} FROM (
  SELECT 'whole' AS mode, rank FROM {ranks_sql(knn_sql(10))} UNION ALL SELECT 'fused', rank FROM {ranks_sql(fused_sql(10))}) GROUP BY mode"""


def _modes(spark, d):
    by = {"whole": _knn(spark, d), "fused": _fused(spark, d)}
    rows = [_relevant(spark, d, hits).withColumn("mode", F.lit(mode)) for mode, hits in by.items()]
    return evaluate.ranking_metrics(rows[0].unionByName(rows[1]), by=("mode",))


@query(MODE_SQL)
def compare_modes(spark, d):
    return _modes(spark, d)


@query(f"""SELECT 'all' AS config, max(CASE WHEN mode = 'whole' THEN mrr END) AS whole, max(CASE WHEN mode = 'fused' THEN mrr END) AS fused FROM ({MODE_SQL})""")
def pivot_modes(spark, d):
    return evaluate.pivot_modes(_modes(spark, d).withColumn("config", F.lit("all")), "config", "mode", "mrr", ["whole", "fused"])


@query(f"""WITH m AS ({MODE_SQL}), l AS (UNPIVOT m ON mrr, hit_1, hit_5, hit_10 INTO NAME metric VALUE v),
j AS (SELECT b.metric, b.v::DOUBLE AS before, a.v::DOUBLE AS after FROM l b JOIN l a USING (metric) WHERE b.mode = 'fused' AND a.mode = 'whole')
SELECT metric, before, after, round(CASE WHEN before > 0 THEN after - before ELSE after END, 6) AS absolute,
  round(CASE WHEN before > 0 THEN (after - before) / before * 100 WHEN after > 0 THEN 100 ELSE 0 END, 6) AS relative_percent, after > before AS improved FROM j""")
def compare_reports(spark, d):
    """Before: the fused fields; after: whole vectors."""
    m = _modes(spark, d)
    out = evaluate.compare_reports(m.where("mode = 'fused'"), m.where("mode = 'whole'"))
    return out.withColumns({c: F.round(c, 6) for c in ("absolute", "relative_percent")})


@query(f"""SELECT query_id, a.rank AS left_rank, b.rank AS right_rank,
  CASE WHEN coalesce(a.rank, 99) < coalesce(b.rank, 99) THEN 'left' WHEN coalesce(a.rank, 99) > coalesce(b.rank, 99) THEN 'right' ELSE 'tie' END AS winner
FROM {ranks_sql(knn_sql(10))} a JOIN {ranks_sql(fused_sql(10))} b USING (query_id)""")
def compare_indexes(spark, d):
    return evaluate.compare_sides(_relevant(spark, d, _knn(spark, d)), _relevant(spark, d, _fused(spark, d)))


def bm25_parts(table: str, id_col: str, text: str, tokens: str = STANDARD, queries: str = "SELECT item_id AS query_id, text FROM benchmark", ask: str | None = None) -> str:
    """SQL of (query_id, id, score) by BM25 on one field."""
    return rf"""(WITH d AS (SELECT {id_col} AS id, {tokens.format(text)} AS t FROM {table}),
n AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d WHERE len(t) > 0),
q AS (SELECT query_id, unnest(list_distinct({(ask or tokens).format('text')})) AS term FROM ({queries})),
p AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(t) AS length, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT query_id, id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY query_id, id)"""


def top_sql(hits: str, k: int) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {hits} QUALIFY rank <= {k})"


def _index(df: DataFrame, id_col: str, texts: dict) -> lexical_index.LexicalIndex:
    """A stored index of the given fields in a fresh shared folder."""
    return lexical_index.build(df, id_col, texts, scratch(df.sparkSession, "index"))


@query(f"SELECT query_id, id, round(score, 6) AS score FROM {bm25_parts('documents', 'doc_id', 'text')}")
def bm25_all_matches(spark, d):
    """Every benchmark item as a query against all documents; every match with its score."""
    hits = search.bm25(read(spark, d, "documents"), "doc_id", F.col("text"), read(spark, d, "benchmark"), "item_id", F.col("text"))
    return hits.select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"SELECT query_id, id, round(score, 6) AS score FROM {bm25_parts('documents', 'doc_id', 'text')}")
def bm25_match(spark, d):
    """Every benchmark item as a query against all documents; every match with its score."""
    return bm25_all_matches(spark, d)


@query(f"SELECT query_id, id, round(score, 6) AS score, rank FROM {top_sql(bm25_parts('documents', 'doc_id', 'text'), 3)}")
def bm25_appended(spark, d):
    """The same from an index that was built of half the documents and appended to."""
    docs = read(spark, d, "documents")
    index = _index(docs.where("doc_id % 2 = 0"), "doc_id", {"text": F.col("text")})
    index.append(docs.where("doc_id % 2 <> 0"), "doc_id", {"text": F.col("text")})
    return _rounded(index.search(read(spark, d, "benchmark"), "item_id", F.col("text"), 3))


CJK_TEXT = "CASE WHEN doc_id % 3 = 0 THEN '東風-' || doc_id % 7 || '導彈和' || source WHEN doc_id % 3 = 1 THEN '坦克導彈 ' || lang ELSE source || ' 東' END"
CJK_QUERIES = "(SELECT 0 AS query_id, '東風導彈' AS text UNION ALL SELECT 1, '導彈 SRC3' UNION ALL SELECT 2, '坦克')"


def _cjk(spark, d):
    i, source = F.col("doc_id"), F.col("source")
    text = F.when(i % 3 == 0, F.concat(F.lit("東風-"), (i % 7).cast("string"), F.lit("導彈和"), source)).when(
        i % 3 == 1, F.concat(F.lit("坦克導彈 "), F.col("lang"))).otherwise(F.concat(source, F.lit(" 東")))
    asked = spark.createDataFrame([(0, "東風導彈"), (1, "導彈 SRC3"), (2, "坦克")], "query_id long, text string")
    return read(spark, d, "documents").select("doc_id", text.alias("text")), asked


@query(f"SELECT query_id, id, round(score, 6) AS score FROM {bm25_parts(f'(SELECT doc_id, {CJK_TEXT} AS text FROM documents)', 'doc_id', 'text', queries='SELECT * FROM ' + CJK_QUERIES)}")
def bm25_cjk(spark, d):
    """The standard analyzer on Chinese text: single characters."""
    docs, q = _cjk(spark, d)
    return search.bm25(docs, "doc_id", F.col("text"), q, "query_id", F.col("text")).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"SELECT query_id, id, round(score, 6) AS score FROM {bm25_parts(f'(SELECT doc_id, {CJK_TEXT} AS text FROM documents)', 'doc_id', 'text', TOKENS, 'SELECT * FROM ' + CJK_QUERIES, STANDARD)}")
def bm25_two_analyzers(spark, d):
    """One field with an analyzer of its own on each side: words in the index, the standard analyzer for queries."""
    docs, q = _cjk(spark, d)
    hits = search.bm25(docs, "doc_id", F.col("text"), q, "query_id", F.col("text"), analyzer=T.tokens, search_analyzer=T.standard_tokens)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"))


# part names as labels, types and brands as aliases
PART_QUERIES = f"SELECT p_partkey AS query_id, p_name || ' ' || p_type AS text FROM part WHERE p_partkey % {EVERY} = 0"
PART_FIELDS = {"label": ("p_name", 3.0), "aliases_zh": ("p_type", 2.0), "aliases_en": ("replace(p_brand, '#', ' ')", 2.0), "content": ("p_name || ' ' || p_type", 2.0)}


def _parts(spark, d):
    part = read(spark, d, "part")
    asked = part.where(F.col("p_partkey") % EVERY == 0).select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    texts = {"label": F.col("p_name"), "aliases_zh": F.col("p_type"), "aliases_en": F.replace("p_brand", F.lit("#"), F.lit(" ")), "content": F.concat_ws(" ", "p_name", "p_type")}
    return part, asked, texts


def fields_sql(fields: dict[str, float], how: str) -> str:
    part = " UNION ALL ".join(
        f"SELECT query_id, id, score * {boost} AS score, {i} AS place, '{n}' AS field FROM {bm25_parts('part', 'p_partkey', PART_FIELDS[n][0], queries=PART_QUERIES)}" for i, (n, boost) in enumerate(fields.items()))
    return f"""(SELECT query_id, id, {how}(score) AS score, arg_max(field, round(score, 9) * 1000 - place) AS field FROM ({part}) GROUP BY query_id, id)"""


def _grouped(part: DataFrame, texts: dict) -> lexical_index.GroupedIndex:
    """A stored index of the distinct texts of parts, of which many parts share one."""
    return lexical_index.GroupedIndex(part, "p_partkey", texts, scratch(part.sparkSession, "index"))


def _searched(spark, d, boosts: dict[str, float], how: str, k: int, index: lexical_index.GroupedIndex | None = None) -> DataFrame:
    """The k best parts of each asked one, from the stored index."""
    part, asked, texts = _parts(spark, d)
    index = index or _grouped(part, texts)
    return index.search(asked, "query_id", F.col("text"), k, boosts=boosts, how=how)


def _fields(spark, d, boosts: dict[str, float], how: str) -> DataFrame:
    part, asked, texts = _parts(spark, d)
    return search.search_fields(part, "p_partkey", {n: (texts[n], b) for n, b in boosts.items()}, asked, "query_id", F.col("text"), how=how, digits=6)


SHOULD = {"label": 2.0, "aliases_zh": 2.0}
NARROW = {"label": 3.0, "aliases_zh": 2.0, "aliases_en": 2.0}
WIDE = {**NARROW, "content": 2.0}


@query(f"SELECT query_id, id, round(score, 6) AS score FROM {fields_sql(SHOULD, 'sum')}")
def bm25_bool_should(spark, d):
    return _fields(spark, d, SHOULD, "sum").drop("field")


@query(f"SELECT query_id, id, round(score, 6) AS score, field FROM {fields_sql(NARROW, 'max')}")
def bm25_multi_match_best_fields(spark, d):
    return _fields(spark, d, NARROW, "best")


@query(f"SELECT query_id, id, round(score, 6) AS score FROM {fields_sql(WIDE, 'max')}")
def bm25_best_fields_with_content(spark, d):
    return _fields(spark, d, WIDE, "best").drop("field")


def _top(hits: DataFrame, k: int) -> DataFrame:
    return search.top_k(hits.withColumn("score", F.round("score", 9)), "query_id", "score", "id", k)


@query(f"""SELECT query_id, p_name AS link, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, p_name ORDER BY rank) AS n FROM {top_sql(fields_sql(SHOULD, 'sum'), 50)} JOIN part ON p_partkey = id) WHERE n = 1""")
def search_distinct_links(spark, d):
    """Label and alias search; of hits with one link (here: the name) the best stays."""
    hits = _searched(spark, d, SHOULD, "sum", 50)
    named = hits.join(read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("link")), "id")
    return search.first_per(named.select("query_id", "link", "id", "rank"), "query_id", "link")


HYBRID_VECTOR = f"""(SELECT query_id, id, (1 + score) / 2 AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, {COS} AS score FROM embeddings q JOIN embeddings e ON true WHERE q.vec_id % {EVERY} = 0)) WHERE n <= 5)"""
HYBRID_QUERIES = f"SELECT doc_id AS query_id, text FROM documents WHERE doc_id % {EVERY} = 0"


@query(f"""WITH lex AS {bm25_parts('documents', 'doc_id', 'text', queries=HYBRID_QUERIES)}, vec AS {HYBRID_VECTOR}
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(round(coalesce(lex.score, 0), 9) + coalesce(vec.score, 0), 9) AS score FROM lex FULL JOIN vec USING (query_id, id))) WHERE rank <= 10""")
def hybrid_lexical_vector(spark, d):
    """Text scores plus the scores of each query's five nearest vectors; a query is a whole document and the vector of its number.

    A document among the ten best by the sum is one of the five, or among the fifteen best by its text.
    """
    docs, emb = read(spark, d, "documents"), read(spark, d, "embeddings")
    q = docs.where(F.col("doc_id") % EVERY == 0).select("doc_id", "text")
    index = _index(docs, "doc_id", {"text": F.col("text")})
    near = cut(search.knn(asked(emb), emb, id_col="vec_id", vector_col="embedding", k=5, exclude_self=False).select("query_id", "id", V.search_score(F.col("score")).alias("score")))
    lexical = index.search(q, "doc_id", F.col("text"), 15).select("query_id", "id", "score")
    lexical = lexical.unionByName(index.score_pairs(near, docs, "doc_id", {"text": F.col("text")}, q, "doc_id", F.col("text"))).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return _rounded(_top(search.hybrid(lexical, near, k=200).drop("rank"), 10))


# the retrieval modes: part names as entities, a part's own key as its gold id; vectors by key
def _retrieve(spark, d, mode, k=30, near=None, gold=None, gate=0.5):
    part, asked_text, texts = _parts(spark, d)
    emb = read(spark, d, "embeddings")
    near = near or (lambda n: search.knn(asked(emb), emb, id_col="vec_id", vector_col="embedding", k=n, exclude_self=False))
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    # a vector without a part of its number is a candidate without a text
    ids = emb.select(F.col("vec_id").alias("id")).unionByName(part.select(F.col("p_partkey").alias("id"))).distinct()
    options = ids.join(part, F.col("id") == F.col("p_partkey"), "left").select(
        "id", text(texts["label"]).alias("label"), F.array(texts["aliases_zh"]).alias("aliases_zh"), F.array().cast("array<string>").alias("aliases_en"),
        none.alias("descriptions_zh"), none.alias("descriptions_en"), F.concat(F.lit("https://en.wikipedia.org/wiki/Part_"), text(F.col("id"))).alias("link"))
    # an offline client that answers prompts by shared words stands in for a language model; prompts, replies and reconciling are the real ones
    again = lambda hits: prompts.rerank(hits, options, asked_text, "text", prompts.OverlapClient, scratch(spark, "replies"), pause=0.0)
    gold = gold if gold is not None else asked(emb).select("query_id", F.col("query_id").alias("id"))
    index = None if mode == "vector_only" else _grouped(part, texts)
    return search.retrieve(
        mode, vector=near, text=lambda n: _searched(spark, d, WIDE, "best", n, index), narrow_text=lambda n: _searched(spark, d, NARROW, "best", n, index),
        rerank=again, gold=gold, gate=gate, k=k)


NEAR30 = f"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, {COS} AS score FROM embeddings q JOIN embeddings e ON true WHERE q.vec_id % {EVERY} = 0) QUALIFY rank <= {{}})"""


def rerank_sql(hits: str) -> str:
    words = "list_distinct(" + STANDARD.format("text") + ")"
    return f"""SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, rank, id) AS rank FROM (
  SELECT h.query_id, h.id, h.rank, coalesce(len(list_intersect(q.w, t.w)) / len(q.w), 0) AS share FROM {hits} h
  LEFT JOIN (SELECT query_id, {words} AS w FROM ({PART_QUERIES})) q ON q.query_id = h.query_id
  LEFT JOIN (SELECT p_partkey AS id, {STANDARD.format("p_name || ' ' || p_type")} AS w FROM part) t ON t.id = h.id)"""


MODE_QUERIES = {
    "vector_only": f"SELECT query_id, id, rank FROM {NEAR30.format(30)}",
    "es_text_only": f"SELECT query_id, id, rank FROM {top_sql(fields_sql(WIDE, 'max'), 30)}",
    "llm_only": rerank_sql(top_sql(fields_sql(NARROW, "max"), 30)),
    "vector_with_llm_always": rerank_sql(NEAR30.format(30)),
    # a vector is nearest to itself, so each query's gold id is among its hits and each best score passes the gate
    "oracle_gated": rerank_sql(NEAR30.format(10)) + f" UNION ALL SELECT * FROM ({rerank_sql(top_sql(fields_sql(NARROW, 'max'), 30))}) WHERE query_id NOT IN (SELECT vec_id FROM embeddings)",
    "score_gated": rerank_sql(NEAR30.format(10)) + f" UNION ALL SELECT * FROM ({rerank_sql(top_sql(fields_sql(NARROW, 'max'), 30))}) WHERE query_id NOT IN (SELECT vec_id FROM embeddings)",
}


def _mode(mode: str, sql: str) -> None:
    query(sql, f"mode_{mode}")(lambda spark, d: _retrieve(spark, d, mode))


for _name, _sql in MODE_QUERIES.items():
    _mode(_name, _sql)


APART = f"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, {COS} AS score FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0) QUALIFY rank <= 10)"""
#: The gold id of a query that is no multiple of 100 is its second hit; other queries have one that no search finds. The gate lies among the best scores.
APART_GOLD = f"(SELECT query_id FROM {APART} WHERE rank = 2 AND query_id % {2 * EVERY} > 0)"
APART_GATE = f"(SELECT query_id FROM {APART} WHERE rank = 1 AND score >= 0.38)"


def apart_sql(sure: str) -> str:
    narrow = top_sql(fields_sql(NARROW, "max"), 30)
    return f"""WITH sure AS MATERIALIZED {sure}, a AS MATERIALIZED ({rerank_sql(APART)}), b AS MATERIALIZED ({rerank_sql(narrow)})
SELECT a.* FROM a SEMI JOIN sure USING (query_id) UNION ALL SELECT b.* FROM b ANTI JOIN sure USING (query_id)"""


def _apart(spark, d, mode):
    """Gates that differ: queries do not find themselves, gold ids and scores let different queries through."""
    emb = read(spark, d, "embeddings")
    near = cut(search.knn(asked(emb), emb, id_col="vec_id", vector_col="embedding", k=10))
    odd = F.col("query_id") % (2 * EVERY) > 0
    gold = near.where(F.col("rank") == 2).select("query_id", F.when(odd, F.col("id")).otherwise(-1).alias("id"))
    return _retrieve(spark, d, mode, near=lambda n: near.where(F.col("rank") <= n), gold=gold, gate=0.38)


@query(apart_sql(APART_GOLD))
def mode_oracle_gated_apart(spark, d):
    return _apart(spark, d, "oracle_gated")


@query(apart_sql(APART_GATE))
def mode_score_gated_apart(spark, d):
    return _apart(spark, d, "score_gated")


@query(f"""WITH h AS {top_sql(fields_sql(WIDE, 'max'), 30)}, q AS ({PART_QUERIES}),
r AS (SELECT q.query_id, min(CASE WHEN lower(g.p_name) = lower(f.p_name) THEN h.rank END) AS rank
  FROM q JOIN part g ON g.p_partkey = q.query_id LEFT JOIN h USING (query_id) LEFT JOIN part f ON f.p_partkey = h.id GROUP BY q.query_id)
SELECT {METRICS_SQL} FROM r""")
def evaluate_text_index(spark, d):
    """Text search on one index, judged by the gold link (here: the part's name as an article) in its strict form."""
    part, asked_text, _ = _parts(spark, d)
    link = F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.lower(F.replace("p_name", F.lit(" "), F.lit("%20")))).alias("link")
    hits = _searched(spark, d, WIDE, "best", 30).join(part.select(F.col("p_partkey").alias("id"), link), "id")
    gold = asked_text.select("query_id").join(part.select(F.col("p_partkey").alias("query_id"), link.alias("gold")), "query_id")
    return evaluate.ranking_metrics(evaluate.gold_ranks(hits, gold))


LINKS = "(SELECT page_id AS query_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rank, link FROM (SELECT page_id, i, CASE i WHEN 0 THEN '1. https://x.org/' || page_id || '0' WHEN 1 THEN 'link: ' || url ELSE '' END AS link FROM pages, range(3) r(i)))"


@query(rf"""WITH h AS (SELECT query_id, rank, trim(regexp_replace(regexp_replace(link, '^\d+[.)]\s*', ''), '^link:\s*', '')) AS l FROM {LINKS}), g AS (SELECT page_id AS query_id, url AS gold FROM pages)
SELECT g.query_id, min(CASE WHEN l = gold THEN rank END) AS strict, min(CASE WHEN contains(gold, l) OR contains(l, gold) THEN rank END) AS lenient FROM g JOIN h USING (query_id) GROUP BY g.query_id""")
def gold_link_ranks(spark, d):
    """First ranks by the four-way match: strict, and lenient, where an empty link matches everything."""
    pages = read(spark, d, "pages")
    found = F.array(F.concat(F.lit("1. https://x.org/"), F.col("page_id").cast("string"), F.lit("0")), F.concat(F.lit("link: "), "url"), F.lit(""))
    hits = pages.select(F.col("page_id").alias("query_id"), F.posexplode(found).alias("rank", "link")).withColumn("rank", F.col("rank") + 1)
    gold = pages.select(F.col("page_id").alias("query_id"), F.col("url").alias("gold"))
    both = [evaluate.gold_ranks(hits, gold, how).select("query_id", F.col("rank").alias(how)) for how in ("strict", "lenient")]
    return both[0].join(both[1], "query_id")


@query(f"""SELECT vec_id AS query_id, b.best AS top, c.n AS listed, round(coalesce(1.0 / r.rank, 0), 6) AS mrr FROM embeddings
  JOIN {ranks_sql(knn_sql(10))} r ON r.query_id = vec_id JOIN (SELECT query_id, id AS best FROM ({knn_sql(10)}) WHERE rank = 1) b ON b.query_id = vec_id
  JOIN (SELECT query_id, count(*) AS n FROM ({knn_sql(10)}) GROUP BY query_id) c ON c.query_id = vec_id""")
def evaluation_details(spark, d):
    """One row per query with its links found; a vector's label stands for its link."""
    label = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("L"), F.col("label").cast("string"), F.lit("!")).alias("link"))
    hits = _knn(spark, d).join(label, "id").select("query_id", "rank", "link", "id")
    gold = label.select(F.col("id").alias("query_id"), F.col("link").alias("gold")).join(hits.select("query_id").distinct(), "query_id")
    found = evaluate.details(hits, gold).join(hits.where("rank = 1").select("query_id", F.col("id").alias("top")), "query_id")
    return found.select("query_id", "top", F.size("sorted_links").cast("long").alias("listed"), F.round("mrr", 6).alias("mrr"))
