"""Queries on annotations, each with its SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dictionary
from ..functions import text as T
from ..operators import annotation, assembly, evaluate, models, profile
from .registry import query
from .tables import TOKENS, read

KIND = "CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 'NUM' WHEN length(token) >= 9 THEN 'LONG' END"
BIO_SQL = rf"""SELECT doc_id, pos, CASE WHEN kind IS NULL THEN 'O' WHEN kind = lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) THEN 'I-' || kind ELSE 'B-' || kind END AS tag
FROM (SELECT doc_id, pos, {KIND} AS kind FROM (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)))"""


def _tagged(spark, d):
    kind = lambda w: F.when(w.rlike("^[0-9]+$"), "NUM").when(F.char_length(w) >= 9, "LONG")
    kinds = read(spark, d, "documents").select("doc_id", F.transform(T.tokens(F.col("text")), kind).alias("kinds"))
    return kinds.select("doc_id", annotation.encode_kinds(F.col("kinds")).alias("tags"))


@query(BIO_SQL)
def bio_encode(spark, d):
    """Tags by the kind of each word."""
    return _tagged(spark, d).select("doc_id", F.posexplode("tags").alias("pos", "tag"))


# damaged tags: every fifth is O, every seventh inside tag changes its type
DAMAGED = f"""SELECT doc_id, pos, CASE WHEN pos % 5 = 4 THEN 'O' WHEN pos % 7 = 3 AND tag LIKE 'I-%' THEN 'I-X' ELSE tag END AS tag FROM ({BIO_SQL})"""


@query(f"""SELECT doc_id, min(pos)::INT AS start, count(*)::INT AS length, any_value(kind) AS type FROM (
  SELECT *, sum(CASE WHEN stops THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (
    SELECT doc_id, pos, tag, substr(tag, 3) AS kind, NOT coalesce(tag LIKE 'I-%' AND substr(lag(tag) OVER w, 3) = substr(tag, 3) AND lag(tag) OVER w <> 'O', false) AS stops FROM ({DAMAGED}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)))
GROUP BY doc_id, run HAVING bool_or(tag LIKE 'B-%' AND stops) AND count(*) >= 2""")
def bio_decode(spark, d):
    """Entities of at least two tags; stray inside tags and changes of type end them."""
    spoilt = F.transform("tags", lambda t, i: F.when(i % 5 == 4, "O").when((i % 7 == 3) & t.startswith("I-"), "I-X").otherwise(t))
    rows = _tagged(spark, d).select("doc_id", spoilt.alias("tags"))
    return rows.select("doc_id", F.explode(annotation.decode(F.col("tags"))).alias("e")).select("doc_id", "e.start", "e.length", "e.type")


SPANS = "[(0, 4, 'T'), (2, 6, 'U'), (length(text) - 2, length(text), ''), (5, 99, 'V'), (3, 3, 'W')]"


@query("""SELECT p_partkey, pos::INT AS pos, CASE WHEN pos >= n - 2 THEN CASE pos - (n - 2) WHEN 0 THEN 'B-' ELSE 'I-' END || 'ENTITY'
  WHEN pos BETWEEN 2 AND 5 THEN CASE pos WHEN 2 THEN 'B-' ELSE 'I-' END || 'U' WHEN pos < 2 THEN CASE pos WHEN 0 THEN 'B-' ELSE 'I-' END || 'T' ELSE 'O' END AS tag
FROM (SELECT p_partkey, length(p_name) AS n FROM part WHERE length(p_name) >= 6), range(200) r(pos) WHERE pos < n""")
def bio_encode_spans(spark, d):
    """Characters tagged by spans: later ones overwrite, without a type they are entities, those that don't fit are ignored."""
    name = F.col("p_name")
    n = F.char_length(name)
    span = lambda a, b, t: F.struct(F.lit(a).cast("int").alias("start") if isinstance(a, int) else a.alias("start"), F.lit(b).alias("end") if isinstance(b, int) else b.alias("end"), F.lit(t).alias("type"))
    spans = F.array(span(0, 4, "T"), span(2, 6, "U"), span(n - 2, n, ""), span(5, 99, "V"), span(3, 3, "W"))
    rows = read(spark, d, "part").where(n >= 6)
    return rows.select("p_partkey", F.posexplode(annotation.encode_spans(name, spans)).alias("pos", "tag"))


@query(f"""SELECT count(*) AS samples, sum(len(list_filter(t, lambda x: starts_with(x, 'B-'))))::BIGINT AS entities, round(avg(len(list_filter(t, lambda x: starts_with(x, 'B-')))), 6) AS per_sample,
  (SELECT count(DISTINCT substr(tag, 3)) FROM ({BIO_SQL}) WHERE tag <> 'O') AS entity_types
FROM documents LEFT JOIN (SELECT doc_id, list(tag) AS t FROM ({BIO_SQL}) GROUP BY doc_id) USING (doc_id)""")
def ner_statistics(spark, d):
    out = annotation.statistics(_tagged(spark, d), "tags")
    return out.select("samples", "entities", F.round("per_sample", 6).alias("per_sample"), "entity_types")


@query(f"SELECT substr(tag, 3) AS type, count(*) AS mentions FROM ({BIO_SQL}) WHERE tag LIKE 'B-%' GROUP BY 1 ORDER BY mentions DESC, type LIMIT 10")
def entity_mentions(spark, d):
    return annotation.type_counts(_tagged(spark, d), "tags")


@query(f"SELECT kept, count(*) AS n FROM (SELECT 'labelled' AS kept FROM documents) GROUP BY kept")
def usable_validation(spark, d):
    """A labelled set stays, an unlabelled one goes as a whole."""
    rows = _tagged(spark, d)
    none = rows.withColumn("tags", F.transform("tags", lambda t: F.lit("O")))
    part = lambda df, name: annotation.usable_validation(df, "tags").select(F.lit(name).alias("kept"))
    return part(rows, "labelled").unionByName(part(none, "unlabelled")).groupBy("kept").agg(F.count(F.lit(1)).alias("n"))


NAMES = {"widget": "THING", "ring": "THING", "red": "COLOUR", "green": "COLOUR"}
HELD = "list_filter(list_distinct(string_split(p_name, ' ')), lambda w: w IN ('widget', 'ring', 'red', 'green'))"


def _entity_words(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("descriptions_zh"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("descriptions_en"))
    return assembly.entity_words(rows, models.tag(lambda: models.Gazetteer({f" {k}"[1:]: v for k, v in NAMES.items()})), zh_min=2, en_min=4)


@query(f"""SELECT p_partkey, array_to_string(list_sort({HELD}), ' ') AS zh, CASE WHEN p_partkey % 2 = 0 THEN array_to_string(list_sort(list_filter({HELD}, lambda w: length(w) >= 4)), ' ') ELSE '' END AS en,
  len({HELD})::INT AS zh_count FROM part""")
def entity_words(spark, d):
    """Names of a gazetteer in both descriptions; English ones need four letters here."""
    out = _entity_words(spark, d)
    return out.select("p_partkey", *[F.array_join(F.array_sort(f"entity_words_{x}"), " ").alias(x) for x in ("zh", "en")], F.size("entity_freq_zh").alias("zh_count"))


@query(f"""SELECT count(*) AS records, count_if(len({HELD}) > 0) AS with_zh, count_if(p_partkey % 2 = 0 AND len(list_filter({HELD}, lambda w: length(w) >= 4)) > 0) AS with_en, count_if(len({HELD}) > 0) AS with_any,
  round(avg(len({HELD})), 6) AS mean_zh, round(avg(CASE WHEN p_partkey % 2 = 0 THEN len(list_filter({HELD}, lambda w: length(w) >= 4)) ELSE 0 END), 6) AS mean_en FROM part""")
def word_coverage(spark, d):
    return profile.word_coverage(_entity_words(spark, d), "entity_words_zh", "entity_words_en")


@query(f"SELECT p_partkey, len({HELD}) AS words FROM part WHERE len({HELD}) > 0 ORDER BY words DESC, p_partkey LIMIT 5")
def most_entity_words(spark, d):
    rows = _entity_words(spark, d).select("p_partkey", F.col("entity_count_zh").cast("long").alias("words")).where("words > 0")
    return rows.orderBy(F.desc("words"), "p_partkey").limit(5)


@query("""WITH l AS (SELECT quality * 2 + (doc_id % 2) AS t, toxic * 2 + (doc_id % 2) AS p FROM labels WHERE doc_id % 9 > 0),
s AS (SELECT t AS label, count(*) AS support, count_if(t = p) AS tp FROM l GROUP BY t), g AS (SELECT p AS label, count(*) AS guessed FROM l GROUP BY p),
e AS (SELECT support, tp, coalesce(tp / guessed, 0) AS p, tp / support AS r FROM s LEFT JOIN g USING (label))
SELECT sum(support)::BIGINT AS support, round(sum(tp) / sum(support), 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS precision, round(sum(r * support) / sum(support), 6) AS recall,
  round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * support) / sum(support), 6) AS f1 FROM e""")
def classification_metrics(spark, d):
    """Several classes, weighted by support; masked rows (-100) don't count."""
    side = F.col("doc_id") % 2
    truth = F.when(F.col("doc_id") % 9 == 0, -100).otherwise(F.col("quality") * 2 + side)
    out = evaluate.weighted_metrics(read(spark, d, "labels"), truth, F.col("toxic") * 2 + side)
    return out.select("support", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(None)
def token_tags(spark, d):
    """Character tags carried over to all words, found again in the whole text. The greedy search has no SQL form; the tests hold it against a plain loop."""
    rows = read(spark, d, "documents").where("text <> ''")
    tags = F.transform(F.sequence(F.lit(0), F.char_length("text") - 1), lambda i: F.concat(F.when(i % 3 == 0, "B-").otherwise("I-"), (i % 11).cast("string")))
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    return rows.select("doc_id", F.array_join(annotation.token_tags(words, F.col("text"), tags), " ").alias("tags"))


@query()
def subword_entities(spark, d):
    """Kinds of words carried over to sub-word pieces of whole texts and decoded from these. The tests hold it against plain loops.

    The vocabulary is the benchmark's words, all single letters of them, and both as continuations.
    """
    words = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("piece"))
    words = words.union(words.select(F.explode(F.split("piece", "")))).distinct()
    pieces = dictionary.wordpieces(words.union(words.select(F.concat(F.lit("##"), "piece"))))
    rows = read(spark, d, "documents").where("text <> ''").select("doc_id", "text", pieces(F.col("text")).alias("tokens"))
    # a character's kind goes by its place: stretches of seven of which the last is none
    tags = F.transform(F.sequence(F.lit(0), F.char_length("text") - 1), lambda i: F.when(i % 7 == 6, "O").when(i % 7 == 0, "B-A").otherwise("I-A"))
    rows = rows.withColumn("tags", annotation.token_tags(F.col("tokens"), F.col("text"), tags))
    found = annotation.decode(F.col("tags"), 2, F.col("tokens"))
    return rows.select("doc_id", F.size("tokens").alias("pieces"), F.md5(F.array_join("tokens", " ")).alias("pieces_md5"), F.size(found).alias("entities"), F.md5(F.to_json(found)).alias("entities_md5"))
