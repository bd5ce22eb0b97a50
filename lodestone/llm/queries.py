"""The queries of this subpackage: thin callables over the operators, with their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, filter_audit, language_id, mixing, near_dedup, packing, quality, runs, toxicity, url_filter, vectors, warc
from .common import id_crc_mod, table

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = mixing.sample_mixture(docs)
    none = lambda c: F.coalesce(c, F.lit("(none)")).alias(c)
    return out.select(
        "doc_id", none("source"), none("lang"), "mix.topic", "mix.tokens", F.round("mix.share", 6).alias("share"),
        F.round("mix.probability", 6).alias("probability"), "mix.sampled")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _labelled(spark: SparkSession, sf_dir: str, label: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Documents with their label; up to ``broadcast_rows`` labels go to the documents, so that no text is moved."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(label).alias(label))
    return docs.join(F.broadcast(labels) if labels.count() <= broadcast_rows else labels, "doc_id", "left")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_labelled(spark, sf_dir, "quality"), F.col("quality") == 1)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).drop("url")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_crc_mod(F.col("doc_id"), 3) == 1, F.lit(True))
    model = language_id.train(docs, ~held_out)
    found = language_id.predictor(spark, model)(F.col("text"))
    return docs.select("doc_id", held_out.alias("held_out"), found.alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _labelled(spark, sf_dir, "toxic")
    fold = id_crc_mod(F.col("doc_id"), 5)
    out = toxicity.score(docs, fold > 1, fold == 1, F.col("toxic"))
    held_out = F.coalesce(id_crc_mod(F.col("doc_id"), 5) == 0, F.lit(True))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def periodic_tail(text: Column, doc_id: Column) -> Column:
    """Of one document in ten (by a digest of its id) the words from one place on repeat with a period of up to a third of the rest; other texts stay."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def rewritten(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(at, " ")).otherwise("")

    return F.when(h % 10 == 0, byte_bpe.bound(filter_audit.words(F.coalesce(text, F.lit(""))), rewritten)).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic_tail(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.find_runs(docs, keep_text=False).select("doc_id", "periodic.*")
    best = runs.longest_exponent(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(byte_bpe.default_ranks())
    docs = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, byte_bpe.default_pattern())
    digest = lambda c: F.sha2(c, 256)
    out = lambda ids: F.struct(
        F.size(ids).cast("long").alias("n_tokens"), digest(F.array_join(ids.cast("array<string>"), ",").cast("binary")).alias("ids_sha256"),
        digest(byte_bpe.decode(ids, ranks)).alias("decoded_sha256"))
    return docs.select("doc_id", byte_bpe.bound(F.col("ids"), out).alias("of")).select("doc_id", "of.*")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_mix_sources": op2_mix_sources,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality": op5_quality,
    "op6_pack": op6_pack,
    "op7_url_filter": op7_url_filter,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_runs": op11_runs,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {
    "op2_mix_sources": mixing.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op10_warc": warc.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
    "op7_url_filter": r"""
WITH r(verdict, host, path) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
u AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages)
SELECT u.page_id, any_value(u.host) AS host, any_value(u.path) AS path,
       arg_max(r.host || r.path, length(r.host) + length(r.path)) AS rule,
       coalesce(arg_max(r.verdict, length(r.host) + length(r.path)), 'allow') AS verdict
FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
GROUP BY u.page_id
""",
}
