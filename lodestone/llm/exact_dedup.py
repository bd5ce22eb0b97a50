"""Exact deduplication by content-defined chunk recipes.

A text is normalised (every character of ``[\\x20\\x09-\\x0D]`` deleted) and cut into chunks whose
ends depend on the content around them only. Each distinct chunk is stored once under its SHA-256
and the contents stored under one digest are compared, so a digest counts as an identifier only
after it was verified. A document is then the ordered list of its chunk identifiers, its recipe,
and only recipes are grouped and moved: a long document crosses the network once, as chunks that
each task has deduplicated already. A document with an unverified digest (there is none, unless
SHA-256 breaks) has its chunks' contents in its recipe as well.

Everything is DataFrame and SQL expressions. Groups are never gathered: a group is one aggregate
row (count and best copy), so a group that holds a third of all rows costs one row per task.

Defined results: null text counts as empty; all empty texts are one group. Of equal texts the
row with the most code points in the original, then the smallest doc_id stays (a null id only if
there is no other). A row is kept if it has that id and that length, so of two rows of one id the longer
one is. Rows that repeat id and text: ``find_copies`` has a line for each, all alike, and ``deduplicate`` keeps
one. ``find_copies`` ignores extra columns, ``deduplicate`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: A chunk has at least MIN_CHUNK characters and ends after the next cut mark, or at MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 1024, 8192
CUT_MARKS = r"[.!?;,:|。，、؟।]"
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?{CUT_MARKS}|.{{1,{MAX_CHUNK}}}"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for code in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
        out = F.replace(out, F.lit(chr(code)), F.lit(""))
    return out


def chunks_of(norm: Column) -> Column:
    """The chunks in order; their concatenation is the text. Short texts need no regular expression."""
    return F.when(F.char_length(norm) <= MIN_CHUNK, F.array(norm)).otherwise(
        F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0)))


def digest(chunk: Column) -> Column:
    return F.sha2(chunk.cast("binary"), 256)


def unverified(docs: DataFrame) -> DataFrame:
    """Digests under which different chunk contents were stored."""
    chunk = docs.select(F.explode(chunks_of(normalised(F.col("text")))).alias("chunk"))
    stored = chunk.groupBy(F.unhex(digest(F.col("chunk"))).alias("id")).agg(
        F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    return stored.where("lo <> hi").select(F.lower(F.hex("id")).alias("id"))


def recipe(norm: Column, bad: Column) -> Column:
    """The ordered identifier list as text; ``bad``: array of unverified digests."""
    chunks = chunks_of(norm)
    ids = F.transform(chunks, digest)
    return F.concat(
        F.array_join(ids, ""),
        F.when(F.arrays_overlap(ids, bad), F.concat(F.lit("="), norm)).otherwise(""))


def keyed(docs: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """``docs`` with its original length, the digest of its normalised text, and its recipe."""
    n, sha, key = names
    bad = unverified(docs).agg(F.collect_list("id")).scalar()
    norm = normalised(F.col("text"))
    return docs.select(
        "*", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias(n), digest(norm).alias(sha),
        recipe(norm, bad).alias(key))


def best_copies(rows: DataFrame, n: str, key: str) -> DataFrame:
    """(key, keep_n, keep_id, group_size), aggregated before and after the shuffle."""
    best = F.max(F.struct(F.col(n).alias("n"), (-F.col("doc_id")).alias("i"))).alias("best")
    groups = rows.groupBy(F.col(key).alias("of")).agg(best, F.count(F.lit(1)).alias("group_size"))
    return groups.select("of", F.col("best.n").alias("keep_n"), (-F.col("best.i")).alias("keep_id"), "group_size")


def find_copies(docs: DataFrame) -> DataFrame:
    """One line per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(keyed(docs.select("doc_id", "text"), ("n", "sha", "key")).drop("text"))
    groups = best_copies(rows, "n", "key")
    return rows.join(groups, rows["key"] == groups["of"]).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))).alias("kept"),
        F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, *, broadcast_ids: int = 2_000_000) -> DataFrame:
    """``docs`` with one row of each group of equal texts.

    Only recipes are moved where ids are unique: the ids of the rows that go then meet the documents where
    these lie (up to ``broadcast_ids`` of them; beyond, in a join by id).
    """
    found = cut(find_copies(docs).select("doc_id", "kept"))
    ids = found.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.count_distinct("doc_id").alias("ids"), F.count_if(~F.col("kept")).alias("gone")).first()
    if ids["n"] == ids["known"] == ids["ids"]:
        gone, = fresh(docs, "gone")
        drop = found.where("NOT kept").select(F.col("doc_id").alias(gone))
        return docs.join(F.broadcast(drop) if ids["gone"] <= broadcast_ids else drop, F.col("doc_id") == F.col(gone), "left_anti")
    return deduplicate_rows(docs)


def deduplicate_rows(docs: DataFrame) -> DataFrame:
    """As ``deduplicate``, for ids that are null or repeat: rows are told apart by recipe, id and length."""
    n, sha, key = fresh(docs, "n", "sha", "key")
    groups = best_copies(keyed(docs.select("doc_id", "text"), (n, sha, key)), n, key)
    o, kn, ki, gs = fresh(docs.withColumns({c: F.lit(0) for c in (n, sha, key)}), "of", "keep_n", "keep_id", "group_size")
    groups = groups.select(F.col("of").alias(o), F.col("keep_n").alias(kn), F.col("keep_id").alias(ki))
    rows = keyed(docs, (n, sha, key))
    # joined by recipe and id: the copies of a hot group meet in as many tasks as there are ids
    kept = rows.join(groups, (F.col(key) == F.col(o)) & F.col("doc_id").eqNullSafe(F.col(ki)) & (F.col(n) == F.col(kn)), "left_semi")
    return kept.dropDuplicates([key, "doc_id", n]).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
       text_sha256
FROM d
"""
