"""Quality classifier: perplexity under a Kneser-Ney model of trusted text, by language.

Trusted are the rows of ``trusted``. Documents fall in two halves by a checksum of their id; each half's trusted
text is a model of its own and judges the other half, so no document is judged by counts that it is part of. A
document passes if its perplexity per token is at most the ``quantile`` of its language's trusted
documents; a language without any takes the quantile of all its documents.

Defined results: a null or wordless text has no perplexity and fails; null language is a group of its
own, a null id is in the first half; without trusted text nobody has a perplexity and every text with words passes;
where only one half has trusted text, its model judges all. A perplexity at the threshold passes. Rows that repeat
an id share the perplexity of their texts together. Texts of any length count in whole. Extra columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kneser_ney
from .common import cut, id_crc_mod


def classify(docs: DataFrame, trusted: Column, *, quantile: float = 0.95, accuracy: int = 10_000) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) per row of ``docs`` (doc_id, text, lang)."""
    has_words = F.coalesce(F.col("text").rlike(r"(?U)\w"), F.lit(False))
    good = F.coalesce(trusted & has_words, F.lit(False))
    half = F.coalesce(id_crc_mod(F.col("doc_id"), 2), F.lit(0)).cast("long")
    model, judge = kneser_ney.train(docs, [good & (half == 0), good & (half == 1)]), 1 - half
    if model is None:
        model, judge = kneser_ney.train(docs, [good]), F.lit(0)
    if model is None:
        return docs.select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), has_words.alias("kept"))
    scored = kneser_ney.score(docs, model, judge)
    rows = docs.select("doc_id", "lang", has_words.alias("has_words"), good.alias("good"))
    rows = rows.join(scored, F.col("doc_id").eqNullSafe(F.col("doc")), "left").select(
        "doc_id", "lang", F.when(F.col("has_words"), F.round(F.exp(-F.col("total") / F.col("words")), 6)).alias("perplexity"), "good")
    rows = cut(rows)
    limit = lambda x: F.percentile_approx(x, quantile, accuracy)
    limits = rows.groupBy(F.col("lang").alias("of")).agg(
        F.coalesce(limit(F.when(F.col("good"), F.col("perplexity"))), limit(F.col("perplexity"))).alias("threshold"))
    return rows.join(F.broadcast(limits) if limits.count() <= 100_000 else limits, F.col("lang").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "lang", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
