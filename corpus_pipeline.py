"""The corpus pipeline: language ID, exact dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept and is written as
Parquet in the shared folder before the next one reads it, so a lost executor never repeats more
than one stage. All stages but the last keep the columns of ``documents``, extra ones included.

Defined results: a null text, or one without letters, is in no language and goes in the first stage, so later stages see none. Null ids,
sources and languages stay. Rows that repeat an id are judged row by row up to mixing, which keeps or drops all rows of an id together; rows that
repeat id and text are one document. Ties: of exact copies the longest original stays, then the smallest id, of near copies the smallest id. Texts
of any length are read in whole. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, language_id, mixing, near_dedup, packing
from lodestone.llm.common import fresh, scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language (null, or without letters) go; where none could be learned, all texts with letters are of one."""
    found, = fresh(docs, "found")
    model = language_id.train(docs)
    if not model.langs:
        model = language_id.fit(["a"], ["any"])
    judged = docs.withColumn(found, language_id.predictor(spark, model)(F.col("text")))
    return judged.where(F.col(f"{found}.lang") != "und").drop(found)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.sample_mixture(docs)
    mix = mixed.columns[-1]
    return mixed.where(F.col(f"{mix}.sampled")).drop(mix)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("packing", pack_windows),
]

#: Language ID, near dedup and packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
