"""Writers: JSON lines, numbered files, tables as indexes, upserts, reports. Paths go through the file system that their URI names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions import text as X
from ..operators.records import batches, upsert_rows


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, path_of = _fs(spark, path)
    return fs.exists(path_of(path))


def write_jsonl(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """JSON lines in UTF-8, null fields kept; ``append`` adds files, so a second run adds its rows again."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def swap(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Replaces the folder ``path`` by what ``write`` puts into a staging folder: readers see the old content until the new is complete."""
    fs, path_of = _fs(spark, path)
    stage, old = f"{path}.stage-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    write(stage)
    if fs.exists(path_of(path)):
        fs.rename(path_of(path), path_of(old))
    fs.rename(path_of(stage), path_of(path))
    fs.delete(path_of(old), True)
    spark.catalog.refreshByPath(path)


def rewrite(spark: SparkSession, path: str, schema: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Rewrites a folder of JSON lines through ``change``."""
    from .readers import jsonl

    swap(spark, path, lambda stage: write_jsonl(change(jsonl(spark, path, schema)), stage))


def write_numbered(df: DataFrame, order: str, size: int, path: str) -> None:
    """One folder ``batch=i`` per ``size`` rows in ``order``, one file each."""
    batches(df, order, size).repartition("batch").sortWithinPartitions("batch", order).write.mode("overwrite").partitionBy("batch").json(path)


def concat_files(spark: SparkSession, folder: str, path: str, glob: str = "*.jsonl") -> None:
    """The non-blank lines of all files of a folder as one file. One file is one writer: for outputs of that size only."""
    spark.read.option("pathGlobFilter", glob).text(folder).where("trim(value) <> ''").coalesce(1).write.mode("overwrite").text(path)


def collapse(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """(json): one JSON object that holds a column's values as one sorted array. The whole column is one value, as the format demands."""
    whole = F.coalesce(F.array_sort(F.collect_list(column)), F.array().cast("array<string>"))
    return df.agg(F.to_json(F.struct(whole.alias(name or column))).alias("json"))


def create_index(spark: SparkSession, name: str, schema: str) -> None:
    """An empty table of the declared schema, whatever was there before."""
    spark.createDataFrame([], schema).write.mode("overwrite").saveAsTable(name)


def index_rows(df: DataFrame, name: str, valid: Column, *, rejects: str | None = None) -> DataFrame:
    """Appends the valid rows to a table and the others to ``rejects``; returns (action, n)."""
    columns = df.sparkSession.table(name).columns
    judged = df.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    counts = judged.groupBy(F.when(F.col("_ok"), "indexed").otherwise("rejected").alias("action")).agg(F.count(F.lit(1)).alias("n"))
    done = df.sparkSession.createDataFrame(counts.collect(), "action string, n long")
    judged.where("_ok").select(*columns).write.mode("append").saveAsTable(name)
    if rejects is not None:
        judged.where("NOT _ok").drop("_ok").write.mode("append").saveAsTable(rejects)
    return done


def index_one(spark: SparkSession, name: str, document: Mapping) -> None:
    """Appends one document; fields that it lacks are null."""
    schema = spark.table(name).schema
    spark.createDataFrame([tuple(document.get(f) for f in schema.names)], schema).write.mode("append").saveAsTable(name)


def upsert_index(spark: SparkSession, name: str, new: DataFrame, key: str, updated: Sequence[str]) -> DataFrame:
    """Merges ``new`` into a table by ``key`` (see ``upsert_rows``) and returns (action, n).

    The result is written beside the table before it replaces it, since a table can't be overwritten by a plan that reads it.
    """
    merged = upsert_rows(spark.table(name), new, key, updated)
    stage = f"{name}_stage_{uuid.uuid4().hex[:8]}"
    merged.write.mode("overwrite").saveAsTable(stage)
    counts = spark.table(stage).groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    done = spark.createDataFrame(counts.collect(), "action string, n long")
    spark.table(stage).drop("action").write.mode("overwrite").saveAsTable(name)
    spark.sql(f"DROP TABLE {stage}")
    return done


def add_fields(spark: SparkSession, name: str, fields: Mapping[str, str]) -> None:
    """Adds those of the columns (name to type) that a table lacks, null in all rows."""
    have = {c.lower() for c in spark.table(name).columns}
    new = [f"{n} {t}" for n, t in fields.items() if n.lower() not in have]
    if new:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(new)})")


def write_pages(pages: DataFrame, path: str, *, least: int = 50) -> DataFrame:
    """Appends (filename, value) rows of page texts that aren't there yet; returns (query, link, reason) of what was left out.

    ``pages`` are (query, link, content); a text of fewer than ``least`` characters fails. A name is written once, for the first link.
    """
    spark = pages.sparkSession
    rows = pages.select("query", "link", "content", L.filename_from_link(F.col("link"), F.col("query")).alias("filename"))
    ok = X.min_length(F.col("content"), least)
    fresh = rows.where(ok).groupBy("filename").agg(F.min_by(F.struct("query", "link", "content"), "link").alias("r")).select("filename", "r.*")
    if exists(spark, path):
        fresh = fresh.join(spark.read.schema("filename string, value string").json(path).select("filename"), "filename", "left_anti")
    failed = rows.where(~ok).select("query", "link", F.lit("too short").alias("reason"))
    text = F.concat(F.lit("# 查询词: "), F.coalesce("query", F.lit("")), F.lit("\n# 链接: "), F.col("link"), F.lit("\n# " + "=" * 20 + "\n"), F.col("content"))
    fresh.select("filename", text.alias("value")).write.mode("append").json(path)
    return failed


def write_report(df: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file, stamped with the time of writing."""
    df.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_sample(df: DataFrame, path: str, n: int = 5) -> None:
    df.limit(n).coalesce(1).write.mode("overwrite").json(path)
