"""The same transforms over streams: record files that keep arriving, and events with late data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.writers import upsert_index


def record_stream(spark: SparkSession, folder: str, schema: str, *, files_per_batch: int = 100) -> DataFrame:
    """The records of all JSON-lines files of a folder, present and to come; lines that are no records have only nulls and are left out."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.where(F.coalesce(*[F.col(c).cast("string") for c in rows.columns]).isNotNull())


def first_seen(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first row of each key; keys are forgotten once they are ``delay`` older than the newest row."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def event_counts(events: DataFrame, time: str, by: str, window: str, delay: str) -> DataFrame:
    """(start, by, n, total) per window; works on tables as on streams, where windows close ``delay`` after their end."""
    rows = events.withWatermark(time, delay) if events.isStreaming else events
    return rows.groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def upsert_stream(stream: DataFrame, name: str, key: str, order: str, updated: Sequence[str], checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Merges every batch into a table by ``key``, the last row of a key in ``order`` counting; a batch that is repeated changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        last = transform(batch).groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("r")).select(key, "r.*")
        upsert_index(batch.sparkSession, name, last, key, updated)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
