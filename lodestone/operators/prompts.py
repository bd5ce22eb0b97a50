"""Asking a language model from Spark, and re-ranking hits by its replies.

Prompts are asked in the tasks, each with a client of its own from a factory, several at a time, again after a growing pause where
a call fails. Replies are stored in a table by a digest of their prompt, and only prompts without a stored reply are asked: what a lost or
interrupted run has paid for is read the next time, as far as it was committed (``batch`` prompts at a time at the latest).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import links as L
from ..functions import text as T
from .lineage import cut
from .resolve import reconciled_links

Client = Callable[[str], str]
REPLIES = "digest string, prompt string, reply string, attempts int, error string"
# The fields of a reply about a mention, any of which makes it useful.
MENTION_FIELDS = {"aliases_zh": "中文别名", "aliases_en": "英文别名", "definition_zh": "中文定义", "definition_en": "英文定义", "description_zh": "中文详细描述", "description_en": "英文详细描述"}


def stored_replies(spark: SparkSession, path: str) -> DataFrame:
    """The latest good reply of each prompt; an empty table where none was stored."""
    try:
        rows = spark.read.schema(REPLIES).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], REPLIES)
    return rows.where("reply IS NOT NULL").groupBy("digest").agg(F.max_by(F.struct("prompt", "reply", "attempts", "error"), "attempts").alias("r")).select("digest", "r.*")


def asker(make: Callable[[], Client], concurrency: int, retries: int, pause: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = None

        def one(prompt: str) -> tuple[str | None, int, str | None]:
            error = None
            for attempt in range(1, retries + 1):
                try:
                    return client(prompt), attempt, None
                except Exception as e:  # a client may fail in any way; the last error is stored
                    error = f"{type(e).__name__}: {e}"
                    if attempt < retries:
                        time.sleep(pause * 2 ** (attempt - 1))
            return None, retries, error

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                client = client or make()
                found = [*pool.map(one, batch.column("prompt").to_pylist())]
                yield pa.record_batch([
                    batch.column("digest"), batch.column("prompt"), pa.array([r for r, _, _ in found], pa.string()), pa.array([n for _, n, _ in found], pa.int32()),
                    pa.array([e for *_, e in found], pa.string())], names=["digest", "prompt", "reply", "attempts", "error"])

    return run


def ask(
    prompts: DataFrame, prompt: str, make: Callable[[], Client], path: str, *, concurrency: int = 8, retries: int = 3, pause: float = 1.0, batch: int = 10_000, tasks: int = 8,
) -> DataFrame:
    """``prompts`` with a ``reply``, null where every call failed (a later run asks again) and for null prompts.

    ``tasks`` times ``concurrency`` calls are made at once. Equal prompts are asked once.
    """
    spark = prompts.sparkSession
    digest = F.sha2(F.col(prompt).cast("binary"), 256)
    wanted = cut(prompts.where(F.col(prompt).isNotNull()).select(digest.alias("digest"), F.col(prompt).alias("prompt")).distinct())
    new = cut(wanted.join(stored_replies(spark, path).select("digest"), "digest", "left_anti"))
    rounds = max(1, -(-new.count() // batch))
    for i in range(rounds if not new.isEmpty() else 0):
        some = new.where(F.pmod(F.xxhash64("digest"), F.lit(rounds)) == i).repartition(tasks, "digest")
        some.mapInArrow(asker(make, concurrency, retries, pause), REPLIES).write.mode("append").parquet(path)
    replies = stored_replies(spark, path).select(F.col("digest").alias("_digest"), "reply")
    return prompts.join(replies, digest == F.col("_digest"), "left").drop("_digest")


def mention_prompt(mention: Column) -> Column:
    fields = "\n".join(f"{name}：" for name in MENTION_FIELDS.values())
    return F.concat(F.lit("Say what is known about the mention, a field a line.\n" + fields + "\nMention: "), T.preprocess_query(mention))


def expand_mentions(queries: DataFrame, mention: str, make: Callable[[], Client], path: str, **options) -> DataFrame:
    """``queries`` with a struct ``about`` of the reply's fields, null where none of them has a value."""
    asked = ask(queries.withColumn("_prompt", mention_prompt(F.col(mention))), "_prompt", make, path, **options)
    fields = [T.reply_field(F.coalesce("reply", F.lit("")), name).alias(key) for key, name in MENTION_FIELDS.items()]
    some = F.concat(*[T.reply_field(F.coalesce("reply", F.lit("")), name) for name in MENTION_FIELDS.values()]) != ""
    return asked.withColumn("about", F.when(some, F.struct(*fields))).drop("_prompt", "reply")


def reply_links(reply: Column) -> Column:
    """The non-blank lines of a reply, the first of those that are one link in normal form."""
    lines = F.filter(F.transform(F.split(reply, "\n"), L.strip), lambda x: x != "")
    normal = F.transform(lines, lambda x: L.normalize_v2(L.clean_link(x)))
    return F.filter(lines, lambda x, i: F.array_position(normal, F.get(normal, i)) == i + 1)


def rerank(
    hits: DataFrame, candidates: DataFrame, queries: DataFrame, query: str, make: Callable[[], Client], path: str, *,
    from_vectors: bool = True, about: Column | None = None, needs_about: bool = False, **options,
) -> DataFrame:
    """(query_id, id, rank): ranked hits (query_id, id, rank) in the order that a language model replies.

    ``candidates`` are (id, label, aliases_zh, aliases_en, descriptions_zh, descriptions_en, link); ``queries`` (query_id, query and what ``about``
    needs). Links that the reply drops, invents, repeats or spells otherwise are reconciled with those asked for, so the result is always a
    permutation of the hits; hits that share a link keep their order. Without a reply (or with ``needs_about`` without anything known about the query)
    the hits keep their order. A query has as many candidates as it has hits, which is bounded by the search's k.
    """
    option = F.struct("rank", "id", "label", "aliases_zh", "aliases_en", "descriptions_zh", "descriptions_en", "link")
    full = hits.select("query_id", "id", "rank").join(candidates, "id", "left")
    lists = full.groupBy("query_id").agg(F.array_sort(F.collect_list(option)).alias("options"))
    known = F.lit(None).cast("string") if about is None else about
    asked = lists.join(queries.select("query_id", F.col(query).alias("_query"), known.alias("_about")), "query_id", "left")
    text = T.preprocess_query(F.concat_ws("\n", F.coalesce("_query", F.lit("")), "_about"))
    ready = F.lit(True) if not needs_about else F.col("_about").isNotNull()
    asked = asked.withColumn("_prompt", F.when(ready, T.ranking_prompt(text, F.col("options"), from_vectors=from_vectors)))
    replied = cut(ask(asked, "_prompt", make, path, **options))
    links = F.transform("options", lambda o: F.coalesce(o["link"], F.lit("")))
    replied = replied.select("query_id", "options", links.alias("links"), reply_links(F.col("reply")).alias("said"))
    ordered = cut(replied.select("query_id", "options", F.coalesce("said", "links").alias("said"), "links")).select(
        "query_id", "options", reconciled_links(F.col("said"), F.col("links")).alias("order"))
    each = cut(ordered).select("query_id", "order", F.explode("options").alias("o"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.array_position("order", F.coalesce("o.link", F.lit(""))), "o.rank", "o.id"))
    return each.select("query_id", F.col("o.id").alias("id"), place.alias("rank"))


class OverlapClient:
    """A client for tests and offline runs: it ranks the options of a ranking prompt by how many of the query's words their label and aliases hold."""

    def __call__(self, prompt: str) -> str:
        import re

        words = lambda s: set(re.findall(r"[^\W_]+", s.lower()))
        query = words(re.search(r"\nQuery: (.*)\n", prompt).group(1))
        rows = []
        for i, block in enumerate(re.split(r"选项\d+：\n", prompt)[1:]):
            field = lambda name, block=block: re.search(rf"(?m)^{name}: (.*)$", block).group(1)
            held = words(" ".join(field(n) for n in ("label", "aliases_zh", "aliases_en")).replace("无", " "))
            rows.append((-len(query & held), i, field("link")))
        return "\n".join(link for *_, link in sorted(rows))
