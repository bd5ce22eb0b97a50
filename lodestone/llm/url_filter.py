"""URL rules as a range join: reversed-host keys, nested intervals, one sorted sweep.

A host ``a.b.com`` becomes the key ``com.b.a.``; a rule on ``b.com`` then covers exactly the
keys in [``com.b.``, ``com.b/``), because ``/`` follows ``.`` in byte order. Rule intervals nest
or are disjoint. The sweep over the sorted end points keeps a stack of the rules that are open
and emits, for each end point, the stack that holds until the next one. Pages are merged into
these segments by sort order (last segment at or before the page's key), and the page's path
picks the longest rule of its stack.

Only DataFrame and SQL expressions are used. The sweep over a block of up to ``max_rules`` rules is one
row; a longer list is swept block by block, and a page keeps its longest rule of all blocks. Pages are dealt by a hash of the whole row's key and
id, never by host, so a hot host cannot land in one task.

Defined results: null url or no ``://``: host and path empty; no fitting rule, or no rules at all: rule null
and verdict ``default``. A rule that is listed with both verdicts blocks. Repeated rows and extra columns pass through
unchanged, but columns named host, path, rule or verdict are replaced by the results. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, task_count

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.coalesce(F.translate(rest, UPPER, UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")
    return F.coalesce(rest, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


#: The sweep: a fold over sorted end points whose state is the stack of open rules and the segments so far.
SWEEP = """
aggregate(
  events,
  named_struct(
    'stack', cast(array() AS array<struct<host:string,path:string,verdict:string>>),
    'out', cast(array() AS array<struct<key:string,rules:array<struct<host:string,path:string,verdict:string>>>>)),
  (st, e) -> transform(array(
      CASE WHEN e.open = 1 THEN concat(st.stack, array(e.rule))
           ELSE filter(st.stack, r -> NOT (r.host = e.rule.host AND r.path = e.rule.path AND r.verdict = e.rule.verdict)) END),
    s -> named_struct('stack', s, 'out', concat(st.out, array(named_struct('key', e.key, 'rules', s)))))[0],
  st -> st.out)
"""


def rule_segments(rules: DataFrame) -> DataFrame:
    """(key, rules): for every end point of a rule's interval, the rules open from there on."""
    ends = rules.select(host_key(F.col("host")).alias("lo"), F.struct("host", "path", "verdict").alias("rule"))
    opens = ends.select(F.col("lo").alias("key"), F.lit(1).alias("open"), "rule")
    closes = ends.select(F.expr("concat(substring(lo, 1, length(lo) - 1), '/')").alias("key"), F.lit(0).alias("open"), "rule")
    events = opens.unionByName(closes).agg(F.sort_array(F.collect_list(F.struct("key", "open", "rule"))).alias("events"))
    steps = events.select(F.posexplode(F.expr(SWEEP)).alias("pos", "s"))
    # several end points may share a key: the state after the last of them holds
    return steps.groupBy(F.col("s.key").alias("key")).agg(F.max_by("s.rules", "pos").alias("rules"))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    *,
    url_col: str = "url",
    default: str = "allow",
    max_rules: int = 10_000,
) -> DataFrame:
    """Adds ``host, path, rule, verdict`` to ``pages``; ``rules`` are (verdict, host, path)."""
    spark = pages.sparkSession
    taken = [c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict")]
    body = pages.drop(*taken)
    row, salt, key, open_, found = fresh(body, "row", "salt", "key", "open", "found")
    host, path = fresh(body, "h", "p")
    width = task_count(spark)

    left = body.select(F.struct(*[F.col(f"`{c}`") for c in body.columns]).alias(row)).select(
        row, url_host(F.col(f"{row}.`{url_col}`")).alias(host), url_path(F.col(f"{row}.`{url_col}`")).alias(path))
    left = left.withColumn(key, host_key(F.col(host))).withColumn(
        salt, F.pmod(F.xxhash64(row), F.lit(width)).cast("int"))
    rules_type = "array<struct<host:string,path:string,verdict:string>>"
    merged = left.withColumn(found, F.lit(None).cast("struct<n:int,m:int,rule:string,verdict:string>"))
    listed = sorted(set(rules), key=lambda r: (".".join(reversed(r[1].split("."))), r[2], r[0]))
    for at in range(0, len(listed), max_rules):
        block = spark.createDataFrame([(h, p, v) for v, h, p in listed[at : at + max_rules]], "host string, path string, verdict string")
        # every salt gets all segments: at most 2 * max_rules rows each
        segs = rule_segments(block).select(
            F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias(salt), F.col("key").alias(key), F.col("rules").alias(open_))
        merged = merged.withColumn(open_, F.lit(None).cast(rules_type)).unionByName(segs, allowMissingColumns=True)
        # segments sort before pages with the same key
        sweep = Window.partitionBy(salt).orderBy(F.col(key), F.col(row).isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        merged = merged.withColumn(open_, F.last(open_, ignorenulls=True).over(sweep)).where(F.col(row).isNotNull())
        fits = F.filter(F.col(open_), lambda r: F.startswith(F.col(path), r["path"]))
        longest = F.array_max(F.transform(fits, lambda r: F.struct(
            (F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("m"),
            F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))))
        merged = merged.withColumn(found, F.greatest(found, longest)).drop(open_)
    return merged.select(
        *[F.col(f"{row}.`{c}`").alias(c) for c in body.columns],
        F.col(host).alias("host"), F.col(path).alias("path"), F.col(f"{found}.rule").alias("rule"),
        F.coalesce(F.col(f"{found}.verdict"), F.lit(default)).alias("verdict"))
