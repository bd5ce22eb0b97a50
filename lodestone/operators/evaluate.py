"""Retrieval and classification metrics, and their comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import links as L

METRICS = ("mrr", "hit_1", "hit_5", "hit_10")


def rank_metrics(rank: Column) -> list[Column]:
    """Reciprocal rank and hits of one query (null: not found)."""
    hit = lambda k: F.when(rank <= k, 1.0).otherwise(0.0).alias(f"hit_{k}")
    return [F.coalesce(1.0 / rank, F.lit(0.0)).alias("mrr"), hit(1), hit(5), hit(10)]


def ranking_metrics(ranks: DataFrame, rank: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """MRR and Hit@1/5/10 over all queries from one row per query (null: not found)."""
    one = ranks.select(*by, *rank_metrics(F.col(rank)))
    return one.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


def running_metrics(ranks: DataFrame, order: str, rank: str = "rank") -> DataFrame:
    """The averages up to each query in ``order``; over the evaluated queries, not the corpus."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    one = ranks.select(order, *rank_metrics(F.col(rank)))
    return one.select(order, *[F.round(F.avg(m).over(w), 6).alias(m) for m in METRICS])


def links_match(found: Column, gold: Column, how: str = "strict") -> Column:
    """True if both links mean one page. strict: equal in normal form, and not empty. lenient: also if one contains the other,
    cleaned or in normal form, so that an empty link matches everything."""
    a, b = L.clean_link(F.coalesce(found, F.lit(""))), L.clean_link(F.coalesce(gold, F.lit("")))
    x, y = L.normalize_v1(a), L.normalize_v1(b)
    if how == "strict":
        return (x == y) & (x != "")
    return (x == y) | (a == b) | a.contains(b) | b.contains(a) | x.contains(y) | y.contains(x)


def gold_ranks(hits: DataFrame, gold: DataFrame, how: str = "strict") -> DataFrame:
    """(query_id, gold, rank) for each row of ``gold`` (query_id, gold): the first rank of ``hits`` (query_id, link, rank) that matches, else null."""
    both = gold.join(hits.select("query_id", "link", "rank"), "query_id", "left")
    return both.groupBy("query_id", "gold").agg(F.min(F.when(links_match(F.col("link"), F.col("gold"), how), F.col("rank"))).alias("rank"))


def details(hits: DataFrame, gold: DataFrame, how: str = "strict", listed: int = 10) -> DataFrame:
    """One row per query: its gold link, rank, metrics, and the first ``listed`` links found."""
    top = hits.where(F.col("rank") <= listed).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "link"))), lambda h: h["link"]).alias("sorted_links"))
    ranks = gold_ranks(hits, gold, how)
    return ranks.join(top, "query_id", "left").select("query_id", "gold", "rank", "sorted_links", *rank_metrics(F.col("rank")))


def relative_improvement(before: Column, after: Column) -> Column:
    """Percent; from zero anything above counts as 100 %."""
    return F.when(before > 0, (after - before) / before * 100).when(after > 0, 100.0).otherwise(0.0)


def compare_reports(before: DataFrame, after: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """(metric, before, after, absolute, relative_percent, improved) of two one-row reports."""
    long = lambda df, name: df.select(*[F.col(m).cast("double") for m in metrics]).unpivot([], list(metrics), "metric", name)
    both = long(before, "before").join(long(after, "after"), "metric")
    b, a = F.col("before"), F.col("after")
    return both.select("metric", "before", "after", F.when(b > 0, a - b).otherwise(a).alias("absolute"), relative_improvement(b, a).alias("relative_percent"), (a > b).alias("improved"))


def compare_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """(query_id, left_rank, right_rank, winner) of two (query_id, rank); the smaller rank wins, not found loses."""
    both = left.select("query_id", F.col("rank").alias("left_rank")).join(right.select("query_id", F.col("rank").alias("right_rank")), "query_id")
    far = lambda c: F.coalesce(F.col(c), F.lit(2**31 - 1))
    winner = F.when(far("left_rank") < far("right_rank"), "left").when(far("left_rank") > far("right_rank"), "right").otherwise("tie")
    return both.withColumn("winner", winner)


def pivot_modes(summary: DataFrame, config: str, mode: str, value: str, modes: Sequence[str]) -> DataFrame:
    """One row per configuration, one column per mode."""
    return summary.groupBy(config).pivot(mode, list(modes)).agg(F.first(value))


def weighted_metrics(rows: DataFrame, truth: Column, predicted: Column, ignore: Sequence = (-100,)) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1; rows whose truth is null or in ``ignore`` don't count.

    Everything follows from the confusion counts, which are as many as there are pairs of labels. A label that is never
    predicted has precision 0; without rows all figures are 0.
    """
    pairs = rows.select(truth.alias("t"), predicted.alias("p")).where(F.col("t").isNotNull())
    if ignore:
        pairs = pairs.where(~F.col("t").isin(*ignore))
    cells = pairs.groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"))
    support = cells.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t").eqNullSafe(F.col("p")), F.col("n")).otherwise(0)).alias("tp"))
    guessed = cells.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("guessed"))
    each = support.join(guessed, "label", "left")
    p, r = F.coalesce(F.try_divide("tp", "guessed"), F.lit(0.0)), F.col("tp") / F.col("support")
    each = each.select("support", "tp", p.alias("p"), r.alias("r")).withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    whole = F.sum("support")
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), whole), F.lit(0.0))
    return each.agg(F.coalesce(whole, F.lit(0)).alias("support"), F.coalesce(F.try_divide(F.sum("tp"), whole), F.lit(0.0)).alias("accuracy"), mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"))


def group_probabilities(logits: Column, groups: Sequence[str]) -> Column:
    """Softmax over an array of logits, summed per label group: an array of (group, p), the likeliest first."""
    peak = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - peak))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    names = F.array(*[F.lit(g) for g in groups])
    pairs = F.arrays_zip(F.transform(e, lambda x: x / total).alias("p"), names.alias("g"))
    sums = F.transform(F.array_distinct(names), lambda g: F.struct(
        F.aggregate(F.filter(pairs, lambda z: z["g"] == g), F.lit(0.0), lambda s, z: s + z["p"]).alias("p"), g.alias("group")))
    return F.reverse(F.array_sort(sums))
