"""Filter interaction audit: what each filter removes in every order of the filters.

A document's failures are a mask of one bit a filter, and everything the audit reports depends on the masks' counts
alone, so documents are reduced to mask cells (part, mask, documents, good, toxic): one aggregate with partial sums
before the shuffle. All orders are then visited by single swaps of neighbours, each order
once: a swap at step k changes the prefix of steps k and k+1 only, so these two are read from the cells again and the other
steps keep their numbers. Shapley sums are gathered along the walk.

The cells of a part are one row (2^filters counts, three times), so a part never meets in one task as documents; parts are
walked in Arrow batches, many at once.

"Identical to a smaller id's text" needs no window over equal texts: of each text's digest the smallest id is an aggregate, and only rows
whose (digest, id) is that smallest one do not fail. A group of copies of any size is one row per task there.

Defined results: null text is empty; null part is the empty string; a row without label is neither good nor toxic, and of several labels of an id
the largest counts; a null id is never smaller or larger than another; rows that repeat the smallest id of their text all
pass. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SPACE = "\\x20\\x09-\\x0D"
FILTERS = "ABCDE"
REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def words(text: Column) -> Column:
    """Maximal runs of characters that are no ASCII white space."""
    return F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: too few words, too few distinct words, too many capitals, forbidden marks."""
    w = F.get(F.transform(F.array(words(text)), lambda ws: F.array(F.size(ws), F.size(F.array_distinct(ws)))), F.lit(0))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    mask = F.get(F.transform(F.array(w), lambda n: F.when(n[0] < 200, 1).otherwise(0) + F.when(n[1] * F.lit(100) < n[0] * F.lit(50), 2).otherwise(0)), F.lit(0))
    return (mask + F.when(capitals.cast("long") * 100 > F.char_length(text).cast("long") * 2, 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)).cast("int")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, good, toxic), a row a document: 16 is added to the mask where a smaller id has the same text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_mask(text).alias("mask")), "audit")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").select("doc_id", "digest", F.lit(True).alias("first"))
    of = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # both joins are by id, which no group of copies makes hot
    marked = rows.join(first, ["doc_id", "digest"], "left").join(of, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return marked.select(
        "doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"),
        F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0)).alias("good"), F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0)).alias("toxic"))


def cells(failed: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """One row a part: arrays of 2^filters counts of documents, good and toxic ones by mask."""
    of = failed.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("documents"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    masks = [F.col("mask") == m for m in range(1 << filters)]
    row = lambda c: F.array(*[F.coalesce(F.sum(F.when(m, F.col(c))), F.lit(0)) for m in masks]).cast("array<long>").alias(c)
    return of.groupBy("part").agg(row("documents"), row("good"), row("toxic"))


def swaps(n: int) -> Iterator[int]:
    """The places at which neighbours change, so that all orders of n things are met: the last thing sweeps through each order of the others."""
    if n < 2:
        return
    down = True
    inner = swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        other = next(inner, None)
        if other is None:
            return
        # while the last thing stands in front, the others' places are shifted by one
        yield other + 1 if down else other
        down = not down


def walk(documents: np.ndarray, good: np.ndarray, toxic: np.ndarray, names: str) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Each order with its steps' (removed, redundant, good lost, toxic lost), an array of parts x steps x 4 that the next swap changes in place."""
    n = len(names)
    masks = np.arange(1 << n)

    def step(prefix: int, f: int) -> np.ndarray:
        fails = (masks >> f) & 1 == 1
        new, old = fails & (masks & prefix == 0), fails & (masks & prefix != 0)
        return np.stack([documents[:, new].sum(1), documents[:, old].sum(1), good[:, new].sum(1), toxic[:, new].sum(1)], axis=1)

    order = list(range(n))
    prefix = [(1 << k) - 1 for k in range(n)]
    steps = np.stack([step(prefix[k], order[k]) for k in range(n)], axis=1)
    yield tuple(order), steps
    for k in swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        prefix[k + 1] = prefix[k] | 1 << order[k]
        for changed in (k, k + 1):
            steps[:, changed] = step(prefix[changed], order[changed])
        yield tuple(order), steps


def report(parts: Sequence[str], documents: np.ndarray, good: np.ndarray, toxic: np.ndarray, names: str) -> pd.DataFrame:
    n, p = len(names), len(parts)
    total = documents.sum(1)
    alone = np.stack([documents[:, 1 << f] for f in range(n)], axis=1)
    shapley = np.zeros((p, n), dtype=np.int64)
    orders, found = [], []
    for order, steps in walk(documents, good, toxic, names):
        shapley[:, list(order)] += steps[:, :, 0]
        orders.append(order)
        found.append(steps.copy())
    steps, at = np.stack(found, axis=1), np.array(orders)
    kept = total[:, None, None] - np.cumsum(steps[..., 0], axis=2)
    shape = (p, len(orders), n)
    flat = lambda a: np.broadcast_to(a, shape).reshape(-1)
    text = np.array(["".join(names[f] for f in o) for o in orders], dtype=object)
    return pd.DataFrame({
        "part": flat(np.array(parts, dtype=object)[:, None, None]), "filter_order": flat(text[None, :, None]), "step": flat(np.arange(1, n + 1, dtype=np.int32)[None, None, :]),
        "kept": kept.reshape(-1), "removed": steps[..., 0].reshape(-1), "redundant": steps[..., 1].reshape(-1), "unique_fails": alone[:, at].reshape(-1),
        "good_lost": steps[..., 2].reshape(-1), "toxic_lost": steps[..., 3].reshape(-1), "shapley": shapley[:, at].reshape(-1)})


def audit(cell_rows: DataFrame, names: str = FILTERS) -> DataFrame:
    """Rows of ``cells`` to one row per part, order and step."""
    count = 1 << len(names)

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1000):
                some = batch.iloc[start:start + 1000]
                arrays = [np.stack(some[c].to_numpy()).astype(np.int64).reshape(-1, count) for c in ("documents", "good", "toxic")]
                yield report(some["part"].tolist(), *arrays, names)

    return cell_rows.mapInPandas(walked, REPORT)


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(cells(failures(docs, labels)))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e
  FROM documents),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part,
         CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN e THEN 16 ELSE 0 END AS mask,
         coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, count_if(good) AS g, count_if(toxic) AS x FROM f GROUP BY part, mask),
k AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)),
o AS (
  SELECT a.name || b.name || d.name || e.name || h.name AS filter_order, [a.bit, b.bit, d.bit, e.bit, h.bit] AS bits
  FROM k a, k b, k d, k e, k h WHERE a.bit + b.bit + d.bit + e.bit + h.bit = 31 AND a.bit | b.bit | d.bit | e.bit | h.bit = 31),
s AS (
  SELECT filter_order, step::INTEGER AS step, bits[step]::INTEGER AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS prefix
  FROM o, range(1, 6) r(step)),
r AS (
  SELECT c.part, s.filter_order, s.step, s.bit,
         sum(CASE WHEN c.mask & (s.prefix | s.bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN c.mask & s.bit > 0 AND c.mask & s.prefix = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN c.mask & s.bit > 0 AND c.mask & s.prefix > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN c.mask = s.bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN c.mask & s.bit > 0 AND c.mask & s.prefix = 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN c.mask & s.bit > 0 AND c.mask & s.prefix = 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM r
"""
