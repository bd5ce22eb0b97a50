"""Resolving queries to entities: candidates by eight tiers, one-to-one assignment, reconciling ranked links.

Entities are (ord, label, link, aliases_zh, aliases_en); queries are (q, query, link), worked off in the order of ``q``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import links as L
from .lineage import asking, cut, spread, unguessed
from .records import contained_pairs, fuzzy_join

# The tiers in their order, and the similarity that a fuzzy match must exceed.
TIERS = ("label_exact", "alias_exact", "url_title_exact", "link_exact", "label_fuzzy", "alias_fuzzy", "url_title_fuzzy", "link_fuzzy")
FUZZY = 0.3


def keys_of(entities: DataFrame) -> dict[str, DataFrame]:
    """Per kind (label, alias, title, link) the table (key, ord, place): the entity behind each distinct key.

    The first entity wins a label, alias or title, the last one a link; ``place`` orders keys as they first occurred.
    """
    some = lambda c: F.nullif(L.strip(c), F.lit(""))
    none = F.array().cast("array<string>")
    aliases = F.concat(F.coalesce("aliases_zh", none), F.coalesce("aliases_en", none))
    raw = {
        "label": entities.select(some(F.col("label")).alias("key"), "ord"),
        "alias": entities.select(F.explode(F.transform(aliases, some)).alias("key"), "ord"),
        "title": entities.select(some(L.title_from_url(F.col("link"))).alias("key"), "ord"),
        "link": entities.select(F.explode(F.array(F.nullif(L.normalize_v2(F.col("link")), F.lit("")), F.nullif("link", F.lit("")))).alias("key"), "ord")}
    winner = {"link": F.max("ord")}
    return {k: df.where(F.col("key").isNotNull()).groupBy("key").agg(winner.get(k, F.min("ord")).alias("ord"), F.min("ord").alias("place")) for k, df in raw.items()}


def candidates(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(q, ord, tier, method, similarity, place): every entity that some tier offers for a query, by its best tier."""
    # the tiers read both sides many times
    keys = {kind: cut(table) for kind, table in keys_of(cut(spread(entities))).items()}
    asked = queries.select("q", L.strip(F.col("query")).alias("text"), F.coalesce("link", F.lit("")).alias("raw"))
    asked = cut(asked.withColumns({"normal": L.normalize_v2(F.col("raw")), "title": L.strip(L.title_from_url(F.col("raw")))}))
    few = asking(asked)
    parts = []

    def add(tier: int, hits: DataFrame, similarity: Column) -> None:
        parts.append(hits.select("q", "ord", F.lit(tier).alias("tier"), F.lit(TIERS[tier - 1]).alias("method"), similarity.cast("double").alias("similarity"), "place"))

    equal = lambda on, kind: unguessed(keys[kind]).join(few.where(F.coalesce(F.col(on), F.lit("")) != ""), F.col(on) == F.col("key"))
    add(1, equal("text", "label"), F.lit(1.0))
    add(2, equal("text", "alias"), F.lit(1.0))
    add(3, equal("title", "title"), F.lit(1.0))
    by_normal = equal("normal", "link")
    add(4, by_normal, F.lit(1.0))
    add(4, equal("raw", "link").join(by_normal.select("q").distinct(), "q", "left_anti"), F.lit(1.0))
    for tier, kind, on in ((5, "label", asked), (6, "alias", asked), (7, "title", asked.where("title <> ''"))):
        near = fuzzy_join(on, keys[kind], "text", "key", FUZZY, above=True)
        add(tier, near.join(unguessed(keys[kind]), "key").join(unguessed(on), "text"), F.col("similarity"))
    # links: either contains the other, in normal or in raw form; the first key wins, so all count alike
    table = cut(keys["link"].withColumn("normal_key", L.normalize_v2(F.col("key"))))
    for mine, other in (("normal", "normal_key"), ("raw", "key")):
        both = contained_pairs(asked, table, mine, other).select(mine, other).union(contained_pairs(table, asked, other, mine).select(mine, other)).distinct()
        add(8, both.join(few, mine).join(unguessed(table), other), F.lit(0.0))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = F.min_by(F.struct("tier", "method", "similarity", "place"), F.struct("tier", -F.col("similarity"), "place"))
    return every.groupBy("q", "ord").agg(best.alias("b")).select("q", "ord", "b.*")


def _taken_in_turn(offers: pa.Table) -> pa.Table:
    """(q, ord) of one group of (q, ord, turn): queries in order each take their first choice that none before them took."""
    offers = offers.sort_by([("q", "ascending"), ("turn", "ascending")])
    taken: dict[int, int] = {}
    done: set[int] = set()
    for q, o in zip(offers["q"].to_pylist(), offers["ord"].to_pylist(), strict=True):
        if q not in done and o not in taken:
            taken[o] = q
            done.add(q)
    return pa.table({"q": pa.array(list(taken.values()), offers["q"].type), "ord": pa.array(list(taken), offers["ord"].type)})


def greedy_one_to_one(offers: DataFrame, *, group: int = 1000) -> DataFrame:
    """(q, ord): queries in the order of ``q`` each take the first entity of theirs that no earlier one took.

    ``offers`` are (q, ord, tier, similarity, place); a query prefers the lower tier, the higher similarity, then the earlier place.
    Every entity is held by the earliest query that has asked for it so far. In a round, the queries that hold nothing drop what an earlier query holds, the
    first ``group`` of those with one first choice settle among themselves in one pass, and each entity goes to the earliest that then asks. As all entities
    rank queries alike, it does not matter in which order queries ask: what an entity refuses once it refuses for good, so the
    end is the sequential result. Queries with one preference list take a round for each ``group`` of them. A query that is the n-th of its group needs
    n choices at most, so a group's rows are bounded by the square of its size, whatever the lists' lengths are.
    """
    turn = Window.partitionBy("q").orderBy("tier", F.desc("similarity"), "place", "ord")
    wanted = cut(offers.select("q", "ord", F.row_number().over(turn).alias("turn")))
    held = wanted.select("q", "ord").limit(0)
    while True:
        holder = held.select("ord", F.col("q").alias("_by"))
        free = wanted.join(held.select("q"), "q", "left_anti").join(holder, "ord", "left").where(F.col("_by").isNull() | (F.col("_by") > F.col("q"))).select("q", "ord", "turn")
        first = free.groupBy("q").agg(F.min_by("ord", "turn").alias("first"))
        asking = first.withColumn("_n", F.row_number().over(Window.partitionBy("first").orderBy("q"))).where(F.col("_n") <= group)
        asking = cut(asking)
        if asking.isEmpty():
            return held
        choices = free.join(asking, "q").withColumn("_c", F.row_number().over(Window.partitionBy("q").orderBy("turn"))).where(F.col("_c") <= F.col("_n"))
        found = choices.select("first", "q", "ord", "turn").groupBy("first").applyInArrow(_taken_in_turn, held.schema)
        held = cut(held.unionByName(found).groupBy("ord").agg(F.min("q").alias("q")).select("q", "ord"))


def match(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """``queries`` with ``ord`` and ``method`` of the entity each is assigned to, null if none is left for it."""
    offers = cut(candidates(queries, entities))
    taken = greedy_one_to_one(offers).join(unguessed(offers.select("q", "ord", "method")), ["q", "ord"])
    return queries.join(taken, "q", "left")


def method_shares(matched: DataFrame) -> DataFrame:
    """(method, n, percent) of the matched queries."""
    rows = matched.where(F.col("method").isNotNull()).groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.join(F.broadcast(total)).select("method", "n", F.round(F.try_divide(F.col("n") * 100.0, "total"), 6).alias("percent"))


def reconcile(ranked: Sequence[str], originals: Sequence[str], clean: Callable[[str], str], normal: Callable[[str], str]) -> list[str]:
    """``originals`` in the order of ``ranked`` links: each ranked link takes the first unused original that is equal, equal in normal
    form, contains it or lies in it, and does so in normal form, in this order of tests; the others follow in their own order. Originals are
    distinct here: of repeated ones the first counts."""
    cleaned = [(o, clean(o), normal(clean(o))) for o in originals]
    within = lambda a, b: a in b or b in a
    out: list[str] = []
    for link in ranked:
        c = clean(link)
        n = normal(c)
        last = {k: o for o, k, _ in cleaned}
        tests = (lambda o, k, m: o == last.get(c), lambda o, k, m: m == n, lambda o, k, m: within(c, k), lambda o, k, m: within(n, m))
        free = [x for x in cleaned if x[0] not in out]
        hit = next((x[0] for test in tests for x in free if test(*x)), None)
        if hit is not None:
            out.append(hit)
    return out + [o for o in dict.fromkeys(originals) if o not in out]


def _clean(link: str) -> str:
    import re

    out = link.strip()
    for prefix in (r"^\d+[.)]\s*", r"^选项\d+[：:]\s*", r"(?i)^link[：:]\s*"):
        out = re.sub(prefix, "", out)
    return out.strip()


def _normal(link: str) -> str:
    from urllib.parse import unquote

    link = link.strip()
    return unquote(link.split("/wiki/", 1)[1]) if L.ARTICLE in link else link


@F.udf(ArrayType(StringType()), useArrow=True)
def reconciled_links(ranked, originals):
    """Column form of ``reconcile`` for the two short lists of one query; a worker reconciles lists that come again once, and holds a bounded number of them."""
    if originals is None:
        return None
    import sys
    import types

    known = sys.modules.setdefault("_lodestone_reconciled", types.ModuleType("_lodestone_reconciled")).__dict__.setdefault("known", {})
    key = (tuple(x or "" for x in (ranked if ranked is not None else [])), tuple(x or "" for x in originals))
    if key not in known:
        if len(known) == 1 << 14:
            known.clear()
        known[key] = reconcile(*key, _clean, _normal)
    return known[key]
