"""Near-duplicate groups by DartMinHash signatures.

A document is a weighted set of word 5-gram hashes, weight ``1 + log2(count)``. Darts fall on the
region (0, weight] x (0, inf) of each element as a Poisson process with rate K over time; element,
weight cell and index seed each dart, so a document only ever sees a prefix of the same sequence
that any other document sees. Each dart has a coordinate in [K]; the earliest dart per coordinate
is the signature, and two documents agree on a coordinate with the probability of their weighted
Jaccard similarity. Long documents stop earlier (time ~ log K / total weight), so all documents
cost about the same number of darts.

Signatures are banded (BANDS bands of ROWS coordinates); a document with repeated shingles has a second
signature with all weights 1, in the same bands, so that plain similarity makes candidates as well.
Documents with equal shingles and counts are one class from the start, and classes with equal shingle
sets are linked. Of a band bucket of up to SMALL classes all pairs are tested; in a
larger one each class is tested against the most central one. Where that leaves a large bucket
unconnected, its members meet by an exact prefix filter on shingles (``prefix_links``), so no
link between groups is lost. Every tested link is
verified exactly on the shingles. Classes of links are connected by repeated minimum-label
propagation over tables. No bucket, group or component is ever gathered.

Defined results: two documents are near duplicates if the Jaccard similarity of their shingle
sets, plain or weighted, is at least ``threshold``. Words are runs of letters, digits and
underscores, lower-cased. A text of one to four words is one shingle; null, empty and wordless
texts have none and are groups of their own. A row is a document of its own even if its id repeats: a group's
id is its smallest doc_id, and the row that stays is the one with that id (of several, the one whose text has the
smallest 64-bit digest). Rows that repeat id and text are one document: ``near_duplicates`` has a line for each and
``deduplicate`` keeps one. Rows with a null id are groups of their own and stay. Very long texts are shingled in
whole. Extra columns stay; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PART, cut, fresh, slices

SHINGLE, BANDS, ROWS = 5, 25, 5
K = BANDS * ROWS
SMALL = 6
#: Expected darts per coordinate and document: ln K + MARGIN; e^-MARGIN coordinates stay empty.
MARGIN = 4.0
WORD = re.compile(r"\w+")
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    codes, uniques = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(np.asarray(uniques, dtype=object), categorize=False)[codes]


def shingles(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count), sorted by document, of a list of texts."""
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    empty = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not n.sum():
        return empty
    h = word_hashes([w for ws in words for w in ws])
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    # a text of fewer than five words is one shingle
    take = np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1))
    doc = np.repeat(np.arange(len(n)), take)
    at = np.arange(take.sum()) + np.repeat(starts - (np.cumsum(take) - take), take)
    h = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    short = np.flatnonzero((n < SHINGLE)[doc])
    s = np.zeros(len(at), dtype=np.uint64)
    factor = M1
    for j in range(SHINGLE):
        v = h[at + j]
        v[short[j >= n[doc[short]]]] = j
        s += v * factor
        factor = mix(np.array([factor]))[0] | np.uint64(1)
    # document and 44 bits of the shingle in one sortable number
    key = (doc.astype(np.uint64) << np.uint64(44)) | (mix(s) >> np.uint64(20))
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.concatenate([first, [len(key)]]))
    key = key[first]
    return (key >> np.uint64(44)).astype(np.int64), mix(key & np.uint64((1 << 44) - 1)), count


def weights(count: np.ndarray) -> np.ndarray:
    return 1.0 + np.log2(count)


def signatures(doc: np.ndarray, s: np.ndarray, w: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Earliest dart (its hash) per document and coordinate, and whether there is one."""
    total = np.bincount(doc, weights=w, minlength=docs)
    limit = (math.log(K) + MARGIN) / np.maximum(total, 1e-9)
    # one line per element and weight cell [m, m + 1)
    cells = np.ceil(w).astype(np.int64)
    line = np.repeat(np.arange(len(s)), cells)
    m = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    seed, reach, of = mix(s[line] + (m + 1).astype(np.uint64) * M1), (w[line] - m), doc[line]
    best_t = np.full(docs * K, np.inf)
    best = np.zeros(docs * K, dtype=np.uint64)
    t, i, until = np.zeros(len(seed)), 0, limit[of]
    steps = np.arange(1 << 16, dtype=np.uint64) * M2
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(seed):
        i += 1
        dart = mix(seed + steps[i])
        u = ((dart >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        t = t - np.log(u) / K
        alive = t < until
        if not alive.all():
            seed, reach, of, t, until, dart = seed[alive], reach[alive], of[alive], t[alive], until[alive], dart[alive]
        place = mix(dart * M1 + np.uint64(1))
        height = (place >> np.uint64(32)).astype(np.float64) / float(1 << 32)
        hit = height < reach
        slot = of[hit] * K + ((place[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(K)).astype(np.int64)
        found.append((slot, t[hit], dart[hit]))
    if found:
        slot, t, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        np.minimum.at(best_t, slot, t)
        earliest = t == best_t[slot]
        best[slot[earliest]] = dart[earliest]
    return best.reshape(docs, K), np.isfinite(best_t).reshape(docs, K)


def band_keys(doc: np.ndarray, s: np.ndarray, w: np.ndarray, docs: int) -> np.ndarray:
    """A key per document and band; 0: none."""
    sig, has = signatures(doc, s, w, docs)
    keys = np.zeros((docs, BANDS), dtype=np.uint64)
    for j in range(ROWS):
        keys = mix((keys + sig[:, j::ROWS]) * M1 + np.uint64(j))
    keys = mix(keys + np.arange(BANDS, dtype=np.uint64) * M3)
    keys[~np.logical_and.reduce([has[:, j::ROWS] for j in range(ROWS)])] = 0
    return keys


def describe(texts: list) -> pd.DataFrame:
    """Per text: fingerprints of its shingle multiset and set, band keys (0: none), shingles and counts as bytes."""
    doc, s, count = shingles(texts)
    n = len(texts)
    keys = band_keys(doc, s, weights(count), n)
    bands = list(keys.astype(np.int64))
    repeats = np.unique(doc[count > 1])
    if len(repeats):
        of = np.isin(doc, repeats)
        plain = band_keys(np.searchsorted(repeats, doc[of]), s[of], np.ones(of.sum()), len(repeats))
        for i, more in zip(repeats, plain, strict=True):
            bands[i] = np.unique(np.concatenate([keys[i], more])).astype(np.int64)
    ends = np.searchsorted(doc, np.arange(n), side="right")
    begins = np.searchsorted(doc, np.arange(n), side="left")
    short = (s >> np.uint64(32)).astype(np.uint32)
    few = np.minimum(count, 65535).astype(np.uint16)
    x, y = mix(s + count.astype(np.uint64)), mix(s * M2 + count.astype(np.uint64))
    u, v = mix(s), mix(s * M2)
    prints, sets = [], []
    for a, b in zip(begins, ends, strict=True):
        prints.append(f"{int(x[a:b].sum()):016x}{int(y[a:b].sum()):016x}{b - a:x}" if b > a else None)
        sets.append(f"{int(u[a:b].sum()):016x}{int(v[a:b].sum()):016x}{b - a:x}" if b > a else None)
    return pd.DataFrame({
        "print": prints, "shape": sets, "bands": bands,
        "shingles": [short[a:b].tobytes() for a, b in zip(begins, ends, strict=True)],
        "tf": [few[a:b].tobytes() if (few[a:b] > 1).any() else b"" for a, b in zip(begins, ends, strict=True)]})


def similarity(a: bytes, a_tf: bytes, b: bytes, b_tf: bytes) -> float:
    """The larger of plain and weighted Jaccard similarity of two described texts."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    shared, i, j = np.intersect1d(x, y, assume_unique=False, return_indices=True)
    plain = len(shared) / max(1, len(x) + len(y) - len(shared))
    if not a_tf and not b_tf:
        return plain
    v = weights(np.frombuffer(a_tf, np.uint16).astype(float)) if a_tf else np.ones(len(x))
    w = weights(np.frombuffer(b_tf, np.uint16).astype(float)) if b_tf else np.ones(len(y))
    low = np.minimum(v[i], w[j]).sum()
    return max(plain, low / max(1e-9, v.sum() + w.sum() - low))


def row_nodes(docs: DataFrame) -> Column | None:
    """What tells rows apart where ids repeat, else None. A digest of id and text, as rows have no other name that outlives a lost task."""
    n = docs.agg(F.count("doc_id").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    return None if n["rows"] == n["ids"] else F.xxhash64("doc_id", "text")


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, print, shape, bands, shingles, tf)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [None if t is None or t != t else t for t in batch["text"].tolist()]
            for a, b in slices(texts, PART):
                out = describe(texts[a:b])
                out.insert(0, "doc_id", batch["doc_id"].iloc[a:b].to_numpy())
                yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, print string, shape string, bands array<long>, shingles binary, tf binary")


def band_rows(classes: DataFrame) -> DataFrame:
    """(rep, key, n) of every band bucket of n > 1 classes, from (rep, bands)."""
    rows = classes.select("rep", F.explode("bands").alias("key")).where("key <> 0")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut(rows.join(sizes, "key"))


def same_links(classes: DataFrame) -> DataFrame:
    """Links (a, b), a < b, of each class to the first one with its shingle set, from (rep, shape): plain similarity is 1."""
    first = classes.groupBy("shape").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("shape", "a")
    return classes.join(first, "shape").where("rep <> a").select("a", F.col("rep").alias("b"))


def small_links(rows: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of buckets of up to SMALL classes."""
    small = rows.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("rep")).alias("m"))
    pairs = small.select(F.explode(F.expr(
        "flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> named_struct('a', x, 'b', y))))")).alias("p"))
    return pairs.select("p.a", "p.b").where("a <> b").distinct()


def star_links(rows: DataFrame) -> DataFrame:
    """Links (a, b), a < b, of each large bucket's most central class (that in the largest buckets overall) to all others."""
    central = rows.groupBy("rep").agg(F.sum("n").alias("c"))
    large = rows.where(F.col("n") > SMALL).select("key", "rep")
    hubs = large.join(central, "rep").groupBy("key").agg(F.max_by("rep", F.struct("c", "rep")).alias("hub"))
    stars = large.join(hubs, "key").where("rep <> hub")
    return stars.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()


def unconnected(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(rep, root) of the members of large buckets whose members ``found`` doesn't connect."""
    roots = connected(found)
    members = rows.where(F.col("n") > SMALL).select("key", "rep").join(roots, F.col("rep") == F.col("node"), "left")
    members = cut(members.select("key", "rep", F.coalesce("root", "rep").alias("root")))
    still = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return cut(members.join(still, "key", "left_semi").select("rep", "root").distinct())


def prefix_links(left: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """All links (a, b), a < b, that can be similar among ``left`` (rep, root) and are not of one root.

    Prefix filter: with every document's shingles in one order, rarest first, two documents of
    ``threshold`` share one of the first ones, which hold a share of 1 - threshold of the weight. That is
    exact, for plain and weighted similarity alike. Documents that only share common passages have
    rarer shingles of their own in front and never meet.
    """
    body = rows.select(F.col("doc_id").alias("rep"), "shingles", "tf").join(left, "rep")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for rep, root, data, tf in zip(x["rep"], x["root"], x["shingles"], x["tf"], strict=True):
                sh = np.frombuffer(data, np.uint32).astype(np.int64)
                w = weights(np.frombuffer(tf, np.uint16).astype(float)) if tf else np.ones(len(sh))
                yield pd.DataFrame({"rep": rep, "root": root, "s": sh, "w": w})

    items = cut(body.select("rep", "root", "shingles", "tf").mapInPandas(run, "rep long, root long, s long, w double"))
    often = items.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("rep").orderBy("df", "s")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("rep")
    some, share = 1 - threshold + 1e-9, threshold / (1 + threshold) - 1e-9
    first = items.join(often, "s").select(
        "rep", "root", "s", "df", F.sum("w").over(whole).alias("w"), F.count(F.lit(1)).over(whole).alias("n"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("wb"), (F.row_number().over(order) - 1).alias("nb"))
    first = cut(first.where((F.col("df") > 1) & ((F.col("wb") <= some * F.col("w")) | (F.col("nb") <= some * F.col("n")))).drop("df"))
    mixed = first.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("s")
    first = first.join(mixed, "s", "left_semi")
    x, y = (first.select("s", *[F.col(c).alias(f"{c}_{n}") for c in ("rep", "root", "w", "n", "wb", "nb")]) for n in ("a", "b"))

    def reach(size: str, gone: str) -> Column:
        # at the first shared shingle, what is left of both must still hold the overlap that similarity needs
        rest = F.least(F.col(f"{size}_a") - F.col(f"{gone}_a"), F.col(f"{size}_b") - F.col(f"{gone}_b"))
        return rest >= share * (F.col(f"{size}_a") + F.col(f"{size}_b"))

    pairs = x.join(y, "s").where("rep_a < rep_b AND root_a <> root_b").where(reach("w", "wb") | reach("n", "nb"))
    return pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def verified(links: DataFrame, rows: DataFrame, threshold: float, broadcast_ids: int = 200_000) -> DataFrame:
    """The links (a, b) whose documents in ``rows`` are similar; only their shingles are moved."""
    used = cut(links.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    body = rows.select("doc_id", "shingles", "tf")
    body = body.join(F.broadcast(used) if used.count() <= broadcast_ids else used, "doc_id", "left_semi")
    both = links.join(body.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"), F.col("tf").alias("ta")), "a")
    both = both.join(body.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"), F.col("tf").alias("tb")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            keep = [similarity(*r) >= threshold - 1e-12 for r in zip(x["sa"], x["ta"], x["sb"], x["tb"], strict=True)]
            yield x.loc[keep, ["a", "b"]]

    return both.select("a", "b", "sa", "ta", "sb", "tb").mapInPandas(run, "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the smallest id reachable over ``links`` (a, b)."""
    edges = cut(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    before = None
    while True:
        # large star, then small star: each node points to the least of its neighbours
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = large.where("x <> y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.explode(F.array(F.struct(F.col("x"), F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e"))
        edges = cut(small.select("e.x", "e.y").where("x <> y").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
        before = now


def groups(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """(doc_id, group_id) of documents with unique ids: group_id is the smallest doc_id of the document's near-duplicate group."""
    rows = cut(described(docs.select("doc_id", "text").where("doc_id IS NOT NULL")))
    reps = cut(rows.where("print IS NOT NULL").groupBy(F.col("print").alias("of")).agg(F.min("doc_id").alias("rep")))
    classes = rows.select("doc_id", "print", "shape", "bands").join(
        reps, (F.col("print") == F.col("of")) & (F.col("doc_id") == F.col("rep")), "left_semi").select(F.col("doc_id").alias("rep"), "shape", "bands")
    buckets = band_rows(classes)
    verify = lambda links: verified(links, rows, threshold)
    found = verify(cut(small_links(buckets).unionByName(star_links(buckets)).distinct()))
    found = cut(found.unionByName(same_links(classes)))
    left = unconnected(buckets, found)
    if not left.isEmpty():
        found = cut(found.unionByName(verify(cut(prefix_links(left, rows, threshold)))))
    roots = connected(found)
    named = reps.join(roots, F.col("rep") == F.col("node"), "left").select("of", F.coalesce("root", "rep").alias("root"))
    return rows.select("doc_id", "print").join(named, F.col("print") == F.col("of"), "left").select(
        "doc_id", F.coalesce("root", "doc_id").alias("group_id"))


def row_groups(docs: DataFrame, node: Column, threshold: float) -> DataFrame:
    """(node, doc_id, root, group_id, group_size, kept) per row; of rows with repeated ids."""
    named = docs.where("doc_id IS NOT NULL").select(node.alias("node"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    one = named.groupBy("node").agg(F.any_value("text").alias("text"))
    of = cut(groups(one.select(F.col("node").alias("doc_id"), "text"), threshold=threshold).select(F.col("doc_id").alias("of"), F.col("group_id").alias("root")))
    rows = cut(named.select("node", "doc_id").join(of, F.col("node") == F.col("of")).drop("of"))
    best = rows.groupBy(F.col("root").alias("g")).agg(F.min(F.struct("doc_id", "node")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(best, F.col("root") == F.col("g")).select(
        "node", "doc_id", "root", F.col("best.doc_id").alias("group_id"), "group_size", (F.col("node") == F.col("best.node")).alias("kept"))


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """One line per document: doc_id, group_id, group_size, kept; null ids are on their own."""
    node = row_nodes(docs)
    if node is None:
        of = cut(groups(docs, threshold=threshold))
        size = of.groupBy(F.col("group_id").alias("g")).agg(F.count(F.lit(1)).alias("group_size"))
        out = of.join(size, F.col("group_id") == F.col("g")).select(
            "doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("kept"))
    else:
        out = row_groups(docs, node, threshold).select("doc_id", "group_id", "group_size", "kept")
    alone = docs.where("doc_id IS NULL").select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def deduplicate(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group."""
    gone, = fresh(docs, "gone")
    node = row_nodes(docs)
    if node is None:
        of = groups(docs, threshold=threshold).where("doc_id <> group_id").select(F.col("doc_id").alias(gone)).distinct()
        return docs.join(of, F.col("doc_id") == F.col(gone), "left_anti")
    of = row_groups(docs, node, threshold).where("NOT kept").select(F.col("node").alias(gone)).distinct()
    rest = docs.join(of, F.col("doc_id").isNotNull() & (node == F.col(gone)), "left_anti").withColumn(gone, F.coalesce(node, F.lit(0)))
    alone = rest.where("doc_id IS NULL").drop(gone)
    return rest.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", gone]).drop(gone).unionByName(alone)
