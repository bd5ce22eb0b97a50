"""Approximate nearest neighbours by adaptive dimension scan over probed lists.

Vectors are rotated by one random orthogonal matrix, so that a prefix of the dimensions estimates
the whole distance. They are kept in inverted lists (centres fitted on a bounded sample, every
vector indexed) and laid out in blocks of columns. A query scans its ``probes`` nearest lists
block by block. After each block a hypothesis test compares the partial distance, scaled to all
dimensions, with the distance of the k-th best so far times ``1 + epsilon / sqrt(d)``: candidates
that are larger with significance are given up; those that live through all blocks have their
exact distance, and the best k of each task are scored again on the original vectors in double
precision.

There are about sqrt(n) lists (the centres, at most ``max_lists``, and the sample they are fitted on have
documented bounds). How many of them a query probes follows from the data: ``probes_for`` searches a bounded
sample of queries by brute force over all vectors and takes the smallest number of lists that holds ``recall_target``
of their true neighbours. Clustered vectors need few lists, however many there are; vectors without
any structure need most of them, since no list then tells more than another.

Queries are many (a share of the table), so nothing about them is broadcast. Vectors and queries are packed
by list into chunks of at most CHUNK rows and meet chunk by chunk: a vector is moved once, and a query once per
probed list (and salt: lists are split by ``max_task_rows`` so that a hot list, for instance of copies, spreads over
tasks). A task holds one chunk of each side. Each pair of chunks returns k rows per query and the final k come
from an aggregate.

Equal distances differ by rounding once vectors are rotated, so a scan keeps everything within a
rounding margin of its k-th best and only the exact distances, with ties by id, cut it to k.

Defined results: vectors that are null, of another length than ``dim``, zero, or that hold null or
non-finite components take no part. Rows that repeat an id count once, the smallest vector first.
Distances tie by smaller id. A table without vectors gives an empty result; with fewer than k
candidates in the probed lists all lists are read (queries short of k are searched again
everywhere). Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BLOCK, EPSILON, CHUNK = 16, 2.1, 4096
#: Rounding of squared distances, relative to the squared lengths of both vectors.
ROUNDING = 1e-12
FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column, dim: int) -> Column:
    """True for a vector of ``dim`` finite components that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def kmeans(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of ``sample``; distinct rows only, so copies cannot take all lists."""
    rows = np.unique(sample, axis=0)
    lists = max(1, min(lists, len(rows)))
    centres = rows[np.random.default_rng(seed).choice(len(rows), lists, replace=False)]
    for _ in range(rounds):
        of = nearest_lists(rows, centres, 1)[:, 0]
        n = np.bincount(of, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, rows)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_lists(x: np.ndarray, centres: np.ndarray, n: int, cells: int = 2_000_000) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first; rows are taken in blocks of at most ``cells`` distances."""
    squares, out = (centres * centres).sum(1)[None, :], np.empty((len(x), min(n, len(centres))), dtype=np.int64)
    step = max(1, cells // max(1, len(centres)))
    for at in range(0, len(x), step):
        d = squares - 2.0 * (x[at : at + step] @ centres.T)
        out[at : at + step] = d.argmin(1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]
    return out


def scan(q: np.ndarray, columns: list[np.ndarray], bound: float, k: int, own: np.ndarray, epsilon: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions, squared distances) of the candidates that no test abandoned.

    columns: the rotated vectors in blocks of columns. bound: squared k-th best distance so far. slack: a squared distance
    that is zero but for rounding.
    """
    dim = len(q)
    alive = np.flatnonzero(~own)
    part = np.zeros(len(alive))
    seen = 0
    for block in columns:
        width = block.shape[1]
        diff = block[alive] - q[seen : seen + width]
        part += np.einsum("ij,ij->i", diff, diff)
        seen += width
        if seen < dim and math.isfinite(bound) and len(alive) > k:
            limit = bound * (seen / dim) * (1 + epsilon / math.sqrt(seen)) ** 2
            stay = part <= max(limit, slack)
            alive, part = alive[stay], part[stay]
    return alive, part


def scan_list(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, epsilon: float = EPSILON, stripe: int = 512):
    """Yields (query id, positions) of each query's k nearest in a list and what ties with the last of them; ``vectors`` are rotated."""
    dim = vectors.shape[1]
    stripes = [
        (a, [np.ascontiguousarray(vectors[a : a + stripe, b : b + BLOCK]) for b in range(0, dim, BLOCK)])
        for a in range(0, len(vectors), stripe)]
    longest = float((vectors * vectors).sum(1).max()) if len(vectors) else 0.0
    for q, qid in zip(queries, query_ids, strict=True):
        best_p, best_d = np.zeros(0, np.int64), np.zeros(0)
        bound, slack = math.inf, ROUNDING * (float(q @ q) + longest)
        for a, columns in stripes:
            p, d = scan(q, columns, bound, k, ids[a : a + stripe] == qid, epsilon, slack)
            best_p, best_d = np.concatenate([best_p, p + a]), np.concatenate([best_d, d])
            if len(best_d) >= k:
                bound = float(np.partition(best_d, k - 1)[k - 1]) + slack
                stay = best_d <= bound
                best_p, best_d = best_p[stay], best_d[stay]
        yield qid, best_p


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, dim))


def nearest_exact(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, distances), each (queries, k): brute force, ties by id; -1 where there are fewer."""
    d = np.sqrt(((queries[:, None, :] - vectors[None, :, :]) ** 2).sum(2))
    d[query_ids[:, None] == ids[None, :]] = np.inf
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
    d = np.take_along_axis(d, order, 1)
    return np.where(np.isfinite(d), order, -1), d


def probes_for(indexed: DataFrame, queries: list, centres: np.ndarray, turn: np.ndarray, dim: int, k: int, target: float) -> int:
    """The number of nearest lists that hold a share of ``target`` of the true neighbours of ``queries`` (vec_id, v).

    Brute force over all vectors for this bounded sample: a task keeps k rows per query and batch.
    """
    ask, asked = np.array([r["v"] for r in queries]), np.array([r["vec_id"] for r in queries])
    position = np.argsort(nearest_lists(ask @ turn, centres, len(centres)), axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for at in range(0, len(x), 1024):
                part = x.iloc[at : at + 1024]
                p, d = nearest_exact(ask, asked, _matrix(part["v"], dim), part["vec_id"].to_numpy(), k)
                q, c = np.nonzero(p >= 0)
                lists = part["list"].to_numpy()[p[q, c]]
                yield pd.DataFrame({"query": q, "score": d[q, c], "vec_id": part["vec_id"].to_numpy()[p[q, c]], "place": position[q, lists]})

    found = indexed.select("vec_id", "v", "list").mapInPandas(run, "query long, score double, vec_id long, place long")
    best = found.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id", "place"))), 1, k).alias("best")).collect()
    places = np.sort([f["place"] for r in best for f in r["best"]])
    return 1 if not len(places) else int(places[min(len(places) - 1, math.ceil(target * len(places)) - 1)]) + 1


def search(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 10,
    dim: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    recall_target: float = 0.96,
    sample_queries: int = 64,
    max_lists: int = 16_384,
    sample_rows: int = 20_000,
    max_task_rows: int = 200_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` that ``is_query`` picks, against all rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where("vec_id IS NOT NULL")
    if dim is None:
        sizes = rows.where("v IS NOT NULL").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = sizes["d"] if sizes else 0
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dim:
        return empty
    good = rows.where(usable(F.col("v"), dim)).groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    good = cut(good)
    n = good.count()
    if not n:
        return empty
    # samples: the rows with the smallest digests of their ids, at most sample_rows and sample_queries
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").collect()
    turn = rotation(dim)
    lists = max(1, min(max_lists, round(math.sqrt(n)), len(sample) // 4))
    centres = kmeans(np.array([r["v"] for r in sample]) @ turn, lists)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                x["list"] = nearest_lists(_matrix(x["v"], dim) @ turn, centres, 1)[:, 0].astype("int32")
                yield x[["vec_id", "v", "list", "q"]]

    indexed = cut(good.mapInPandas(assign, "vec_id long, v array<double>, list int, q boolean"))
    asking = indexed.where("q").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_queries).select("vec_id", "v").collect()
    if not asking:
        return empty
    probes = probes_for(indexed, asking, centres, turn, dim, k, recall_target)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                x["lists"] = list(nearest_lists(_matrix(x["v"], dim) @ turn, centres, probes).astype("int32"))
                yield x[["vec_id", "v", "lists"]]

    wanted = cut(indexed.where("q").select("vec_id", "v").mapInPandas(route, "vec_id long, v array<double>, lists array<int>"))
    sizes = indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n"))  # at most max_lists rows
    splits = F.broadcast(cut(sizes.select("list", F.ceil(F.col("n") / max_task_rows).cast("int").alias("splits"))))
    dealt = indexed.join(splits, "list").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("splits")).cast("int"))
    data = chunks(dealt, dim)

    def probe(queries: DataFrame) -> DataFrame:
        asked = queries.join(splits, "list").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
        return _probed(data, chunks(asked, dim), turn, dim, k)

    first = probe(wanted.select("vec_id", "v", F.explode("lists").alias("list")))
    best = cut(_top(first, k))
    full = best.where(F.size("found") >= min(k, n - 1))
    again = wanted.join(full.select("query_id"), F.col("vec_id") == F.col("query_id"), "left_anti")
    everywhere = again.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(len(centres) - 1))).alias("list"))
    rest = _top(probe(everywhere), k)
    best = full.unionByName(rest)
    return best.select(
        "query_id", F.posexplode("found").alias("rank", "f")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def chunks(rows: DataFrame, dim: int) -> DataFrame:
    """(list, salt, ids, vectors): the rows (list, salt, vec_id, v) of each list and salt, at most CHUNK in a row, as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> Iterator[pd.DataFrame]:
            if held:
                x = pd.concat(held)
                held.clear()
                for (of, salt), part in x.groupby(["list", "salt"], sort=False):
                    for at in range(0, len(part), CHUNK):
                        p = part.iloc[at : at + CHUNK]
                        yield pd.DataFrame({"list": [of], "salt": [salt], "ids": [p["vec_id"].to_numpy("<i8").tobytes()], "vectors": [_matrix(p["v"], dim).tobytes()]})

        for x in batches:
            held.append(x)
            if sum(map(len, held)) >= 8 * CHUNK:
                yield from flush()
        yield from flush()

    dealt = rows.select("list", "salt", "vec_id", "v").repartition("list", "salt").sortWithinPartitions("list", "salt")
    return dealt.mapInPandas(run, "list int, salt int, ids binary, vectors binary")


def _probed(data: DataFrame, asked: DataFrame, turn: np.ndarray, dim: int, k: int) -> DataFrame:
    """Each pair of chunks' best k per query."""
    ask = asked.select("list", "salt", F.col("ids").alias("asked"), F.col("vectors").alias("queries"))
    pairs = data.join(ask, ["list", "salt"]).select("ids", "vectors", "asked", "queries")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for data_ids, vectors, asked_ids, queries in zip(x["ids"], x["vectors"], x["asked"], x["queries"], strict=True):
                ids, exact = np.frombuffer(data_ids, "<i8"), np.frombuffer(vectors, np.float64).reshape(-1, dim)
                qids, q = np.frombuffer(asked_ids, "<i8"), np.frombuffer(queries, np.float64).reshape(-1, dim)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for at, (qid, p) in enumerate(scan_list(q @ turn, qids, exact @ turn, ids, k)):
                    d = exact[p] - q[at]
                    d = np.sqrt((d * d).sum(1))
                    order = np.lexsort((ids[p], d))[:k]
                    out.append((np.full(len(order), qid), ids[p][order], d[order]))
                yield pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("query_id", "vec_id", "score"))})

    return pairs.mapInPandas(run, FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    """(query_id, found): the k best of a query's few hundred rows (k per probed list and salt)."""
    return found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("found"))


def recall(vectors: np.ndarray, ids: np.ndarray, found: dict[int, list[int]], k: int) -> float:
    """Share of the true k nearest that ``found`` holds, by brute force over the rows given."""
    hit = total = 0
    for i, got in found.items():
        d = np.sqrt(((vectors - vectors[ids == i][0]) ** 2).sum(1))
        order = np.lexsort((ids, np.where(ids == i, np.inf, d)))[: min(k, len(ids) - 1)]
        hit, total = hit + len(set(ids[order].tolist()) & set(got)), total + len(order)
    return hit / max(1, total)
