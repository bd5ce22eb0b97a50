"""A stored vector index of inverted lists, and the blocked products that exact search shares with it. Nearness is the cosine.

Centres are fitted on a bounded sample (``sample_rows``); every row is indexed, under its nearest centre. How many lists a search reads is either
given as ``num_candidates`` (the nearest lists that hold at least as many rows) or was measured when the index was built: the fewest lists that
hold ``recall`` of the true neighbours of 64 sample rows, which one exact pass over all rows found. All rows of the lists
are scored exactly, with the vectors as given.

A list is a set of rows of one table, dealt by list and, where it is large, by a hash of the id, so a list that holds a third of all
rows is many tasks. Queries are a table too: each goes to the lists it reads, and is multiplied with them in blocks.

Defined results: null vectors, vectors of another length, zero vectors and such with null or non-finite components are not indexed and find nothing; rows and queries
without an id are left out; ties go to the smaller id. Rows that repeat an id are hits of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut

#: Rounding of matrix products: scores closer than this are ties, decided by id.
DIGITS = 12
#: Products that exact search holds at a time, whatever its blocks: a task's memory is bounded by it.
CELLS = 500_000
HITS = "query_id long, id long, score double, place int"
STORED = "id long, vector array<double>, list int, part int"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of NaN for zero vectors and such with non-finite components."""
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.full_like(x, np.nan), where=(n > 0) & np.isfinite(n))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) of unit vectors from a list array; a row of NaN for what is no vector of that length."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    out = np.full((len(column), dim), np.nan)
    out[fits.to_numpy(zero_copy_only=False)] = column.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return unit(out)


def nearest(
    ask: Sequence[np.ndarray], ask_ids: np.ndarray, vectors: Sequence[np.ndarray], ids: np.ndarray, k: int, exclude_self: bool, least: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score, field) of the k best rows of each query and what ties with the last of them, and each query's k-th best score.

    ask, vectors: a matrix of unit vectors for each field; the best field counts, the first at ties. least: scores below it are of no use.
    """
    score, place = None, np.zeros((len(ask_ids), len(ids)), dtype=np.int32)
    for i, (q, v) in enumerate(zip(ask, vectors, strict=True)):
        one = q @ v.T
        np.round(np.nan_to_num(one, copy=False, nan=-np.inf), DIGITS, out=one)
        if score is None:
            score = one
        else:
            better = one > score
            score[better], place[better] = one[better], i
    if exclude_self:
        score[ask_ids[:, None] == ids[None, :]] = -np.inf
    floor = np.full(len(score), -np.inf) if least is None else least
    kth = floor
    if score.shape[1] >= k:
        kth = np.maximum(floor, -np.partition(-score, k - 1, axis=1)[:, k - 1])
    q, r = np.nonzero((score >= kth[:, None]) & np.isfinite(score))
    return q, r, score[q, r], place[q, r], kth


def hits_table(ids: np.ndarray, found: np.ndarray, score: np.ndarray, place: np.ndarray) -> dict[str, pa.Array]:
    return {"query_id": pa.array(ids, pa.int64()), "id": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64()), "place": pa.array(place, pa.int32())}


def packed(df: DataFrame, dims: Sequence[int], rows: int, prefix: str) -> DataFrame:
    """Rows (id, a vector per field) in place as rows of up to ``rows`` of them: ids, and each field's unit vectors in one array."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                whole = [matrix(some.column(i + 1), d) for i, d in enumerate(dims)]
                of = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a))
                yield pa.record_batch([of(some.column(0).to_numpy(zero_copy_only=False)), *[of(x.reshape(-1)) for x in whole]], names=[f"{prefix}{i}" for i in range(len(dims) + 1)])

    schema = ", ".join([f"{prefix}0 array<long>", *[f"{prefix}{i + 1} array<double>" for i in range(len(dims))]])
    return df.mapInArrow(pack, schema)


def block_scorer(dims: Sequence[int], k: int, exclude_self: bool):
    """Blocks of vectors beside blocks of queries to hits, at most CELLS products (and k for each query) at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                values = lambda name, row=row, batch=batch: batch.column(batch.schema.get_field_index(name)).slice(row, 1).flatten().to_numpy(zero_copy_only=False)
                ids, ask_ids = values("v0"), values("q0")
                v = [values(f"v{i + 1}").reshape(-1, d) for i, d in enumerate(dims)]
                q = [values(f"q{i + 1}").reshape(-1, d) for i, d in enumerate(dims)]
                key = ask_ids.tobytes()
                step = max(k, CELLS // len(ask_ids))
                for at in range(0, len(ids), step):
                    near = ids[at:at + step]
                    a, r, s, p, least[key] = nearest(q, ask_ids, [x[at:at + step] for x in v], near, k, exclude_self, least.get(key))
                    yield pa.record_batch(hits_table(ask_ids[a], near[r], s, p))

    return run


def exact(queries: DataFrame, vectors: DataFrame, fields: int, k: int, *, exclude_self: bool, block: int, broadcast_bytes: int = 64_000_000) -> DataFrame:
    """(query_id, id, score, place) of at least the k best rows of each query, for tables (id, a vector per field).

    Vectors are packed where they lie and meet blocks of ``block`` queries there; the blocks are broadcast if they are known to be
    small, else every block of one side meets every block of the other. Neither side passes through Python on the driver.
    """
    spark = queries.sparkSession
    names = queries.columns
    size = queries.agg(F.count(F.lit(1)).alias("n"), *[F.max(F.size(F.col(c))).alias(c) for c in names[1:]]).first()
    dims = [max(1, size[c] or 1) for c in names[1:]]
    if not size["n"]:
        return spark.createDataFrame([], HITS)
    parts = max(1, -(-size["n"] // block))
    asked = packed(queries.repartition(parts, F.xxhash64(names[0])) if parts > 1 else queries.coalesce(1), dims, block, "q")
    known = packed(vectors, dims, 4096, "v")
    small = size["n"] * (8 + 8 * sum(dims)) <= broadcast_bytes
    pairs = known.crossJoin(F.broadcast(asked) if small else asked)

    return pairs.mapInArrow(block_scorer(dims, k, exclude_self), HITS)


def centres_of(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Unit centres of unit rows; distinct rows only, so that copies cannot take all lists."""
    rows = np.unique(sample, axis=0)
    lists = max(1, min(lists, len(rows)))
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), lists, replace=False)]
    for _ in range(rounds):
        of = ranked_lists(rows, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, of, rows)
        fresh = np.nan_to_num(unit(sums))
        centres = np.where(np.abs(fresh).sum(1)[:, None] > 0, fresh, rows[rng.choice(len(rows), lists)])
    return centres


def ranked_lists(x: np.ndarray, centres: np.ndarray, n: int, cells: int = 2_000_000) -> np.ndarray:
    """The n nearest lists of each row, nearest first, in blocks of at most ``cells`` products."""
    out = np.empty((len(x), min(n, len(centres))), dtype=np.int32)
    step = max(1, cells // len(centres))
    for at in range(0, len(x), step):
        near = x[at:at + step] @ centres.T
        out[at:at + step] = near.argmax(1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]
    return out


class VectorIndex:
    """An index in a folder that all executors share: ``centres``, ``vectors`` (by part, a group of lists) and ``measured`` (one row)."""

    def __init__(self, spark: SparkSession, path: str, *, parts: int = 32, list_rows: int = 50_000):
        self.spark, self.path, self.parts, self.list_rows = spark, path.rstrip("/"), parts, list_rows

    def centres(self) -> np.ndarray:
        """Bounded by the number of lists, which the sample bounds."""
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("list").toArrow()
        return np.stack(rows["vector"].to_numpy()) if rows.num_rows else np.zeros((0, 1))

    def stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(STORED).parquet(f"{self.path}/vectors")
        except AnalysisException:
            return self.spark.createDataFrame([], STORED)

    def append(self, vectors: DataFrame, id_col: str, vector_col: str) -> None:
        """Indexes more rows under the centres there are; nothing stored is read or written."""
        centres = self.centres()
        shared, dim, parts = self.spark.sparkContext.broadcast(centres), centres.shape[1], self.parts

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1), dim)
                good = np.isfinite(x).all(1)
                some = batch.filter(pa.array(good))
                of = ranked_lists(x[good], shared.value, 1)[:, 0] if good.any() else np.zeros(0, np.int32)
                yield pa.record_batch([some.column(0), some.column(1), pa.array(of, pa.int32()), pa.array(of % parts, pa.int32())], names=["id", "vector", "list", "part"])

        if not len(centres):
            return
        rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        dealt = rows.mapInArrow(assign, STORED).repartition("list", F.pmod(F.xxhash64("id"), F.lit(8)))
        dealt.sortWithinPartitions("part", "list").write.mode("append").partitionBy("part").parquet(f"{self.path}/vectors")

    def search(
        self, queries: DataFrame, query_id: str, vector: Column, k: int, *, num_candidates: int | None = None, probes: int | None = None, exclude_self: bool = False, block: int = 2048,
    ) -> DataFrame:
        """(query_id, id, score, rank): the k best of the rows in the lists that are read."""
        from .search import top_k

        centres = self.centres()
        if not len(centres):
            return self.spark.createDataFrame([], "query_id long, id long, score double, rank int")
        dim = centres.shape[1]
        rows = self.stored()
        # one row a list
        sizes = {r["list"]: r["n"] for r in rows.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
        size = np.array([sizes.get(i, 0) for i in range(len(centres))], dtype=np.int64)
        if num_candidates is None and probes is None:
            probes = self.spark.read.parquet(f"{self.path}/measured").first()["probes"]
        pieces = np.maximum(1, -(-size // self.list_rows))
        shared = self.spark.sparkContext.broadcast((centres, size, pieces))

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, size, pieces = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, block):
                    some = batch.slice(at, block)
                    x = matrix(some.column(1), dim)
                    some, x = some.filter(pa.array(np.isfinite(x).all(1))), x[np.isfinite(x).all(1)]
                    if not len(x):
                        continue
                    near = ranked_lists(x, centres, len(centres))
                    if num_candidates is None:
                        read = np.broadcast_to(np.arange(near.shape[1]) < probes, near.shape)
                    else:
                        held = np.cumsum(size[near], axis=1)
                        read = held - size[near] < num_candidates
                    read = read & (size[near] > 0)
                    q, j = np.nonzero(read)
                    lists = near[q, j]
                    q, lists = np.repeat(q, pieces[lists]), np.repeat(lists, pieces[lists])
                    # pieces of a list follow each other
                    start = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (lists[1:] != lists[:-1])])) if len(q) else np.zeros(0, np.int64)
                    piece = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate([start, [len(q)]])))
                    for lo in range(0, len(q), 16384):
                        pick = pa.array(q[lo:lo + 16384])
                        yield pa.record_batch([some.column(0).take(pick), some.column(1).take(pick), pa.array(lists[lo:lo + 16384], pa.int32()), pa.array(piece[lo:lo + 16384].astype(np.int32))], names=["query_id", "vector", "list", "piece"])

        def score(known: pa.Table, asked: pa.Table) -> pa.Table:
            out = [pa.table(hits_table(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)))]
            v = matrix(known["vector"], dim)
            ids = known["id"].to_numpy()
            for at in range(0, asked.num_rows if len(ids) else 0, block):
                some = asked.slice(at, block)
                ask_ids, least = some["query_id"].to_numpy(), None
                x = matrix(some["vector"], dim)
                for row in range(0, len(ids), 8192):
                    q, r, s, p, least = nearest([x], ask_ids, [v[row:row + 8192]], ids[row:row + 8192], k, exclude_self, least)
                    out.append(pa.table(hits_table(ask_ids[q], ids[row:row + 8192][r], s, p)))
            return pa.concat_tables(out)

        ask = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), vector.cast("array<double>").alias("vector"))
        asked = cut(ask.mapInArrow(choose, "query_id long, vector array<double>, list int, piece int"))
        lists = [r[0] for r in asked.select("list").distinct().collect()]
        if len({i % self.parts for i in lists}) < self.parts:
            rows = rows.where(F.col("part").isin(sorted({i % self.parts for i in lists})))
        rows = rows.where(F.col("list").isin(lists)) if len(lists) < len(centres) // 2 else rows
        cut_in = F.element_at(F.lit(pieces.tolist()).cast("array<int>"), F.col("list") + 1) if int(pieces.max()) > 1 else F.lit(1)
        rows = rows.withColumn("piece", F.pmod(F.xxhash64("id"), cut_in).cast("int")).select("id", "vector", "list", "piece")
        hits = rows.groupBy("list", "piece").cogroup(asked.groupBy("list", "piece")).applyInArrow(score, HITS)
        return top_k(hits, "query_id", "score", "id", k).select("query_id", "id", "score", "rank")


def build(
    vectors: DataFrame, id_col: str, vector_col: str, path: str, *, lists: int | None = None, sample_rows: int = 20_000, recall: float = 0.95, k: int = 10, sample_queries: int = 64, **options,
) -> VectorIndex:
    """A new index of ``vectors`` in ``path``: about the square root of the rows as ``lists``, a sixteenth of the sample at most."""
    spark = vectors.sparkSession
    index = VectorIndex(spark, path, **options)
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    seen = rows.agg(F.count("vector").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    n, dim = seen["n"], max(1, seen["dim"] or 1)
    some = rows.where(F.col("vector").isNotNull())
    some = some.sample(min(1.0, 1.2 * sample_rows / n), seed=5).limit(sample_rows) if n > sample_rows else some
    held = some.toArrow()
    sample = matrix(held["vector"], dim)
    good = np.isfinite(sample).all(1)
    sample, ids = sample[good], held["id"].to_numpy()[good]
    wanted = lists or int(n**0.5)
    centres = centres_of(sample, max(1, min(wanted, len(sample) // 16 or 1))) if len(sample) else np.zeros((0, dim))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, vector array<double>").coalesce(1).write.parquet(f"{path}/centres")
    index.append(vectors, id_col, vector_col)
    probes = len(centres)
    if len(centres) > 1:
        pick = np.random.default_rng(3).choice(len(sample), min(sample_queries, len(sample)), replace=False)
        asked = spark.createDataFrame([(int(ids[i]), sample[i].tolist()) for i in pick], "query_id long, vector array<double>")
        from .search import top_k

        hits = top_k(exact(asked, index.stored().select("id", "vector"), 1, k, exclude_self=True, block=sample_queries), "query_id", "score", "id", k)
        true = hits.join(index.stored().select("id", "list"), "id").select("query_id", "list").toArrow()
        order = np.argsort(ranked_lists(sample[pick], centres, len(centres)), axis=1)
        place = {int(ids[i]): row for row, i in enumerate(pick)}
        ranks = np.sort([order[place[q], of] for q, of in zip(true["query_id"].to_pylist(), true["list"].to_pylist(), strict=True)])
        probes = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else len(centres)
    spark.createDataFrame([(int(n), dim, probes)], "rows long, dim int, probes int").coalesce(1).write.parquet(f"{path}/measured")
    return index
