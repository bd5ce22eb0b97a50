"""A stored inverted index: built once, appended to, searched many times for the k best by BM25.

Documents are indexed in ranges of about a thousand, as they lie in a task. All postings of a term within a range are one *block* with its highest
count and shortest length, from which no document of the range can gain more than a known score by that term, whatever the corpus'
mean length has become since. Blocks are stored by a hash of their term, so a search reads the buckets of its terms alone.

A search sends the blocks of its terms to tasks by range, and the queries to all of them. A task visits its ranges in order of what they can score at most,
leaves out each query whose k-th best score so far is out of the range's reach, and does not decode a range that is in reach of none
(block-max pruning over aligned ranges). Results are exact: the same as scoring every match and cutting at k.

Folders: ``postings`` (blocks by segment and bucket), ``terms`` (document counts), ``stats`` (a row per segment and field). A segment counts
once its rows of ``stats`` are written, which happens last, so a build that breaks off leaves the index as it was.

Defined results: rows and queries without an id are left out, null and empty texts match nothing and count neither as documents nor in the mean length; rows
that repeat an id are documents of their own. Ties go to the smaller id. A query without a known term has no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut

Analyzer = Callable[[Column], Column]
K1, B = 1.2, 0.75
BLOCK = "range long, field string, term string, n int, max_tf int, min_length int, total long, ids array<long>, spots array<int>, tfs array<int>, lengths array<int>"
#: What a build stages: also how many rows a block's documents stand for.
STAGED = f"{BLOCK}, rows long"
POSTINGS = f"{BLOCK}, segment string, bucket int"
TERMS = "field string, term string, df long, segment string, bucket int"
STATS = "segment string, field string, docs long, total long"
HITS = "query_id long, id long, score double, place int"
#: Scores are compared in so many digits, so that the order of additions decides no tie.
DIGITS = 9
QUERIES_AT_ONCE = 512


def blocks_of(ids: np.ndarray, tokens: pa.ListArray, field: str, number: int, rows_of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of one range, and a row without a term that counts its documents and their lengths; rows_of: how many rows a document stands for."""
    n = len(ids)
    length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), length)
    key, tf = np.unique(key, return_counts=True)
    code, doc = key // n, key % n
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    ends = np.concatenate([first, [len(code)]]).astype(np.int32)
    size = np.diff(ends)
    of = length[doc]
    rows = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
    count = len(first)
    if count:
        yield pa.record_batch({
            "range": pa.array(np.full(count, number, np.int64)), "field": pa.array([field] * count), "term": coded.dictionary.cast(pa.string()).take(pa.array(code[first])),
            "n": pa.array(size.astype(np.int32)), "max_tf": pa.array(np.maximum.reduceat(tf, first).astype(np.int32)),
            "min_length": pa.array(np.minimum.reduceat(of, first).astype(np.int32)), "total": pa.nulls(count, pa.int64()),
            "ids": rows(ids[doc], pa.int64()), "spots": rows(doc, pa.int32()), "tfs": rows(tf, pa.int32()), "lengths": rows(of, pa.int32()), "rows": pa.array(np.add.reduceat(rows_of[doc], first), pa.int64())})
        yield pa.record_batch({
            "range": pa.array([number]), "field": pa.array([field]), "term": pa.nulls(1, pa.string()), "n": pa.array([int((length > 0).sum())], pa.int32()),
            "max_tf": pa.nulls(1, pa.int32()), "min_length": pa.nulls(1, pa.int32()), "total": pa.array([int((length * rows_of).sum())], pa.int64()),
            "ids": pa.nulls(1, pa.list_(pa.int64())), "spots": pa.nulls(1, pa.list_(pa.int32())), "tfs": pa.nulls(1, pa.list_(pa.int32())), "lengths": pa.nulls(1, pa.list_(pa.int32())),
            "rows": pa.array([int(rows_of[length > 0].sum())], pa.int64())})


def indexer(fields: Sequence[str], range_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, range_docs):
                part = batch.slice(at, range_docs)
                ids, rows_of = part.column(0).to_numpy(zero_copy_only=False), part.column(len(fields) + 1).to_numpy(zero_copy_only=False)
                for i, field in enumerate(fields):
                    yield from blocks_of(ids, part.column(i + 1), field, number, rows_of)
                number += 1

    return run


class Range:
    """The blocks of one range that some query asks for: which key each is of, its highest score part, and its postings (ids, places in the range, blocks, score parts)."""

    def __init__(self, keys: np.ndarray, bounds: np.ndarray, decode: Callable[[], tuple[np.ndarray, ...]]):
        self.keys, self.bounds, self.decode = keys, bounds, decode


def scores_of(
    keys: np.ndarray, field_of: np.ndarray, fields: int, q: np.ndarray, key: np.ndarray, w: np.ndarray, known: int, queries: int, row: np.ndarray, column: np.ndarray, part: np.ndarray, docs: int, *,
    at_once: int = 2_000_000,
) -> np.ndarray:
    """Scores (field, query, document) of one range. ``keys`` are those of its blocks, ``row``, ``column`` and ``part`` its postings' blocks, documents and score parts;
    (q, key, w) are weights by key. A block that many queries ask for and many documents hold is multiplied as a matrix, for any other each pair of a query and a posting is added up.
    """
    if len(row) > 1 and (row[1:] < row[:-1]).any():
        order = np.argsort(row, kind="stable")
        row, column, part = row[order], column[order], part[order]
    size = np.bincount(row, minlength=len(keys))
    start = np.cumsum(size) - size
    asked = np.bincount(key, minlength=known)
    before = np.cumsum(asked) - asked
    n = asked[keys]
    dense = n * size * 64 > queries * docs
    out = np.zeros((fields, queries, docs))
    for f in range(fields):
        some = np.flatnonzero(dense & (field_of[keys] == f))
        if len(some):
            of = np.full(len(keys), -1)
            of[some] = np.arange(len(some))
            mine = of[row] >= 0
            values, weights = np.zeros((len(some), docs)), np.zeros((queries, len(some)))
            values[of[row[mine]], column[mine]] = part[mine]
            at = np.arange(n[some].sum()) + np.repeat(before[keys[some]] - (np.cumsum(n[some]) - n[some]), n[some])
            weights[q[at], np.repeat(np.arange(len(some)), n[some])] = w[at]
            out[f] = weights @ values
    rest = np.flatnonzero(~dense & (n > 0))
    at = np.arange(n[rest].sum()) + np.repeat(before[keys[rest]] - (np.cumsum(n[rest]) - n[rest]), n[rest])
    block = np.repeat(rest, n[rest])
    ends = np.cumsum(size[block])
    lo = 0
    while lo < len(block):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + at_once, "right")))
        b, a = block[lo:hi], at[lo:hi]
        posting = np.arange(size[b].sum()) + np.repeat(start[b] - (np.cumsum(size[b]) - size[b]), size[b])
        to = np.repeat((field_of[keys[b]] * queries + q[a]) * docs, size[b]) + column[posting]
        out += np.bincount(to, np.repeat(w[a], size[b]) * part[posting], minlength=out.size).reshape(out.shape)
        lo = hi
    return out


def best_hits(weights: np.ndarray, field_of: np.ndarray, ranges: Sequence[Range], k: int, how: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, id, score, field) of at least the k best hits of each query, and how many ranges were not decoded.

    weights: queries x keys; field_of: field number of each key; ranges in any order.
    """
    queries, fields = len(weights), int(field_of.max(initial=0)) + 1

    def combined(parts: Sequence[np.ndarray]) -> np.ndarray:
        return np.maximum.reduce(parts) if how == "best" else np.sum(parts, axis=0)

    if not ranges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), 0
    # the weights that are not zero, by key: a query asks for few of its block's keys
    q_of, key_of = np.nonzero(weights)
    order = np.argsort(key_of, kind="stable")
    q_of, key_of = q_of[order], key_of[order]
    w_of = weights[q_of, key_of]
    cell = field_of[key_of] * queries + q_of

    def reach_of(r: Range) -> np.ndarray:
        bound = np.bincount(r.keys, r.bounds, minlength=weights.shape[1])
        return combined(np.bincount(cell, w_of * bound[key_of], minlength=fields * queries).reshape(fields, queries))

    reach = np.stack([reach_of(r) for r in ranges], axis=1)
    kth = np.full((queries, k), -np.inf)
    out: list[tuple[np.ndarray, ...]] = []
    skipped = 0
    for i in np.argsort(-reach.max(0), kind="stable").tolist():
        near = np.flatnonzero((reach[:, i] > 0) & (reach[:, i] + 10.0**-DIGITS >= kth[:, 0]))
        if not len(near):
            skipped += 1
            continue
        r = ranges[i]
        ids, spots, row, part = r.decode()
        first = np.full(spots.max() + 1, -1)
        first[spots[::-1]] = np.arange(len(spots) - 1, -1, -1)
        seen = np.flatnonzero(first >= 0)
        column, docs = np.searchsorted(seen, spots), ids[first[seen]]
        place = np.full(queries, -1)
        place[near] = np.arange(len(near))
        asking = place[q_of] >= 0
        each = np.round(scores_of(r.keys, field_of, fields, place[q_of[asking]], key_of[asking], w_of[asking], weights.shape[1], len(near), row, column, part, len(docs)), DIGITS)
        score = np.round(combined(each), DIGITS)
        q, d = np.nonzero((score > 0) & (score >= kth[near, :1]))
        out.append((near[q], docs[d], score[q, d], each.argmax(0)[q, d] if fields > 1 else np.zeros(len(q), np.int64)))
        better = np.unique(q)
        top = np.concatenate([kth[near[better]], np.where(score[better] > 0, score[better], -np.inf)], axis=1)
        kth[near[better]] = np.sort(np.partition(top, top.shape[1] - k, axis=1)[:, -k:], axis=1)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), skipped
    q, ids, score, field = (np.concatenate(c) for c in zip(*out, strict=True))
    good = score >= kth[q, 0]
    return q[good], ids[good], score[good], field[good], skipped


def scorer(k: int, how: str, means: Mapping[int, float]):
    """Cogrouped blocks (key, field_no, range, ...) and queries (query_id, keys, weights) to hits."""
    empty = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("place", pa.int32())])

    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        if not blocks.num_rows or not queries.num_rows:
            return empty.empty_table()
        blocks = blocks.take(pc.sort_indices(blocks["range"])).combine_chunks()
        number = blocks["range"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        mean = np.array([means[f] for f in blocks["field_no"].to_pylist()])
        tops = blocks["max_tf"].to_numpy() / (blocks["max_tf"].to_numpy() + K1 * (1 - B + B * blocks["min_length"].to_numpy() / mean))
        lists = {c: blocks[c].combine_chunks() for c in ("ids", "spots", "tfs", "lengths")}
        lists = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in lists.items()}
        flat = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in lists.items()}
        ends = np.concatenate([[0], np.cumsum(blocks["n"].to_numpy())])
        found = []
        for at in range(0, queries.num_rows, QUERIES_AT_ONCE):
            some = queries.slice(at, QUERIES_AT_ONCE).combine_chunks()
            keys = pa.concat_arrays([c.flatten() for c in some["keys"].chunks])
            coded = keys.dictionary_encode()
            weights = np.zeros((some.num_rows, len(coded.dictionary)))
            of = np.repeat(np.arange(some.num_rows), pc.list_value_length(some["keys"]).to_numpy())
            weights[of, coded.indices.to_numpy()] = pa.concat_arrays([c.flatten() for c in some["weights"].chunks]).to_numpy()
            field_of = np.array([int(x.split(":", 1)[0]) for x in coded.dictionary.to_pylist()])
            known = pc.fill_null(pc.index_in(blocks["key"], value_set=coded.dictionary), -1).to_numpy()

            def a_range(lo: int, hi: int, known=known) -> Range | None:
                rows = lo + np.flatnonzero(known[lo:hi] >= 0)
                if not len(rows):
                    return None

                def decode() -> tuple[np.ndarray, ...]:
                    size = ends[rows + 1] - ends[rows]
                    at = np.arange(size.sum()) + np.repeat(ends[rows] - (np.cumsum(size) - size), size)
                    row = np.repeat(np.arange(len(rows)), size)
                    tf = flat["tfs"][at]
                    return flat["ids"][at], flat["spots"][at], row, tf / (tf + K1 * (1 - B + B * flat["lengths"][at] / mean[rows][row]))

                return Range(known[rows], tops[rows], decode)

            ranges = [r for lo, hi in zip(starts, [*starts[1:], len(number)], strict=True) if (r := a_range(lo, hi)) is not None]
            q, ids, score, place, _ = best_hits(weights, field_of, ranges, k, how)
            asked = some["query_id"].to_numpy()
            found.append(pa.table({"query_id": pa.array(asked[q], pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(score), "place": pa.array(place, pa.int32())}))
        return pa.concat_tables(found)

    return run


class LexicalIndex:
    """An index in a folder that all executors share. Fields and analyzers are the caller's and must be the same at each use."""

    def __init__(self, spark: SparkSession, path: str, analyzers: Mapping[str, Analyzer], *, buckets: int = 64, range_docs: int = 1024, weight: str | None = None):
        # weight: a column of how many rows a document stands for
        self.weight = weight
        self.spark, self.path, self.analyzers, self.buckets, self.range_docs = spark, path.rstrip("/"), dict(analyzers), buckets, range_docs

    def _bucket(self, field: Column, term: Column) -> Column:
        return F.pmod(F.xxhash64(field, term), F.lit(self.buckets)).cast("int")

    def append(self, docs: DataFrame, id_col: str, texts: Mapping[str, Column], *, blocks_per_file: int = 500_000) -> str:
        """Indexes more documents as a segment of their own and returns its name. Nothing already stored is read or written."""
        segment = uuid.uuid4().hex
        fields = list(self.analyzers)
        rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), *[self.analyzers[f](texts[f]).alias(f"t{i}") for i, f in enumerate(fields)],
            (F.lit(1) if self.weight is None else F.col(self.weight)).cast("long").alias("_rows"))
        # written first: which documents share a range must not change when a task is run again
        stage = f"{self.path}/stage-{segment}"
        rows.mapInArrow(indexer(fields, self.range_docs), STAGED).write.parquet(stage)
        made = self.spark.read.schema(STAGED).parquet(stage)
        blocks = made.where("term IS NOT NULL").withColumn("segment", F.lit(segment)).withColumn("bucket", self._bucket(F.col("field"), F.col("term")))
        spread = max(1, -(-blocks.count() // (self.buckets * blocks_per_file)))
        dealt = blocks.repartition(self.buckets * spread if spread > 1 else min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "bucket", F.pmod(F.xxhash64("range"), F.lit(spread)))
        dealt.drop("rows").sortWithinPartitions("bucket", "field", "term", "range").write.mode("append").partitionBy("segment", "bucket").parquet(f"{self.path}/postings")
        count = blocks.groupBy("segment", "bucket", "field", "term").agg(F.sum("rows").cast("long").alias("df"))
        count.select("field", "term", "df", "segment", "bucket").write.mode("append").partitionBy("segment", "bucket").parquet(f"{self.path}/terms")
        known = self.spark.createDataFrame([(f,) for f in fields], "field string").join(made.where("term IS NULL").groupBy("field").agg(
            F.sum("rows").cast("long").alias("docs"), F.sum("total").alias("total")), "field", "left").fillna(0)
        known.select(F.lit(segment).alias("segment"), "field", "docs", "total").coalesce(1).write.mode("append").parquet(f"{self.path}/stats")
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return segment

    def stats(self) -> tuple[list[str], dict[str, tuple[int, float]]]:
        """Segments, and of each field how many documents have it and their mean length. A few rows a segment."""
        try:
            rows = self.spark.read.schema(STATS).parquet(f"{self.path}/stats").collect()
        except AnalysisException:
            rows = []
        out = {}
        for f in self.analyzers:
            docs = sum(r["docs"] for r in rows if r["field"] == f)
            out[f] = (docs, sum(r["total"] for r in rows if r["field"] == f) / docs if docs else 1.0)
        return sorted({r["segment"] for r in rows}), out

    def _stored(self, name: str, schema: str, segments: Sequence[str], buckets: Sequence[int]) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("segment").isin(list(segments)))
        return rows if len(buckets) >= self.buckets else rows.where(F.col("bucket").isin(list(buckets)))

    def _weighed(self, queries: DataFrame, query_id: str, query: Column, boosts: Mapping[str, float] | None, search_analyzers: Mapping[str, Analyzer] | None, broadcast_terms: int):
        """Fields, their mean lengths, segments, buckets, whether the terms are few, the terms, their weights (with df), and the weights of each query's terms; None without a field."""
        boosts = dict(boosts or {f: 1.0 for f in self.analyzers})
        segments, stats = self.stats()
        fields = [f for f in boosts if stats[f][0]]
        if not fields:
            return None
        use = {**self.analyzers, **(search_analyzers or {})}
        asked = None
        for i, f in enumerate(fields):
            of = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), F.lit(i).alias("place"), F.lit(f).alias("field"), F.explode(F.array_distinct(use[f](query))).alias("term"))
            asked = of if asked is None else asked.unionByName(of)
        asked = cut(asked.distinct().withColumn("bucket", self._bucket(F.col("field"), F.col("term"))))
        terms = asked.select("field", "term", "bucket").distinct()
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]
        few = asked.count() <= broadcast_terms
        sent = F.broadcast if few else (lambda x: x)
        df = self._stored("terms", TERMS, segments, buckets).join(sent(terms.drop("bucket")), ["field", "term"], "left_semi").groupBy("field", "term").agg(F.sum("df").alias("df"))
        docs = F.element_at(F.create_map(*[x for f in fields for x in (F.lit(f), F.lit(float(stats[f][0])))]), F.col("field"))
        boost = F.element_at(F.create_map(*[x for f in fields for x in (F.lit(f), F.lit(float(boosts[f])))]), F.col("field"))
        weight = boost * F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (K1 + 1)
        df = cut(df.select("field", "term", "df", weight.alias("weight")))
        return fields, {i: stats[f][1] for i, f in enumerate(fields)}, segments, buckets, few, terms, df, asked.join(sent(df), ["field", "term"])

    def score_pairs(
        self, pairs: DataFrame, docs: DataFrame, id_col: str, texts: Mapping[str, Column], queries: DataFrame, query_id: str, query: Column, *,
        boosts: Mapping[str, float] | None = None, how: str = "best", search_analyzers: Mapping[str, Analyzer] | None = None, broadcast_terms: int = 500_000, broadcast_pairs: int = 1_000_000,
    ) -> DataFrame:
        """(query_id, id, score) of given pairs by the index' statistics, from the documents' own texts; pairs that do not match are left out."""
        known = self._weighed(queries, query_id, query, boosts, search_analyzers, broadcast_terms)
        if known is None:
            return self.spark.createDataFrame([], "query_id long, id long, score double")
        fields, means, *_, asked = known
        pairs = cut(pairs.select(F.col("query_id").cast("long").alias("query_id"), F.col("id").cast("long").alias("id")).distinct())
        sent = F.broadcast if pairs.count() <= broadcast_pairs else (lambda x: x)
        some = docs.withColumn("_id", F.col(id_col).cast("long")).join(sent(pairs.select(F.col("id").alias("_id")).distinct()), "_id", "left_semi")
        parts = None
        for i, f in enumerate(fields):
            rows = some.select(F.col("_id").alias("id"), F.monotonically_increasing_id().alias("row"), self.analyzers[f](texts[f]).alias("t")).where(F.size("t") > 0)
            rows = rows.select("id", "row", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("id", "row", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
            of = rows.join(sent(pairs), "id").join(asked.where(F.col("place") == i).select("query_id", "term", "weight"), ["query_id", "term"])
            part = F.col("weight") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(means[i])))
            of = of.groupBy("query_id", "id", "row").agg(F.sum(part).alias("score")).groupBy("query_id", "id").agg(F.max("score").alias("score"))
            parts = of if parts is None else parts.unionByName(of)
        return parts.groupBy("query_id", "id").agg(F.round((F.max if how == "best" else F.sum)("score"), DIGITS).alias("score"))

    def search(
        self, queries: DataFrame, query_id: str, query: Column, k: int, *, boosts: Mapping[str, float] | None = None, how: str = "best",
        search_analyzers: Mapping[str, Analyzer] | None = None, broadcast_terms: int = 500_000, postings_per_task: int = 2_000_000,
    ) -> DataFrame:
        """(query_id, id, score, field, rank): the k best of an OR of the query's distinct terms over the fields named in ``boosts`` (default: all, by 1).

        how: ``best`` takes the best field's score, ``sum`` adds the fields' scores; ``field`` is the best one, the first at ties.
        """
        known = self._weighed(queries, query_id, query, boosts, search_analyzers, broadcast_terms)
        if known is None:
            return self.spark.createDataFrame([], "query_id long, id long, score double, field string, rank int")
        fields, means, segments, buckets, few, terms, df, asked = known
        sent = F.broadcast if few else (lambda x: x)
        postings = df.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        parts = max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-postings // 20_000)), -(-postings // postings_per_task))
        key = F.concat(F.col("place").cast("string"), F.lit(":"), F.col("term"))
        weighed = asked.select("query_id", key.alias("key"), "weight").groupBy("query_id").agg(
            F.collect_list(F.struct("key", "weight")).alias("w")).select("query_id", F.col("w.key").alias("keys"), F.col("w.weight").alias("weights"))
        places = F.element_at(F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(f), F.lit(i))]), F.col("field"))
        rows = self._stored("postings", POSTINGS, segments, buckets).join(sent(terms.drop("bucket")), ["field", "term"], "left_semi").withColumn("place", places)
        # ranges of different segments may carry one number
        rows = rows.select(
            F.xxhash64("segment", "range").alias("range"), key.alias("key"), F.col("place").alias("field_no"), "n", "max_tf", "min_length", "ids", "spots", "tfs", "lengths")
        rows = rows.withColumn("p", F.pmod("range", F.lit(parts)))
        to_all = weighed.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        hits = rows.groupBy("p").cogroup(to_all.groupBy("p")).applyInArrow(scorer(k, how, means), HITS)
        from .search import top_k

        name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("place") + 1)
        return top_k(hits, "query_id", "score", "id", k).select("query_id", "id", "score", name.alias("field"), "rank")


class GroupedIndex:
    """An index of distinct texts beside the table of their rows: rows of the same texts are indexed, and queries of the same text are searched, once.

    Scores are those of an index of all rows: counts of documents and lengths are weighed by how many rows a text has. A search finds the best texts,
    of which as many are kept as hold k rows, and only then their rows: of each text the k smallest ids can be among the k best.
    """

    def __init__(self, docs: DataFrame, id_col: str, texts: Mapping[str, Column], path: str, **options):
        fields = list(texts)
        rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), *[texts[f].cast("string").alias(f) for f in fields])
        spark = docs.sparkSession
        each = rows.groupBy(*fields).agg(F.count(F.lit(1)).alias("_rows"), F.min("id").alias("_first"))
        # the smallest id is the text's own
        each.write.parquet(f"{path}/texts")
        self.texts = spark.read.parquet(f"{path}/texts")
        self.rows, self.fields = rows, fields
        self.index = LexicalIndex(spark, path, {f: T.standard_tokens for f in fields}, weight="_rows", **options)
        self.index.append(self.texts, "_first", {f: F.col(f) for f in fields})

    def best_texts(self, queries: DataFrame, query_id: str, query: Column, k: int, *, boosts: Mapping[str, float] | None = None, how: str = "best") -> tuple[DataFrame, DataFrame]:
        """(query_id, class) and (class, text, score, field) of at least the texts that hold the k best rows of each class; ``text`` is the smallest id with it."""
        asked = cut(queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), query.alias("query")))
        classes = asked.groupBy("query").agg(F.min("query_id").alias("class"))
        members = asked.join(classes, "query").select("query_id", "class")
        hits = self.index.search(classes, "class", F.col("query"), k, boosts=boosts, how=how)
        return members, hits.select(F.col("query_id").alias("class"), F.col("id").alias("text"), "score", "field")

    def search(self, queries: DataFrame, query_id: str, query: Column, k: int, *, boosts: Mapping[str, float] | None = None, how: str = "best") -> DataFrame:
        """(query_id, id, score, field, rank) as ``LexicalIndex.search`` returns them."""
        from .search import top_k

        members, hits = self.best_texts(queries, query_id, query, k, boosts=boosts, how=how)
        hits = cut(hits)
        # the k smallest ids of each text that was found; a text is among the k best texts of a class if any of its rows is among the k best rows
        found = hits.select(F.col("text").alias("_first")).distinct()
        text = F.to_json(F.struct(*self.fields)).alias("_text")
        wanted = self.texts.join(found, "_first", "left_semi").select("_first", text)
        per = self.rows.select("id", text).join(wanted, "_text").select("_first", "id")
        ids = top_k(per.withColumn("_one", F.lit(1)), "_first", "_one", "id", k).select(F.col("_first").alias("text"), "id")
        rows = top_k(hits.join(ids, "text").select("class", "id", "score", "field"), "class", "score", "id", k)
        return rows.join(members, "class").select("query_id", "id", "score", "field", "rank")


def build(docs: DataFrame, id_col: str, texts: Mapping[str, Column], path: str, *, analyzers: Mapping[str, Analyzer] | None = None, **options) -> LexicalIndex:
    """A new index of ``docs`` in ``path``."""
    index = LexicalIndex(docs.sparkSession, path, {f: (analyzers or {}).get(f, T.standard_tokens) for f in texts}, **options)
    index.append(docs, id_col, texts)
    return index
