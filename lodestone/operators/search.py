"""Lexical, vector and fused retrieval over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut
from .vector_index import exact

Analyzer = Callable[[Column], Column]
K1, B = 1.2, 0.75

def top_k(hits: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each ``by`` with their ``rank``; Spark prunes to k per task before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_per(hits: DataFrame, by: str, key: str, rank: str = "rank") -> DataFrame:
    """The best-ranked hit of each key per query, ranked again."""
    best = hits.groupBy(by, key).agg(F.min_by(F.struct(*[c for c in hits.columns if c not in (by, key)]), rank).alias("r")).select(by, key, "r.*")
    return best.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(rank)))


def postings(docs: DataFrame, id_col: str, text: Column, analyzer: Analyzer = T.standard_tokens) -> DataFrame:
    """(id, term, length, tf)."""
    rows = docs.select(F.col(id_col).alias("id"), analyzer(text).alias("t")).where(F.size("t") > 0)
    return rows.select("id", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("id", "term", "length").agg(
        F.count(F.lit(1)).alias("tf"))


def _asked(queries: DataFrame, query_id: str, query: Column, analyzer: Analyzer) -> tuple[DataFrame, DataFrame]:
    """(query_id, class) and (class, term, n): queries of the same terms are one class; n is how many rows of a query hold the term."""
    terms = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(analyzer(query))).alias("term"))
    each = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "n"))).alias("w"))
    each = cut(each)
    classes = cut(each.select("w").distinct().withColumn("class", F.monotonically_increasing_id()))
    return each.join(classes, "w").select("query_id", "class"), classes.select("class", F.explode("w").alias("x")).select("class", "x.term", "x.n")


def _packed_tokens(fields: int, rows: int):
    """Rows (id, an array of tokens per field) in place as blocks of up to ``rows`` of them: ids, and each field's terms, places, counts and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                out = [one(some.column(0))]
                for i in range(fields):
                    tokens = some.column(i + 1)
                    length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                    coded = tokens.flatten().dictionary_encode()
                    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * some.num_rows + np.repeat(np.arange(some.num_rows), length)
                    key, tf = np.unique(key, return_counts=True)
                    out += [one(coded.dictionary.cast(pa.string())), *[one(pa.array(x, pa.int32())) for x in (key // some.num_rows, key % some.num_rows, tf, length)]]
                yield pa.record_batch(out, names=[f"d{i}" for i in range(len(out))])

    return run


def _block_scorer(boosts: Sequence[float], means: Sequence[float], how: str, k1: float, b: float, id_type: pa.DataType, cells: int = 2_000_000):
    """Blocks of documents beside blocks of query classes to (class, id, score, place) of all that match."""
    fields = len(boosts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda name, row=row, batch=batch: batch.column(batch.schema.get_field_index(name)).slice(row, 1).flatten()
                number = lambda name, value=value: value(name).to_numpy(zero_copy_only=False)
                ids, classes = value("d0"), number("classes")
                known = []
                for f in range(fields):
                    # places of the block's terms among the queries' terms of this field
                    asked = value(f"terms{f}")
                    at = pc.fill_null(pc.index_in(value(f"d{1 + 5 * f}"), value_set=asked), -1).to_numpy(zero_copy_only=False)[number(f"d{2 + 5 * f}")]
                    hit = at >= 0
                    used, term = np.unique(at[hit], return_inverse=True)
                    doc, tf, length = number(f"d{3 + 5 * f}")[hit], number(f"d{4 + 5 * f}")[hit], number(f"d{5 + 5 * f}")
                    part = tf / (tf + k1 * (1 - b + b * length[doc] / means[f]))
                    # weights of the classes for the terms in use
                    q, t, w = number(f"of{f}"), number(f"at{f}"), number(f"weight{f}")
                    place = np.full(len(asked), -1)
                    place[used] = np.arange(len(used))
                    near = place[t] >= 0
                    weights = np.zeros((len(classes), len(used)))
                    weights[q[near], place[t[near]]] = w[near]
                    known.append((term, doc, part, weights))
                step = max(1, min(len(ids), cells // max(1, len(classes), *[w.shape[1] for *_, w in known])))
                for lo in range(0, len(ids), step):
                    hi = min(lo + step, len(ids))
                    each = []
                    for term, doc, part, weights in known:
                        mine = (doc >= lo) & (doc < hi)
                        values = np.zeros((weights.shape[1], hi - lo))
                        values[term[mine], doc[mine] - lo] = part[mine]
                        each.append(weights @ values)
                    match = np.logical_or.reduce([e > 0 for e in each])
                    boosted = np.stack([e * x for e, x in zip(each, boosts, strict=True)])
                    # a field without a match never is the best one
                    ranked = np.where(np.stack(each) > 0, np.round(boosted, 9), -np.inf)
                    c, d = np.nonzero(match)
                    score = boosted.sum(0) if how == "sum" else np.where(np.stack(each) > 0, boosted, -np.inf).max(0)
                    yield pa.record_batch({
                        "class": pa.array(classes[c], pa.int64()), "id": ids.take(pa.array(d + lo)).cast(id_type), "score": pa.array(score[c, d]), "place": pa.array(ranked.argmax(0)[c, d], pa.int32())})

    return run


def search_fields(
    docs: DataFrame, id_col: str, fields: Mapping[str, tuple[Column, float]], queries: DataFrame, query_id: str, query: Column, *,
    how: str = "best", analyzers: Mapping[str, Analyzer] | None = None, search_analyzer: Analyzer | None = None, k1: float = K1, b: float = B,
    block: int = 4096, at_once: int = 512, broadcast_rows: int = 1_000_000, digits: int | None = None,
) -> DataFrame:
    """(query_id, id, score, field) of all matching documents over several fields, each a (text, boost): an OR of the query's distinct terms.

    how: ``best`` takes the best field's score, the first field at ties; ``sum`` adds the scores of all fields, as a boolean
    OR of clauses does. ``field`` is the field with the highest score.

    Documents are packed in blocks where they lie and scored there against blocks of queries, so neither postings nor pairs are shuffled; what is moved are
    the counts of the queries' terms. Queries of the same terms are scored once, and where ``digits`` are given their scores are rounded once. Rows that repeat an id count as one document for each length it has, and their scores add up.
    """
    names = list(fields)
    boosts = [float(boost) for _, boost in fields.values()]
    use = lambda n: (analyzers or {}).get(n, T.standard_tokens)
    rows = docs.select(F.col(id_col).alias("id"), *[use(n)(text).alias(f"t{i}") for i, (n, (text, _)) in enumerate(fields.items())])
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        return _fields_by_joins(rows, names, boosts, queries, query_id, query, how, analyzers, search_analyzer, k1, b, digits)
    each = {search_analyzer or use(n) for n in names}
    if len(each) > 1:
        return _fields_by_joins(rows, names, boosts, queries, query_id, query, how, analyzers, search_analyzer, k1, b, digits)
    members, wanted = _asked(queries, query_id, query, each.pop())
    # one row
    counted = rows.agg(*[F.count_if(F.size(f"t{i}") > 0).alias(f"n{i}") for i in range(len(names))], *[F.avg(F.when(F.size(f"t{i}") > 0, F.size(f"t{i}"))).alias(f"m{i}") for i in range(len(names))]).first()
    means = [counted[f"m{i}"] or 1.0 for i in range(len(names))]
    terms = wanted.select("term").distinct()
    found = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.array_distinct(f"t{i}").alias("t")) for i in range(len(names))])).alias("x")).select("x.f", F.explode("x.t").alias("term"))
    df = found.join(F.broadcast(terms), "term", "left_semi").groupBy("f", "term").agg(F.count(F.lit(1)).alias("df"))
    total = F.element_at(F.array(*[F.lit(float(counted[f"n{i}"])) for i in range(len(names))]), F.col("f") + 1)
    df = df.select("f", "term", (F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (k1 + 1)).alias("weight"))
    weighed = cut(wanted.join(df, "term").select("class", "f", "term", (F.col("weight") * F.col("n")).alias("weight")))
    classes = weighed.select("class").distinct().count()
    if not classes:
        return _no_hits(rows)
    asked = weighed.groupBy(F.pmod(F.xxhash64("class"), F.lit(-(-classes // at_once))).alias("p")).applyInArrow(_query_block(len(names)), ", ".join(
        ["classes array<long>", *[f"terms{i} array<string>, of{i} array<int>, at{i} array<int>, weight{i} array<double>" for i in range(len(names))]]))
    id_sql = rows.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(rows.schema["id"].dataType)
    known = rows.mapInArrow(_packed_tokens(len(names), block), ", ".join([f"d0 array<{id_sql}>", *[
        f"d{1 + 5 * i} array<string>, " + ", ".join(f"d{j + 5 * i} array<int>" for j in (2, 3, 4, 5)) for i in range(len(names))]]))
    # a table in few files is dealt to all cores: pairs are many more than rows
    cores = docs.sparkSession.sparkContext.defaultParallelism
    known = known.repartition(4 * cores) if known.rdd.getNumPartitions() < cores else known
    hits = known.crossJoin(F.broadcast(cut(asked)) if weighed.count() <= broadcast_rows else asked).mapInArrow(
        _block_scorer(boosts, means, how, k1, b, id_arrow), f"class long, id {id_sql}, score double, place int")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("place") + 1)
    # what is computed of a hit is computed before it goes to all queries of its class
    hits = hits.select("class", "id", _rounded("score", digits), name.alias("field"))
    members = cut(members)
    if members.count() > broadcast_rows:
        return hits.join(members, "class").select("query_id", "id", "score", "field")
    # a class's queries lie side by side, so that a hit goes to them without a look-up for each; null ids stay
    beside = members.groupBy("class").agg(F.flatten(F.collect_list(F.array("query_id"))).alias("_asked"))
    return hits.join(F.broadcast(beside), "class").select(F.explode("_asked").alias("query_id"), "id", "score", "field")


def _rounded(score: str, digits: int | None) -> Column:
    return F.col(score) if digits is None else F.round(score, digits).alias(score)


def _no_hits(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([], f"query_id long, id {rows.schema['id'].dataType.simpleString()}, score double, field string")


def _query_block(fields: int):
    """(class, f, term, weight) of one group as one row: its classes, and each field's terms and the weights of classes for them."""

    def run(table: pa.Table) -> pa.Table:
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        classes, of = np.unique(table["class"].to_numpy(), return_inverse=True)
        field, weight = table["f"].to_numpy(), table["weight"].to_numpy()
        out = {"classes": one(pa.array(classes, pa.int64()))}
        term = table["term"].combine_chunks()
        for i in range(fields):
            mine = np.flatnonzero(field == i)
            taken = term.take(pa.array(mine))
            coded = (taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken).dictionary_encode()
            out |= {f"terms{i}": one(coded.dictionary.cast(pa.string())), f"of{i}": one(pa.array(of[mine], pa.int32())), f"at{i}": one(coded.indices.cast(pa.int32())), f"weight{i}": one(pa.array(weight[mine]))}
        return pa.table(out)

    return run


def _fields_by_joins(rows, names, boosts, queries, query_id, query, how, analyzers, search_analyzer, k1, b, digits=None) -> DataFrame:
    """The same by joins, where rows repeat an id or fields split queries in different ways: postings of one id and length are added up, and so are the scores of an id."""
    parts = None
    for i, (n, boost) in enumerate(zip(names, boosts, strict=True)):
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct((search_analyzer or (analyzers or {}).get(n, T.standard_tokens))(query))).alias("term"))
        some = rows.select("id", F.col(f"t{i}").alias("t")).where(F.size("t") > 0)
        stats = some.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("t")).alias("mean"))
        post = some.select("id", F.size("t").alias("length"), F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
        post = post.groupBy("term", "id", "length").agg(F.count(F.lit(1)).alias("tf"))
        weight = post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(stats)).select(
            "term", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean")
        part = F.col("idf") * (k1 + 1) * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        of = post.join(weight, "term").join(asked, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"))
        of = of.select("query_id", "id", (F.col("score") * boost).alias("score"), F.lit(i).alias("place"), F.lit(n).alias("field"))
        parts = of if parts is None else parts.unionByName(of)
    best = F.max_by("field", F.struct(F.round("score", 9), -F.col("place"))).alias("field")
    return parts.groupBy("query_id", "id").agg((F.max if how == "best" else F.sum)("score").alias("score"), best).select("query_id", "id", _rounded("score", digits), "field")


def bm25(
    docs: DataFrame, id_col: str, text: Column, queries: DataFrame, query_id: str, query: Column, *,
    k1: float = K1, b: float = B, analyzer: Analyzer = T.standard_tokens, search_analyzer: Analyzer | None = None, **options,
) -> DataFrame:
    """(query_id, id, score) of all matching documents of one field: ``search_fields`` of one. Analyzers of both sides are parameters."""
    hits = search_fields(
        docs, id_col, {"text": (text, 1.0)}, queries, query_id, query, analyzers={"text": analyzer}, search_analyzer=search_analyzer, k1=k1, b=b, **options)
    return hits.drop("field")


def fused_knn(
    queries: DataFrame, vectors: DataFrame, *, id_col: str, fields: Mapping[str, Column], query_fields: Mapping[str, Column], k: int,
    exclude_self: bool = True, block: int = 2048,
) -> DataFrame:
    """Exact top-k by the best cosine over several fields: (query_id, id, score, field, rank).

    ``queries`` (query_id and what ``query_fields`` needs) in blocks of ``block`` rows meet blocks of vectors where these lie; k rows per query leave a
    task. The first field wins ties; score ties go to the smaller id. Null and zero vectors never match. Ids are whole numbers.
    """
    names = list(fields)
    side = lambda df, key, of: df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), *[of[n].cast("array<double>").alias(f"f{i}") for i, n in enumerate(names)])
    found = exact(side(queries, "query_id", query_fields), side(vectors, id_col, fields), len(names), k, exclude_self=exclude_self, block=block)
    field = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("place") + 1)
    return top_k(found, "query_id", "score", "id", k).select("query_id", "id", "score", field.alias("field"), "rank")


def knn(queries: DataFrame, vectors: DataFrame, *, id_col: str, vector_col: str, k: int, exclude_self: bool = True) -> DataFrame:
    """Exact cosine top-k of (query_id, query): (query_id, id, score, rank)."""
    return fused_knn(
        queries, vectors, id_col=id_col, fields={"vector": F.col(vector_col)}, query_fields={"vector": F.col("query")}, k=k,
        exclude_self=exclude_self).drop("field")


def hybrid(lexical: DataFrame, vector: DataFrame, *, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): scores of both (query_id, id, score) lists added, a missing one counting as zero; the k best."""
    a = lexical.select("query_id", "id", F.col("score").alias("s1"))
    b = vector.select("query_id", "id", F.col("score").alias("s2"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = a.join(b, ["query_id", "id"], "full").select("query_id", "id", (zero("s1") + zero("s2")).alias("score"))
    return top_k(both, "query_id", "score", "id", k)


def retrieve(
    mode: str, *, vector: Callable[[int], DataFrame], text: Callable[[int], DataFrame], narrow_text: Callable[[int], DataFrame],
    rerank: Callable[[DataFrame], DataFrame], gold: DataFrame | None = None, gate: float | None = None, k: int = 30,
) -> DataFrame:
    """(query_id, id, rank) by one of the retrieval modes.

    vector, text, narrow_text: k to (query_id, id, score, rank) by vectors, by all text fields, and without page content.
    rerank: ranked hits to ranked hits.
    ``vector_only``, ``es_text_only``, ``llm_only``, ``vector_with_llm_always`` are what their names say. ``oracle_gated`` re-ranks the ten
    vector hits of a query if they hold its gold id (``gold``: query_id, id), else the text hits; it reads the answer, so it is no
    honest measure. ``score_gated`` decides by the best vector score reaching ``gate`` instead.
    """
    if mode == "vector_only":
        return vector(k).select("query_id", "id", "rank")
    if mode == "es_text_only":
        return text(k).select("query_id", "id", "rank")
    if mode == "llm_only":
        return rerank(narrow_text(k))
    if mode == "vector_with_llm_always":
        return rerank(vector(k))
    near = cut(vector(10))
    if mode == "oracle_gated":
        sure = near.join(gold.select("query_id", "id"), ["query_id", "id"], "left_semi").select("query_id").distinct()
    elif mode == "score_gated":
        sure = near.groupBy("query_id").agg(F.max("score").alias("s")).where(F.col("s") >= gate).select("query_id")
    else:
        raise ValueError(f"unknown mode {mode}")
    rest = narrow_text(k).join(sure, "query_id", "left_anti")
    return rerank(near.join(sure, "query_id", "left_semi")).unionByName(rerank(rest))


MODES: Sequence[str] = ("vector_only", "es_text_only", "llm_only", "vector_with_llm_always", "oracle_gated", "score_gated")
