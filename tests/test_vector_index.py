"""The stored vector index: recall against brute force, appended rows, hot lists, odd rows; exact search in blocks."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import search, vector_index


def table(spark, ids, x):
    return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "v": pa.array([r.tolist() for r in x], pa.list_(pa.float64()))}))


def truth(x, asked, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in asked:
        s = np.round(u @ u[q], 12)
        s[q] = -9
        out[q] = [int(i) for i in np.lexsort((np.arange(len(x)), -s))[:k]]
    return out


def recall(hits, want):
    got = {}
    for r in hits.collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    return sum(len(got.get(q, set()) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["clustered", "isotropic"])
def test_recall_and_appended_rows(spark, tmp_path, kind):
    rng = np.random.default_rng(2)
    n = 2000
    x = rng.standard_normal((n, 32))
    if kind == "clustered":
        x = rng.standard_normal((40, 32))[rng.integers(0, 40, n)] * 4 + x
    df = table(spark, np.arange(n), x)
    index = vector_index.build(df.where("id < 1500"), "id", "v", str(tmp_path / "i"))
    index.append(df.where("id >= 1500"), "id", "v")
    asked = df.where("id % 50 = 0")
    want = truth(x, range(0, n, 50), 10)
    assert recall(index.search(asked, "id", F.col("v"), 10, exclude_self=True), want) >= 0.9
    assert recall(index.search(asked, "id", F.col("v"), 10, exclude_self=True, num_candidates=n), want) == 1.0
    few = recall(index.search(asked, "id", F.col("v"), 10, exclude_self=True, num_candidates=200), want)
    assert few >= 0.9 if kind == "clustered" else few > 0.2
    probes = spark.read.parquet(f"{tmp_path}/i/measured").first()["probes"]
    assert probes <= 10 or kind == "isotropic"
    exact = search.knn(asked.select(F.col("id").alias("query_id"), F.col("v").alias("query")), df, id_col="id", vector_col="v", k=10)
    assert recall(exact, want) == 1.0


def test_a_list_with_most_rows_is_dealt_to_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8))
    x[:400] = x[0]
    df = table(spark, np.arange(600), x)
    index = vector_index.build(df, "id", "v", str(tmp_path / "i"), list_rows=50, parts=4)
    hits = index.search(df.where("id in (0, 500)"), "id", F.col("v"), 5, num_candidates=600, block=1)
    got = [(r["query_id"], r["id"]) for r in hits.orderBy("query_id", "rank").collect()]
    assert got[:5] == [(0, i) for i in range(5)] and got[5] == (500, 500)


def test_rows_that_are_no_vectors(spark, tmp_path):
    inf = float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [inf, 0.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("list", F.lit("clash"))
    index = vector_index.build(df, "id", "v", str(tmp_path / "i"))
    got = [(r["query_id"], r["id"], r["rank"]) for r in index.search(df, "id", F.col("v"), 2, probes=9).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 8, 2), (2, 2, 1), (2, 8, 2), (8, 8, 1), (8, 1, 2)]
    empty = vector_index.build(df.limit(0), "id", "v", str(tmp_path / "e"))
    assert empty.search(df, "id", F.col("v"), 2).count() == 0


def test_exact_search_in_blocks_and_without_broadcast(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 6))
    df = table(spark, np.arange(300), x)
    q = df.where("id % 3 = 0")
    want = sorted((a, b) for a, bs in truth(x, range(0, 300, 3), 4).items() for b in bs)
    for block, size in ((7, 64_000_000), (16, 0)):
        hits = vector_index.exact(q, df, 1, 4, exclude_self=True, block=block, broadcast_bytes=size)
        best = search.top_k(hits, "query_id", "score", "id", 4)
        assert sorted((r["query_id"], r["id"]) for r in best.collect()) == want


def test_registered_query_reaches_its_recall(spark):
    from lodestone.plans import catalog, registry  # noqa: F401

    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    assert [r["vec_id"] for r in rows] == list(range(len(rows)))
    assert recall(registry.queries()["knn_index"](spark, folder), truth(x, range(0, len(x), 50), 10)) >= 0.9


def test_exact_search_holds_few_products_at_once():
    rng, dims = np.random.default_rng(3), [4, 4]
    v, q = rng.standard_normal((2, 4096, 4)), rng.standard_normal((2, 2048, 4))
    one = lambda x: pa.array([x.reshape(-1).tolist()])
    unit = [[vector_index.unit(m) for m in x] for x in (v, q)]
    batch = pa.record_batch({
        "v0": one(np.arange(4096)), "v1": one(unit[0][0]), "v2": one(unit[0][1]), "q0": one(np.arange(9000, 11048)), "q1": one(unit[1][0]), "q2": one(unit[1][1])})
    tracemalloc.start()
    hits = pa.Table.from_batches([*vector_index.block_scorer(dims, 5, True)(iter([batch]))]).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000  # all products at once are 67 MB for each field
    got = hits.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(5)
    each = np.stack([np.round(a @ b.T, 12) for a, b in zip(unit[1], unit[0], strict=True)])
    score = each.max(0)
    want = np.stack([np.lexsort((np.arange(4096), -s))[:5] for s in score])
    assert (got["id"].to_numpy().reshape(-1, 5) == want).all()
    assert (got["place"].to_numpy().reshape(-1, 5) == np.take_along_axis(each.argmax(0), want, 1)).all()
