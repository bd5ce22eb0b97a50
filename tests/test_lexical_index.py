"""The stored inverted index against full scoring, its pruning, its buckets, appended and broken-off segments."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical_index, search

DIR = "/root/testdata/sf0.001"


def ranked(hits, k):
    """Full scoring cut at k, ties by id."""
    return sorted(tuple(r) for r in search.top_k(hits.withColumn("score", F.round("score", 9)), "query_id", "score", "id", k).select("query_id", "rank", "id").collect())


def found(hits):
    return sorted((r["query_id"], r["rank"], r["id"]) for r in hits.collect())


@pytest.mark.parametrize("range_docs", [7, 256])
def test_same_hits_as_full_scoring_on_every_benchmark_item(spark, tmp_path, range_docs):
    docs, asked = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet")
    index = lexical_index.build(docs, "doc_id", {"text": F.col("text")}, str(tmp_path / "i"), range_docs=range_docs)
    want = ranked(search.bm25(docs, "doc_id", F.col("text"), asked, "item_id", F.col("text")), 10)
    assert len(want) > 100 and found(index.search(asked, "item_id", F.col("text"), 10)) == want
    # once built, searched again with other queries
    one = asked.select("item_id", F.substring_index("text", " ", 2).alias("text"))
    assert found(index.search(one, "item_id", F.col("text"), 3, postings_per_task=50)) == ranked(search.bm25(docs, "doc_id", F.col("text"), one, "item_id", F.col("text")), 3)


def test_scores_of_given_pairs(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    asked = docs.where("doc_id % 50 = 0 AND doc_id < 200").select("doc_id", "text")
    index = lexical_index.build(docs, "doc_id", {"text": F.col("text")}, str(tmp_path / "i"))
    full = {(r["query_id"], r["id"]): r["score"] for r in search.bm25(docs, "doc_id", F.col("text"), asked, "doc_id", F.col("text")).collect()}
    pairs = [(q, i) for q in (0, 50, 100, 150) for i in (3, 17, 60, 10_000)]
    got = {(r["query_id"], r["id"]): r["score"] for r in index.score_pairs(
        spark.createDataFrame(pairs, "query_id long, id long"), docs, "doc_id", {"text": F.col("text")}, asked, "doc_id", F.col("text")).collect()}
    assert got == {p: pytest.approx(full[p], abs=1e-8) for p in pairs if p in full} and len(got) > 6


@pytest.mark.parametrize("how", ["best", "sum"])
def test_fields_with_boosts_in_segments(spark, tmp_path, how):
    part = spark.read.parquet(f"{DIR}/part.parquet")
    texts = {"label": F.col("p_name"), "kind": F.col("p_type"), "brand": F.replace("p_brand", F.lit("#"), F.lit(" "))}
    asked = part.where("p_partkey % 10 = 0").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("q"))
    index = lexical_index.build(part.where("p_partkey % 3 = 0"), "p_partkey", texts, str(tmp_path / "i"), range_docs=16, buckets=8)
    index.append(part.where("p_partkey % 3 = 1"), "p_partkey", texts)
    index.append(part.where("p_partkey % 3 = 2"), "p_partkey", texts, blocks_per_file=50)
    boosts = {"label": 3.0, "kind": 2.0}
    got = index.search(asked, "p_partkey", F.col("q"), 5, boosts=boosts, how=how)
    full = search.search_fields(part, "p_partkey", {f: (texts[f], b) for f, b in boosts.items()}, asked, "p_partkey", F.col("q"), how=how)
    assert found(got) == ranked(full, 5)
    fields = {(r["query_id"], r["id"]): (r["field"], r["score"]) for r in full.collect()}
    for r in got.collect():
        assert r["score"] == pytest.approx(fields[r["query_id"], r["id"]][1], abs=1e-8) and r["field"] == fields[r["query_id"], r["id"]][0]


def test_only_the_terms_buckets_are_read(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    index = lexical_index.build(docs, "doc_id", {"text": F.col("text")}, str(tmp_path / "i"), buckets=16)
    bucket = spark.range(1).select(index._bucket(F.lit("text"), F.lit("the"))).first()[0]
    segments, _ = index.stats()
    rows = index._stored("postings", lexical_index.POSTINGS, segments, [bucket])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r[0].split("bucket=")[1].split("/")[0] for r in rows.select("_metadata.file_path").distinct().collect()} == {str(bucket)}


def test_ranges_out_of_reach_are_not_decoded():
    rng = random.Random(4)
    for how in ("best", "sum"):
        skipped = 0
        for _ in range(20):
            keys, fields = 12, np.array([i % 2 for i in range(12)])
            weights = np.array([[rng.choice([0, 0, 0, rng.uniform(0.5, 6)]) for _ in range(keys)] for _ in range(5)])
            ranges, docs = [], {}
            for n in range(30):
                rows, ids, part = [], [], []
                held = sorted(rng.sample(range(keys), rng.randrange(1, 4)))
                for at, key in enumerate(held):
                    for d in rng.sample(range(8), rng.randrange(1, 5)):
                        rows.append(at)
                        ids.append(n * 8 + d)
                        part.append(rng.uniform(0.01, 0.2 + 0.8 * (n == 3)))
                        docs.setdefault(n * 8 + d, {})[key] = part[-1]
                top = np.array([max(p for r, p in zip(rows, part, strict=True) if r == at) for at in range(len(held))])
                ranges.append(lexical_index.Range(np.array(held), top, lambda a=ids, b=rows, c=part: (np.array(a), np.array(a), np.array(b), np.array(c))))
            q, ids, score, field, left = lexical_index.best_hits(weights, fields, ranges, 3, how)
            skipped += left
            for i in range(5):
                full = []
                for d, parts in docs.items():
                    by = [sum(weights[i, t] * p for t, p in parts.items() if fields[t] == f) for f in (0, 1)]
                    s = max(by) if how == "best" else sum(by)
                    if s > 0:
                        full.append((-round(s, 9), d, int(by[1] > by[0])))
                got = sorted((-s, d, f) for a, d, s, f in zip(q.tolist(), ids.tolist(), score.tolist(), field.tolist(), strict=True) if a == i)[:3]
                want = sorted(full)[:3]
                assert [(d, f) for _, d, f in got] == [(d, f) for _, d, f in want] and [s for s, *_ in got] == pytest.approx([s for s, *_ in want], abs=1e-8)
        assert skipped > 100


def test_blocks_that_few_ask_for_make_no_matrix():
    """Keys that one query and one document have are added up one by one; a key of all is multiplied."""
    import tracemalloc

    rng = np.random.default_rng(3)
    keys, queries, docs = 20_000, 256, 1024
    weights = np.zeros((queries, keys), np.float64)
    weights[rng.integers(0, queries, keys), np.arange(keys)] = rng.uniform(0.5, 6, keys)
    weights[:, 0] = 1.0
    row = np.concatenate([np.zeros(docs, np.int64), np.arange(1, keys)])
    spot = np.concatenate([np.arange(docs), rng.integers(0, docs, keys - 1)])
    part = rng.uniform(0.1, 1, len(row))
    values = np.zeros((keys, docs))
    values[row, spot] = part
    want = np.sort(weights @ values, axis=1)[:, -3:]
    one = lexical_index.Range(np.arange(keys), np.ones(keys), lambda: (spot, spot, row, part))
    del values
    tracemalloc.start()
    q, _, score, _, _ = lexical_index.best_hits(weights, np.zeros(keys, np.int64), [one], 3, "best")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    assert all(np.sort(score[q == i])[-3:] == pytest.approx(want[i], abs=1e-8) for i in range(queries))


def test_odd_rows_and_empty_indexes(spark, tmp_path):
    rows = [(1, "b a"), (2, "a"), (2, "a b"), (None, "a"), (3, None), (4, ""), (5, "c c"), (7, "a b")]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1).withColumn("term", F.lit("clash"))
    index = lexical_index.build(docs, "id", {"text": F.col("text")}, str(tmp_path / "i"), range_docs=2)
    asked = spark.createDataFrame([(9, "A a b"), (8, "zzz"), (6, None), (None, "c")], "q long, text string")
    got = [(r["query_id"], r["id"]) for r in index.search(asked, "q", F.col("text"), 10).orderBy("query_id", "rank").collect()]
    assert got == [(9, 1), (9, 2), (9, 7), (9, 2)]
    # a segment whose statistics were never written does not count
    before = index.search(asked, "q", F.col("text"), 10).count()
    spark.createDataFrame([(0, "text", "a", 1, 1, 1, None, [99], [0], [1], [1], "broken", 0)], lexical_index.POSTINGS).write.mode("append").partitionBy("segment", "bucket").parquet(f"{tmp_path}/i/postings")
    assert index.search(asked, "q", F.col("text"), 10).count() == before
    empty = lexical_index.build(docs.limit(0), "id", {"text": F.col("text")}, str(tmp_path / "e"))
    assert empty.search(asked, "q", F.col("text"), 10).count() == 0
    assert lexical_index.LexicalIndex(spark, str(tmp_path / "none"), {"text": search.T.standard_tokens}).search(asked, "q", F.col("text"), 10).count() == 0


def test_full_scoring_shuffles_no_pairs(spark):
    part = spark.read.parquet(f"{DIR}/part.parquet")
    hits = search.search_fields(
        part, "p_partkey", {"a": (F.col("p_name"), 2.0), "b": (F.col("p_type"), 1.0)}, part.where("p_partkey % 50 = 0"), "p_partkey", F.concat_ws(" ", "p_name", "p_type"), how="sum")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and hits.count() > 100


@pytest.mark.parametrize("repeated", [False, True])
def test_full_scoring_of_odd_rows_against_sql(spark, repeated):
    import duckdb

    from lodestone.plans import catalog

    docs = [(1, "a b"), (2, "b b c"), (3, "C d, a"), (4, None), (5, ""), (6, "x"), (7, "a a a b")] + [(1, "a"), (1, "a a"), (2, "c b b"), (None, "a b")] * repeated
    asked = [(0, "a b"), (0, "b"), (1, "c"), (2, "b a"), (3, None), (4, "zz"), (5, "A b"), (None, "x a")]
    con = duckdb.connect()
    con.execute("CREATE TABLE docs (id BIGINT, text VARCHAR)"), con.execute("CREATE TABLE asked (query_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO docs VALUES (?, ?)", docs), con.executemany("INSERT INTO asked VALUES (?, ?)", asked)
    want = con.execute(f"SELECT query_id, id, round(score, 6) FROM {catalog.bm25_parts('docs', 'id', 'text', queries='SELECT * FROM asked')}").fetchall()
    hits = search.bm25(spark.createDataFrame(docs, "id long, text string"), "id", F.col("text"), spark.createDataFrame(asked, "query_id long, text string"), "query_id", F.col("text"), at_once=2)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = [(r["query_id"], r["id"], round(r["score"], 6)) for r in hits.collect()]
    assert len(want) > 10 and sorted(map(key, got)) == sorted(map(key, want))


def test_bm25_match_returns_every_match(spark):
    from lodestone.plans import registry

    assert registry.queries()["bm25_match"](spark, DIR).groupBy("query_id").count().where("count > 10").count() > 10


@pytest.mark.parametrize("how", ["best", "sum"])
def test_rows_of_one_text_are_indexed_once(spark, tmp_path, how):
    rng = random.Random(8)
    rows = [(i if i != 30 else None, rng.choice(["a b", "b a", "c", "a", None]), rng.choice(["x", "a", "", "c x"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "id long, u string, v string").repartition(3)
    asked = spark.createDataFrame([(1, "a x"), (2, "c"), (3, "a x"), (4, None), (5, "zz"), (6, "b a c")], "q long, text string")
    texts, boosts = {"u": F.col("u"), "v": F.col("v")}, {"u": 2.0, "v": 1.5}
    index = lexical_index.GroupedIndex(docs, "id", texts, str(tmp_path / "g"))
    assert index.texts.count() <= 20
    every = lexical_index.build(docs, "id", texts, str(tmp_path / "i"))
    for k in (1, 100):
        row = lambda hits: sorted((r["query_id"], r["rank"], r["id"], r["field"], round(r["score"], 6)) for r in hits.collect())
        want = row(every.search(asked, "q", F.col("text"), k, boosts=boosts, how=how))
        assert len(want) >= 3 * k and row(index.search(asked, "q", F.col("text"), k, boosts=boosts, how=how)) == want
