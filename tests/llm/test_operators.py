"""Small cases of every operator: nulls, ties, repeats, empty tables, clashing columns, and brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, language_id, mixing, near_dedup, packing, quality, toxicity, url_filter, vectors, warc

DOCS = "doc_id long, text string, lang string, source string"


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16))
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(300)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, rows[5][1], 0), (5, rows[5][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = vectors.search(df, F.col("vec_id") % 100 == 5).orderBy("query_id", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(found) == {5, 105, 205}
    assert all(len(v) == 10 for v in found.values()) and found[5][0] == 303 and got[0]["score"] == 0.0
    every = np.concatenate([x, x[5:6]])
    assert vectors.recall(every, np.array([*range(300), 303]), found, 10) >= 0.9


def test_nearest_of_nothing_and_of_few(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.search(df, F.lit(True)).count() == 0
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in vectors.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 2)]
    assert all(math.isclose(g[3], math.sqrt(2)) for g in got)


def test_exact_copies(spark):
    long = "word, " * 5000
    rows = [(1, "a b", "en", "s"), (2, "ab", "en", "s"), (3, None, None, None), (4, "", "en", "s"), (5, long, "en", "s"), (6, long + " ", "en", "s")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in exact_dedup.find_copies(df).collect()}
    assert [got[i]["keep_id"] for i in range(1, 7)] == [1, 1, 3, 3, 6, 6]
    assert got[2]["text_sha256"] == hashlib.sha256(b"ab").hexdigest() and got[2]["group_size"] == 2
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(df.withColumn("n", F.lit(1))).collect()) == [1, 3, 6]
    assert exact_dedup.find_copies(df.limit(0)).count() == 0


def shingles(t):
    w = re.findall(r"\w+", t.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(12)]
    for t in texts[:6]:
        w = t.split()
        w[60] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", "one two", "one two"]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)
    sets, root = [shingles(t or "") for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicates(df).collect()} == dict(enumerate(root))


def test_large_buckets_lose_no_link(spark):
    """Texts that share a long passage, and groups of copies within them, all taken for one bucket."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(8):
        own = [word() for _ in range(40)]
        texts += [" ".join(passage + own[:39] + [f"x{j}"]) for j in range(3)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)
    left = spark.createDataFrame([(i, i) for i in range(24)], "rep long, root long")
    rows = near_dedup.described(df)
    links = near_dedup.prefix_links(left, rows, 0.8)
    found = {(r["a"], r["b"]) for r in near_dedup.verified(links, rows, 0.8).collect()}
    sets = [shingles(t) for t in texts]
    assert found == {(a, b) for a, b in itertools.combinations(range(24), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert links.count() == len(found) == 24
    assert {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicates(df).collect()} == {i: i // 3 * 3 for i in range(24)}


def test_repeated_passages_are_near_copies(spark):
    """Texts pasted several times, and those with a word changed: plain similarity alone makes them near copies."""
    rng = random.Random(12)
    texts = []
    for _ in range(12):
        words = rng.choices([f"w{i}" for i in range(2000)], k=150)
        changed = [*words[:-1], "changed"]
        texts += [" ".join(words), " ".join(words * 2), " ".join(words * 8), " ".join(changed * 16)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)
    assert {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicates(df).collect()} == {i: i // 4 * 4 for i in range(48)}


def test_equal_shingle_sets_are_near_copies(spark):
    texts = ["one two three four five " * 2, "one two three four five " * 40, "one two three four five " * 9]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)
    assert {r["group_id"] for r in near_dedup.near_duplicates(df).collect()} == {0}


def test_mixture(spark):
    rows = [(i, "a b c d", "en" if i % 3 else None, f"s{i % 2}") for i in range(60)]
    df = spark.createDataFrame(rows, DOCS).withColumn("mix", F.lit(1))
    got = mixing.sample_mixture(df, targets={"source": {"s0": 0.5, "s1": 0.5}})
    assert got.count() == 60 and got.columns[-1] != "mix"
    assert mixing.sample_mixture(df.limit(0)).count() == 0


def test_mixture_rakes_every_source(spark, monkeypatch):
    """More sources than one row may hold: all keep their own targets, as in the fold over one row."""
    monkeypatch.setattr(mixing, "ROUNDS", 3)
    rng = random.Random(8)
    rows = [(i, " ".join(["a"] * rng.randrange(1, 30)), rng.choice(["en", "de", None]), f"s{i % 12}") for i in range(240)]
    df = spark.createDataFrame(rows, DOCS)
    read = lambda out: {r["doc_id"]: r["mix"] for r in out.collect()}
    wanted = {"source": {f"s{i}": i + 1.0 for i in range(12)}}
    for targets in (None, wanted):
        one, many = (read(mixing.sample_mixture(df, targets=targets, max_steps=m)) for m in (20_000, 3))
        assert len(many) == 240
        for i in one:
            assert math.isclose(one[i]["share"], many[i]["share"], rel_tol=1e-9) and math.isclose(one[i]["probability"], many[i]["probability"], rel_tol=1e-9)
            assert (one[i]["sampled"], one[i]["tokens"], one[i]["topic"]) == (many[i]["sampled"], many[i]["tokens"], many[i]["topic"])
    cells = {(r[3], r[2]): many[r[0]]["share"] for r in rows}
    share = {f"s{i}": sum(v for (s, _), v in cells.items() if s == f"s{i}") for i in range(12)}
    assert all(math.isclose(share[f"s{i}"], (i + 1) / 78, abs_tol=0.01) for i in range(12))


def test_quality(spark):
    good = [(i, "the cat sat on the mat and the dog sat too", "en", "s") for i in range(20)]
    df = spark.createDataFrame([*good, (20, "zq xv kk jj ww", "en", "s"), (21, None, None, "s"), (22, "!!", "en", "s")], DOCS)
    got = {r["doc_id"]: r for r in quality.classify(df, F.col("doc_id") < 10, quantile=0.9).collect()}
    assert got[15]["kept"] and not got[20]["kept"] and not got[21]["kept"] and got[22]["perplexity"] is None
    assert quality.classify(df, F.lit(False)).where("kept").count() == 21


def test_quality_rejects_as_many_as_are_bad(spark):
    rng = random.Random(6)
    good = [f"g{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choices(good, k=30)), "en", "s") for i in range(120)]
    rows += [(i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(30)), "en", "s") for i in range(120, 200)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["kept"] for r in quality.classify(df, F.col("doc_id") < 80).collect()}
    assert not any(got[i] for i in range(120, 200)) and sum(got[i] for i in range(80, 120)) >= 30


def test_toxicity(spark):
    rng = random.Random(2)
    plain = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(300):
        w = rng.choices(plain, k=20)
        if i % 3 == 0:
            w[3] = w[9] = "vile"
        rows.append((i, " ".join(w), "en", "s"))
    df = spark.createDataFrame([*rows, (300, None, "en", "s")], DOCS).withColumn("toxic", F.when(F.col("doc_id") < 300, (F.col("doc_id") % 3 == 0).cast("int")))
    fold = F.col("doc_id") % 5
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, fold > 1, fold == 1, F.col("toxic")).collect()}
    held = [i for i in range(0, 300, 5)]
    assert len(got) == 301 and sum((got[i] >= 0.5) == (i % 3 == 0) for i in held) >= 0.9 * len(held)


def test_packing_round_trip(spark):
    rng = random.Random(1)
    texts = [None, "", "x", *[" ".join(rng.choices(["alpha", "beta", "gamma", "été"], k=rng.randrange(1, 900))) for _ in range(20)]]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)
    got = packing.pack(df).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert set(by_doc) == set(range(len(texts)))
    for pieces in by_doc.values():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == total
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_statistics_cover_all_shards(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randrange(1, 9))) for _ in range(40)] + [None, ""]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS).repartition(5)
    path = packing.default_tokenizer()
    tokens = [set(np.frombuffer(t, "<u4").tolist()) for t in packing.encoder(path).encode(texts)]
    lengths = [len(t) // 4 for t in packing.encoder(path).encode(texts)]
    got = packing.statistics(df.select("doc_id", "text").mapInArrow(lambda b: packing.encode_rows(b, path), packing.TOKENS))
    assert got.docs == 42 and math.isclose(got.mean, sum(lengths) / 42)
    assert {i: int(n) for i, n in enumerate(got.df) if n} == {i: sum(i in t for t in tokens) for i in set().union(*tokens)}
    # 7 is rarer than 8 in the shard, but common in the corpus
    docs = [np.array(d, dtype="<u4") for d in ([7, 8, 0], [7, 9, 0], [8, 9, 0], [8, 9, 0])]
    held = np.array([1000, *[0] * 6, 900, 3, 500])
    order = list(dict.fromkeys(p[0] for p in packing.pack_shard(docs, packing.Statistics(held, 1000, 3.0))))
    assert order == [0, 2, 3, 1]


def test_packing_fills_windows_with_all_neighbours():
    seed = np.array([*range(100, 140), 0], dtype="<u4")
    apart = [np.array([200 + i, 300 + i], dtype="<u4") for i in range(20)]
    # each shares one term with the seed: more documents than twelve, more terms than sixteen
    related = [np.array([100 + i, 400 + i], dtype="<u4") for i in range(40)]
    docs = [seed, *apart, *related]
    corpus = packing.Statistics(np.bincount(np.concatenate(docs)), len(docs), np.mean([len(d) for d in docs]))
    order = list(dict.fromkeys(p[0] for p in packing.pack_shard(docs, corpus)))
    assert order[0] == 0 and set(order[1:41]) == set(range(21, 61)) and order[41:] == list(range(1, 21))


def test_url_rules(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7")]
    urls = [None, "nothing", "http://A.Example.com/en/71?x", "http://b.com/en/7", "http://examplecom/en/7"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, rules).collect()}
    assert got == {0: ("", None, "allow"), 1: ("", None, "allow"), 2: ("a.example.com", "example.com/en/7", "allow"), 3: ("b.com", "com/en/", "block"), 4: ("examplecom", None, "allow")}


def test_language(spark):
    en, de = "the cat and the house with this", "der hund und das haus mit dieser"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", "s") for i in range(60)]
    df = spark.createDataFrame([*rows, (60, None, None, "s"), (61, "123 !!", None, "s")], DOCS)
    model = language_id.train(df)
    got = {r["doc_id"]: r["p"]["lang"] for r in df.select("doc_id", language_id.predictor(spark, model)("text").alias("p")).collect()}
    assert got[1] == "en" and got[2] == "de" and got[60] == "und" and got[61] == "und"


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "x"), (2, "http://b/", "x"), (3, "http://c/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(df).collect()}
    assert got == {1: (1, "revisit", 2), 2: (1, "response", None), 3: (0, "response", None)}
