"""Run detection, byte-level BPE and the filter audit against brute force, and their defined results in odd cases."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, filter_audit, queries, runs

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


def plain_runs(x, min_length, min_exponent):
    """Every stretch that some period keeps, with its smallest one, by extension from each place."""
    n, best = len(x), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            if j > i and j + p - i >= max(min_length, min_exponent * p):
                best.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e, p) for (s, e), p in best.items())


@pytest.mark.parametrize("seed", range(6))
def test_all_repetitions_against_plain_extension(seed):
    rng = random.Random(seed)
    for _ in range(250):
        n, k = rng.randrange(0, 70), rng.choice([1, 2, 2, 3, 4])
        x = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5:
            root = [rng.randrange(k) for _ in range(rng.randrange(1, 9))]
            x[rng.randrange(n + 1):0] = root * rng.randrange(2, 6)
        for length, exponent in ((2, 2), (6, 3), (24, 3)):
            assert runs.runs(x, length, exponent) == plain_runs(x, length, exponent)


def test_factors_are_the_longest_that_began_earlier():
    rng = random.Random(1)
    for _ in range(200):
        x = [rng.randrange(3) for _ in range(rng.randrange(1, 60))]
        at = 0
        for start, end, earlier in runs.factors(x):
            assert start == at
            at = end
            occurs = lambda m, s=start: any(x[i:i + m] == x[s:s + m] for i in range(s))
            assert x[earlier:earlier + end - start] == x[start:end] and earlier < start if earlier >= 0 else end == start + 1 and not occurs(1)
            assert end == len(x) or earlier < 0 or not occurs(end - start + 1)
        assert at == len(x)


def test_areas_lose_no_run():
    rng = random.Random(2)
    texts = []
    for _ in range(120):
        words = [rng.choice(["a", "b", "cc", "é", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            root = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 14))]
            words[rng.randrange(len(words) + 1):0] = (root * 9)[:rng.randrange(20, 70)]
        texts.append(rng.choice([" ", "\t\n", "\x0b"]).join(words))
    texts += ["", None, " \n "]
    found, left = runs.found_in(texts, 24, 3)
    assert sum(map(len, found)) > 60
    for t, rs, c in zip(texts, found, left, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want = plain_runs(words, 24, 3)
        assert [(r["start"], r["start"] + r["length"], r["period"]) for r in rs] == want
        gone = {i for s, e, p in want for i in range(s + p, e)}
        assert c.decode() == " ".join(w for i, w in enumerate(words) if i not in gone)


def run_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    rs = [(s, e - s, p) for s, e, p in plain_runs(words, 24, 3)]
    gone = {i for s, m, p in rs for i in range(s + p, s + m)}
    best = min(rs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(rs), *best, best[1] * 1000 // best[2] if rs else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in rs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11_against_brute_force(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect() if len((r["text"] or "").split()) < 3000]
    got = {r["doc_id"]: tuple(r) for r in queries.op11_runs(spark, DIR).collect()}
    assert len(got) >= len(texts) and any(r[1] for r in got.values())
    for i, t in texts:
        assert got[i] == run_row(i, t)


def test_runs_of_odd_rows(spark, tmp_path):
    periodic = " ".join(["x y z"] * 4000)
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, periodic, "en", "s"), (3, periodic, "en", "s"), (None, "a " * 30, "en", "s"), (5, " \t", None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("periodic", F.lit(1))
    out = runs.find_runs(df)
    assert out.columns == [*df.columns, "_periodic"] and runs.find_runs(df.limit(0)).count() == 0
    got = sorted((r["doc_id"] or 0, [tuple(x) for x in r["_periodic"]["runs"]], r["_periodic"]["collapsed"]) for r in out.collect())
    assert got == [(0, [(0, 30, 1)], "a"), (1, [], ""), (2, [], ""), (3, [(0, 12000, 3)], "x y z"), (3, [(0, 12000, 3)], "x y z"), (5, [], "")]
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_runs(spark, str(tmp_path)).count() == 6


def test_tied_runs_and_large_exponents(spark):
    found = [(40, 30, 3), (0, 30, 3), (100, 24, 4)]
    df = spark.createDataFrame([([{"start": s, "length": m, "period": p} for s, m, p in found],), ([],)], "runs array<struct<start: bigint, length: bigint, period: bigint>>")
    got = [r[0] and tuple(r[0]) for r in df.select(runs.longest_exponent(F.col("runs"))).collect()]
    assert got == [(0, 30, 3), None]


ODD = [
    "", None, "a", " ", "  a  b   ", "\n\n x\t\ty\r\n", "don't it's WE'LL 'sx", "héllo wörld 日本語のテキスト これはペンです", "x\x00y\x85z  w q", "😀😀 👩‍👩‍👧 <|endoftext|>", "123 4567.89%", "thouinor ononedth", "a" * 300,
    "zqxjkvbw" * 40, "　　語 ", "İıſK ²³½ ⅷ ٣", "﻿x", "é́ नमस्ते दुनिया", " " * 50, "\x1c\x1d a\x1f", "word " * 5000]


def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("cached", [0, 50])
def test_ids_are_the_librarys(spark, cached):
    ranks = byte_bpe.read_ranks(byte_bpe.default_ranks())
    whole = library(ranks)
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(ODD)], DOCS).withColumn("ids", F.lit("clash"))
    out = byte_bpe.encode(df, ranks, byte_bpe.default_pattern(), cached_words=cached)
    assert out.columns == [*df.columns, "_ids"]
    for r in out.withColumn("back", byte_bpe.decode(F.col("_ids"), ranks)).collect():
        assert r["_ids"] == whole.encode_ordinary(r["text"] or "") and bytes(r["back"]) == (r["text"] or "").encode()
    assert byte_bpe.encode(df.limit(0), ranks, byte_bpe.default_pattern(), cached_words=cached).count() == 0


def test_op12_against_the_library(spark):
    ranks = byte_bpe.read_ranks(byte_bpe.default_ranks())
    whole = library(ranks)
    got = {r["doc_id"]: tuple(r) for r in queries.op12_byte_bpe(spark, DIR).collect()}
    texts = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    assert len(got) == len(texts)
    for r in texts:
        text = r["text"] or ""
        ids = whole.encode_ordinary(text)
        assert got[r["doc_id"]] == (r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_swaps_visit_every_order_once():
    for n in range(7):
        order, seen = list(range(n)), []
        seen.append(tuple(order))
        for k in filter_audit.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_walk_against_filtering_in_each_order():
    rng = np.random.default_rng(3)
    documents = rng.integers(0, 50, (3, 16))
    good, toxic = documents // 3, documents // 5
    got = filter_audit.report(["a", "", "c"], documents, good, toxic, "PQRS")
    assert len(got) == 3 * 24 * 4
    for part, rows in got.groupby("part"):
        at = ["a", "", "c"].index(part)
        total = {f: 0 for f in "PQRS"}
        for order, steps in rows.groupby("filter_order"):
            alive = set(range(16))
            for name, s in zip(order, steps.sort_values("step").to_dict("records"), strict=True):
                bit = 1 << "PQRS".index(name)
                gone = {m for m in alive if m & bit}
                old = [m for m in range(16) if m & bit and m not in alive]
                alive -= gone
                count = lambda ms, of=documents: int(sum(of[at, m] for m in ms))
                assert (s["kept"], s["removed"], s["redundant"], s["unique_fails"]) == (count(alive), count(gone), count(old), count([bit]))
                assert (s["good_lost"], s["toxic_lost"]) == (count(gone, good), count(gone, toxic))
                total[name] += count(gone)
        assert all(s["shapley"] == total[s["filter_order"][s["step"] - 1]] for s in rows.to_dict("records"))


def test_audit_against_sql_and_in_odd_cases(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [
        (1, long, "en", "a"), (2, long, "en", "b"), (2, long, "de", None), (3, "A A A", "en", "a"), (4, None, "en", "a"), (5, "", "en", "a"), (None, "", "en", "a"), (6, "x $", "en", "b"),
        (7, "word " * 300, "en", "b"), (1, long, "en", "a"), (9, "É\x0bÄ\x1cB", "en", ""), (10, long + " #", "en", "a"), (11, long * 200, "en", "c")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 0, 1), (99, 1, 1), (5, None, None), (None, 1, 1), (7, 1, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("mask", F.lit("clash")).withColumn("part", F.lit(9))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.op13_filter_audit(spark, str(tmp_path))
    want = con.execute(filter_audit.ORACLE)
    names = [c[0] for c in want.description]
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
    empty = filter_audit.audit_documents(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert empty.count() == 0


def test_op13_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS FROM '{DIR}/{t}.parquet'")
    assert sorted(tuple(r) for r in queries.op13_filter_audit(spark, DIR).collect()) == sorted(con.execute(filter_audit.ORACLE).fetchall())


def test_archives_that_end_within_a_member():
    import gzip
    import io

    from lodestone.llm import warc

    good = gzip.compress(b"abc" * 50)
    assert list(warc.members(io.BytesIO(good + good))) == [b"abc" * 50] * 2
    for n in (1, 5, 11, len(good) - 1):
        with pytest.raises(ValueError):
            list(warc.members(io.BytesIO(good + good[:n])))


def test_nearest_centres_in_blocks_of_rows():
    from lodestone.llm import vectors

    rng = np.random.default_rng(1)
    x, centres = rng.standard_normal((300, 5)), rng.standard_normal((40, 5))
    d = ((x[:, None] - centres[None]) ** 2).sum(2)
    for n in (1, 7, 99):
        assert (vectors.nearest_lists(x, centres, n, cells=400) == np.argsort(d, axis=1, kind="stable")[:, :n]).all()


def test_training_rows_are_bounded_in_bytes(spark):
    from lodestone.llm import language_id

    rows = [(i, "wort " * 20 if i % 2 else "word " * 20, "de" if i % 2 else "en", "s") for i in range(40)] + [(99, "x" * 5000, "en", "s")]
    df = spark.createDataFrame(rows, DOCS)
    texts, _ = language_id.training_rows(df, F.lit(True), rows_per_language=100, max_rows=100, max_bytes=64_000)
    assert len(texts) == 40
    texts, _ = language_id.training_rows(df, F.lit(True), rows_per_language=100, max_rows=100, max_bytes=1_000)
    assert not texts
    texts, langs = language_id.training_rows(df, F.lit(True), rows_per_language=100, max_rows=30, max_bytes=64_000)
    assert len(texts) == 30 and set(langs) == {"de", "en"}


def plain_ftrl(rows, langs, epochs, alpha, beta, l1, l2, seed):
    """One coordinate at a time, from the published update rule; features are dictionaries of (feature: share)."""
    import math

    train = [r for i, r in enumerate(rows) if i % 5]
    df = {}
    for x, _ in train:
        for f in x:
            df[f] = df.get(f, 0) + 1
    idf = lambda f: math.log((1 + len(train)) / (1 + df.get(f, 0))) + 1
    z, n = {}, {}

    def weight(key, l1, l2):
        if abs(z.get(key, 0.0)) <= l1:
            return 0.0
        return -(z[key] - math.copysign(l1, z[key])) / ((beta + math.sqrt(n[key])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(train)):
            x, y = train[k]
            x = {None: 1.0, **{f: v * idf(f) * 64.0 for f, v in x.items()}}
            w = {(f, c): weight((f, c), l1, l2) for f in x for c in range(len(langs))}
            s = [sum(v * w[f, c] for f, v in x.items()) for c in range(len(langs))]
            e = [math.exp(v - max(s)) for v in s]
            for f, v in x.items():
                for c in range(len(langs)):
                    g = v * (e[c] / sum(e) - (c == y))
                    key = (f, c)
                    sigma = (math.sqrt(n.get(key, 0.0) + g * g) - math.sqrt(n.get(key, 0.0))) / alpha
                    z[key] = z.get(key, 0.0) + g - sigma * w[key]
                    n[key] = n.get(key, 0.0) + g * g
    return {key: weight(key, l1, l2) * (1 if key[0] is None else idf(key[0])) for key in z}


def test_training_against_plain_loops():
    from lodestone.llm import language_id

    rng = random.Random(5)
    vocabulary = {"de": "der die das und nicht ist".split(), "en": "the and not is of it".split(), "fr": "le la et est pas de".split()}
    labels = [rng.choice(sorted(vocabulary)) for _ in range(30)]
    texts = [" ".join(rng.choices(vocabulary[y], k=6)) for y in labels]
    options = {"epochs": 2, "alpha": 0.3, "beta": 1.0, "l1": 1e-3, "l2": 1e-2, "seed": 4}
    model = language_id.fit(texts, labels, **options)
    rows = [(dict(zip(*(a.tolist() for a in language_id.counts(t)), strict=True)), model.langs.index(y)) for t, y in zip(texts, labels, strict=True)]
    want = plain_ftrl(rows, model.langs, **options)
    assert len(want) > 300
    for (f, c), w in want.items():
        if f is None:
            assert model.bias[c] == pytest.approx(w, abs=1e-9)
        else:
            assert model.weights[f, c] == pytest.approx(w, rel=1e-4, abs=1e-6)


def test_python_workers_need_no_installed_package(tmp_path):
    """Language ID outside the repository's folder, without PYTHONPATH: only the driver can import the package."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(queries.__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "c")!r}).getOrCreate()
from lodestone.llm import language_id, queries, runs
from lodestone.operators import lexical_index
model = language_id.fit(["der die das"] * 5 + ["the and of"] * 5, ["de"] * 5 + ["en"] * 5)
df = spark.createDataFrame([(1, "the the"), (2, "a b c " * 20)], "doc_id long, text string")
assert df.select(language_id.predictor(spark, model)(F.col("text")).alias("p")).first()[0]["lang"] == "en"
assert runs.find_runs(df).count() == 2
index = lexical_index.build(df, "doc_id", {{"text": F.col("text")}}, {str(tmp_path / "i")!r})
assert index.search(df, "doc_id", F.col("text"), 1).count() == 2
assert queries.op13_filter_audit(spark, {DIR!r}).count() > 0
spark.stop()
print("fine")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.stdout.strip().endswith("fine"), done.stderr[-3000:]
