"""Defined results of the training-data operators in odd cases, and brute force on small fixtures."""

import base64
import gzip
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, language_id, mixing, near_dedup, packing, url_filter, vectors, warc

DOCS = "doc_id long, text string, lang string, source string"
VECTORS = "vec_id long, embedding array<double>"
PAGES = "page_id long, url string, html string"


def nearest(x, ids, q, k=10):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_nearest_ties_of_equal_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[100:500] = x[100]
    ids = np.arange(1500)
    df = spark.createDataFrame([(int(i), [float(v) for v in x[i]]) for i in ids], VECTORS)
    got = {}
    for r in vectors.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(range(0, 1500, 100))
    for q in (100, 200, 300, 400):
        assert [got[q][i + 1][0] for i in range(10)] == [v for v, _ in nearest(x, ids, q)] and got[q][1][1] == 0.0


def test_nearest_probes_few_of_many_lists_of_clustered_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 16)) * 6
    x = centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16))
    ids = np.arange(4000)
    probed = []
    count = vectors.probes_for
    monkeypatch.setattr(vectors, "probes_for", lambda *a: probed.append((count(*a), len(a[2]))) or probed[-1][0])
    monkeypatch.setattr(vectors, "CHUNK", 50)
    df = spark.createDataFrame([(int(i), [float(v) for v in x[i]]) for i in ids], VECTORS)
    found = {}
    for r in vectors.search(df, F.col("vec_id") % 50 == 0, max_task_rows=60).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert len(found) == 80 and vectors.recall(x, ids, found, 10) >= 0.9
    (probes, lists), = probed
    assert lists == 63 and probes <= lists // 3


def test_nearest_skips_what_is_no_vector(spark):
    rows = [(0, [1.0, 0.0]), (1, [math.inf, 0.0]), (2, [0.0, None]), (3, [1.0]), (4, None), (None, [1.0, 0.0]), (5, [0.5, 0.0]), (6, [0.0, 0.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("rank", F.lit("x")).withColumn("score", F.lit("y"))
    got = [tuple(r) for r in vectors.search(df, F.lit(True)).orderBy("query_id").collect()]
    assert got == [(0, 1, 5, 0.5), (5, 1, 0, 0.5)]
    assert vectors.search(df, F.lit(False)).count() == 0


@pytest.mark.parametrize("steps", [20_000, 1])
def test_mixture_of_texts_without_tokens(spark, steps, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 3)
    rows = [(i, "a b c", "en", "s0") for i in range(20)] + [(20, None, "xx", "s1"), (21, "", None, None), (22, "  ", "en", "s1"), (5, "a b c", "en", "s0")]
    df = spark.createDataFrame(rows, DOCS).withColumn("topic", F.lit("clash"))
    for targets in (None, {"lang": {"en": 0.0, "xx": 1.0}}):
        got = {r["doc_id"]: r["mix"] for r in mixing.sample_mixture(df, targets=targets, max_steps=steps).collect()}
        assert len(got) == 23 and got[20]["tokens"] == 0 and all(0 <= m["probability"] <= 1 for m in got.values())
    only = spark.createDataFrame([(1, None, None, None)], DOCS)
    assert mixing.sample_mixture(only, max_steps=steps).first()["mix"]["tokens"] == 0


def test_exact_copies_of_repeated_and_null_ids(spark):
    rows = [(1, "a b", "en", "s"), (1, "ab", "en", "s"), (2, "x", "en", "s"), (2, "x", "en", "s"), (None, "x", "en", "s"), (3, "y ", "en", "s"), (4, " y", "en", "s")]
    df = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(7))
    got = sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.find_copies(df).collect())
    assert got == [(0, 2, 3, False), (1, 1, 2, False), (1, 1, 2, True), (2, 2, 3, True), (2, 2, 3, True), (3, 3, 2, True), (4, 3, 2, False)]
    left = sorted(tuple(r)[:2] for r in exact_dedup.deduplicate(df).collect())
    assert left == [(1, "a b"), (2, "x"), (3, "y ")]
    unique = df.where("doc_id > 2")
    assert [tuple(r) for r in exact_dedup.deduplicate(unique).collect()] == [(3, "y ", "en", "s", 7)]
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0


def test_near_copies_of_repeated_ids(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choices([f"w{i}" for i in range(300)], k=60))
    a, b, c = text(), text(), text()
    rows = [(5, a, "en", "s"), (5, b, "en", "s"), (3, b + " end", "en", "s"), (7, c, "en", "s"), (7, c, "en", "s"), (None, a, "en", "s"), (9, None, "en", "s")]
    df = spark.createDataFrame(rows, DOCS).withColumn("gone", F.lit(1))
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in near_dedup.deduplicate(df).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
    assert kept == sorted([(0, a), (3, b + " end"), (5, a), (7, c), (9, "")])
    got = sorted((r["doc_id"] or 0, r["group_id"] or 0, r["group_size"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(0, 0, 1), (3, 3, 2), (5, 3, 2), (5, 5, 1), (7, 7, 2), (7, 7, 2), (9, 9, 1)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0 and near_dedup.deduplicate(df.limit(0)).columns == df.columns


def pieces_match(rows, texts):
    """Every piece against the tokenizer itself; sequences gapless and, but for each shard's last, full."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: [*(tok.encode(t or "", add_special_tokens=False).ids), 0] for i, t in texts}
    sequences, seen = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and len(part) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for spans, total in [*((s, None) for s in sequences.values()), *((s, len(ids[d])) for d, s in seen.items())]:
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == total if total is not None else at <= 1024
    assert set(seen) == set(ids)
    return sum(sum(n for _, n in s) < 1024 for s in sequences.values())


def test_packing_against_the_tokenizer(spark):
    rng = random.Random(11)
    words = ["alpha", "Ünder", "naïve", "中文", " ", "x\ty", "\r\n", "😀", "<|endoftext|>"]
    texts = [(9007199254740993, "a\0b \0 c"), (1, None), (2, ""), (3, "  two  spaces "), (4, "x" * 30_000)]
    texts += [(10 + i, " ".join(rng.choices(words, k=rng.randrange(1, 400)))) for i in range(40)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in texts], DOCS).withColumn("length", F.lit("clash"))
    assert pieces_match(packing.pack(df).collect(), texts) <= 1


def test_packing_shards(spark):
    """Small shards: every piece is right, copies of a group meet in few shards, a bin of copies beyond a shard's size is spread."""
    rng = random.Random(12)
    texts = []
    for g in range(30):
        base = [f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bdfgklmnprst')}{rng.randrange(99)}" for _ in range(60)]
        texts += [(10 * g + j, " ".join(base)) for j in range(10)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in texts], DOCS).repartition(7)
    rows = packing.pack(df, shard_tokens=3000).collect()
    assert 5 < len({r["sequence_id"] >> 32 for r in rows}) >= pieces_match(rows, texts)
    shards = {}
    for r in rows:
        shards.setdefault(r["doc_id"] // 10, set()).add(r["sequence_id"] >> 32)
    assert np.mean([len(s) for s in shards.values()]) < 2
    assert packing.shards_of_bins([(0, 5), (1, 4), (2, 25), (3, 2), (4, 9)], 10) == [(0, 0, 1), (1, 0, 1), (2, 1, 3), (3, 4, 1), (4, 5, 1)]


def test_packing_repeats_and_null_ids(spark):
    df = spark.createDataFrame([(None, "one two", "en", "s"), (1, "three", "en", "s"), (1, "three", "en", "s"), (9007199254740993, "z", "en", "s")], DOCS)
    got = packing.pack(df).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 1, 9007199254740993]
    assert sorted(r["offset"] for r in got)[0] == 0 and len({r["sequence_id"] for r in got}) == 1


def test_url_rules_in_blocks(spark):
    rng = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "a.net", "org"]
    rules = [(rng.choice(["block", "allow"]), h, p) for h in hosts for p in ("/", "/en/", "/en/7")]
    urls = [f"http://{s}{h}{p}" for h in hosts for s in ("", "w.", "w.v.") for p in ("/", "/en/", "/en/77?q", "", "#f")]
    df = spark.createDataFrame(list(enumerate([*urls, None, "no url", "http://" + "y" * 50_000 + ".com/en/"])), "page_id long, url string")
    df = df.unionAll(df.limit(2)).withColumn("host", F.lit("clash")).withColumn("n", F.lit(1))

    def judged(url):
        if not url or "://" not in url:
            return None, "allow"
        rest = url.split("://", 1)[1]
        host = "".join(c if c not in "/?#" else "\n" for c in rest).split("\n")[0].lower()
        path = rest[len(host):].split("?")[0].split("#")[0]
        fit = [(len(h) + len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, "allow")

    for most in (10_000, 4):
        got = url_filter.filter_urls(df, rules, max_rules=most).collect()
        assert len(got) == df.count() and all((r["rule"], r["verdict"]) == judged(r["url"]) for r in got)
    assert {(r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, []).collect()} == {(None, "allow")}
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def test_language_odd_rows(spark):
    en, de = "the cat and the house with this", "der hund und das haus mit dieser"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", "s") for i in range(60)]
    rows += [(1, en, "en", "s"), (70, None, None, None), (71, "", "en", "s"), (72, "12 !?", "en", "s"), (73, en * 20_000, None, "s"), (None, de, "de", "s")]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    model = language_id.train(df)
    got = [(r["doc_id"], *r["p"]) for r in df.select("doc_id", language_id.predictor(spark, model)("text").alias("p")).collect()]
    by = {g[0]: g[1:] for g in got}
    assert len(got) == len(rows) and by[73][0] == "en" and by[None][0] == "de" and by[1][0] == "en"
    assert all(by[i] == ("und", 0.0) for i in (70, 71, 72)) and all(0 <= g[2] <= 1 for g in got)
    nothing = language_id.train(df.limit(0))
    assert {r["p"]["lang"] for r in df.select(language_id.predictor(spark, nothing)("text").alias("p")).collect()} == {"und"}


def test_language_of_pieces(monkeypatch):
    rng = random.Random(3)
    words = {"en": ["the", "and", "with"], "de": ["der", "und", "mit"]}
    texts = [(lang, " ".join(rng.choices(words[lang], k=40))) for lang in ("en", "de") * 30]
    model = language_id.fit([t for _, t in texts], [x for x, _ in texts])
    asked = [" ".join(rng.choices(words["en"] + words["de"], k=rng.randrange(1, 60))) for _ in range(30)] + [None, "", "12", "x"]
    whole = model.predict(asked)
    for piece in (7, 50):
        monkeypatch.setattr(language_id, "PIECE", piece)
        cut = model.predict(asked)
        assert cut[0] == whole[0] and np.allclose(cut[1], whole[1])


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language_id.train(docs, ~held)
    rows = docs.where(held & F.col("lang").isNotNull()).select("lang", language_id.predictor(spark, model)("text").alias("p")).collect()
    assert sum(r["lang"] == r["p"]["lang"] for r in rows) >= 0.95 * len(rows)


def test_warc_odd_pages(spark):
    rows = [(1, None, "x"), (2, "http://b/\r\nX: y", "x"), (2, "http://b/", "x"), (None, "http://n/", "x"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 200_000), (7, "u", "a\r\n\r\nb")]
    df = spark.createDataFrame(rows, PAGES).withColumn("refers_to", F.lit("clash"))
    got = sorted(((r["page_id"] or 0), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(df).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    kind = {0: ("response", None), 1: ("revisit", 2), 2: ("response", None), 4: ("revisit", 5)}
    assert [g[:4] for g in got] == sorted((i or 0, len((t or "").encode()), digest(t), kind.get(i or 0, ("response", None))[0]) for i, _, t in rows)
    assert all(g[4] == kind.get(g[0], ("", None))[1] for g in got)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_warc_damage_is_found():
    good = warc.page_record(1, "u", b"payload", None, 7, warc.payload_digest(b"payload"))

    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:n], self.data[n:]
            return out

    assert [warc.page_of(m)[5] for m in warc.members(Stream(good * 3), 10)] == [b"payload"] * 3
    with pytest.raises(ValueError):
        list(warc.members(Stream(good + good[:-9])))
    wrong = gzip.compress(gzip.decompress(good).replace(b"payload\r\n", b"paylOad\r\n"))
    with pytest.raises(ValueError):
        [warc.page_of(m) for m in warc.members(Stream(wrong))]


def test_warc_rolls_archives(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"http://a/{i}", f"page {i}") for i in range(30)], PAGES).coalesce(1)
    manifest = warc.write_archives(warc.with_references(rows), str(tmp_path), roll_bytes=500).collect()
    assert len(manifest) > 3
    read = warc.read_archives(spark.createDataFrame(manifest), str(tmp_path))
    assert sorted(r["page_id"] for r in read.collect()) == list(range(30))


def test_packing_encodes_in_small_parts_with_the_tokenizers_ids():
    from tokenizers import Tokenizer

    odd = [None, "", " ", "  ", " a", "a ", "a  b", "a \nb c.\nD e,", "<|endoftext|> a", "a <|endoftext|>", "é 　x", "it's ok\0 a"]
    texts = odd + [" ".join(f"w{i * 31 + j}." for j in range(2000)) for i in range(100)]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    parts = [p for p in packing.encode_rows(iter([batch]), packing.default_tokenizer()) if p.column("bin")[0].as_py() >= 0]
    of = dict(enumerate(texts))
    assert all(sum(len(of[i] or "") for i in p.column("doc_id").to_pylist()) <= 400_000 for p in parts)
    got = {i: np.frombuffer(t, "<u4").tolist() for p in parts for i, t in zip(p.column("doc_id").to_pylist(), p.column("tokens").to_pylist(), strict=True)}
    plain = Tokenizer.from_file(packing.default_tokenizer())
    assert got == {i: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for i, t in of.items()}


def test_packing_encodes_by_byte_ranks_only_where_they_give_the_tokenizers_ids(tmp_path):
    import json

    from tokenizers import Tokenizer

    plain = packing.default_tokenizer()
    by_ranks = packing.Encoder(plain)
    # a second way to "abc": by ranks a + bc would merge too, by the tokenizer's own merges only ab + c does
    with open(plain, encoding="utf-8") as f:
        other = json.load(f)
    letters = [t for t in other["model"]["vocab"] if len(t) == 1]
    other["model"] |= {"vocab": {t: i for i, t in enumerate([*letters, "bc", "ab", "abc"])}, "merges": [["b", "c"], ["a", "b"], ["ab", "c"]]}
    path = str(tmp_path / "own.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(other, f)
    by_merges = packing.Encoder(path)
    assert by_ranks.single is not None and by_merges.single is None
    rng = random.Random(3)
    texts = [None, "", "abc ab bc", "a" * 3000 + "abc", " " * 5000 + "a", "\n" * 1_100_000 + "a", "a　 b \x1c\x1d c", "<|endoftext|>", "x <|endoftext|>y  z"]
    texts += ["".join(rng.choice("abcé ñ中\n\t '’sS1٣²#$\x85\xa0😀́") for _ in range(300)) for _ in range(40)]
    for encoder, of in ((by_ranks, plain), (by_merges, path)):
        tokenizer = Tokenizer.from_file(of)
        got = [np.frombuffer(t, "<u4").tolist() for t in encoder.encode(texts)]
        assert got == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_packing_keeps_no_table_of_pieces():
    """Words that never come again must not gather in a worker: the executor's memory is shared with all other stages."""
    import tracemalloc

    encoder = packing.Encoder(packing.default_tokenizer())
    encoder.encode(["warm up"])
    tracemalloc.start()
    try:
        for k in range(10):
            encoder.encode([" ".join(f"{k}word{i}x{j}" for j in range(2000)) for i in range(10)])
        held, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert held < 2_000_000
