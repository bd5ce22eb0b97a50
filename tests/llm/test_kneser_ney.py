"""The language models against plain loops over dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import kneser_ney, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string"


def words(text):
    return [*re.findall(r"\w+", (text or "").lower()), "</s>"]


def bigrams(texts):
    return Counter(p for t in texts for p in zip(["</s>", *words(t)[:-1]], words(t), strict=True))


def discounts(counts):
    n = [max(sum(c == j for c in counts), 0.5) for j in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    raw = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
    d = [min(max(x, 0.1), 0.95 * (i + 1)) for i, x in enumerate(raw)]
    return lambda c: 0 if c <= 0 else d[min(c, 3) - 1]


class KneserNey:
    """Textbook interpolated modified Kneser-Ney of order two."""

    def __init__(self, pairs):
        self.pairs, self.after, self.before = pairs, defaultdict(Counter), Counter(w for _, w in pairs)
        for (v, w), c in pairs.items():
            self.after[v][w] = c
        self.d2, self.d1 = discounts(pairs.values()), discounts(self.before.values())
        self.total = sum(self.before.values())
        self.mass = sum(map(self.d1, self.before.values())) / self.total
        self.uniform = 1 / (len(self.before) + 1)

    def word(self, w, below=None):
        n = self.before[w]
        return (n - self.d1(n)) / self.total + self.mass * (self.uniform if below is None else below)

    def share(self, v, w):
        n, t = self.after[v][w], sum(self.after[v].values())
        return (n - self.d2(n)) / t if t else 0.0

    def backoff(self, v):
        t = sum(self.after[v].values())
        return sum(map(self.d2, self.after[v].values())) / t if t else 1.0

    def __call__(self, v, w):
        return self.share(v, w) + self.backoff(v) * self.word(w)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(60)]
    out = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40))), "en", "s") for i in range(n)]
    return [*out, (n, None, "en", "s"), (n + 1, "", "en", "s"), (n + 2, "unseen words only", "en", "s"), (n + 3, "w1 Été_9 w1 w1 w1", "en", "s")]


@pytest.mark.parametrize(("hot", "parts"), [(0, 1), (5, 3), (10_000, 2)])
def test_independent_models(spark, hot, parts):
    rows = corpus(80, 1)
    df = spark.createDataFrame(rows, DOCS)
    model = kneser_ney.train(df, [(F.col("doc_id") < 60) & (F.col("doc_id") % 2 == i) for i in (0, 1)], parts=parts, hot=hot)
    own = [KneserNey(bigrams([t for i, t, *_ in rows if i < 60 and i % 2 == k])) for k in (0, 1)]
    got = {r["doc"]: r for r in kneser_ney.score(df, model, F.col("doc_id") % 2, parts=parts).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        w = words(t)
        want = sum(math.log(own[i % 2](a, b)) for a, b in zip(["</s>", *w[:-1]], w, strict=True))
        assert got[i]["words"] == len(w) and math.isclose(got[i]["total"], want, rel_tol=1e-6, abs_tol=1e-5)


def test_contrast(spark):
    rows = corpus(120, 2)
    df = spark.createDataFrame(rows, DOCS)
    model = kneser_ney.train(df, [F.col("doc_id") < 20, F.col("doc_id").between(20, 79)], contrast=True, prior=3.0, pair_prior=7.0, parts=2, hot=4)
    one, other = (KneserNey(bigrams([t for i, t, *_ in rows if a <= i < b])) for a, b in ((0, 20), (20, 80)))
    both = KneserNey(one.pairs + other.pairs)
    lean = lambda x, shared, n, p: (x * n + shared * p) / (n + p)
    unseen = both.mass * both.uniform
    p = [{w: lean(m.word(w, both.word(w)), both.word(w), both.before[w], 3.0) for w in both.before} for m in (one, other)]
    z = [sum(x.values()) + unseen for x in p]

    def ratio(v, w):
        out = []
        for m, x, total in zip((one, other), p, z, strict=True):
            low = x.get(w, unseen) / total
            n = both.pairs[v, w]
            seen = lean(m.share(v, w), both.share(v, w) * low / both.word(w), n, 7.0) if n else 0.0
            out.append(math.log(both.backoff(v) * low + seen))
        return out[0] - out[1]

    got = {r["doc"]: r for r in kneser_ney.score(df, model).collect()}
    for i, t, *_ in rows:
        w = words(t)
        want = sum(ratio(a, b) for a, b in zip(["</s>", *w[:-1]], w, strict=True))
        assert got[i]["words"] == len(w) and math.isclose(got[i]["total"], want, rel_tol=1e-5, abs_tol=1e-4)


def test_bitmap_holds_every_key(spark):
    rng = random.Random(3)
    keys = [rng.getrandbits(64) - 2**63 for _ in range(3000)] + [0, 2**kneser_ney.BITS - 1, -1]
    known = kneser_ney.bitmap(spark.createDataFrame([(k,) for k in keys], "key long"))
    place = [k % 2**kneser_ney.BITS for k in keys]
    assert all(known[p >> 3] >> (p & 7) & 1 for p in place) and sum(int(x).bit_count() for x in known) == len(set(place))


def test_quality_against_brute_force(spark):
    rows = [(i, t, "en" if i % 3 else None, s) for i, t, _, s in corpus(90, 4)]
    rows += [(200, "!!", "en", "s"), (201, "w1 w2", "xx", "s"), (None, "w1 w3 w3", "en", "s")]
    df = spark.createDataFrame([*rows, rows[5]], DOCS).withColumn("kept", F.lit("clash"))
    got = quality.classify(df, F.col("doc_id") < 50).collect()
    assert len(got) == len(rows) + 1
    half = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 2
    own = [KneserNey(bigrams([t for i, t, *_ in [*rows, rows[5]] if i is not None and i < 50 and half(i) == k])) for k in (0, 1)]
    want = {}
    for i, t, lang, _ in rows:
        w = words(t)
        if len(w) > 1:
            want[i] = math.exp(-sum(math.log(own[1 - half(i)](a, b)) for a, b in zip(["</s>", *w[:-1]], w, strict=True)) / len(w))
    for r in got:
        assert (r["perplexity"] is None) == (r["doc_id"] not in want) and (r["perplexity"] is None or math.isclose(r["perplexity"], want[r["doc_id"]], rel_tol=1e-5))
        assert r["kept"] == (r["perplexity"] is not None and r["perplexity"] <= r["threshold"])
    for lang in ("en", None):
        of = [(i, r["threshold"]) for r in got for i in [r["doc_id"]] if r["lang"] == lang]
        held = sorted(want[i] for i, t, x, _ in rows if i is not None and i < 50 and x == lang for _ in range(1 + (i == rows[5][0])))
        assert len({t for _, t in of}) == 1 and math.isclose(of[0][1], held[math.ceil(0.95 * len(held)) - 1], rel_tol=1e-5)
    assert quality.classify(df.limit(0), F.lit(True)).count() == 0


def test_toxicity_odd_rows(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["a", "b", "c", "d"], k=20)) + (" vile" * (i % 3 == 0)), "en", "s") for i in range(200)]
    rows += [(300, None, None, None), (301, "", "en", "s"), (5, rows[5][1], "en", "s"), (302, "a b vile " * 5000, "en", "s")]
    df = spark.createDataFrame(rows, DOCS).withColumn("toxic", F.when(F.col("doc_id") < 200, (F.col("doc_id") % 3 == 0).cast("int"))).withColumn("score", F.lit("clash"))
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(df, F.col("doc_id") % 5 > 1, F.col("doc_id") % 5 == 1, F.col("toxic"), prior=1.0, pair_prior=50.0).collect()]
    by = dict(got)
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got) and by[300] == by[301] and by[302] > 0.5
    held = [i for i in range(0, 200, 5) if i != 5]
    assert sum((by[i] >= 0.5) == (i % 3 == 0) for i in held) >= 0.9 * len(held)
    one = toxicity.score(df.where("toxic = 0"), F.lit(True), F.lit(True), F.col("toxic"))
    assert {r["score"] for r in one.collect()} == {0.0}
    assert toxicity.score(df.limit(0), F.lit(True), F.lit(True), F.col("toxic")).count() == 0


def test_each_part_weighs_its_own_hot_ngrams(spark):
    """A scan works only on its part's n-grams, the hot ones included: three scans weigh each once, none weighs all."""
    import numpy as np

    text = " ".join(f"w{i}" for i in range(60))
    doc, w = kneser_ney.tokens([text])
    keys = np.unique(kneser_ney.marked(np.concatenate([w, kneser_ney.pair_hash(kneser_ney.contexts(doc, w), w)]), np.zeros(2 * len(w), np.int64)))
    bits = np.full(1 << (kneser_ney.BITS - 3), 255, np.uint8)
    shared = spark.sparkContext.broadcast((np.array([0.0]), keys, np.ones(len(keys)), bits))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("which", F.lit(0))
    weighed = [kneser_ney.features(docs, shared, p, 3).where("total IS NOT NULL").agg(F.sum("total"), F.sum("words")).first() for p in range(3)]
    assert [r[0] for r in weighed] == [int(kneser_ney.in_part(keys, p, 3).sum()) for p in range(3)]
    assert sum(r[1] for r in weighed) == len(w)
