"""Prints figures that the README states: ``python -m tests.llm.measure DIR``.

op1: recall of the query's neighbours against brute force. op6: of each seed's best neighbours in the whole corpus, the share that lies in its
shard, and the score of the shard's best ones against that of the corpus', on a sample of seeds. op5, op8, op9: results on labelled rows.
"""

import json
import sys

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.llm import packing, queries, vectors
from lodestone.llm.common import table


def nearest(spark, d: str) -> dict:
    rows = table(spark, d, "embeddings").where("embedding IS NOT NULL").orderBy("vec_id").collect()
    rows = [r for r in rows if all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    x, ids = np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["vec_id"] for r in rows])
    found = {}
    for r in queries.op1_nearest(spark, d).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    return {"vectors": len(ids), "queries": len(found), "recall": round(vectors.recall(x, ids, found, 10), 4)}


def neighbours(spark, d: str, seeds: int = 200, k: int = 12) -> dict:
    texts = [r["text"] for r in table(spark, d, "documents").select("text").collect()]
    encode = packing.encoder(packing.default_tokenizer())
    tokens = encode.encode(texts)
    docs = [np.frombuffer(t, "<u4") for t in tokens]
    df = np.zeros(len(encode.width), dtype=np.int64)
    for t in docs:
        df[np.unique(t)] += 1
    corpus = packing.Statistics(df, len(docs), float(np.mean([len(t) for t in docs])))
    index, rng = packing.Index(docs, corpus), np.random.default_rng(5)
    bins = packing.lexical_bins(tokens, len(encode.width))
    sizes = np.bincount(bins, weights=[len(t) for t in docs])
    plan = {b: (first, n) for b, first, n in packing.shards_of_bins([(int(b), int(sizes[b])) for b in np.flatnonzero(sizes)], 400_000)}
    shard = np.array([plan[int(b)][0] + rng.integers(plan[int(b)][1]) for b in bins])
    random_shard = rng.integers(0, len(set(shard.tolist())), len(docs))
    out = {"documents": len(docs), "shards": len(set(shard.tolist()))}
    for name, of in (("dealt", shard), ("at random", random_shard)):
        inside, share = [], []
        for seed in np.random.default_rng(6).choice(len(docs), min(seeds, len(docs)), replace=False):
            best = [n for n in index.neighbours(int(seed), np.array([seed]))][:k]
            scores = index.scores(int(seed))
            scores[seed] = 0
            near = np.sort(np.where(of == of[seed], scores, 0))[::-1][:k]
            if best:
                inside.append(np.mean(of[best] == of[seed]))
                share.append(near.sum() / scores[best].sum())
        out[name] = {"neighbours in the shard": round(float(np.mean(inside)), 4), "score": round(float(np.mean(share)), 4)}
    return out


def labelled(spark, d: str) -> dict:
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "lang")
    language = queries.op8_language_id(spark, d).join(docs, "doc_id").where("held_out AND lang IS NOT NULL")
    toxic = queries.op9_toxicity(spark, d).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    y, p, s = (np.array([r[c] for r in toxic], dtype=float) for c in ("toxic", "predicted", "score"))
    rank = np.argsort(np.argsort(s))
    quality = queries.op5_quality(spark, d).join(labels, "doc_id", "left").groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("kept").cast("int")).alias("kept"))
    return {
        "op8 held-out accuracy": round(language.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0], 4),
        "op9 held-out": {"rows": len(y), "recall": round(float(p[y == 1].mean()), 4), "false positives": round(float(p[y == 0].mean()), 4), "auc": round(float((rank[y == 1].mean() - rank[y == 0].mean()) / len(y) + 0.5), 4)},
        "op5 kept by language and quality": {f"{r['lang']} {r['quality']}": [r["n"], round(r["kept"], 3)] for r in quality.orderBy("lang", "quality").collect()}}


if __name__ == "__main__":
    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    for part in (nearest, neighbours, labelled):
        print(part.__name__, json.dumps(part(session, sys.argv[1]), ensure_ascii=False), flush=True)
