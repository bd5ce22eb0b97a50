"""Asking through a stored reply table, and re-ranking by unreliable replies."""

import random
import re

from pyspark.sql import functions as F

from lodestone.operators import prompts


def counting(folder, fail=0):
    """A client that leaves a file per call and fails the first ``fail`` times on each prompt."""

    def make():
        import hashlib
        import os

        def client(prompt):
            name = hashlib.md5(prompt.encode()).hexdigest()
            before = len([f for f in os.listdir(folder) if f.startswith(name)])
            open(os.path.join(folder, f"{name}-{before}"), "w").close()
            if before < fail:
                raise OSError("busy")
            return f"re: {prompt}"

        return client

    return make


def test_replies_are_paid_for_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    path = str(tmp_path / "replies")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "i long, p string").withColumn("digest", F.lit("clash"))
    out = prompts.ask(df, "p", counting(str(calls)), path, pause=0.0)
    assert sorted((r["i"], r["reply"]) for r in out.collect()) == [(1, "re: a"), (2, "re: b"), (3, "re: a"), (4, None)]
    assert len(list(calls.iterdir())) == 2
    more = df.unionByName(spark.createDataFrame([(5, "c")], "i long, p string").withColumn("digest", F.lit("")))
    assert prompts.ask(more, "p", counting(str(calls)), path, batch=1).where("reply IS NOT NULL").count() == 4 and len(list(calls.iterdir())) == 3
    assert prompts.ask(df.limit(0), "p", counting(str(calls)), path).count() == 0


def test_calls_are_repeated_and_failures_asked_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    path = str(tmp_path / "replies")
    df = spark.createDataFrame([(1, "a")], "i long, p string")
    assert prompts.ask(df, "p", counting(str(calls), fail=5), path, retries=2, pause=0.0).first()["reply"] is None
    assert spark.read.parquet(path).first()["error"] == "OSError: busy" and len(list(calls.iterdir())) == 2
    assert prompts.ask(df, "p", counting(str(calls), fail=5), path, retries=9, pause=0.0).first()["reply"] == "re: a"


def sloppy():
    """Shuffles, drops, repeats, misspells and invents links, and sometimes says nothing."""

    def client(prompt):
        rng = random.Random(prompt)
        links = re.findall(r"(?m)^link: (.*)$", prompt)
        rng.shuffle(links)
        links = links[: rng.randrange(len(links) + 1)] + [rng.choice(links)] + ["https://x.org/none"]
        if rng.random() < 0.2:
            raise ValueError("no answer")
        return "\n".join(f"{i}. {x}" if rng.random() < 0.5 else x for i, x in enumerate(links, 1))

    return client


def test_a_permutation_of_the_hits_whatever_the_reply_is(spark, tmp_path):
    rng = random.Random(2)
    hits = [(q, i, r) for q in range(25) for r, i in enumerate(rng.sample(range(40), rng.randrange(1, 9)), 1)]
    found = spark.createDataFrame(hits, "query_id long, id long, rank int")
    # some candidates share a link, some have none, one has no row
    rows = [(i, f"L{i}", ["x"], None, None, "d", None if i % 13 == 0 else f"https://en.wikipedia.org/wiki/P{i % 30}") for i in range(39)]
    cands = spark.createDataFrame(rows, "id long, label string, aliases_zh array<string>, aliases_en array<string>, descriptions_zh string, descriptions_en string, link string")
    asked = spark.createDataFrame([(q, f"query {q}") for q in range(25)], "query_id long, query string")
    got = {}
    for r in prompts.rerank(found, cands, asked, "query", sloppy_factory, str(tmp_path / "r"), retries=1).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    want = {}
    for q, i, _ in hits:
        want.setdefault(q, []).append(i)
    moved = 0
    for q, ids in want.items():
        rows = sorted(got[q])
        assert [r for r, _ in rows] == list(range(1, len(ids) + 1)) and sorted(i for _, i in rows) == sorted(ids)
        moved += [i for _, i in rows] != ids
    assert moved > 5


def sloppy_factory():
    return sloppy()


def test_mentions_without_a_useful_reply_keep_their_order(spark, tmp_path):
    def make():
        return lambda prompt: "中文别名：坦克\n英文定义：a tank" if "Mention: T-72" in prompt else "no idea"

    asked = spark.createDataFrame([(1, " T-72\n"), (2, "zzz")], "query_id long, query string")
    known = prompts.expand_mentions(asked, "query", make, str(tmp_path / "m"))
    about = {r["query_id"]: r["about"] for r in known.collect()}
    assert about[2] is None and (about[1]["aliases_zh"], about[1]["definition_en"], about[1]["aliases_en"]) == ("坦克", "a tank", "")

    def backwards():
        return lambda prompt: "\n".join(reversed(re.findall(r"(?m)^link: (.*)$", prompt)))

    hits = spark.createDataFrame([(q, i, i) for q in (1, 2) for i in (1, 2, 3)], "query_id long, id long, rank int")
    cands = spark.createDataFrame([(i, "l", None, None, None, None, f"http://l/{i}") for i in (1, 2, 3)], "id long, label string, aliases_zh array<string>, aliases_en array<string>, descriptions_zh string, descriptions_en string, link string")
    out = prompts.rerank(hits, cands, known, "query", backwards, str(tmp_path / "r"), about=F.to_json("about"), needs_about=True)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 3), (1, 2, 2), (1, 3, 1), (2, 1, 1), (2, 2, 2), (2, 3, 3)]
