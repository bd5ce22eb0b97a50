"""Hand-derived cases of functions and operators."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import arrays as A
from lodestone.functions import html as H
from lodestone.functions import links as L
from lodestone.functions import text as T
from lodestone.functions import vector as V
from lodestone.operators import annotation, evaluate, models, profile, records, resolve, search
from lodestone.plans import catalog, registry, runner  # noqa: F401


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_links(spark):
    lit = F.lit
    wiki = "https://zh.wikipedia.org/wiki/"
    got = values(
        spark, L.normalize_v1(lit(wiki + "%E9%98%BF#x")), L.normalize_v2(lit(wiki + "%E9%98%BF?a=1#x")), L.normalize_v1(lit(wiki + "C++")), L.normalize_v2(lit(wiki + "%zz")),
        L.normalize_v1(lit(" u ")), L.normalize_v2(lit(None).cast("string")), L.title_from_url(lit("")), L.clean_link(lit("3. https://a/b")), L.clean_link(lit("12) u")), L.clean_link(lit("选项2：u")),
        L.clean_link(lit("LINK: u")), L.clean_link(lit("link：u")), L.article_url(lit("/wiki/ikea")), L.absolute_src(lit("//a/b")), L.absolute_src(lit("/a")), L.absolute_src(lit("x")))
    assert got == ["阿#x", "阿", "C++", "%zz", "u", "", None, "https://a/b", "u", "u", "u", "u", "https://en.wikipedia.org/wiki/ikea", "https://a/b", "https://en.wikipedia.org/a", "x"]
    names = values(
        spark, L.sanitize_filename(lit(' .a<b>:"c/d\\e|f?*. ')), F.char_length(L.sanitize_filename(lit("x" * 300))), L.filename_from_link(lit(wiki + "F%2F16?x"), lit("q")),
        L.filename_from_link(lit("https://h/a/b.html?x"), lit("q:1")), L.filename_from_link(lit("https://h/a/b.html/?x"), lit("")), L.filename_from_link(lit("https://h"), lit(None).cast("string")),
        L.filename_from_link(lit(None).cast("string"), lit("q")))
    assert names == ["a_b___c_d_e_f__", 200, "F_16.txt", "q_1.txt", "b.html.txt", "unknown.txt", "unknown.txt"]


def test_html(spark):
    lit = F.lit
    got = values(
        spark, H.first_sentence(lit("<p>甲是乙。丙。</p>")), H.first_sentence(lit("<p>\n甲</p>")), H.first_sentence(lit("none")), H.first_sentence(lit("<p class='a'>v1.5 是？x</p>")),
        H.first_paragraph(lit("<p>a <b>b</b> &amp;lt;\nc </p><p>d</p>")), H.first_paragraph(lit("<pre>x</pre>")), H.description(lit("<table><tr><p>x</p></tr></table><p></p>"), lit("def")),
        H.description(lit("none"), lit("def")), H.html_to_text(lit("<nav>n</nav><header a=b>h</header><!-- c --><p>x<br>y</p><footer>f</footer>")),
        H.rewrite_anchors(lit('<a href="/wiki/X" title="t">x</a>')), H.rewrite_anchors(lit('<a href="/w/Y">y</a>')), H.strip_srcset(lit('<img src="a" srcset="b 2x">')))
    assert got == ["甲是乙", "N/A", "N/A", "v1.5 是", "a b &lt;c", None, "def", None, "x y", '<a href="https://en.wikipedia.org/wiki/X" title="t">x</a>', '<a href="/w/Y">y</a>', '<img src="a">']
    page = "<html><body><nav>menu</nav><div id='bodyContent'>one<br><p> two <script>bad()</script></p><div>three</div></div><p>outside</p></body></html>"
    assert H.page_text(page) == "one\ntwo\nthree" and H.page_text("<p>a<p>b") == "a\nb" and H.page_text(None) is None
    assert H.page_text("x<body>y<!-- z --><div class='mw-body-content k'>in</div></body>") == "in"
    df = spark.createDataFrame([(page,), (None,)], "html string")
    assert [r[0] for r in df.select(H.visible_text("html")).collect()] == ["one\ntwo\nthree", None]


def test_text(spark):
    lit = F.lit
    assert values(spark, T.preprocess_query(lit("  F-16\n战斗机　x ")), T.containment(lit("AK"), lit("ak-47")), T.containment(lit("F16"), lit("F-16")), T.containment(lit("a"), lit("A")), T.containment(lit(""), lit(""))) == ["F-16 战斗机 x", 0.4, 0.0, 1.0, 0.0]
    assert values(spark, T.standard_tokens(lit("F-16战机 x")), T.bigram_tokens(lit("战斗机")), T.bigram_tokens(lit("x"))) == [["f", "16", "战", "机", "x"], ["战斗", "斗机"], ["x"]]
    assert values(spark, T.to_simplified(lit("東風")), T.is_traditional(lit("東")), T.is_traditional(lit("东")), T.canonical_json(lit('{"b": 1, "a": [2]}')), T.canonical_json(lit("{"))) == ["东风", True, False, '{"a":[2],"b":1}', None]
    assert values(spark, T.is_progress_line(lit(" 3%| | 1/30 [")), T.is_progress_line(lit(" 3%| | 1/30 Loss")), T.log_number(lit("训练样本数: 51,338 条"), "训练样本数"), T.log_number(lit("x"), "y")) == [True, False, 51338.0, None]
    reply = lit("中文别名：甲, 乙 英文别名: A\n\n英文定义：\n标签 z")
    assert values(spark, T.reply_field(reply, "中文别名"), T.reply_field(reply, "英文别名"), T.reply_field(reply, "英文定义", "none"), T.reply_field(reply, "中文定义")) == ["甲, 乙", "A", "none", ""]


def test_arrays_and_vectors(spark):
    vec = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    r6 = lambda c: F.transform(c, lambda x: F.round(x, 4))
    got = values(spark, r6(V.fit_dim(V.l2_normalize(vec(3, 4)), 4)), r6(V.fit_dim(vec(3, 4, 0, 12), 2)), V.l2_normalize(vec(0, 0)), V.cosine(vec(0), vec(1)), r6(V.merge_list(F.array(vec(1, 0), vec(0, 1)))), V.merge_list(F.array().cast("array<array<double>>")))
    assert got == [[0.6, 0.8, 0, 0], [0.6, 0.8], None, None, [0.7071, 0.7071], None]
    assert values(spark, A.list_from_json(F.lit('["a"]')), A.list_from_json(F.lit('"b"')), A.list_from_json(F.lit("{")), A.alias_map({"zh": A.no_strings()}), A.presence_counts(F.array(F.lit("x"), F.lit("x")))) == [["a"], ["b"], [], None, {"x": 1}]
    types = spark.createDataFrame([("火炮",), ("导弹",), (None,)], "type string")
    assert [tuple(r) for r in A.label_ids(types).orderBy("id").collect()] == [("O", 0), ("B-导弹", 1), ("I-导弹", 2), ("B-火炮", 3), ("I-火炮", 4)]


def span(a, b, t):
    return F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).cast("string").alias("type"))


def test_bio(spark):
    tags = values(spark, annotation.encode_spans(F.lit("ABCDE"), F.array(span(0, 2, "T"), span(1, 3, "U"))), annotation.encode_spans(F.lit("ABCDE"), F.array(span(3, 9, "T"), span(4, 5, None))), annotation.encode_spans(F.lit(""), F.array(span(0, 1, "T"))))
    assert tags == [["B-T", "B-U", "I-U", "O", "O"], ["O", "O", "O", "O", "B-ENTITY"], []]
    damaged = F.split(F.lit("B-A I-A I-B I-B O I-A B-B I-B"), " ")
    entity = values(spark, annotation.decode(damaged), annotation.entity_words(F.lit("abcdefgh"), damaged), annotation.decode(F.array(F.lit("B-A"), F.lit("O"))))
    assert [tuple(e) for e in entity[0]] == [(0, 2, "A"), (6, 2, "B")] and entity[1] == ["ab", "gh"] and entity[2] == []


def test_bio_decode_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(i, rng.choices(["O", "B-A", "I-A", "B-AB", "I-AB", "[SEP]"], k=rng.randrange(0, 30))) for i in range(300)]

    def loop(tags):
        out, start, kind = [], None, None
        for i, t in enumerate([*tags, "O"]):
            if start is not None and not (t.startswith("I-") and t[2:] == kind):
                if i - start >= 2:
                    out.append((start, i - start, kind))
                start = None
            if t.startswith("B-"):
                start, kind = i, t[2:]
        return out

    df = spark.createDataFrame(rows, "i long, tags array<string>")
    got = {r["i"]: [tuple(e) for e in r["e"]] for r in df.select("i", annotation.decode(F.col("tags")).alias("e")).collect()}
    assert got == {i: loop(t) for i, t in rows}


def plain_alignment(text, tokens, size):
    """The rule place by place."""
    out, at = [], 0
    for token in tokens:
        piece = token.replace("##", "").replace("▁", "").strip()
        if token in annotation.SPECIAL_TOKENS or not piece:
            out.append(None)
            continue
        fits = [p for p in range(max(0, at - 20), min(len(text), at + 50)) if text[p:p + len(piece)] == piece]
        near = [p for p in fits if abs(p - at) < 10]
        place = near[0] if near else fits[-1] if fits else at
        out.append(place if place < size else None)
        if place < size and not token.startswith("##"):
            at = place + len(piece) if fits else min(at + 1, len(text))
    return out


def test_alignment(spark):
    align = lambda *a: annotation.align_tokens(*a)
    assert align("F-16战机 f-16", ["F", "-", "16", "战", "##机", "[UNK]", "f"], 10) == [0, 1, 2, 4, 5, None, 7]
    # the last occurrence if none is near; a token that isn't found takes the tag where the search stands
    assert align("x" * 15 + "abab", ["ab"], 19) == [17] and align("abc", ["q", "b"], 3) == [0, 1]
    rng = random.Random(8)
    for _ in range(2000):
        text = "".join(rng.choice("aab ") for _ in range(rng.randrange(0, 90)))
        tokens = [rng.choice(["", "##", "▁"]) + "".join(rng.choice("aabc") for _ in range(rng.randrange(0, 4))) for _ in range(rng.randrange(0, 25))] + rng.choice([[], ["[SEP]"], ["[UNK]", "a"]])
        size = rng.choice([len(text), len(text) // 2])
        assert align(text, tokens, size) == plain_alignment(text, tokens, size)
    rows = spark.createDataFrame([(["F", "##16"], "F16", ["B-X", "I-X", "I-X"]), (None, "a", ["O"])], "k array<string>, text string, tags array<string>")
    assert [r[0] for r in rows.select(annotation.token_tags(F.col("k"), F.col("text"), F.col("tags"))).collect()] == [["B-X", "I-X"], None]


def test_token_tags_of_whole_texts(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r["tags"] for r in registry.queries()["token_tags"](spark, folder).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r["text"]}
    assert len(got) == len(texts)
    for i, t in texts.items():
        if len(t) < 5000:
            tags = [f"{'B' if k % 3 == 0 else 'I'}-{k % 11}" for k in range(len(t))]
            want = ["O" if p is None else tags[p] for p in plain_alignment(t, re.findall(r"[^ \t\n\x0b\f\r]+", t), len(t))]
            assert got[i] == " ".join(want)


def test_entities_are_as_long_as_their_characters(spark):
    rows = [(["F16", "is", "F", "##1", "x"], ["B-P", "O", "B-P", "I-P", "B-P"])]
    df = spark.createDataFrame(rows, "k array<string>, tags array<string>")
    got = df.select(annotation.decode(F.col("tags"), 2, F.col("k")).alias("e")).first()["e"]
    assert [tuple(e) for e in got] == [(0, 1, "P"), (2, 2, "P")]


def test_containers_are_divisions():
    assert H.page_text('<span id="content">menu</span><div id="bodyContent">real</div>') == "real"
    assert H.page_text('<div id="x content">no</div><div class="a mw-body-content">yes</div>') == "yes"
    assert H.page_text('<header><div id="content">h</div></header><body>b</body>') == "b"


def test_metrics(spark):
    ranks = spark.createDataFrame([(0, 1), (1, 4), (2, None), (3, 11)], "query_id long, rank int")
    m = evaluate.ranking_metrics(ranks).first()
    assert (m["queries"], round(m["mrr"], 6), m["hit_1"], m["hit_5"], m["hit_10"]) == (4, 0.335227, 0.25, 0.5, 0.5)
    rel = values(spark, evaluate.relative_improvement(F.lit(0.0), F.lit(0.2)), evaluate.relative_improvement(F.lit(0.5), F.lit(0.4)), evaluate.relative_improvement(F.lit(0.0), F.lit(0.0)))
    assert [round(x, 6) for x in rel] == [100.0, -20.0, 0.0]
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (-100, 1), (2, 0)], "t int, p int")
    w = evaluate.weighted_metrics(rows, F.col("t"), F.col("p")).first()
    assert w["support"] == 4 and w["accuracy"] == 0.5 and math.isclose(w["precision"], (0.5 * 2 + 0.5 * 1 + 0) / 4) and math.isclose(w["recall"], 0.5)
    assert tuple(evaluate.weighted_metrics(rows.limit(0), F.col("t"), F.col("p")).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    p = values(spark, evaluate.group_probabilities(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), ["A", "B", "A"]))[0]
    assert p[0]["group"] == "A" and math.isclose(p[0]["p"], 2 / 3)


def test_fused_search_ties(spark):
    unit = lambda c: [c, math.sqrt(1 - c * c)]
    docs = spark.createDataFrame([(1, unit(0.9), unit(0.2)), (2, None, unit(0.9)), (3, [0.0, 0.0], [1.0])], "id long, f1 array<double>, f2 array<double>")
    ask = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, q array<double>")
    hits = search.fused_knn(ask, docs, id_col="id", fields={"f1": F.col("f1"), "f2": F.col("f2")}, query_fields={"f1": F.col("q"), "f2": F.col("q")}, k=3)
    assert [(r["id"], r["field"], r["rank"]) for r in hits.orderBy("rank").collect()] == [(1, "f1", 1), (2, "f2", 2)]
    assert search.fused_knn(ask.limit(0), docs, id_col="id", fields={"f": F.col("f1")}, query_fields={"f": F.col("q")}, k=1).count() == 0


def test_modes_disagree_only_where_they_should(spark):
    near = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 2), (1, 3, 0.2, 1)], "query_id long, id long, score double, rank int")
    text = spark.createDataFrame([(0, 7, 3.0, 1), (1, 8, 3.0, 1)], "query_id long, id long, score double, rank int")
    gold = spark.createDataFrame([(0, 2), (1, 9)], "query_id long, id long")
    flip = lambda h: h.select("query_id", "id", (3 - F.col("rank")).alias("rank"))
    run = lambda mode, **kw: sorted(tuple(r) for r in search.retrieve(mode, vector=lambda k: near, text=lambda k: text, narrow_text=lambda k: text, rerank=flip, gold=gold, **kw).collect())
    assert run("vector_only") == [(0, 1, 1), (0, 2, 2), (1, 3, 1)] and run("es_text_only") == [(0, 7, 1), (1, 8, 1)]
    assert run("oracle_gated") == [(0, 1, 2), (0, 2, 1), (1, 8, 2)] == run("score_gated", gate=0.5)
    assert run("vector_with_llm_always") == [(0, 1, 2), (0, 2, 1), (1, 3, 2)]
    with pytest.raises(ValueError):
        run("none")


def test_reconcile():
    clean, normal = resolve._clean, resolve._normal
    assert resolve.reconcile(["2. B", "x"], ["A", "B", "C"], clean, normal) == ["B", "A", "C"]
    assert resolve.reconcile(["link: https://en.wikipedia.org/wiki/%41b", "1) zz"], ["zzz", "https://zh.wikipedia.org/wiki/Ab"], clean, normal) == ["https://zh.wikipedia.org/wiki/Ab", "zzz"]
    assert resolve.reconcile([], ["a", "a", "b"], clean, normal) == ["a", "b"]


def test_greedy_against_a_loop(spark):
    rng = random.Random(5)
    offers = {(rng.randrange(60), rng.randrange(40)): (rng.randrange(1, 9), round(rng.random(), 2), rng.randrange(50)) for _ in range(600)}
    df = spark.createDataFrame([(q, o, *x) for (q, o), x in offers.items()], "q long, ord long, tier int, similarity double, place long")
    used, want = set(), {}
    for q in sorted({q for q, _ in offers}):
        mine = sorted((t, -s, p, o) for (x, o), (t, s, p) in offers.items() if x == q and o not in used)
        if mine:
            want[q] = mine[0][3]
            used.add(mine[0][3])
    for group in (1, 3, 1000):
        assert {r["q"]: r["ord"] for r in resolve.greedy_one_to_one(df, group=group).collect()} == want
    assert resolve.greedy_one_to_one(df.limit(0)).count() == 0


def test_one_preference_list_takes_few_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(resolve, "cut", lambda df, cut=resolve.cut: cuts.append(1) or cut(df))
    n, m = 1500, 1400
    q, o = spark.range(n).select(F.col("id").alias("q")), spark.range(m).select(F.col("id").alias("ord"))
    offers = q.crossJoin(o).select("q", "ord", F.lit(1).alias("tier"), F.lit(0.5).alias("similarity"), F.col("ord").alias("place"))
    got = {r["q"]: r["ord"] for r in resolve.greedy_one_to_one(offers, group=300).collect()}
    assert got == {i: i for i in range(m)}
    assert len(cuts) <= 1 + 2 * 7


def test_method_shares_against_a_loop(spark):
    from collections import Counter

    from lodestone.plans import catalog_entities

    folder = "/root/testdata/sf0.001"
    offers = resolve.candidates(catalog_entities.queries(spark, folder), catalog_entities.entities(spark, folder)).collect()
    used, methods = set(), Counter()
    for q in sorted({r["q"] for r in offers}):
        mine = sorted((r["tier"], -r["similarity"], r["place"], r["ord"], r["method"]) for r in offers if r["q"] == q and r["ord"] not in used)
        if mine:
            used.add(mine[0][3])
            methods[mine[0][4]] += 1
    got = {r["method"]: (r["n"], r["percent"]) for r in registry.queries()["match_methods"](spark, folder).collect()}
    assert got == {k: (n, round(100 * n / sum(methods.values()), 6)) for k, n in methods.items()}


def test_cascade(spark):
    wiki = "https://en.wikipedia.org/wiki/"
    entities = spark.createDataFrame(
        [(0, "F-16", wiki + "F-16", ["战隼"], ["Falcon"]), (1, "F-16", wiki + "F-16_B", [], []), (2, "AK-47", wiki + "AK%2D47", None, ["Kalashnikov rifle"]), (3, "Tank", wiki + "Tank", ["坦克"], [])],
        "ord long, label string, link string, aliases_zh array<string>, aliases_en array<string>")
    queries = spark.createDataFrame(
        [(0, "F-16 ", ""), (1, "F-16", wiki + "F-16_B#x"), (2, "Kalashnikov", ""), (3, "坦克", ""), (4, "nothing", "https://other/"), (5, "", wiki + "AK-47")], "q long, query string, link string")
    got = {r["q"]: (r["ord"], r["method"]) for r in resolve.match(queries, entities).collect()}
    assert got == {0: (0, "label_exact"), 1: (1, "url_title_exact"), 2: (2, "alias_fuzzy"), 3: (3, "alias_exact"), 4: (None, None), 5: (None, None)}


def test_contained_pairs_against_a_loop(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abc中 ", k=n))
    short, long = [word(rng.randrange(1, 6)) for _ in range(80)], [word(rng.randrange(1, 15)) for _ in range(80)]
    a, b = (spark.createDataFrame([(x,) for x in [*xs, None, ""]], f"{c} string") for xs, c in ((short, "s"), (long, "t")))
    got = {tuple(r) for r in records.contained_pairs(a, b, "s", "t").collect()}
    assert got == {(s, t) for s in short for t in long if s in t}
    pairs = spark.createDataFrame([("F16",)], "a string"), spark.createDataFrame([("f16a fighter",)], "b string")
    assert records.fuzzy_join(*pairs, "a", "b", 0.2).count() == 1


def test_records(spark):
    rows = spark.createDataFrame([(i,) for i in range(125)], "i long")
    assert [r["n"] for r in records.batches(rows, "i", 60).groupBy("batch").agg(F.count("i").alias("n")).orderBy("batch").collect()] == [60, 60, 5]
    split = lambda n: records.train_dev_split(rows.where(F.col("i") < n), "i").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split(11)} == {"train": 8, "dev": 3} and {r["split"]: r["count"] for r in split(10)} == {"train": 10}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "link string, target string")
    seeds = spark.createDataFrame([("a",), ("a",)], "link string")
    assert {tuple(r) for r in records.crawl(seeds, edges, "link", "target", 3).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {tuple(r) for r in records.crawl(seeds, edges, "link", "target").collect()} == {("a", 0), ("b", 1)}


def test_recommendations(spark):
    facts = spark.createDataFrame([(500, 0, 0.5, 2)], "train_samples long, dev_samples long, f1 double, epochs int")
    assert [(r["level"], r["category"]) for r in profile.recommendations(facts).orderBy("place").collect()] == [("error", "model"), ("warning", "data size"), ("warning", "validation"), ("warning", "epochs")]


def test_models(spark):
    df = spark.createDataFrame([("F-16 fighter",), (None,), (" ",)], "t string")
    got = [r["v"] for r in df.select(models.embed(lambda: models.HashingEmbedder(16), dim=20)("t").alias("v")).collect()]
    assert len(got[0]) == 20 and math.isclose(sum(x * x for x in got[0]), 1, rel_tol=1e-5) and got[1] is got[2] is None
    raw = df.select(models.embed(lambda: models.HashingEmbedder(16), dim=8, normalize=False)("t").alias("v")).first()["v"]
    assert len(raw) == 8
    words = spark.createDataFrame([(["a", "b", " "],), ([],), (None,)], "w array<string>")
    merged = [r["v"] for r in words.select(models.embed_words(lambda: models.HashingEmbedder(16))("w").alias("v")).collect()]
    assert math.isclose(sum(x * x for x in merged[0]), 1, rel_tol=1e-5) and merged[1] is merged[2] is None
    assert models.Gazetteer({"ab": "X", "abc": "Y"})("zabcab") == ["O", "B-Y", "I-Y", "I-Y", "B-X", "I-X"]
    out = values(spark, models.translate(F.array(F.lit("a"), F.lit("b"), F.lit("c")), {"a": "x", "b": "I don't think so."}), models.expand(F.lit("m"), {"m": "标签"}), models.expand(F.lit("n"), {}))
    assert out == [["x"], "标签", ""]


def test_runner(spark):
    step = lambda name, f, **kw: runner.Step(name, f, **kw)
    fail = lambda s: 1 / 0
    steps = [step("a", lambda s: {"x": 1}), step("b", fail, may_fail=True), step("c", lambda s: {"y": s["x"] + 1})]
    out = runner.run(steps)
    assert out.state == {"x": 1, "y": 2} and [o for _, o, _ in out.log] == ["done", "failed", "done"]
    assert runner.run(steps, {"x": 5}, start="c").state == {"x": 5, "y": 6} and [o for _, o, _ in runner.run(steps, {"x": 5}, skip=["a", "b"]).log] == ["skipped", "skipped", "done"]
    assert runner.run(steps).report(spark).count() == 3
    with pytest.raises(ValueError):
        runner.run(steps, skip=["z"])
    with pytest.raises(ZeroDivisionError):
        runner.run([step("b", fail)])


def test_reconciled_links_of_one_file_use_all_cores(spark):
    links = registry.queries()["reconciled_links"](spark, "/root/testdata/sf0.001")
    assert links.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_the_smaller_side_of_contained_pairs_is_packed_whole(spark, monkeypatch):
    packed = {}
    monkeypatch.setattr(records, "_packs", lambda df, name, *size, packs=records._packs: packed.update({name: df.rdd.getNumPartitions()}) or packs(df, name, *size))
    few = spark.createDataFrame([(f"a word {i}x",) for i in range(40)], "t string")
    many = spark.range(3000).select(F.col("id").cast("string").alias("s"))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in records.contained_pairs(many, few, "s", "t", patterns=100).collect()}
        assert packed == {"_s": 2, "_t": 1}
        assert got == {(str(n), f"a word {i}x") for i in range(40) for n in range(3000) if str(n) in f"a word {i}x"}
        back = {tuple(r) for r in records.contained_pairs(few, many.select(F.concat(F.lit("so a word "), "s", F.lit("x")).alias("u")), "t", "u", patterns=7).collect()}
        assert packed == {"_s": 1, "_t": 2}
        assert back == {(f"a word {i}x", f"so a word {i}x") for i in range(40)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def test_candidates_read_their_entities_once(spark):
    from lodestone.plans import catalog_entities

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(label):
        read.add(1)
        return label

    folder = "/root/testdata/sf0.001"
    entities = catalog_entities.entities(spark, folder)
    resolve.candidates(catalog_entities.queries(spark, folder), entities.withColumn("link", counted("link"))).count()
    assert read.value <= entities.count()
