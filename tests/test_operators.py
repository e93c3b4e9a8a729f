"""Known answers and invariants of the library's own operators."""

from __future__ import annotations

import itertools
import math
import pathlib
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import chunking, cleaning, graph, layout, records, retrieval, routing, scoring, structure, vectors
from foliospark.operators.components import connected_components
from foliospark.sources import exports, jsonl
from foliospark.streaming import feedback


def one(spark, column, **values):
    df = spark.range(1)
    for name, v in values.items():
        df = df.withColumn(name, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


def test_the_library_does_not_import_llm():
    package = pathlib.Path(structure.__file__).parents[1]
    for path in package.rglob("*.py"):
        if "llm" not in path.relative_to(package).parts:
            assert "foliospark.llm" not in path.read_text() and "import llm" not in path.read_text(), path


@pytest.mark.parametrize(("raw", "clean"), [("Deﬁnition", "Definition"), ("eﬀect", "effect"), ("−10 °C", "-10 °C"), ("1950–1999", "1950-1999"), ("l’hiver", "l'hiver"), ("km² m³ °C µm", "km² m³ °C µm"), ("so­ft", "soft")])
def test_unicode(spark, raw, clean):
    assert one(spark, T.normalize_unicode(F.col("t")), t=raw) == clean


def test_normal_forms(spark):
    assert one(spark, T.normalize_text(F.col("t")), t="  Élan-vital: Ça & là! ") == "elan vital ca la"
    assert one(spark, T.tokens(F.col("t")), t="A b2 C_d é, ÉTÉ") == ["b2", "c_d", "été"]
    assert one(spark, T.sentences(F.col("t")), t="This is one long sentence. And here is another one! short. Éte") == ["This is one long sentence.", "And here is another one! short."]


@pytest.mark.parametrize(("line", "is_number"), [("4", True), ("115", True), ("xii", True), ("page 12", True), ("p. 3", True), ("1963 was the coldest winter", False), ("", False), ("12345", False)])
def test_page_numbers(spark, line, is_number):
    assert one(spark, T.is_page_number(F.col("t")), t=line) is is_number


def test_language(spark):
    def verdict(text):
        t = F.col("t")
        return tuple(one(spark, T.language(T.signals(t, T.FRENCH), T.signals(t, T.ENGLISH), t), t=text))

    assert verdict("le chat est dans la maison et les chiens sont avec nous") == ("fr", 1.0)
    assert verdict("the cat is in the house and the dogs are with us")[0] == "en"
    assert verdict("  ") == ("unknown", 0.0) and verdict("xyz") == ("en", 0.0)


def test_hyphens(spark):
    words = spark.createDataFrame([("considered", 40), ("wellknown", 0)], "word string, n long")
    compounds = spark.createDataFrame([("well-known", 12)], "compound string, n long")
    breaks = spark.createDataFrame([(1, "con", "sidered"), (2, "well", "known"), (3, "new", "word")], "id int, head string, tail string")
    assert {r["id"]: r["repaired"] for r in cleaning.repair_hyphens(breaks, words, compounds).collect()} == {1: "considered", 2: "well-known", 3: "newword"}


def test_captions_and_glossary(spark):
    lines = [(1, 0, "ssp585"), (1, 1, "Fig. S11. Composite of the height anomalies over the region in winter days"), (1, 2, "(Z500) and more"), (2, 0, "Fig. S1. Trop court.")]
    found = cleaning.captions(spark.createDataFrame(lines, "doc_id int, pos int, line string")).collect()
    assert len(found) == 1 and found[0]["caption"].startswith("Fig. S11.") and "(Z500)" in found[0]["caption"] and "ssp585" not in found[0]["caption"]
    rows = [(1, 0, "Acronyms"), (1, 1, "NAO North Atlantic"), (1, 2, "Oscillation ..... 9, 12-14, ii"), (1, 3, "SWG Stochastic Generator .... 7")]
    entries = {r["acronym"]: r for r in cleaning.glossary(spark.createDataFrame(rows, "doc_id int, pos int, line string")).collect()}
    assert entries["NAO"]["expanded_form"] == "North Atlantic Oscillation" and entries["NAO"]["referenced_pages"] == [9, 12, 13, 14] and entries["NAO"]["referenced_pages_roman"] == ["ii"]
    assert entries["SWG"]["referenced_pages"] == [7]


@pytest.mark.parametrize(("page", "zone"), [(3, "front_matter"), (7, "summaries"), (12, "acknowledgements"), (14, "toc"), (60, "chapters"), (128, "acronyms"), (135, "bibliography"), (140, "lists_figures_tables"), (146, "appendix_a"), (160, "appendix_b"), (190, "appendix_c"), (900, "front_matter")])
def test_zones(spark, page, zone):
    assert structure.with_zone(spark.createDataFrame([(page,)], "page int")).first()["zone"] == zone


def test_thesis_pages_and_inclusion(spark):
    got = spark.createDataFrame([(p,) for p in (15, 16, 19, 130, 206)], "p int").select(structure.thesis_page(F.col("p")).alias("x")).collect()
    assert [r["x"] for r in got] == [None, 1, 4, 115, 191]
    cases = {("chapters", 500): (True, None), ("chapters", 0): (False, "page_blanche"), ("appendix_b", 500): (False, "annexe_b_hors_sujet"), ("appendix_c", 130): (False, "annexe_c_sans_texte_exploitable"), ("appendix_c", 151): (True, None), ("chapters", 50): (False, "page_quasi_vide_ou_titre_seul")}
    for (zone, n), want in cases.items():
        assert tuple(one(spark, structure.inclusion(F.col("z"), F.col("n")), z=zone, n=n)) == want


def test_headings(spark):
    h = lambda s: one(spark, structure.heading(F.col("t")), t=s)
    assert tuple(h("3.2 Data and methods")) == ("3.2", "Data and methods")
    assert h("3.2 Data . . . . 17") is None and h("plain line") is None


def blocks(spark, boxes):
    df = spark.createDataFrame([(1, i, *map(float, b), f"text of block number {i} that is long enough") for i, b in enumerate(boxes)], "page int, pos int, x0 double, y0 double, x1 double, y1 double, text string")
    return layout.classified(df, 595.0, 842.0)


def test_two_columns(spark):
    boxes = [(46, y, 287, y + 60) for y in (100, 200, 300)] + [(307, y, 548, y + 60) for y in (100, 200, 300)]
    b = blocks(spark, boxes)
    lay = layout.layouts(b)
    assert lay.first()["layout"] == "double_column"
    order = layout.naive_order(layout.reading_order(b, lay))
    assert [r["pos"] for r in order.orderBy("nth").collect()] == [0, 1, 2, 3, 4, 5]
    assert layout.alternations(order, "nth").first()["switches"] == 1 and layout.alternations(order, "naive").first()["switches"] > 1


def test_full_block_cuts_columns(spark):
    boxes = [(46, y, 287, y + 40) for y in (100, 200, 400)] + [(307, y, 548, y + 40) for y in (100, 200, 400)] + [(46, 300, 548, 330)]
    b = blocks(spark, boxes)
    lay = layout.layouts(b)
    assert lay.first()["layout"] == "mixed_layout"
    assert [r["pos"] for r in layout.reading_order(b, lay).orderBy("nth").collect()] == [0, 1, 3, 4, 6, 2, 5]


def test_single_column_and_paragraphs(spark):
    boxes = [(61, 100, 458, 112), (61, 114, 458, 126), (61, 128, 300, 140), (61, 142, 458, 154)]
    b = blocks(spark, boxes)
    lay = layout.layouts(b)
    assert lay.first()["layout"] == "single_column"
    assert [r["group"] for r in layout.paragraphs(layout.reading_order(b, lay), 595.0).orderBy("nth").collect()] == [1, 1, 1, 2]


def test_as_of(spark):
    events = spark.createDataFrame([("a", 1, 10), ("a", 5, 11), ("a", 9, 12), ("b", 5, 13)], "k string, at int, id int")
    marks = spark.createDataFrame([("a", 5, "x"), ("a", 8, "y"), ("c", 1, "z")], "k string, at int, v string")
    assert {r["id"]: r["v"] for r in structure.as_of(events, marks, "k", "at", ["v"]).collect()} == {10: None, 11: "x", 12: "y", 13: None}


def test_windows_cover_the_text():
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice(["word ", "a. ", "\n", "longerword"]) for _ in range(rng.randint(0, 800)))
        for size, step in ((900, 900), (900, 650), (50, 30)):
            found = chunking.windows(text, size, step)
            assert all(0 < len(c) <= size for c in found)
            assert "".join(sorted(set("".join(found)))) == "".join(sorted(set("".join(text.split(" "))) | ({" "} if any(" " in c for c in found) else set()))).replace("\n", "\n" if any("\n" in c for c in found) else "")
    assert chunking.windows("", 10, 5) == []


def test_recursive_chunks_keep_all_words():
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "beta", "gamma.", "delta;\n\n"]) for _ in range(3000))
    found = chunking.recursive(text, 200, 40)
    assert all(len(c) <= 200 for c in found) and set(" ".join(found).split()) == set(text.split())
    assert chunking.recursive("short") == ["short"] and chunking.recursive("") == []


def test_semantic_chunks():
    same = "The cat sat on the mat here. " * 60
    assert len(chunking.semantic(same)) == 2 and chunking.semantic("") == []
    mixed = "Cats like the warm sunny mat a lot. " * 10 + "Engines burn diesel fuel under pressure. " * 10
    assert any("Engines" not in c for c in chunking.semantic(mixed)) and len(chunking.semantic(mixed)) >= 2


def test_sentence_packing(spark):
    df = spark.createDataFrame([(1, "A first sentence of some length. A second sentence of some length. " * 20)], "doc_id int, text string")
    found = [r["text"] for r in chunking.sentence_based(df, 100).orderBy("nth").collect()]
    assert all(len(c) <= 100 for c in found) and len(" ".join(found)) == len(df.first()["text"].strip())


def test_min_max(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    got = rows.select(chunking.min_max("a").alias("x"), chunking.min_max("a", True).alias("y"), chunking.min_max("b").alias("z"), chunking.min_max("b", True).alias("w")).orderBy("x").collect()
    assert [tuple(r) for r in got] == [(0.0, 1.0, 1.0, 0.0), (1 / 3, 1 - 1 / 3, 1.0, 0.0), (1.0, 0.0, 1.0, 0.0)]


def test_ir_metrics(spark):
    rows = [(1, 1, True, 2), (1, 2, False, 2), (1, 3, True, 2), (2, 1, False, 1), (2, 2, True, 1), (3, 1, False, 0)]
    got = {r["query_id"]: r for r in retrieval.ir_metrics(spark.createDataFrame(rows, "query_id int, rank int, relevant boolean, total_relevant int"), 2).collect()}
    assert (got[1]["precision_at_k"], got[1]["recall_at_k"], got[1]["rr"]) == (0.5, 0.5, 1.0) and got[1]["ap"] == pytest.approx((1 + 2 / 3) / 2, abs=1e-6)
    assert got[2]["rr"] == 0.5 and got[2]["ndcg_at_k"] == pytest.approx(1 / math.log2(3), abs=1e-6)
    assert (got[3]["ap"], got[3]["rr"], got[3]["ndcg_at_k"]) == (0.0, 0.0, 0.0)


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 10, 2), (1, 13, 3)], "query_id int, doc_id int, rank int")
    x, y = (retrieval.fuse(r, 5).orderBy("rank").collect() for r in ([a, b], [b, a]))
    assert x == y and x[0]["doc_id"] == 10 and x[0]["score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-6)


def test_dense_in_blocks_is_the_same(spark):
    rng = random.Random(3)
    v = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(60)], "doc_id long, embedding array<double>")
    q = v.where("doc_id % 7 = 0").withColumnRenamed("doc_id", "query_id")
    assert sorted(map(tuple, retrieval.dense(v, q, 3).collect())) == sorted(map(tuple, retrieval.dense(v, q, 3, block=2).collect()))


def test_pair_mean(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [rng.random() for _ in range(3)]) for i in range(9)]
    got = {r["label"]: r["mean_similarity"] for r in vectors.pair_mean(spark.createDataFrame(rows, "vec_id int, label int, embedding array<double>"), ["label"]).collect()}
    for label in (0, 1):
        own = [v for _, k, v in rows if k == label]
        pairs = [sum(a * b for a, b in zip(x, y, strict=True)) for x, y in itertools.combinations(own, 2)]
        assert got[label] == pytest.approx(sum(pairs) / len(pairs), abs=1e-6)


def test_projections(spark, data_dir):
    v = spark.read.parquet(f"{data_dir}/embeddings.parquet")
    pcs, shares = vectors.pca(v)
    assert shares[0] >= shares[1] > 0 and pcs.count() == v.count()
    assert pcs.agg(F.abs(F.avg(F.col("pc")[0]))).first()[0] < 1e-6
    latent, values = vectors.svd(v, 8)
    assert values == sorted(values, reverse=True) and latent.agg(F.max(F.abs(vectors.dot(F.col("latent"), F.col("latent")) - 1))).first()[0] < 1e-6
    assert vectors.kmeans(v).select("cluster").distinct().count() == 8


EDGES = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)]


def test_graph_of_two_triangles(spark):
    e = spark.createDataFrame(EDGES, "u long, v long")
    p = spark.createDataFrame([(n, 1 if n < 4 else 4) for n in range(1, 7)], "node long, community long")
    assert graph.modularity(e, p).first()["modularity"] == pytest.approx(5 / 14, abs=1e-8)
    assert graph.modularity(e, p.withColumn("community", F.lit(1))).first()["modularity"] == 0
    assert {r["node"]: r["community"] for r in graph.louvain(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert sum(r["degree"] for r in graph.degrees(e).collect()) == 2 * len(EDGES)
    c = {r["node"]: r for r in graph.path_centralities(e).collect()}
    assert c[3]["betweenness"] == pytest.approx(0.6) and c[1]["betweenness"] == 0 and c[3]["closeness"] == pytest.approx(5 / 7, abs=1e-8)
    assert graph.density(e).first()["density"] == pytest.approx(14 / 30, abs=1e-8)


def test_components_of_random_graphs(spark):
    rng = random.Random(6)
    for n, m in ((30, 20), (200, 150), (100, 99)):
        edges = [(i, i + 1) for i in range(m)] if m == 99 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        root = list(range(n))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    once = graph.upsert(old, new, "k")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "e")] == sorted(map(tuple, graph.upsert(once, new, "k").collect()))


def test_cooccurrence_confidence(spark):
    occ = spark.createDataFrame([(c, e) for c in (1, 2) for e in ("x", "y")] + [(3, "x")], "chunk_id int, entity string")
    r = graph.cooccurrences(occ).first()
    assert (r["a"], r["b"], r["n"], r["confidence"]) == ("x", "y", 2, 0.537889)


FIXPOINTS = {"semantic": ("use_vector", 2.35), "relational": ("use_graph", 2.35), "hybrid": ("use_hybrid", 2.05), "unknown": ("abstain", 1.9)}


def test_training_reaches_its_fixpoints():
    assert routing.epsilon(0) == 0.3 and routing.epsilon(159) == 0.05
    groups = [(f"{t}|entity_{e}|coverage_high", t, 2) for t in routing.TYPES for e in (0, 1)]
    route, post, history = routing.train(groups, 160)
    assert post["context_found"][0] == pytest.approx(1.5, abs=0.05) and post["context_empty"][1] == pytest.approx(1.0, abs=0.05)
    best = {s.split("|")[0]: (routing.ACTIONS[max(range(4), key=v.__getitem__)], max(v)) for s, v in route.items()}
    for t, (action, value) in FIXPOINTS.items():
        assert best[t][0] == action and best[t][1] == pytest.approx(value, abs=0.1)
    assert history[-1]["routing_accuracy"] > 0.9 and history[0]["epoch"] == 1 and history[0]["routing_accuracy"] == 0.25
    assert (route, post) == routing.train(groups, 160)[:2] and routing.train([], 5)[2] == []
    assert [history[k]["mean_reward"] for k in (0, 80, 159)] == sorted(history[k]["mean_reward"] for k in (0, 80, 159))


def test_training_against_drawn_steps():
    """The same rewards, question by question with drawn actions: the same policy, and values that differ by the draws alone."""
    rng, groups = random.Random(5), [(f"{t}|entity_1|coverage_low", t, 3 + i) for i, t in enumerate(routing.TYPES)]
    values, after = {s: dict.fromkeys(routing.ACTIONS, 0.0) for s, _, _ in groups}, {c: dict.fromkeys(routing.POST_ACTIONS, 0.0) for c in routing.POST_STATES}

    def draw(row, eps):
        return rng.choice([k for k in row if rng.random() < eps or math.isclose(row[k], max(row.values()))] or list(row))

    for epoch in range(160):
        for s, t in rng.sample([(s, t) for s, t, n in groups for _ in range(n)], sum(n for _, _, n in groups)):
            a = draw(values[s], routing.epsilon(epoch))
            hit = a == routing.EXPECTED[t]
            c = ("context_empty" if t == "unknown" else "context_found") if hit else "context_weak"
            b = draw(after[c], routing.epsilon(epoch))
            want = "abstain" if t == "unknown" else "answer" if hit else "escalate_hybrid"
            after[c][b] += 0.1 * ((1 if b == want else -1) + (0.5 if c == "context_found" else 0) - after[c][b])
            values[s][a] += 0.1 * ((1 if hit else -1) - (0.3 if a == "use_hybrid" else 0) + 0.9 * max(after[c].values()) - values[s][a])
    route, post, _ = routing.train(groups)
    for s, t, _ in groups:
        a = max(values[s], key=values[s].get)
        assert a == FIXPOINTS[t][0] == routing.ACTIONS[max(range(4), key=route[s].__getitem__)]
        assert values[s][a] == pytest.approx(max(route[s]), abs=0.1)
    assert max(post["context_weak"]) == pytest.approx(max(after["context_weak"].values()), abs=0.3)


def test_confidences(spark):
    q = F.array(*map(F.lit, (2.0, 1.0, 0.0, -1.0)))
    total = sum(math.exp(x) for x in (2, 1, 0, -1))
    assert one(spark, routing.final_confidence(q, F.lit("use_graph"), F.lit(0.4))) == pytest.approx(0.5 * math.e / total + 0.2, abs=1e-6)
    c = lambda a: one(spark, routing.context_confidence(F.lit(a), F.lit(0.8), F.lit(2)))
    assert (c("abstain"), c("use_vector"), c("use_graph")) == (1.0, 0.8, 0.4) and c("use_hybrid") == pytest.approx(0.62)


def test_feedback_stream_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", rng.choice("ab"), rng.choice("xy"), rng.choice([0.5, -0.5])) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, ts string, state string, action string, reward double").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(3):
        df.where(F.floor(F.col("event_id") / 100) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    df.where("event_id = 299").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # an event that comes twice counts once
    got = {(r["state"], r["action"]): (r["q"], r["n"]) for r in feedback.run(spark, f"{tmp_path}/in", f"{tmp_path}/values", f"{tmp_path}/checkpoint").collect()}
    want: dict = {}
    for _, _, s, a, r in rows:
        q, n = want.get((s, a), (0.0, 0))
        want[(s, a)] = (q + routing.ALPHA * (r - q), n + 1)
    assert got.keys() == want.keys()
    for k, (q, n) in want.items():
        assert got[k][1] == n and got[k][0] == pytest.approx(q, abs=1e-6)


def test_nearest_and_answers(spark):
    known = spark.createDataFrame([(1, "cold winter of 1963"), (2, "jet stream")], "known_id int, question string")
    asked = spark.createDataFrame([(7, "the winter of 1963"), (8, "nothing")], "question_id int, question string")
    assert [tuple(r) for r in routing.nearest(asked, known).collect()] == [(7, 1, 0.6)]
    a = lambda **k: one(spark, routing.answer(F.lit(k.get("action", "use_vector")), F.lit(k.get("kind", "semantic")), F.lit(k.get("match", 0.9)), F.lit("gold"), F.lit(k.get("context", 0.9)), F.lit("text"), k.get("serve", False)))
    assert (a(), a(serve=True), a(context=0.1), a(kind="unknown"), a(action="abstain")) == ("text", "gold", routing.UNKNOWN, routing.UNKNOWN, routing.UNKNOWN)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é\nx"), (2, None)], "k int, v string")
    jsonl.write(df, f"{tmp_path}/a")
    jsonl.write(df, f"{tmp_path}/a")
    assert sorted(map(tuple, jsonl.read(spark, f"{tmp_path}/a", "k int, v string").collect())) == [(1, "é\nx"), (2, None)]
    built = []
    for _ in range(2):
        exports.build(spark, f"{tmp_path}/b", lambda: built.append(1) or df)
    assert len(built) == 1 and exports.build(spark, f"{tmp_path}/b", lambda: built.append(1) or df, force=True).count() == 2 and len(built) == 2
    counts = exports.fan_out(df, f"{tmp_path}/c", {"one": F.col("k") == 1, "rest": F.col("k") > 1})
    assert counts == {"one": 1, "rest": 1}
    assert exports.checksums(spark, f"{tmp_path}/a/*.json").count() >= 1


def test_windows_against_a_plain_search():
    rng = random.Random(31)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", " ", ". ", "\n", "."]) for _ in range(rng.randint(0, 60)))
        size, step = rng.randint(2, 15), rng.randint(1, 15)
        spans = chunking.window_spans(text, size, step)
        assert [x for x in (text[a:b].strip() for a, b in spans) if x] == chunking.windows(text, size, step)
        for (a, b), after in zip(spans, [*spans[1:], None], strict=False):
            if a + size < len(text):
                ends = [e for e in range(a + size // 2 + 1, a + size + 1) if text[e - 1] == "\n" or text[e - 1 : e + 1] == ". " and e < a + size]
                assert b == (ends[-1] if ends else a + size)
            if after:
                assert after[0] == max(a + 1, min(b, a + step))


def test_recursive_levels():
    text = "aa bb. cc dd\n\nee ff gg hh; ii, jj kk ll mm nn"
    assert chunking.recursive(text, 12, 0) == ["aa bb. cc dd", "ee ff gg hh", "; ii", ", jj kk ll", "mm nn"]
    assert chunking.recursive("one two three four five", 9, 4) == ["one two", "three", "four", "five"]
    assert chunking.recursive("a b c d e f g", 6, 3) == ["a b c", "c d e", "e f g"]
    assert chunking.recursive("x" * 50, 10, 0) == ["x" * 50]


def test_semantic_against_a_plain_fold():
    rng = random.Random(32)
    for _ in range(60):
        said = [" ".join(rng.choice("sun moon star rain wind snow".split()) for _ in range(rng.randint(5, 60))).capitalize() + "." for _ in range(rng.randint(1, 25))]
        said = [s for s in said if len(s) >= 20]
        if not said:
            continue
        v = chunking._sentence_vectors(said)
        want, held = [], [said[0]]
        for i in range(1, len(said)):
            size = len(" ".join(held))
            if size + 1 + len(said[i]) > chunking.SEMANTIC_SIZE or size >= chunking.SEMANTIC_LEAST and float((v[i - 1] * v[i]).sum()) < chunking.SEMANTIC_COSINE:
                want.append(" ".join(held))
                held = []
            held.append(said[i])
        assert chunking.semantic(" ".join(said)) == [*want, " ".join(held)]


def test_alias_of_any_length_and_acronyms(spark):
    chunks = spark.createDataFrame([(1, "The North Atlantic Oscillation index, or NAO, of winter"), (2, "nao and SNAOX are not it; the oscillations neither"), (3, None), (4, "Éte: NAO.")], "chunk_id long, text string")
    entities = spark.createDataFrame([("NAO", "NAO"), ("NAO", "north atlantic oscillation"), ("osc", "oscillation"), ("none", "..."), ("ete", "été"), (None, "x")], "entity string, alias string")
    want = {(1, "NAO"), (1, "osc"), (2, "osc"), (4, "NAO"), (4, "ete")}
    for block in (100, 2):
        found = [tuple(r) for r in graph.occurrences(chunks, entities, block).collect()]
        assert set(found) - {(4, "ete")} == want - {(4, "ete")} and len(found) == len(set(found))


def test_hyphens_in_texts_by_vote(spark):
    docs = spark.createDataFrame([(1, "a well-\nknown inter-\nnational fact"), (2, "well-known well-known wellknown international"), (3, "no break"), (4, None)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in cleaning.repair_texts(docs, cleaning.word_frequencies(docs), cleaning.hyphen_frequencies(docs)).collect()}
    assert out == {1: "a well-known international fact", 2: "well-known well-known wellknown international", 3: "no break", 4: None}


def test_clean_groups(spark):
    rows = [
        (1, 0, 0, 50.0, 20.0, 30.0, "header", "Title of the page"), (1, 1, 1, 50.0, 100.0, 110.0, "body", "First line of text"), (1, 1, 2, 50.0, 112.0, 122.0, "body", "and second line."),
        (1, 2, 3, 30.0, 200.0, 230.0, "body", "180\nA line with a number in its margin"), (1, 3, 4, 50.0, 400.0, 410.0, "body", "5000"), (1, 4, 5, 50.0, 420.0, 430.0, "body", "17"), (1, 5, 6, 50.0, 800.0, 810.0, "body", "42"), (1, 6, 7, 50.0, 500.0, 510.0, "body", "ok"),
    ]
    blocks = spark.createDataFrame(rows, "page int, group int, nth int, x0 double, y0 double, y1 double, band string, text string")
    numbers = spark.createDataFrame([(1, ["17"])], "page int, tokens array<string>")
    r = cleaning.clean_groups(blocks, numbers, 842.0).first()
    assert r["text"] == "Title of the page\n\nFirst line of text and second line.\n\nA line with a number in its margin\n\n5000\n\nok" and r["page_numbers_removed"] == 2 and r["margin_groups"] == 1
    assert "ok" not in cleaning.clean_groups(blocks, numbers, 842.0, 5).first()["text"].split("\n\n")


def test_double_columns_by_hand(spark):
    from foliospark.operators import layout

    rows = [(1, 0, 46.0, 100.0, 287.0, 112.0, "left one"), (1, 1, 307.0, 100.0, 548.0, 112.0, "right one"), (1, 2, 46.0, 120.0, 287.0, 132.0, "left two"), (1, 3, 307.0, 120.0, 548.0, 132.0, "right two")]
    blocks = layout.classified(spark.createDataFrame(rows, "page int, pos int, x0 double, y0 double, x1 double, y1 double, text string"), 595.0, 842.0)
    r = layout.double_column_check(layout.reading_order(layout.naive_order(blocks), layout.layouts(blocks)), 595.0).first()
    assert (r["n_left"], r["n_right"], r["bands"], r["switches_nth"], r["switches_naive"], r["apart"]) == (2, 2, 1, 1, 3, True) and r["widest_share"] == 0.405


def test_manifest_and_documents(spark, tmp_path):
    from foliospark.sources import exports

    exports.manifest(spark, str(tmp_path / "m"), {"a": [1, 2], "é": None})
    assert exports.read_manifest(spark, str(tmp_path / "m")) == {"a": [1, 2], "é": None}
    with pytest.raises(ValueError):
        exports.manifest(spark, str(tmp_path / "n"), {"a": float("nan")})
    for name, data in (("a.txt", "é text".encode()), ("b.bin", b"\xff\xfe\x00\x80"), ("c.txt", b""), ("d.pdf", b"%PDF-1.7 /Encrypt 5 0 R")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in exports.open_documents(spark, str(tmp_path / "in" / "*")).collect()}
    assert got == {"a.txt": ("é text", None), "b.bin": (None, "not text"), "d.pdf": (None, "encrypted")}


def test_saved_encoder_gives_the_same_ranking(spark, tmp_path):
    from foliospark.operators import scoring, vectors

    rng = random.Random(33)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta".split()) for _ in range(12))) for i in range(40)], "doc_id long, text string")
    q = docs.where("doc_id < 5").withColumnRenamed("doc_id", "query_id")
    held = q.select("query_id", F.col("query_id").alias("doc_id"))
    out = {r["method"]: r for r in vectors.run_embeddings(docs, q, held, str(tmp_path / "best")).collect()}
    assert set(out) == set(vectors.KINDS) and sum(r["winner"] for r in out.values()) == 1 and all(r["mrr"] > 0.9 for r in out.values())
    best = next(m for m, r in out.items() if r["winner"])
    a, b = vectors.fit_encoder(docs, best), vectors.load_encoder(spark, str(tmp_path / "best"))
    assert sorted(scoring.top(spark, a.scorers(docs, q), 3).collect()) == sorted(scoring.top(spark, b.scorers(docs, q), 3).collect())


def test_hybrid_is_the_fusion_of_whole_rankings(spark):
    rng = random.Random(34)
    vocabulary = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    docs = spark.createDataFrame([(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 15)))) for i in range(400)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "kappa iota theta")], "query_id long, text string")
    from foliospark.operators import scoring, vectors

    one, two = retrieval.bm25_scorers(docs, q), vectors.sparse_scorers(docs, q, vectors.word_grams(F.col("text")), idf=False)
    whole = retrieval.fuse([retrieval.ranked(scoring.top(spark, x, 400), None) for x in (one, two)], 5)
    assert sorted(map(tuple, retrieval.hybrid(spark, one, two, 5).select("query_id", "doc_id", "rank").collect())) == sorted(map(tuple, whole.select("query_id", "doc_id", "rank").collect()))


def test_chunking_run(spark):
    pages = spark.createDataFrame([(i, " ".join(f"Word{i} stands in sentence {k} of the page." for k in range(40))) for i in range(6)], "doc_id long, text string")
    q = spark.createDataFrame([(i, f"word{i} stands") for i in range(6)], "query_id long, text string")
    out = chunking.run_chunking(pages, q, q.select("query_id", F.col("query_id").alias("doc_id")), ["fixed_size", "sentence_based", "recursive"]).collect()
    assert len(out) == 3 and sum(r["winner"] for r in out) == 1
    assert all(r["recall_at_5"] > 0 and 0 <= r["global_score"] <= 1 and r["intra_similarity"] > r["inter_similarity"] - 1 for r in out)
    assert next(r for r in out if r["winner"])["global_score"] == max(r["global_score"] for r in out)


def test_boundary_repairs_by_hand(spark):
    words = spark.createDataFrame([("considered", 40), ("replace", 2), ("cold", 9), ("wave", 7), ("firstform", 1)], "word string, n long")
    compounds = spark.createDataFrame([("well-known", 12)], "compound string, n long")
    pages = [
        (1, 1, "a con- "), (1, 2, "Figure 2\n\nother text\n\nsidered it"),  # the attested paragraph, not the first
        (2, 1, "so well-"), (2, 2, "FIGURE"), (2, 3, "known"),  # a page skipped
        (3, 1, "the cold-"), (3, 2, "wave came"),  # both members are words
        (4, 1, "some re-"), (4, 2, "placement is"),  # neither
        (5, 1, "gap re-"), (5, 3, "place"),  # a page is missing
        (6, 1, "end re-"), (6, 2, None), (6, 3, ""), (6, 4, "Upper"), (6, 5, "place"),  # too far
        (7, 1, None), (7, 2, "a-"),
    ]
    out = cleaning.boundary_repairs(spark.createDataFrame(pages, "doc int, page int, text string"), words, compounds).collect()
    got = {r["doc"]: (r["right_page"], r["repaired"], r["confidence"], r["reason"], list(r["skipped_pages"])) for r in out}
    assert got == {
        1: (2, "considered", 1.0, "joined", []), 2: (3, "well-known", 0.9, "compound", [2]), 3: (2, "cold-wave", 0.75, "compound, not attested", []), 4: (2, "replacement", 0.75, "joined, not attested", []),
        5: (None, None, 0.0, "no continuation", []), 6: (None, None, 0.0, "no continuation", [2, 3, 4]),
    }


def test_page_headings(spark):
    got = [one(spark, structure.page_heading(F.split(F.col("t"), "\n\n")), t=t) for t in ("1.1.2\nDefinition of events\nmore", "text\n\n3.1 Attribution", "Conclusions . . . . 107", "2\nOne . . . . 3", "", "7")]
    assert [tuple(x) if x else None for x in got] == [("1.1.2", "Definition of events"), ("3.1", "Attribution"), None, None, None, None]


def test_sections_and_references_by_hand(spark):
    from foliospark.operators import records

    toc = structure.contents(spark.createDataFrame([(1, 0, 1, "bad"), (1, 16, 1, "One"), (1, 17, 2, "A"), (1, 20, 2, "B"), (1, 34, 1, "Two")], "doc int, page int, level int, title string"))
    assert {(r["page"], r["chapter_number"]) for r in toc.collect()} == {(16, "1"), (17, None), (20, None), (34, "2")}
    pages = spark.createDataFrame([(1, p, ("1.1", "Own") if p == 18 else None) for p in (15, 16, 17, 18, 19, 20, 34, 35)], "doc int, page int, own_heading struct<number: string, title: string>")
    got = {r["page"]: (r["chapter_number"], r["section_number"], r["section_title"], r["section_inherited"]) for r in structure.with_sections(pages, toc).collect()}
    assert got == {
        15: (None, None, None, False), 16: ("1", None, None, False), 17: ("1", None, "A", False), 18: ("1", "1.1", "Own", False), 19: ("1", "1.1", "Own", True), 20: ("1", None, "B", False),
        34: ("2", None, None, False), 35: ("2", None, None, False),
    }

    texts = {16: "body\n\nReferences are cited here.", 17: "body one\n\nReferences.\n\nSmith 2000", 18: "Jones 2001\n\nBibliography\n\nLee", 19: "", 20: "next article", 34: "Reference list:\n\nKim", 35: "after"}
    rows = [("d", "f", "s", 1, p, p - 15, None, "C", p != 20, None, "single_column", "raw " + t, t, len(t), 9, []) for p, t in texts.items()]
    schema = "document_id string, source_file string, source_sha256 string, doc int, page int, thesis_page int, chapter_number string, chapter_title string, keep_for_rag boolean, exclusion_reason string, extraction_mode string, raw_text string, clean_text string, clean_char_count int, estimated_word_count int, warnings array<string>"
    kept, lists = records.move_references(spark.createDataFrame(rows, schema), toc)
    assert {r["page"]: (r["article"], r["section"], r["partial_page"], r["raw_text"], r["clean_text"]) for r in lists.collect()} == {
        17: ("A", "References.", True, "References.\n\nSmith 2000", "References.\n\nSmith 2000"), 18: ("A", "References.", False, "raw " + texts[18], texts[18]), 34: ("B", "Reference list:", False, "raw " + texts[34], texts[34]),
    }
    left = {r["page"]: (r["clean_text"], r["keep_for_rag"], r["exclusion_reason"], r["estimated_word_count"], list(r["warnings"])) for r in kept.collect()}
    assert left[17] == ("body one", True, None, 2, ["references moved"]) and left[18][:3] == ("", False, "references_internes_article")
    assert left[16][0] == texts[16] and left[20] == ("next article", False, None, 9, []) and left[35][0] == "after" and left[19][1]
    assert len(kept.columns) == len(rows[0])


def test_service_reports(spark, tmp_path):
    from foliospark.service import Service

    chunks = spark.createDataFrame([(1, "cold air over the sea brings snow to the coast"), (2, "a graph of entities and their relations"), (3, "warm summers and dry soil in the south")], "doc_id long, text string")
    entities = spark.createDataFrame([("snow", "snow"), ("snow", "sleet")], "entity string, alias string")
    relations = spark.createDataFrame([(1, "snow", "sea"), (2, "sea", "coast")], "relation_id int, u string, v string")
    service = Service(chunks, entities, relations, routing.states(spark).withColumn("action", F.lit("use_vector")).withColumn("q", F.lit(1.0)))
    questions = spark.createDataFrame([(7, "snow on the coast"), (8, "relations of entities")], "query_id long, text string")
    with pytest.raises(ValueError):
        service.chunking()
    with pytest.raises(ValueError):
        Service(chunks, entities, relations, service.q_table, {"other": chunks})
    assert service.evaluation().count() == 0 and service.vectorial().first().asDict() == {"chunks": 3, "chunking_winner": None, "embeddings_winner": None, "dimension": None, "retrieval_winner": None}
    service.reports["retrieval"] = service.compare(questions, spark.createDataFrame([(7, 1), (8, 2)], "query_id long, doc_id long"))
    assert service.vectorial().first()["retrieval_winner"] == "bm25" and {r["mrr"] for r in service.reports["retrieval"].collect()} == {1.0}
    assert tuple(service.graph_status().first()) == (3, 2, 1, 2, True)
    assert [r["doc_id"] for r in service.plot("graph relations", 1).where("nearest").collect()] == [2]
    service.save(str(tmp_path / "s"))
    again = Service.load(spark, str(tmp_path / "s"))
    assert list(again.reports) == ["retrieval"] and again.graph().count() == 5 and again.evaluation().count() == 2


def test_cohesion_sends_sums_only(spark, monkeypatch):
    def exploded(*_):
        raise AssertionError("vectors are exploded into rows")

    texts = ["One sentence about the weather here. Another sentence about the harbour. A third sentence, quite unlike.", "Only one sentence stands in this chunk", "", "The same words come twice again. The same words come twice again."]
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, nth int, text string")
    v = chunking._sentence_vectors(texts).astype(float)
    pairs = [float(v[i] @ v[j]) for i in range(4) for j in range(4) if i != j]
    said = [[p for p in t.replace(". ", ".|").split("|") if len(p) >= 20] for t in texts]
    means = []
    for parts in (p for p in said if len(p) > 1):
        w = chunking._sentence_vectors(parts).astype(float)
        means.append(np.mean([w[i] @ w[j] for i in range(len(w)) for j in range(len(w)) if i != j]))
    with monkeypatch.context() as m:
        m.setattr(vectors, "pair_mean", exploded)
        got = chunking.cohesion(chunks)
    assert np.allclose(got, (np.mean(means), np.mean(pairs)), atol=2e-6)


def test_labelled_sums_hold_no_pairs_on_the_driver(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)], rng.choice((0, 1, None))) for i in range(300)] + [(300, None, 1)]  # many ties
    v = spark.createDataFrame(rows, "doc_id long, embedding array<float>, label int")
    q = v.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")

    def collected(*_):
        raise AssertionError("pairs reach the driver")

    with monkeypatch.context() as m:
        for name in ("toPandas", "collect"):
            m.setattr(type(v), name, collected)
        out = scoring.labelled_sums(v, q, 5, block=4)
    got = {r["query_id"]: tuple(r)[1:] for r in out.collect()}
    want = {}
    for i, e, label in rows:
        if i % 10 or e is None or label is None:
            continue
        order = sorted((r for r in rows if r[1] is not None), key=lambda r: (-sum(a * b for a, b in zip(e, r[1], strict=True)), r[0]))
        ranks = [n for n, r in enumerate(order, 1) if r[2] == label]
        top = [n for n in ranks if n <= 5]
        want[i] = (len(top), len(ranks), sum(h / n for h, n in enumerate(ranks, 1)), ranks[0], sum(1 / math.log2(n + 1) for n in top))
    assert got.keys() == want.keys()
    assert all(np.allclose(got[i], want[i]) for i in want)


def test_text_vocabulary_counts_what_lists_of_terms_count(spark):
    rng = random.Random(9)
    said = ["Été", "über", "a", "snow", "wind", "cold_1", "ice", "frost", "thaw", "hail"]
    rows = [(i, None if i == 7 else "" if i == 8 else " ".join(rng.choices(said, weights=range(1, 11), k=rng.randint(1, 30)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    texts = docs.select(F.lower("text").alias("text"))
    for kind, grams in (("word", vectors.word_grams), ("char", vectors.char_grams)):
        for most in (3, 12, 25, 10_000):
            want = vectors.vocabulary(docs.select("doc_id", grams(F.col("text")).alias("terms")), 2, most)
            got = vectors.text_vocabulary(texts, kind, 2, most)
            assert got[0] == want[0] and np.allclose(got[1], want[1])
    words = ["cold_1", "frost", "hail", "ice", "thaw", "wind"]
    for least in (2, 40):
        pairs, more = scoring.frequent_pairs(texts, words, least, unit=300)  # several units
        found = {f"{words[r['a']]} {words[r['b']]}": r for r in pairs.collect()}
        exact = {r["term"]: r for r in scoring.frequencies(docs.select(vectors.word_grams(F.col("text")).alias("terms"))).collect() if all(w in words for w in r["term"].split())}
        for term in (t for t in exact if " " in t and exact[t]["total"] >= least):
            r = found[term]
            assert r["total"] <= exact[term]["total"] <= r["total"] + r["others"] * (more - 1) and r["df"] <= exact[term]["df"]


def test_pages_are_cleaned_once_and_breaks_alone_repaired(spark, monkeypatch):
    head = "Running  Head 12"
    rows = [(i, f"{head}\nsome text of page {chr(97 + i)}{chr(97 + i)} with consid-\nered words" if i % 2 else f"{head}\nsome text of page {chr(97 + i)}{chr(97 + i)}") for i in range(6)] + [(6, None), (7, "consideration considered considered")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, cleaning.running_keys(docs).collect())) == sorted(map(tuple, cleaning.running_lines(cleaning.lines(docs)).collect())) == [("running head #", 6)]
    out = {r["doc_id"]: r["clean_text"] for r in records.clean_pages(docs).collect()}
    assert out == {i: f"some text of page {chr(97 + i)}{chr(97 + i)}" + " with considered words" * (i % 2) for i in range(6)} | {6: "", 7: "consideration considered considered"}

    def counted(*_):
        raise AssertionError("words are counted though no line ends in a hyphen")

    with monkeypatch.context() as m:
        m.setattr(cleaning, "word_frequencies", counted)
        assert records.clean_pages(docs.where("doc_id % 2 = 0")).count() == 4


def test_bm25_of_many_questions_is_that_of_few(spark, monkeypatch):
    rng = random.Random(3)
    said = [f"w{i:02d}" for i in range(60)]
    texts = [None, "", "w00"] + [" ".join(rng.choices(said, weights=[60 / (i + 1) for i in range(60)], k=rng.randint(1, 40))) for _ in range(700)]
    texts += [texts[9]] * 40 + ["half"] * 20  # copies, whose ties the smaller ids win
    docs = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    asked = [texts[9], "unknown words", "", None, "half"] + [" ".join(rng.choices(said, k=rng.randint(1, 9))) for _ in range(95)]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")

    def collected(f):
        return sorted(map(tuple, f.select("query_id", "rank", "doc_id", "score").collect()))

    want = {k: collected(retrieval.bm25(docs, queries, k)) for k in (1, 3)}
    terms, _ = retrieval.bm25_terms(docs, queries)
    lower = lambda f, i: f.select(i, F.lower("text").alias("terms"))
    rows = scoring.placed(lower(docs, "doc_id"), terms)
    for k, often in ((1, 8), (3, 8), (3, 512)):
        got = retrieval.ranked(scoring.sparse_top(rows, lower(queries, "query_id"), terms, k, block=30, often=often), k)
        assert collected(got) == want[k]

    def scored(*_):
        raise AssertionError("blocks of many questions cut all texts again")

    monkeypatch.setattr(scoring, "top", scored)
    assert collected(retrieval.bm25(docs, queries, 1, few=50)) == want[1]


def test_types_are_learned_from_grams_cut_once(spark, monkeypatch):
    from pyspark.ml.feature import HashingTF

    rng = random.Random(4)
    texts = ["Le château était froid, à l'été", "the cold winter wind", "", "œuvre ß tiny_word ab"] + [" ".join(rng.choices(("snow", "vent", "Åland", "régime", "of"), k=rng.randint(1, 30))) for _ in range(40)]
    docs = spark.createDataFrame([(i, "abc"[i % 3], t) for i, t in enumerate(texts)], "doc_id long, label string, text string").repartition(3)
    want = HashingTF(inputCol="grams", outputCol="tf", numFeatures=routing.GRAMS).transform(docs.select("doc_id", vectors.char_grams(F.col("text")).alias("grams")))
    want = {r["doc_id"]: r["tf"] for r in want.collect()}

    def exploded(*_):
        raise AssertionError("grams are made as arrays of strings")

    monkeypatch.setattr(vectors, "char_grams", exploded)
    more = docs.unionByName(spark.createDataFrame([(99, None, None)], docs.schema))
    made = routing.type_vectors(more)
    assert made.columns == ["doc_id", "label", "tf"]
    got = {r["doc_id"]: r["tf"] for r in made.collect()}
    assert got.pop(99).numNonzeros() == 0 and got == want
    predicted = routing.fit_types(made.where("label is not null")).transform(made)
    assert predicted.count() == 45 and predicted.where("prediction in (0, 1, 2)").count() == 45


def test_texts_already_composed_stay_out_of_python(spark, monkeypatch):
    from foliospark.functions import python as PY

    texts = [None, "", "plain", "été", "été", "가", "ü " * 300, "Å"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 80)], "id long, text string").coalesce(1)  # several slices
    got = {r["id"]: r["t"] for r in docs.select("id", PY.nfc(F.col("text")).alias("t")).collect()}
    assert got == {i: t if t is None else unicodedata.normalize("NFC", t) for i, t in enumerate(texts * 80)}
    seen = []
    monkeypatch.setattr(PY, "arrow_udf", lambda f, kind: lambda c: seen.append(c) or c)
    PY.nfc(F.col("text"))
    kept = docs.select("text", seen[0].alias("sent")).where("sent is not null").select("text").distinct().collect()
    assert {r["text"] for r in kept} == {t for t in texts if t and any(ord(c) >= 0x300 for c in t)}


def test_no_text_of_pages_is_dealt_out_by_line(spark, monkeypatch):
    loose = "«x» ﬁn œuvre —­"
    texts = [f"Run  Head {i}\n{loose} {i}{i}\n 12\n 12 \npage {i}-­\nword {chr(97 + i)}" for i in range(5)] + ["run head #", None, "", "IV\np. 3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for t, k, n in docs.select("text", T.line_keys("text"), T.normalized("text")).collect():
        want = spark.createDataFrame([(x,) for x in (t or "").split("\n")], "x string").select(T.line_key(F.col("x"))).collect()
        assert k == (None if t is None else [r[0] for r in want])
        assert n == (None if t is None else spark.createDataFrame([(t,)], "x string").select(T.normalize_unicode(F.col("x"))).first()[0])

    def dealt(*_):
        raise AssertionError("lines are rows with their text")

    monkeypatch.setattr(cleaning, "lines", dealt)
    out = {r["doc_id"]: r["clean_text"] for r in records.clean_pages(docs).collect()}
    assert out[0] == "page 0-word a" or out[0].endswith("word a")
    assert "Head" not in "".join(out.values()) and out[5] == out[6] == out[7] == out[8] == ""
    both = docs.select(F.lower("text").alias("t"), T.signals(F.col("text"), T.FRENCH).alias("fr"), T.signals(F.col("text"), T.ENGLISH).alias("en"))
    from foliospark.functions.python import language_signals

    assert all(list(r["s"]) == [r["fr"], r["en"]] for r in both.select("*", language_signals(F.col("t")).alias("s")).collect())


def test_components_take_two_passes_without_ml(spark, monkeypatch):
    import pyspark.ml.feature as ML

    def fitted(*_, **__):
        raise AssertionError("vectors are made again for each of several fits")

    monkeypatch.setattr(ML.PCA, "__init__", fitted)
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(700, 6)) * [5, 3, 1, 1, 0.5, 0.1] + 2).astype(np.float32)
    v = spark.createDataFrame([(i, [float(a) for a in r], "l") for i, r in enumerate(x)], "doc_id long, embedding array<float>, label string").repartition(3)
    out, shares = vectors.pca(v)
    c = x.astype(float) - x.astype(float).mean(axis=0)
    _, s, axes = np.linalg.svd(c, full_matrices=False)
    load = axes[:2].T * np.sign(axes[:2].T[np.argmax(np.abs(axes[:2].T), axis=0), range(2)])
    rows = sorted(out.collect())
    assert out.columns == ["doc_id", "embedding", "label", "pc"] and np.allclose([r["pc"] for r in rows], c @ load)
    assert np.allclose(shares, (s**2 / (s**2).sum())[:2])
