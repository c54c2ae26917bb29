"""Operators on small tables: nulls, ties, repeated rows, empty tables, other columns."""

import math
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import fuzzy, text
from quern.operators import alike, blocks, dense, dialogue, graph, procedures, ranking, rules, sparse
from quern.plans import retrieval


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def hits(spark, data):
    return spark.createDataFrame(data, "query_id long, doc_id long, method string, score double, rank int, text string")


def test_reciprocal_rank_fusion_of_a_worked_example(spark):
    a = hits(spark, [(1, 10, "g", 0.9, 1, None), (1, 11, "g", 0.8, 2, None)])
    b = hits(spark, [(1, 10, "f", 0.7, 1, None), (1, 12, "f", 0.6, 2, None)])
    fused = ranking.reciprocal_rank_fusion([(a, 0.6), (b, 0.4)], 5)
    assert [(r["doc_id"], round(r["score"], 4)) for r in fused.orderBy("rank").collect()] == [(10, 0.0164), (11, 0.0097), (12, 0.0065)]


def test_fusion_with_an_empty_branch_keeps_the_other(spark):
    a, empty = hits(spark, [(1, 10, "g", 0.9, 1, None)]), hits(spark, [])
    assert rows(ranking.reciprocal_rank_fusion([(a, 0.6), (empty, 0.4)], 5), "doc_id") == [(10,)]
    assert ranking.reciprocal_rank_fusion([(empty, 0.6), (empty, 0.4)], 5).count() == 0


def test_ties_go_to_the_smaller_id_and_null_scores_rank_last(spark):
    df = hits(spark, [(1, 12, "m", 0.5, 0, None), (1, 11, "m", 0.5, 0, None), (1, 10, "m", None, 0, None)])
    assert rows(ranking.ranked(df), "rank", "doc_id") == [(1, 11), (2, 12), (3, 10)]


def test_max_normalisation_without_a_positive_score_gives_zero(spark):
    df = hits(spark, [(1, 1, "m", -2.0, 0, None), (1, 2, "m", -1.0, 0, None), (2, 1, "m", 4.0, 0, None), (2, 3, "m", 1.0, 0, None)])
    assert rows(ranking.max_normalised(df), "query_id", "doc_id", "score") == [(1, 1, 0.0), (1, 2, 0.0), (2, 1, 1.0), (2, 3, 0.25)]


def test_weighted_merge_counts_present_methods_only(spark):
    df = hits(spark, [(1, 1, "a", 1.0, 0, None), (1, 1, "b", 0.5, 0, None), (1, 2, "b", 0.5, 0, None), (1, 3, "c", 0.9, 0, None), (1, 4, "a", None, 0, None), (1, 1, "a", 1.0, 0, None)])
    assert [(d, round(s, 6)) for d, s in rows(ranking.weighted_merge(df, {"a": 0.8, "b": 0.2, "c": 0.0}), "doc_id", "score")] == [(1, 0.9), (2, 0.5)]


def test_no_query_vanishes(spark):
    queries = spark.createDataFrame([(1,), (2,), (2,)], "query_id long")
    out = ranking.every_query(queries, hits(spark, [(1, 5, "m", 1.0, 1, None)]))
    assert rows(out, "query_id", "doc_id", "status") == [(1, 5, "success"), (2, None, "no_results")]


def test_first_branch_and_append(spark):
    a, b = hits(spark, [(1, 5, "a", 1.0, 1, None)]), hits(spark, [(1, 6, "b", 1.0, 1, None), (2, 7, "b", 1.0, 1, None), (1, 5, "b", 1.0, 1, None)])
    assert rows(ranking.first_branch([a, b]), "query_id", "doc_id", "branch") == [(1, 5, 0), (2, 7, 1)]
    assert rows(ranking.appended_if_absent(a, b), "query_id", "doc_id", "method") == [(1, 5, "a"), (1, 6, "b"), (2, 7, "b")]


def test_nearest_matches_a_plain_loop_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 4)
    data = [(i, [math.sin(i * j + 1) for j in range(5)], "x") for i in range(20)] + [(20, None, "x"), (21, [0.0] * 5, "x"), (22, [1.0, 2.0], "x"), (3, [math.sin(3 * j + 1) for j in range(5)], "x")]
    df = spark.createDataFrame(data, "id long, v array<float>, score string").repartition(3)
    vectors = {i: v for i, v, _ in data if v}
    queries = df.where("id < 4").dropDuplicates(["id"]).withColumnRenamed("id", "query_id")
    got = {}
    for r in dense.nearest(queries, df.dropDuplicates(["id"]), "id", "v", 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
    for q in range(4):
        def cosine(d, q=q):
            a, b = vectors[q], vectors[d]
            n = math.hypot(*a) * math.hypot(*b)
            return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

        best = sorted((d for d in vectors if len(vectors[d]) == 5), key=lambda d: (-round(cosine(d), 6), d))[:4]
        assert [d for _, d in sorted(got[q])] == best


def test_nearest_over_nothing(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert dense.nearest(empty.withColumnRenamed("id", "query_id"), empty, "id", "v", 3).count() == 0
    one = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    assert dense.nearest(one.withColumnRenamed("id", "query_id"), empty, "id", "v", 3, "l2").count() == 0


def test_bm25_counts_repeated_query_terms_and_survives_nulls(spark):
    docs = spark.createDataFrame([(1, "a b c", 9), (2, "b", 9), (3, None, 9), (4, "", 9), (5, "d e", 9), (6, "f", 9)], "id long, text string, term int")
    one = spark.createDataFrame([(1, "a"), (2, None)], "query_id long, query string")
    two = spark.createDataFrame([(1, "a a")], "query_id long, query string")
    s1 = sparse.bm25(one, docs, "id", "text", 5).collect()
    s2 = sparse.bm25(two, docs, "id", "text", 5).collect()
    assert [r["doc_id"] for r in s1] == [1] and s2[0]["score"] == pytest.approx(2 * s1[0]["score"])
    assert sparse.bm25(one, docs.limit(0), "id", "text", 5).count() == 0


def test_keyword_scores_weigh_the_title_twice(spark):
    docs = spark.createDataFrame([(1, "phí thẻ", "x"), (2, "x", "phí thẻ phí"), (3, None, None)], "id long, t string, b string")
    q = spark.createDataFrame([(1, "Phí thẻ?")], "query_id long, query string")
    assert rows(sparse.keyword_scores(q, docs, "id", "t", "b", 5), "doc_id", "score") == [(1, 1.0), (2, 0.5)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcde é🙂", max_size=12), min_size=1, max_size=5), st.lists(st.text("abcde é🙂", max_size=12), min_size=1, max_size=5), st.sampled_from([0.3, 0.6, 0.85, 1.0]))
def test_count_bounds_never_drop_a_similar_pair(x, y, least):
    kept = set(zip(*(c.tolist() for c in alike.possible(x, y, least))))
    assert {(i, j) for i, a in enumerate(x) for j, b in enumerate(y) if SequenceMatcher(None, a, b).ratio() >= least} <= kept


def test_block_products_equal_plain_sums(spark, monkeypatch):
    import random

    monkeypatch.setattr(blocks, "ROWS", 4)
    monkeypatch.setattr(blocks, "COLUMNS", 3)
    rng = random.Random(1)
    side = lambda n: [(i, [rng.randrange(12) for _ in range(rng.randrange(0, 9))]) for i in range(n)]
    q, d = [(i, sorted(set(t))) for i, t in side(11)], side(30)
    weigh = lambda rows_: [(i, t, [round(rng.random(), 3) for _ in t]) for i, t in rows_]
    q, d = weigh(q), weigh(d)
    want = set()
    for i, t, w in q:
        scores = [(-round(sum(a * b for x, a in zip(t, w) for y, b in zip(u, v) if x == y), 9), j) for j, u, v in d]
        want |= {(i, j, -s) for s, j in sorted(scores)[:5] if s < 0}
    df = lambda rows_: spark.createDataFrame(rows_, "key long, terms array<long>, weights array<double>").repartition(3)
    got = blocks.products(df(q), df(d), 5, blocks.sparse_product, positive=True).collect()
    assert {(r["query_id"], r["doc_id"], round(r["score"], 9)) for r in got} == want
    assert blocks.products(df(q), df(d).limit(0), 5, blocks.sparse_product, positive=True).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("abcd ", max_size=12), st.text("abcd ", max_size=12), st.sampled_from([0.3, 0.6, 0.85]))
def test_the_fuzzy_bounds_never_drop_a_similar_pair(a, b, least):
    full = SequenceMatcher(None, a, b).ratio()
    assert fuzzy.ratio(a, b, least) == full or full < least


def test_fuzzy_pairs_need_no_word_in_common(spark):
    asked = spark.createDataFrame([(1, "activation charges"), (2, "Activation Charges"), (3, None)], "query_id long, query string")
    faq = spark.createDataFrame([(7, "activations charged"), (8, "opening hours"), (9, None), (9, "ACTIVATIONS charged")], "faq_id long, question string")
    score = SequenceMatcher(None, "activation charges", "activations charged").ratio()
    assert sorted(tuple(r) for r in retrieval._fuzzy_pairs(asked, faq, 0.85).collect()) == [(q, d, score) for q in (1, 2) for d in (7, 9)]


def test_entity_matches(spark):
    edges = spark.createDataFrame([(1, "R", "L", "Ngân hàng Mây ", 0.5), (1, "R", "L", "ngân hàng mây", 0.4), (2, "R", "L", "mây", 0.1), (3, "R", "L", None, 0.1), (4, "R", "L", "mâyx", 0.1), (5, "R", "L", "ab", 0.1)], "src long, rel_type string, label string, entity_name string, confidence double")
    asked = spark.createDataFrame([(9, "bank", "Mây"), (9, "bank", None), (9, "bank", "ab cd")], "query_id long, etype string, value string")
    assert rows(graph.entity_matches(edges, asked), "doc_id", "exact") == [(1, False), (2, True)]
    assert graph.entity_matches(edges.limit(0), asked).count() == 0


def test_paths_have_least_depths_and_end_in_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1)], "a long, b long")
    starts = spark.createDataFrame([(1,)], "start long")
    assert rows(graph.paths(edges, starts), "node", "depth") == [(1, 0), (2, 1), (3, 1)]


def test_most_shared_counts_frequent_entities(spark):
    rows = [(i, n) for i in range(60) for n in (["Hot "] + ["warm"] * (i % 2) + [f"n{i % 7}"] * (i % 3 == 0))] + [(0, "hot"), (70, None), (71, " "), (72, "alone")]
    edges = spark.createDataFrame(rows, "src long, entity_name string").repartition(4)
    seeds = spark.createDataFrame([(i,) for i in (0, 1, 20, 21, 45, 72)], "doc_id long")
    held = {}
    for i, n in rows:
        if n and n.strip():
            held.setdefault(i, set()).add(n.strip().lower())
    want = set()
    for (s,) in seeds.collect():
        near = sorted((-len(held[s] & held[d]), d) for d in held if d != s and held[s] & held[d])
        want |= {(s, d, -n) for n, d in near[:3]}
    assert {tuple(r) for r in graph.most_shared(edges, seeds, 3).collect()} == want


def test_upsert_keeps_what_the_new_row_lacks(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, p string, q string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", None)], "id long, p string, q string")
    assert rows(graph.upserted_nodes(old, new, "id"), "id", "p", "q") == [(1, "a", "x"), (2, "b", "z"), (3, "c", None)]


def test_steps_of_a_procedural_answer(spark):
    answer = "Làm như sau:\nBước 1: Mở ứng dụng\nBước 2: Chọn thẻ, bấm Khoá\nBước 3: Xác nhận\nGhi chú: chờ 5 phút."
    df = spark.createDataFrame([(1, answer, 7), (2, None, 7), (3, "", 7), (4, "Không có bước", 7)], "id long, answer string, number int")
    found = procedures.parsed_steps(df, "id", "answer")
    assert rows(found, "id", "number", "text") == [(1, 1, "Mở ứng dụng"), (1, 2, "Chọn thẻ, bấm Khoá"), (1, 3, "Xác nhận")]
    steps = found.select(F.col("id").alias("parent_id"), "number", "text")
    assert rows(procedures.steps_from(steps, 2, True), "number", "total") == [(2, 3)]
    assert rows(procedures.next_steps(steps, 1, 1), "number") == [(2,)]
    assert procedures.rendered(steps).first()["text"].startswith("Step 1: Mở ứng dụng\nStep 2: ")


def test_sections_drop_what_precedes_the_first(spark):
    df = spark.createDataFrame([(1, "x\n\nCách 1: a\nb\nCách 2: c"), (2, "y")], "id long, t string")
    assert rows(procedures.sections(df, "id", "t", r"^Cách \d+:"), "section", "title", "body") == [(1, "Cách 1: a", "b"), (2, "Cách 2: c", "")]


def test_best_case(spark):
    kind = "doc_id long, case_id int, name string, method string, features array<string>, statuses array<string>, keywords array<string>, description string"
    cases = spark.createDataFrame([(1, 1, "a", "m", ["x"], None, ["k"], None), (1, 2, "tên", "cách", ["nạp tiền"], ["bị trả lại"], [], "tiền bị trả lại")], kind)
    hit = lambda text: spark.createDataFrame([(7, 1, text)], "query_id long, doc_id long, text string")
    assert rows(procedures.best_case(hit("Nạp tiền bị trả lại"), cases, "text"), "case_id", "score") == [(2, 45)]
    assert rows(procedures.best_case(hit("theo tên và cách"), cases, "text"), "case_id", "score") == [(2, 20)]  # by name and method where nothing else is found
    assert rows(procedures.best_case(hit("0"), cases, "text"), "case_id", "score") == [(1, 1)]
    assert rows(procedures.cases_found(hit("nạp tiền bị trả lại"), cases, "text"), "case_id", "score", "confidence") == [(2, 18, 0.9)]
    assert procedures.cases_found(hit("phí"), cases, "text").count() == 0


def test_latest_and_carried(spark):
    df = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "a", 2), (1, 1, None, 1), (1, 2, "b", 1), (None, 0, None, 1)], "c long, n int, topic string, at int")
    one = dialogue.latest(df, ["c", "n"], "at")
    assert one.count() == 4
    assert rows(dialogue.carried(one, "c", ["n"], "topic", "held"), "c", "n", "held") == [(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (None, 0, None)]
    assert rows(dialogue.topic_sessions(one, "c", ["n"], "topic"), "c", "n", "session") == [(1, 0, 1), (1, 1, 1), (1, 2, 2), (None, 0, 0)]


def test_intent_pack_order_override_and_floor(spark):
    pack = rules.IntentPack([rules.Intent("A", 1, 1.0, ["x"], ["y"]), rules.Intent("B", 1, 1.0, ["x"], ["z"])], "NONE", 0.3, ("A", "C", ["late"]), {"A": 0.9})
    df = spark.createDataFrame([(1, "X"), (2, "x z"), (3, "x late"), (4, None), (5, "")], "id long, t string").withColumns(pack.columns(F.col("t")))
    assert [(r["id"], r["intent"], round(r["confidence"], 3)) for r in df.orderBy("id").collect()] == [(1, "A", 0.9), (2, "B", 1.0), (3, "C", 0.9), (4, "NONE", 0.3), (5, "NONE", 0.3)]
    with pytest.raises(ValueError):
        rules.IntentPack([rules.Intent("A", 1, 1.0, [], []), rules.Intent("A", 1, 1.0, [], [])], "N", 0.1)


def test_restored_words_keep_one_closing_mark(spark):
    df = spark.createDataFrame([("Phi bao nhieu?",), ("Phí bao nhieu?",), (None,), ("",)], "t string")
    out = df.select(text.restored(F.col("t"), {"phi": "phí", "nhieu": "nhiêu"}, "[àáíêđ]").alias("x"))
    assert [r["x"] for r in out.collect()] == ["phí bao nhiêu?", "Phí bao nhieu?", None, ""]


def _plain_entity_scores(edges, entities, k):
    """The scores read off their definition, query by query and document by document."""
    key = lambda x: x.strip().lower()
    docs, asked = {}, {}
    for src, rel, label, name in edges:
        if name and name.strip():
            docs.setdefault(src, set()).add((rel, label, name))
    for q, etype, value in entities:
        if value and value.strip():
            asked.setdefault(q, set()).add((etype.lower(), value))
    inside = lambda a, b: len(a) >= 3 and f" {a} " in f" {b} "
    out = set()
    for q, said in asked.items():
        values, scores = {key(v) for _, v in said}, []
        for d, held in docs.items():
            met = [(r, la, n) for r, la, n in held if any(key(n) == v or inside(v, key(n)) or inside(key(n), v) for v in values)]
            if not met:
                continue
            own = lambda t: {v for e, v in said if e == t}  # noqa: E731, B023
            has = lambda t: {n for r, _, n in held if r == graph.RELATIONS[t]}  # noqa: E731, B023
            near = lambda t, marks=(): any(a.lower() in b.lower() or b.lower() in a.lower() or any(m in a.lower() and m in b.lower() for m in marks) for a in own(t) for b in has(t))  # noqa: E731, B023
            rels = {r for r, _, _ in met}
            score = len({(la, key(n)) for _, la, n in met}) * next((w for r, w in graph.RELATION_WEIGHTS if r in rels), 1.0) + 0.5 * len({n for _, _, n in met} & {v for _, v in said})
            score += 2.0 if own("service") & has("service") else -1.0 if own("service") and has("service") else 0.3
            score += 1.5 if own("bank") & has("bank") else -0.8 if own("bank") and has("bank") else 0.2
            score += -2.0 if has("error") and not own("error") else 4.0 if own("error") & has("error") else 3.0 if near("error", graph.ALIKE_ERRORS) else 0.0
            score += 1.8 * bool(own("action") & has("action")) + 2.0 * bool(own("fee") and has("fee")) + 1.5 * bool(own("status") & has("status")) + 1.5 * bool(own("limit") and has("limit"))
            score += 2.5 if near("feature") else -0.5 if own("feature") and has("feature") else 0.0
            score += 2.0 * near("topic")
            scores.append((-round(score, 9), d))
        out |= {(q, d, -s) for s, d in sorted(scores)[:k]}
    return out


def test_entity_scores_of_all_types_equal_their_definition(spark):
    import random

    rng = random.Random(8)
    names = ["ví Sao", "Ví Sao", "sao", "thẻ Mây ", "thẻ", "giao dịch thất bại", "nạp tiền thất bại", "chưa nhận mã", "nạp tiền", "phí nạp tiền", "hạn mức", " ", None, "liên kết ngân hàng", "ngân hàng"]
    edges = [(d, r, t.title(), rng.choice(names)) for d in range(60) for t, r in rng.sample(sorted(graph.RELATIONS.items()), 4)]
    edges += [(100 + d, r, la, n) for d in range(40) for s, r, la, n in edges if s == 3]
    entities = [(q, rng.choice([t, t.title()]), rng.choice(names)) for q in range(25) for t in rng.sample(sorted(graph.RELATIONS), rng.randrange(1, 5))] + [(99, "bank", n) for q, t, n in [(0, "", None)]]
    entities += [(200 + q, e, v) for q in range(5) for n, e, v in entities if n == 2]
    got = graph.entity_scores(spark.createDataFrame(edges, "src long, rel_type string, label string, entity_name string").repartition(3), spark.createDataFrame(entities, "query_id long, etype string, value string"), 7)
    assert {(r["query_id"], r["doc_id"], round(r["raw"], 9)) for r in got.collect()} == _plain_entity_scores(edges, entities, 7)


def test_long_chains_and_branches_are_followed_to_their_end(spark):
    edges = [(i, i + 1) for i in range(37)] + [(5, 100), (100, 101), (200, 200)]
    got = graph.paths(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(0,), (35,), (200,), (999,)], "start long")).collect()
    want = {(0, i, i) for i in range(38)} | {(0, 100, 6), (0, 101, 7), (35, 35, 0), (35, 36, 1), (35, 37, 2), (200, 200, 0), (999, 999, 0)}
    assert {tuple(r) for r in got} == want


def test_all_loads_of_a_node_are_folded(spark):
    loads = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, "p"), ("a", 3, "y", None), ("b", 1, None, None)], "node string, nth int, q string, i string")
    assert rows(graph.folded_nodes(loads, "node", "nth"), "node", "q", "i") == [("a", "y", "p"), ("b", None, None)]


def test_edges_are_resolved_by_property(spark):
    nodes = spark.createDataFrame([(1, "A", "x"), (2, "A", "y"), (3, "B", "x"), (4, "B", "x")], "id long, label string, name string")
    edges = spark.createDataFrame([("x", "x"), ("y", "z"), (None, "x")], "a string, b string")
    assert rows(graph.resolved_edges(edges, nodes, {"a": ("A", "name"), "b": ("B", "name")}), "a_id", "b_id") == [(1, 3), (1, 4)]


def test_the_guard_and_the_extraction_gate(spark):
    from pyspark.sql import functions as F

    from quern.operators import rerank

    data = [(1, 9, 0.5, 0.5, "phí qua ngân hàng Mây Tím", "Mây Tím", "phí ngân hàng mây tím", "x"), (2, 9, 0.5, 0.5, "phí qua ngân hàng Mây Tím", "Mây Tím", "phí nạp tiền", "x"), (3, 9, 0.5, 0.5, "phí qua ngân hàng Mây Tím", "Mây Tím", "phí ngân hàng", "gọi mt bank"), (4, 9, 0.5, 0.5, "zzz yyy xxx", None, "phí nạp tiền vào ví", None), (5, 9, 0.8, 1.8, "nạp tiền", None, "nạp tiền", None)]
    df = spark.createDataFrame(data, "query_id long, doc_id long, base double, score double, query string, b string, question string, answer string")
    got = {r["query_id"]: (r["status"], round(r["boosted"], 6)) for r in rerank.guarded(df, F.col("b"), {"mây tím": ["mt bank"]}, ["qua"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "success", 2: "no_specific_answer", 3: "success", 4: "no_specific_answer", 5: "success"}
    assert got[5][1] == 1.8 - 0.8 + 1.0 + 5.0
    cases = [("FEE", "x" * 50, 0.5, "9", 0.9), ("FEE", "x" * 50, 0.95, "9", 0.9), ("WHY", "x" * 400, 0.5, "9", 0.9), ("HOW_TO", "x" * 400, 0.5, "y" * 390, 0.7), ("HOW_TO", "x" * 200, 0.5, "y", 0.7), ("LIMIT", "x" * 10, 0.5, "y" * 9, 0.9), ("TIME", "x" * 50, 0.1, None, 0.0), (None, None, None, None, None)]
    rows_ = spark.createDataFrame(cases, "i string, a string, r double, f string, c double")
    gate = rerank.extraction(*[F.col(c) for c in "iarfc"])
    assert [(r["wanted"], r["used"]) for r in rows_.select(*[v.alias(k) for k, v in gate.items()]).collect()] == [(True, True), (False, False), (False, False), (True, True), (False, False), (True, False), (True, False), (False, False)]


def test_keywords_count_within_words_and_compounds_as_a_whole(spark):
    docs = spark.createDataFrame([(1, "miễnphí nạp tiền", "x"), (2, "tiền nạp", "phí nạp tiền " + "z" * 30000), (3, None, None)], "id long, t string, b string")
    q = spark.createDataFrame([(1, "Phí nạp tiền?"), (2, None), (3, "zzz")], "query_id long, query string")
    hits = sparse.keyword_scores(q, docs, "id", "t", "b", 5, compounds=["nạp tiền"])
    # phí, nạp, tiền and the compound: 2 each in the first title; 2 x 2 and 4 in the second
    assert rows(hits, "query_id", "doc_id", "score") == [(1, 1, 1.0), (1, 2, 1.0), (3, 2, 1.0)]


def test_texts_that_contain_others(spark):
    texts = ["", "a", "ab", "bc", None, "ab", "zz"]
    others = ["abc", "", None, "xbcx", "abc"]
    got = alike.containing(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(t,) for t in others], "other string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "abc"), ("ab", "abc"), ("bc", "abc"), ("bc", "xbcx")]
