"""Hand tables that mirror the asserted behaviours."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import catalog
from palimpsest.functions import lexicon as L
from palimpsest.functions import text as T
from palimpsest.functions.words import words
from palimpsest.operators import consolidation, fusion, graph, metrics, scans, vectors

from conftest import rows


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_words():
    assert words("Ｌｏｇ​in re-\nrun x_y 3.5 ÉTÉ") == ["login", "rerun", "x", "y", "3", "5", "été"]
    assert words(None) == words("") == words("--") == []


def ranked(spark, ids):
    return spark.createDataFrame([("q", i, n) for n, i in enumerate(ids, 1)], "query_id string, id string, rank int")


def test_rrf_two_lists(spark):
    got = {r["id"]: r["score"] for r in fusion.reciprocal_rank(ranked(spark, "abc"), ranked(spark, "cd")).collect()}
    assert got["c"] == pytest.approx(1 / 63 + 1 / 61)
    assert sorted(got, key=lambda i: (-round(got[i], 9), i)) == ["c", "a", "b", "d"]


def test_fuse_later_metadata_wins(spark):
    a = ranked(spark, "a").withColumn("metadata", F.create_map(F.lit("k"), F.lit("1"), F.lit("x"), F.lit("y")))
    b = ranked(spark, "a").withColumn("metadata", F.create_map(F.lit("k"), F.lit("2")))
    assert fusion.fuse([a, b]).first()["metadata"] == {"k": "2", "x": "y"}


def test_session_head_pin(spark):
    hits = spark.createDataFrame([("q", "s1", "a", 1), ("q", "s2", "b", 2), ("q", "s2", "c", 3), ("q", "s2", "d", 4)], "query_id string, session_id string, id string, rank int").withColumn("event_at", F.lit(None).cast("timestamp"))
    assert [r["session_id"] for r in fusion.session_ranking(hits).orderBy("position").collect()] == ["s1", "s2"]


def edges(spark, es):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in es], "src string, dst string, weight double")


def test_walk_diamond(spark):
    e = edges(spark, [("a", "b", 0.9), ("b", "d", 0.5), ("a", "c", 0.6), ("c", "d", 0.9), ("d", "a", 0.1)])
    got = {r["id"]: (r["depth"], round(r["strength"], 6)) for r in graph.walk(e, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {"b": (1, 0.9), "c": (1, 0.6), "d": (2, 0.54)}


def test_activation_cycle(spark):
    e = edges(spark, [("a", "b", 0.8), ("b", "c", 0.8), ("c", "a", 0.8)])
    got = rows(graph.activate(e, spark.createDataFrame([("a", 1.0)], "node string, value double"), hops=3, decay=1.0))
    assert [(n, round(v, 6), d) for n, v, d in got] == [("b", 0.8, 1), ("c", 0.8, 1)]


def test_activation_hides_nodes(spark):
    e = edges(spark, [("a", "b", 0.8), ("b", "c", 0.8)])
    hidden = spark.createDataFrame([("b",)], "node string")
    assert rows(graph.activate(e, spark.createDataFrame([("a", 1.0)], "node string, value double"), hidden)) == []


def facts(spark, *rs):
    return spark.createDataFrame(rs, "id string, f string, u string").select("id", F.col("f").cast("timestamp").alias("valid_from"), F.col("u").cast("timestamp").alias("valid_until"))


def test_asof_boundary(spark):
    f = facts(spark, ("x", "2024-01-01", "2024-02-01"), ("open", None, None))
    at = lambda t: {r["id"] for r in scans.point_in_time(f, t).collect()}
    assert at("2024-01-01") == {"x", "open"} and at("2024-02-01") == {"open"}


def test_project_null_shared(spark):
    df = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", None)], "id string, project_id string")
    assert {r["id"] for r in catalog.in_project(df, "p").collect()} == {"a", "c"}


@pytest.mark.parametrize(
    "text, score",
    [("remember this please", 0.95), ("we decided on it", 0.90), ("no, actually it is", 0.85), ("I prefer tea", 0.85), ("this is urgent", 0.80), ("is it so?", 0.60), ("see ``` here", 0.50), ("x" * 201, 0.40), ("plain words", 0.30), ("ok!", 0.10), ("I prefer this, it is urgent", 0.90), (None, 0.30)],
)
def test_salience_ladder(spark, text, score):
    assert one(spark, text, L.salience) == pytest.approx(score)


@pytest.mark.parametrize("s, want", [(0.15, 0.0), (0.275, 0.5), (0.40, 1.0)])
def test_gate_edges(spark, s, want):
    assert one(spark, s, lambda c: L.salience_gate(F.lit(1.0), c, F.lit(0.9)), "double") == pytest.approx(want)


@pytest.mark.parametrize("n, want", [(1, 0.2), (2, 0.3), (9, 1.0), (20, 1.0)])
def test_co_recall_upsert(spark, n, want):
    assert one(spark, n, scans.co_recalled_strength, "int") == pytest.approx(want)


@pytest.mark.parametrize("c, want", [(0.06, 0.05), (0.05, 0.05), (0.5, 0.48)])
def test_decay_floor(spark, c, want):
    assert one(spark, c, lambda x: consolidation.decayed(x, 0.02), "double") == pytest.approx(want)


def test_interleave(spark):
    r = spark.createDataFrame([("q", 0, 1, "a"), ("q", 0, 2, "b"), ("q", 0, 3, "c"), ("q", 1, 1, "b"), ("q", 1, 2, "d")], "query_id string, round int, rank int, id string")
    assert [x["id"] for x in fusion.interleave(r, 10).orderBy("position").collect()] == ["a", "b", "d", "c"]


@pytest.mark.parametrize("b, c, p", [(0, 7, 0.015625), (1, 0, 1.0), (0, 0, 1.0)])
def test_mcnemar(b, c, p):
    assert metrics.mcnemar_p(b, c) == pytest.approx(p)


def test_containment_clamps(spark):
    exact = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, id string, rank int")
    pool = spark.createDataFrame([("q", "a")], "query_id string, id string")
    assert rows(metrics.containment(exact, pool, [1, 10])) == [("q", 1, 1.0), ("q", 10, 0.5)]


@pytest.mark.parametrize("text, want", [("2023-02-30", None), ("2023/05/20 (Sat) 02:21", "2023-05-20 02:21"), ("", None), ("2024-01-05", "2024-01-05 00:00"), ("soon", None), (None, None)])
def test_date_overflow(spark, text, want):
    got = one(spark, text, T.event_date)
    assert (got and got.strftime("%Y-%m-%d %H:%M")) == want


@pytest.mark.parametrize("d, want", [(1, "1 day"), (13, "13 days"), (14, "14 days (2 weeks)"), (20, "20 days (~3 weeks)"), (61, "61 days (~2 months)"), (366, "366 days (~1 year)"), (900, "900 days (~2.5 years)")])
def test_humanize(spark, d, want):
    assert one(spark, d, T.humanize_days, "int") == want


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, None]


def test_needle_and_unusable_vectors(spark):
    rng = np.random.default_rng(0)
    noise = [(f"n{i:04d}", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 32)))]
    target = [float(x) for x in rng.normal(size=32)]
    bad = [("null", None), ("short", [1.0]), ("zero", [0.0] * 32), ("nan", [float("nan")] * 32)]
    df = spark.createDataFrame([*noise, ("needle", target), *bad], "id string, embedding array<double>")
    got = vectors.scan_topk(df, [("q", target)], 3).orderBy("rank").collect()
    assert got[0]["id"] == "needle" and got[0]["similarity"] == 1.0 and not {r["id"] for r in got} & {i for i, _ in bad}
    assert vectors.scan_topk(df, [("q", [0.0] * 32)], 3).count() == 0
    # more queries than one scan takes are worked off in blocks, with the same result
    many = [(f"q{k}", [float(x) for x in rng.normal(size=32)]) for k in range(5)]
    whole = rows(vectors.scan_topk(df, many, 3))
    vectors.MAX_QUERIES, most = 2, vectors.MAX_QUERIES
    try:
        assert rows(vectors.scan_topk(df, many, 3)) == whole and len(whole) == 15
    finally:
        vectors.MAX_QUERIES = most


def test_quantized_contains_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 48))
    df = spark.createDataFrame([(f"{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, embedding array<double>")
    codes = vectors.encode_table(df, 48).cache()
    hit = 0
    for q in range(5):
        exact = {r["id"] for r in vectors.scan_topk(df, [("q", list(x[q]))], 10).collect()}
        quick = {r["id"] for r in vectors.quantized_topk(codes, df, list(x[q]), 10, 48).collect()}
        hit += len(exact & quick)
    assert hit >= 49


def test_mmr_prefers_other_words(spark):
    c = spark.createDataFrame([("q", "a", 1.0, "red apple pie"), ("q", "b", 0.95, "red apple pies"), ("q", "c", 0.9, "blue moon river")], "query_id string, id string, relevance double, content string")
    assert [r["id"] for r in fusion.mmr(c).orderBy("position").collect()] == ["a", "c", "b"]


def test_betweenness_path(spark):
    e = edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1)])
    got = dict(rows(graph.betweenness(e, spark.createDataFrame([(n,) for n in "abcd"], "node string"))))
    assert got["b"] == got["c"] == 4.0 and got["a"] == 0.0


def test_pagerank_star(spark):
    e = edges(spark, [("hub", x, 1) for x in "abcd"])
    got = dict(rows(graph.pagerank(e)))
    assert got["hub"] > 2 * got["a"] and sum(got.values()) == pytest.approx(5, abs=0.05)


def test_communities_two_cliques(spark):
    e = edges(spark, [(a, b, 1) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w", 0.1)])
    got = dict(rows(graph.communities(e)))
    assert len({got[n] for n in "abcd"}) == 1 and len({got[n] for n in "wxyz"}) == 1 and got["a"] != got["z"]


def test_entity_pairs(spark):
    data = [("1", ["A", "b"]), ("2", ["a ", "B", "c"]), ("3", ["a"]), ("4", ["a", "c", "d"]), ("5", ["b", "a"])]
    df = spark.createDataFrame(data, "id string, entities array<string>").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    known = spark.createDataFrame([("4", "2")], "source_id string, target_id string")
    got = {(r["a"], r["b"]): r["shared"] for r in consolidation.entity_pairs(df, known, "2024-01-02").collect()}
    assert got == {("1", "1"): 2, ("1", "2"): 2}


def test_heuristic_summary():
    text, topics = consolidation.heuristic_summary([("user", "The gateway dropped packets. The gateway was restarted by hand."), ("assistant", "ok")])
    assert "gateway" in text and topics[0] == "gateway" and consolidation.heuristic_summary([]) == ("", [])


def test_knowledge_and_contradiction(spark):
    df = spark.createDataFrame([("d", "I prefer dark mode, always run the tests."), ("e", None)], "id string, t string")
    got = {(r["kind"], r["topic"], r["content"]) for r in consolidation.knowledge_candidates(df, "id", "t").collect()}
    assert got == {("semantic", "preference", "dark mode"), ("procedural", "convention", "the tests.")}
    pair = spark.createDataFrame([("I hate dark mode", "I like dark mode"), ("I hate tea", "I like dark mode")], "a string, b string")
    assert [r[0] for r in pair.select(consolidation.contradicts(F.col("a"), F.col("b"))).collect()] == [True, False]


@pytest.mark.parametrize("text, mode", [("hi", "skip"), ("what did we say", "deep"), ("tell me about the gateway", "light"), ("is it on the gateway?", "deep"), (None, "skip")])
def test_recall_mode(spark, text, mode):
    assert one(spark, text, L.recall_mode) == mode


def test_recall_failure_needs_no_hedge(spark):
    df = spark.createDataFrame([("assistant", "I can't find it"), ("assistant", "I can't find it, but it was March"), ("user", "I can't find it"), (None, None)], "role string, t string")
    assert [r[0] for r in df.select(L.recall_failure(F.col("role"), F.col("t"))).collect()] == [True, False, False, False]


def test_intent_and_emotion(spark):
    assert one(spark, "thanks!", L.intent) == "SOCIAL"
    assert one(spark, "please fix this error in the build", L.intent) == "DEBUGGING"
    assert one(spark, "this is awesome, can't wait!!", L.emotion)["label"] == "excited"


def test_light_stem():
    from palimpsest.operators.text_search import light_stem

    assert [light_stem(w) for w in ("running", "studies", "go")] == ["runn", "study", "go"]


def test_panel_tie_is_strict(spark):
    v = spark.createDataFrame([("q", "correct"), ("q", "incorrect")], "id string, verdict string")
    assert metrics.panel_verdict(v, "id").first()["verdict"] == "incorrect"


def test_salience_is_never_nan(spark):
    assert not math.isnan(one(spark, "", L.salience))


def test_relative_days(spark):
    df = spark.createDataFrame([("We met yesterday, and Yesterday again; last week too", "2024-03-10 08:00:00"), ("yesterday", None), (None, "2024-03-10 08:00:00")], "t string, a string")
    got = [r[0] for r in df.select(L.resolve_relative_days(F.col("t"), F.col("a").cast("timestamp"))).collect()]
    assert got == ["We met yesterday (approximately March 09, 2024), and Yesterday again; last week (approximately March 03, 2024) too", "yesterday", None]


def test_persons(spark):
    got = {p["name"]: p["confidence"] for p in one(spark, "Please ask Sarah about it. Sarah said no; The said yes. We told Bob Marsh.", L.persons)}
    assert got == {"Sarah": 0.9, "Bob Marsh": 0.95}


def test_repeats(spark):
    df = spark.createDataFrame([("the gateway failed", ["gateway a", "Gateway b", "c gateway"]), ("the gateway failed", ["gateway a"]), ("this that", ["this", "this", "this"])], "t string, r array<string>")
    assert [r[0] for r in df.select(L.repeats(F.col("t"), F.col("r"))).collect()] == [True, False, False]


def test_context_tools(spark):
    from palimpsest.operators import context

    assert context.project_scope(" Shared ", "x") is None and context.project_scope(None, "core") == "core" and context.project_scope("p", None) == "p"
    reply = spark.createDataFrame([('Sure: ```json\n{"a": 1}\n```',), ("no",)], "t string")
    assert [r[0] and r[0]["a"] for r in reply.select(context.tolerant_json(F.col("t"), "a int")).collect()] == [1, None]
    nodes = spark.createDataFrame([("p1", "person", "Ann"), ("e1", "entity", "Redis"), ("e2", "entity", "other")], "node string, label string, name string")
    named = context.entity_nodes(nodes, spark.createDataFrame([("ann",), ("redis",), ("Ann",)], "name string"))
    recalled = spark.createDataFrame([("m1", 0.9), ("e1", 0.2)], "id string, relevance double")
    got = dict(rows(context.seeds(recalled, named, "core")))
    assert got == {"m1": 0.9, "e1": 0.2, "p1": 0.7, "project:core": 0.6}
    act = spark.createDataFrame([("q", "person", "Ann", 0.5), ("q", "person", "ann", 0.4), ("q", "entity", "redis", 0.3), ("q", "intent", "QUESTION", 0.1), ("q", "intent", None, 0.1)], "query_id string, label string, name string, activation double")
    c = context.assemble(act).first()
    assert c["speakers"] == ["Ann"] and c["topics"] == ["redis"] and c["dominant_intent"] == "QUESTION"


def test_bm25_top_equals_all_hits_ranked(spark):
    import random

    from palimpsest.operators import text_search

    r = random.Random(4)
    texts = [(f"d{k:03d}", " ".join(r.choice("red blue Apple pie moon 7 river".split()) for _ in range(r.randrange(0, 5)))) for k in range(300)] + [("null", None)]
    docs = spark.createDataFrame(texts, "id string, content string").repartition(5)
    queries = spark.createDataFrame([("q1", "red apple"), ("q2", "APPLE, red red!"), ("q3", "moon"), ("q4", "nowhere"), ("q5", "..."), ("q6", None), ("q7", "7 rivers river")], "query_id string, query string")
    for k in (1, 7, 500):
        want = text_search.top(text_search.normalised(text_search.bm25(docs, queries)), k).select("query_id", "id", "score", "rank")
        got = text_search.bm25_top(docs, queries, k)
        assert rows(got) == rows(want) and got.count() > 3 * min(k, 20)


def test_boost_and_rescue_forms_no_row_for_every_text_hit(spark, data, monkeypatch):
    from palimpsest.operators import text_search
    from palimpsest.plans import ranking

    t = catalog.Tables(spark, data)
    asked = t.semantic.where(T.divisible_id(F.col("id"))).select(F.col("id").alias("query_id"), F.col("topic").alias("query"))
    every = text_search.top(text_search.normalised(text_search.bm25(t.episodes.where("content is not null"), asked)), 200)
    want = {(q, i): b for q, i, b in rows(every.select("query_id", "id", "score"))}

    def all_hits(*_):
        raise AssertionError("a row for every hit")

    monkeypatch.setattr(text_search, "bm25", all_hits)
    got = ranking.boost_and_rescue(t).collect()
    assert {(r["query_id"], r["id"]): r["boost"] for r in got if r["rescued"] or r["boost"] > 0} == want and want
    near = {(r["query_id"], r["id"]) for r in got if not r["rescued"]}
    assert len(near) + len(set(want) - near) == len(got) and near & set(want)


def test_scans_for_many_queries_keep_few_rows(spark, monkeypatch):
    """What a task keeps is counted in queries x k rows: no more tasks than run at once."""
    from palimpsest.operators import text_search

    monkeypatch.setattr(vectors, "MANY_KEPT", 10)
    r = np.random.default_rng(8)
    data = [(f"r{k:03d}", r.integers(-2, 3, 4).astype(float).tolist(), "red apple pie"[: 3 + 6 * (k % 2)]) for k in range(200)]
    many = spark.createDataFrame(data, "id string, embedding array<float>, content string").repartition(40)
    queries = [(i, v) for i, v, _ in data[:9] if any(v)]
    got = vectors.scan_topk(many, queries, 8, exclude_self=True)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in data if any(v)}
    for q, v in queries:
        want = sorted((-round(float(unit[q] @ x), 6), i) for i, x in unit.items() if i != q)[:8]
        assert [(-x["similarity"], x["id"]) for x in got.where(F.col("query_id") == q).orderBy("rank").collect()] == want
    assert vectors.in_order(many, 10).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    asked = spark.createDataFrame([("a", "red"), ("b", "apple red")], "query_id string, query string")
    assert text_search.bm25_top(many, asked, 8).count() == 16


def test_similar_texts_equal_all_pairs_and_form_no_candidates(spark, monkeypatch):
    import random

    from palimpsest.operators import text_search

    r = random.Random(5)
    lists = {k: [r.choice("abcdefghij") for _ in range(r.randrange(0, 8))] for k in range(90)}
    docs = spark.createDataFrame(list(lists.items()), "id long, words array<string>")
    asked = docs.where("id % 4 = 0").select("id")
    sets = {k: set(w) for k, w in lists.items() if w}
    for threshold in (0.5, 0.75, 1.0):
        want = sorted((q, k, round(len(a & b) / len(a | b), 9)) for q, a in sets.items() if q % 4 == 0 for k, b in sets.items() if k != q and len(a & b) >= threshold * len(a | b))
        for block in (1000, 7):
            monkeypatch.setattr(text_search, "MAX_TEXTS", block)
            pairs = text_search.similar_texts(docs, asked, threshold)
            assert [(q, k, round(j, 9)) for q, k, j in rows(pairs)] == want and want
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert text_search.similar_texts(docs, asked.limit(0), 0.5).count() == 0


def random_graph(seed=6, n=24, m=40):
    import random

    r = random.Random(seed)
    return sorted({tuple(sorted((f"n{r.randrange(n):02d}", f"n{r.randrange(n):02d}"))) for _ in range(m)})


def brute_betweenness(pairs):
    from collections import deque
    from itertools import permutations

    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def counted(source):
        depth, paths, queue = {source: 0}, {source: 1}, deque([source])
        while queue:
            x = queue.popleft()
            for y in near[x]:
                if y not in depth:
                    depth[y], paths[y] = depth[x] + 1, 0
                    queue.append(y)
                if depth[y] == depth[x] + 1:
                    paths[y] += paths[x]
        return depth, paths

    every = {x: counted(x) for x in near}
    out = dict.fromkeys(near, 0.0)
    for s, t in permutations(near, 2):
        depth, paths = every[s]
        if t in depth:
            for v in near:
                if v not in (s, t) and v in depth and t in every[v][0] and depth[v] + every[v][0][t] == depth[t]:
                    out[v] += paths[v] * every[v][1][t] / paths[t]
    return {k: round(v, 6) for k, v in out.items()}


def test_betweenness_equals_brute_force(spark):
    pairs = random_graph()
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")
    want = brute_betweenness(pairs)
    for bound in (10_000, 0):
        got = {r["node"]: round(r["score"], 6) for r in graph.betweenness(e, sent_edges=bound, batch=9).collect()}
        assert got == want
    assert graph.betweenness(e.limit(0)).count() == 0


@pytest.mark.parametrize("seed, n, m", [(3, 30, 26), (4, 26, 30), (5, 22, 34)])
def test_betweenness_over_blocks_trees_and_parts(spark, seed, n, m):
    pairs = random_graph(seed, n, m)
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")
    assert {r["node"]: round(r["score"], 6) for r in graph.betweenness(e).collect()} == brute_betweenness(pairs)
    some = spark.createDataFrame([(f"n{k:02d}",) for k in range(0, n, 3)], "node string")
    by = [{r["node"]: round(r["score"], 6) for r in graph.betweenness(e, some, sent_edges=bound).collect()} for bound in (10_000, 0)]
    assert by[0] == by[1]


def test_betweenness_of_a_long_tree_searches_no_block(spark, monkeypatch):
    def searched(*_):
        raise AssertionError("a tree has no block to search")

    monkeypatch.setattr(graph, "_dependencies", searched)
    e = spark.range(3000).selectExpr("lpad(id, 5, '0') src", "lpad(id + 1, 5, '0') dst", "1.0D weight")
    got = dict(rows(graph.betweenness(e)))
    assert got == {f"{k:05d}": 2.0 * k * (3000 - k) for k in range(3001)}


def test_bridge_flags_of_a_barbell_with_trees(spark):
    ring = [(f"{g}{k}", f"{g}{(k + 1) % 5}") for g in "lr" for k in range(5)]
    pairs = ring + [("l0", "m"), ("m", "r0")] + [(f"l{k}", f"leaf{k}") for k in range(1, 5)]
    scores = graph.betweenness(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")).withColumn("score", F.round("score", 6))
    got = {n: (s, b) for n, s, b in rows(graph.bridge_flags(scores))}
    want = brute_betweenness(pairs)
    cut = float(np.percentile(list(want.values()), 95))
    assert got == {n: (s, s >= cut) for n, s in want.items()} and sum(b for _, b in got.values()) == 1


def test_betweenness_over_rings_and_chains(spark):
    """Long ways between branching nodes, some as long as the ways around them, trees, a lone ring."""
    path = lambda *names: list(zip(names, names[1:]))
    pairs = path("a", "b1", "b2", "b3", "d") + path("a", "c1", "c2", "c3", "c4", "c5", "d") + path("a", "e", "d") + path("c2", "f1", "f2", "e") + path("b2", "t1", "t2") + path("c4", "t3")
    ring = [f"r{k}" for k in range(7)]
    pairs += path(*ring, "r0") + path("r3", "leaf") + path("t2", "r0") + path("x", "y", "z", "x")
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")
    assert {r["node"]: round(r["score"], 6) for r in graph.betweenness(e).collect()} == brute_betweenness(pairs)
    some = spark.createDataFrame([(n,) for n in ("a", "b2", "c1", "c4", "f2", "r5", "r6", "leaf", "x")], "node string")
    by = [{r["node"]: round(r["score"], 6) for r in graph.betweenness(e, some, sent_edges=bound).collect()} for bound in (10_000, 0)]
    assert by[0] == by[1]


def test_betweenness_searches_from_the_ends_of_chains_alone():
    n = 40
    ring = np.stack([np.arange(n), (np.arange(n) + 1) % n], axis=1)
    src, dst = np.r_[ring[:, 0], ring[:, 1]], np.r_[ring[:, 1], ring[:, 0]]
    start, dst = np.arange(0, 2 * n + 1, 2), dst[np.argsort(src, kind="stable")]
    groups = graph._groups(start, dst, np.ones(n), np.array([0, n]))
    assert sum(len(nodes) for nodes, _, _ in groups) == 2
    # ((n - 2) / 2) ^ 2 for every node of an even ring, in ordered pairs
    assert np.allclose(graph._dependencies(start, dst, np.ones(n), np.ones(n), np.array([0, n]), groups), (n - 2) ** 2 / 4)


@pytest.mark.parametrize("bound", [10_000, 0])
def test_bridge_flags_do_not_search_again(spark, bound):
    e = spark.createDataFrame([(a, b, 1.0) for a, b in random_graph()], "src string, dst string, weight double")
    plan = graph.bridge_flags(graph.betweenness(e, sent_edges=bound))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "LeftOuter" not in plan


def test_louvain_finds_planted_groups(spark):
    import random

    r = random.Random(2)
    edges = []
    for g in range(4):
        members = [f"g{g}m{k}" for k in range(8)]
        edges += [(a, b, 1.0) for i, a in enumerate(members) for b in members[:i] if r.random() < 0.8]
    edges += [(f"g{g}m0", f"g{(g + 1) % 4}m1", 0.3) for g in range(4)]
    got = dict(rows(graph.louvain(spark.createDataFrame(edges, "src string, dst string, weight double"))))
    assert got == {f"g{g}m{k}": f"g{g}m0" for g in range(4) for k in range(8)}
    assert graph.louvain(spark.createDataFrame([], "src string, dst string, weight double")).count() == 0


def test_louvain_in_one_task_equals_louvain_in_tables(spark):
    import random

    r = random.Random(9)
    pairs = random_graph(9, 60, 85)
    e = spark.createDataFrame([(a, b, round(r.uniform(0.1, 1), 3)) for a, b in pairs], "src string, dst string, weight double")
    got, tables = (rows(graph.louvain(e, sent_edges=bound)) for bound in (10_000, 0))
    assert got == tables and 1 < len({c for _, c in got}) < len(got)


def test_replay_links_seeds_that_share_three_nodes(spark):
    from palimpsest.operators import consolidation

    a = spark.createDataFrame([(s, n) for s, ns in {"s1": "abcd", "s2": "bcde", "s3": "xya"}.items() for n in ns], "seed string, node string")
    assert [(r["a"], r["b"], r["shared"], round(r["weight"], 6)) for r in consolidation.replay_pairs(a).collect()] == [("s1", "s2", 3, 0.6)]
