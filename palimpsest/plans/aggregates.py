"""Queries over aggregates, graphs and metrics (inventory 53-87, 183-204, 255-263)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.catalog import Tables
from palimpsest.functions import lexicon as L
from palimpsest.functions import text as T
from palimpsest.operators import consolidation, graph, metrics
from palimpsest.plans.registry import NOW, Registry

R = Registry()


@R.query("SELECT 'episode' AS tier, count(*) AS n FROM ep UNION ALL SELECT 'digest', count(*) FROM dg UNION ALL SELECT 'semantic', count(*) FROM se WHERE superseded_by IS NULL UNION ALL SELECT 'association', count(*) FROM ed")
def tier_stats(t: Tables) -> DataFrame:
    frames = {"episode": t.episodes, "digest": t.digests, "semantic": t.semantic.where("superseded_by is null"), "association": t.associations}
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tier"), "n") for name, df in frames.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@R.query("SELECT session_id, count(*) AS n FROM dg WHERE session_id IS NOT NULL GROUP BY 1")
def digest_counts(t: Tables) -> DataFrame:
    return t.digests.where("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    """+ c AS (SELECT session_id, project_id, count(*) AS n, min((created_at, id)) AS first FROM ep WHERE project_id IS NOT NULL AND session_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1, 2)
    SELECT session_id, project_id FROM c QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first) = 1"""
)
def majority_project(t: Tables) -> DataFrame:
    rows = t.episodes.where("session_id is not null and created_at is not null")
    return consolidation.majority(rows, ["session_id"], "project_id", ["created_at", "id"])


@R.query()
def entity_cooccurrence(t: Tables) -> DataFrame:
    rows = t.episodes.select("id", "created_at", F.from_json("entities_json", "array<string>", {"mode": "PERMISSIVE"}).alias("entities")).where("entities is not null")
    return consolidation.entity_pairs(rows, t.associations, NOW, days=400, limit=50)


@R.query(
    """+ w AS (SELECT id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: length(x) >= 3))) AS word FROM ep WHERE session_id = (SELECT min(session_id) FROM ep) AND content IS NOT NULL)
    SELECT word, n, round(0.15 * least(n, 5), 6) AS boost FROM (SELECT word, count(*) AS n FROM w GROUP BY 1) WHERE n >= 2"""
)
def priming_topics(t: Tables) -> DataFrame:
    session = t.raw("episodes").agg(F.min("session_id")).first()[0]
    words = F.array_distinct(F.filter(F.split(F.lower("content"), "[^a-z0-9]+"), lambda x: F.length(x) >= 3))
    n = t.episodes.where((F.col("session_id") == session) & F.col("content").isNotNull()).select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return n.where("n >= 2").withColumn("boost", F.round(0.15 * F.least("n", F.lit(5)), 6))


@R.query("SELECT kind, term, n FROM (SELECT kind, term, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, term) AS r FROM (SELECT kind, term, count(*) AS n FROM (SELECT kind, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2)) WHERE r <= 3", base=False)
def community_top_terms(t: Tables) -> DataFrame:
    n = t.documents.where("text is not null").select("kind", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("n").desc(), "term"))).where("r <= 3").drop("r")


def _edges(t: Tables) -> DataFrame:
    return t.associations.where("source_id is not null and target_id is not null").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("strength"))).alias("weight"), "edge_type", "created_at", "last_activated")


_EDGES = "e AS (SELECT source_id AS src, target_id AS dst, least(1, greatest(0, strength)) AS weight, edge_type FROM ed WHERE source_id IS NOT NULL AND target_id IS NOT NULL)"
_SYM = "b AS (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) WHERE src <> dst AND weight >= {m} GROUP BY 1, 2)"


@R.query("SELECT edge_type, source_type, target_type, count(*) AS n FROM ed GROUP BY 1, 2, 3")
def graph_stats(t: Tables) -> DataFrame:
    return t.associations.groupBy("edge_type", "source_type", "target_type").agg(F.count(F.lit(1)).alias("n"))


def _hub(t: Tables) -> str:
    return t.associations.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "source_id").first()[0]


_HUB = "(SELECT source_id FROM ed GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@R.query(f"+ {_EDGES} SELECT node, round(max(weight), 6) AS weight FROM (SELECT dst AS node, weight FROM e WHERE src = {_HUB} UNION ALL SELECT src, weight FROM e WHERE dst = {_HUB}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def neighbors(t: Tables) -> DataFrame:
    edges = _edges(t).withColumn("weight", F.round("weight", 6))
    return graph.neighbours(edges, _hub(t), limit=50)


@R.query("SELECT ep.id FROM ep WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.source_id = ep.id OR ed.target_id = ep.id)")
def isolated_nodes(t: Tables) -> DataFrame:
    return graph.isolated(t.episodes.select(F.col("id").alias("node")), _edges(t)).select(F.col("node").alias("id"))


_SEEDS = "seeds AS (SELECT DISTINCT source_id AS id FROM ed ORDER BY 1 LIMIT 5)"


def _seeds(t: Tables) -> DataFrame:
    return t.associations.select(F.col("source_id").alias("id")).distinct().orderBy("id").limit(5)


@R.query(
    f"""+ {_EDGES}, {_SYM.format(m=0.2)}, {_SEEDS}, h1 AS (SELECT dst AS node, max(weight) AS s FROM b JOIN seeds ON src = id GROUP BY 1), h2 AS (SELECT b.dst AS node, max(s * weight) AS s FROM h1 JOIN b ON b.src = h1.node GROUP BY 1)
    SELECT node AS id, min(d) AS depth, round(max(s), 6) AS strength FROM (SELECT node, s, 1 AS d FROM h1 UNION ALL SELECT node, s, 2 FROM h2) WHERE node NOT IN (SELECT id FROM seeds) GROUP BY 1"""
)
def association_walk_2hop(t: Tables) -> DataFrame:
    return graph.walk(_edges(t), _seeds(t), 2, 0.2, limit=None).withColumn("strength", F.round("strength", 6))


_H = "".join(f", h{i} AS (SELECT dst AS node, max(v * weight * 0.6) AS v FROM h{i - 1} JOIN b ON src = node WHERE v * weight * 0.6 >= 0.05 GROUP BY 1)" for i in (1, 2, 3))


@R.query(
    f"""+ {_EDGES}, {_SYM.format(m=0.01)}, {_SEEDS}, h0 AS (SELECT id AS node, 1.0 AS v FROM seeds){_H}
    SELECT node, round(max(v), 6) AS activation, min(d) AS depth FROM (SELECT node, v, 1 AS d FROM h1 UNION ALL SELECT node, v, 2 FROM h2 UNION ALL SELECT node, v, 3 FROM h3) WHERE node NOT IN (SELECT id FROM seeds) GROUP BY 1"""
)
def spreading_activation(t: Tables) -> DataFrame:
    seeds = _seeds(t).select(F.col("id").alias("node"), F.lit(1.0).alias("value"))
    out = graph.activate(_edges(t), seeds, hops=3, decay=0.6, threshold=0.05, budget=1_000_000)
    return out.withColumn("activation", F.round("activation", 6))


@R.query(
    f"""+ {_EDGES}, g AS (SELECT edge_type AS attribute, dst AS node, max(weight) AS v FROM e GROUP BY 1, 2)
    SELECT node, count(DISTINCT attribute) AS n, round(least(1, max(v) * pow(1.2, count(DISTINCT attribute) - 1)), 6) AS activation FROM g GROUP BY 1"""
)
def convergence_bonus(t: Tables) -> DataFrame:
    g = _edges(t).groupBy(F.col("edge_type").alias("attribute"), F.col("dst").alias("node")).agg(F.max("weight").alias("value"))
    return graph.converge(g).withColumn("activation", F.round("activation", 6))


@R.query()
def pagerank(t: Tables) -> DataFrame:
    return graph.pagerank(_edges(t)).withColumn("rank", F.round("rank", 6))


@R.query()
def communities(t: Tables) -> DataFrame:
    return graph.louvain(_edges(t))


@R.query()
def label_communities(t: Tables) -> DataFrame:
    return graph.communities(_edges(t))


@R.query()
def betweenness(t: Tables) -> DataFrame:
    return graph.betweenness(_edges(t)).withColumn("score", F.round("score", 6))


@R.query()
def bridge_nodes_p95(t: Tables) -> DataFrame:
    return graph.bridge_flags(graph.betweenness(_edges(t)).withColumn("score", F.round("score", 6)))


@R.query(
    """+ x AS (SELECT DISTINCT ed.target_id AS node, ep.project_id, ep.id FROM ed JOIN ep ON ep.id = ed.source_id WHERE ep.project_id IS NOT NULL), n AS (SELECT node, project_id, count(*) AS n FROM x GROUP BY 1, 2)
    SELECT a.project_id AS project_a, b.project_id AS project_b, count(*) AS shared_nodes, CAST(sum(a.n + b.n) AS BIGINT) AS memories FROM n a JOIN n b ON a.node = b.node AND a.project_id < b.project_id GROUP BY 1, 2"""
)
def project_bridges(t: Tables) -> DataFrame:
    links = t.associations.select(F.col("target_id").alias("node"), F.col("source_id").alias("id"))
    n = links.join(t.episodes.where("project_id is not null").select("id", "project_id"), "id").distinct().groupBy("node", "project_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = n.select("node", F.col("project_id").alias("project_a"), F.col("n").alias("x")), n.select("node", F.col("project_id").alias("project_b"), F.col("n").alias("y"))
    # pre-aggregated to one row a (node, project), so a node joins its projects, not its memories
    return a.join(b, "node").where("project_a < project_b").groupBy("project_a", "project_b").agg(F.count(F.lit(1)).alias("shared_nodes"), F.sum(F.col("x") + F.col("y")).alias("memories"))


@R.query(
    """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1, 2, 3)
    SELECT a.event_type AS cause, b.event_type AS effect, count(*) AS sessions FROM s a JOIN s b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type <> b.event_type AND a.first < b.last GROUP BY 1, 2 HAVING count(*) >= 3""", base=False
)
def causal_pairs(t: Tables) -> DataFrame:
    events = t.events.select(F.concat_ws("|", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session"), F.col("event_type").alias("topic"), F.col("ts").alias("at"))
    return consolidation.causal_topics(events)


@R.query("SELECT label, n, earliest FROM (SELECT lower(trim(topic)) AS label, count(*) AS n, min(created_at) AS earliest FROM se WHERE topic IS NOT NULL GROUP BY 1)")
def distinct_instances(t: Tables) -> DataFrame:
    from palimpsest.operators.synthesis import distinct_instances as group

    return group(t.semantic.where("topic is not null"), "topic", "created_at").drop("place")


@R.query()
def episode_graph(t: Tables) -> DataFrame:
    c = F.col("content")
    turns = t.episodes.where("content is not null").select("id", "session_id", "role", "created_at", "project_id", L.entities(c).alias("entities"), L.emotion(c).alias("emotion"), L.content_intent(c).alias("intent"))
    edges = graph.decompose_episodes(turns)
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


# --- metrics over surrogate runs -----------------------------------------------------------------


def _runs(t: Tables) -> DataFrame:
    """Digests as questions: the source episodes are gold, the first three of them retrieved in
    reverse order."""
    d = t.digests.where("source_episode_ids is not null")
    gold = F.array_compact("source_episode_ids")
    return d.select(F.col("id").alias("question_id"), F.col("level").cast("string").alias("question_type"), gold.alias("gold"), F.reverse(F.slice(gold, 1, 3)).alias("retrieved"))


@R.query(
    """+ r AS (SELECT CAST(level AS VARCHAR) AS question_type, list_filter(source_episode_ids, lambda x: x IS NOT NULL) AS gold FROM dg WHERE source_episode_ids IS NOT NULL), p AS (SELECT question_type, gold, list_reverse(gold[1:3]) AS got, unnest([1, 2, 5]) AS k FROM r),
    f AS (SELECT k, question_type, len(gold) > 0 AND list_has_any(gold, got[1:k]) AS a, len(gold) > 0 AND list_has_all(got[1:k], gold) AS c FROM p)
    SELECT k, coalesce(question_type, 'all') AS question_type, count(*) AS n, round(avg(CAST(a AS INT)), 6) AS any_hit, round(avg(CAST(c AS INT)), 6) AS complete_evidence FROM f GROUP BY GROUPING SETS ((k), (k, question_type))"""
)
def recall_at_k(t: Tables) -> DataFrame:
    m = metrics.recall_at(_runs(t), [1, 2, 5])
    return m.select("k", F.coalesce("question_type", F.lit("all")).alias("question_type"), "n", F.round("any_hit", 6).alias("any_hit"), F.round("complete_evidence", 6).alias("complete_evidence"))


@R.query(
    """WITH p AS (SELECT item_id, regexp_extract_all(lower(question), '[a-z0-9]+') AS a, regexp_extract_all(lower(passage), '[a-z0-9]+') AS g FROM eval_items),
    x AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(a) AS w FROM p) GROUP BY 1, 2), y AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(g) AS w FROM p) GROUP BY 1, 2),
    s AS (SELECT item_id, sum(least(x.n, y.n)) AS s FROM x JOIN y USING (item_id, w) GROUP BY 1)
    SELECT item_id, round(coalesce(s, 0) / len(a), 6) AS precision, round(coalesce(s, 0) / len(g), 6) AS recall FROM p LEFT JOIN s USING (item_id) WHERE len(a) > 0 AND len(g) > 0""", base=False
)
def token_f1(t: Tables) -> DataFrame:
    f = metrics.token_f1(t.eval_items.select("item_id", "question", "passage"), "question", "passage")
    return f.where(F.length("question") > 0).select("item_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


_JUDGED = "a AS (SELECT id, salience > 0.4 AS x FROM ep WHERE salience IS NOT NULL), b AS (SELECT id, access_count > 3 AS y FROM ep WHERE access_count IS NOT NULL)"


@R.query(f"+ {_JUDGED} SELECT count(*) FILTER (WHERE x AND y) AS both_right, count(*) FILTER (WHERE x AND NOT y) AS b, count(*) FILTER (WHERE NOT x AND y) AS c, count(*) FILTER (WHERE NOT x AND NOT y) AS both_wrong, count(*) FILTER (WHERE y IS NULL) AS only_base, count(*) FILTER (WHERE x IS NULL) AS only_treated FROM a FULL OUTER JOIN b USING (id)")
def mcnemar_counts(t: Tables) -> DataFrame:
    base = t.episodes.where("salience is not null").select("id", (F.col("salience") > 0.4).alias("ok"))
    treated = t.episodes.where("access_count is not null").select("id", (F.col("access_count") > 3).alias("ok"))
    return metrics.paired_outcomes(base, treated, "id", "ok")


_VERDICT = "CASE WHEN {c} > 0.6 THEN 'correct' WHEN {c} > 0.35 THEN 'partial' ELSE 'incorrect' END"


def _verdict(c: str):
    return F.when(F.col(c) > 0.6, "correct").when(F.col(c) > 0.35, "partial").otherwise("incorrect")


@R.query(f"+ v AS (SELECT coalesce(project_id, 'shared') AS kind, {_VERDICT.format(c='confidence')} AS verdict FROM se WHERE confidence IS NOT NULL) SELECT coalesce(kind, 'all') AS kind, count(*) AS n, round(avg(CAST(verdict = 'correct' AS INT)), 6) AS strict, round(avg(CAST(verdict IN ('correct', 'partial') AS INT)), 6) AS lenient FROM v GROUP BY GROUPING SETS ((), (kind))")
def verdict_accuracy(t: Tables) -> DataFrame:
    rows = t.semantic.where("confidence is not null").select(F.coalesce("project_id", F.lit("shared")).alias("kind"), _verdict("confidence").alias("verdict"))
    return metrics.accuracy(rows, "kind").select(F.coalesce("kind", F.lit("all")).alias("kind"), "n", F.round("strict", 6).alias("strict"), F.round("lenient", 6).alias("lenient"))


@R.query(
    f"""+ v AS (SELECT session_id, {_VERDICT.format(c='salience')} AS verdict FROM ep WHERE session_id IS NOT NULL AND salience IS NOT NULL), n AS (SELECT session_id, verdict, count(*) AS n FROM v GROUP BY 1, 2)
    SELECT session_id, verdict FROM n QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, CASE verdict WHEN 'incorrect' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END) = 1"""
)
def panel_verdict(t: Tables) -> DataFrame:
    votes = t.episodes.where("session_id is not null and salience is not null").select("session_id", _verdict("salience").alias("verdict"))
    return metrics.panel_verdict(votes, "session_id")


@R.query("+ a AS (SELECT id, memory_type FROM mem), x AS (SELECT memory_type, project_id, access_count > 2 AS busy FROM mem) SELECT coalesce(memory_type, 'all') AS memory_type, CASE WHEN busy IS NULL THEN 'all' WHEN busy THEN 'busy' ELSE 'idle' END AS use, count(*) AS n FROM x WHERE busy IS NOT NULL GROUP BY CUBE (memory_type, busy)")
def ablation_cube(t: Tables) -> DataFrame:
    """Extension: all marginals of a two-way comparison in one pass."""
    rows = t.memories.select("memory_type", (F.col("access_count") > 2).alias("busy")).where("busy is not null")
    cube = rows.cube("memory_type", "busy").agg(F.count(F.lit(1)).alias("n"))
    return cube.select(F.coalesce("memory_type", F.lit("all")).alias("memory_type"), F.when(F.col("busy").isNull(), "all").when(F.col("busy"), "busy").otherwise("idle").alias("use"), "n")


@R.query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1", base=False)
def latency_percentiles(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("value", 0.95), 4).alias("p95"))


@R.query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2", base=False)
def tumbling_windows(t: Tables) -> DataFrame:
    """Extension: tumbling windows (the stream's batch twin)."""
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


@R.query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""", base=False
)
def session_windows(t: Tables) -> DataFrame:
    """Extension: session windows with a gap of 30 minutes."""
    return t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@R.query("SELECT n_name, o_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM (SELECT n_name, year(o_orderdate) AS o_year, l_extendedprice, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1, 2", base=False)
def lineage_star_join(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", F.year("o_orderdate").cast("long").alias("o_year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
