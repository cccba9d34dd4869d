"""Queries over consolidation jobs, backfills and incremental maintenance (inventory 15-27, 216-260)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.catalog import Tables
from palimpsest.functions import text as T
from palimpsest.operators import consolidation, graph, sequence, synthesis
from palimpsest.plans import aggregates
from palimpsest.plans.registry import NOW, Registry
from palimpsest.streaming import incremental

R = Registry()


@R.query(
    """+ u AS (SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(salience, 0.3) DESC, id) AS place, count(*) OVER (PARTITION BY session_id) AS n FROM ep WHERE consolidated_at IS NULL AND forgotten_at IS NULL AND session_id IS NOT NULL)
    SELECT id, session_id, place, CAST((place - 1) // 20 AS BIGINT) AS batch FROM u WHERE n >= 5"""
)
def light_sleep_batches(t: Tables) -> DataFrame:
    return consolidation.session_batches(t.episodes).select("id", "session_id", "place", "batch")


@R.query()
def light_sleep_digests(t: Tables) -> DataFrame:
    return consolidation.light_sleep(t.episodes, NOW)["digests"].select("id", "session_id", "batch", "summary", "key_topics", "project_id", "detail")


@R.query()
def knowledge_candidates(t: Tables) -> DataFrame:
    return consolidation.knowledge_candidates(t.episodes, "id", "content")


@R.query()
def deep_sleep_inserts(t: Tables) -> DataFrame:
    return consolidation.deep_sleep(t.digests, t.semantic, NOW, days=400)["inserts"]


@R.query(
    """SELECT id, round(CASE WHEN (last_accessed IS NULL OR last_accessed < $NOW - INTERVAL 30 DAY) AND forgotten_at IS NULL AND superseded_by IS NULL AND confidence > 0.05 THEN greatest(0.05, confidence - 0.02) ELSE confidence END, 6) AS confidence FROM se"""
)
def decay_flat(t: Tables) -> DataFrame:
    return consolidation.decay_flat(t.semantic, NOW).select("id", F.round("confidence", 6).alias("confidence"))


@R.query(
    """+ d AS (SELECT node, CAST(count(*) AS DOUBLE) AS rank FROM (SELECT source_id AS node FROM ed UNION ALL SELECT target_id FROM ed) GROUP BY 1), m AS (SELECT max(rank) AS m FROM d)
    SELECT se.id, round(CASE WHEN (last_accessed IS NULL OR last_accessed < $NOW - INTERVAL 30 DAY) AND confidence > 0.05 THEN greatest(0.05, confidence - 0.02 * (1 - 0.8 * coalesce(rank / m, 0))) ELSE confidence END, 6) AS confidence FROM se LEFT JOIN d ON node = se.id, m"""
)
def decay_gradient(t: Tables) -> DataFrame:
    e = t.associations
    degree = e.select(F.col("source_id").alias("node")).union(e.select("target_id")).groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("rank"))
    return consolidation.decay_gradient(t.semantic, degree, NOW).select("id", F.round("confidence", 6).alias("confidence"))


@R.query("SELECT id, edge_type FROM ed WHERE NOT coalesce(strength < 0.05 AND coalesce(last_activated, created_at) < $NOW - INTERVAL 90 DAY, false)")
def prune_edges(t: Tables) -> DataFrame:
    return consolidation.prune_weak(t.associations, NOW).select("id", "edge_type")


@R.query("SELECT id FROM ed WHERE NOT (last_activated IS NULL AND created_at < $NOW - INTERVAL 60 DAY AND edge_type <> 'derives_from')")
def prune_untravelled(t: Tables) -> DataFrame:
    edges = t.associations.withColumn("traversals", F.when(F.col("last_activated").isNull(), 0).otherwise(1))
    return consolidation.prune_untravelled(edges, NOW).select("id")


@R.query(
    """+ o AS (SELECT * FROM ep WHERE consolidated_at IS NULL AND forgotten_at IS NULL)
    SELECT 'light' AS cycle, (SELECT count(*) FROM o) >= 20 AS due UNION ALL SELECT 'deep', (SELECT count(*) FROM dg) >= 5
    UNION ALL SELECT 'dream', (SELECT count(*) FROM (SELECT session_id FROM o UNION SELECT session_id FROM dg) WHERE session_id IS NOT NULL) >= 10 UNION ALL SELECT 'decay', true"""
)
def due_gates(t: Tables) -> DataFrame:
    from palimpsest import schema

    return consolidation.due(t.episodes, t.digests, t.spark.createDataFrame([], schema.RUNS), NOW)


@R.query("SELECT edge_type, count(*) AS n, CAST(sum(CASE WHEN strength >= 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS walkable FROM ed GROUP BY 1")
def edge_strengths(t: Tables) -> DataFrame:
    return t.associations.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("strength") >= 0.2).cast("long")).alias("walkable"))


@R.query("+ u AS (SELECT source_id, target_id, edge_type, count(*) AS traversals, max(least(1, greatest(0, strength))) AS weight FROM ed GROUP BY 1, 2, 3) SELECT source_id AS src, target_id AS dst, edge_type, round(weight, 6) AS weight, CAST(2 * traversals AS BIGINT) AS traversals FROM u")
def edge_merge(t: Tables) -> DataFrame:
    e = t.associations.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "edge_type", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("strength"))).alias("weight"))
    return graph.merge_edges(e.withColumn("traversals", F.lit(1).cast("long")), e).withColumn("weight", F.round("weight", 6))


@R.query()
def replay_edges(t: Tables) -> DataFrame:
    """Every live episode with an edge replays what it activates; those that share three nodes or more
    are linked.  (The nightly job takes the newest five of them as seeds.)"""
    both = graph.symmetric(aggregates._edges(t), 0.01)
    linked = t.episodes.where("created_at is not null and forgotten_at is null").join(both.select(F.col("src").alias("id")).distinct(), "id")
    seeds = linked.where(T.divisible_id(F.col("id"))).select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(1.0).alias("value"))
    return consolidation.replay_pairs(graph.spread(both, seeds, 3, 0.6, 0.01, by=["seed"]).where("depth > 0"))


@R.query()
def community_summaries(t: Tables) -> DataFrame:
    members = graph.louvain(aggregates._edges(t))
    terms = t.digests.select(F.col("id").alias("node"), F.lit("topic").alias("kind"), F.explode("key_topics").alias("term")).where("term is not null")
    return consolidation.community_summaries(members, terms, minimum=2)


@R.query("SELECT max(created_at) AS cursor FROM ep")
def stream_cursor(t: Tables) -> DataFrame:
    return incremental.high_water(t.raw("episodes"))


@R.query("SELECT id FROM ep WHERE created_at >= TIMESTAMPTZ '2025-11-01 00:00:00+00' - INTERVAL 60 SECOND")
def rescan_with_overlap(t: Tables) -> DataFrame:
    return incremental.rescan(t.episodes, "2025-11-01").select("id")


@R.query(
    """SELECT id FROM ep WHERE embedding IS NOT NULL AND forgotten_at IS NULL""",
)
def reconcile_index(t: Tables) -> DataFrame:
    rows = t.episodes.where("embedding is not null").select("id", "created_at")
    cut = F.lit("2025-11-01").cast("timestamp")
    old, fresh = rows.where(F.col("created_at").isNull() | (F.col("created_at") < cut)), rows.where(F.col("created_at") >= cut)
    return incremental.apply_changes(old, fresh, t.episodes.where("forgotten_at is not null")).select("id")


@R.query(
    """+ u AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS turn, role FROM ep WHERE session_id IS NOT NULL AND created_at IS NOT NULL AND role IS NOT NULL)
    SELECT a.session_id, a.turn, count(DISTINCT b.role) AS primed FROM u a JOIN u b ON a.session_id = b.session_id AND b.turn BETWEEN a.turn - 4 AND a.turn GROUP BY 1, 2"""
)
def primed_topics(t: Tables) -> DataFrame:
    rows = t.episodes.where("session_id is not null and created_at is not null and role is not null").select("session_id", "id", "created_at", "role")
    placed = sequence.numbered(rows, "session_id", sequence.day_bucket("created_at"), [F.col("created_at"), F.col("id")], "turn")
    turns = placed.select("session_id", F.col("turn").cast("long").alias("turn"), F.array("role").alias("topics"))
    return incremental.primed_topics_batch(turns).select("session_id", "turn", F.size("topics").cast("long").alias("primed"))


@R.query()
def contextual_backfill(t: Tables) -> DataFrame:
    """Turns without a preamble, with the text an embedder gets for them."""
    rows = t.episodes.where("content is not null and session_id is not null and created_at is not null").select("id", "session_id", "created_at", "content", "metadata")
    rows = sequence.preceding(rows, "session_id", sequence.day_bucket("created_at"), ["created_at", "id"], 2, ["content"], "p").withColumn("before", F.transform("p", lambda x: x["content"]))
    due = rows.where(F.try_element_at("metadata", F.lit("contextPreamble")).isNull())
    return due.select("id", T.embed_text(F.col("content"), F.col("before"), F.lit(None).cast("string")).alias("text"))


@R.query()
def synthesis_blocks(t: Tables) -> DataFrame:
    rows = t.episodes.where("session_id is not null and content is not null")
    evidence = rows.select(F.col("session_id").alias("query_id"), "id", F.coalesce(T.resolve_event_date(F.col("metadata")), "created_at").alias("event_at"), "content")
    return synthesis.blocks(evidence)


@R.query("SELECT edge_type, 'topical' AS kind, count(*) AS n FROM ed WHERE source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mem WHERE mem.id = ed.target_id) GROUP BY 1")
def dangling_edges(t: Tables) -> DataFrame:
    gone = t.associations.where("source_id is not null").join(t.memories.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return gone.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")).select("edge_type", F.lit("topical").alias("kind"), "n")


@R.query("SELECT memory_type, count(*) AS n FROM (SELECT 'episode' AS memory_type, id FROM ep WHERE forgotten_at IS NULL AND salience >= 0.5 UNION ALL SELECT 'semantic', id FROM se WHERE forgotten_at IS NULL AND confidence >= 0.5) GROUP BY 1")
def forget_preview(t: Tables) -> DataFrame:
    a = t.episodes.where("forgotten_at is null and salience >= 0.5").select(F.lit("episode").alias("memory_type"), "id")
    b = t.semantic.where("forgotten_at is null and confidence >= 0.5").select(F.lit("semantic").alias("memory_type"), "id")
    return a.unionByName(b).groupBy("memory_type").agg(F.count(F.lit(1)).alias("n"))


@R.query()
def synthesis_notes(t: Tables) -> DataFrame:
    """Notes on the sessions of each project, as the answer to one temporal and one counting question."""
    asked = t.spark.createDataFrame([("temporal", "How long ago did we first talk about this?"), ("count", "How many different sessions did we have?")], "kind string, query string")
    rows = t.episodes.where("session_id is not null and content is not null and project_id is not null")
    rows = rows.select("project_id", "id", "session_id", F.coalesce(T.resolve_event_date(F.col("metadata")), "created_at").alias("event_at"), "content", "salience")
    best = Window.partitionBy("project_id").orderBy(F.col("salience").desc_nulls_last(), "id")
    hits = rows.withColumn("rank", F.row_number().over(best)).where("rank <= 30").drop("salience")
    now = F.lit(NOW).cast("timestamp")
    questions = hits.select("project_id").distinct().crossJoin(F.broadcast(asked)).select(F.concat_ws("/", "project_id", "kind").alias("query_id"), "project_id", "query", now.alias("now"))
    evidence = questions.select("query_id", "project_id").join(hits, "project_id").drop("project_id")
    groups = evidence.groupBy("query_id", "session_id").agg(F.min("event_at").alias("earliest"), F.count(F.lit(1)).alias("n"), F.min("rank").alias("position"))
    return synthesis.synthesize(questions.drop("project_id"), evidence, groups)
