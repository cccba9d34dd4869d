"""Queries over scans, updates, feeds, filters and projections (inventory 1-42, 109-115)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import catalog
from palimpsest.catalog import Tables
from palimpsest.functions import lexicon as L
from palimpsest.functions import text as T
from palimpsest.operators import scans
from palimpsest.plans.registry import NOW, Registry

R = Registry()
PROJECT_SQL = "(SELECT min(project_id) FROM ep)"


def _project(t: Tables) -> str:
    return t.raw("episodes").agg(F.min("project_id")).first()[0]


def _session(t: Tables) -> str:
    return t.raw("episodes").agg(F.min("session_id")).first()[0]


@R.query("SELECT id, role, content FROM ep WHERE id = (SELECT min(id) FROM ep)")
def tier_point_lookup(t: Tables) -> DataFrame:
    first = t.raw("episodes").agg(F.min("id")).first()[0]
    return scans.by_id(t.episodes, first).select("id", "role", "content")


@R.query("SELECT m.memory_type, m.id, m.content FROM mem m WHERE EXISTS (SELECT 1 FROM ed WHERE ed.target_id = m.id AND ed.target_type = m.memory_type)")
def batched_hydrate(t: Tables) -> DataFrame:
    keys = t.raw("associations").select(F.col("target_type").alias("memory_type"), F.col("target_id").alias("id"))
    return scans.by_ids(t.memories, keys).select("memory_type", "id", "content")


@R.query("SELECT id, role, created_at FROM ep WHERE session_id = (SELECT min(session_id) FROM ep) AND created_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00'")
def session_scan(t: Tables) -> DataFrame:
    return scans.by_session(t.episodes, _session(t), "2025-01-01").select("id", "role", "created_at").orderBy("created_at", "id")


@R.query("SELECT id, round(salience, 6) AS salience FROM ep WHERE consolidated_at IS NULL AND forgotten_at IS NULL")
def unconsolidated_scan(t: Tables) -> DataFrame:
    return scans.unconsolidated(t.episodes).select("id", F.round("salience", 6).alias("salience")).orderBy(F.col("salience").desc(), "id")


@R.query("SELECT DISTINCT session_id FROM ep WHERE consolidated_at IS NULL AND forgotten_at IS NULL AND session_id IS NOT NULL")
def unconsolidated_sessions(t: Tables) -> DataFrame:
    return scans.unconsolidated(t.raw("episodes")).where("session_id is not null").select("session_id").distinct()


@R.query("SELECT id, session_id, created_at FROM dg WHERE created_at >= $NOW - INTERVAL 60 DAY")
def recent_digests(t: Tables) -> DataFrame:
    return scans.recent(t.digests, NOW, 60).select("id", "session_id", "created_at").orderBy(F.col("created_at").desc(), "id")


@R.query("SELECT id, round(confidence, 6) AS confidence FROM se WHERE confidence > 0.05 AND (last_accessed IS NULL OR last_accessed < $NOW - INTERVAL 30 DAY)")
def unaccessed_semantic(t: Tables) -> DataFrame:
    return scans.unaccessed(t.semantic, NOW, 30).select("id", F.round("confidence", 6).alias("confidence"))


@R.query("SELECT id, created_at FROM ep WHERE embedding IS NOT NULL AND forgotten_at IS NULL AND created_at > TIMESTAMPTZ '2025-06-01 00:00:00+00' ORDER BY created_at, id LIMIT 1000")
def keyset_scan(t: Tables) -> DataFrame:
    return scans.keyset_page(t.episodes, ("2025-06-01", "~"), 1000).select("id", "created_at")


@R.query(
    """SELECT DISTINCT * FROM (SELECT 'episode' AS memory_type, id FROM ep WHERE forgotten_at >= TIMESTAMPTZ '2025-06-01 00:00:00+00'
    UNION ALL SELECT 'semantic', id FROM se WHERE forgotten_at >= TIMESTAMPTZ '2025-06-01 00:00:00+00' OR (superseded_by IS NOT NULL AND updated_at >= TIMESTAMPTZ '2025-06-01 00:00:00+00'))"""
)
def tombstone_feed(t: Tables) -> DataFrame:
    return scans.tombstones(t.episodes, t.semantic, "2025-06-01")


@R.query("SELECT count(*) AS n, count(*) FILTER (WHERE superseded_by IS NULL) AS n_current FROM se")
def tier_insert(t: Tables) -> DataFrame:
    # inserting rows that are there already changes nothing
    again = scans.append(t.semantic, t.raw("semantic"))
    return again.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("superseded_by").isNull()).alias("n_current"))


@R.query(
    """, hits AS (SELECT target_id AS id, count(*) AS n FROM ed WHERE target_type = 'semantic' GROUP BY 1)
    SELECT se.id, access_count + coalesce(n, 0) AS access_count, round(CASE WHEN n IS NULL THEN confidence ELSE greatest(0.05, least(1, confidence + 0.05 * n)) END, 6) AS confidence
    FROM se LEFT JOIN hits USING (id)"""
    .replace(", hits", "+ hits", 1)
)
def record_access_boost(t: Tables) -> DataFrame:
    hits = t.associations.where("target_type = 'semantic'").select(F.col("target_id").alias("id"))
    return scans.record_access(t.semantic, hits, NOW, 0.05).select("id", "access_count", F.round("confidence", 6).alias("confidence"))


@R.query(
    """+ hit AS (SELECT DISTINCT unnest(source_episode_ids) AS id FROM dg)
    SELECT ep.id, CASE WHEN hit.id IS NOT NULL AND consolidated_at IS NULL THEN $NOW ELSE consolidated_at END AS consolidated_at FROM ep LEFT JOIN hit USING (id)"""
)
def mark_consolidated(t: Tables) -> DataFrame:
    ids = t.digests.select(F.explode("source_episode_ids").alias("id"))
    return scans.stamp(t.episodes, ids, "consolidated_at", NOW).select("id", "consolidated_at")


@R.query("SELECT count(*) AS newly_forgotten FROM ep WHERE forgotten_at IS NULL AND id IN (SELECT source_id FROM ed WHERE edge_type = 'contradicts')")
def mark_forgotten(t: Tables) -> DataFrame:
    ids = t.raw("associations").where("edge_type = 'contradicts'").select(F.col("source_id").alias("id"))
    after = scans.stamp(t.episodes.select("id", "forgotten_at"), ids, "forgotten_at", NOW)
    return after.where(F.col("forgotten_at") == F.lit(NOW).cast("timestamp")).agg(F.count(F.lit(1)).alias("newly_forgotten"))


@R.query(
    """+ pairs AS (SELECT supersedes AS old_id, min(id) AS new_id FROM se WHERE supersedes IS NOT NULL GROUP BY 1)
    SELECT se.id, coalesce(new_id, superseded_by) AS superseded_by, CASE WHEN new_id IS NOT NULL THEN coalesce(valid_until, $NOW) ELSE valid_until END AS valid_until FROM se LEFT JOIN pairs ON se.id = old_id"""
)
def mark_superseded(t: Tables) -> DataFrame:
    pairs = t.semantic.where("supersedes is not null").select(F.col("supersedes").alias("old_id"), F.col("id").alias("new_id"))
    return scans.supersede(t.semantic, pairs, NOW).select("id", "superseded_by", "valid_until")


@R.query("SELECT source_id, target_id, count(*) AS times, round(least(1.0, 0.2 + 0.1 * (count(*) - 1)), 6) AS strength FROM ed WHERE edge_type = 'co_recalled' GROUP BY 1, 2")
def co_recall_upsert(t: Tables) -> DataFrame:
    n = t.associations.where("edge_type = 'co_recalled'").groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("times"))
    return n.withColumn("strength", F.round(scans.co_recalled_strength(F.col("times")), 6))


@R.query(
    """SELECT project_id AS community_id, count(*) AS member_count, round(avg(salience), 4) AS mean_salience FROM ep WHERE project_id IS NOT NULL GROUP BY 1 ORDER BY member_count DESC, community_id LIMIT 20"""
)
def community_cache(t: Tables) -> DataFrame:
    rows = t.episodes.where("project_id is not null").groupBy(F.col("project_id").alias("community_id")).agg(F.count(F.lit(1)).alias("member_count"), F.round(F.avg("salience"), 4).alias("mean_salience"))
    return rows.orderBy(F.col("member_count").desc(), "community_id").limit(20)


@R.query("SELECT session_id, max(created_at) AS saved_at, count(*) AS n FROM ep WHERE session_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1")
def sensory_snapshot(t: Tables) -> DataFrame:
    # one document a session, the last write wins
    rows = t.episodes.where("session_id is not null and created_at is not null")
    return rows.groupBy("session_id").agg(F.max("created_at").alias("saved_at"), F.count(F.lit(1)).alias("n"))


@R.query("SELECT level, max(created_at) AS last, arg_max(id, (created_at, id)) AS last_id FROM dg GROUP BY level")
def run_ledger_last(t: Tables) -> DataFrame:
    return t.digests.groupBy("level").agg(F.max("created_at").alias("last"), F.max_by("id", F.struct("created_at", "id")).alias("last_id"))


@R.query("SELECT id, coalesce(topic || ' ', '') || content AS text FROM se WHERE embedding IS NULL AND content IS NOT NULL AND length(content) > 0 AND topic IS NOT NULL")
def embedding_backfill_texts(t: Tables) -> DataFrame:
    rows = t.semantic.where("embedding is null and content is not null and length(content) > 0 and topic is not null")
    return rows.select("id", F.substring(catalog.text_to_embed("semantic"), 1, 24_000).alias("text"))


@R.query("SELECT memory_type, id, content FROM mem WHERE content IS NOT NULL AND forgotten_at IS NULL AND superseded_by IS NULL")
def unified_view_live(t: Tables) -> DataFrame:
    return catalog.live(t.memories).where("content is not null").select("memory_type", "id", "content")


@R.query("SELECT id, topic || ': ' || content AS display FROM se WHERE topic IS NOT NULL AND content IS NOT NULL")
def display_projection(t: Tables) -> DataFrame:
    shown = catalog.display_content(F.lit("semantic"), F.col("content"), F.col("topic"), F.lit(None).cast("string"))
    return t.semantic.where("topic is not null and content is not null").select("id", shown.alias("display"))


@R.query("SELECT id, topic FROM se WHERE (valid_from IS NULL OR valid_from <= TIMESTAMPTZ '2025-08-01 00:00:00+00') AND (valid_until IS NULL OR valid_until > TIMESTAMPTZ '2025-08-01 00:00:00+00')")
def point_in_time(t: Tables) -> DataFrame:
    return scans.point_in_time(t.semantic, "2025-08-01").select("id", "topic")


@R.query("SELECT id, topic, coalesce(valid_from, created_at) AS effective_at FROM se WHERE contains(lower(topic), 'timezone') OR contains(lower(content), 'timezone')")
def topic_timeline(t: Tables) -> DataFrame:
    return scans.topic_timeline(t.semantic, "timezone").select("id", "topic", "effective_at").orderBy("effective_at", "id")


@R.query("SELECT doc_id, kind FROM documents WHERE text ILIKE '%gateway%'", base=False)
def ilike_fallback(t: Tables) -> DataFrame:
    return t.documents.where(F.col("text").ilike(scans.like_escaped("gateway"))).select("doc_id", "kind")


@R.query(f"SELECT memory_type, id FROM mem WHERE project_id = {PROJECT_SQL} OR project_id IS NULL")
def project_scope(t: Tables) -> DataFrame:
    return catalog.in_project(t.memories, _project(t)).select("memory_type", "id")


@R.query(f"SELECT id, round(salience + CASE WHEN project_id = {PROJECT_SQL} THEN 0.1 ELSE 0 END, 6) AS relevance FROM ep WHERE salience IS NOT NULL AND (project_id = {PROJECT_SQL} OR project_id IS NULL)")
def project_preference_strict(t: Tables) -> DataFrame:
    from palimpsest.operators.fusion import prefer_project

    rows = t.episodes.where("salience is not null").select("id", "project_id", F.col("salience").alias("relevance"))
    return prefer_project(rows, _project(t), strict=True).select("id", F.round("relevance", 6).alias("relevance"))


@R.query("SELECT memory_type, count(*) AS n FROM mem WHERE memory_type <> 'episode' OR session_id = (SELECT min(session_id) FROM ep) GROUP BY 1")
def session_scope_episode_only(t: Tables) -> DataFrame:
    return catalog.in_session(t.memories, _session(t)).groupBy("memory_type").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    """SELECT id FROM ep WHERE trim(lower(role)) = 'assistant' AND regexp_matches(content, '(?i)""" + L.RECALL_FAILURE.replace("'", "''") + """')
    AND NOT regexp_matches(substr(content, strpos(content, regexp_extract(content, '(?is)""" + L.RECALL_FAILURE.replace("'", "''") + """')) + length(regexp_extract(content, '(?is)""" + L.RECALL_FAILURE.replace("'", "''") + """')), 80), '(?i)""" + L.HEDGE + """')"""
)
def recall_failure_noise(t: Tables) -> DataFrame:
    return t.episodes.where(L.recall_failure(F.trim(F.lower("role")), F.col("content"))).select("id")


@R.query()
def ingest_filter(t: Tables) -> DataFrame:
    kept = L.should_ingest(F.col("content"), F.lower(F.trim("role")))
    return t.episodes.groupBy(kept.alias("kept")).agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT id, round(confidence, 6) AS confidence FROM se WHERE confidence >= 0.5 AND forgotten_at IS NULL")
def min_relevance_gate(t: Tables) -> DataFrame:
    return t.semantic.where("confidence >= 0.5 and forgotten_at is null").select("id", F.round("confidence", 6).alias("confidence"))


@R.query("SELECT id FROM dg WHERE len(list_filter(key_topics, lambda x: x IS NOT NULL AND contains(lower(x), 'queue'))) > 0")
def community_topic_filter(t: Tables) -> DataFrame:
    return t.digests.where(F.exists("key_topics", lambda x: F.coalesce(F.lower(x).contains("queue"), F.lit(False)))).select("id")


@R.query("SELECT count(*) AS n FROM (SELECT session_id FROM ep WHERE consolidated_at IS NULL AND forgotten_at IS NULL UNION SELECT session_id FROM dg) WHERE session_id IS NOT NULL")
def distinct_sessions_union(t: Tables) -> DataFrame:
    a = scans.unconsolidated(t.raw("episodes")).select("session_id")
    return a.union(t.raw("digests").select("session_id")).where("session_id is not null").distinct().agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT id FROM ep WHERE id NOT IN (SELECT source_id FROM ed WHERE source_id IS NOT NULL) AND id NOT IN (SELECT target_id FROM ed WHERE target_id IS NOT NULL)")
def exclude_recalled(t: Tables) -> DataFrame:
    ends = t.raw("associations").select(F.col("source_id").alias("id")).union(t.raw("associations").select("target_id")).distinct()
    return t.episodes.select("id").join(ends, "id", "left_anti")


@R.query()
def transport_clean(t: Tables) -> DataFrame:
    role = F.lower(F.trim("role"))
    return t.episodes.where("content is not null").select("id", T.clean(F.col("content")).alias("cleaned"), T.clean_for_search(F.col("content"), role).alias("searchable"), T.parts_text(F.col("content")).alias("parts_text"))
