"""Queries over context, seeds and run tools (inventory 54-60, 71-72, 86-87, 106, 124-148, 157, 182-196, 258-263)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.catalog import Tables
from palimpsest.functions import lexicon as L
from palimpsest.operators import context
from palimpsest.plans import aggregates
from palimpsest.plans.lexical import _any, _hit
from palimpsest.plans.registry import NOW, Registry

R = Registry()


@R.query()
def person_mentions(t: Tables) -> DataFrame:
    rows = t.documents.where("text is not null").select("doc_id", F.explode(L.persons(F.col("text"))).alias("p"))
    return rows.select("doc_id", "p.name", "p.confidence")


_S = "list_filter([" + ", ".join(f"CASE WHEN {_hit('content', p)} THEN {w} END" for w, p in L.ANALYSER_SIGNALS) + f", CASE WHEN ends_with(trim(content), '?') THEN 0.6 END, CASE WHEN contains(content, '```') THEN 0.5 END, CASE WHEN length(content) > 200 THEN 0.4 END, CASE WHEN {_hit('content', chr(92) + 'b(ok|okay|thanks|sure)' + chr(92) + 'b')} AND length(content) < 20 THEN 0.1 END], lambda x: x IS NOT NULL)"


@R.query(f"SELECT id, round(CASE WHEN len({_S}) = 0 THEN 0.3 ELSE least(0.99, list_max({_S}) + 0.05 * (len({_S}) - 1)) END, 2) AS score FROM ep WHERE content IS NOT NULL")
def analyser_salience(t: Tables) -> DataFrame:
    return t.episodes.where("content is not null").select("id", F.round(L.analyser_salience(F.col("content")), 2).alias("score"))


@R.query("SELECT item_id, list_filter(regexp_split_to_array(lower(question), '[\\s,;:.!?()\\[\\]{}\"'']+'), lambda w: length(w) >= 3 AND w NOT IN (" + ", ".join(repr(w) for w in L.CUE_STOP) + "))[1:8] AS cues FROM eval_items", base=False)
def query_cues(t: Tables) -> DataFrame:
    return t.eval_items.select("item_id", L.cues(F.col("question")).alias("cues"))


@R.query()
def query_variants(t: Tables) -> DataFrame:
    return t.eval_items.select("item_id", F.posexplode(L.query_variants(F.col("question"), L.intent(F.col("question")))).alias("n", "variant"))


@R.query(f"SELECT item_id, CASE WHEN len(answer_aliases) >= 3 THEN 'aggregation' WHEN {_any('question', L.TEMPORAL)} THEN 'temporal' WHEN len(answer_aliases) >= 2 THEN 'multi_hop' ELSE 'lookup' END AS structure, regexp_matches(answer, '^\\s*\\d+') AS is_number FROM eval_items", base=False)
def recall_structure(t: Tables) -> DataFrame:
    nothing = F.lit(None).cast("int"), F.lit(None).cast("string")
    return t.eval_items.select("item_id", L.recall_structure(*nothing, F.col("question"), F.col("answer_aliases")).alias("structure"), L.numeric_gold(F.col("answer")).alias("is_number"))


@R.query(f"SELECT id FROM ep WHERE content IS NOT NULL AND length(trim(content)) < 240 AND {_any('substr(trim(content), 1, 120)', L.ABSTENTIONS)}")
def abstentions(t: Tables) -> DataFrame:
    return t.episodes.where(L.abstention(F.col("content"))).select("id")


@R.query()
def relative_days(t: Tables) -> DataFrame:
    rows = t.episodes.where("content is not null and created_at is not null")
    said = L.resolve_relative_days(F.col("content"), F.col("created_at"))
    return rows.select("id", said.alias("said"), "content").where("said <> content").select("id", F.col("said").alias("content"))


@R.query(
    """+ s AS (SELECT DISTINCT dg.id AS digest_id, unnest(source_episode_ids) AS id FROM dg), k AS (SELECT DISTINCT * FROM s WHERE id IS NOT NULL), n AS (SELECT digest_id, count(*) AS n FROM k GROUP BY 1)
    SELECT digest_id, target_id AS dst, edge_type, round(count(DISTINCT k.id) / any_value(n), 6) AS weight FROM k JOIN ed ON ed.source_id = k.id JOIN n USING (digest_id) GROUP BY 1, 2, 3"""
)
def digest_context(t: Tables) -> DataFrame:
    sources = t.digests.select(F.col("id").alias("digest_id"), F.explode("source_episode_ids").alias("id")).where("id is not null")
    return context.inherit_digest_context(sources, aggregates._edges(t)).withColumn("weight", F.round("weight", 6))


@R.query(
    """+ l AS (SELECT DISTINCT se.id AS fact_id, unnest(source_digest_ids) AS digest_id FROM se), e AS (SELECT source_id, target_id, least(1, greatest(0, strength)) AS w FROM ed)
    SELECT fact_id, target_id AS dst, round(0.7 * max(w), 6) AS weight FROM l JOIN e ON source_id = digest_id WHERE target_id IS NOT NULL GROUP BY 1, 2"""
)
def fact_context(t: Tables) -> DataFrame:
    lineage = t.semantic.select(F.col("id").alias("fact_id"), F.explode("source_digest_ids").alias("digest_id")).distinct()
    return context.inherit_fact_context(lineage, aggregates._edges(t)).withColumn("weight", F.round("weight", 6))


@R.query("SELECT ep.project_id AS community, ed.edge_type AS label, ed.target_type AS name, count(*) AS n FROM ep JOIN ed ON ed.source_id = ep.id WHERE ep.project_id IS NOT NULL AND ed.target_id IS NOT NULL GROUP BY 1, 2, 3")
def context_frequency(t: Tables) -> DataFrame:
    members = t.episodes.where("project_id is not null").select(F.col("project_id").alias("community"), F.col("id").alias("node"))
    typed = t.associations.where("target_id is not null").select(F.col("source_id").alias("node"), F.col("edge_type").alias("label"), F.col("target_type").alias("name"))
    return members.join(typed, "node").groupBy("community", "label", "name").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    """+ a AS (SELECT target_id AS node, max(least(1, greatest(0, strength))) AS activation FROM ed WHERE target_id IS NOT NULL GROUP BY 1)
    SELECT project_id AS community, count(*) AS n, round(0.8 * avg(activation), 5) AS activation FROM a JOIN ep ON ep.id = a.node WHERE project_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2"""
)
def community_activation(t: Tables) -> DataFrame:
    activated = aggregates._edges(t).groupBy(F.col("dst").alias("node")).agg(F.max("weight").alias("activation"))
    members = t.episodes.where("project_id is not null").select(F.col("id").alias("node"), F.col("project_id").alias("community"))
    return context.community_activation(activated, members).withColumn("activation", F.round("activation", 5))


@R.query("+ x AS (SELECT session_id, role AS key, arg_max(salience, (created_at, id)) AS importance FROM ep WHERE session_id IS NOT NULL AND role IS NOT NULL AND created_at IS NOT NULL AND salience IS NOT NULL GROUP BY 1, 2) SELECT session_id, key, round(importance, 6) AS importance FROM x QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY importance DESC, key) <= 2")
def working_memory(t: Tables) -> DataFrame:
    rows = t.episodes.where("session_id is not null and role is not null and created_at is not null and salience is not null")
    items = rows.select("session_id", F.col("role").alias("key"), F.col("content").alias("value"), F.col("salience").alias("importance"), F.struct("created_at", "id").alias("seq"))
    return context.working_memory(items, capacity=2).select("session_id", "key", F.round("importance", 6).alias("importance"))


@R.query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS p FROM events) WHERE (p - 1) % 7 = 0", base=False)
def stride_sample(t: Tables) -> DataFrame:
    return context.stride_sample(t.events, "event_id", 7).select("event_id", "event_type")


@R.query("SELECT kind, round(sum(ceil(length(text) / 4.0) * 0.15 + 100 * 0.6) / 1000000, 6) AS usd FROM documents WHERE text IS NOT NULL GROUP BY 1", base=False)
def summary_cost(t: Tables) -> DataFrame:
    n = F.ceil(F.length("text") / 4)
    return t.documents.where("text is not null").groupBy("kind").agg(F.round(F.sum(context.cost(n, F.lit(100), 0.15, 0.6)), 6).alias("usd"))


@R.query("+ t AS (SELECT DISTINCT least(source_id, target_id) AS x, greatest(source_id, target_id) AS y FROM ed WHERE edge_type = 'temporal') SELECT id, round(CASE WHEN x IS NOT NULL THEN least(1, strength + 0.02) ELSE strength END, 6) AS weight, CASE WHEN x IS NOT NULL THEN 1 ELSE 0 END AS traversals FROM ed LEFT JOIN t ON least(source_id, target_id) = x AND greatest(source_id, target_id) = y")
def strengthened_edges(t: Tables) -> DataFrame:
    e = t.associations.select("id", F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("strength").alias("weight"), F.lit(0).alias("traversals"), F.lit(None).cast("timestamp").alias("last_traversed"))
    walked = t.associations.where("edge_type = 'temporal'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return context.strengthen(e, walked, NOW).select("id", F.round("weight", 6).alias("weight"), "traversals")
