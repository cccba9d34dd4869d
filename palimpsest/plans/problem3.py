"""Queries of problem 3 (histories of semantic records) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import history
from palimpsest.runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = history.version_pairs(table(spark, sf_dir, "semantic"))
    return pairs.select(F.least("id", "next_id").alias("id_a"), F.greatest("id", "next_id").alias("id_b"))


def p3_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.linked_histories(table(spark, sf_dir, "semantic"))


QUERIES = {f.__name__: f for f in (p3_found, p3_history)}

#: topics of the tables differ in case, spaces and punctuation only, which this states in SQL
_LINKED = r"""
WITH RECURSIVE latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST) AS rn
                 FROM semantic WHERE id IS NOT NULL) WHERE rn = 1),
facts AS (
  SELECT id, coalesce(updated_at, created_at) AS held_at, supersedes, superseded_by, topic, content, confidence, project_id,
         array_to_string(regexp_extract_all(lower(topic), '[\p{L}\p{N}]+'), ' ') AS topic_key FROM latest),
links AS (
  SELECT supersedes AS x, id AS y FROM facts WHERE supersedes IS NOT NULL
  UNION SELECT id, superseded_by FROM facts WHERE superseded_by IS NOT NULL),
held AS (
  SELECT x, y FROM links JOIN facts a ON a.id = x JOIN facts b ON b.id = y
  WHERE x <> y AND a.topic_key = b.topic_key AND a.held_at <= b.held_at),
both_ways AS (SELECT x AS a, y AS b FROM held UNION SELECT y, x FROM held),
reach AS (
  SELECT a AS node, a AS seen FROM both_ways
  UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.seen),
roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node),
versions AS (SELECT coalesce(root, id) AS entity, id, held_at, topic, content, confidence, project_id FROM facts LEFT JOIN roots ON node = id WHERE held_at IS NOT NULL),
history AS (
  SELECT *, lag(id) OVER w IS NULL OR (topic, content, confidence, project_id) IS DISTINCT FROM (lag(topic) OVER w, lag(content) OVER w, lag(confidence) OVER w, lag(project_id) OVER w) AS opens,
         lead(id) OVER w AS next_id
  FROM versions WINDOW w AS (PARTITION BY entity ORDER BY held_at, id))
"""

SQL = {
    "p3_found": _LINKED + "SELECT least(id, next_id) AS id_a, greatest(id, next_id) AS id_b FROM history WHERE next_id IS NOT NULL",
    "p3_history": _LINKED
    + """SELECT entity, id, topic, content, confidence, project_id, held_at AS valid_from, lead(held_at) OVER w AS valid_to, lead(held_at) OVER w IS NULL AS is_current
    FROM history WHERE opens WINDOW w AS (PARTITION BY entity ORDER BY held_at, id)""",
}
