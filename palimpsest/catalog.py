"""The tiers as frames: distinct rows, visibility rules, and one view over all tiers.

Unusual cases: rows delivered twice count once; in semantic the latest export of an id counts;
a null project is shared by all projects; digests have no tombstone.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.history import latest_records
from palimpsest.runtime import table


class Tables:
    """Lazily read tables of one folder; column pruning reaches the scans."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.raw(name)

    @cached_property
    def episodes(self) -> DataFrame:
        return self.raw("episodes").where("id is not null").dropDuplicates(["id"])

    @cached_property
    def digests(self) -> DataFrame:
        return self.raw("digests").where("id is not null").dropDuplicates(["id"])

    @cached_property
    def semantic(self) -> DataFrame:
        return latest_records(self.raw("semantic"))

    @cached_property
    def associations(self) -> DataFrame:
        return self.raw("associations").where("id is not null").dropDuplicates(["id"])

    @cached_property
    def memories(self) -> DataFrame:
        return all_tiers(self.episodes, self.digests, self.semantic)


#: the same rows stated in SQL
BASE_SQL = """
WITH ep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id) AS rn FROM episodes WHERE id IS NOT NULL) WHERE rn = 1),
dg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id) AS rn FROM digests WHERE id IS NOT NULL) WHERE rn = 1),
se AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, superseded_by DESC NULLS LAST) AS rn FROM semantic WHERE id IS NOT NULL) WHERE rn = 1),
ed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id) AS rn FROM associations WHERE id IS NOT NULL) WHERE rn = 1),
mem AS (
  SELECT 'episode' AS memory_type, id, content, session_id, project_id, role, created_at, access_count, embedding, forgotten_at, CAST(NULL AS VARCHAR) AS superseded_by FROM ep
  UNION ALL SELECT 'digest', id, summary, session_id, project_id, NULL, created_at, 0, embedding, NULL, NULL FROM dg
  UNION ALL SELECT 'semantic', id, content, NULL, project_id, NULL, created_at, access_count, embedding, forgotten_at, superseded_by FROM se)
"""

_VIEW = ("memory_type", "id", "content", "session_id", "project_id", "role", "created_at", "access_count", "embedding", "forgotten_at", "superseded_by")


def _aligned(df: DataFrame, tier: str, content: str, **given: Column) -> DataFrame:
    text, stamp = F.lit(None).cast("string"), F.lit(None).cast("timestamp")
    defaults = {"session_id": text, "project_id": text, "role": text, "access_count": F.lit(0).cast("long"), "forgotten_at": stamp, "superseded_by": text}
    columns = {"memory_type": F.lit(tier), "content": F.col(content)} | given
    return df.select(*[columns.get(c, F.col(c) if c in df.columns else defaults.get(c)).alias(c) for c in _VIEW])


def all_tiers(episodes: DataFrame, digests: DataFrame, semantic: DataFrame, procedural: DataFrame | None = None) -> DataFrame:
    """One view over the tiers with a ``memory_type`` column; filters push through the union."""
    out = _aligned(episodes, "episode", "content").unionByName(_aligned(digests, "digest", "summary")).unionByName(_aligned(semantic, "semantic", "content"))
    return out if procedural is None else out.unionByName(_aligned(procedural, "procedural", "procedure"))


def display_content(tier: Column, content: Column, topic: Column, trigger: Column) -> Column:
    """Text shown for a memory: facts and procedures carry their topic or trigger in front."""
    return F.when(tier == "semantic", F.concat(F.coalesce(topic, F.lit("")), F.lit(": "), content)).when(tier == "procedural", F.concat(F.coalesce(trigger, F.lit("")), F.lit(": "), content)).otherwise(content)


def text_to_embed(tier: str) -> Column:
    """The text an embedding is made from: topic with content, summary, trigger with procedure."""
    parts = {"episode": ["content"], "digest": ["summary"], "semantic": ["topic", "content"], "procedural": ["trigger", "procedure"]}[tier]
    return F.concat_ws(" ", *parts)


def live(df: DataFrame) -> DataFrame:
    """Rows neither forgotten nor superseded."""
    for c in ("forgotten_at", "superseded_by"):
        if c in df.columns:
            df = df.where(F.col(c).isNull())
    return df


def in_project(df: DataFrame, project: str | None) -> DataFrame:
    """Hard project scope: the project's rows and the shared ones; no project, no filter."""
    return df if project is None else df.where((F.col("project_id") == project) | F.col("project_id").isNull())


def in_session(df: DataFrame, session: str | None) -> DataFrame:
    """Session scope binds episodes only."""
    return df if session is None else df.where((F.col("memory_type") != "episode") | (F.col("session_id") == session))
