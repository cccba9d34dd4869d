"""Scans, keyed reads, change feeds and updates expressed as frame transformations.

Updates return the new table (or the rows that change); the caller writes it.  Keys to update
come as frames and are joined, never collected.  Unusual cases: ids absent from the table change
nothing; repeated ids act once; empty key frames give the unchanged table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR, CEILING = 0.05, 1.0


def by_id(tier: DataFrame, id_: str) -> DataFrame:
    return tier.where(F.col("id") == id_)


def by_ids(memories: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the given (memory_type, id) pairs; pairs without a row are dropped."""
    return memories.join(keys.select("memory_type", "id").distinct(), ["memory_type", "id"], "left_semi")


def by_session(tier: DataFrame, session: str, since: str | None = None) -> DataFrame:
    out = tier.where(F.col("session_id") == session)
    return out if since is None else out.where(F.col("created_at") >= F.lit(since).cast("timestamp"))


def unconsolidated(episodes: DataFrame) -> DataFrame:
    return episodes.where("consolidated_at is null and forgotten_at is null")


def recent(tier: DataFrame, now: str, days: int) -> DataFrame:
    return tier.where(F.col("created_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def unaccessed(semantic: DataFrame, now: str, days: int) -> DataFrame:
    """Facts above the confidence floor that were not read for ``days`` (or ever)."""
    cut = F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")
    return semantic.where((F.col("confidence") > FLOOR) & (F.col("last_accessed").isNull() | (F.col("last_accessed") < cut)))


def keyset_page(tier: DataFrame, after: tuple[str, str] | None, size: int) -> DataFrame:
    """Next page of live embedded rows in (created_at, id) order; safe for equal timestamps."""
    rows = tier.where("embedding is not null")
    if "forgotten_at" in tier.columns:
        rows = rows.where("forgotten_at is null")
    if after is not None:
        at = F.lit(after[0]).cast("timestamp")
        rows = rows.where((F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col("id") > after[1])))
    return rows.orderBy("created_at", "id").limit(size)


def tombstones(episodes: DataFrame, semantic: DataFrame, since: str, procedural: DataFrame | None = None) -> DataFrame:
    """(memory_type, id) forgotten or superseded since an instant, once each."""
    at = F.lit(since).cast("timestamp")
    gone = [(t, df.where(F.col("forgotten_at") >= at)) for t, df in (("episode", episodes), ("semantic", semantic), ("procedural", procedural)) if df is not None]
    gone.append(("semantic", semantic.where(F.col("superseded_by").isNotNull() & (F.col("updated_at") >= at))))
    return reduce(DataFrame.union, [df.select(F.lit(t).alias("memory_type"), "id") for t, df in gone]).distinct()


def append(tier: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert: new rows whose id is not in the tier yet, aligned by name."""
    fresh = rows.dropDuplicates(["id"]).join(tier.select("id"), "id", "left_anti")
    return tier.unionByName(fresh, allowMissingColumns=True)


def record_access(tier: DataFrame, hits: DataFrame, now: str, boost: float = 0.0) -> DataFrame:
    """Counts reads; ``boost`` moves confidence, clamped to the floor and 1.  ``hits(id)`` may
    repeat an id: each counts."""
    n = hits.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    out = tier.join(n, "id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0)))
    out = out.withColumn("last_accessed", F.when(F.col("_n").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("last_accessed")))
    if boost and "confidence" in tier.columns:
        moved = F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), F.col("confidence") + boost * F.col("_n")))
        out = out.withColumn("confidence", F.when(F.col("_n").isNotNull(), moved).otherwise(F.col("confidence")))
    return out.select(*tier.columns)


def stamp(tier: DataFrame, ids: DataFrame, column: str, now: str) -> DataFrame:
    """Sets a null time column for the given ids (consolidated, forgotten); set ones stay."""
    marked = tier.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return marked.withColumn(column, F.when(F.col("_hit") & F.col(column).isNull(), F.lit(now).cast("timestamp")).otherwise(F.col(column))).select(*tier.columns)


def supersede(semantic: DataFrame, pairs: DataFrame, now: str) -> DataFrame:
    """``pairs(old_id, new_id)``: links both records and closes the old one's validity.  Of
    several successors the smallest id counts."""
    at = F.lit(now).cast("timestamp")
    old = pairs.groupBy(F.col("old_id").alias("id")).agg(F.min("new_id").alias("_by"))
    new = pairs.groupBy(F.col("new_id").alias("id")).agg(F.min("old_id").alias("_of"))
    out = semantic.join(old, "id", "left").join(new, "id", "left")
    return out.withColumns(
        {
            "superseded_by": F.coalesce("_by", "superseded_by"),
            "supersedes": F.coalesce("_of", "supersedes"),
            "valid_until": F.when(F.col("_by").isNotNull(), F.coalesce("valid_until", at)).otherwise(F.col("valid_until")),
            "updated_at": F.when(F.coalesce("_by", "_of").isNotNull(), at).otherwise(F.col("updated_at")),
        }
    ).select(*semantic.columns)


def co_recalled_strength(times: Column) -> Column:
    """Strength after n co-recalls: 0.2 at first, 0.1 more each time, at most 1."""
    return F.least(F.lit(1.0), F.lit(0.2) + F.lit(0.1) * (times - 1))


def point_in_time(semantic: DataFrame, at: str) -> DataFrame:
    """Facts valid at an instant: half-open interval, nulls open, supersession ignored."""
    t = F.lit(at).cast("timestamp")
    return semantic.where((F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_until").isNull() | (F.col("valid_until") > t)))


def topic_timeline(semantic: DataFrame, topic: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Facts about a topic in order of effect, superseded ones included."""
    effect = F.coalesce("valid_from", "created_at")
    out = semantic.where(F.lower("topic").contains(topic.lower()) | F.lower("content").contains(topic.lower())).withColumn("effective_at", effect)
    for bound, keep in ((start, lambda t: F.col("effective_at") >= t), (end, lambda t: F.col("effective_at") <= t)):
        if bound is not None:
            out = out.where(keep(F.lit(bound).cast("timestamp")))
    return out


def like_escaped(text: str) -> str:
    """Search text as a LIKE pattern without wild cards of its own."""
    for c in ("\\", "%", "_"):
        text = text.replace(c, "\\" + c)
    return f"%{text}%"
