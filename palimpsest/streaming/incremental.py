"""Incremental maintenance with Structured Streaming.

The batch functions define the results; the streams apply them to micro-batches with event-time
late-data allowance and idempotent upserts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.sequence import recent_count

LATE = "60 seconds"


def file_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def deduplicated(stream: DataFrame, at: str = "created_at", key: str = "id", late: str = LATE) -> DataFrame:
    """Rows once each although re-delivered within the allowance."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def high_water(rows: DataFrame, at: str = "created_at") -> DataFrame:
    """Cursor after a scan: the greatest time seen; an empty scan gives null (keep the old one)."""
    return rows.agg(F.max(at).alias("cursor"))


def rescan(rows: DataFrame, cursor: str, overlap_s: int = 60, at: str = "created_at") -> DataFrame:
    """Rows from the cursor less the overlap on; the overlap widens the query, not the cursor."""
    return rows.where(F.col(at) >= F.lit(cursor).cast("timestamp") - F.expr(f"interval {overlap_s} seconds"))


def apply_changes(index: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """Index rows after a reconcile pass: fresh rows replace equal ids, removed ids leave."""
    kept = index.join(fresh.select("id"), "id", "left_anti").unionByName(fresh.dropDuplicates(["id"]))
    return kept.join(gone.select("id").distinct(), "id", "left_anti")


def maintain(stream: DataFrame, encode: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Write-through index: every micro-batch is encoded and appended under its batch number, so
    that a replayed batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        encode(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lookback(turns: DataFrame, minutes: int = 30) -> DataFrame:
    """For every turn the number of turns of its session in the minutes before it."""
    return recent_count(turns, "session_id", "created_at", minutes, "recent")


def sessions(stream: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Extension: session windows with counts."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed(stream: DataFrame, at: str, by: str, size: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Extension: tumbling or sliding counts."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


PRIMED = "session_id string, turn long, topics array<string>"


def primed_topics_batch(turns: DataFrame, ttl: int = 5) -> DataFrame:
    """(session_id, turn, topics): topics primed within the last ``ttl`` turns, this turn's own
    included; ``turns(session_id, turn, topics)``."""
    w = Window.partitionBy("session_id").orderBy("turn").rangeBetween(-(ttl - 1), 0)
    return turns.select("session_id", "turn", F.sort_array(F.array_distinct(F.flatten(F.collect_list("topics").over(w)))).alias("topics"))


def primed_topics_stream(turns: DataFrame, ttl: int = 5) -> DataFrame:
    """The same as a stream with a topic's remaining turns as state; re-priming overwrites."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values("turn")
        out = []
        for turn, topics in zip(rows["turn"], rows["topics"]):
            left = {t: n - 1 for t, n in left.items() if n > 1}
            left |= {t: ttl for t in (topics if topics is not None else [])}
            out.append((key[0], turn, sorted(left)))
        state.update((list(left), list(left.values())))
        yield pd.DataFrame(out, columns=["session_id", "turn", "topics"])

    return turns.groupBy("session_id").applyInPandasWithState(step, PRIMED, "topics array<string>, turns array<long>", "append", GroupStateTimeout.NoTimeout)
