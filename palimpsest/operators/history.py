"""Histories of changing attributes: type-two dimension merge (problem 3).

* ``merge_versions`` - one merge step: a batch of changes against the current open versions.
  Attribute hashes are compared; a changed key's open version is closed at the change's time
  and a new open version inserted; unchanged keys keep their version.
* ``linked_records`` - finds which records are versions of one fact from incomplete replacement
  links (connected components by min-label propagation with pointer jumping).
* ``linked_histories`` - the merged history of those; ``version_pairs`` - its neighbours.

Unusual cases: null keys or times give no version; repeated rows count once; equal times are
ordered by the tie column; consecutive changes with equal attributes extend the open version;
an empty log gives an empty history with the same columns.

Scale and skew: a history may hold a third of all rows.  ``neighbours`` cuts every history into
time segments and looks across segment borders through the segments' first and last rows only,
so no task holds a whole history.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.words import words
from palimpsest.operators.skew import hot_keys, lookup
from palimpsest.runtime import Scratch

SEGMENT_S = 30 * 86_400


def attribute_hash(columns: Sequence[str]) -> Column:
    """Null-safe hash of the tracked attributes (a null differs from an empty string)."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def neighbours(rows: DataFrame, key: str, order: Sequence[str], time_us: str, carry: Sequence[str], segment_s: int = SEGMENT_S) -> DataFrame:
    """Every row with the fields ``carry`` of the next row of its key, as ``next_<field>``.

    ``order`` starts with ``time_us`` (long, microseconds).  Two levels of windows: rows within
    (key, time segment), then the segments' first rows within the key.
    """
    seg = F.floor(F.col(time_us) / (segment_s * 1_000_000))
    inner = Window.partitionBy(key, "_seg").orderBy(*order)
    rows = rows.withColumn("_seg", seg).withColumn("_next", F.lead(F.struct(*carry)).over(inner)).withColumn("_first", F.lag(F.lit(1)).over(inner).isNull())
    firsts = rows.where("_first").select(key, "_seg", F.struct(*carry).alias("_head"))
    outer = Window.partitionBy(key).orderBy("_seg")
    heads = firsts.select(key, "_seg", F.lead("_head").over(outer).alias("_after")).where("_after is not null")
    out = rows.join(heads, [key, "_seg"], "left")
    found = F.coalesce("_next", "_after")
    return out.select(*[c for c in rows.columns if not c.startswith("_")], *[found[c].alias(f"next_{c}") for c in carry])


def merge_versions(dimension: DataFrame | None, changes: DataFrame, key: str, time: str, tie: str, attributes: Sequence[str], segment_s: int = SEGMENT_S) -> DataFrame:
    """One type-two merge: ``dimension`` (key, tie, attributes.., valid_from, valid_to, is_current;
    ``None`` for an empty one) and a batch of changes -> the new dimension.

    The attribute hash of every change is compared with that of the version before it: the key's
    open version for the first change of the batch, the change before it for the others.  An
    equal one extends that version; a different one closes it at its own time and opens a new
    version.  Closed versions pass untouched (no shuffle), only open ones meet the batch.  A
    change earlier than its key's open version is left out: batches come in order of time.
    """
    columns = [key, tie, *[c for c in attributes if c not in (key, tie)], "valid_from", "valid_to", "is_current"]
    fresh = changes.where(F.col(key).isNotNull() & F.col(time).isNotNull()).dropDuplicates([key, time, tie])
    fresh = fresh.withColumn("valid_from", F.col(time)).select(*columns[:-2], F.lit(False).alias("_held"))
    steps = fresh
    if dimension is not None:
        held = dimension.where("is_current").select(*columns[:-2], F.lit(True).alias("_held"))
        since = held.select(key, F.struct("valid_from", tie).alias("_since"))
        steps = fresh.join(since, key, "left").where(F.col("_since").isNull() | (F.struct("valid_from", tie) > F.col("_since"))).drop("_since").unionByName(held)
    steps = steps.withColumn("_us", F.unix_micros("valid_from")).withColumn("_hash", attribute_hash(attributes))
    slim = steps.select(key, tie, "valid_from", F.col("_us").alias("us"), F.col("_hash").alias("hash"))
    # a row opens a version when the row before it differs: look at the pair from its later end
    marked = neighbours(slim, key, ["us", tie], "us", ["us", tie, "hash"], segment_s)
    same = marked.where(F.col("next_hash") == F.col("hash")).select(key, F.col("next_us").alias("us"), F.col(f"next_{tie}").alias(tie))
    opened = slim.join(same, [key, "us", tie], "left_anti")
    ends = neighbours(opened, key, ["us", tie], "us", ["valid_from"], segment_s).select(key, tie, "us", F.col("next_valid_from").alias("valid_to"))
    out = steps.withColumn("us", F.col("_us")).join(ends, [key, "us", tie]).withColumn("is_current", F.col("valid_to").isNull()).select(*columns)
    return out if dimension is None else dimension.where("not is_current").select(*columns).unionByName(out)


def build_history(changes: DataFrame, key: str, time: str, tie: str, attributes: Sequence[str]) -> DataFrame:
    """(key, tie, attributes.., valid_from, valid_to, is_current) of a whole log of changes."""
    return merge_versions(None, changes, key, time, tie, attributes)


def topic_words(rows: DataFrame, key: str, topic: str) -> DataFrame:
    """(key, topic_key): the topic's words in order, joined by spaces."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array([None if t is None else " ".join(words(t)) for t in batch.column("t").to_pylist()], pa.string())], names=[key, "topic_key"]
            )

    return rows.select(key, F.col(topic).alias("t")).mapInArrow(run, f"{key} string, topic_key string")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): root is the smallest node of the node's component.

    ``edges(a, b)``.  Each round every node takes the least label among its own and its
    neighbours' (partially aggregated, so hubs do not gather), then jumps to its label's label.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = held = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    hubs = hot_keys(both, "b", scratch)
    while True:
        near = lookup(both, labels.select(F.col("node").alias("b"), "root"), "b", scratch, hot=hubs).groupBy("a").agg(F.min("root").alias("least"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "least").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("root").alias("jump"))
        # in a large component most nodes carry one label
        step = lookup(scratch.keep(step, "lower"), up, "low", scratch).select("node", F.col("root").alias("was"), F.least("low", "jump").alias("root"))
        new = scratch.keep(step, "round")
        moved = not new.where("was <> root").isEmpty()
        scratch.drop(held)
        held, labels = new, new.select("node", "root")
        if not moved:
            return labels


def latest_records(rows: DataFrame) -> DataFrame:
    """Of the rows of one id the one with the latest updated_at (a null is the earliest)."""
    least = [c for c in ("created_at", "topic", "supersedes", "superseded_by") if c in rows.columns]
    rest = [c for c in rows.columns if c != "id"]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(F.unix_micros("updated_at"), F.lit(-(2**62))), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in least]))
    return rows.where("id is not null").groupBy("id").agg(best.alias("r")).select("id", *[F.col(f"r.{c}") for c in rest])


#: what a version of a semantic record holds
ATTRIBUTES = ("topic", "content", "confidence", "project_id")


def linked_records(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows(id, topic, supersedes, superseded_by, created_at, updated_at, ..)`` -> the latest row of
    each id with ``entity``, the least id of its history, and ``at``, its time.

    A link Y replaces X holds if both records exist and differ, their topics have the same words
    in order, and X is not later than Y.  Records without a link that holds are histories of
    their own.  A record without any time is left out.
    """
    slim = scratch.keep(latest_records(rows).withColumn("us", F.coalesce(F.unix_micros("updated_at"), F.unix_micros("created_at"))), "records")
    links = slim.where("supersedes is not null").select(F.col("supersedes").alias("x"), F.col("id").alias("y"))
    links = links.union(slim.where("superseded_by is not null").select(F.col("id").alias("x"), F.col("superseded_by").alias("y"))).where("x <> y").distinct()
    topics = topic_words(slim, "id", "topic")
    facts = scratch.keep(slim.select("id", "us").join(topics, "id"), "facts")
    old = facts.select(F.col("id").alias("x"), F.col("us").alias("us_x"), F.col("topic_key").alias("topic_x"))
    new = facts.select(F.col("id").alias("y"), F.col("us").alias("us_y"), F.col("topic_key").alias("topic_y"))
    # a record may be named by a third of all others, on either side
    links = scratch.keep(links, "links")
    held = lookup(lookup(links, old, "x", scratch), new, "y", scratch, hot=hot_keys(links, "y", scratch)).where("topic_x = topic_y and us_x <= us_y")
    roots = components(held.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch)
    named = slim.drop("entity", "at").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("entity", F.coalesce("root", "id")).drop("root")
    return named.where("us is not null").withColumn("at", F.timestamp_micros("us")).drop("us")


def linked_histories(rows: DataFrame, attributes: Sequence[str] = ATTRIBUTES, every_record: bool = False, last_days: int = 30) -> DataFrame:
    """(entity, id, attributes.., valid_from, valid_to, is_current): the type-two history of linked
    records, merged in two steps, the records of the last ``last_days`` upon all before them.

    Records that follow one another with equal attributes are one version, named by the first;
    with ``every_record`` the record itself is a tracked attribute, so each is a version.
    """
    scratch = Scratch(rows.sparkSession, "history")
    tracked = [*(["id"] if every_record else []), *attributes]
    fields = dict.fromkeys(("id", "topic", "supersedes", "superseded_by", "created_at", "updated_at", *attributes))
    records = scratch.keep(linked_records(rows.select(*fields), scratch).select("entity", "id", "at", *attributes), "named")
    last = records.agg(F.date_sub(F.max("at"), last_days).cast("timestamp").alias("t")).first()["t"]
    before = records if last is None else records.where(F.col("at") < last)
    dimension = scratch.keep(merge_versions(None, before, "entity", "at", "id", tracked), "dimension")
    if last is None:
        return dimension
    return merge_versions(dimension, records.where(F.col("at") >= last), "entity", "at", "id", tracked)


def version_pairs(rows: DataFrame, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """(id, next_id): each record with the one that follows it in its history."""
    scratch = Scratch(rows.sparkSession, "history")
    versions = linked_histories(rows, attributes, every_record=True).select("entity", "id", F.unix_micros("valid_from").alias("us"))
    return neighbours(scratch.keep(versions, "versions"), "entity", ["us", "id"], "us", ["id"]).where("next_id is not null").select("id", "next_id")
