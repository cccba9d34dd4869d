"""Problem 6 - items that appear together.

Method: large-basket blocking.  Baskets are cut into chunks of at most ``block`` items on their
array, first of all; every pair of chunks of a basket is one unit of work, so a huge basket is
spread over tasks while an ordinary basket is one unit; pair counts of all units are combined (partially aggregated before
the shuffle) and turned into association scores.

An item below the minimum support cannot be in a pair that reaches it, so such items leave
before any pair is formed; that loses nothing and bounds the pairs of the rest.  With a minimum
support of 0 every pair comes out.

Result for the unusual cases
* null id or null item list: no basket.  Text that is not a JSON array: no items; elements
  that are not strings, and empty ones after trimming: left out; repeats within a basket: once.
* baskets delivered twice (one id): counted once.  No baskets at all: empty output.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import Scratch


def parse_items(text: str | None) -> list[str]:
    """Distinct trimmed, lower-cased string elements of a JSON array."""
    if not text:
        return []
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return []
    if not isinstance(value, list):
        return []
    return list(dict.fromkeys(x for v in value if isinstance(v, str) and (x := v.strip().lower())))


def baskets_from_json(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(basket, items), one row an id with at least one item."""

    def run(batches):
        for batch in batches:
            items = [parse_items(t) for t in batch.column("t").to_pylist()]
            kept = [i for i, x in enumerate(items) if x]
            if kept:
                yield pa.RecordBatch.from_arrays([batch.column("basket").take(pa.array(kept)), pa.array([items[i] for i in kept], pa.list_(pa.string()))], names=["basket", "items"])

    source = rows.select(F.col(id_col).alias("basket"), F.col(json_col).alias("t")).where("basket is not null and t is not null")
    return source.mapInArrow(run, "basket string, items array<string>").dropDuplicates(["basket"])


def chunks(baskets: DataFrame, block: int = 64) -> DataFrame:
    """``baskets(basket, items)`` -> (basket, n_chunks, i, items): at most ``block`` items a row."""
    pieces = F.expr(f"transform(sequence(0, cast((size(items) - 1) / {block} as int)), i -> slice(items, i * {block} + 1, {block}))")
    cut = baskets.where(F.size("items") > 0).select("basket", pieces.alias("pieces"))
    return cut.select("basket", F.size("pieces").alias("n_chunks"), F.posexplode("pieces").alias("i", "items"))


def pair_counts(parts: DataFrame) -> DataFrame:
    """(item_a, item_b, together), item_a < item_b, over the rows of ``chunks``.

    A basket of one chunk is paired where it stands.  Of a larger one every chunk goes to the tasks
    of its chunk pairs, named (basket, i, j); no row and no task holds more than two chunks of it.
    """
    small = parts.where("n_chunks = 1").select(F.col("items").alias("one"), F.col("items").alias("other"), F.lit(True).alias("same"))
    others = F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("j")
    spread = parts.where("n_chunks > 1").select("basket", "i", others, "items")
    pair = spread.groupBy("basket", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"))
    large = pair.agg(F.min_by("items", "i").alias("one"), F.max_by("items", "i").alias("other"), F.count(F.lit(1)).alias("n"))
    # a chunk that lost all its items leaves its pairs with one side
    large = large.where("low = high or n = 2").select("one", "other", (F.col("low") == F.col("high")).alias("same"))
    pairs = small.unionByName(large).select(F.explode("one").alias("x"), "other", "same").select("x", F.explode("other").alias("y"), "same")
    pairs = pairs.where("x <> y and (not same or x < y)").select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))
    return pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("together"))


def associations(baskets: DataFrame, min_support: float = 0.001, block: int = 64, broadcast_items: int = 500_000) -> DataFrame:
    """(item_a, item_b, together, n_a, n_b, n, lift, pmi, jaccard) for pairs in at least
    ``min_support`` of the ``n`` baskets."""
    scratch = Scratch(baskets.sparkSession, "cooccur")
    kept = scratch.keep(baskets, "baskets")
    n = kept.count()
    single = kept.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    frequent = scratch.keep(single.where(F.col("n_item") >= F.lit(min_support) * n - 1e-9), "frequent")
    # at most (mean basket size) / min_support items; sent to all tasks only behind a check, so that
    # an item of a third of all baskets is not gathered in one task
    small = F.broadcast if frequent.count() <= broadcast_items else (lambda df: df)
    parts = chunks(kept, block)
    if min_support > 0:
        # rare items leave; what is left of a chunk, at most ``block`` items, comes together again
        single_items = parts.select("basket", "n_chunks", "i", F.explode("items").alias("item")).join(small(frequent.select("item")), "item")
        parts = single_items.groupBy("basket", "n_chunks", "i").agg(F.collect_list("item").alias("items"))
    pairs = pair_counts(parts).where(F.col("together") >= F.lit(min_support) * n - 1e-9)
    a = frequent.select(F.col("item").alias("item_a"), F.col("n_item").alias("n_a"))
    b = frequent.select(F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    scored = pairs.join(small(a), "item_a").join(small(b), "item_b").withColumn("n", F.lit(n))
    lift = F.col("together") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    jaccard = F.col("together") / (F.col("n_a") + F.col("n_b") - F.col("together"))
    return scored.withColumns({"lift": lift, "pmi": F.log2(lift), "jaccard": jaccard})
