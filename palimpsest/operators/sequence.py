"""Order-dependent measures on keys of any size.

A key (a session, a source) may hold a third of all rows, so no window runs over a whole key:
rows are cut into buckets that follow the order, windows run within (key, bucket), and a small
table of one row a bucket carries what crosses the borders.  The bucket column must be
non-decreasing along the order; its null values come last and form one bucket.

Results equal those of a plain window over the key (the tests compare them).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
_LAST = 2**62


def day_bucket(time: str, days: int = 7) -> Column:
    """Bucket of a timestamp column: its week (or ``days``)."""
    return F.floor(F.unix_micros(time) / (DAY_US * days))


def _bucketed(rows: DataFrame, bucket: Column) -> DataFrame:
    return rows.withColumn("_b", F.coalesce(bucket.cast("long"), F.lit(_LAST)))


def _with_borders(rows: DataFrame, borders: DataFrame, key: str) -> DataFrame:
    """Joins the one-row-a-bucket table; keys may be null."""
    small = borders.withColumnsRenamed({key: "_k", "_b": "_b2"})
    return rows.join(small, rows[key].eqNullSafe(small["_k"]) & (rows["_b"] == small["_b2"]), "left").drop("_k", "_b2")


def running_sum(rows: DataFrame, key: str, bucket: Column, order: Sequence[Column | str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` from the key's first row up to this one."""
    b = _bucketed(rows, bucket).withColumn("_v", value)
    sums = b.groupBy(key, "_b").agg(F.sum("_v").alias("_s"))
    ahead = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    borders = sums.select(key, "_b", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _with_borders(b.withColumn("_in", F.sum("_v").over(inner)), borders, key).withColumn(name, F.col("_before") + F.col("_in")).drop("_b", "_v", "_in", "_before")


def numbered(rows: DataFrame, key: str, bucket: Column, order: Sequence[Column | str], name: str) -> DataFrame:
    """Adds the row's number within its key, from 1."""
    b = _bucketed(rows, bucket)
    counts = b.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    borders = counts.select(key, "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order))
    return _with_borders(b.withColumn("_in", inner), borders, key).withColumn(name, F.col("_before") + F.col("_in")).drop("_b", "_in", "_before")


def _beside(rows: DataFrame, key: str, bucket: Column, order: Sequence[str], n: int, fields: Sequence[str], name: str, later: bool) -> DataFrame:
    b = _bucketed(rows, bucket).withColumn("_f", F.struct(*fields))
    w = Window.partitionBy(key, "_b").orderBy(*order)
    near = F.collect_list("_f").over(w.rowsBetween(1, n) if later else w.rowsBetween(-n, -1))
    # of each bucket the n rows at the border that others look across, in order
    place = F.row_number().over(w) if later else F.row_number().over(Window.partitionBy(key, "_b").orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    edge = b.withColumn("_p", place).where(F.col("_p") <= n).groupBy(key, "_b").agg(F.array_sort(F.collect_list(F.struct((F.col("_p") if later else -F.col("_p")).alias("p"), F.col("_f").alias("f")))).alias("_e"))
    edge = edge.select(key, "_b", F.transform("_e", lambda x: x["f"]).alias("_e"))
    over = Window.partitionBy(key).orderBy("_b")
    joined = F.flatten(F.collect_list("_e").over(over.rowsBetween(1, n) if later else over.rowsBetween(-n, -1)))
    borders = edge.select(key, "_b", joined.alias("_x"))
    out = _with_borders(b.withColumn("_near", near), borders, key)
    empty = F.slice("_near", 1, 0)
    across = F.coalesce("_x", empty)
    found = F.slice(F.concat("_near", across), 1, n) if later else F.concat(across, F.col("_near"))
    if not later:
        found = F.slice(found, F.greatest(F.lit(1), F.size(found) - n + 1), n)
    return out.withColumn(name, found).drop("_b", "_f", "_near", "_x")


def following(rows: DataFrame, key: str, bucket: Column, order: Sequence[str], n: int, fields: Sequence[str], name: str) -> DataFrame:
    """Adds the fields of the next ``n`` rows of the key, nearest first."""
    return _beside(rows, key, bucket, order, n, fields, name, True)


def preceding(rows: DataFrame, key: str, bucket: Column, order: Sequence[str], n: int, fields: Sequence[str], name: str) -> DataFrame:
    """Adds the fields of the previous ``n`` rows of the key, nearest last."""
    return _beside(rows, key, bucket, order, n, fields, name, False)


def recent_count(rows: DataFrame, key: str, time: str, minutes: int, name: str, segment_days: int = 1) -> DataFrame:
    """Adds the number of the key's rows in the ``minutes`` before this one (equal times out).

    Rows near the end of a segment also go to the next one as context.
    """
    us, span, reach = F.unix_micros(time), segment_days * DAY_US, minutes * 60_000_000
    if reach > span:
        raise ValueError("the look-back is longer than a segment")
    b = rows.withColumn("_us", us).withColumn("_home", F.floor(F.col("_us") / span))
    near_end = F.pmod(F.col("_us"), F.lit(span)) >= span - reach
    b = b.withColumn("_b", F.explode(F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    frame = Window.partitionBy(key, "_b").orderBy("_us").rangeBetween(-reach, -1)
    return b.withColumn(name, F.count(F.lit(1)).over(frame)).where("_b = _home").drop("_us", "_home", "_b")
