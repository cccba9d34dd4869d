"""Bucketed order measures against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from palimpsest.operators import sequence as S


@pytest.fixture(scope="module")
def turns(spark):
    r = random.Random(8)
    data = [(f"{i:04d}", r.choice(("hot", "hot", "b", "c", None)), f"2024-0{r.randrange(1, 6)}-{r.randrange(1, 28):02d} {r.randrange(24):02d}:{r.choice((0, 10, 10)):02d}:00", r.randrange(9)) for i in range(300)]
    return spark.createDataFrame(data, "id string, k string, t string, v int").withColumn("at", F.col("t").cast("timestamp")).cache()


def plain():
    return Window.partitionBy("k").orderBy("at", "id")


BUCKET = S.day_bucket


def test_numbered_and_sum(turns):
    n = S.numbered(turns, "k", BUCKET("at"), ["at", "id"], "n").select("id", "n")
    assert rows(n) == rows(turns.select("id", F.row_number().over(plain()).alias("n")))
    s = S.running_sum(turns, "k", BUCKET("at"), ["at", "id"], F.col("v"), "s").select("id", "s")
    assert rows(s) == rows(turns.select("id", F.sum("v").over(plain().rowsBetween(Window.unboundedPreceding, 0)).alias("s")))
    d = S.numbered(turns, "k", -BUCKET("at"), [F.col("at").desc(), F.col("id")], "n").select("id", "n")
    assert rows(d) == rows(turns.select("id", F.row_number().over(Window.partitionBy("k").orderBy(F.col("at").desc(), "id")).alias("n")))


@pytest.mark.parametrize("n", [1, 3, 7])
def test_beside(turns, n):
    ids = lambda c: F.transform(c, lambda x: x["id"])
    got = S.following(turns, "k", BUCKET("at"), ["at", "id"], n, ["id"], "x").select("id", ids("x").alias("x"))
    assert rows(got) == rows(turns.select("id", F.collect_list("id").over(plain().rowsBetween(1, n)).alias("x")))
    got = S.preceding(turns, "k", BUCKET("at"), ["at", "id"], n, ["id"], "x").select("id", ids("x").alias("x"))
    assert rows(got) == rows(turns.select("id", F.collect_list("id").over(plain().rowsBetween(-n, -1)).alias("x")))


def test_recent_count(turns):
    frame = Window.partitionBy("k").orderBy(F.unix_micros("at")).rangeBetween(-1_800_000_000, -1)
    assert rows(S.recent_count(turns, "k", "at", 30, "n").select("id", "n")) == rows(turns.select("id", F.count(F.lit(1)).over(frame).alias("n")))
    with pytest.raises(ValueError):
        S.recent_count(turns, "k", "at", 2000, "n")


def test_empty(turns):
    none = turns.limit(0)
    assert S.numbered(none, "k", BUCKET("at"), ["at"], "n").count() == 0 == S.following(none, "k", BUCKET("at"), ["at"], 2, ["id"], "x").count()
