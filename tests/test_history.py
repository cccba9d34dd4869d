
from pyspark.sql import functions as F

from conftest import rows
from palimpsest.operators import history

SEMANTIC = "id string, topic string, supersedes string, superseded_by string, c string, u string"


def records(spark, *rs):
    df = spark.createDataFrame(rs, SEMANTIC)
    return df.withColumn("created_at", F.col("c").cast("timestamp")).withColumn("updated_at", F.col("u").cast("timestamp")).withColumn("us", F.lit("clash"))


def links(spark, *rs):
    return [tuple(r) for r in history.version_pairs(records(spark, *rs), ["topic"]).orderBy("id").collect()]


def test_links_from_either_side(spark):
    got = links(
        spark,
        ("a", "Time zone", None, "b", "2024-01-01", None), ("b", "time-ZONE", None, None, "2024-01-02", None), ("c", "time zone", "b", None, "2024-01-03", None),
        ("d", "other", "c", None, "2024-01-04", None), ("e", "time zone", "missing", "e", "2024-01-05", None), ("f", "time zone", None, "a", "2024-01-09", None), (None, "x", "a", None, None, None),
    )
    assert got == [("a", "b"), ("b", "c")]


def test_latest_export_counts_and_ties(spark):
    got = links(
        spark,
        ("a", "t", None, None, "2024-01-01", "2024-01-01"), ("a", "t", None, "b", "2024-01-01", "2024-01-02"), ("a", "t", None, "b", "2024-01-01", "2024-01-02"),
        ("b", "t", None, None, "2024-01-02", "2024-01-02"), ("c", "t", "a", None, "2024-01-02", None),
    )
    assert got == [("a", "b"), ("b", "c")]


def test_empty_and_no_time(spark):
    assert links(spark) == []
    assert links(spark, ("a", "t", None, "b", None, None), ("b", "t", None, None, None, None)) == []


def test_long_chain_over_segments(spark):
    rs = [(f"{i:03d}", "t", f"{i - 1:03d}" if i else None, None, f"20{20 + i // 12}-{i % 12 + 1:02d}-01", None) for i in range(60)]
    assert links(spark, *rs) == [(f"{i:03d}", f"{i + 1:03d}") for i in range(59)]


LOG = [
    ("k1", "2024-01-01", "x"), ("k1", "2024-01-02", "x"), ("k1", "2024-01-03", "y"), ("k2", "2024-01-02", None), ("k2", "2024-01-04", "z"), ("k1", "2024-01-04", "x"),
    ("k3", "2024-01-02", "q"), ("k3", "2024-01-03", "q"), ("k3", "2024-01-03", "q"), (None, "2024-01-01", "q"), ("k4", None, "q"),
]
#: by hand: closed, reopened with its old value, unchanged over three deliveries, null to a value
VERSIONS = {
    ("k1", "x", "2024-01-01", "2024-01-03"), ("k1", "y", "2024-01-03", "2024-01-04"), ("k1", "x", "2024-01-04", None),
    ("k2", None, "2024-01-02", "2024-01-04"), ("k2", "z", "2024-01-04", None), ("k3", "q", "2024-01-02", None),
}


def log_of(spark, log):
    return spark.createDataFrame(log, "k string, t string, v string").withColumn("at", F.col("t").cast("timestamp")).withColumns({"n": F.col("t"), "us": F.lit(1), "hash": F.lit("clash")})


def versions(df):
    day = lambda t: None if t is None else str(t.date())
    got = [(r["k"], r["v"], day(r["valid_from"]), day(r["valid_to"])) for r in df.collect()]
    assert len(got) == len(set(got)) and all(r["is_current"] == (r["valid_to"] is None) for r in df.collect())
    return set(got)


def test_merge_in_batches_or_at_once(spark):
    df = log_of(spark, LOG)
    assert versions(history.build_history(df, "k", "at", "n", ["v"])) == VERSIONS
    for bounds in (("2024-01-02",), ("2024-01-02", "2024-01-03", "2024-01-04"), ("2024-01-04",)):
        dim, low = None, "2000"
        for high in (*bounds, "2999"):
            dim = history.merge_versions(dim, df.where((F.col("t") >= low) & (F.col("t") < high)), "k", "at", "n", ["v"], segment_s=86_400)
            dim = spark.createDataFrame(dim.collect(), dim.schema)
            low = high
        assert versions(dim) == VERSIONS


def test_late_changes_and_empty_batches(spark):
    dim = history.build_history(log_of(spark, LOG), "k", "at", "n", ["v"])
    late = log_of(spark, [("k1", "2024-01-02", "late")])
    assert versions(history.merge_versions(dim, late, "k", "at", "n", ["v"])) == VERSIONS
    none = log_of(spark, LOG).limit(0)
    assert versions(history.merge_versions(dim, none, "k", "at", "n", ["v"])) == VERSIONS
    assert versions(history.build_history(none, "k", "at", "n", ["v"])) == set()


def test_equal_records_are_one_version(spark):
    rs = [("a", "t", None, "b", "2024-01-01", None), ("b", "t", None, "c", "2024-02-01", None), ("c", "T", None, None, "2024-04-01", None)]
    got = {(r["entity"], r["id"], r["topic"], str(r["valid_from"].date()), r["is_current"]) for r in history.linked_histories(records(spark, *rs), ["topic"]).collect()}
    assert got == {("a", "a", "t", "2024-01-01", False), ("a", "c", "T", "2024-04-01", True)}


def test_smaller_id_first(spark, tmp_path):
    from palimpsest.plans import problem3

    records(spark, ("z", "t", None, "y", "2024-01-01", None), ("y", "t", None, None, "2024-01-02", None)).drop("us").withColumns({"content": F.lit("c"), "confidence": F.lit(1.0), "project_id": F.lit(None).cast("string")}).write.parquet(f"{tmp_path}/semantic.parquet")
    assert rows(problem3.p3_found(spark, str(tmp_path))) == [("y", "z")]


def test_hot_keys_are_met_by_broadcast(spark):
    from palimpsest.operators.skew import lookup
    from palimpsest.runtime import Scratch

    left = spark.range(200).selectExpr("if(id % 3 = 0, null, if(id < 100, 7, id)) as k", "id as n")
    right = spark.range(200).selectExpr("id as k", "id * 2 as v")
    assert rows(lookup(left, right, "k", Scratch(spark, "t"), hot_rows=10)) == rows(left.join(right, "k"))


def test_components_random(spark):
    import random

    rng = random.Random(3)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    from palimpsest.runtime import Scratch

    got = dict(rows(history.components(spark.createDataFrame(edges, "a string, b string"), Scratch(spark, "t"))))
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: root(n) for n in linked}
