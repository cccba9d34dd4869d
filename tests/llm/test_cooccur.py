import itertools
import random
from collections import Counter

from palimpsest.llm import cooccur, queries


def test_parse():
    assert cooccur.parse_items('["A ", "a", "", 3, null, {"x": 1}, "b"]') == ["a", "b"]
    for bad in (None, "", "x", '{"a": ["b"]}', '["a", "b"', "3", '"a"', "[" * 100_000):
        assert cooccur.parse_items(bad) == []


def brute(baskets, part):
    n = len(baskets)
    one = Counter(x for b in baskets for x in b)
    two = Counter(p for b in baskets for p in itertools.combinations(sorted(b), 2))
    return {p: (c, one[p[0]], one[p[1]]) for p, c in two.items() if c >= part * n - 1e-9}


def test_counts_with_huge_and_hot_baskets(spark):
    r = random.Random(2)
    baskets = [set(r.sample([f"i{k}" for k in range(40)], r.randrange(1, 6))) | ({"hot"} if k % 3 == 0 else set()) for k in range(200)]
    baskets.append({f"i{k}" for k in range(40)} | {f"z{k}" for k in range(300)})
    rows = [(str(k), sorted(b)) for k, b in enumerate(baskets)]
    df = spark.createDataFrame(rows, "basket string, items array<string>")
    for block in (7, 64):
        got = {(x["item_a"], x["item_b"]): (x["together"], x["n_a"], x["n_b"]) for x in cooccur.associations(df, 0.01, block).collect()}
        assert got == brute(baskets, 0.01)
    assert max(len(r["items"]) for r in cooccur.chunks(df, 16).collect()) == 16
    whole = {(x["item_a"], x["item_b"]): x["together"] for x in cooccur.pair_counts(cooccur.chunks(df, 16)).collect()}
    assert whole == {p: c for p, (c, _, _) in brute(baskets, 0).items()}


def test_rows_repeated_null_and_empty(spark):
    rows = [("1", '["a","b"]'), ("1", '["a","b"]'), ("2", '["A","c"]'), (None, '["a","b"]'), ("3", None), ("4", "[]")]
    b = cooccur.baskets_from_json(spark.createDataFrame(rows, "id string, j string"), "id", "j")
    got = {(x["item_a"], x["item_b"]): (x["together"], x["n"]) for x in cooccur.associations(b, 0.1).collect()}
    assert got == {("a", "b"): (1, 2), ("a", "c"): (1, 2)}
    assert cooccur.associations(b.limit(0)).count() == 0


def test_rare_pairs_come_out(spark, tmp_path):
    rows = [(str(k), '["a", "b"]') for k in range(2000)] + [("x", '["rare", "seldom"]'), ("y", '["a", "rare"]')]
    spark.createDataFrame(rows, "id string, entities_json string").write.parquet(f"{tmp_path}/episodes.parquet")
    got = {(x["entity_a"], x["entity_b"]): (x["together"], x["n_a"], x["n_b"]) for x in queries.p6_associations(spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): (2000, 2001, 2000), ("rare", "seldom"): (1, 2, 1), ("a", "rare"): (1, 2001, 2)}
