import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.words import words
from palimpsest.llm import dedup

SCHEMA = "id string, ts long, content string"


def brute(rows, similarity=0.8, least=12):
    accepted, out = [], set()
    seen = {}
    for i, ts, text in rows:
        if i is not None and ts is not None and text is not None:
            seen[i] = min(seen.get(i, (ts, i, text)), (ts, i, text))
    for ts, i, text in sorted(seen.values()):
        bag = Counter(words(text))
        n = sum(bag.values())
        if n < least:
            continue
        for j, other, m in accepted:
            if sum((bag & other).values()) >= similarity * max(n, m) - 1e-9:
                out.add((j, i))
                break
        else:
            accepted.append((i, bag, n))
    return out


def corpus(seed=5, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(12, 70))) for _ in range(n)]
    rows = []
    for k, t in enumerate(texts):
        rows.append((f"a{k:03d}", r.randrange(50), t))
        w = t.split()
        for c in range(r.choice((0, 0, 1, 3))):
            v = list(w)
            for _ in range(max(1, len(v) // 12)):
                v[r.randrange(len(v))] = f"edit{r.randrange(9999)}"
            rows.append((f"b{k:03d}{c}", r.randrange(50, 99), "  ".join(v).upper()))
    return rows


@pytest.fixture(scope="module")
def rows():
    base = corpus()
    boiler = " ".join(f"boiler{k}" for k in range(12))
    base += [(f"h{k:03d}", 120 + k, boiler + " " + " ".join(f"u{k}x{j}" for j in range(14))) for k in range(60)]
    base += [(f"same{k:02d}", 200, boiler + " and nothing else at all") for k in range(40)]
    base += [base[0], base[1], (None, 1, base[0][2]), ("nul", None, base[0][2]), ("blank", 3, ""), ("none", 3, None), ("short", 1, "too few words")]
    base.append(("long", 500, " ".join(f"l{k}" for k in range(30_000))))
    base.append(("long2", 501, " ".join(f"l{k}" for k in range(30_000)) + " end"))
    return base


def found(df):
    return {(r["original_id"], r["copy_id"]) for r in df.collect()}


def test_same_as_brute_force(spark, rows):
    want = brute(rows)
    got = found(dedup.find_copies(spark.createDataFrame(rows, SCHEMA)))
    assert ("long", "long2") in got and ("same00", "same39") in got
    assert got == want


def test_common_chunks_give_no_candidates_and_lose_none(spark, rows):
    for hot in (1, 5):
        assert found(dedup.find_copies(spark.createDataFrame(rows, SCHEMA), dedup.ChunkParams(hot_chunk=hot))) == brute(rows)


def test_batches_equal_one_run(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    state = dedup.AcceptedTexts(spark, f"file://{tmp_path}/state", dedup.ChunkParams(buckets=3))
    got = set()
    for low, high in ((0, 40), (40, 70), (70, 130), (130, 1000)):
        got |= found(state.process(df.where((F.col("ts") >= low) & (F.col("ts") < high))))
        if high == 70:
            for name in ("records", "postings", "prefixes"):
                state.compact(name)
    assert got == brute(rows)
    # nothing new and nothing at all
    assert found(state.process(df.limit(0))) == set()


def test_stored_rows_never_match_each_other_again(spark, tmp_path):
    text = " ".join(f"t{k}" for k in range(20))
    state = dedup.AcceptedTexts(spark, f"file://{tmp_path}/state")
    frame = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert found(state.process(frame(("a", 1, text), ("b", 2, text + " one")))) == {("a", "b")}
    assert found(state.process(frame(("c", 3, text), ("d", 4, text + " two"), ("e", 5, " ".join(f"x{k}" for k in range(20)))))) == {("a", "c"), ("a", "d")}
    assert found(state.process(frame(("f", 6, " ".join(f"x{k}" for k in range(20)))))) == {("e", "f")}


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(dedup.find_copies(empty)) == set()
    text = " ".join(f"t{k}" for k in range(20))
    df = spark.createDataFrame([("x", 1, text), ("y", 1, text)], SCHEMA).withColumns({c: F.lit(7) for c in ("a", "b", "k", "rid", "old", "h")})
    assert found(dedup.find_copies(df)) == {("x", "y")}


def test_sentences_in_another_order(spark):
    r = random.Random(11)
    rows, want = [], set()
    for k in range(40):
        parts = [" ".join(f"v{r.randrange(4000)}" for _ in range(14)) for _ in range(3)]
        edited = [p.split() for p in reversed(parts)]
        for p in edited:
            p[r.randrange(14)] = f"edit{r.randrange(9999)}"
        rows += [(f"a{k:02d}", k, ". ".join(parts)), (f"b{k:02d}", 100 + k, ". ".join(" ".join(p) for p in edited))]
        want.add((f"a{k:02d}", f"b{k:02d}"))
    assert found(dedup.find_copies(spark.createDataFrame(rows, SCHEMA))) == want == brute(rows)


def test_several_hundred_near_copies(spark):
    """Every chunk of the group is common, and edits leave few pairs of common neighbours."""
    r = random.Random(3)
    base = [f"g{k}" for k in range(40)]
    rows = []
    for k in range(300):
        w = list(base)
        for at in r.sample(range(40), r.randrange(0, 9)):
            w[at] = f"edit{r.randrange(10**6)}"
        rows.append((f"n{k:03d}", k, " ".join(w)))
    want = brute(rows)
    assert len(want) > 100
    for params in (dedup.ChunkParams(), dedup.ChunkParams(hot_token=64), dedup.ChunkParams(crowd=20), dedup.ChunkParams(crowd=20, hot_token=64)):
        assert found(dedup.find_copies(spark.createDataFrame(rows, SCHEMA), params)) == want


def test_scattered_edits_of_a_fifth(spark):
    r = random.Random(7)
    rows = []
    for k in range(150):
        w = [f"v{r.randrange(20_000)}" for _ in range(r.choice((12, 20, 30, 40, 60, 100, 250)))]
        v = list(w)
        for at in r.sample(range(len(w)), int(len(w) * r.uniform(0.15, 0.2))):
            v[at] = f"edit{r.randrange(10**6)}"
        rows += [(f"a{k:03d}", k, " ".join(w)), (f"b{k:03d}", 1000 + k, " ".join(v))]
    want = brute(rows)
    assert len(want) == 150
    assert found(dedup.find_copies(spark.createDataFrame(rows, SCHEMA))) == want


def test_crowds_in_batches(spark, tmp_path):
    """Near copies of three texts that are near each other, in batches, with and without crowds."""
    r = random.Random(8)
    base = [f"g{k}" for k in range(30)]
    kin = [base, base[:26] + ["p", "q", "r", "s"], base[:22] + [f"z{k}" for k in range(8)]]
    rows = []
    for k in range(240):
        w = list(r.choice(kin))
        for at in r.sample(range(30), r.randrange(0, 5)):
            w[at] = f"edit{r.randrange(10**6)}"
        rows.append((f"n{r.randrange(10**6):06d}", k // 3, " ".join(w)))
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(dedup.find_copies(df, dedup.ChunkParams(crowd=10))) == want
    state = dedup.AcceptedTexts(spark, f"file://{tmp_path}/state", dedup.ChunkParams(crowd=10, hot_token=40, buckets=4))
    got = set()
    for out in dedup.feed(state, df, [30, 60]):
        got |= found(out)
    assert got == want
