import random

from palimpsest.functions.words import words
from palimpsest.llm import leak

ITEMS = "item_id long, question string, passage string"
DOCS = "doc_id long, text string, shingle long, df long, item_id long"


def brute(docs, items):
    grams = {}
    for i, *texts in items:
        for t in texts:
            w = words(t)
            for a in range(len(w) - 9):
                grams.setdefault(tuple(w[a : a + 10]), set()).add(i)
    out = set()
    for d, t, *_ in docs:
        w = words(t)
        for a in range(len(w) - 9):
            out |= {(d, i) for i in grams.get(tuple(w[a : a + 10]), ())}
    return out


def corpus():
    r = random.Random(9)
    text = lambda n: " ".join(f"w{r.randrange(60)}" for _ in range(n))
    items = [(k, text(14), text(50)) for k in range(20)] + [(20, "too short", None), (21, text(12), ""), (22, "Same Same", "x " * 30)]
    shared = text(15)
    items += [(30, shared, None), (31, shared.upper(), None)]
    docs = []
    for d in range(150):
        w = text(r.randrange(1, 90)).split()
        if d % 3 == 0:
            p = words(items[0][2])
            w[3:3] = p[5:17]
        if d % 7 == 0:
            p = words(r.choice(items[:20])[r.choice((1, 2))])
            n = r.choice((9, 10, 11))
            w += p[:n]
        docs.append((d, "-- ".join(w), 0, 0, 0))
    docs += [(900, None, 0, 0, 0), (901, "", 0, 0, 0), (902, "x, " * 400, 0, 0, 0), (903, shared.replace(" ", "\n"), 0, 0, 0), (904, " ".join(["a"] * 50_000) + " " + shared, 0, 0, 0)]
    return docs, items


def test_same_as_brute_force_on_both_paths(spark):
    docs, items = corpus()
    want = brute(docs, items)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for bound in (1_000_000, 0):
        got = leak.leaks(d, i, broadcast_shingles=bound)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    assert (903, 30) in want and (903, 31) in want


def test_part_of_windows(spark):
    t = " ".join(f"q{k}" for k in range(19))
    got = leak.leaks(spark.createDataFrame([(1, "so " + " ".join(t.split()[:14]), 0, 0, 0)], DOCS), spark.createDataFrame([(5, t, None)], ITEMS)).collect()
    assert [(r["field"], r["windows"], r["part"]) for r in got] == [("question", 5, 0.5)]


def test_empty(spark):
    d, i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert leak.leaks(d, i).count() == 0
    docs, items = corpus()
    assert leak.leaks(d, spark.createDataFrame(items, ITEMS)).count() == 0
    assert leak.leaks(spark.createDataFrame(docs, DOCS), i).count() == 0
