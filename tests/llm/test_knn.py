import numpy as np

from palimpsest.llm import knn


def vectors(seed=0, noise=1500, groups=60):
    r = np.random.default_rng(seed)
    x = list(r.normal(size=(noise, 32)))
    for _ in range(groups):
        c = r.normal(size=32)
        for _ in range(r.integers(2, 9)):
            x.append(c + r.normal(size=32) * np.linalg.norm(c) / np.sqrt(32) * r.uniform(0.02, 0.2))
    return np.array(x, dtype=np.float32) * r.uniform(0.5, 3, size=(len(x), 1)).astype(np.float32)


def brute(ids, x, k=5, least=0.95):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    out = {}
    for i in range(len(ids)):
        near = [j for j in np.flatnonzero(s[i] >= least) if j != i]
        out[ids[i]] = [ids[j] for j in sorted(near, key=lambda j: (-round(s[i, j], 10), ids[j]))[:k]]
    return out


def frame(spark, ids, x, extra=()):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)] + list(extra), "id string, embedding array<float>")


def test_recall_against_brute_force(spark):
    x = vectors()
    ids = [f"{k:05d}" for k in range(len(x))]
    bad = [("n", None), ("s", [1.0]), ("z", [0.0] * 32), ("nan", [float("nan")] * 32), ("inf", [float("inf")] * 32), (None, [1.0] * 32)]
    got: dict[str, list] = {}
    for r in knn.neighbours(frame(spark, ids, x, bad)).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    want = {i: n for i, n in brute(ids, x).items() if n}
    pairs = lambda d: {(i, n) for i, ns in d.items() for n in ns}
    assert len(pairs(got) & pairs(want)) >= 0.98 * len(pairs(want))
    assert len(pairs(got) - pairs(want)) <= 0.02 * len(pairs(want))


def test_equal_vectors_and_ties(spark):
    x = vectors(3, 20, 0)
    ids = [f"{k:02d}" for k in range(20)]
    same = [(f"c{k}", [float(v) for v in x[0]]) for k in range(9)]
    got = {}
    for r in knn.neighbours(frame(spark, ids, x, same)).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got["c8"] == ["00", "c0", "c1", "c2", "c3"] and got["00"] == ["c0", "c1", "c2", "c3", "c4"]
    assert all(len(v) == 5 for v in got.values()) and len(got) == 10


def test_hot_cells_split(spark):
    r = np.random.default_rng(4)
    c = r.normal(size=32)
    x = (c + r.normal(size=(300, 32)) * 0.05).astype(np.float32)
    ids = [f"{k:03d}" for k in range(300)]
    want = brute(ids, x)
    got = {}
    for row in knn.neighbours(frame(spark, ids, x), knn.KnnParams(hot_cell=64)).collect():
        got.setdefault(row["id"], set()).add(row["neighbour"])
    hit = sum(len(got[i] & set(want[i])) for i in ids)
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_empty(spark):
    assert knn.neighbours(spark.createDataFrame([], "id string, embedding array<float>")).count() == 0


def searched(df):
    got: dict[str, list] = {}
    for r in df.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    return got


def test_search_recall_however_far(spark):
    """Random vectors and groups: every query gets k, at least 0.9 of them the nearest."""
    x = vectors(5, 1200, 40)
    ids = [f"{k:05d}" for k in range(len(x))]
    df = frame(spark, ids, x, [("n", None), ("z", [0.0] * 32)])
    asked = spark.createDataFrame([(i,) for i in [*ids[::3], "n", "z", "nobody", ids[0]]], "id string")
    want = brute(ids, x, least=-1)
    for params in (knn.KnnParams(), knn.KnnParams(shard=300, query_block=100)):
        got = searched(knn.search(asked, df, params))
        assert set(got) == set(ids[::3]) and all(len(n) == 5 for n in got.values())
        assert sum(len(set(got[i]) & set(want[i])) for i in got) >= 0.97 * 5 * len(got)


def test_search_equal_vectors(spark):
    x = vectors(3, 20, 0)
    ids = [f"{k:02d}" for k in range(20)]
    same = [(f"c{k}", [float(v) for v in x[0]]) for k in range(9)]
    df = frame(spark, ids, x, same)
    got = searched(knn.search(df.select("id").where("id in ('c8', '00', '05')"), df))
    assert got["c8"] == ["00", "c0", "c1", "c2", "c3"] and got["00"] == ["c0", "c1", "c2", "c3", "c4"] and len(got["05"]) == 5
    assert knn.search(df.select("id"), df.limit(0)).count() == 0


def test_search_recall_on_the_tables(spark, data):
    from palimpsest.llm import queries

    rows = [(r["id"], r["embedding"]) for r in queries._vectors(spark, data).collect()]
    good = [(i, v) for i, v in rows if v and len(v) == 32 and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    ids, x = [i for i, _ in good], np.array([v for _, v in good], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    place = {i: k for k, i in enumerate(ids)}
    asked = {i for i in ids if int(i.replace("-", ""), 16) % 50 == 0}
    got: dict[str, list] = {}
    for r in queries.p5_neighbours(spark, data).collect():
        got.setdefault(r["id"], []).append(r["cosine"])
    assert set(got) == asked and asked
    hit = 0
    for i in asked:
        c = np.sort(np.delete(x @ x[place[i]], place[i]))[::-1][:5]
        hit += sum(a >= c[-1] - 1e-5 for a in got[i])
    assert hit >= 0.9 * 5 * len(asked)
