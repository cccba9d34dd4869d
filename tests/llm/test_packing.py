import numpy as np
import pytest

from palimpsest.llm import packing


def waste(lengths, window, capacity):
    used = np.bincount(window, weights=lengths)
    assert (used <= capacity).all() and (window >= 0).all()
    return 1 - lengths.sum() / (len(used) * capacity)


@pytest.mark.parametrize("seed", range(4))
def test_pack_fills_windows(seed):
    r = np.random.default_rng(seed)
    lengths = np.clip(r.lognormal(5.5, 0.9, 4000).astype(int), 1, 2048)
    window = packing.pack(lengths, 2048)
    assert waste(lengths, window, 2048) < 0.01


def test_pack_large_items_only():
    r = np.random.default_rng(1)
    lengths = r.integers(500, 1100, 1000)
    window = packing.pack(lengths, 2048)
    first_fit: list[int] = []
    for n in sorted(lengths.tolist(), reverse=True):
        for k, room in enumerate(first_fit):
            if room >= n:
                first_fit[k] -= n
                break
        else:
            first_fit.append(2048 - n)
    waste(lengths, window, 2048)
    assert window.max() + 1 <= 1.05 * len(first_fit)


def test_cover_is_optimal_on_a_known_case():
    sizes = np.array([400, 600])
    columns = packing.configurations(sizes, 1000)
    assert packing.cover(columns, np.array([10.0, 10.0])).sum() == pytest.approx(10)


@pytest.mark.parametrize("lengths, capacity", [([], 10), ([10], 10), ([1] * 25, 10), ([10, 10, 5, 5], 10), ([3, 3, 3, 3, 3], 10)])
def test_edges(lengths, capacity):
    window = packing.pack(np.array(lengths, dtype=int), capacity)
    if lengths:
        waste(np.array(lengths), window, capacity)


def test_documents_whole_and_cut(spark):
    texts = [(1, "word " * 5000), (2, None), (3, ""), (4, "short text"), (4, "short text"), (5, "word " * 3)]
    counts = packing.token_counts(spark.createDataFrame(texts, "doc_id long, text string"))
    n = {r["doc_id"]: r["n_tokens"] for r in counts.collect()}
    assert set(n) == {1, 4, 5}
    got = packing.pack_documents(counts, 512, shard_docs=2).collect()
    by = {}
    for r in got:
        by[r["window"]] = by.get(r["window"], 0) + r["tokens"]
    assert max(by.values()) <= 512
    assert sum(r["tokens"] for r in got if r["doc_id"] == 1) == n[1] and {r["pieces"] for r in got if r["doc_id"] == 1} == {-(-n[1] // 512)}
    assert {r["pieces"] for r in got if r["doc_id"] != 1} == {1}
    with pytest.raises(ValueError):
        packing.pack_documents(counts, 0)
    assert packing.pack_documents(counts.limit(0), 512).count() == 0


def test_all_documents_are_packed_once(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    counts = packing.token_counts(docs)
    got = packing.pack_documents(counts, 2048)
    total = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "n").collect()}
    assert total == {r["doc_id"]: r["n_tokens"] for r in counts.collect()}


def first_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        for k, room in enumerate(rooms):
            if room >= n:
                rooms[k] -= n
                break
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_fill_of_every_capacity(spark, data):
    """The lengths of the documents: no more windows than first-fit of the sorted pieces needs, and one."""
    counts = packing.token_counts(spark.read.parquet(f"{data}/documents.parquet"))
    rows = packing.fill_rates(counts, {"small": 512, "standard": 2048, "large": 8192}).collect()
    n = [r["n_tokens"] for r in counts.collect()]
    for r in rows:
        c = r["capacity"]
        pieces = [c] * sum(x // c for x in n) + [x % c for x in n if x % c]
        assert r["tokens"] == sum(n) and r["documents"] == len(n)
        assert -(-sum(n) // c) <= r["windows"] <= first_fit_decreasing(pieces, c) + 1
    assert packing.fill_rates(counts.limit(0), {"small": 512}).first()["windows"] == 0
