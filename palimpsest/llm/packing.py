"""Problem 7 - filling context windows with documents.

Method: linear grouping scheme.  Lengths above a fifth of the capacity are sorted and cut into
groups of equal cardinality; every length is rounded up to the largest of its group; with few
sizes and at most four of them in a window, all configurations are listed and the covering
linear programme over them is solved; its whole part is laid out, the rest by first-fit; then
actual documents take the places, each the longest that still fits, and the small documents go
best-fit into what is left; windows that stay loose are filled once more.

A document is cut only if it is longer than the window: into full windows and one remainder.

Result for the unusual cases
* null or empty text: no tokens, in no window.  Repeated documents are packed each by its id.
* a capacity below 1 is an error.  No documents: no windows.

Scale and skew: tokens are counted in one pass; only (id, length) pairs are shuffled, to shards of
about ``shard_docs`` documents by hash of the id, each packed by itself (a shard wastes less than
one window beyond the scheme's bound).  No shard grows with the corpus.
"""

from __future__ import annotations

import base64
import importlib.util
import itertools
from bisect import bisect_left, bisect_right, insort
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import Scratch

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
GROUPS = 16
LARGE = 5  # a large length is more than capacity / LARGE


@cache
def tokenizer(file: str, pattern: str):
    """A public byte-level vocabulary, loaded once a worker."""
    import tiktoken
    from pyspark import SparkFiles

    with open(SparkFiles.get(file), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of the whole texts.  The vocabulary file travels with the job."""
    spec = importlib.util.spec_from_file_location("public_tokenizers_files", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    pattern = module.PATTERN
    documents.sparkSession.sparkContext.addFile(f"{folder}/{vocabulary}")

    def run(batches):
        encode = tokenizer(vocabulary, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    return source.mapInArrow(run, "doc_id long, n_tokens long").where("n_tokens > 0")


def configurations(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """All maximal-count vectors of at most LARGE - 1 sizes that fit into the capacity."""
    rows = []
    for n in range(1, LARGE):
        for combo in itertools.combinations_with_replacement(range(len(sizes)), n):
            if sizes[list(combo)].sum() <= capacity:
                rows.append(np.bincount(combo, minlength=len(sizes)))
    return np.array(rows, dtype=np.float64)


def cover(columns: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Fewest columns (fractional) whose sum covers the demand: primal simplex over listed columns.

    Starts from the columns of one size each; a column enters while its dual worth exceeds 1.
    """
    k = len(demand)
    pure = [int(np.argmax(np.where((columns.sum(axis=1) == columns[:, i]), columns[:, i], -1))) for i in range(k)]
    basis = list(pure)
    for _ in range(50 * k):
        b = columns[basis].T
        try:
            dual = np.linalg.solve(b.T, np.ones(k))
            x = np.linalg.solve(b, demand)
        except np.linalg.LinAlgError:
            break
        worth = columns @ dual
        enter = int(worth.argmax())
        if worth[enter] <= 1 + 1e-9:
            break
        d = np.linalg.solve(b, columns[enter])
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[leave] = enter
    out = np.zeros(len(columns))
    np.add.at(out, basis, np.maximum(np.linalg.solve(columns[basis].T, demand), 0))
    return out


def pack(lengths: np.ndarray, capacity: int, groups: int = GROUPS) -> np.ndarray:
    """Window number of each length (all between 1 and the capacity)."""
    full = lengths == capacity
    window = np.where(full, np.cumsum(full) - 1, -1).astype(np.int64)
    left = [0] * int(full.sum())
    large = np.flatnonzero((lengths * LARGE > capacity) & ~full)
    if len(large):
        order = large[np.argsort(-lengths[large], kind="stable")]
        parts = [g for g in np.array_split(order, min(groups, len(order))) if len(g)]
        sizes, which = np.unique([lengths[g[0]] for g in parts], return_inverse=True)
        demand = np.bincount(which, weights=[len(g) for g in parts])
        columns = configurations(sizes, capacity)
        plan = np.floor(cover(columns, demand) + 1e-9).astype(int)
        waiting = order[::-1].tolist()
        size_of = lengths[order[::-1]].tolist()
        # fullest configurations first; a place takes the longest document that leaves room for the
        # places after it, at least the one that its group promises
        for c in sorted(np.flatnonzero(plan), key=lambda c: -(columns[c] @ sizes)):
            places = np.repeat(sizes, columns[c].astype(int))[::-1].tolist()
            for _ in range(plan[c]):
                room, used = capacity, False
                for k in range(len(places)):
                    at = bisect_right(size_of, room - sum(places[k + 1 :])) - 1
                    if at >= 0:
                        i, n = waiting.pop(at), size_of.pop(at)
                        window[i], used = len(left), True
                        room -= n
                if used:
                    left.append(room)
        _best_fit(waiting[::-1], lengths, window, left, capacity)
    small = np.flatnonzero(lengths * LARGE <= capacity)
    _best_fit(small[np.argsort(-lengths[small], kind="stable")].tolist(), lengths, window, left, capacity)
    return _refilled(lengths, window, np.array(left, dtype=np.int64), capacity)


def _refilled(lengths: np.ndarray, window: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """Windows with room left, where rounding up was too coarse, are emptied and filled again best-fit
    from the longest on; that stands if it takes fewer windows."""
    poor = left * 64 > capacity
    loose = np.flatnonzero(poor[window]) if len(window) else window
    if not len(loose):
        return window
    again = np.full(len(lengths), -1, dtype=np.int64)
    rooms: list[int] = []
    _best_fit(loose[np.argsort(-lengths[loose], kind="stable")].tolist(), lengths, again, rooms, capacity)
    if len(rooms) >= poor.sum():
        return window
    number = np.cumsum(~poor) - 1
    return np.where(again >= 0, again + (~poor).sum(), number[window])


def _best_fit(items: list[int], lengths: np.ndarray, window: np.ndarray, left: list[int], capacity: int) -> None:
    """Each item into the window with the least room that holds it; else a new window."""
    rooms = sorted((r, w) for w, r in enumerate(left) if r)
    for i in items:
        n = int(lengths[i])
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, w = rooms.pop(at)
        else:
            room, w = capacity, len(left)
            left.append(capacity)
        window[i] = w
        left[w] = room - n
        if left[w]:
            insort(rooms, (left[w], w))


def pack_documents(counts: DataFrame, capacity: int, shard_docs: int = 20_000) -> DataFrame:
    """(window, doc_id, piece, first_token, tokens, pieces) over ``counts(doc_id, n_tokens)``.

    ``window`` names a window as "shard/number"; ``pieces`` is 1 for a document that is not cut.
    """
    if capacity < 1:
        raise ValueError("a window holds at least one token")
    scratch = Scratch(counts.sparkSession, "packing")
    kept = scratch.keep(counts, "lengths")
    shards = max(1, -(-kept.count() // shard_docs))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        n = pdf["n_tokens"].to_numpy()
        pieces = -(-n // capacity)
        doc = np.repeat(pdf["doc_id"].to_numpy(), pieces)
        total = np.repeat(pieces, pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        tokens = np.minimum(np.repeat(n, pieces) - piece * capacity, capacity)
        number = pack(tokens, capacity)
        shard = int(pdf["shard"].iloc[0])
        return pd.DataFrame(
            {"window": [f"{shard}/{w}" for w in number], "doc_id": doc, "piece": piece, "first_token": piece * capacity, "tokens": tokens, "pieces": total}
        )

    sharded = kept.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(run, "window string, doc_id long, piece long, first_token long, tokens long, pieces long")


def fill_rates(counts: DataFrame, capacities: dict[str, int], shard_docs: int = 20_000) -> DataFrame:
    """(window_name, capacity, documents, windows, tokens, unused): for each capacity the windows
    that ``pack_documents`` fills and the unused part of their space."""
    out = None
    for name, capacity in sorted(capacities.items()):
        packed = pack_documents(counts, capacity, shard_docs).groupBy("window").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("piece") == 0).alias("documents"))
        total = packed.agg(F.count(F.lit(1)).alias("windows"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"))
        unused = F.when(F.col("windows") > 0, F.round(1 - F.col("tokens") / (F.col("windows") * capacity), 6))
        row = total.select(F.lit(name).alias("window_name"), F.lit(capacity).alias("capacity"), "documents", "windows", "tokens", unused.alias("unused"))
        out = row if out is None else out.unionByName(row)
    return out
