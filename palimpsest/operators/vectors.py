"""Exhaustive and quantized vector search.

``scan_topk`` scores one or many query vectors against a scan in Arrow batches and keeps only
the best k a query in each partition, so that what is shuffled is partitions x queries x k rows;
where that is much, a scan has no more partitions than run at once.  Rows that single precision
leaves in question are scored exactly.  The queries are broadcast in blocks of ``MAX_QUERIES``, a
scan each.

Unusual cases: null vectors, other lengths, null or NaN elements, zero norms are never hits; a
query that is not usable has no hits; ties by id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_QUERIES = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine as a column; 0 for other lengths or a zero norm, null for null vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def usable(column: Column, dims: int) -> Column:
    """Vectors of the right length, finite throughout and not all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(column) == dims) & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def batch_vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(lengths == dims)
    if not len(at):
        return at, np.empty((0, dims))
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dims)
    good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
    return at[good], flat[good]


def scan_topk(rows: DataFrame, queries: list[tuple[str, list[float]]], k: int, id_type: str = "string", min_similarity: float | None = None, exclude_self: bool = False, digits: int = 6) -> DataFrame:
    """``rows(id, embedding)`` -> (query_id, id, similarity, rank): the k best a query, ranked on
    the rounded cosine and id."""
    if len(queries) > MAX_QUERIES:
        parts = [scan_topk(rows, queries[a : a + MAX_QUERIES], k, id_type, min_similarity, exclude_self, digits) for a in range(0, len(queries), MAX_QUERIES)]
        return reduce(DataFrame.unionByName, parts)
    spark = rows.sparkSession
    queries = [(q, np.asarray(v, dtype=np.float64)) for q, v in queries if v is not None]
    queries = [(q, v) for q, v in queries if np.isfinite(v).all() and v.any()]
    schema = f"query_id string, id {id_type}, similarity double"
    if not queries:
        return spark.createDataFrame([], schema + ", rank int")
    dims = len(queries[0][1])
    names = pa.array([q for q, _ in queries], pa.string())
    state = spark.sparkContext.broadcast((names, np.stack([v / np.linalg.norm(v) for _, v in queries])))
    margin = 2.4e-7 * dims + 10.0**-digits  # what single precision and rounding may hide

    def run(batches):
        names, matrix = state.value
        found = Best(len(names), k, -np.inf)
        rough = matrix.astype(np.float32)
        same = pc.index_in(names, value_set=names).to_numpy()
        for block in joined(batches):
            at, x = batch_vectors(block.column("embedding").combine_chunks(), dims)
            if not len(at):
                continue
            ids = block.column("id").take(pa.array(at))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            own = pc.index_in(ids.cast(pa.string()), value_set=names).fill_null(-1).to_numpy() if exclude_self else None
            turned, base = np.ascontiguousarray(x.T, dtype=np.float32), found.begin(ids)
            for q in range(0, len(names), 32):
                sims = rough[q : q + 32] @ turned
                least = found.least[q : q + 32].copy()
                if np.isinf(least).any() and len(at) > k + 1:
                    # k + 1 rows are as near as this, one of them may be the query itself
                    least = np.maximum(least, np.partition(sims, len(at) - k - 1, axis=1)[:, len(at) - k - 1] - margin)
                if min_similarity is not None:
                    least = np.maximum(least, min_similarity)
                of, row = np.nonzero(sims >= (least - margin).astype(np.float32)[:, None])
                of += q
                exact = np.round(np.einsum("ij,ij->i", x[row], matrix[of]), digits)
                good = exact > found.least[of]
                if min_similarity is not None:
                    good &= exact >= min_similarity
                if exclude_self:
                    good &= own[row] != same[of]
                found.add(of[good], exact[good], base + row[good])
        for q, ids, s in found.rows():
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids, pa.array(s)], names=["query_id", "id", "similarity"])

    part = in_order(rows.where("embedding is not null").select("id", "embedding"), len(queries) * k).mapInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: rows kept by a task from which on a scan gets no more tasks than run at once, since every task
#: keeps so many
MANY_KEPT = 100_000


def in_order(rows: DataFrame, kept: int) -> DataFrame:
    """``rows`` by id within each partition, so that of equal scores the first seen is the best."""
    if kept >= MANY_KEPT:
        rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    return rows.sortWithinPartitions("id")


def joined(batches, least: int = 32_768):
    """The batches as tables of ``least`` rows or more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


class Best:
    """The k best rows of each query of one task.  Rows come in the order of their ids; ``least`` is
    the score that a further row has to exceed."""

    def __init__(self, queries: int, k: int, least: float):
        self.k, self.least = k, np.full(queries, least)
        self.scores = [np.empty(0)] * queries
        self.at = [np.empty(0, dtype=np.int64)] * queries
        self.ids: list[pa.Array] = []
        self.n = 0

    def begin(self, ids: pa.Array | pa.ChunkedArray, held: int = 1_000_000) -> int:
        """Takes the ids of the next rows; -> the number of the first of them."""
        if self.n > held:
            used = np.unique(np.concatenate(self.at))
            self.ids = [self._named(used)]
            self.at = [np.searchsorted(used, a) for a in self.at]
            self.n = len(used)
        self.ids.append(pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids)
        self.n += len(ids)
        return self.n - len(ids)

    def _named(self, rows: np.ndarray) -> pa.Array:
        return pa.chunked_array(self.ids).take(pa.array(rows)).combine_chunks()

    def add(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        """Rows of ascending number for queries in ascending order."""
        which, first = np.unique(query, return_index=True)
        for q, a, b in zip(which.tolist(), first.tolist(), [*first[1:].tolist(), len(query)]):
            self.add_one(q, score[a:b], row[a:b])

    def add_one(self, q: int, score: np.ndarray, row: np.ndarray) -> None:
        score, row = np.concatenate([self.scores[q], score]), np.concatenate([self.at[q], row])
        best = np.argsort(-score, kind="stable")[: self.k]
        self.scores[q], self.at[q] = score[best], row[best]
        if len(best) == self.k:
            self.least[q] = score[best[-1]]

    def rows(self, at_once: int = 100):
        for q in range(0, len(self.at), at_once):
            at = np.concatenate(self.at[q : q + at_once])
            if len(at):
                yield np.repeat(np.arange(q, q + len(self.at[q : q + at_once])), [len(a) for a in self.at[q : q + at_once]]), self._named(at), np.concatenate(self.scores[q : q + at_once])


# --- quantized engine -------------------------------------------------------------------------


def _splitmix(seed: int, n: int) -> np.ndarray:
    """n values of the splitmix64 sequence."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Codec:
    """Rotated, scalar-quantized vector codes with a one-bit sketch.

    A vector is normalised, rotated by ``rounds`` of random signs and Walsh-Hadamard transforms
    (padded to a power of two), and every coordinate is replaced by the nearest of 2^bits
    Lloyd-Max levels of the normal distribution.  The sign bits serve as the first, coarse stage.
    """

    def __init__(self, dims: int, bits: int = 4, seed: int = 42, rounds: int = 3):
        if bits not in (2, 3, 4, 5):
            raise ValueError("bits must be 2 to 5")
        self.dims, self.bits = dims, bits
        self.width = 1 << (dims - 1).bit_length()
        signs = _splitmix(seed, rounds * self.width) >> np.uint64(63)
        self.signs = np.where(signs.reshape(rounds, self.width) == 0, 1.0, -1.0)
        self.levels = self._lloyd_max(1 << bits)
        self.cuts = (self.levels[1:] + self.levels[:-1]) / 2

    @staticmethod
    def _lloyd_max(n: int) -> np.ndarray:
        """Levels of least squared error for the standard normal, by fixed-point iteration."""
        grid = np.linspace(-6, 6, 24_001)
        mass = np.exp(-grid * grid / 2)
        levels = np.linspace(-2, 2, n)
        for _ in range(300):
            cell = np.searchsorted((levels[1:] + levels[:-1]) / 2, grid)
            levels = np.bincount(cell, weights=mass * grid, minlength=n) / np.bincount(cell, weights=mass, minlength=n)
        return levels

    def rotate(self, x: np.ndarray) -> np.ndarray:
        y = np.zeros((len(x), self.width))
        y[:, : self.dims] = x
        for s in self.signs:
            y = y * s
            h = 1
            while h < self.width:
                y = y.reshape(len(x), -1, 2, h)
                y = np.concatenate([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
                h *= 2
            y = y / np.sqrt(self.width)
        return y

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sign bits packed, level numbers, scale that makes the code's self-product exact)."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        y = self.rotate(unit) * np.sqrt(self.width)
        code = np.searchsorted(self.cuts, y).astype(np.uint8)
        near = self.levels[code]
        gamma = np.sqrt(self.width) / np.maximum((near * y).sum(axis=1) / np.sqrt(self.width), 1e-12)
        return np.packbits(y > 0, axis=1), code, gamma

    def estimate(self, code: np.ndarray, gamma: np.ndarray, rotated_query: np.ndarray) -> np.ndarray:
        """Estimated cosine of coded vectors with a rotated unit query."""
        return self.levels[code] @ rotated_query / self.width * gamma


def encode_table(rows: DataFrame, dims: int, bits: int = 4, id_type: str = "string", seed: int = 42) -> DataFrame:
    """``rows(id, embedding)`` -> (id, signs, code, gamma): the columnar snapshot of the engine."""

    def run(batches):
        codec = Codec(dims, bits, seed)
        for batch in batches:
            at, x = batch_vectors(batch.column("embedding"), dims)
            if len(at):
                signs, code, gamma = codec.encode(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at)), pa.array([s.tobytes() for s in signs], pa.binary()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(gamma)], names=["id", "signs", "code", "gamma"]
                )

    return rows.where("embedding is not null").select("id", "embedding").mapInArrow(run, f"id {id_type}, signs binary, code binary, gamma double")


def quantized_topk(codes: DataFrame, rows: DataFrame, query: list[float], k: int, dims: int, bits: int = 4, id_type: str = "string", seed: int = 42, first: int | None = None, second: int | None = None) -> DataFrame:
    """Three stages: sign-bit distance to the best ``first``, code estimate to the best
    ``second``, exact cosine to the best k."""
    first, second = first or max(8 * k, 512), second or max(4 * k, 64)
    vector = np.asarray(query, dtype=np.float64)
    unit = vector / np.linalg.norm(vector)

    def run(batches):
        codec = Codec(dims, bits, seed)
        rotated = codec.rotate(unit[None])[0] * np.sqrt(codec.width)
        bits_q = np.packbits(rotated > 0)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = np.frombuffer(b"".join(batch.column("signs").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
            away = np.bitwise_count(signs ^ bits_q).sum(axis=1)
            near = np.argsort(away, kind="stable")[:first]
            code = np.frombuffer(b"".join(batch.column("code").take(pa.array(near)).to_pylist()), dtype=np.uint8).reshape(len(near), -1)
            gamma = np.asarray(batch.column("gamma"))[near]
            kept.append((np.asarray(batch.column("id").take(pa.array(near)).to_pylist(), dtype=object), away[near], codec.estimate(code, gamma, rotated)))
        if kept:
            ids, away, guess = (np.concatenate(c) for c in zip(*kept))
            near = np.argsort(away, kind="stable")[:first]
            yield pa.RecordBatch.from_arrays([pa.array(ids[near].tolist()), pa.array(away[near].astype(np.int32)), pa.array(guess[near])], names=["id", "away", "estimate"])

    staged = codes.mapInArrow(run, f"id {id_type}, away int, estimate double")
    pool = staged.orderBy("away", "id").limit(first).orderBy(F.col("estimate").desc(), "id").limit(second)
    exact = scan_topk(rows.join(F.broadcast(pool.select("id")), "id", "left_semi"), [("q", list(vector))], k, id_type)
    return exact.drop("query_id")
