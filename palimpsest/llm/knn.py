"""Problem 5 - the most similar vectors of every vector.

Method: collision-counting hashing.  The coordinates of a randomly rotated vector are its single
projections.

* ``search`` - given queries against all vectors: sorted arrays of each projection, query-centred
  windows that are expanded by virtual rehashing, collisions counted, vectors beyond the threshold
  verified with the exact cosine.
* ``neighbours`` - all vectors as queries, down to ``min_cosine``.  Windows over the whole
  collection would be quadratic in all, so vectors are first gathered in cells (three
  cross-polytope hashes, ``tables`` times over).  Within a cell the rows are sorted by one
  projection; every row's window on it is walked, projections within the radius are counted as
  collisions, and pairs with enough collisions are scored on small integer codes, first at a small
  radius, then, for rows that lack ``k`` neighbours, at the full one.  Survivors are verified.

The loss is measured against brute force in the tests.

Result for the unusual cases
* null, wrong length, a null, NaN or infinite element, all zero: not usable, in no pair.
* rows delivered twice: once.  Equal vectors: each row's first neighbours, ordered by id.
* ties in cosine: the smaller id first.  Empty tables: empty result.
* a query that is no row, or has no usable vector: no row.

Scale and skew: equal vectors are folded before cells are formed.  A cell beyond ``hot_cell``
rows is cut into blocks and worked off as block pairs in separate tasks.  A row emits at most
``3 k`` pairs a table, the best by code, so dense cells do not flood the next step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.runtime import Scratch

SCALE = 160.0


@dataclass(frozen=True)
class KnnParams:
    dims: int = 32
    k: int = 5
    min_cosine: float = 0.95
    tables: int = 12
    hashes: int = 3
    seed: int = 42
    hot_cell: int = 20_000
    #: candidate pairs that may be broadcast for verification (16 bytes each)
    broadcast_pairs: int = 200_000
    #: search: the first half width of the windows, its growth, base vectors in a sorted shard, and
    #: queries that are sent to the tasks at once (260 bytes each)
    first_radius: float = 0.02
    widening: float = 2.0
    shard: int = 20_000
    query_block: int = 50_000

    @property
    def sigma(self) -> float:
        """Standard deviation of one projection's difference at the least cosine."""
        return math.sqrt((2 - 2 * self.min_cosine) / self.dims)

    @property
    def radii(self) -> tuple[int, int]:
        full = math.ceil(2 * self.sigma * SCALE)
        return max(1, full // 3), full

    @property
    def threshold(self) -> int:
        p = math.erf(2 / math.sqrt(2))
        return math.floor(self.dims * p - 3.5 * math.sqrt(self.dims * p * (1 - p)))


def rotations(params: KnnParams, count: int) -> list[np.ndarray]:
    rng = np.random.default_rng(params.seed)
    return [np.linalg.qr(rng.normal(size=(params.dims, params.dims)))[0].astype(np.float32) for _ in range(count)]


def usable_vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors of a list column, and the vectors (float32)."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(lengths == dims)
    if not len(at):
        return at, np.empty((0, dims), np.float32)
    values = column.take(pa.array(at)).flatten()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(at), dims)
    good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
    return at[good], flat[good]


def hashed_vectors(rows: DataFrame, params: KnnParams) -> DataFrame:
    """``rows(id, embedding)`` -> (id, vh, vec, code, cells) of the usable ones."""

    def run(batches):
        rot = rotations(params, params.tables * params.hashes + 1)
        for batch in batches:
            at, x = usable_vectors(batch.column("embedding"), params.dims)
            if not len(at):
                continue
            norm = np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
            unit = (x / norm).astype(np.float32)
            code = np.clip(np.rint(unit @ rot[-1] * SCALE), -127, 127).astype(np.int8)
            cells = np.empty((len(at), params.tables), dtype=np.int64)
            line = np.arange(len(at))
            for t in range(params.tables):
                cell = np.full(len(at), t, dtype=np.int64)
                for r in rot[t * params.hashes : (t + 1) * params.hashes]:
                    y = unit @ r
                    axis = np.abs(y).argmax(axis=1)
                    cell = cell * (2 * params.dims) + axis * 2 + (y[line, axis] > 0)
                cells[:, t] = cell
            raw = [v.tobytes() for v in x]
            offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * np.int32(params.tables))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(at)),
                    pa.array(np.array([xxhash.xxh64_intdigest(v) for v in raw], dtype=np.uint64).view(np.int64)),
                    pa.array(raw, pa.binary()),
                    pa.array([c.tobytes() for c in code], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(cells.ravel())),
                ],
                names=["id", "vh", "vec", "code", "cells"],
            )

    return rows.where("id is not null and embedding is not null").select("id", "embedding").mapInArrow(run, "id string, vh long, vec binary, code binary, cells array<long>")


def _walk(key: np.ndarray, lead: np.ndarray, code: np.ndarray, radius: int, params: KnnParams, fresh: int, done: np.ndarray):
    """Pairs (i, j, score) of one sorted run: same key, lead within the radius, enough collisions.

    Row i meets row i+d for d = 1, 2, .. while its window lasts; a pair is taken only if its
    later row is at or after ``fresh`` (rows before are context of the previous run).
    """
    out_i, out_j, out_s, held = [], [], [], 0
    live = np.arange(len(key) - 1)
    d = 1
    while len(live):
        j = live + d
        ok = j < len(key)
        live, j = live[ok], j[ok]
        ok = (key[live] == key[j]) & (lead[j] - lead[live] <= radius)
        live, j = live[ok], j[ok]
        if not len(live):
            break
        take = (j >= fresh) & ~(done[live] & done[j])
        i1, j1 = live[take], j[take]
        for a in range(0, len(i1), 65_536):
            i2, j2 = i1[a : a + 65_536], j1[a : a + 65_536]
            x, y = code[i2].astype(np.int16), code[j2].astype(np.int16)
            hits = (np.abs(x - y) <= radius).sum(axis=1) >= params.threshold
            if hits.any():
                # by distance: rounding disturbs it less than the product where vectors are close
                away = x[hits].astype(np.int32) - y[hits]
                score = 1 - np.einsum("ij,ij->i", away, away) / (2 * SCALE * SCALE)
                near = score >= params.min_cosine - 0.03
                out_i.append(i2[hits][near])
                out_j.append(j2[hits][near])
                out_s.append(score[near])
                held += int(near.sum())
        if held > 1_000_000:
            i, j, s = _best(np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_s), params)
            out_i, out_j, out_s, held = [i], [j], [s], len(i) // 4
        d += 1
    if not out_i:
        none = np.empty(0, dtype=np.int64)
        return none, none, np.empty(0)
    return _best(np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_s), params)


def _best(i: np.ndarray, j: np.ndarray, s: np.ndarray, params: KnnParams):
    """Pairs that are among the best 3 k of either end."""
    keep = np.zeros(len(i), dtype=bool)
    for end in (i, j):
        order = np.lexsort((-s, end))
        e = end[order]
        first = np.concatenate([[True], e[1:] != e[:-1]]) if len(e) else np.empty(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(e)), 0)) if len(e) else e
        keep[order[np.arange(len(e)) - start < 3 * params.k]] = True
    return i[keep], j[keep], s[keep]


def _near_pairs(cells: DataFrame, params: KnnParams) -> DataFrame:
    """(u, v) that meet in a cell with enough collisions; ``cells(cell, vh, code)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small, full = params.radii
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column("cell"))
            vh = np.asarray(batch.column("vh"))
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.int8).reshape(-1, params.dims)
            fresh = 0
            if tail is not None:
                fresh = len(tail[0])
                key, vh, code = np.concatenate([tail[0], key]), np.concatenate([tail[1], vh]), np.concatenate([tail[2], code])
            lead = code[:, 0].astype(np.int32)
            done = np.zeros(len(key), dtype=bool)
            i, j, _ = _walk(key, lead, code, small, params, fresh, done)
            done |= np.bincount(np.concatenate([i, j]), minlength=len(key)) >= params.k
            i2, j2, _ = _walk(key, lead, code, full, params, fresh, done)
            i, j = np.concatenate([i, i2]), np.concatenate([j, j2])
            if len(i):
                u, v = np.minimum(vh[i], vh[j]), np.maximum(vh[i], vh[j])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
            left = (key == key[-1]) & (lead >= lead[-1] - full)
            tail = key[left], vh[left], code[left]

    placed = cells.repartition("cell").withColumn("lead", F.expr("cast(conv(hex(substring(code, 1, 1)), 16, 10) as int)"))
    placed = placed.withColumn("lead", F.when(F.col("lead") > 127, F.col("lead") - 256).otherwise(F.col("lead"))).sortWithinPartitions("cell", "lead")
    return placed.select("cell", "vh", "code").mapInArrow(run, "u long, v long")


def _split_hot(cells: DataFrame, params: KnnParams, scratch: Scratch) -> DataFrame:
    """Cells beyond ``hot_cell`` rows become pairs of blocks, each a cell of its own."""
    hot = scratch.keep(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > params.hot_cell), "hot-cells")
    if hot.isEmpty():
        return cells
    blocks = F.ceil(F.col("n") / params.hot_cell)
    marked = cells.join(hot, "cell", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.col("vh"), F.col("blocks")))
    calm = marked.where("n is null").select("cell", "vh", "code")
    loud = marked.where("n is not null").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    loud = loud.select(F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "vh", "code")
    return calm.unionByName(loud)


class _Shelf:
    """Base vectors of one shard, with the sorted array of every single projection."""

    def __init__(self, vh: np.ndarray, x: np.ndarray, rotation: np.ndarray):
        self.vh = vh
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        y = self.unit @ rotation
        self.order = np.argsort(y, axis=0, kind="stable").T.astype(np.int32)
        self.value = np.take_along_axis(y, self.order.T, axis=0).T.copy()

    def nearest(self, unit: np.ndarray, y: np.ndarray, top_v: np.ndarray, top_c: np.ndarray, params: KnnParams) -> None:
        """Bring the best of this shard into one query's running best (``top_v``, ``top_c``).

        The windows around the query start at ``first_radius`` on every projection and are widened
        by ``widening`` (virtual rehashing): only what a window gains is counted.  A vector that
        collides on ``threshold`` projections is verified once.  The query ends when the windows
        are as wide as neighbours at the distance of its k-th best are apart, or hold everything.
        """
        m = params.dims
        hits = np.zeros(len(self.vh), dtype=np.int16)
        seen = np.zeros(len(self.vh), dtype=bool)
        low = high = None
        radius = params.first_radius
        while True:
            new_low = np.array([self.value[j].searchsorted(y[j] - radius) for j in range(m)])
            new_high = np.array([self.value[j].searchsorted(y[j] + radius, "right") for j in range(m)])
            for j in range(m):
                if low is None:
                    hits[self.order[j, new_low[j] : new_high[j]]] += 1
                else:
                    hits[self.order[j, new_low[j] : low[j]]] += 1
                    hits[self.order[j, high[j] : new_high[j]]] += 1
            low, high = new_low, new_high
            at = np.flatnonzero((hits >= params.threshold) & ~seen)
            if len(at):
                seen[at] = True
                c = self.unit[at] @ unit
                if len(at) > len(top_v):
                    best = np.argpartition(-c, len(top_v) - 1)[: len(top_v)]
                    at, c = at[best], c[best]
                both_c, both_v = np.concatenate([top_c, c]), np.concatenate([top_v, self.vh[at]])
                best = np.argsort(-both_c, kind="stable")[: len(top_v)]
                top_c[:], top_v[:] = both_c[best], both_v[best]
            # the vector itself is among the best, so the k-th neighbour stands at k
            kth = top_c[params.k]
            enough = 2 * math.sqrt(max(0.0, 2 - 2 * kth) / m) if np.isfinite(kth) else math.inf
            if radius >= enough or (low == 0).all() and (high == len(self.vh)).all():
                return
            radius = min(radius * params.widening, enough) if radius * params.widening < 2 else 2.0


def search(queries: DataFrame, rows: DataFrame, params: KnnParams = KnnParams()) -> DataFrame:
    """``queries(id)``, ``rows(id, embedding)``, one row an id -> (id, neighbour, cosine, rank): the
    ``k`` most similar others of every query that has a usable vector, however far away.

    Collision counting over single projections: every task sorts its shards of the base on each
    projection and lets all queries of a block expand their windows there.  Queries are worked off
    in blocks of ``query_block`` distinct vectors, the bound of what is sent to the tasks; a task
    returns its best of each query.
    """
    scratch = Scratch(rows.sparkSession, "knn-search")
    hashed = scratch.keep(hashed_vectors(rows, replace(params, tables=0)).select("vh", "id", "vec"), "hashed")
    members = hashed.select("vh", "id").distinct()
    vectors = scratch.keep(hashed.groupBy("vh").agg(F.first("vec").alias("vec")), "vectors")
    asked = scratch.keep(hashed.join(queries.select("id").distinct(), "id").select("vh", "id"), "asked")
    blocks = max(1, math.ceil(asked.select("vh").distinct().count() / params.query_block))
    wanted = scratch.keep(vectors.join(asked.select("vh").distinct(), "vh").withColumn("block", F.pmod(F.xxhash64("vh"), F.lit(blocks)).cast("int")), "queries")
    found = None
    for block in range(blocks):
        part = _searched(vectors, wanted.where(F.col("block") == block), params)
        found = part if found is None else found.unionByName(part)
    both = scratch.keep(found.where("u <> v"), "found")
    return _ranked(both, members, params, scratch, asked)


def _decoded(vecs: pa.Array, params: KnnParams) -> np.ndarray:
    return np.frombuffer(b"".join(vecs.to_pylist()), dtype=np.float32).reshape(-1, params.dims).astype(np.float64)


def _searched(vectors: DataFrame, queries: DataFrame, params: KnnParams) -> DataFrame:
    """(u, v, cosine): each query's best of every task; the query itself may be among them."""
    block = queries.select("vh", "vec").toArrow()  # about ``query_block`` vectors
    q_vh = block.column("vh").to_numpy()
    q = _decoded(block.column("vec").combine_chunks(), params) if len(q_vh) else np.empty((0, params.dims))
    sent = vectors.sparkSession.sparkContext.broadcast((q_vh, q / np.linalg.norm(q, axis=1, keepdims=True)))

    def run(batches):
        vh, unit = sent.value
        rotation = rotations(params, 1)[0].astype(np.float64)
        turned = unit @ rotation
        top_v = np.zeros((len(vh), 2 * params.k + 1), dtype=np.int64)
        top_c = np.full(top_v.shape, -np.inf)
        waiting, held = [], 0

        def work():
            shelf = _Shelf(np.concatenate([v for v, _ in waiting]), np.concatenate([x for _, x in waiting]), rotation)
            for i in range(len(vh)):
                shelf.nearest(unit[i], turned[i], top_v[i], top_c[i], params)

        for batch in batches:
            if batch.num_rows:
                waiting.append((batch.column("vh").to_numpy(), _decoded(batch.column("vec"), params)))
                held += batch.num_rows
            if held >= params.shard:
                work()
                waiting, held = [], 0
        if held:
            work()
        i, j = np.nonzero(np.isfinite(top_c))
        yield pa.RecordBatch.from_arrays([pa.array(vh[i]), pa.array(top_v[i, j]), pa.array(top_c[i, j])], names=["u", "v", "cosine"])

    return vectors.select("vh", "vec").mapInArrow(run, "u long, v long, cosine double")


def neighbours(rows: DataFrame, params: KnnParams = KnnParams()) -> DataFrame:
    """``rows(id, embedding)``, one row an id -> (id, neighbour, cosine, rank): up to ``k``
    neighbours of cosine ``min_cosine`` at least for every usable vector."""
    scratch = Scratch(rows.sparkSession, "knn")
    hashed = scratch.keep(hashed_vectors(rows, params), "hashed")
    members = hashed.select("vh", "id").distinct()
    vectors = hashed.groupBy("vh").agg(F.first("code").alias("code"), F.first("cells").alias("cells"))
    cells = vectors.select(F.explode("cells").alias("cell"), "vh", "code")
    pairs = scratch.keep(_near_pairs(_split_hot(cells, params, scratch), params).distinct(), "pairs")
    exact = scratch.keep(_verify(pairs, hashed, params), "verified")
    both = exact.select("u", "v", "cosine").union(exact.select(F.col("v"), F.col("u"), "cosine"))
    return _ranked(both, members, params, scratch)


def _ranked(both: DataFrame, members: DataFrame, params: KnnParams, scratch: Scratch, asked: DataFrame | None = None) -> DataFrame:
    """From distinct vectors ``both(u, v, cosine)`` to the rows that hold them, or those ``asked``."""
    by_id = Window.partitionBy("vh").orderBy("id")
    heads = members.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= params.k + 1)
    heads = scratch.keep(heads.select("vh", "id"), "heads")
    near = Window.partitionBy("u").orderBy(F.col("cosine").desc(), "v")
    # 2k distinct neighbours are more than k rows can need, ties among equal cosines included
    near_groups = both.withColumn("r", F.row_number().over(near)).where(F.col("r") <= 2 * params.k).select(F.col("u").alias("own"), F.col("v").alias("vh"), "cosine")
    own = heads.groupBy("vh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("vh").alias("own"), "vh", F.lit(1.0).alias("cosine"))
    groups = near_groups.unionByName(own).join(heads, "vh").select(F.col("own").alias("vh"), F.col("id").alias("neighbour"), "cosine")
    lists = groups.groupBy("vh").agg(F.collect_list(F.struct((-F.col("cosine")).alias("far"), F.col("neighbour").alias("id"))).alias("near"))
    found = (members if asked is None else asked).join(lists, "vh").select("id", F.slice(F.array_sort(F.filter("near", lambda x: x["id"] != F.col("id"))), 1, params.k).alias("near"))
    return found.select("id", F.posexplode("near").alias("rank", "n")).select("id", F.col("n.id").alias("neighbour"), (-F.col("n.far")).alias("cosine"), (F.col("rank") + 1).alias("rank"))


def _verify(pairs: DataFrame, hashed: DataFrame, params: KnnParams) -> DataFrame:
    """Exact cosine of the surviving pairs."""
    wanted = pairs.select(F.col("u").alias("vh")).union(pairs.select("v")).distinct()
    few = pairs.count() <= params.broadcast_pairs
    small = F.broadcast if few else (lambda df: df)
    vectors = hashed.select("vh", "vec").join(small(wanted), "vh").dropDuplicates(["vh"])
    left = pairs.join(vectors.select(F.col("vh").alias("u"), F.col("vec").alias("vec_u")), "u")
    both = left.join(vectors.select(F.col("vh").alias("v"), F.col("vec").alias("vec_v")), "v")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.float32).reshape(-1, params.dims).astype(np.float64) for c in ("vec_u", "vec_v"))
            cosine = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
            good = np.flatnonzero(cosine >= params.min_cosine)
            yield pa.RecordBatch.from_arrays([batch.column("u").take(pa.array(good)), batch.column("v").take(pa.array(good)), pa.array(cosine[good])], names=["u", "v", "cosine"])

    return both.select("u", "v", "vec_u", "vec_v").mapInArrow(run, "u long, v long, cosine double")
