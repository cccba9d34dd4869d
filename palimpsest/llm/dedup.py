"""Problem 1 - new batches of texts against everything accepted before.

Method: content-defined chunking.  A rolling hash over the word stream sets chunk boundaries
from the content alone, so an edit moves only the boundaries next to it.  One of the streams has
the words ordered by hash, since texts match by their words whatever the order.  Chunk hashes go to
a persistent chunk-to-record table; records that share chunks get the total of shared bytes;
pairs whose shared bytes cover enough of the longer record are candidates; candidates are
verified on all their words; the chunks of accepted records are appended.

Scattered edits leave few whole chunks, and chunks of more than ``hot_chunk`` records (boiler-plate)
count for nothing, so chunks alone lose matches.  Every record therefore also meets others by its
rarest words (``exact_pairs``), which finds every match: of ``n`` words, two that match share at
least one of the first ``n - ceil(0.8 n) + 1`` in one order of all words.  Parity sketches of the
words drop the pairs that differ too much; neither step drops a pair that matches.

A batch costs passes over the batch, and one scan of the key columns of the stored tables in those
hash buckets that the batch touches, against a broadcast of the batch's keys (behind a check of
its size).  Texts are read once; of the history only the words of candidates are read again, as
hashes, in the buckets they lie in.

Result for the unusual cases
* null id, null or blank content, null time, fewer than ``min_words`` words: not taken, no row.
* rows delivered twice (one id): counted once, at the earliest time.
* ties in time: broken by id.  Empty input: empty output, same columns.
* a text of any length is chunked whole.

Scale and skew: texts with the same bag of words are folded into their first row before any
chunk is shuffled (a third of all rows may be one text), and told apart again by a join that sends
hot bags to the rows.  A group of near copies would give all its pairs: where more than ``crowd``
records share a rare word, its earliest record is compared with all others first; records that
match one which has no earlier match are copies for certain, and two of those are not compared.
A word of more than ``hot_token`` postings is cut into blocks, and every pair of blocks is work of
its own.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.words import WordHasher, words
from palimpsest.operators.skew import hot_keys, lookup
from palimpsest.runtime import Scratch

_ROLL = np.uint64(0x9E3779B97F4A7C15)
_SPAN = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

BAG_FAMILY = 2

SIGNATURE = "rid long, id string, ts long, n_words int, bag_a long, bag_b long, n_bytes int, chunks array<struct<h:long,bytes:int>>, tokens array<int>"

PREFIXES = "k int, rid long, n_words int, s0 long, s1 long, s2 long, s3 long"


@dataclass(frozen=True)
class ChunkParams:
    min_words: int = 12
    similarity: float = 0.8
    #: words in a chunk at least, and the further words on average up to the boundary
    chunk_min: int = 5
    chunk_mean: int = 4
    #: the same in the stream ordered by hash, where a chunk mixes words of all sentences
    bag_min: int = 3
    #: boundary families, each cuts the whole text: two over the text's order, one over the words
    #: ordered by hash
    families: int = 3  # at most 3
    #: texts of at most so many words are also cut into finer chunks, since one edit of a short
    #: text reaches most of its chunks; 1 / similarity above the length where that matters
    short_words: int = 30
    fine_min: int = 3
    fine_mean: int = 2
    #: shared bytes (over all families) as a part of the longer record's bytes
    coverage: float = 0.05
    #: records that share a chunk; a chunk of more gives no candidates (the rare words do)
    hot_chunk: int = 32
    #: shared keys that a record carries with each of its postings; beyond, pairs are summed up
    carried_keys: int = 64
    #: candidate pairs (to find their texts) and keys that may be broadcast
    broadcast_pairs: int = 1_000_000
    #: words with a place of their own in the order by frequency, the rest counts as rarest
    ranked_tokens: int = 1_000_000
    #: postings of one word that are compared in one task
    hot_token: int = 32_768
    #: postings of one word from which on its earliest record is compared with all others first
    crowd: int = 2_000
    #: hash ranges of the stored tables
    buckets: int = 16


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    out = np.empty(n + 1, dtype=np.uint64)
    out[0] = 1
    if n:
        out[1:] = _SPAN
        np.multiply.accumulate(out, out=out)
    return out


def _cut(ends: list[int], spans, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of each span: up to the next boundary that leaves ``least`` words, or the span's end."""
    first, last, at = [], [], 0
    for s, e in spans:
        a = s
        while at < len(ends) and ends[at] < s:
            at += 1
        while at < len(ends) and ends[at] < e:
            b = ends[at] + 1
            if b - a >= least:
                first.append(a)
                last.append(b)
                a = b
            at += 1
        if a < e:
            first.append(a)
            last.append(e)
    return np.array(first, dtype=np.int64), np.array(last, dtype=np.int64)


def _numbered_tokens(h: np.ndarray, doc_of: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """The words of each text as 32-bit hashes, numbered by repeat; clashes only add to what two texts share."""
    half = h >> np.uint64(32)
    place = np.lexsort((half, doc_of))
    half, doc = half[place], doc_of[place]
    first = np.ones(len(half), dtype=bool)
    first[1:] = (half[1:] != half[:-1]) | (doc[1:] != doc[:-1])
    at = np.arange(len(half))
    repeat = at - np.maximum.accumulate(np.where(first, at, 0))
    token = (_mix(half * _SPAN + repeat.astype(np.uint64) * _ROLL) >> np.uint64(32)).astype(np.uint32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(token.view(np.int32)))


def signature_arrays(texts: list[str | None], params: ChunkParams, hasher: WordHasher):
    """Kept positions, word counts, bag hashes, byte lengths, chunk and word lists of a batch of texts."""
    tokens: list[str] = []
    kept, counts = [], []
    for i, text in enumerate(texts):
        w = words(text)
        if len(w) >= params.min_words:
            kept.append(i)
            counts.append(len(w))
            tokens += w
    if not kept:
        return [], None
    n = np.array(counts, dtype=np.int64)
    stop = np.cumsum(n)
    start = stop - n
    h = hasher.array(tokens)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1
    total = np.add.reduceat(lengths, start).astype(np.int32)
    bag_a = np.add.reduceat(_mix(h), start)
    bag_b = np.add.reduceat(_mix(h * _ROLL + np.uint64(1)), start)
    if not params.families:
        empty = pa.nulls(len(n), pa.list_(pa.struct([("h", pa.int64()), ("bytes", pa.int32())])))
        return kept, (n.astype(np.int32), bag_a.view(np.int64), bag_b.view(np.int64), total, empty, pa.nulls(len(n), pa.list_(pa.int32())))
    roll = h.copy()
    roll[1:] += h[:-1] * _ROLL
    roll[start] = h[start]
    roll = _mix(roll)
    # hash of words[a:b] is sum of h[i] * P^(i-a): prefix sums of h[i] * P^i, times P^-a
    power = _powers(len(h))
    inverse = pow(int(_SPAN), -1, 1 << 64)
    back = np.empty(len(h) + 1, dtype=np.uint64)
    back[0] = 1
    back[1:] = np.uint64(inverse)
    np.multiply.accumulate(back, out=back)
    doc_of = np.repeat(np.arange(len(n)), n)
    short = n <= params.short_words
    parts = []
    for family in range(4):
        fine = family == 3
        if not fine and family >= params.families or fine and not short.any():
            continue
        words_, sizes, bits = h, lengths, roll
        if family == BAG_FAMILY:
            # the words in the order of their hashes: a text with its sentences in another order
            # has the same stream, and an edit reaches two chunks at most
            place = np.lexsort((h, doc_of))
            words_, sizes = h[place], lengths[place]
            bits = _mix(words_ * _ROLL)
        mean, least = (params.fine_mean, params.fine_min) if fine else (params.chunk_mean, params.bag_min if family == BAG_FAMILY else params.chunk_min)
        ends = np.flatnonzero((bits >> np.uint64(16 * family)) % np.uint64(mean) == 0)
        spans = (start[short], stop[short]) if fine else (start, stop)
        a, b = _cut(ends.tolist(), zip(*(x.tolist() for x in spans)), least)
        prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mix(words_) * power[:-1], dtype=np.uint64)])
        reach = np.concatenate([[0], np.cumsum(sizes)])
        tag = np.uint64(family)
        value = _mix((prefix[b] - prefix[a]) * back[a] + np.array([tag]) * _ROLL)
        # the lowest two bits name the family, so that neighbours in the list are known to be neighbours in the text
        parts.append((doc_of[a], np.full(len(a), family), a, (value & ~np.uint64(3)) | tag, (reach[b] - reach[a]).astype(np.int32)))
    doc, fam, a, value, size = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((a, fam, doc))
    doc, value, size = doc[order], value[order], size[order]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))]).astype(np.int32)
    chunks = pa.ListArray.from_arrays(
        pa.array(offsets),
        pa.StructArray.from_arrays(
            [pa.array(value.view(np.int64)), pa.array(size)], names=["h", "bytes"]
        ),
    )
    return kept, (n.astype(np.int32), bag_a.view(np.int64), bag_b.view(np.int64), total, chunks, _numbered_tokens(h, doc_of, n))


def signatures(texts: DataFrame, params: ChunkParams) -> DataFrame:
    """``texts(id, ts, content)`` -> one row of hashes a text that is long enough."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            kept, out = signature_arrays(batch.column("content").to_pylist(), params, hasher)
            if not kept:
                continue
            at = pa.array(kept)
            ids, (n, bag_a, bag_b, total, chunks, tokens) = batch.column("id").take(at), out
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid").take(at), ids, batch.column("ts").take(at), pa.array(n), pa.array(bag_a), pa.array(bag_b), pa.array(total), chunks, tokens],
                names=["rid", "id", "ts", "n_words", "bag_a", "bag_b", "n_bytes", "chunks", "tokens"],
            )

    source = texts.where("id is not null and ts is not null and content is not null").select(F.xxhash64("id").alias("rid"), "id", "ts", "content")
    return source.mapInArrow(run, SIGNATURE)


def _postings(reps: DataFrame) -> DataFrame:
    """(k, rid, n_words, n_bytes, bytes): a row a chunk."""
    return reps.select("rid", "n_words", "n_bytes", F.explode("chunks").alias("c")).select(F.col("c.h").alias("k"), "rid", "n_words", "n_bytes", "c.bytes")


def _shared_postings(postings: DataFrame, params: ChunkParams, scratch: Scratch) -> DataFrame:
    """Postings of the chunks that 2 to ``hot_chunk`` records hold.

    Chunks are counted before anything is shuffled by chunk (one row a task and chunk), so a
    chunk of a third of all records gathers nowhere.
    """
    counts = scratch.keep(postings.groupBy("k").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "chunk-counts")
    hot = counts.where(F.col("df") > params.hot_chunk).select("k")
    few = hot.count() <= params.broadcast_pairs
    calm = postings.join(F.broadcast(hot), "k", "left_anti") if few else postings
    shared = counts.where(F.col("df") <= params.hot_chunk).select("k")
    return scratch.keep(calm.join(shared, "k", "left_semi").select("k", "rid", "old", "n_words", "n_bytes", "bytes"), "shared")


def candidate_pairs(reps: DataFrame, params: ChunkParams, scratch: Scratch, history: DataFrame | None = None) -> DataFrame:
    """(a, b, old): pairs of records whose shared chunk bytes cover enough of the longer one.

    With ``history`` (stored postings of the chunks that the new records hold) the new records also
    meet the stored ones (``old``); stored records do not meet each other again.
    """
    postings = _postings(reps).withColumn("old", F.lit(False))
    if history is not None:
        postings = postings.unionByName(history.withColumn("old", F.lit(True)))
    left = _shared_postings(postings, params, scratch)

    def listed(postings: DataFrame) -> DataFrame:
        return postings.groupBy("rid", "old", "n_words", "n_bytes").agg(F.collect_set(F.struct("k", "bytes")).alias("keys"))

    def side(lists: DataFrame, names: str) -> DataFrame:
        # the same columns in the same order on both sides, so that one exchange serves both
        carried = F.when(F.size("keys") <= params.carried_keys, F.col("keys"))
        rows = lists.select(F.explode("keys").alias("key"), "old", "rid", "n_words", "n_bytes", carried.alias("keys"))
        return rows.select("key.k", "key.bytes", "old", "rid", "n_words", "n_bytes", "keys").toDF(*names.split())

    lists = scratch.keep(listed(left), "lists")
    a = side(lists, "k bytes old a n_a size_a keys_a")
    b = side(lists if history is None else lists.where("not old"), "k_b bytes_b old_b b n_b size_b keys_b")
    longest, shortest = F.greatest("n_a", "n_b"), F.least("n_a", "n_b")
    met = a.join(b, (F.col("k") == F.col("k_b")) & (F.col("old") | (F.col("a") < F.col("b"))) & (shortest >= params.similarity * longest))
    met = met.withColumn("size", F.greatest("size_a", "size_b"))
    enough = params.coverage * params.families * F.col("size")
    # a record carries the keys it shares, so a pair is judged whole where its least common key
    # brings it together, and pairs are not shuffled
    both = F.col("keys_a").isNotNull() & F.col("keys_b").isNotNull()
    common = met.where(both).select("a", "b", "old", "k", "size", F.array_intersect("keys_a", "keys_b").alias("common"))
    shared = F.aggregate("common", F.lit(0), lambda total, c: total + c["bytes"])
    out = common.where((F.array_min("common")["k"] == F.col("k")) & (shared >= enough)).select("a", "b", "old")
    if lists.where(F.size("keys") > params.carried_keys).isEmpty():
        return out
    # records with too many shared keys to carry (long texts) have their pairs summed up
    summed = met.where(~both).groupBy("a", "b", "old", "size").agg(F.sum("bytes").alias("shared")).where(F.col("shared") >= enough)
    return out.unionByName(summed.select("a", "b", "old"))


def token_counts(reps: DataFrame, params: ChunkParams, scratch: Scratch) -> DataFrame:
    """(k, df) of the most frequent words, at most ``ranked_tokens``."""
    counts = scratch.keep(reps.select(F.explode("tokens").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "tokens")
    least = 2
    while counts.where(F.col("df") >= least).count() > params.ranked_tokens:
        least *= 2
    return counts.where(F.col("df") >= least)


def prefix_postings(reps: DataFrame, order: DataFrame, params: ChunkParams) -> DataFrame:
    """(k, rid, n_words, s0..s3): a row for each of a record's rarest words, with its sketch.

    Records that match share a word of these, whatever the order is, as long as it is the same
    one for both.  ``order`` is bounded by ``ranked_tokens``.
    """
    known = order.toArrow()
    k, df = known.column("k").to_numpy(), known.column("df").to_numpy()
    place = np.argsort(k)
    held = reps.sparkSession.sparkContext.broadcast((k[place], df[place]))

    def run(batches):
        ks, dfs = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("tokens")
            token = lists.flatten().to_numpy()
            n = np.asarray(lists.value_lengths()).astype(np.int64)
            start = np.cumsum(n) - n
            doc = np.repeat(np.arange(len(n)), n)
            df = np.zeros(len(token), dtype=np.int64)
            if len(ks):
                at = np.minimum(np.searchsorted(ks, token), len(ks) - 1)
                df = np.where(ks[at] == token, dfs[at], 0)
            bit = _mix(token.view(np.uint32).astype(np.uint64) * _ROLL) & np.uint64(255)
            one = np.uint64(1) << (bit & np.uint64(63))
            sketch = [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == i, one, np.uint64(0)), start).view(np.int64) for i in range(4)]
            rare = np.lexsort((token, df, doc))
            need = np.ceil(params.similarity * n - 1e-9).astype(np.int64)
            taken = rare[np.arange(len(token)) - start[doc] < (n - need + 1)[doc]]
            # the position in the sorted run is the position in the text's range, as runs keep their place
            owner = pa.array(doc[taken])
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[taken]), batch.column("rid").take(owner), batch.column("n_words").take(owner), *(pa.array(s[doc[taken]]) for s in sketch)],
                names=["k", "rid", "n_words", "s0", "s1", "s2", "s3"],
            )

    return reps.select("rid", "n_words", "tokens").mapInArrow(run, PREFIXES)


def _close(rid: np.ndarray, n: np.ndarray, s: np.ndarray, left: np.ndarray, right: np.ndarray | None, params: ChunkParams):
    """Pairs of rows (left x right, or each two of left) whose sketches differ by no more than matching texts can."""
    need = 2 * np.ceil(params.similarity * n - 1e-9).astype(np.int32)
    left = left[np.argsort(n[left], kind="stable")]
    right_ = left if right is None else right[np.argsort(n[right], kind="stable")]
    n_right = n[right_]
    out_i, out_j = [], []
    for a in range(0, len(left), 256):
        i = left[a : a + 256]
        low = a if right is None else np.searchsorted(n_right, params.similarity * n[i[0]] - 1e-6)
        high = np.searchsorted(n_right, n[i[-1]] / params.similarity + 1e-6, "right")
        for b in range(low, high, 4096):
            j = right_[b : min(b + 4096, high)]
            # |A| + |B| - 2 |A and B| is at least the number of bits that differ
            most = n[i][:, None] + n[j][None, :] - np.maximum(need[i][:, None], need[j][None, :])
            x, y = np.nonzero(np.bitwise_count(s[0][i][:, None] ^ s[0][j][None, :]) <= most)
            if right is None:
                later = b + y > a + x
                x, y = x[later], y[later]
            x_, y_ = i[x], j[y]
            differ = sum(np.bitwise_count(c[x_] ^ c[y_]).astype(np.int32) for c in s)
            ok = (differ <= most[x, y]) & (rid[x_] != rid[y_])
            out_i.append(x_[ok])
            out_j.append(y_[ok])
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (none, none)


def _met(columns: list[np.ndarray], params: ChunkParams) -> pa.RecordBatch:
    """Pairs of whole groups: rows sorted by (k, block_a, block_b)."""
    k, block_a, block_b, side, old, free, rid, n, *s = columns
    s = [c.view(np.uint64) for c in s]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (block_a[1:] != block_a[:-1]) | (block_b[1:] != block_b[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(k)))
    out_i, out_j = [], []

    def add(left, right=None):
        if len(left) and (right is None or len(right)):
            i, j = _close(rid, n, s, left, right, params)
            out_i.append(i)
            out_j.append(j)

    # small groups: row i meets row i + d, all groups at once; the sides matter in cut groups only
    small = np.repeat(size <= 32, size) & (block_b < 0)
    group = np.cumsum(new)
    need = 2 * np.ceil(params.similarity * n - 1e-9).astype(np.int32)
    live, d = np.flatnonzero(small), 1
    while len(live):
        live = live[live + d < len(k)]
        live = live[group[live] == group[live + d]]
        i, j = live, live + d
        differ = sum(np.bitwise_count(c[i] ^ c[j]).astype(np.int32) for c in s) if len(i) else np.empty(0)
        ok = (differ <= n[i] + n[j] - np.maximum(need[i], need[j])) & ~(old[i] & old[j]) & (free[i] | free[j])
        out_i.append(i[ok])
        out_j.append(j[ok])
        d += 1
    for a, m in zip(start, size):
        if m < 2 or small[a]:
            continue
        at = np.arange(a, a + m)
        o, f, right = old[a : a + m], free[a : a + m], side[a : a + m] == 1
        if block_a[a] == block_b[a]:
            # two free rows, or a free row and a tied one; at least one of them new
            add(at[f & ~o])
            add(at[f & ~o], at[o])
            add(at[f & ~o], at[~f & ~o])
            add(at[f & o], at[~f & ~o])
        else:
            for one, other in ((~right, right), (right, ~right)):
                if one is not right:
                    add(at[f & one & ~o], at[f & other])
                    add(at[f & one & o], at[f & other & ~o])
                add(at[f & one & ~o], at[~f & other])
                add(at[f & one & o], at[~f & other & ~o])
    i, j = (np.concatenate(c) if c else np.empty(0, dtype=np.int64) for c in (out_i, out_j))
    # a stored record comes first, else the smaller number
    swap = ~old[i] & (old[j] | (rid[j] < rid[i]))
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    pairs = pa.table([pa.array(rid[i]), pa.array(rid[j]), pa.array(old[i])], names=["a", "b", "old"])
    return pairs.group_by(["a", "b", "old"]).aggregate([]).combine_chunks()


def exact_pairs(postings: DataFrame, params: ChunkParams, scratch: Scratch, calm: bool = False) -> DataFrame:
    """(a, b, old), with repeats: pairs that share one of their rarest words and may match by their
    sketches.

    ``postings``: those of ``prefix_postings`` with ``old`` and ``free``; two stored records do not
    meet, nor do two that are not free.  ``calm``: no word is known to have too many postings.
    """
    hot = None
    if not calm:
        counts = postings.groupBy("k").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > params.hot_token)
        hot = scratch.keep(counts.select("k", F.ceil(F.col("held") / params.hot_token).cast("int").alias("blocks")), "hot-tokens")
    rest = ["old", "free", "rid", "n_words", "s0", "s1", "s2", "s3"]
    whole = [F.lit(-1).alias("block_a"), F.lit(-1).alias("block_b"), F.lit(0).alias("side")]
    if hot is None or hot.isEmpty():
        work = postings.select("k", *whole, *rest)
    else:
        marked = postings.join(F.broadcast(hot), "k", "left")  # at most postings / hot_token rows
        calm = marked.where("blocks is null").select("k", *whole, *rest)
        own = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
        loud = marked.where("blocks is not null").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        loud = loud.select("k", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"), (F.col("own") > F.col("other")).cast("int").alias("side"), *rest)
        work = calm.unionByName(loud)
    keys = ["k", "block_a", "block_b"]

    def run(batches):
        waiting: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            last = [c[-1] for c in waiting[-1][:3]]
            if rows < 100_000 or all(c[0] == x for c, x in zip(waiting[0][:3], last)):
                continue
            columns = [np.concatenate(c) for c in zip(*waiting)]
            # the last group may go on in the next batch
            cut = int(np.argmax((columns[0] == last[0]) & (columns[1] == last[1]) & (columns[2] == last[2])))
            yield from _met([c[:cut] for c in columns], params).to_batches()
            waiting, rows = [[c[cut:] for c in columns]], len(columns[0]) - cut
        if waiting:
            yield from _met([np.concatenate(c) for c in zip(*waiting)], params).to_batches()

    sorted_ = work.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "side", *rest)
    return sorted_.mapInArrow(run, "a long, b long, old boolean")


def word_matches(postings: DataFrame, records: DataFrame, params: ChunkParams, scratch: Scratch) -> DataFrame:
    """Candidates (a, b, old) by rare words over ``postings`` (those of ``prefix_postings`` with
    ``old``): all pairs that may match, but for pairs of records that are copies for certain."""
    free = postings.withColumn("free", F.lit(True))
    crowded = scratch.keep(postings.groupBy("k").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > params.crowd).select("k"), "crowded")
    if crowded.isEmpty():
        return exact_pairs(free, params, scratch, calm=params.crowd <= params.hot_token)
    known = F.broadcast(crowded)  # at most postings / crowd rows
    first = postings.select("k", "rid").join(known, "k").join(records.select("rid", "ts", "id"), "rid").groupBy("k").agg(F.min(F.struct("ts", "id", "rid")).alias("first"))
    leaders = scratch.keep(first.select("first.rid", F.lit(True).alias("leads")).distinct(), "leaders")
    marked = scratch.keep(postings.join(F.broadcast(leaders), "rid", "left").withColumn("free", F.coalesce("leads", F.lit(False))).drop("leads"), "led")
    # only words that a leader holds can bring a pair
    held = marked.where("free").select("k").distinct()
    led = scratch.keep(exact_pairs(marked.join(held, "k", "left_semi"), params, scratch).distinct(), "led-pairs")
    matches = scratch.keep(verified(led, records, params, scratch), "led-matches").select(F.col("a.rid").alias("a"), F.col("b.rid").alias("b"))
    # a leader without an earlier match is accepted whatever comes
    sure = leaders.select(F.col("rid").alias("a")).join(matches.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    copies = scratch.keep(matches.join(F.broadcast(sure), "a").select(F.col("b").alias("rid"), F.lit(True).alias("copy")).distinct(), "sure-copies")
    rest = marked.where("not free").join(copies, "rid", "left").withColumn("free", F.col("copy").isNull()).drop("copy")
    return led.unionByName(exact_pairs(scratch.keep(rest, "rest"), params, scratch))


def verified(pairs: DataFrame, records: DataFrame, params: ChunkParams, scratch: Scratch) -> DataFrame:
    """The check of every pair: words shared with repeats against the words of the longer text.

    Words are compared as the 32-bit hashes, numbered by repeat, of ``records(rid, id, ts,
    tokens)``: two words of a pair of 30 words each clash once in five million pairs, which tells
    only where the pair is a word short.  Returns (a, b) as structs (ts, id, rid), a being the
    earlier of the two, or the stored one.
    """
    place = F.struct("ts", "id", "rid")
    left = records.select(F.col("rid").alias("a"), place.alias("at_a"), F.col("tokens").alias("w_a"))
    right = records.select(F.col("rid").alias("b"), place.alias("at_b"), F.col("tokens").alias("w_b"))
    # one original may have a third of all records as its copies
    both = lookup(lookup(pairs, left, "a", scratch), right, "b", scratch, hot=hot_keys(pairs, "b", scratch))
    shared = F.size(F.array_intersect("w_a", "w_b"))
    same = both.where(shared >= F.lit(params.similarity) * F.greatest(F.size("w_a"), F.size("w_b")) - 1e-9)
    first = F.when(F.col("old"), F.col("at_a")).otherwise(F.least("at_a", "at_b"))
    second = F.when(F.col("old"), F.col("at_b")).otherwise(F.greatest("at_a", "at_b"))
    return same.select(first.alias("a"), second.alias("b"))


def accept_in_order(matches: DataFrame, scratch: Scratch, settled: DataFrame | None = None) -> DataFrame:
    """Copies among the matched records: (b, a) with a the earliest accepted match of b.

    A record is accepted when no earlier accepted record matches it.  Round by round, records
    without an undecided earlier match are accepted and their later matches become copies; the
    edges left over are those between undecided records.  ``settled``: matches whose earlier
    end is in the history, hence accepted already.
    """
    edges = scratch.keep(matches, "matches")
    found = settled
    every = [found] if found is not None else []
    if settled is not None:
        edges = scratch.keep(edges.join(settled.select("b").distinct(), "b", "left_anti").join(settled.select(F.col("b").alias("a")).distinct(), "a", "left_anti").select("a", "b"), "open")
    while not edges.isEmpty():
        waiting = edges.select(F.col("b").alias("a")).distinct()
        decided = scratch.keep(edges.join(waiting, "a", "left_anti").select("a", "b"), "decided")
        every.append(decided)
        copies = decided.select("b").distinct()
        rest = edges.join(copies, "b", "left_anti").join(copies.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b")
        left = scratch.keep(rest, "edges")
        scratch.drop(edges)
        edges = left
    if not every:
        return matches.groupBy("b").agg(F.min("a").alias("a"))
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out.groupBy("b").agg(F.min("a").alias("a"))


def find_copies(texts: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """One batch upon an empty state: ``texts(id, ts long, content)`` -> (original_id, copy_id)."""
    return AcceptedTexts(texts.sparkSession, Scratch(texts.sparkSession, "accepted").root, params).process(texts)


class AcceptedTexts:
    """Persistent state, each table in hash ranges of its key (``bucket``, a partition column):
    ``records`` (by record: id, time, words as hashes), ``postings`` (by chunk: its records), ``prefixes`` (by
    rare word: its records); and ``order``, the frequent words of the first batch.

    A batch of any size gives the same decisions, one week or all of them, since records are
    taken in order of (ts, id) either way.  Accepted texts are appended; ``compact`` rewrites a
    table whose batches left many small files.
    """

    RECORDS = "rid long, id string, ts long, tokens array<int>, bucket int"
    POSTINGS = "k long, rid long, n_words int, n_bytes int, bytes int, bucket int"
    PREFIX_ROWS = PREFIXES + ", bucket int"

    def __init__(self, spark: SparkSession, path: str, params: ChunkParams = ChunkParams()):
        self.spark, self.path, self.params = spark, path.rstrip("/"), params

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return self.spark.read.schema(schema).parquet(path)
        return self.spark.createDataFrame([], schema)

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.params.buckets)).cast("int")

    def _append(self, df: DataFrame, name: str, key: str) -> None:
        # few files a bucket where the batch is small, more tasks a bucket where it is large
        rows = df.withColumn("bucket", self._bucket(key)).hint("rebalance", "bucket")
        rows.write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def compact(self, name: str) -> None:
        """Few files a bucket; the old files go only after the new ones are written."""
        schema = {"records": self.RECORDS, "postings": self.POSTINGS, "prefixes": self.PREFIX_ROWS}[name]
        rows = self._read(name, schema).hint("rebalance", "bucket")
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{name}-new")
        jvm = self.spark.sparkContext._jvm
        old, new = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}{end}") for end in ("", "-new"))
        fs = old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(old, True)
        fs.rename(new, old)

    def _touched(self, name: str, schema: str, keys: DataFrame, key: str) -> DataFrame:
        """The stored rows of the given keys: the buckets they lie in, and a join that shuffles the
        stored side only where the keys are too many to send."""
        stored = self._read(name, schema)
        there = sorted(r[0] for r in keys.select(self._bucket(key)).distinct().collect())  # at most ``buckets`` numbers
        few = keys.count() <= self.params.broadcast_pairs
        met = stored.where(F.col("bucket").isin(there)).join(F.broadcast(keys) if few else keys, key, "left_semi")
        return met.drop("bucket")

    def _order(self, reps: DataFrame, scratch: Scratch) -> DataFrame:
        """The order of words, fixed by the first batch: prefixes meet under one order only."""
        schema = "k int, df long"
        order = self._read("order", schema)
        if order.isEmpty() and self._read("prefixes", self.PREFIX_ROWS).isEmpty():
            token_counts(reps, self.params, scratch).write.mode("overwrite").parquet(f"{self.path}/order")
            order = self._read("order", schema)
        return order

    def process(self, batch: DataFrame) -> DataFrame:
        """``batch(id, ts, content)`` -> (original_id, copy_id); accepted texts are appended.

        Batches must come in order of time; a row older than the history is compared with it
        all the same and its match in the history counts as the earlier one.
        """
        p, scratch = self.params, Scratch(self.spark, "dedup")
        batch = batch.select("id", "ts", "content")
        first = F.struct("ts", "id", "rid")
        one = signatures(batch, p).groupBy("bag_a", "bag_b").agg(
            F.min(first).alias("first"), F.min("n_words").alias("n_words"), F.min("n_bytes").alias("n_bytes"), F.min_by("chunks", first).alias("chunks"), F.min_by("tokens", first).alias("tokens")
        )
        reps = scratch.keep(one.select("bag_a", "bag_b", "first.ts", "first.id", "first.rid", "n_words", "n_bytes", "chunks", "tokens"), "records")
        empty = self._read("records", self.RECORDS).isEmpty()
        chunks = None
        if not empty:
            keys = scratch.keep(reps.select(F.explode("chunks.h").alias("k")).distinct(), "chunk-keys")
            chunks = scratch.keep(self._touched("postings", self.POSTINGS, keys, "k"), "met-chunks")
        chunked = scratch.keep(candidate_pairs(reps, p, scratch, chunks), "chunked")
        prefixes = scratch.keep(prefix_postings(reps, self._order(reps, scratch), p), "prefixes")
        postings = prefixes.withColumn("old", F.lit(False))
        if not empty:
            keys = scratch.keep(prefixes.select("k").distinct(), "word-keys")
            postings = scratch.keep(postings.unionByName(self._touched("prefixes", self.PREFIX_ROWS, keys, "k").withColumn("old", F.lit(True))), "met-words")
        old = scratch.keep(chunked.where("old").select(F.col("a").alias("rid")).union(postings.where("old").select("rid")).distinct(), "met-records") if not empty else None
        known = reps.select("rid", "id", "ts", "tokens")
        if not empty:
            known = known.unionByName(scratch.keep(self._touched("records", self.RECORDS, old, "rid"), "met-words-of"))
        by_words = word_matches(postings, known, p, scratch)
        pairs = scratch.keep(chunked.unionByName(by_words).distinct(), "candidates")
        matches = scratch.keep(verified(pairs, known, p, scratch), "verified")
        if empty:
            copies = scratch.keep(accept_in_order(matches, scratch), "copies")
        else:
            stored = old.select("rid")
            settled = scratch.keep(matches.join(stored, F.col("a.rid") == F.col("rid"), "left_semi"), "settled")
            inner = matches.join(stored, F.col("a.rid") == F.col("rid"), "left_anti")
            copies = scratch.keep(accept_in_order(inner, scratch, settled), "copies")
        out = scratch.keep(self._expand(reps, copies, batch, scratch), "result")
        copied = copies.select(F.col("b.rid").alias("rid"))
        accepted = reps.join(copied, "rid", "left_anti")
        scratch.clear(but=(out, copies, reps, prefixes))
        self._append(accepted.select("rid", "id", "ts", "tokens"), "records", "rid")
        self._append(prefixes.join(copied, "rid", "left_anti"), "prefixes", "k")
        self._append(_postings(accepted), "postings", "k")
        scratch.clear(but=(out,))
        return out

    def _expand(self, reps: DataFrame, copies: DataFrame, batch: DataFrame, scratch: Scratch) -> DataFrame:
        """From records to rows: each row of a bag follows its first row's decision."""
        near = copies.select("b.rid", F.col("a.id").alias("original"))
        groups = reps.select("bag_a", "bag_b", "rid", F.col("id").alias("rep_id")).join(near, "rid", "left").drop("rid")
        # a second reading of the texts, for the bag hashes alone, takes less than carrying the rows along
        rows = scratch.keep(signatures(batch, replace(self.params, families=0)).select("id", "bag_a", "bag_b"), "members")
        out = lookup(rows, groups, ["bag_a", "bag_b"], scratch).select(F.coalesce("original", "rep_id").alias("original_id"), F.col("id").alias("copy_id"))
        return out.where("original_id <> copy_id").distinct()


def feed(state: AcceptedTexts, texts: DataFrame, bounds: list[int]) -> list[DataFrame]:
    """The results of feeding ``texts(id, ts, content)`` to the state in batches that end at ``bounds``
    (exclusive; the last one has no end)."""
    edges = [None, *sorted(set(bounds)), None]
    out = []
    for low, high in zip(edges, edges[1:]):
        part = texts
        if low is not None:
            part = part.where(F.col("ts") >= low)
        if high is not None:
            part = part.where(F.col("ts") < high)
        out.append(state.process(part))
    return out
