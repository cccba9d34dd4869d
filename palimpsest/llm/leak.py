"""Problem 8 - evaluation texts inside training texts.

Method: prefix-filtered set join.  An item's windows of ``window`` consecutive words are sets of
five-word shingles.  A document contains a window only if it contains all its shingles, so the
necessary prefix is one token: the rarest shingle of the window, by its count over the whole
corpus.  Prefix tokens are joined with the documents' shingles; the position of the shingle in
the window bounds where the window must stand in the document; the words there are compared
exactly.

Result for the unusual cases
* null texts, and texts of fewer than ``window`` words: in no match.
* repeated documents each come out under their own doc_id; repeated items likewise.
* items that share a passage each come out.  Empty tables: empty result.

Scale and skew: documents are read once; only shingles that occur in an item leave the scan
(tested against the item shingles inside the scan while those stay under ``broadcast_shingles``,
by a shuffle join beyond).  The item side of the key join is small, so a passage copied into a
third of all documents is spread over the scan's tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.words import WordHasher, words
from palimpsest.runtime import Scratch

SHINGLE = 5
WINDOW = 10
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five word hashes."""
    if len(h) < SHINGLE:
        return np.empty(0, dtype=np.uint64)
    n = len(h) - SHINGLE + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(SHINGLE):
        out = out * _BASE + h[j : j + n]
    return out ^ (out >> np.uint64(31))


def item_windows(items: DataFrame, id_col: str, text_cols: list[str], window: int) -> DataFrame:
    """(item_id, field, start, text, shingles): every window of every text of an item."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            rows = {"item_id": [], "field": [], "start": [], "text": [], "shingles": []}
            for i, field, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "field", "text"))):
                w = words(text)
                if len(w) < window:
                    continue
                s = shingle_hashes(hasher.array(w)).view(np.int64).tolist()
                for a in range(len(w) - window + 1):
                    for name, value in zip(rows, (i, field, a, " ".join(w[a : a + window]), s[a : a + window - SHINGLE + 1])):
                        rows[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["item_id"], pa.int64()), pa.array(rows["field"], pa.string()), pa.array(rows["start"], pa.int32()), pa.array(rows["text"], pa.string()), pa.array(rows["shingles"], pa.list_(pa.int64()))],
                names=list(rows),
            )

    texts = [items.select(F.col(id_col).cast("long").alias("item_id"), F.lit(c).alias("field"), F.col(c).alias("text")) for c in text_cols]
    all_texts = texts[0]
    for t in texts[1:]:
        all_texts = all_texts.unionByName(t)
    return all_texts.where("item_id is not null and text is not null").mapInArrow(run, "item_id long, field string, start int, text string, shingles array<long>")


def document_shingles(documents: DataFrame, id_col: str, text_col: str, window: int, known: np.ndarray) -> DataFrame:
    """(doc_id, shingle, before, around): the shingles of each document that are in ``known``, with
    the words around, ``before`` of which stand in front of the shingle."""
    reach = window - SHINGLE

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            doc, sh, before, around = [], [], [], []
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                w = words(text)
                if len(w) < window:
                    continue
                s = shingle_hashes(hasher.array(w))
                if len(known):
                    k = np.searchsorted(known, s)
                    at = np.flatnonzero(known[np.minimum(k, len(known) - 1)] == s).tolist()
                else:
                    at = ()
                signed = s.view(np.int64)
                for p in at:
                    a = max(0, p - reach)
                    doc.append(d)
                    sh.append(int(signed[p]))
                    before.append(p - a)
                    around.append(" ".join(w[a : p + window]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(sh, pa.int64()), pa.array(before, pa.int32()), pa.array(around, pa.string())], names=["doc_id", "shingle", "before", "around"])

    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    return source.mapInArrow(run, "doc_id long, shingle long, before int, around string")


def _around(documents: DataFrame, hits: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``hits(doc_id, shingle, at)`` with the words around, as ``document_shingles`` gives them."""
    reach = window - SHINGLE

    def run(batches):
        for batch in batches:
            doc, sh, before, around = [], [], [], []
            for d, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "hits"))):
                w = words(text)
                for hit in found:
                    p = hit["at"]
                    a = max(0, p - reach)
                    doc.append(d)
                    sh.append(hit["shingle"])
                    before.append(p - a)
                    around.append(" ".join(w[a : p + window]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(sh, pa.int64()), pa.array(before, pa.int32()), pa.array(around, pa.string())], names=["doc_id", "shingle", "before", "around"])

    lists = hits.groupBy("doc_id").agg(F.collect_list(F.struct("shingle", "at")).alias("hits"))  # of one text
    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null").join(lists, "doc_id")
    return source.mapInArrow(run, "doc_id long, shingle long, before int, around string")


def _positions(documents: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(doc_id, shingle, at): every shingle of every document, hashes alone."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            doc, sh, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                w = words(text)
                if len(w) >= window:
                    s = shingle_hashes(hasher.array(w)).view(np.int64)
                    doc.append(np.full(len(s), d, np.int64))
                    sh.append(s)
                    at.append(np.arange(len(s), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (doc, sh, at)], names=["doc_id", "shingle", "at"])

    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    return source.mapInArrow(run, "doc_id long, shingle long, at int")


def leaks(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_texts: tuple[str, ...] = ("question", "passage"), window: int = WINDOW, broadcast_shingles: int = 1_000_000, broadcast_windows: int = 500_000,
) -> DataFrame:
    """(doc_id, item_id, field, windows, part): how many windows of an item's text stand in the
    document, and which part of all its windows that is."""
    scratch = Scratch(documents.sparkSession, "leak")
    wins = scratch.keep(item_windows(items, item_id, list(item_texts), window), "windows")
    vocabulary = scratch.keep(wins.select(F.explode("shingles").alias("shingle")).distinct(), "item-shingles")
    if vocabulary.count() <= broadcast_shingles:
        known = np.sort(np.array([r[0] for r in vocabulary.collect()], dtype=np.int64).view(np.uint64))
        met = document_shingles(documents, doc_id, text, window, known)
    else:
        # hashes alone are shuffled; the words around are read where a document has a known shingle
        hits = scratch.keep(_positions(documents, doc_id, text, window).join(vocabulary, "shingle", "left_semi"), "hits")
        met = _around(documents, hits, doc_id, text, window)
    met = scratch.keep(met, "document-shingles")
    rarity = met.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    sized = wins.select("*", F.posexplode("shingles").alias("offset", "shingle")).drop("shingles").join(rarity, "shingle")
    key = ["item_id", "field", "start"]
    prefix = sized.groupBy(*key).agg(F.count(F.lit(1)).alias("found"), F.first("text").alias("text"), F.min(F.struct("df", "shingle", "offset")).alias("rarest"))
    prefix = scratch.keep(prefix.where(F.col("found") == window - SHINGLE + 1).select(*key, "text", "rarest.shingle", "rarest.offset"), "prefixes")
    # a passage in a third of all documents makes hot shingles: behind a check of its size the item
    # side is sent to the documents' tasks instead of gathering documents by shingle
    near = met.join(F.broadcast(prefix) if prefix.count() <= broadcast_windows else prefix, "shingle").where(F.col("before") >= F.col("offset"))
    stands = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("offset") + 1, window), " ")
    held = near.where(stands == F.col("text")).groupBy("doc_id", "item_id", "field", "start").agg(F.lit(1).alias("one"))
    total = wins.groupBy("item_id", "field").agg(F.count(F.lit(1)).alias("all"))
    out = held.groupBy("doc_id", "item_id", "field").agg(F.count(F.lit(1)).alias("windows")).join(total, ["item_id", "field"])
    return out.select("doc_id", "item_id", "field", "windows", (F.col("windows") / F.col("all")).alias("part"))
