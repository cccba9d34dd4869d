"""BM25 over an inverted index held as a frame.

The index is (term, id, tf) with document lengths; scoring joins it with the query terms, which
are broadcast behind a check of their number.  Statistics cover all documents.

Unusual cases: null or empty texts have no postings and no hits; a query without terms has no
hits; ties by id.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators.vectors import Best, in_order, joined
from palimpsest.runtime import Scratch

K1, B = 1.2, 0.75
#: query terms that may be sent to all tasks; more are joined by shuffle
MAX_TERMS = 200_000


def postings(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf, length): the inverted index of a tier's text."""
    words = rows.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    return words.select("id", F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("term", "id", "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25(rows: DataFrame, queries: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``queries(query_id, query)`` -> (query_id, id, score), unnormalised.

    Only the postings of query terms leave the scan; document count and average length come from a
    second pass over the tokens.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term"))
    tokens = rows.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    corpus = tokens.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("w")).alias("avg_length"))
    few = F.broadcast if terms.count() <= MAX_TERMS else (lambda df: df)
    met = tokens.select("id", F.size("w").alias("length"), F.explode("w").alias("term")).join(few(terms.select("term").distinct()), "term", "left_semi")
    tf = met.groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = tf.join(few(terms), "term").join(few(df), "term").crossJoin(F.broadcast(corpus))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    return scored.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def normalised(scores: DataFrame) -> DataFrame:
    """Scores divided by the best of their query (a partial maximum, not a window over all hits)."""
    best = scores.groupBy("query_id").agg(F.max("score").alias("_best"))
    return scores.join(best, "query_id").withColumn("score", F.col("score") / F.col("_best")).drop("_best")


def top(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best a query on the rounded score and id, with rank."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scores.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_top(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id", text_col: str = "content", digits: int = 6) -> DataFrame:
    """``top(normalised(bm25(..)), k)`` for stated queries, which come to the driver, without a row
    for every hit: queries of the same terms are scored once, and each task keeps the k best of
    each.  Documents are told apart by their id.
    """
    spark = rows.sparkSession
    asked = queries.select("query_id", F.array_sort(F.array_distinct(T.tokens(F.col("query")))).alias("terms")).where(F.size("terms") > 0).collect()
    kind = rows.schema[id_col].dataType.simpleString()
    named = {}
    for r in asked:
        named.setdefault(tuple(r["terms"]), []).append(r["query_id"])
    place = {t: i for i, t in enumerate(sorted({t for terms in named for t in terms}))}
    sets = [np.array([place[t] for t in terms]) for terms in named]
    words = spark.sparkContext.broadcast(place)
    pattern = re.compile("[a-z0-9]+")

    def counted(batches):
        place = words.value
        for batch in batches:
            length, terms, times = [], [], []
            for text in batch.column("text").to_pylist():
                found = pattern.findall(text)
                met = Counter(place[w] for w in found if w in place)
                length.append(len(found))
                terms.append(list(met))
                times.append(list(met.values()))
            arrays = [batch.column("id"), pa.array(length, pa.int32()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))]
            out = pa.RecordBatch.from_arrays(arrays, names=["id", "length", "terms", "times"])
            yield out.filter(pc.greater(out.column("length"), 0))

    scratch = Scratch(spark, "bm25")
    texts = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    docs = scratch.keep(texts.mapInArrow(counted, f"id {kind}, length int, terms array<int>, times array<int>"), "docs")
    n_docs, avg_length = docs.agg(F.count(F.lit(1)), F.avg("length")).first()
    df = np.zeros(len(place))
    for r in docs.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():
        df[r["t"]] = r["n"]
    state = spark.sparkContext.broadcast((sets, np.log(1 + (n_docs - df + 0.5) / (df + 0.5)), avg_length))

    def scored(batches):
        """(table of documents, number of the term set, scores of all the table's documents)"""
        sets, idf, avg_length = state.value
        for block in joined(batches):
            n = block.num_rows
            terms, times = (block.column(c).combine_chunks() for c in ("terms", "times"))
            doc = np.repeat(np.arange(n), terms.value_lengths().to_numpy())
            terms, times = terms.flatten().to_numpy(), times.flatten().to_numpy()
            part = idf[terms] * times * (K1 + 1) / (times + K1 * (1 - B + B * block.column("length").to_numpy()[doc] / avg_length))
            order = np.argsort(terms, kind="stable")
            doc, part = doc[order], part[order]
            first = np.searchsorted(terms[order], np.arange(len(idf) + 1))
            for q, own in enumerate(sets):
                spans = [slice(first[t], first[t + 1]) for t in own if first[t] < first[t + 1]]
                if spans:
                    yield block, q, np.bincount(np.concatenate([doc[s] for s in spans]), weights=np.concatenate([part[s] for s in spans]), minlength=n)

    def highest(batches):
        best = np.zeros(len(state.value[0]))
        for _, q, score in scored(batches):
            best[q] = max(best[q], score.max())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(best), dtype=np.int32)), pa.array(best)], names=["q", "best"])

    best = np.zeros(len(sets))
    for r in docs.mapInArrow(highest, "q int, best double").groupBy("q").agg(F.max("best").alias("best")).collect():
        best[r["q"]] = r["best"]
    whole = spark.sparkContext.broadcast(best)

    def keep(batches):
        whole_best = whole.value
        found, block, base = Best(len(whole_best), k, -np.inf), None, 0
        for now, q, score in scored(batches):
            if now is not block:
                block, base = now, found.begin(now.column("id"))
            # the rounded score decides; what lies clearly below the k-th is left out before
            met = np.flatnonzero(score > max(0.0, (found.least[q] - 10.0**-digits) * whole_best[q]))
            share = np.round(score[met] / whole_best[q], digits)
            more = share > found.least[q]
            if more.any():
                found.add_one(q, share[more], base + met[more])
        for q, ids, score in found.rows():
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), ids, pa.array(score)], names=["q", "id", "score"])

    part = in_order(docs.where(F.size("terms") > 0), len(sets) * k).mapInArrow(keep, f"q int, id {kind}, score double")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, name) for q, own in enumerate(named.values()) for name in own], f"q int, query_id {queries.schema['query_id'].dataType.simpleString()}")
    return part.join(F.broadcast(names), "q").select("query_id", "id", "score", "rank")


#: query rows whose word lists go to the tasks at once
MAX_TEXTS = 20_000


def similar_texts(rows: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """``rows(id, words array)``, ``queries(id)`` -> (query_id, id, jaccard) of the query rows
    against all rows, from ``threshold`` on; ids are unique.

    The stated queries come to the driver and go to the tasks as an inverted index, in blocks of
    ``MAX_TEXTS``, a scan each.  A row counts its common words with all queries at once, so no
    candidate pair is formed.
    """
    spark = rows.sparkSession
    lists = rows.where(F.size("words") > 0).select("id", F.array_distinct("words").alias("words"))
    asked = lists.join(queries.select("id").distinct(), "id", "left_semi").toArrow()
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, id {kind}, jaccard double"
    if not asked.num_rows:
        return spark.createDataFrame([], schema)
    even = lists.repartition(4 * spark.sparkContext.defaultParallelism, "id")
    parts = [_similar_to(even, asked.slice(at, MAX_TEXTS), threshold, schema) for at in range(0, asked.num_rows, MAX_TEXTS)]
    return reduce(DataFrame.unionByName, parts)


def _similar_to(lists: DataFrame, asked: pa.Table, threshold: float, schema: str) -> DataFrame:
    words = asked.column("words").combine_chunks()
    size = words.value_lengths().to_numpy()
    coded = words.flatten().dictionary_encode()
    term = coded.indices.to_numpy()
    order = np.argsort(term, kind="stable")
    holders = np.repeat(np.arange(len(size)), size)[order]
    first = np.searchsorted(term[order], np.arange(len(coded.dictionary) + 1))
    state = lists.sparkSession.sparkContext.broadcast((asked.column("id").combine_chunks(), coded.dictionary, size, holders, first))

    def run(batches):
        names, known, size, holders, first = state.value
        of = [holders[a:b] for a, b in zip(first.tolist(), first[1:].tolist())]
        # s / (n + m - s) >= t is s >= t / (1 + t) * (n + m)
        share = threshold / (1 + threshold)
        need = share * size - 1e-6
        for batch in batches:
            words, ids = batch.column("words"), batch.column("id")
            n = words.value_lengths().to_numpy()
            term = pc.index_in(words.flatten(), value_set=known).fill_null(-1).to_numpy()
            ends = np.cumsum(n)
            found = []
            for row, (a, b) in enumerate(zip((ends - n).tolist(), ends.tolist())):
                met = [of[t] for t in term[a:b].tolist() if t >= 0]
                if not met:
                    continue
                s = np.bincount(np.concatenate(met), minlength=len(size))
                q = np.flatnonzero(s >= need + share * (b - a))
                if len(q):
                    jaccard = s[q] / (size[q] + (b - a) - s[q])
                    good = jaccard >= threshold - 1e-9
                    found.append((q[good], np.full(good.sum(), row), jaccard[good]))
            if found:
                q, row, jaccard = (np.concatenate(c) for c in zip(*found))
                out = pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids.take(pa.array(row)), pa.array(jaccard)], names=["query_id", "id", "jaccard"])
                yield out.filter(pc.not_equal(out.column("query_id"), out.column("id")))

    return lists.mapInArrow(run, schema)


SUFFIXES = ("ational", "tional", "ization", "fulness", "ousness", "iveness", "ing", "edly", "ed", "ly", "ies", "es", "s")


def light_stem(word: str) -> str:
    """A light suffix stripper for English terms, kept apart from the unstemmed index."""
    for s in SUFFIXES:
        if word.endswith(s) and len(word) - len(s) >= 3:
            return word[: -len(s)] + ("y" if s == "ies" else "")
    return word
