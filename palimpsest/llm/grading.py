"""Problem 9 - reading level of documents.

Method: a document-word graph.  Documents and graded samples are joined to the words of their
prose, weighted by occurrences.  The samples' grades are clamped; difficulty is then propagated
by harmonic iterations: a word's value is the weighted mean of its texts, an ungraded text's
value the weighted mean of its words, a text's own share in a word always left out.  Cut points
between grades come from the samples' own left-out values.

Prose is what a reader reads: front matter, headings, fenced code, tables, page addresses, tags
and speaker marks are taken off.

Result for the unusual cases
* null text, no prose, or a kind without a grade: no row.
* a text none of whose words occurs elsewhere: value null.  Repeated documents each count.
* no graded samples: all null.

Scale and skew: word nodes are hashed into ``word_nodes`` values, so what is broadcast and
collected in an iteration is two numbers a node whatever the corpus; rows are pre-aggregated per
task.  The graph is written once and re-read by each iteration; no iteration shuffles edges.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.words import WordHasher, words
from palimpsest.runtime import Scratch

#: fixed values: kinds of documents that hold no graded prose
UNGRADED_KINDS = ("log", "config", "stub")

_FRONT = re.compile(r"\A\s*---[ \t]*\n.*?\n---[ \t]*(?:\n|\Z)", re.S)
_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.S | re.M)
_LINE = re.compile(r"^[ \t]*(?:#{1,6}[ \t].*|\|.*|.*\|.*\|.*|[-=*_ \t]{3,})$", re.M)
_TAG = re.compile(r"<[^<>\n]{1,200}>")
_URL = re.compile(r"\b(?:https?://|www\.)\S+")
_MARK = re.compile(r"^[ \t]*(?:[-*+][ \t]+|\d+[.)][ \t]+|>[ \t]*)*(?:\*\*\w+:\*\*|\[?\w+\]?:(?=[ \t]))?", re.M)


def prose(text: str) -> str:
    for pattern in (_FRONT, _FENCE, _LINE, _TAG, _URL, _MARK):
        text = pattern.sub(" ", text)
    return text


@dataclass(frozen=True)
class GradeParams:
    word_nodes: int = 1 << 17
    #: rounds go on until the words' values move by no more than ``settled`` on average (weighted
    #: by their occurrences), or there were ``rounds``
    rounds: int = 20
    settled: float = 0.005
    #: weight of all clamped samples together against all documents together
    graded_part: float = 6.0


def word_edges(texts: DataFrame, params: GradeParams) -> DataFrame:
    """``texts(key, text, grade)`` -> (key, grade, nodes, counts): the text's word nodes."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            key, nodes, counts, sizes, grade = [], [], [], [0], []
            column = zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("grade").to_pylist())
            for k, text, g in column:
                w = [x for x in words(prose(text)) if not any(map(str.isdigit, x))]
                if not w:
                    continue
                node, count = np.unique(hasher.array(w) % np.uint64(params.word_nodes), return_counts=True)
                key.append(k)
                grade.append(g)
                nodes.append(node.astype(np.int32))
                counts.append(count.astype(np.int32))
                sizes.append(sizes[-1] + len(node))
            if key:
                offsets = pa.array(np.array(sizes, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(grade, pa.float64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(nodes))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts)))],
                    names=["key", "grade", "nodes", "counts"],
                )

    return texts.where("key is not null and text is not null").select("key", "text", F.col("grade").cast("double").alias("grade")).mapInArrow(run, "key long, grade double, nodes array<int>, counts array<int>")


def _text_values(batch: pa.RecordBatch, score: np.ndarray, mass: np.ndarray, own: np.ndarray | None, weight: np.ndarray):
    """Left-out weighted mean over a text's words; ``own``: the value the text gave last round."""
    sizes = np.asarray(batch.column("nodes").value_lengths())
    node = batch.column("nodes").flatten().to_numpy(zero_copy_only=False)
    count = batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    s, m = score[node], mass[node]
    if own is not None:
        w = count * weight[row]
        there = ~np.isnan(own[row])
        s = s - np.where(there, w * np.nan_to_num(own)[row], 0)
        m = m - np.where(there, w, 0)
    known = m > 1e-6
    value = np.where(known, s / np.where(known, m, 1), 0)
    part = np.where(known, count, 0)
    total = np.bincount(row, weights=part, minlength=len(sizes))
    mean = np.bincount(row, weights=part * value, minlength=len(sizes)) / np.where(total > 0, total, 1)
    return np.where(total > 0, mean, np.nan), row, node, count


def _propagate(graph: DataFrame, params: GradeParams, sample_weight: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Harmonic rounds over the written graph; the state is two numbers a word node."""
    spark = graph.sparkSession
    n = params.word_nodes
    history: list[tuple[np.ndarray, np.ndarray]] = []

    for _ in range(params.rounds):
        states = spark.sparkContext.broadcast([(s.astype(np.float32), m.astype(np.float32)) for s, m in history])

        def run(batches, states=states):
            score, mass = np.zeros(n), np.zeros(n)
            for batch in batches:
                if not batch.num_rows:
                    continue
                value, weight = current_values(batch, states.value, sample_weight)
                row = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column("nodes").value_lengths()))
                node = batch.column("nodes").flatten().to_numpy(zero_copy_only=False)
                count = batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                there = ~np.isnan(value[row])
                w = np.where(there, count * weight[row], 0)
                score += np.bincount(node, weights=w * np.nan_to_num(value)[row], minlength=n)
                mass += np.bincount(node, weights=w, minlength=n)
            at = np.flatnonzero(mass)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(score[at]), pa.array(mass[at])], names=["node", "score", "mass"])

        sums = graph.mapInArrow(run, "node int, score double, mass double").groupBy("node").agg(F.sum("score").alias("score"), F.sum("mass").alias("mass"))
        got = sums.toPandas()  # at most word_nodes rows
        score, mass = np.zeros(n), np.zeros(n)
        at = got["node"].to_numpy().astype(np.int64)
        score[at] = got["score"].to_numpy()
        mass[at] = got["mass"].to_numpy()
        history.append((score, mass))
        if len(history) > 1 and _moved(*history[-2:]) <= params.settled:
            break
    return history


def _moved(before: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray]) -> float:
    """Mean change of the words' values over the mass they have after the round; a word without a
    value before counts whole."""
    (s0, m0), (s1, m1) = before, after
    old = np.where(m0 > 0, s0 / np.where(m0 > 0, m0, 1), 0)
    new = np.where(m1 > 0, s1 / np.where(m1 > 0, m1, 1), 0)
    return float((np.abs(new - old) * m1).sum() / max(m1.sum(), 1e-12))


def current_values(batch: pa.RecordBatch, history: list, sample_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Each text's value after the rounds so far, and its edge weight: the clamped grade of a
    sample; for a document nothing at first, then the left-out mean of its words."""
    grade = batch.column("grade").to_numpy(zero_copy_only=False)
    weight = np.where(np.isnan(grade), 1.0, sample_weight)
    value = grade
    for score, mass in history:
        free = _text_values(batch, score, mass, value, weight)[0]
        value = np.where(np.isnan(grade), free, grade)
    return value, weight


def free_values(graph: DataFrame, history: list, sample_weight: float) -> DataFrame:
    """(key, grade, value): the left-out mean of every text's words after the last round, for the
    samples too."""
    states = graph.sparkSession.sparkContext.broadcast([(s.astype(np.float32), m.astype(np.float32)) for s, m in history])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            before, weight = current_values(batch, states.value[:-1], sample_weight)
            value = _text_values(batch, *states.value[-1], before, weight)[0]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("grade"), pa.array(value, from_pandas=True)], names=["key", "grade", "value"])

    return graph.mapInArrow(run, "key long, grade double, value double")


def cut_points(grades: np.ndarray, values: np.ndarray) -> list[tuple[float, int]]:
    """Cuts between neighbouring grades, each where it misplaces the fewest samples."""
    present = sorted(set(grades.tolist()))
    cuts = []
    for low, high in zip(present, present[1:]):
        a, b = np.sort(values[grades == low]), np.sort(values[grades == high])
        both = np.unique(np.concatenate([a, b]))
        middle = (both[1:] + both[:-1]) / 2 if len(both) > 1 else both
        wrong = np.array([(a > m).mean() + (b <= m).mean() for m in middle])
        best = middle[wrong == wrong.min()]
        gap = best[np.argmin(np.abs(best - (np.median(a) + np.median(b)) / 2))]
        cuts.append((float(gap), int(high)))
    return cuts


def grade_documents(documents: DataFrame, samples: DataFrame, params: GradeParams = GradeParams(), kind_col: str | None = "kind") -> DataFrame:
    """(doc_id, value, grade) of the documents with prose; ``samples(sample_id, text, grade)``."""
    scratch = Scratch(documents.sparkSession, "grading")
    prosaic = documents.where(F.coalesce(F.col(kind_col), F.lit("")).isin(*UNGRADED_KINDS) == F.lit(False)) if kind_col else documents
    graded = samples.where("grade is not null").select(F.col("sample_id").cast("long").alias("key"), "text", F.col("grade").cast("double").alias("grade"))
    texts = prosaic.select(F.col("doc_id").cast("long").alias("key"), "text", F.lit(None).cast("double").alias("grade")).unionByName(graded)
    graph = scratch.keep(word_edges(texts, params), "graph")
    size = graph.agg(F.count("grade").alias("samples"), F.count_if(F.col("grade").isNull()).alias("documents")).first()
    sample_weight = params.graded_part * max(1, size["documents"]) / max(1, size["samples"])
    history = _propagate(graph, params, sample_weight)
    values = scratch.keep(free_values(graph, history, sample_weight), "values")
    known = values.where("grade is not null and value is not null").toPandas()  # the samples
    document = values.where("grade is null").select(F.col("key").alias("doc_id"), "value")
    if known.empty:
        return document.withColumn("grade", F.lit(None).cast("int"))
    cuts = cut_points(known["grade"].to_numpy(), known["value"].to_numpy())
    grade = F.lit(int(known["grade"].min()))
    for cut, high in cuts:
        grade = F.when(F.col("value") > cut, high).otherwise(grade)
    return document.withColumn("grade", F.when(F.col("value").isNotNull(), grade).cast("int"))
