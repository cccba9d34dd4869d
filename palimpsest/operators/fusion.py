"""Fusion, re-ranking and diversification of ranked lists.

Lists carry ``query_id``, so that many queries run in one plan.  Ranks start at 1.  Unusual
cases: an id in one list only takes part with that list; empty lists change nothing; ties by id.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T

RRF_K = 60


def ranked(df: DataFrame, score: str, by: str = "query_id", id_: str = "id") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), id_)))


def reciprocal_rank(a: DataFrame, b: DataFrame, weight_a: float = 1.0, weight_b: float = 1.0, k: int = RRF_K) -> DataFrame:
    """Full outer join of two ranked lists (query_id, id, rank) -> (query_id, id, score)."""
    left, right = a.select("query_id", "id", F.col("rank").alias("ra")), b.select("query_id", "id", F.col("rank").alias("rb"))
    both = left.join(right, ["query_id", "id"], "full_outer")
    part = lambda w, r: F.coalesce(F.lit(w) / (k + F.col(r)), F.lit(0.0))
    return both.select("query_id", "id", (part(weight_a, "ra") + part(weight_b, "rb")).alias("score"))


def fuse(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Any number of ranked lists with metadata; of equal keys the later list's value wins."""
    parts = [df.select("query_id", "id", "rank", F.lit(i).alias("place"), *(["metadata"] if "metadata" in df.columns else [])) for i, df in enumerate(lists)]
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    aggregates = [F.sum(1.0 / (k + F.col("rank"))).alias("score")]
    if "metadata" in every.columns:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", F.map_entries("metadata").alias("m")))), lambda x: x["m"])
        merged = F.aggregate(F.flatten(ordered), F.expr("cast(map() as map<string,string>)"), lambda acc, e: F.map_concat(F.map_filter(acc, lambda key, _: key != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))
        aggregates.append(merged.alias("metadata"))
    return every.groupBy("query_id", "id").agg(*aggregates)


def composite_score(similarity: Column, text_boost: Column, created_at: Column, access: Column, role: Column, content: Column, now: str, recency_bias: float, priming: Column | None = None) -> Column:
    """Similarity, text, recency, use, priming and role in one score, damped for noise."""
    from palimpsest.functions.lexicon import recall_failure

    hours = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(created_at)) / 3_600_000_000
    whole = similarity + 0.15 * text_boost + recency_bias * F.exp(-hours / 720) + F.least(F.lit(0.1), F.coalesce(access, F.lit(0)) * 0.01) + (priming if priming is not None else F.lit(0.0)) + F.when(role == "assistant", 0.05).otherwise(0.0)
    return whole * F.when(recall_failure(role, content), 0.4).otherwise(1.0)


def boost_and_rescue(vector_hits: DataFrame, text_hits: DataFrame) -> DataFrame:
    """Vector hits (query_id, id, similarity) joined with text boosts (query_id, id, boost);
    text-only hits are appended with similarity 0."""
    both = vector_hits.select("query_id", "id", "similarity").join(text_hits.select("query_id", "id", "boost"), ["query_id", "id"], "full_outer")
    return both.select("query_id", "id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("boost", F.lit(0.0)).alias("boost"), F.col("similarity").isNull().alias("rescued"))


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, text_weight: float = 0.4) -> DataFrame:
    """Weighted sum of normalised text score and cosine; sums of 0 or less drop out."""
    both = boost_and_rescue(vector_hits, text_hits)
    score = text_weight * F.col("boost") + (1 - text_weight) * F.col("similarity")
    return both.select("query_id", "id", score.alias("score")).where("score > 0")


def rerank_blend(relevance: Column, rerank: Column, harder: Column) -> Column:
    """0.7 of the reranker (0.85 for multi-hop or temporal queries); a missing score counts 0."""
    w = F.when(harder, 0.85).otherwise(0.7)
    return w * F.coalesce(rerank, F.lit(0.0)) + (1 - w) * relevance


def prefer_project(df: DataFrame, project: str | None, strict: bool = False) -> DataFrame:
    """Adds 0.1 to rows of the project; ``strict`` drops rows of other projects."""
    if project is None:
        return df
    if strict:
        df = df.where((F.col("project_id") == project) | F.col("project_id").isNull())
    return df.withColumn("relevance", F.col("relevance") + F.when(F.col("project_id") == project, 0.10).otherwise(0.0))


def max_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two result sets (query_id, id, relevance): the higher relevance per id."""
    return a.select("query_id", "id", "relevance").unionByName(b.select("query_id", "id", "relevance")).groupBy("query_id", "id").agg(F.max("relevance").alias("relevance"))


def interleave(rounds: DataFrame, limit: int) -> DataFrame:
    """``rounds(query_id, round, rank, id)``: by (rank, round), first occurrence of an id."""
    first = rounds.groupBy("query_id", "id").agg(F.min(F.struct("rank", "round")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at", "id")
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select("query_id", "id", "position")


def session_ranking(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """``hits(query_id, session_id, id, rank, event_at)`` -> sessions by reciprocal-rank mass,
    the session of the first hit pinned in front."""
    known = hits.where("session_id is not null")
    mass = known.groupBy("query_id", "session_id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("mass"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("memory_ids"), F.min("event_at").alias("earliest"), F.max("event_at").alias("latest"), F.min("rank").alias("best")
    )
    head = F.col("best") == F.min("best").over(Window.partitionBy("query_id"))
    order = Window.partitionBy("query_id").orderBy(head.desc(), F.round("mass", 6).desc(), "session_id")
    return mass.withColumn("head", head).withColumn("position", F.row_number().over(order)).drop("best")


def mmr(candidates: DataFrame, weight: float = 0.5, limit: int = 50) -> DataFrame:
    """Greedy diversification of at most ``limit`` candidates a query: argmax of
    weight * relevance - (1 - weight) * greatest word overlap with what is taken."""
    best = candidates.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "id"))).where(F.col("_r") <= limit)
    best = best.select("query_id", "id", "relevance", T.lemmas(F.col("content")).alias("lemmas"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["relevance", "id"], ascending=[False, True])
        left = [(i, r, frozenset(w)) for i, r, w in zip(pdf["id"], pdf["relevance"], pdf["lemmas"])]
        taken: list[tuple[str, float, frozenset]] = []
        overlap = dict.fromkeys((i for i, _, _ in left), 0.0)
        while left:
            at = max(range(len(left)), key=lambda n: (weight * left[n][1] - (1 - weight) * overlap[left[n][0]], -n))
            chosen = left.pop(at)
            taken.append(chosen)
            for i, _, w in left:
                union = len(w | chosen[2])
                overlap[i] = max(overlap[i], len(w & chosen[2]) / union if union else 0.0)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "id": [t[0] for t in taken], "relevance": [t[1] for t in taken], "position": range(1, len(taken) + 1)})

    return best.groupBy("query_id").applyInPandas(pick, "query_id string, id string, relevance double, position int")


def near_duplicates(new: DataFrame, stored: DataFrame, similarity: Column, threshold: float) -> DataFrame:
    """Best stored row of each new one at or above the threshold, from joined pairs."""
    pairs = new.join(stored, similarity >= threshold)
    order = Window.partitionBy("new_id").orderBy(similarity.desc(), "id")
    return pairs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
