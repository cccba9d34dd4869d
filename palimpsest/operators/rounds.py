"""Retrieval in several rounds: a second pass by a hypothetical answer, and multi-hop rounds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import fusion

#: below this best relevance the answer's own words are looked for instead of the question's
WEAK = 0.3


def second_pass_due(best: float | None, multi_hop: bool, temporal: bool) -> bool:
    return (best or 0.0) < WEAK or bool(multi_hop) or bool(temporal)


def second_pass(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """Two ranked result lists (query_id, id, rank) fused by reciprocal rank: the best ``limit`` as
    (query_id, id, score, rank)."""
    both = fusion.fuse([first.select("query_id", "id", "rank"), second.select("query_id", "id", "rank")])
    return fusion.ranked(both.withColumn("score", F.round("score", 9)), "score").where(F.col("rank") <= limit)


def iterate(question: str, recall: Callable[[str], DataFrame], propose: Callable[[str, list[tuple[str, str]]], str | None], rounds: int = 3, limit: int = 20) -> tuple[DataFrame, list[str]]:
    """Multi-hop retrieval: (query_id, id, position) of all rounds interleaved by rank, and the queries
    asked.

    ``recall`` gives (id, content, rank) of a query, of bounded size; ``propose`` sees the question
    and what was found so far, best rank first, and names the next query.  It ends after
    ``rounds``, without a next query, or when one comes again.
    """
    asked: list[str] = []
    found: list[DataFrame] = []
    seen: dict[str, tuple[int, str]] = {}
    query = question
    for n in range(max(1, rounds)):
        asked.append(query)
        hits = recall(query).where(F.col("rank") <= limit).select("id", "content", "rank")
        rows = hits.collect()  # at most ``limit``
        found.append(hits.sparkSession.createDataFrame([("q", n, r["rank"], r["id"]) for r in rows], "query_id string, round int, rank int, id string"))
        for r in rows:
            seen[r["id"]] = min(seen.get(r["id"], (r["rank"], r["content"])), (r["rank"], r["content"]))
        if n == rounds - 1:
            break
        known = sorted(((rank, i, text) for i, (rank, text) in seen.items()))
        step = (propose(question, [(i, text) for _, i, text in known]) or "").strip()
        if not step or step in asked:
            break
        query = step
    return fusion.interleave(reduce(DataFrame.unionByName, found), limit), asked
