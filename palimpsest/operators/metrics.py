"""Retrieval-quality and comparison metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T


def recall_at(results: DataFrame, ks: list[int]) -> DataFrame:
    """``results(question_id, question_type, gold array, retrieved array)`` -> per k and type (and
    over all, type null): n, any_hit, complete_evidence.  Empty gold never counts as found."""
    per = results.select("question_type", "gold", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "retrieved")
    first = F.slice("retrieved", 1, F.col("k"))
    some = F.size("gold") > 0
    per = per.select("question_type", "k", (some & F.arrays_overlap("gold", first)).cast("int").alias("any"), (some & (F.size(F.array_except("gold", first)) == 0)).cast("int").alias("all"))
    return per.rollup("k", "question_type").agg(F.count(F.lit(1)).alias("n"), F.avg("any").alias("any_hit"), F.avg("all").alias("complete_evidence"), F.grouping_id().alias("_g")).where("_g < 2").drop("_g")


def token_f1(pairs: DataFrame, answer: str, gold: str) -> DataFrame:
    """Adds precision, recall and f1 over bags of tokens."""

    def numbered(c: str) -> Column:
        w = T.tokens(F.col(c))
        return F.transform(w, lambda t, i: F.concat_ws("#", t, F.size(F.filter(F.slice(w, F.lit(1), i + 1), lambda u: u == t)).cast("string")))

    a, g = numbered(answer), numbered(gold)
    shared = F.size(F.array_intersect(a, g))
    precision, recall = F.when(F.size(a) > 0, shared / F.size(a)).otherwise(0.0), F.when(F.size(g) > 0, shared / F.size(g)).otherwise(0.0)
    out = pairs.withColumns({"precision": precision, "recall": recall})
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided p of discordant counts: the binomial tail sum of outcomes no likelier."""
    n = b + c
    if n == 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) for k in range(n + 1)]
    return min(1.0, sum(math.exp(x) for x in log if x <= log[b] + 1e-9))


def paired_outcomes(base: DataFrame, treated: DataFrame, key: str, correct: str) -> DataFrame:
    """2x2 counts of two runs joined on the key, with rows found in one run only."""
    x, y = base.select(key, F.col(correct).alias("x")), treated.select(key, F.col(correct).alias("y"))
    both = x.join(y, key, "full_outer")
    c = lambda e: F.count_if(F.coalesce(e, F.lit(False)))
    return both.agg(
        c(F.col("x") & F.col("y")).alias("both_right"), c(F.col("x") & ~F.col("y")).alias("b"), c(~F.col("x") & F.col("y")).alias("c"), c(~F.col("x") & ~F.col("y")).alias("both_wrong"),
        c(F.col("x").isNotNull() & F.col("y").isNull()).alias("only_base"), c(F.col("x").isNull() & F.col("y").isNotNull()).alias("only_treated"),
    )


def drift(base: DataFrame, treated: DataFrame, key: str, by: str, answer: str, verdict: str) -> DataFrame:
    """Rates of changed answers and verdicts by type."""
    y = treated.select(key, F.col(answer).alias("_a"), F.col(verdict).alias("_v"))
    j = base.join(y, key)
    return j.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg((~F.col(answer).eqNullSafe(F.col("_a"))).cast("int")).alias("answer_changed"), F.avg((~F.col(verdict).eqNullSafe(F.col("_v"))).cast("int")).alias("verdict_changed"))


STRICTNESS = {"incorrect": 0, "partial": 1, "correct": 2}


def panel_verdict(votes: DataFrame, key: str) -> DataFrame:
    """Most frequent verdict of a panel; ties to the strictest."""
    strict = F.create_map(*[F.lit(x) for kv in STRICTNESS.items() for x in kv])[F.col("verdict")]
    n = votes.groupBy(key, "verdict").agg(F.count(F.lit(1)).alias("n")).withColumn("s", strict)
    return n.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "s"))).where("r = 1").select(key, "verdict")


def accuracy(verdicts: DataFrame, by: str) -> DataFrame:
    """Strict (correct) and lenient (correct or partial) accuracy by type and over all."""
    return verdicts.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("verdict") == "correct").cast("int")).alias("strict"), F.avg(F.col("verdict").isin("correct", "partial").cast("int")).alias("lenient"))


def graph_verdict(n: int, lift: float, epsilon: float = 0.005, least: int = 100) -> str:
    if n < least:
        return "insufficient"
    return "keep" if lift > epsilon else "kill"


def containment(exact: DataFrame, pool: DataFrame, depths: list[int]) -> DataFrame:
    """Share of the exact best d (``exact(query_id, id, rank)``) inside the candidate pool
    (``pool(query_id, id)``), d clamped to what there is: (query_id, depth, contained)."""
    inside = exact.join(pool.select("query_id", "id").distinct().withColumn("_in", F.lit(1)), ["query_id", "id"], "left")
    per = inside.select("query_id", "rank", "_in", F.explode(F.array(*[F.lit(d) for d in depths])).alias("depth")).where("rank <= depth")
    return per.groupBy("query_id", "depth").agg((F.sum(F.coalesce("_in", F.lit(0))) / F.count(F.lit(1))).alias("contained"))


def summary_stats(values: DataFrame, column: str) -> DataFrame:
    """n, mean, nearest-rank p50 and p10, min, max."""
    return values.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.expr(f"percentile_disc(0.5) within group (order by {column})").alias("p50"), F.expr(f"percentile_disc(0.1) within group (order by {column})").alias("p10"), F.min(column).alias("min"), F.max(column).alias("max"))


def histogram(values: DataFrame, column: str, width: float) -> DataFrame:
    return values.where(F.col(column).isNotNull()).groupBy(F.floor(F.col(column) / width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def hop_metrics(predictions: DataFrame, ks: list[int]) -> DataFrame:
    """``predictions(item_id, support array, bridge array, retrieved array)`` -> per k: all-support
    rate, mean bridge recall and bridge-hit rate; items without bridge labels are left out there."""
    per = predictions.select("support", "bridge", "retrieved", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).withColumn("first", F.slice("retrieved", 1, F.col("k")))
    labelled = F.size("bridge") > 0
    return per.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.avg(((F.size("support") > 0) & (F.size(F.array_except("support", "first")) == 0)).cast("int")).alias("all_support"),
        F.avg(F.when(labelled, F.arrays_overlap("bridge", "first").cast("int"))).alias("bridge_hit"), F.avg(F.when(labelled, F.size(F.array_intersect("bridge", "first")) / F.size("bridge"))).alias("bridge_recall"),
    )


def abstains(answer: Column) -> Column:
    """A short refusal at the start of an answer."""
    return (F.length(answer) < 240) & F.substring(answer, 1, 120).rlike(r"(?i)\b(i (don'?t|do not) (know|have)|no information|not (mentioned|specified|enough)|cannot (determine|answer)|can'?t (determine|answer))\b")
