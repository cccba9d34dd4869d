"""Context around recalled memories: seeds, assembly, inheritance, working memory, run tools.

Unusual cases: unknown names give no seeds; empty activations give an empty context; nulls in
labels are left out; ties by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARED_SCOPES = ("global", "none", "shared")
#: fixed values: seed weights by kind of node
SEED_WEIGHTS = {"person": 0.7, "entity": 0.5, "topic": 0.5, "project": 0.6, "primed": 0.45}


def entity_nodes(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """``nodes(node, label, name)``, ``names(name)`` -> nodes named: people exactly, others by case
    folded name."""
    wanted = names.select(F.col("name").alias("wanted")).distinct()
    met = nodes.join(wanted, F.lower("name") == F.lower("wanted"))
    return met.where((F.col("label") != "person") | (F.col("name") == F.col("wanted"))).select("node", "label", "name").distinct()


def seeds(recalled: DataFrame, named: DataFrame, project: str | None = None, primed: DataFrame | None = None, most: int = 8) -> DataFrame:
    """(node, value): the best recalled memories by relevance, then named nodes, the project and
    primed topics; the first source of a node wins."""
    best = recalled.orderBy(F.col("relevance").desc(), "id").limit(most).select(F.col("id").alias("node"), F.col("relevance").alias("value"), F.lit(0).alias("source"))
    weight = F.when(F.col("label") == "person", SEED_WEIGHTS["person"]).otherwise(SEED_WEIGHTS["entity"])
    every = best.unionByName(named.select("node", weight.alias("value"), F.lit(1).alias("source")))
    if project is not None:
        every = every.unionByName(recalled.sparkSession.createDataFrame([(f"project:{project}", SEED_WEIGHTS["project"], 2)], "node string, value double, source int"))
    if primed is not None:
        every = every.unionByName(primed.select(F.concat(F.lit("entity:"), "topic").alias("node"), F.lit(SEED_WEIGHTS["primed"]).alias("value"), F.lit(3).alias("source")))
    return every.groupBy("node").agg(F.min_by("value", "source").alias("value"))


def assemble(activated: DataFrame) -> DataFrame:
    """``activated(query_id, label, name, activation)`` -> one row a query: speakers, emotions,
    topics (ten), times and the most frequent intent."""
    def some(label: str, n: int) -> Column:
        rows = F.collect_list(F.when(F.col("label") == label, F.struct((-F.col("activation")).alias("a"), F.col("name").alias("name"))))
        return F.slice(F.array_distinct(F.transform(F.array_sort(rows), lambda x: x["name"])), 1, n)

    named = activated.where("name is not null").groupBy("query_id", "label", F.lower("name").alias("_n")).agg(F.max("activation").alias("activation"), F.min("name").alias("name"), F.count(F.lit(1)).alias("n"))
    intent = F.max_by(F.when(F.col("label") == "intent", F.col("name")), F.when(F.col("label") == "intent", F.struct("n", "activation", "name")))
    return named.groupBy("query_id").agg(some("person", 50).alias("speakers"), some("emotion", 20).alias("emotions"), some("entity", 10).alias("topics"), some("time", 20).alias("times"), F.coalesce(intent, F.lit("INFORMATIONAL")).alias("dominant_intent"))


def inherit_digest_context(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """``sources(digest_id, id)``, ``edges(src, dst, edge_type)`` -> (digest_id, dst, edge_type,
    weight): the part of a digest's sources that link to a context node."""
    distinct = sources.distinct()
    total = distinct.groupBy("digest_id").agg(F.count(F.lit(1)).alias("n"))
    met = distinct.join(edges.select(F.col("src").alias("id"), "dst", "edge_type").distinct(), "id")
    return met.groupBy("digest_id", "dst", "edge_type").agg(F.count_distinct("id").alias("k")).join(total, "digest_id").select("digest_id", "dst", "edge_type", (F.col("k") / F.col("n")).alias("weight"))


def inherit_fact_context(lineage: DataFrame, edges: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """``lineage(fact_id, digest_id)`` -> (fact_id, dst, weight): 0.7 of the strongest link of the
    fact's digests, unless the fact's own link is stronger."""
    got = lineage.join(edges.select(F.col("src").alias("digest_id"), "dst", "weight"), "digest_id").groupBy("fact_id", "dst").agg((0.7 * F.max("weight")).alias("weight"))
    if own is not None:
        got = got.unionByName(own.select("fact_id", "dst", "weight")).groupBy("fact_id", "dst").agg(F.max("weight").alias("weight"))
    return got


def community_activation(activated: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """Communities with ``least`` activated members: 0.8 of their mean activation."""
    return activated.join(members, "node").groupBy("community").agg(F.count(F.lit(1)).alias("n"), (0.8 * F.avg("activation")).alias("activation")).where(F.col("n") >= least)


def context_frequency(members: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community, label, name, n): how often members link to each context node."""
    met = members.join(edges.select(F.col("src").alias("node"), "dst"), "node").join(nodes.select(F.col("node").alias("dst"), "label", "name"), "dst")
    return met.groupBy("community", "label", "name").agg(F.count(F.lit(1)).alias("n"))


def strengthen(edges: DataFrame, travelled: DataFrame, now: str, by: float = 0.02) -> DataFrame:
    """Adds ``by`` to the travelled edges (either direction), at most 1, and counts the walk."""
    t = travelled.select(F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y")).distinct().withColumn("_hit", F.lit(True))
    e = edges.join(t, (F.least("src", "dst") == F.col("_x")) & (F.greatest("src", "dst") == F.col("_y")), "left")
    return e.withColumns({
        "weight": F.when(F.col("_hit"), F.least(F.lit(1.0), F.col("weight") + by)).otherwise(F.col("weight")),
        "traversals": F.col("traversals") + F.when(F.col("_hit"), 1).otherwise(0),
        "last_traversed": F.when(F.col("_hit"), F.lit(now).cast("timestamp")).otherwise(F.col("last_traversed")),
    }).select(*edges.columns)


def working_memory(items: DataFrame, by: str = "session_id", capacity: int = 100) -> DataFrame:
    """What stays in a bounded working memory: of a key's writes the last, then the most important
    ``capacity`` keys."""
    last = items.groupBy(by, "key").agg(F.max_by(F.struct("value", "importance"), "seq").alias("v")).select(by, "key", "v.*")
    return last.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.col("importance").desc(), "key"))).where(F.col("_r") <= capacity).drop("_r")


def hydrate_evidence(runs: DataFrame, turns: DataFrame) -> DataFrame:
    """``runs(question_id, session_ids array)``, ``turns(question_id, session_id, turn, role,
    content)`` -> ranked evidence rows, relevance 1 - 0.01 a rank."""
    ranked = runs.select("question_id", F.posexplode("session_ids").alias("rank", "session_id"))
    return ranked.join(turns, ["question_id", "session_id"]).withColumn("relevance", 1.0 - 0.01 * F.col("rank"))


def stride_sample(rows: DataFrame, order: str, n: int) -> DataFrame:
    """Every n-th row: a sampling operator, deterministic in the order."""
    from palimpsest.operators.sequence import numbered

    placed = numbered(rows.withColumn("_all", F.lit(0)), "_all", F.floor(F.col(order) / 10_000), [F.col(order)], "_p")
    return placed.where((F.col("_p") - 1) % n == 0).drop("_all", "_p")


def cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float) -> Column:
    """Price of a model call from rates per million tokens."""
    return (tokens_in * rate_in + tokens_out * rate_out) / 1_000_000


def rank_fallback(rank: Column, n: Column) -> Column:
    """Reranker scores when the reranker fails: from 1 down to a half by input rank (from 0)."""
    return 1 - rank * 0.5 / n


def tolerant_json(text: Column, schema: str) -> Column:
    """JSON out of a model's reply: the outermost brackets, code fences dropped; null if none."""
    body = F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1)
    return F.when(body != "", F.from_json(body, schema))


def project_scope(explicit: str | None, detected: str | None) -> str | None:
    """The first scope that is set; shared aliases mean no scope."""
    for scope in (explicit, detected):
        if scope and scope.strip():
            return None if scope.strip().lower() in SHARED_SCOPES else scope.strip()
    return None


def text_table(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Fixed-width lines of the given columns."""
    return rows.select(F.concat_ws(" ", *[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ") for c, w in widths.items()]).alias("line"))


def attribution(at: Column, metadata: Column) -> Column:
    """Tag of a result: day, device and channel where known."""
    return F.concat_ws(" | ", F.date_format(at, "yyyy-MM-dd"), F.try_element_at(metadata, F.lit("device")), F.try_element_at(metadata, F.lit("channel")))
