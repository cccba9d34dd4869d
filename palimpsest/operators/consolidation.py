"""Consolidation jobs: summarise, promote, discover edges, decay, prune, and their gates.

Each job is a function of frames that returns the rows to write.  Sequential rules are stated as
their batch-deterministic equivalent: within one job, of equal candidates the first by (time, id)
counts.

Unusual cases: sessions under the minimum give no batch; null salience counts as 0.3; null
confidence stays null; empty inputs give empty outputs.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.scans import FLOOR
from palimpsest.operators.sequence import numbered

# --- fixed values: summary stop words, knowledge patterns and contradiction phrases -----------------

SUMMARY_STOP = frozenset(
    "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might this that these those i you he she it we they me him her us them my your his its our their not no so if then than as".split()
)
SEMANTIC_PATTERNS = [
    (r"I prefer\s+(.+?)(?:\.|,|$)", "preference", 0.9), (r"I like\s+(.+?)(?:\.|,|$)", "preference", 0.9), (r"I want\s+(.+?)(?:\.|,|$)", "preference", 0.85), (r"I don'?t like\s+(.+?)(?:\.|,|$)", "preference", 0.9),
    (r"I hate\s+(.+?)(?:\.|,|$)", "preference", 0.9), (r"let'?s go with\s+(.+?)(?:\.|,|$)", "decision", 0.9), (r"we decided\s+(?:to\s+)?(.+?)(?:\.|,|$)", "decision", 0.9), (r"the plan is to\s+(.+?)(?:\.|,|$)", "decision", 0.9),
    (r"my (?:name|email|timezone|location) is\s+(.+?)(?:\.|,|$)", "personal_info", 0.9),
]
PROCEDURAL_PATTERNS = [
    (r"\bmy workflow is\b(.+)", "workflow"), (r"\bi usually\b(.+)", "habit"), (r"\bmy process is\b(.+)", "workflow"), (r"\bi always\b(.+)", "habit"), (r"\bbefore (?:i|we) \w+,\s*(?:i|we)\b(.+)", "workflow"),
    (r"\bafter (?:i|we) \w+,\s*(?:i|we)\b(.+)", "workflow"), (r"\bnever use\b(.+)", "convention"), (r"\balways run\b(.+)", "convention"), (r"\bmake sure to\b(.+)", "convention"),
]
CONTRADICTIONS = [
    ("I prefer", "I don'?t like"), ("I like", "I hate"), ("I like", "I don'?t like"), ("I always", "I never"), ("I don'?t like", "I prefer"), ("I don'?t like", "I like"), ("I hate", "I like"), ("I hate", "I prefer"), ("I never", "I always"),
]

# --- light: sessions into digests ----------------------------------------------------------------


def session_batches(episodes: DataFrame, size: int = 20, minimum: int = 5) -> DataFrame:
    """Unconsolidated rows of sessions with ``minimum`` of them, in batches of ``size`` by
    salience; adds batch and place.  Sessions of any length split over batches, not tasks."""
    score = F.coalesce("salience", F.lit(0.3))
    rows = episodes.where("consolidated_at is null and forgotten_at is null and session_id is not null")
    enough = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum).select("session_id")
    placed = numbered(rows.join(enough, "session_id", "left_semi"), "session_id", F.floor(-score * 1000), [score.desc(), F.col("id")], "place")
    return placed.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("long"))


def detail_level(mean: Column) -> Column:
    return F.when(mean > 0.7, "high").when(mean > 0.4, "medium").otherwise("low")


def majority(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Most frequent non-null value a group; of equal counts the first seen."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_first"))
    best = counted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_n").desc(), "_first"))).where("_r = 1")
    return best.select(*keys, value)


def heuristic_summary(turns: list[tuple[str, str]], budget: int = 1200) -> tuple[str, list[str]]:
    """Sentences of the highest mean word weight up to a token budget, and the ten most frequent
    words; a word of two to five occurrences weighs half as much again."""
    text = "\n".join(f"[{r}]: {c}" for r, c in turns)
    sentences = [s for s in (x.strip() for x in re.split(r"[.!?\n]+", text)) if len(s) > 10]
    if not sentences:
        return "", []

    def words_of(s: str) -> list[str]:
        return [w for w in re.split(r"\W+", s.lower(), flags=re.A) if len(w) > 2 and w not in SUMMARY_STOP]

    split = [words_of(s) for s in sentences]
    freq = pd.Series([w for ws in split for w in ws], dtype=object).value_counts().to_dict()
    total = max(1, sum(freq.values()))
    weight = {w: n / total * (1.5 if 2 <= n <= 5 else 1.0) for w, n in freq.items()}
    scored = sorted(range(len(sentences)), key=lambda i: -(sum(weight[w] for w in split[i]) / len(split[i]) if split[i] else 0.0))
    used, chosen = 0, []
    for i in scored:
        cost = -(-len(sentences[i]) // 4)
        if used + cost > budget:
            break
        chosen.append(sentences[i])
        used += cost
    summary = (". ".join(chosen) if chosen else sentences[0]) + "."
    count: dict[str, int] = {}
    for w in re.split(r"\W+", " ".join(chosen).lower(), flags=re.A):
        if len(w) > 3 and w not in SUMMARY_STOP:
            count[w] = count.get(w, 0) + 1
    return summary, [w for w, _ in sorted(count.items(), key=lambda x: -x[1])[:10]]


def light_sleep(episodes: DataFrame, now: str, size: int = 20, minimum: int = 5) -> dict[str, DataFrame]:
    """Digests of session batches, the consolidated ids, and the derived-from edges."""
    batches = session_batches(episodes, size, minimum)
    lists = batches.groupBy("session_id", "batch").agg(
        F.array_sort(F.collect_list(F.struct("place", "id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("content", F.lit("")).alias("content")))).alias("turns"), F.avg(F.coalesce("salience", F.lit(0.3))).alias("mean_salience")
    )
    project = majority(batches, ["session_id", "batch"], "project_id", ["created_at", "id"])

    def summarise(frames):
        for pdf in frames:
            made = [heuristic_summary([(t["role"], t["content"]) for t in turns]) for turns in pdf["turns"]]
            yield pd.DataFrame(
                {"session_id": pdf["session_id"], "batch": pdf["batch"], "summary": [m[0] for m in made], "key_topics": [m[1] for m in made], "source_episode_ids": [[t["id"] for t in turns] for turns in pdf["turns"]], "mean_salience": pdf["mean_salience"]}
            )

    made = lists.mapInPandas(summarise, "session_id string, batch long, summary string, key_topics array<string>, source_episode_ids array<string>, mean_salience double")
    digests = made.join(project, ["session_id", "batch"], "left").withColumns(
        {"id": F.sha2(F.concat_ws("|", "session_id", F.col("batch").cast("string"), F.array_join("source_episode_ids", ",")), 256), "level": F.lit(0), "detail": detail_level(F.col("mean_salience")), "created_at": F.lit(now).cast("timestamp")}
    )
    edges = digests.select("id", F.explode("source_episode_ids").alias("target_id")).select(F.col("id").alias("source_id"), "target_id", F.lit("derives_from").alias("edge_type"), F.lit(0.8).alias("strength"))
    return {"digests": digests, "consolidated": batches.select("id"), "edges": edges}


# --- deep: digests into facts and procedures ------------------------------------------------------


def _fact(pattern: str, topic: str, confidence: float):
    def of(phrase: Column) -> Column:
        content = F.trim(F.regexp_extract(phrase, "(?i)" + pattern, 1))
        return F.struct(F.lit("semantic").alias("kind"), F.lit(topic).alias("topic"), content.alias("content"), F.trim(phrase).alias("phrase"), F.lit(confidence).alias("confidence"))

    return of


def knowledge_candidates(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(source_id, kind, topic, content, phrase, confidence) found by the patterns; procedural
    patterns give their first match, semantic ones all."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = []
    for p, category in PROCEDURAL_PATTERNS:
        body = F.trim(F.regexp_extract(text, "(?i)" + p, 1))
        found.append(F.array(F.struct(F.lit("procedural").alias("kind"), F.lit(category).alias("topic"), body.alias("content"), body.alias("phrase"), F.lit(0.85).alias("confidence"))))
    for p, topic, confidence in SEMANTIC_PATTERNS:
        whole = F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0))
        found.append(F.transform(whole, _fact(p, topic, confidence)))
    every = rows.select(F.col(id_col).alias("source_id"), F.explode(F.flatten(F.array(*found))).alias("c")).select("source_id", "c.*")
    return every.where(F.length("content") >= 3).dropDuplicates(["source_id", "kind", "topic", "content"])


def subject_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 2))


def contradicts(phrase: Column, stored: Column) -> Column:
    """Whether a new phrase reverses a stored one about the same subject (over half the words)."""
    out = F.lit(False)
    for a, b in CONTRADICTIONS:
        new, old = F.regexp_extract(phrase, rf"(?i){a}\s+(.+)", 1), F.regexp_extract(stored, rf"(?i){b}\s+(.+)", 1)
        x, y = subject_words(new), subject_words(old)
        most = F.greatest(F.size(x), F.size(y))
        out = out | ((new != "") & (old != "") & (most > 0) & (F.size(F.array_intersect(x, y)) / most > 0.5))
    return F.coalesce(out, F.lit(False))


def deep_sleep(digests: DataFrame, semantic: DataFrame, now: str, days: int = 7, minimum: int = 3) -> dict[str, DataFrame]:
    """Promotes knowledge of recent digests: ``boosts(id)`` for facts repeated, ``inserts`` for
    new ones, ``supersessions(old_id, new_id)`` for reversed ones.  Candidates meet stored facts
    of their topic only."""
    recent = digests.where(F.col("created_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))
    found = knowledge_candidates(recent, "id", "summary").where("kind = 'semantic'")
    merged = found.withColumn("key", F.lower("content")).groupBy("topic", "key").agg(F.min("content").alias("content"), F.min("phrase").alias("phrase"), F.max("confidence").alias("confidence"), F.sort_array(F.collect_set("source_id")).alias("source_digest_ids"))
    enough = recent.agg((F.count(F.lit(1)) >= minimum).alias("enough"))
    merged = merged.crossJoin(F.broadcast(enough)).where("enough").drop("enough").withColumn("new_id", F.sha2(F.concat_ws("|", "topic", "key"), 256))
    facts = semantic.where("forgotten_at is null and superseded_by is null").select("id", F.col("topic").alias("fact_topic"), F.col("content").alias("fact"))
    met = merged.join(facts, F.col("topic") == F.col("fact_topic"))
    a, b = subject_words(F.col("content")), subject_words(F.col("fact"))
    union = F.size(F.array_union(a, b))
    same = F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0) >= 0.88
    boosts = met.where(same & ~contradicts(F.col("phrase"), F.col("fact"))).select("id", "new_id").distinct()
    reversed_ = met.where(contradicts(F.col("phrase"), F.col("fact"))).select(F.col("id").alias("old_id"), "new_id").distinct()
    inserts = merged.join(boosts.select("new_id").distinct(), "new_id", "left_anti").withColumn("created_at", F.lit(now).cast("timestamp"))
    return {"boosts": boosts.select("id").distinct(), "inserts": inserts, "supersessions": reversed_}


# --- dream: edges -------------------------------------------------------------------------------


def entity_pairs(rows: DataFrame, known: DataFrame, now: str, days: int = 7, limit: int | None = 50) -> DataFrame:
    """Pairs of recent rows that share two entities or more and are not linked yet.

    ``rows(id, created_at, entities)`` -> (a, b, shared, entity, rows_a, rows_b).  Rows with equal
    entity sets form a class, named by its smallest id; a pair is a pair of classes, and a class of
    several rows is paired with itself.  Entities are ordered from rare to common; rows that share
    two meet at one that is not their last, so a row's commonest entity joins nothing and a pair is
    formed once, at its rarest common entity.  Pairs that share one entity only are every pair of
    an entity's group and are not formed.
    """
    recent = rows.where(F.col("created_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))
    clean = F.array_distinct(F.filter(F.transform("entities", lambda e: F.lower(F.trim(e))), lambda e: e != ""))
    sets = recent.select("id", F.array_sort(clean).alias("set")).where(F.size("set") > 1)
    classes = sets.groupBy("set").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    one = classes.select("id", "n", F.explode("set").alias("entity"))
    df = one.groupBy("entity").agg(F.sum("n").alias("df"))
    lists = one.join(df, "entity").groupBy("id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "entity"))), lambda x: x["entity"]).alias("list"))
    keys = lists.select("id", "n", "list", F.explode(F.slice("list", F.lit(1), F.size("list") - 1)).alias("entity"))
    left = keys.select(F.col("id").alias("a"), F.col("n").alias("rows_a"), F.col("list").alias("list_a"), "entity")
    right = keys.select(F.col("id").alias("b"), F.col("n").alias("rows_b"), F.col("list").alias("list_b"), "entity")
    both = F.array_intersect("list_a", "list_b")
    met = left.join(right, "entity").where((F.col("a") < F.col("b")) & (F.size(both) > 1) & (both[0] == F.col("entity"))).withColumn("shared", F.size(both))
    alone = lists.where("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.size("list").alias("shared"), F.col("list")[0].alias("entity"), F.col("n").alias("rows_a"), F.col("n").alias("rows_b"))
    pairs = met.select(*alone.columns).unionByName(alone)
    linked = known.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    fresh = pairs.join(linked, ["a", "b"], "left_anti")
    return fresh if limit is None else fresh.orderBy(F.col("shared").desc(), "a", "b").limit(limit)


def topical_strength(shared: Column) -> Column:
    return 0.3 + 0.1 * F.least(shared, F.lit(5))


def causal_topics(events: DataFrame, minimum: int = 3, limit: int = 50) -> DataFrame:
    """``events(session, topic, at)``: topic a before topic b in the same session, counted over
    distinct sessions.  First and last times a (session, topic) suffice, so sessions of any length
    contribute at most one row a topic."""
    span = events.where("session is not null and topic is not null").groupBy("session", "topic").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    a = span.select("session", F.col("topic").alias("cause"), "first")
    b = span.select("session", F.col("topic").alias("effect"), "last")
    pairs = a.join(b, "session").where("cause <> effect and first < last").groupBy("cause", "effect").agg(F.count(F.lit(1)).alias("sessions"))
    return pairs.where(F.col("sessions") >= minimum).orderBy(F.col("sessions").desc(), "cause", "effect").limit(limit)


def replay_pairs(activated: DataFrame, minimum: int = 3) -> DataFrame:
    """``activated(seed, node)``: pairs of seeds whose activated sets share ``minimum`` nodes, with
    the replay weight min(0.9, 0.3 + 0.1 * min(n, 6))."""
    a, b = activated.select(F.col("seed").alias("a"), "node").distinct(), activated.select(F.col("seed").alias("b"), "node").distinct()
    n = a.join(b, "node").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= minimum)
    return n.withColumn("weight", F.least(F.lit(0.9), 0.3 + 0.1 * F.least("shared", F.lit(6))))


def community_summaries(members: DataFrame, terms: DataFrame, minimum: int = 5, top: int = 3) -> DataFrame:
    """``members(community, node)``, ``terms(node, kind, term)`` -> (community, member_count,
    top_<kind>.., label)."""
    size = members.groupBy("community").agg(F.count_distinct("node").alias("member_count")).where(F.col("member_count") >= minimum)
    counted = members.join(terms, "node").groupBy("community", "kind", "term").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("community", "kind").orderBy(F.col("n").desc(), "term"))).where(F.col("r") <= top)
    lists = ranked.groupBy("community").pivot("kind", ["entity", "topic"]).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]))
    out = size.join(lists, "community", "left").withColumnsRenamed({"entity": "top_entities", "topic": "top_topics"})
    words = F.concat(F.coalesce("top_topics", F.array().cast("array<string>")), F.coalesce("top_entities", F.array().cast("array<string>")))
    return out.withColumn("label", F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 2), " and ")).otherwise(F.concat(F.lit("community "), F.col("community").cast("string"))))


# --- decay and pruning ----------------------------------------------------------------------------


def decayed(confidence: Column, rate: Column | float) -> Column:
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    return F.when(confidence > FLOOR, F.greatest(F.lit(FLOOR), confidence - rate)).otherwise(confidence)


def decay_flat(semantic: DataFrame, now: str, days: int = 30, rate: float = 0.02) -> DataFrame:
    """Lowers the confidence of live facts not read for ``days``; the floor is never passed."""
    stale = F.col("last_accessed").isNull() | (F.col("last_accessed") < F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))
    due = stale & F.col("forgotten_at").isNull() & F.col("superseded_by").isNull()
    return semantic.withColumn("confidence", F.when(due, decayed(F.col("confidence"), rate)).otherwise(F.col("confidence")))


def decay_gradient(semantic: DataFrame, ranks: DataFrame, now: str, days: int = 30, rate: float = 0.02, shield: float = 0.8) -> DataFrame:
    """Flat decay weakened by centrality: the best ranked fact keeps up to ``shield`` of it."""
    most = ranks.agg(F.max("rank").alias("_most"))
    r = semantic.join(ranks.withColumnRenamed("node", "id"), "id", "left").crossJoin(F.broadcast(most))
    r = r.withColumn("_rate", rate * (1 - shield * F.coalesce(F.col("rank") / F.col("_most"), F.lit(0.0))))
    stale = F.col("last_accessed").isNull() | (F.col("last_accessed") < F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))
    return r.withColumn("confidence", F.when(stale, decayed(F.col("confidence"), F.col("_rate"))).otherwise(F.col("confidence"))).select(*semantic.columns)


def prune_weak(edges: DataFrame, now: str, strength: float = 0.05, days: int = 90) -> DataFrame:
    """Edges that stay: strong ones, and those activated (or made) within ``days``."""
    seen = F.coalesce("last_activated", "created_at")
    return edges.where(~F.coalesce((F.col("strength") < strength) & (seen < F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")), F.lit(False)))


def prune_untravelled(edges: DataFrame, now: str, days: int = 60) -> DataFrame:
    """Edges that stay: travelled, young, or derived-from ones."""
    old = F.col("created_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")
    return edges.where(~F.coalesce((F.col("traversals") == 0) & old & (F.col("edge_type") != "derives_from"), F.lit(False)))


# --- gates ---------------------------------------------------------------------------------------


def due(episodes: DataFrame, digests: DataFrame, runs: DataFrame, now: str) -> DataFrame:
    """(cycle, due): light from 20 unconsolidated turns, deep from 5 new digests, dream from 10
    sessions and a day since the last run, decay after 7 days; from counts and the run ledger."""
    at = F.lit(now).cast("timestamp")
    last = runs.where("status = 'completed'").groupBy("cycle").agg(F.max("completed_at").alias("last"))
    open_ = episodes.where("consolidated_at is null and forgotten_at is null")
    fresh = digests.join(F.broadcast(last.where("cycle = 'deep'").select("last")), F.col("created_at") > F.col("last"), "left_semi") if runs.where("cycle = 'deep' and status = 'completed'").limit(1).count() else digests
    sessions = open_.select("session_id").union(digests.select("session_id")).where("session_id is not null").distinct()
    counts = {"light": (open_, 20), "deep": (fresh, 5), "dream": (sessions, 10)}
    rows = [df.agg((F.count(F.lit(1)) >= n).alias("enough")).select(F.lit(c).alias("cycle"), "enough") for c, (df, n) in counts.items()]
    gates = rows[0].union(rows[1]).union(rows[2]).union(episodes.sparkSession.range(1).select(F.lit("decay").alias("cycle"), F.lit(True).alias("enough")))
    waited = F.when(F.col("cycle") == "decay", F.expr("interval 7 days")).when(F.col("cycle") == "dream", F.expr("interval 1 days")).otherwise(F.expr("interval 0 days"))
    return gates.join(last, "cycle", "left").select("cycle", (F.col("enough") & (F.col("last").isNull() | (F.col("last") <= at - waited))).alias("due"))
