"""The engine's interface: a folder of tier tables, read and written as frames.

Reads are lazy plans; writes append new files or replace a table by writing the next version
beside it and switching the version file.  Nothing of a tier's size reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import catalog, schema
from palimpsest.functions import lexicon as L
from palimpsest.functions import text as T
from palimpsest.operators import consolidation, fusion, graph, rounds, scans, sequence, synthesis, text_search, vectors
from palimpsest.runtime import Scratch, ship_code


@dataclass(frozen=True)
class Recall:
    """Result frames of one recall; ``deltas`` are the writes a caller may commit."""

    mode: str
    memories: DataFrame
    associations: DataFrame
    sessions: DataFrame
    primed: DataFrame
    deltas: dict[str, DataFrame]


@dataclass(frozen=True)
class Intelligence:
    """The model-backed steps, each a plain function or None; without one the rule named stands in.

    Functions run on the driver over one query or the bounded rows of one result.
    """

    #: text -> vector; without it recall is by text alone
    embed: Callable[[str], list[float]] | None = None
    #: query -> an invented answer, for the second pass; without it there is none
    hypothetical: Callable[[str], str] | None = None
    #: query -> further search terms; without it none
    expand: Callable[[str], list[str]] | None = None
    #: (query, texts) -> a score each; without it the order of relevance stands
    rerank: Callable[[str, list[str]], list[float]] | None = None
    #: (query, lines, mode) -> [(index, instance, date_text)]; without it the plain notes are made
    select: Callable[[str, list[str], str], list[tuple[int, str | None, str | None]]] | None = None
    #: (question, [(id, text)]) -> the next query of a multi-hop recall; without it one round
    propose: Callable[[str, list[tuple[str, str]]], str | None] | None = None


class Memory:
    """Memory over tables ``episodes, digests, semantic, procedural, associations, runs`` in a
    folder.  ``embed`` (optional) maps a query text to a vector; without it recall is by text."""

    TABLES = {"episodes": schema.EPISODES, "digests": schema.DIGESTS, "semantic": schema.SEMANTIC, "procedural": schema.PROCEDURAL, "associations": schema.ASSOCIATIONS, "runs": schema.RUNS}

    def __init__(self, spark: SparkSession, folder: str, project: str | None = None, embed: Callable[[str], list[float]] | None = None, intelligence: Intelligence | None = None):
        ship_code(spark)
        self.model = intelligence or Intelligence(embed=embed)
        self.spark, self.folder, self.project, self.embed = spark, folder.rstrip("/"), project, self.model.embed

    # --- tables ---------------------------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _version(self, name: str) -> int:
        fs, root = self._fs(f"{self.folder}/{name}")
        if not fs.exists(root):
            return 0
        done = [s.getPath() for s in fs.listStatus(root) if fs.exists(s.getPath().suffix("/_SUCCESS"))]
        return max((int(p.getName().split("=")[1]) for p in done), default=0)

    def table(self, name: str) -> DataFrame:
        version = self._version(name)
        if not version:
            return self.spark.createDataFrame([], self.TABLES[name])
        return self.spark.read.schema(self.TABLES[name]).parquet(f"{self.folder}/{name}/v={version}")

    def append(self, name: str, rows: DataFrame) -> None:
        """New files into the current version; ids that are there stay as they are."""
        version = max(1, self._version(name))
        have = self.table(name)
        key = "run_id" if name == "runs" else "id"
        fresh = rows.dropDuplicates([key]).join(have.select(key), key, "left_anti")
        empty = self.spark.createDataFrame([], self.TABLES[name])
        aligned = empty.unionByName(fresh, allowMissingColumns=True).select(*empty.columns)
        aligned.write.mode("append").parquet(f"{self.folder}/{name}/v={version}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """The next version of a table; readers of the old one are not disturbed."""
        rows.select(*self.table(name).columns).write.parquet(f"{self.folder}/{name}/v={self._version(name) + 1}")

    def view(self) -> DataFrame:
        every = catalog.all_tiers(self.table("episodes"), self.table("digests"), self.table("semantic"), self.table("procedural"))
        return catalog.in_project(catalog.live(every), self.project)

    # --- write path -----------------------------------------------------------------------------

    def ingest(self, messages: DataFrame, now: str) -> None:
        """``messages(id, session_id, role, content, created_at[, metadata, embedding, project_id])``:
        cleans, scores, extracts entities, appends, and links turns at most five apart."""
        m = messages.withColumn("role", F.lower(F.trim("role"))).where(L.should_ingest(F.col("content"), F.col("role")))
        cleaned = T.parts_text(F.col("content"))
        rows = m.withColumns({"content": cleaned, "salience": L.salience(cleaned), "entities_json": F.to_json(L.entities(cleaned)), "access_count": F.lit(0).cast("long"), "created_at": F.coalesce("created_at", F.lit(now).cast("timestamp"))})
        rows = rows.where(F.length("content") >= 2)
        self.append("episodes", rows)
        touched = self.table("episodes").join(rows.select("session_id").distinct(), "session_id", "left_semi")
        ahead = sequence.following(touched, "session_id", sequence.day_bucket("created_at"), ["created_at", "id"], 5, ["id", "salience"], "_a").select(F.col("id").alias("source_id"), "salience", F.explode("_a").alias("n"))
        self._link(ahead.select("source_id", F.col("n.id").alias("target_id"), F.lit("episode").alias("source_type"), F.lit("episode").alias("target_type"), F.lit("temporal").alias("edge_type"), L.salience_gate(F.lit(0.3), F.coalesce("salience", F.lit(0.3)), F.coalesce("n.salience", F.lit(0.3))).alias("strength")), now)

    def _link(self, edges: DataFrame, now: str) -> None:
        key = F.sha2(F.concat_ws("|", "source_id", "target_id", "edge_type"), 256)
        self.append("associations", edges.withColumns({"id": key, "created_at": F.lit(now).cast("timestamp")}))

    # --- read path ------------------------------------------------------------------------------

    def recall(self, query: str, now: str, limit: int = 30, embedding: list[float] | None = None, session: str | None = None, as_of: str | None = None) -> Recall:
        """Hybrid recall: mode and signals of the query, vector candidates with text boost and
        rescue, composite score, project preference, diversification, sessions, and (deep mode)
        associated memories."""
        q = self.spark.createDataFrame([("q", query)], "query_id string, query string")
        s = L.query_signals(F.col("query"))
        found = q.select(L.recall_mode(F.col("query")).alias("mode"), s["multi_hop"].alias("m"), s["temporal"].alias("t")).first()
        mode = found["mode"]
        top, hops, recency = L.MODE_PARAMS[mode]
        top = min(limit, top)
        view = catalog.in_session(self.view(), session)
        if as_of is not None:
            facts = scans.point_in_time(self.table("semantic"), as_of).select("id")
            view = view.where("memory_type <> 'semantic'").unionByName(view.where("memory_type = 'semantic'").join(facts, "id", "left_semi"))
        vector = embedding if embedding is not None else (self.embed(query) if self.embed else None)
        if self.model.expand:
            q = self.spark.createDataFrame([("q", " ".join([query, *self.model.expand(query)]))], "query_id string, query string")
        # the best rows, at most ``top``, are read by all that follows
        scratch = Scratch(self.spark, "recall")
        best = scratch.keep(self._searched(view, q, vector, top, now, recency), "first")
        if self.model.hypothetical and self.embed:
            high = best.agg(F.max("relevance")).first()[0]
            if rounds.second_pass_due(high, found["m"], found["t"]):
                again = scratch.keep(self._searched(view, q, self.embed(self.model.hypothetical(query)), top, now, recency), "second")
                both = rounds.second_pass(best, again, top).select("id", F.col("rank").alias("_rank"))
                rows = best.unionByName(again).dropDuplicates(["id"])
                best = scratch.keep(rows.join(both, "id").withColumn("rank", F.col("_rank")).drop("_rank"), "fused")
        if self.model.rerank:
            some = best.where("rank <= 25").orderBy("rank").select("id", "content").collect()  # what a reranker reads at once
            scores = self.spark.createDataFrame(list(zip((r["id"] for r in some), map(float, self.model.rerank(query, [r["content"] for r in some])))), "id string, _score double")
            harder = F.lit(bool(found["m"] or found["t"]))
            blended = fusion.rerank_blend(F.col("relevance"), F.col("_score"), harder)
            best = best.join(scores, "id", "left").withColumn("relevance", F.when(F.col("rank") <= 25, F.round(blended, 6)).otherwise(F.col("relevance"))).drop("_score", "rank")
            best = scratch.keep(fusion.ranked(best, "relevance"), "reranked")
        order = scratch.keep(fusion.mmr(best.select("query_id", "id", "relevance", "content")), "order")
        memories = order.join(best.drop("relevance", "query_id"), "id").orderBy("position")
        sessions = fusion.session_ranking(best.withColumn("event_at", F.col("created_at")))
        edges = self.table("associations").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("strength").alias("weight"), "edge_type")
        seeds = best.where("rank <= 5").select("id")
        walked = graph.walk(edges, seeds, max(hops, 1), 0.2, limit=20)
        reached = walked.join(best.select("id"), "id", "left_anti").join(self.view().drop("embedding"), "id") if hops else self.view().drop("embedding").limit(0).withColumns({"depth": F.lit(0), "strength": F.lit(0.0)})
        strongest = best.where("rank <= 5").agg(F.max("relevance").alias("_seed"))
        associated = reached.crossJoin(F.broadcast(strongest)).withColumn("relevance", F.col("_seed") * F.col("strength") * 0.8).drop("_seed").orderBy(F.col("relevance").desc(), "id").limit(10)
        words = F.filter(F.split(F.lower("content"), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
        primed = best.select(F.explode(F.array_distinct(words)).alias("topic")).where(~F.col("topic").isin(*T.QUERY_STOP)).groupBy("topic").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("topic", (0.15 * F.least("n", F.lit(5))).alias("boost"))
        pairs = graph.pairs_within(best.where("rank <= 5").select("query_id", "id", "rank"), "query_id", ["rank"], 4).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))
        return Recall(mode, memories, associated, sessions, primed, {"accessed": best.select("id", "memory_type"), "co_recalled": pairs})

    def _searched(self, view: DataFrame, q: DataFrame, vector: list[float] | None, top: int, now: str, recency: float) -> DataFrame:
        """The ``top`` rows of one pass, with relevance and rank."""
        terms = text_search.top(text_search.normalised(text_search.bm25(view, q)), 5 * max(top, 1)).select("query_id", "id", F.col("score").alias("boost"))
        near = vectors.scan_topk(view.select("id", "embedding"), [("q", vector)] if vector is not None else [], 4 * max(top, 1)).where("similarity > 0")
        rows = fusion.boost_and_rescue(near, terms).join(view.drop("embedding"), "id")
        score = fusion.composite_score(F.col("similarity"), F.col("boost"), F.coalesce("created_at", F.lit(now).cast("timestamp")), F.col("access_count"), F.col("role"), F.col("content"), now, recency)
        rows = fusion.prefer_project(rows.withColumn("relevance", F.round(score, 6)), self.project)
        return fusion.ranked(rows, "relevance").where(F.col("rank") <= top)

    def recall_rounds(self, question: str, now: str, most: int = 3, limit: int = 20) -> tuple[DataFrame, list[str]]:
        """Multi-hop recall: (query_id, id, position) over at most ``most`` rounds, and the queries asked."""
        one = lambda query: self.recall(query, now).memories.select("id", "content", F.col("position").alias("rank"))
        return rounds.iterate(question, one, self.model.propose or (lambda _, __: None), most, limit)

    def notes(self, query: str, recall: Recall, now: str | None = None, most_sessions: int | None = None) -> DataFrame:
        """Notes derived from a recall, at most one row (see ``synthesis.synthesize``)."""
        asked = self.spark.createDataFrame([("q", query, now)], "query_id string, query string, n string").select("query_id", "query", F.col("n").cast("timestamp").alias("now"))
        rows = recall.memories.select("query_id", F.col("position").alias("rank"), "id", "session_id", F.col("created_at").alias("event_at"), "content")
        groups = recall.sessions.select("query_id", "session_id", "position", "earliest", F.size("memory_ids").alias("n"))
        replies = None
        mode = asked.select(L.synthesis_intent(F.col("query")).alias("i")).first()["i"]
        if self.model.select and mode != "none":
            lines = [r["content"][: synthesis.LINE_CHARS] for r in rows.where(F.col("rank") <= synthesis.MOST_LINES).orderBy("rank").select("content").collect()]
            items = [tuple(x) for x in self.model.select(query, lines, mode)]
            replies = self.spark.createDataFrame([("q", items)], "query_id string, items array<struct<index:int,instance:string,date_text:string>>")
        return synthesis.synthesize(asked, rows, groups, replies, most_sessions)

    def commit(self, recall: Recall, now: str) -> None:
        """Writes a recall's access counts and co-recall edges."""
        for name, tier, boost in (("episodes", "episode", 0.0), ("semantic", "semantic", 0.05)):
            hits = recall.deltas["accessed"].where(F.col("memory_type") == tier).select("id")
            self.replace(name, scans.record_access(self.table(name), hits, now, boost))
        have = self.table("associations")
        pairs = recall.deltas["co_recalled"].distinct().withColumn("edge_type", F.lit("co_recalled"))
        again = have.join(pairs.withColumn("_hit", F.lit(True)), ["source_id", "target_id", "edge_type"], "left")
        again = again.withColumn("strength", F.when(F.col("_hit"), F.least(F.lit(1.0), F.col("strength") + 0.1)).otherwise(F.col("strength")))
        fresh = pairs.join(have, ["source_id", "target_id", "edge_type"], "left_anti").withColumns({"strength": F.lit(0.2), "id": F.sha2(F.concat_ws("|", "source_id", "target_id", "edge_type"), 256), "created_at": F.lit(now).cast("timestamp")})
        self.replace("associations", again.select(*have.columns).unionByName(fresh, allowMissingColumns=True))

    def forget(self, query: str, now: str, tier: str | None = None, confirm: bool = False, min_relevance: float = 0.5, embedding: list[float] | None = None) -> DataFrame:
        """Rows a query would forget; with ``confirm`` they are stamped."""
        hits = self.recall(query, now, embedding=embedding).memories.where(F.col("relevance") >= min_relevance)
        hits = hits if tier is None else hits.where(F.col("memory_type") == tier)
        hits = hits.select("id", "memory_type", "relevance", "content")
        if confirm:
            for name, kind in (("episodes", "episode"), ("semantic", "semantic"), ("procedural", "procedural")):
                self.replace(name, scans.stamp(self.table(name), hits.where(F.col("memory_type") == kind), "forgotten_at", now))
        return hits

    def timeline(self, topic: str, start: str | None = None, end: str | None = None) -> DataFrame:
        return scans.topic_timeline(catalog.in_project(self.table("semantic"), self.project), topic, start, end).orderBy("effective_at", "id")

    def session(self, session: str) -> DataFrame:
        return scans.by_session(self.table("episodes"), session).orderBy("created_at", "id")

    def expand(self, digest_id: str) -> DataFrame:
        ids = scans.by_id(self.table("digests"), digest_id).select(F.explode("source_episode_ids").alias("id"))
        return self.table("episodes").join(ids, "id", "left_semi")

    def bridges(self, a: str, b: str) -> DataFrame:
        """Nodes linked to memories of both projects, with counts on each side."""
        links = self.table("associations").select(F.col("target_id").alias("node"), F.col("source_id").alias("id"))
        side = links.join(self.table("episodes").where(F.col("project_id").isin(a, b)).select("id", "project_id"), "id")
        n = side.groupBy("node").agg(F.count_distinct(F.when(F.col("project_id") == a, F.col("id"))).alias("n_a"), F.count_distinct(F.when(F.col("project_id") == b, F.col("id"))).alias("n_b"))
        return n.where("n_a > 0 and n_b > 0").orderBy((F.col("n_a") + F.col("n_b")).desc(), "node")

    def stats(self) -> DataFrame:
        frames = {n: self.table(n) for n in ("episodes", "digests", "semantic", "procedural", "associations")}
        frames["semantic"] = frames["semantic"].where("superseded_by is null")
        out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tier"), "n") for n, df in frames.items()]
        return out[0].union(out[1]).union(out[2]).union(out[3]).union(out[4])

    # --- consolidation --------------------------------------------------------------------------

    def consolidate(self, now: str, cycle: str = "all") -> None:
        """Runs light, deep, dream and decay (or one of them) and writes the run ledger."""
        for name in ("light", "deep", "dream", "decay") if cycle == "all" else (cycle,):
            getattr(self, f"_{name}")(now)
            run = self.spark.createDataFrame([(f"{name}-{now}", name, "completed", now, now)], "run_id string, cycle string, status string, s string, c string")
            self.append("runs", run.withColumns({"started_at": F.col("s").cast("timestamp"), "completed_at": F.col("c").cast("timestamp")}).drop("s", "c"))

    def _light(self, now: str) -> None:
        made = consolidation.light_sleep(self.table("episodes"), now)
        digests, used = made["digests"], made["consolidated"]
        self.append("digests", digests.select("id", "session_id", "summary", "key_topics", "source_episode_ids", "level", "created_at", "project_id"))
        self._link(made["edges"].withColumns({"source_type": F.lit("digest"), "target_type": F.lit("episode")}), now)
        self.replace("episodes", scans.stamp(self.table("episodes"), used, "consolidated_at", now))

    def _deep(self, now: str) -> None:
        facts = self.table("semantic")
        made = consolidation.deep_sleep(self.table("digests"), facts, now)
        fresh = made["inserts"].select(F.col("new_id").alias("id"), "topic", "content", "confidence", "source_digest_ids", "created_at").withColumns({"access_count": F.lit(0).cast("long"), "decay_rate": F.lit(0.02), "updated_at": F.col("created_at")})
        boosted = scans.record_access(facts, made["boosts"], now, 0.1)
        linked = scans.supersede(boosted.unionByName(fresh.join(facts.select("id"), "id", "left_anti"), allowMissingColumns=True), made["supersessions"], now)
        self.replace("semantic", linked)

    def _dream(self, now: str) -> None:
        rows = self.table("episodes").where("forgotten_at is null").select("id", "created_at", F.from_json("entities_json", "array<string>").alias("entities")).where("entities is not null")
        pairs = consolidation.entity_pairs(rows, self.table("associations"), now).where("a <> b")
        self._link(pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit("episode").alias("source_type"), F.lit("episode").alias("target_type"), F.lit("topical").alias("edge_type"), consolidation.topical_strength(F.col("shared")).alias("strength")), now)

    def _decay(self, now: str) -> None:
        edges = self.table("associations").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("strength").alias("weight"))
        facts = self.table("semantic")
        if edges.isEmpty():
            self.replace("semantic", consolidation.decay_flat(facts, now))
        else:
            self.replace("semantic", consolidation.decay_gradient(facts, graph.pagerank(edges), now))
        self.replace("associations", consolidation.prune_weak(self.table("associations"), now))
