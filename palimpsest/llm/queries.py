"""Queries of the training-data operators, and their SQL twins where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.catalog import BASE_SQL
from palimpsest.functions.text import divisible_id
from palimpsest.llm import cooccur, dedup, grading, knn, leak, packing, pii, threads
from palimpsest.operators.history import latest_records
from palimpsest.runtime import Scratch, table


def _fed(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """All episodes through one stored state: what came before the last weekly batch that is closed
    as one load, then that batch and what came after it."""
    rows = table(spark, sf_dir, "episodes").select("id", F.unix_micros("created_at").alias("ts"), "content").where("created_at is not null")
    last = rows.agg(F.max("ts")).first()[0] or 0
    batch = table(spark, sf_dir, "ingest_batches").select(F.unix_micros("opened_at").alias("a"), F.unix_micros("closed_at").alias("b")).where(F.col("b") <= last).orderBy(F.col("b").desc()).first()
    state = dedup.AcceptedTexts(spark, Scratch(spark, "accepted").root)
    return dedup.feed(state, rows, [batch["a"] if batch else last + 1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _fed(spark, sf_dir)
    return before.unionByName(after)


def p1_last_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows since the last closed weekly batch opened, against the stored state of all before."""
    return _fed(spark, sf_dir)[1]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.session_defects(table(spark, sf_dir, "episodes"))


def p2_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.link_trees(threads.ordered_turns(table(spark, sf_dir, "episodes")))


def p2_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.clean_conversations(table(spark, sf_dir, "episodes"))


def _associations(spark: SparkSession, sf_dir: str, **limits: float) -> DataFrame:
    return cooccur.associations(cooccur.baskets_from_json(table(spark, sf_dir, "episodes"), "id", "entities_json"), **limits)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("together") * F.col("n") >= 3 * F.col("n_a") * F.col("n_b")
    return _associations(spark, sf_dir).where(case).select(F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"))


def p6_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = [F.round(c, 6).alias(c) for c in ("lift", "pmi", "jaccard")]
    return _associations(spark, sf_dir, min_support=0.0).select(F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"), "together", "n_a", "n_b", *scores)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding) of all three tiers, one row an id."""
    episodes, digests = (table(spark, sf_dir, t).select("id", "embedding").dropDuplicates(["id"]) for t in ("episodes", "digests"))
    semantic = latest_records(table(spark, sf_dir, "semantic").select("id", "updated_at", "created_at", "embedding")).select("id", "embedding")
    return episodes.unionByName(digests).unionByName(semantic)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = knn.neighbours(_vectors(spark, sf_dir))
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar of every fiftieth record, among all records and however far away."""
    vectors = _vectors(spark, sf_dir)
    return knn.search(vectors.where(divisible_id(F.col("id"))).select("id"), vectors).withColumn("cosine", F.round("cosine", 6))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).withColumn("part", F.round("part", 6))


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    episodes = table(spark, sf_dir, "episodes").select(F.lit("episode").alias("tier"), "id", "content")
    semantic = latest_records(table(spark, sf_dir, "semantic").select("id", "updated_at", "created_at", "content"))
    rows = episodes.unionByName(semantic.select(F.lit("semantic").alias("tier"), "id", "content"))
    return pii.find(rows, table(spark, sf_dir, "name_parts"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).select("tier", "id", F.explode("kinds").alias("kind")).distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir).select("tier", "id", "redacted").distinct()


def _packed(spark: SparkSession, sf_dir: str, window: str) -> DataFrame:
    capacity = table(spark, sf_dir, "context_windows").where(F.col("window_name") == window).first()["capacity_tokens"]
    return packing.pack_documents(packing.token_counts(table(spark, sf_dir, "documents")), capacity)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, "standard").where("pieces > 1").select("doc_id").distinct()


def p7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, "standard")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the windows of every capacity come out."""
    names = {r["window_name"]: r["capacity_tokens"] for r in table(spark, sf_dir, "context_windows").select("window_name", "capacity_tokens").distinct().collect()}
    scratch = Scratch(spark, "fill")
    return packing.fill_rates(scratch.keep(packing.token_counts(table(spark, sf_dir, "documents")), "lengths"), names)


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "graded_samples"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).where("grade in (1, 5)").select("doc_id", "grade")


def p9_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).withColumn("value", F.round("value", 3))


QUERIES = {f.__name__: f for f in (p1_found, p1_last_batch, p2_found, p2_threads, p2_conversations, p4_found, p4_redacted, p5_found, p5_neighbours, p6_found, p6_associations, p7_found, p7_windows, p7_fill, p8_found, p8_report, p9_found, p9_grades)}

_ROLES = ", ".join(f"'{k}': '{v}'" for k, v in threads.ROLE_NAMES.items())

SQL = {
    "p2_found": BASE_SQL
    + f""", m AS (SELECT session_id, id, created_at, MAP {{{_ROLES}}}[lower(trim(role, ' ' || chr(9) || chr(10) || chr(13)))] AS who FROM ep
      WHERE session_id IS NOT NULL AND regexp_matches(content, '[\\p{{L}}\\p{{N}}]')),
    t AS (SELECT *, lag(who) OVER w AS prev, row_number() OVER w AS first, lead(id) OVER w IS NULL AS last FROM m WHERE created_at IS NOT NULL AND who IN ('user', 'assistant')
      WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id))
    SELECT DISTINCT session_id, 'bad_row' AS defect FROM m WHERE created_at IS NULL OR who IS NULL
    UNION SELECT session_id, 'empty' FROM episodes WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM t)
    UNION SELECT session_id, 'bad_order' FROM t WHERE prev = who OR (first = 1 AND who <> 'user')
    UNION SELECT session_id, 'no_reply' FROM t WHERE last AND who = 'user'""",
    "p5_found": BASE_SQL
    + """, v AS (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM mem WHERE len(embedding) = 32
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    s AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.e, b.e), 12) AS c FROM v a JOIN v b ON a.id <> b.id),
    r AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS rank FROM s WHERE c >= 0.95)
    SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM r WHERE rank <= 5""",
    "p6_found": BASE_SQL
    + """, j AS (SELECT id, CASE WHEN json_valid(entities_json) AND json_type(entities_json) = 'ARRAY' THEN json_extract(entities_json, '$[*]') END AS xs FROM ep),
    u AS (SELECT id, unnest(xs) AS x FROM j), i AS (SELECT DISTINCT id, lower(trim(x ->> '$', ' ' || chr(9) || chr(10) || chr(13))) AS item FROM u WHERE json_type(x) = 'VARCHAR'),
    b AS (SELECT id, item FROM i WHERE item <> ''), n AS (SELECT count(DISTINCT id) AS n FROM b), one AS (SELECT item, count(*) AS c FROM b GROUP BY 1),
    p AS (SELECT x.item AS entity_a, y.item AS entity_b, count(*) AS c FROM b x JOIN b y ON x.id = y.id AND x.item < y.item GROUP BY 1, 2)
    SELECT entity_a, entity_b FROM p JOIN one a ON a.item = entity_a JOIN one z ON z.item = entity_b, n WHERE 1000 * p.c >= n AND p.c * n >= 3 * a.c * z.c""",
}
