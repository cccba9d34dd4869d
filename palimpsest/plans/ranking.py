"""Queries over vectors, fusion, ranking and diversification (inventory 43-60, 88-108, 158-176, 205-215, 226)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.catalog import Tables
from palimpsest.functions import lexicon as L
from palimpsest.functions import text as T
from palimpsest.operators import fusion, metrics, sequence, text_search, vectors
from palimpsest.plans import lexical
from palimpsest.plans.registry import NOW, Registry

R = Registry()
DIMS = 64
_SIM = "round(list_cosine_similarity(CAST({a}.embedding AS DOUBLE[]), CAST({b}.embedding AS DOUBLE[])), 6)"
_Q0 = "q AS (SELECT * FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"
_ALL = f"{_Q0}, s AS (SELECT e.vec_id AS id, e.label, {_SIM.format(a='e', b='q')} AS similarity FROM embeddings e, q)"
_MANY = f"s AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, e.vec_id AS id, {_SIM.format(a='e', b='q')} AS similarity FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q ON e.vec_id <> q.vec_id)"


def _rows(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding")


def _first_query(t: Tables) -> list[tuple[str, list[float]]]:
    r = t.embeddings.orderBy("vec_id").first()
    return [(str(r["vec_id"]), r["embedding"])]


def _stated_queries(t: Tables) -> list[tuple[str, list[float]]]:
    """Every vector whose id is divisible by 50, at most ``MAX_QUERIES`` of them a scan."""
    return [(str(r["vec_id"]), r["embedding"]) for r in t.embeddings.where("vec_id % 50 = 0").collect()]


@R.query(f"WITH {_ALL} SELECT * FROM (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM s) WHERE rank <= 15", base=False)
def vector_topk(t: Tables) -> DataFrame:
    return vectors.scan_topk(_rows(t), _first_query(t), 15, "long").drop("query_id")


@R.query(f"WITH {_ALL} SELECT * FROM (SELECT label % 4 AS tier, id, similarity, row_number() OVER (PARTITION BY label % 4 ORDER BY similarity DESC, id) AS rank FROM s WHERE similarity >= 0) WHERE rank <= 5", base=False)
def vector_topk_per_tier(t: Tables) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _first_query(t)[0][1]])
    scored = t.embeddings.select((F.col("label") % 4).alias("tier"), F.col("vec_id").alias("id"), F.round(vectors.cosine(F.col("embedding"), q), 6).alias("similarity")).where("similarity >= 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("tier").orderBy(F.col("similarity").desc(), "id"))).where("rank <= 5")


@R.query(f"WITH {_ALL} SELECT id, similarity FROM s WHERE similarity >= 0.1", base=False)
def vector_min_similarity(t: Tables) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _first_query(t)[0][1]])
    return _rows(t).select("id", F.round(vectors.cosine(F.col("embedding"), q), 6).alias("similarity")).where("similarity >= 0.1")


@R.query(f"WITH {_MANY} SELECT * FROM (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) WHERE rank <= 10", base=False)
def vector_leave_one_out(t: Tables) -> DataFrame:
    return vectors.scan_topk(_rows(t), _stated_queries(t), 10, "long", exclude_self=True)


@R.query(f"WITH {_MANY} SELECT * FROM (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s WHERE similarity >= 0.3) WHERE rank <= 1", base=False)
def near_duplicate_best(t: Tables) -> DataFrame:
    return vectors.scan_topk(_rows(t), _stated_queries(t), 1, "long", min_similarity=0.3, exclude_self=True)


@R.query()
def quantized_topk(t: Tables) -> DataFrame:
    codes = vectors.encode_table(_rows(t), DIMS, id_type="long")
    return vectors.quantized_topk(codes, _rows(t), _first_query(t)[0][1], 10, DIMS, id_type="long")


_RANKED = f"""WITH {_ALL}, v AS (SELECT * FROM (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM s) WHERE rank <= 50),
w AS (SELECT vec_id AS id, row_number() OVER (ORDER BY label DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 50)"""


def _vector_list(t: Tables) -> DataFrame:
    return vectors.scan_topk(_rows(t), _first_query(t), 50, "long").withColumn("query_id", F.lit("q"))


def _label_list(t: Tables) -> DataFrame:
    best = t.embeddings.select(F.lit("q").alias("query_id"), F.col("vec_id").alias("id"), "label").orderBy(F.col("label").desc(), "id").limit(50)
    return fusion.ranked(best, "label")


@R.query(_RANKED + " SELECT id, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(0.5 / (60 + w.rank), 0), 6) AS score FROM v FULL OUTER JOIN w USING (id)", base=False)
def rrf_fusion(t: Tables) -> DataFrame:
    return fusion.reciprocal_rank(_vector_list(t), _label_list(t), 1.0, 0.5).select("id", F.round("score", 6).alias("score"))


@R.query(_RANKED + " SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT id, rank FROM v UNION ALL SELECT id, rank FROM w) GROUP BY id", base=False)
def fuse_lists(t: Tables) -> DataFrame:
    return fusion.fuse([_vector_list(t), _label_list(t)]).select("id", F.round("score", 6).alias("score"))


@R.query(_RANKED + " SELECT id, max(r) AS relevance FROM (SELECT id, similarity AS r FROM v UNION ALL SELECT id, CAST(rank AS DOUBLE) / 100 FROM w) GROUP BY id", base=False)
def max_merge(t: Tables) -> DataFrame:
    a = _vector_list(t).withColumn("relevance", F.col("similarity"))
    b = _label_list(t).withColumn("relevance", F.col("rank").cast("double") / 100)
    return fusion.max_merge(a, b).select("id", F.round("relevance", 6).alias("relevance"))


@R.query(_RANKED + " SELECT id, row_number() OVER (ORDER BY rank, rd, id) AS position FROM (SELECT id, min(rank) AS rank, arg_min(rd, (rank, rd)) AS rd FROM (SELECT id, rank, 0 AS rd FROM v UNION ALL SELECT id, rank, 1 FROM w) GROUP BY id) QUALIFY position <= 40", base=False)
def interleave_rounds(t: Tables) -> DataFrame:
    both = _vector_list(t).select("query_id", F.lit(0).alias("round"), "rank", "id").unionByName(_label_list(t).select("query_id", F.lit(1).alias("round"), "rank", "id"))
    return fusion.interleave(both, 40).select("id", "position")


# the queries: facts whose id is divisible by 50, by their topic and by their own vector, against episodes
_USABLE = "len(embedding) = 32 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_DIVISIBLE = "list_reduce(list_transform(string_split(replace(id, '-', ''), ''), lambda c: strpos('0123456789abcdef', c) - 1), lambda a, b: (a * 16 + b) % 50) = 0"
_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_PAIR = f"""+ asked AS (SELECT id AS query_id, topic, embedding FROM se WHERE {_DIVISIBLE}),
d AS (SELECT id, w, len(w) AS length FROM (SELECT id, {_TOKENS.format('content')} AS w FROM ep WHERE content IS NOT NULL) WHERE len(w) > 0), stats AS (SELECT count(*) AS n_docs, avg(length) AS avg_length FROM d),
q AS (SELECT query_id, unnest(list_distinct({_TOKENS.format('topic')})) AS term FROM asked),
tf AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, length, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT query_id, id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) AS score FROM tf JOIN q USING (term) JOIN df USING (term), stats GROUP BY 1, 2),
bm AS (SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM raw),
t AS (SELECT query_id, id, score AS boost FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 200),
sv AS (SELECT query_id, e.id, {_SIM.format(a='e', b='asked')} AS similarity FROM asked JOIN ep e ON true WHERE {_USABLE.replace('embedding', 'e.embedding')} AND {_USABLE.replace('embedding', 'asked.embedding')}),
v AS (SELECT * FROM sv QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 200)"""


def _asked(t: Tables) -> DataFrame:
    return t.semantic.where(T.divisible_id(F.col("id")))


def _text_hits(t: Tables) -> DataFrame:
    queries = _asked(t).select(F.col("id").alias("query_id"), F.col("topic").alias("query"))
    return text_search.bm25_top(t.episodes.where("content is not null"), queries, 200).select("query_id", "id", F.col("score").alias("boost"))


def _vector_hits(t: Tables) -> DataFrame:
    """Episodes near the query's own vector: the same ids as the text hits."""
    queries = [(r["id"], r["embedding"]) for r in _asked(t).where(vectors.usable(F.col("embedding"), 32)).select("id", "embedding").collect()]  # the stated queries
    return vectors.scan_topk(t.episodes.select("id", "embedding"), queries, 200).select("query_id", "id", "similarity")


@R.query(_PAIR + " SELECT query_id, id, round(0.4 * coalesce(boost, 0) + 0.6 * coalesce(similarity, 0), 6) AS score FROM t FULL OUTER JOIN v USING (query_id, id) WHERE 0.4 * coalesce(boost, 0) + 0.6 * coalesce(similarity, 0) > 0")
def hybrid_score(t: Tables) -> DataFrame:
    return fusion.hybrid(_text_hits(t), _vector_hits(t)).select("query_id", "id", F.round("score", 6).alias("score"))


@R.query(_PAIR + " SELECT query_id, id, coalesce(similarity, 0) AS similarity, coalesce(boost, 0) AS boost, similarity IS NULL AS rescued FROM t FULL OUTER JOIN v USING (query_id, id)")
def boost_and_rescue(t: Tables) -> DataFrame:
    return fusion.boost_and_rescue(_vector_hits(t), _text_hits(t))


_FAILED = f"""(coalesce(role = 'assistant' AND regexp_matches(content, '(?is){L.RECALL_FAILURE.replace(chr(39), chr(39) * 2)}')
    AND NOT regexp_matches(substr(content, strpos(content, regexp_extract(content, '(?is){L.RECALL_FAILURE.replace(chr(39), chr(39) * 2)}', 0)) + length(regexp_extract(content, '(?is){L.RECALL_FAILURE.replace(chr(39), chr(39) * 2)}', 0)), 80), '(?is){L.HEDGE.replace(chr(39), chr(39) * 2)}'), false))"""


@R.query(
    """SELECT id, round((salience + 0.15 * least(1, length(content) / 400.0) + 0.4 * exp(-(epoch_us($NOW) - epoch_us(created_at)) / 3600000000.0 / 720) + least(0.1, coalesce(access_count, 0) * 0.01)
    + CASE WHEN role = 'assistant' THEN 0.05 ELSE 0 END) * CASE WHEN """ + _FAILED + """ THEN 0.4 ELSE 1 END, 5) AS score FROM ep WHERE created_at IS NOT NULL AND content IS NOT NULL AND salience IS NOT NULL"""
)
def composite_score(t: Tables) -> DataFrame:
    rows = t.episodes.where("created_at is not null and content is not null and salience is not null")
    boost = F.least(F.lit(1.0), F.length("content") / 400.0)
    score = fusion.composite_score(F.col("salience"), boost, F.col("created_at"), F.col("access_count"), F.col("role"), F.col("content"), NOW, 0.4)
    return rows.select("id", F.round(score, 5).alias("score"))


@R.query(
    """SELECT id, round(CASE WHEN salience > 0.8 THEN 0.85 * coalesce(rr, 0) + 0.15 * salience ELSE 0.7 * coalesce(rr, 0) + 0.3 * salience END, 6) AS blended
    FROM (SELECT id, salience, CASE WHEN access_count > 0 THEN 1.0 / (1 + exp(-access_count / 10.0)) END AS rr FROM ep WHERE salience IS NOT NULL)"""
)
def rerank_blend(t: Tables) -> DataFrame:
    sigmoid = F.when(F.col("access_count") > 0, 1 / (1 + F.exp(-F.col("access_count") / 10.0)))
    return t.episodes.where("salience is not null").select("id", F.round(fusion.rerank_blend(F.col("salience"), sigmoid, F.col("salience") > 0.8), 6).alias("blended"))


_HITS = "h AS (SELECT *, row_number() OVER (ORDER BY round(salience, 6) DESC, id) AS rank FROM (SELECT * FROM ep WHERE salience IS NOT NULL ORDER BY round(salience, 6) DESC, id LIMIT 200))"


@R.query(
    "+" + _HITS + """, g AS (SELECT session_id, round(sum(1.0 / (60 + rank)), 6) AS mass, min(rank) AS best, count(*) AS n FROM h WHERE session_id IS NOT NULL GROUP BY 1)
    SELECT session_id, mass, n, best = (SELECT min(best) FROM g) AS head, row_number() OVER (ORDER BY (best = (SELECT min(best) FROM g)) DESC, mass DESC, session_id) AS position FROM g"""
)
def session_mass_ranking(t: Tables) -> DataFrame:
    top = t.episodes.where("salience is not null").withColumn("salience", F.round("salience", 6)).orderBy(F.col("salience").desc(), "id").limit(200)
    hits = fusion.ranked(top.withColumn("query_id", F.lit("q")), "salience").withColumn("event_at", F.coalesce(T.resolve_event_date(F.col("metadata")), "created_at"))
    return fusion.session_ranking(hits).select("session_id", F.round("mass", 6).alias("mass"), F.size("memory_ids").cast("long").alias("n"), "head", "position")


@R.query("+" + _HITS + " SELECT session_id, min(rank) AS first_rank FROM h WHERE session_id IS NOT NULL GROUP BY 1")
def first_distinct(t: Tables) -> DataFrame:
    top = t.episodes.where("salience is not null").withColumn("salience", F.round("salience", 6)).orderBy(F.col("salience").desc(), "id").limit(200)
    return fusion.ranked(top.withColumn("query_id", F.lit("q")), "salience").where("session_id is not null").groupBy("session_id").agg(F.min("rank").alias("first_rank"))


@R.query()
def mmr_diversified(t: Tables) -> DataFrame:
    hits = text_search.top(lexical.bm25_scores(t), 50)
    texts = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    rows = hits.join(texts, "id").select(F.col("query_id").cast("string").alias("query_id"), F.col("id").cast("string").alias("id"), F.col("score").alias("relevance"), "content")
    return fusion.mmr(rows)


@R.query(
    f"""WITH a AS (SELECT doc_id, {lexical._LEMMAS} AS l FROM documents WHERE text IS NOT NULL), p AS (SELECT q.doc_id AS query_id, d.doc_id AS id, len(list_intersect(q.l, d.l)) AS s, len(q.l) AS n, len(d.l) AS m FROM a q JOIN a d ON q.doc_id <> d.doc_id WHERE q.doc_id % 50 = 0)
    SELECT query_id, id, round(s / (n + m - s), 6) AS jaccard FROM p WHERE s > 0 AND s / (n + m - s) >= 0.5""", base=False
)
def jaccard_pairs(t: Tables) -> DataFrame:
    """Documents with at least half their words in common with a query document (id divisible by 50)."""
    words = t.documents.where("text is not null").select(F.col("doc_id").alias("id"), T.lemmas(F.col("text")).alias("words"))
    pairs = text_search.similar_texts(words, words.where("id % 50 = 0"), 0.5)
    return pairs.withColumn("jaccard", F.round("jaccard", 6))


@R.query(
    """+ u AS (SELECT id, session_id, role, content, created_at, lag(content, 1) OVER w AS p1, lag(content, 2) OVER w AS p2 FROM ep WHERE session_id IS NOT NULL AND created_at IS NOT NULL AND content IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id))
    SELECT id, coalesce(length(p1), 0) + coalesce(length(p2), 0) AS context_chars FROM u"""
)
def previous_context(t: Tables) -> DataFrame:
    rows = t.episodes.where("session_id is not null and created_at is not null and content is not null").select("id", "session_id", "created_at", "content")
    rows = sequence.preceding(rows, "session_id", sequence.day_bucket("created_at"), ["created_at", "id"], 2, ["content"], "before")
    return rows.select("id", F.aggregate("before", F.lit(0), lambda n, c: n + F.length(c["content"])).alias("context_chars"))


@R.query(
    """+ u AS (SELECT id, session_id, epoch_us(created_at) AS us FROM ep WHERE session_id IS NOT NULL AND created_at IS NOT NULL)
    SELECT id, count(*) OVER (PARTITION BY session_id ORDER BY us RANGE BETWEEN 1800000000 PRECEDING AND 1 PRECEDING) AS recent FROM u"""
)
def lookback_30min(t: Tables) -> DataFrame:
    from palimpsest.streaming.incremental import lookback

    return lookback(t.episodes.where("session_id is not null and created_at is not null").select("id", "session_id", "created_at")).select("id", "recent")


@R.query(
    """+ u AS (SELECT id, session_id, created_at, salience, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS p FROM ep WHERE session_id IS NOT NULL AND created_at IS NOT NULL)
    SELECT a.id AS a, b.id AS b, b.p - a.p AS gap, round(0.3 * greatest(0, least(1, (least(coalesce(a.salience, 0.3), coalesce(b.salience, 0.3)) - 0.15) / 0.25)), 6) AS strength FROM u a JOIN u b ON a.session_id = b.session_id AND b.p - a.p BETWEEN 1 AND 5"""
)
def temporal_pairs(t: Tables) -> DataFrame:
    from palimpsest.functions.lexicon import salience_gate

    rows = t.episodes.where("session_id is not null and created_at is not null").select("session_id", "id", "created_at", F.coalesce("salience", F.lit(0.3)).alias("s"))
    ahead = sequence.following(rows, "session_id", sequence.day_bucket("created_at"), ["created_at", "id"], 5, ["id", "s"], "ahead").select(F.col("id").alias("a"), "s", F.posexplode("ahead").alias("gap", "n"))
    return ahead.select("a", F.col("n.id").alias("b"), (F.col("gap") + 1).alias("gap"), F.round(salience_gate(F.lit(0.3), F.col("s"), F.col("n.s")), 6).alias("strength"))


@R.query("+" + _HITS + " SELECT id, lead(id) OVER (ORDER BY rank) AS next_id FROM h")
def consecutive_pairs(t: Tables) -> DataFrame:
    top = t.episodes.where("salience is not null").withColumn("salience", F.round("salience", 6)).orderBy(F.col("salience").desc(), "id").limit(200)
    return fusion.ranked(top.withColumn("query_id", F.lit("q")), "salience").select("id", F.lead("id").over(Window.partitionBy("query_id").orderBy("rank")).alias("next_id"))


@R.query(
    """+ u AS (SELECT dg.id AS digest_id, unnest(source_episode_ids) AS episode_id FROM dg)
    SELECT digest_id, count(DISTINCT ep.id) AS episodes, min(ep.created_at) AS earliest FROM u JOIN ep ON ep.id = u.episode_id GROUP BY 1"""
)
def digest_lineage(t: Tables) -> DataFrame:
    links = t.digests.select(F.col("id").alias("digest_id"), F.explode("source_episode_ids").alias("id")).distinct()
    return links.join(t.episodes.select("id", "created_at"), "id").groupBy("digest_id").agg(F.count(F.lit(1)).alias("episodes"), F.min("created_at").alias("earliest"))


@R.query(f"WITH {_MANY}, x AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) WHERE rank <= 10), p AS (SELECT query_id, id FROM s WHERE similarity >= 0.25) SELECT query_id, depth, round(avg(CASE WHEN p.id IS NULL THEN 0 ELSE 1 END), 6) AS contained FROM x LEFT JOIN p USING (query_id, id), (SELECT unnest([5, 10]) AS depth) WHERE rank <= depth GROUP BY 1, 2", base=False)
def containment_depth(t: Tables) -> DataFrame:
    queries = _stated_queries(t)
    exact = vectors.scan_topk(_rows(t), queries, 10, "long", exclude_self=True)
    pool = exact.where("similarity >= 0.25")
    return metrics.containment(exact, pool, [5, 10]).select("query_id", "depth", F.round("contained", 6).alias("contained"))


@R.query(f"WITH {_ALL} SELECT CAST(floor(similarity / 0.05) AS BIGINT) AS bucket, count(*) AS n FROM s GROUP BY 1", base=False)
def similarity_histogram(t: Tables) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _first_query(t)[0][1]])
    sims = _rows(t).select(F.round(vectors.cosine(F.col("embedding"), q), 6).alias("similarity"))
    return metrics.histogram(sims, "similarity", 0.05)


@R.query(f"WITH {_ALL} SELECT count(*) AS n, round(avg(similarity), 5) AS mean, quantile_disc(similarity, 0.5) AS p50, quantile_disc(similarity, 0.1) AS p10, min(similarity) AS min, max(similarity) AS max FROM s", base=False)
def similarity_stats(t: Tables) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _first_query(t)[0][1]])
    sims = _rows(t).select(F.round(vectors.cosine(F.col("embedding"), q), 6).alias("similarity"))
    return metrics.summary_stats(sims, "similarity").withColumn("mean", F.round("mean", 5))


@R.query("SELECT doc_id, tokens, CAST(used AS BIGINT) AS used FROM (SELECT doc_id, tokens, sum(tokens) OVER (PARTITION BY source ORDER BY written_at DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT doc_id, source, written_at, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL AND written_at IS NOT NULL)) WHERE used <= 2000", base=False)
def token_budget_take(t: Tables) -> DataFrame:
    rows = t.documents.where("text is not null and written_at is not null").select("doc_id", "source", "written_at", T.token_estimate(F.col("text")).alias("tokens"))
    order = [F.col("written_at").desc(), F.col("doc_id")]
    used = sequence.running_sum(rows, "source", -sequence.day_bucket("written_at"), order, F.col("tokens"), "used")
    return used.where("used <= 2000").select("doc_id", "tokens", "used")


@R.query("+ u AS (SELECT session_id, id, created_at, date_diff('day', lag(created_at) OVER w, created_at) AS days FROM ep WHERE session_id IS NOT NULL AND created_at IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id)) SELECT session_id, id, days FROM u WHERE days IS NOT NULL")
def elapsed_between(t: Tables) -> DataFrame:
    rows = t.episodes.where("session_id is not null and created_at is not null").select("session_id", "id", "created_at")
    rows = sequence.preceding(rows, "session_id", sequence.day_bucket("created_at"), ["created_at", "id"], 1, ["created_at"], "before")
    return rows.where(F.size("before") > 0).select("session_id", "id", F.date_diff("created_at", F.col("before")[0]["created_at"]).cast("long").alias("days"))
