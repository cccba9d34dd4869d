"""Queries over text signals, dates and metadata (inventory 116-157, 177-182)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.catalog import Tables
from palimpsest.functions import lexicon as L
from palimpsest.functions import text as T
from palimpsest.operators import text_search
from palimpsest.plans.registry import Registry

R = Registry()


def _hit(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '(?i){pattern.replace(chr(39), chr(39) * 2)}')"


def _any(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(_hit(text, p) for p in patterns) + ")"


def _count(text: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"CAST({_hit(text, p)} AS INT)" for p in patterns) + ")"


def _best(text: str, names: tuple[str, ...], table: dict[str, list[str]]) -> tuple[str, str]:
    """SQL of the greatest count and of the first name that has it."""
    counts = {n: _count(text, table[n]) for n in names}
    most = f"greatest({', '.join(counts.values())})"
    return most, "CASE " + " ".join(f"WHEN {c} = {most} THEN '{n}'" for n, c in counts.items()) + " END"


_T = "trim(content)"
_SIGNALS = [(w, _any("content", p)) for w, p in L.SALIENCE_WEIGHTS] + [(0.60, f"ends_with({_T}, '?')"), (0.50, "contains(content, '```')"), (0.40, "length(content) > 200")]
_LIST = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {w} END" for w, c in _SIGNALS) + "], lambda x: x IS NOT NULL)"


@R.query(
    f"""SELECT id, round(CASE WHEN {_any(_T, L.ACKNOWLEDGED)} THEN 0.1 WHEN len({_LIST}) = 0 THEN 0.3
    ELSE least(0.99, list_max({_LIST}) + 0.05 * (len({_LIST}) - 1)) END, 2) AS score FROM ep WHERE content IS NOT NULL"""
)
def salience_scores(t: Tables) -> DataFrame:
    return t.episodes.where("content is not null").select("id", F.round(L.salience(F.col("content")), 2).alias("score"))


_MOST, _NAME = _best(_T, L.SCORED_INTENTS, L.INTENTS)


@R.query(
    f"""SELECT id, CASE WHEN length({_T}) < 20 AND {_any(_T, L.INTENTS['SOCIAL'])} THEN 'SOCIAL' WHEN {_any(_T, L.INTENTS['EMOTIONAL'])} THEN 'EMOTIONAL'
    WHEN {_any(_T, L.INTENTS['RECALL_EXPLICIT'])} THEN 'RECALL_EXPLICIT' WHEN {_MOST} > 0 THEN {_NAME} WHEN length({_T}) > 15 THEN 'INFORMATIONAL' ELSE 'SOCIAL' END AS intent FROM ep WHERE content IS NOT NULL"""
)
def intents(t: Tables) -> DataFrame:
    return t.episodes.where("content is not null").select("id", L.intent(F.col("content")).alias("intent"))


_MOST2, _NAME2 = _best(_T, ("RECALL_EXPLICIT", *L.SCORED_INTENTS), L.INTENTS)


@R.query(
    f"""SELECT id, CASE WHEN length({_T}) < 20 AND {_any(_T, L.INTENTS['SOCIAL'])} THEN 'SOCIAL' WHEN {_any(_T, L.INTENTS['EMOTIONAL'])} THEN 'EMOTIONAL'
    WHEN {_MOST2} > 0 THEN {_NAME2} WHEN length({_T}) > 15 THEN 'INFORMATIONAL' ELSE 'SOCIAL' END AS intent FROM ep WHERE content IS NOT NULL"""
)
def content_intents(t: Tables) -> DataFrame:
    return t.episodes.where("content is not null").select("id", L.content_intent(F.col("content")).alias("intent"))


_EMOST, _ENAME = _best("content", tuple(L.EMOTIONS), L.EMOTIONS)


@R.query(f"SELECT id, CASE WHEN {_EMOST} >= 2 THEN {_ENAME} ELSE 'neutral' END AS label, round(CASE WHEN {_EMOST} >= 3 THEN least(0.95, 0.7 + 0.1 * ({_EMOST} - 3)) WHEN {_EMOST} = 2 THEN 0.5 ELSE 0.1 END, 3) AS intensity FROM ep WHERE content IS NOT NULL")
def emotion_class(t: Tables) -> DataFrame:
    e = L.emotion(F.col("content"))
    return t.episodes.where("content is not null").select("id", e.alias("e")).select("id", "e.label", F.round("e.intensity", 3).alias("intensity"))


@R.query(f"SELECT id, list_filter([{', '.join(f'CASE WHEN {_hit('content', chr(92) + 'b(' + p + ')' + chr(92) + 'b')} THEN {chr(39)}{n}{chr(39)} END' for n, p in L.EMOTION_WORDS.items())}], lambda x: x IS NOT NULL) AS labels FROM ep WHERE content IS NOT NULL")
def emotion_keywords(t: Tables) -> DataFrame:
    return t.episodes.where("content is not null").select("id", L.emotion_keywords(F.col("content")).alias("labels"))


@R.query(f"SELECT id, CASE WHEN length({_T}) < 10 OR {_hit(_T, L.SKIP_MODE)} THEN 'skip' WHEN contains({_T}, '?') OR {_hit(_T, L.DEEP_MODE)} THEN 'deep' ELSE 'light' END AS mode FROM ep WHERE content IS NOT NULL")
def recall_mode(t: Tables) -> DataFrame:
    return t.episodes.where("content is not null").select("id", L.recall_mode(F.col("content")).alias("mode"))


_SPANS = f"len(list_filter(regexp_extract_all(question, '{L.CAPITALIZED}'), lambda x: split_part(x, ' ', 1) NOT IN ({', '.join(repr(w) for w in L.CAPITAL_STOP)})))"


@R.query(f"SELECT item_id, {_any('question', L.COUNTING)} OR regexp_matches(question, '{L.NAMES_AND}') OR ({_SPANS} >= 2 AND {_any('question', L.RELATIONAL)}) AS multi_hop, {_any('question', L.TEMPORAL)} AS temporal, {_SPANS} AS entity_count FROM eval_items", base=False)
def query_signals(t: Tables) -> DataFrame:
    s = L.query_signals(F.col("question"))
    return t.eval_items.select("item_id", *[c.alias(n) for n, c in s.items()])


@R.query(f"SELECT item_id, CASE WHEN {_any('question', L.SYNTH_TEMPORAL)} THEN 'temporal' WHEN {_any('question', L.SYNTH_AGGREGATION)} THEN 'aggregation' ELSE 'none' END AS intent, NOT {_hit('question', L.PAST_ASSISTANT)} AND {_any('question', L.PREFERENCE_REQUEST)} AS wants_advice FROM eval_items", base=False)
def synthesis_intents(t: Tables) -> DataFrame:
    return t.eval_items.select("item_id", L.synthesis_intent(F.col("question")).alias("intent"), L.preference_request(F.col("question")).alias("wants_advice"))


@R.query()
def preference_hits(t: Tables) -> DataFrame:
    return t.memories.where(L.preference_content(F.col("content"))).select("memory_type", "id", "content")


@R.query(f"SELECT doc_id, {_count('text', L.TECHNOLOGIES)} AS families FROM documents WHERE text IS NOT NULL", base=False)
def technology_mentions(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", L.count_hits(F.col("text"), L.TECHNOLOGIES).alias("families"))


@R.query()
def entity_extraction(t: Tables) -> DataFrame:
    return t.episodes.where("content is not null").select("id", L.entities(F.col("content")).alias("entities"))


@R.query("SELECT item_id, term FROM (SELECT item_id, unnest(list_distinct(regexp_split_to_array(lower(regexp_replace(question, '[?.!,;:()\\[\\]{}\"'']', ' ', 'g')), '\\s+'))) AS term FROM eval_items) WHERE length(term) >= 2 AND term NOT IN (" + ", ".join(repr(w) for w in T.QUERY_STOP) + ")", base=False)
def query_terms(t: Tables) -> DataFrame:
    return t.eval_items.select("item_id", F.explode(T.query_terms(F.col("question"))).alias("term"))


_LEMMAS = f"""list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z][a-z''-]+'), lambda w: length(w) >= 3 AND w NOT IN ({', '.join(repr(w) for w in T.LEMMA_STOP)})),
 lambda w: CASE WHEN ends_with(w, 'ies') AND length(w) > 4 THEN w[:-4] || 'y' WHEN ends_with(w, 'ing') AND length(w) > 4 THEN w[:-4] WHEN ends_with(w, 'ed') AND length(w) > 3 THEN w[:-3] WHEN ends_with(w, 's') AND length(w) > 3 THEN w[:-2] ELSE w END))"""


@R.query(f"SELECT doc_id, len({_LEMMAS}) AS n_lemmas FROM documents WHERE text IS NOT NULL", base=False)
def lemma_counts(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.size(T.lemmas(F.col("text"))).alias("n_lemmas"))


@R.query("SELECT term, doc_id AS id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2", base=False)
def text_index(t: Tables) -> DataFrame:
    return text_search.postings(t.documents.where("text is not null"), "doc_id", "text").select("term", "id", "tf")


_BM25 = """docs AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT id, w, len(w) AS length FROM docs WHERE len(w) > 0), stats AS (SELECT count(*) AS n_docs, avg(length) AS avg_length FROM d),
q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+'))) AS term FROM eval_items WHERE item_id % 50 = 0),
tf AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, length, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT query_id, id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) AS score FROM tf JOIN q USING (term) JOIN df USING (term), stats GROUP BY 1, 2),
bm AS (SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM raw)"""


def bm25_scores(t: Tables) -> DataFrame:
    queries = t.eval_items.where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))
    return text_search.normalised(text_search.bm25(t.documents.where("text is not null"), queries, "doc_id", "text"))


@R.query(f"WITH {_BM25} SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 10", base=False)
def bm25_topk(t: Tables) -> DataFrame:
    return text_search.top(bm25_scores(t), 10)


@R.query(
    """SELECT id, try_strptime(regexp_extract(trim(metadata['occurredAt']), '^(\\d{4}[-/]\\d{1,2}[-/]\\d{1,2})', 1).replace('/', '-'), '%Y-%m-%d')::DATE::VARCHAR AS event_day FROM ep
    WHERE regexp_matches(trim(metadata['occurredAt']), '^\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}')"""
)
def event_dates(t: Tables) -> DataFrame:
    raw = F.try_element_at("metadata", F.lit("occurredAt"))
    return t.episodes.where(F.trim(raw).rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}")).select("id", F.date_format(T.event_date(raw), "yyyy-MM-dd").alias("event_day"))


@R.query(
    """SELECT event_id, d, CASE WHEN d < 14 THEN d || ' day' || CASE WHEN d = 1 THEN '' ELSE 's' END
    WHEN d < 61 THEN d || ' days (' || CASE WHEN d % 7 = 0 THEN '' ELSE '~' END || CAST(floor(d / 7.0 + 0.5) AS INT) || ' week' || CASE WHEN floor(d / 7.0 + 0.5) = 1 THEN '' ELSE 's' END || ')'
    WHEN d < 366 THEN d || ' days (~' || CAST(floor(d / 30.44 + 0.5) AS INT) || ' month' || CASE WHEN floor(d / 30.44 + 0.5) = 1 THEN '' ELSE 's' END || ')'
    ELSE d || ' days (~1 year)' END AS words FROM (SELECT event_id, event_id % 370 AS d FROM events)""", base=False
)
def humanize_days(t: Tables) -> DataFrame:
    d = F.col("event_id") % 370
    return t.events.select("event_id", d.alias("d"), T.humanize_days(d).alias("words"))


@R.query(
    """SELECT event_id, isoyear(ts) || '-W' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS year_week, lower(dayname(ts)) AS day_of_week,
    CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(ts) BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS time_of_day FROM events""", base=False
)
def time_context(t: Tables) -> DataFrame:
    return t.events.select("event_id", *[c.alias(n) for n, c in T.time_context(F.col("ts")).items()])


@R.query("SELECT id, round(epoch_us(created_at) / 86400000000.0 + 2440587.5, 5) AS julian FROM ep WHERE created_at IS NOT NULL")
def julian_days(t: Tables) -> DataFrame:
    return t.episodes.where("created_at is not null").select("id", F.round(T.julian(F.col("created_at")), 5).alias("julian"))


@R.query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL", base=False)
def token_estimates(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@R.query("SELECT doc_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM documents WHERE title IS NOT NULL", base=False)
def slugs(t: Tables) -> DataFrame:
    return t.documents.where("title is not null").select("doc_id", T.slug(F.col("title")).alias("slug"))


@R.query("SELECT doc_id, CASE WHEN length(f) > 80 THEN substr(f, 1, 79) || '…' ELSE f END AS quote FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents WHERE text IS NOT NULL)", base=False)
def quotes(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", T.quote(F.col("text")).alias("quote"))


@R.query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", base=False)
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@R.query("SELECT id, len(map_keys(metadata)) + CASE WHEN list_contains(map_keys(metadata), 'channel') THEN 0 ELSE 1 END AS n_keys FROM ep WHERE metadata IS NOT NULL")
def metadata_merge(t: Tables) -> DataFrame:
    later = F.create_map(F.lit("channel"), F.lit("merged"))
    return t.episodes.where("metadata is not null").select("id", F.size(T.merge_metadata(F.col("metadata"), later)).cast("long").alias("n_keys"))
