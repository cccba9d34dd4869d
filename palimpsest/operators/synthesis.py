"""Notes derived from retrieved evidence: five renderers, the date guard, and what joins them.

Evidence of one question is bounded by the retrieval's limit, so its lines are put together as an
array; questions stay apart, so any number of them runs in one plan.

Unusual cases: undated evidence takes no part in date arithmetic; a question without evidence,
without a need for notes, or whose section names a date that no evidence carries has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators.sequence import day_bucket, numbered


def evidence_scope(evidence: DataFrame, sessions: DataFrame, most: int = 5) -> DataFrame:
    """Evidence rows of the best ``most`` sessions of their query, and rows without a session."""
    best = sessions.where(F.col("position") <= most).select("query_id", "session_id")
    inside = evidence.join(best, ["query_id", "session_id"], "left_semi")
    return inside.unionByName(evidence.where("session_id is null"))


def chronology(evidence: DataFrame) -> DataFrame:
    """``evidence(query_id, id, event_at, content)`` oldest first with the days since the one
    before, as text."""
    order = Window.partitionBy("query_id").orderBy("event_at", "id")
    days = F.date_diff("event_at", F.lag("event_at").over(order))
    dated = evidence.where("event_at is not null")
    return dated.select("query_id", "id", F.row_number().over(order).alias("place"), F.date_format("event_at", "yyyy-MM-dd").alias("day"), T.humanize_days(days).alias("elapsed"), T.quote(F.col("content")).alias("quote"))


def distinct_instances(items: DataFrame, label: str, at: str) -> DataFrame:
    """One row a normalised label with its count and earliest date; undated ones last."""
    g = items.groupBy(F.lower(F.trim(label)).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("earliest"))
    order = [F.col("earliest").asc_nulls_last(), F.col("label")]
    return numbered(g.withColumn("_all", F.lit(0)), "_all", day_bucket("earliest"), order, "place").drop("_all")


def blocks(evidence: DataFrame) -> DataFrame:
    """One text block a query; a block that names a date no evidence carries is dropped."""
    lines = chronology(evidence)
    line = F.concat(F.lit("- "), F.col("day"), F.lit(": "), F.col("quote"), F.coalesce(F.concat(F.lit(" ("), F.col("elapsed"), F.lit(" later)")), F.lit("")))
    g = lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"), F.collect_set("day").alias("days"))
    return g.where(T.dates_anchored(F.col("block"), F.col("days"))).select("query_id", "block")


#: fixed values: the wording of the notes
HEADER = "### Derived from memory (computed deterministically — verify against the memories above; may be incomplete or irrelevant to the question)"
APPLY = "Apply this stated preference when answering — do not merely mention it."
MOST_CONSTRAINTS = 3
#: evidence shown to a selecting model: lines, and characters of each
MOST_LINES, LINE_CHARS = 30, 400


def _plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def _session(c: Column) -> Column:
    return F.coalesce(c, F.lit("unknown session"))


def _day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _from_now(at: Column, now: Column, separator: str) -> Column:
    """How far a date lies from the question's, nothing on the same day or without one."""
    days = F.date_diff(now, at)
    side = F.when(days > 0, " before the question date").otherwise(" after the question date")
    return F.coalesce(F.when(days != 0, F.concat(F.lit(separator), T.humanize_days(F.abs(days)), side)), F.lit(""))


def _in_order(df: DataFrame, first: list[str], fields: list[Column], *more: Column) -> DataFrame:
    """A row a question with ``items``, its rows in the order of ``first``, and the day of the question."""
    rows = F.array_sort(F.collect_list(F.struct(*first, *fields)))
    return df.groupBy("query_id").agg(rows.alias("items"), F.max("now").alias("now"), *more)


def _steps(label: Column) -> Column:
    """One line for each pair of neighbours in ``items`` with the time between them."""
    pairs = F.sequence(F.lit(1), F.size("items") - 1)
    line = lambda i: F.concat(F.lit("- "), label, F.lit(" from ("), i.cast("string"), F.lit(") to ("), (i + 1).cast("string"), F.lit("): "), T.humanize_days(F.date_diff(F.get("items", i)["at"], F.get("items", i - 1)["at"])), F.lit("."))
    return F.when(F.size("items") > 1, F.transform(pairs, line)).otherwise(F.array().cast("array<string>"))


def _section(df: DataFrame, lines: Column, method: str, selected: bool) -> DataFrame:
    anchor = F.when(F.col("now").isNotNull(), F.array(F.concat(F.lit("- Question anchor date: "), _day(F.col("now")), F.lit(".")))).otherwise(F.array().cast("array<string>")) if method in ("date-arithmetic", "temporal-grounding") else F.array().cast("array<string>")
    text = F.array_join(F.concat(lines, anchor), "\n")
    return df.select("query_id", F.lit(method).alias("method"), text.alias("text"), F.size("items").alias("evidence_count"), F.lit(selected).alias("selected"))


def temporal_notes(selected: DataFrame) -> DataFrame:
    """``selected(query_id, id, session_id, event_at, content, date_text, now)``: dated lines, their
    order and the time between them.  A date counts as the event's own only where the text's
    quoted date says the same day; else it is the conversation's."""
    own = F.coalesce(F.to_date(T.event_date(F.col("date_text"))) == F.to_date("event_at"), F.lit(False))
    mention = F.coalesce(F.concat(F.lit(' (mentions "'), F.col("date_text"), F.lit('")')), F.lit(""))
    quoted, away = F.concat(F.lit('- "'), T.quote(F.col("content")), F.lit('" — ')), _from_now(F.col("event_at"), F.col("now"), ", ")
    line = F.when(own, F.concat(quoted, F.lit("event dated "), _day(F.col("event_at")), away, mention, F.lit("; session "), _session(F.col("session_id")), F.lit(".")))
    line = line.otherwise(F.concat(quoted, F.lit("session "), _session(F.col("session_id")), F.lit(", conversation dated "), _day(F.col("event_at")), away, mention, F.lit(".")))
    dated = selected.where("event_at is not null").withColumns({"line": line, "own": own, "at": F.to_date("event_at")})
    g = _in_order(dated, ["at", "id"], [F.col("line")], F.min("own").alias("own"))
    order = F.array_join(F.transform("items", lambda x, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), _day(x["at"]))), " → ")
    head = F.when(F.col("own"), "- Chronological order: ").otherwise("- Order by conversation date (events may be earlier than their conversations): ")
    sequence = F.when(F.size("items") > 1, F.array(F.concat(head, order, F.lit(".")))).otherwise(F.array().cast("array<string>"))
    steps = _steps(F.when(F.col("own"), "Elapsed").otherwise("Elapsed between conversations"))
    return _section(g, F.concat(F.transform("items", lambda x: x["line"]), sequence, steps), "date-arithmetic", True)


def aggregation_notes(selected: DataFrame) -> DataFrame:
    """``selected(query_id, id, session_id, event_at, instance, now)``: the distinct instances, dated ones
    first, and what the count rests on."""
    named = selected.withColumn("label", F.lower(F.trim("instance")))
    first = F.min_by("session_id", F.struct(F.coalesce("event_at", F.lit("9999-12-31").cast("timestamp")), "id"))
    groups = named.groupBy("query_id", "label").agg(F.min("event_at").alias("earliest"), first.alias("session_id"), F.count(F.lit(1)).alias("n"), F.max("now").alias("now"))
    sessions = named.groupBy("query_id").agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("lines"))
    groups = groups.withColumns({"undated": F.col("earliest").isNull(), "at": F.to_date("earliest")})
    g = _in_order(groups, ["undated", "earliest", "label"], [F.col("session_id"), F.col("n"), F.col("at")]).join(sessions, "query_id")
    one = lambda x, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), x["label"], F.lit(" ("), _session(x["session_id"]), F.coalesce(F.concat(F.lit(", "), _day(x["earliest"])), F.lit("")), F.lit(")"))
    n, m, k = F.size("items"), F.col("lines"), F.col("sessions")
    found = F.concat(F.lit("- [aggregation] Candidate instances found in the selected evidence: "), n.cast("string"), F.lit(" — "), F.array_join(F.transform("items", one), "; "), F.lit("."))
    basis = F.concat(
        F.lit("- Count basis: "), n.cast("string"), F.lit(" candidate instance"), _plural(n, "", "s"), F.lit(" from "), m.cast("string"), F.lit(" selected evidence line"), _plural(m, "", "s"), F.lit(" across "), k.cast("string"),
        F.lit(" session"), _plural(k, "", "s"), F.lit(". Candidates may be missing or duplicated — verify the final count against the memories above."),
    )
    return _section(g, F.array(found, basis), "count-enumerate", True).drop("evidence_count").join(sessions.select("query_id", F.col("lines").cast("int").alias("evidence_count")), "query_id")


def constraint_notes(hits: DataFrame, most: int = MOST_CONSTRAINTS) -> DataFrame:
    """``hits(query_id, rank, session_id, event_at, content, now)``: the first ``most`` stated preferences."""
    line = F.concat(F.lit("- [constraint] Stated user preference ("), _session(F.col("session_id")), F.coalesce(F.concat(F.lit(", "), _day(F.col("event_at"))), F.lit("")), F.lit('): "'), T.quote(F.col("content")), F.lit(f'" {APPLY}'))
    g = _in_order(hits.withColumn("line", line), ["rank"], [F.col("line")]).withColumn("items", F.slice("items", 1, most))
    return _section(g, F.transform("items", lambda x: x["line"]), "constraint-surface", False)


def grounding_notes(sessions: DataFrame) -> DataFrame:
    """``sessions(query_id, session_id, position, earliest, n, now)``: the dated sessions in time."""
    dated = sessions.where("earliest is not null").withColumn("at", F.to_date("earliest"))
    away = _from_now(F.col("earliest"), F.col("now"), " — ")
    line = F.concat(F.lit("- Session "), F.col("session_id"), F.lit(": "), _day(F.col("earliest")), F.lit(" ("), F.date_format("earliest", "EEE"), F.lit(")"), away, F.lit("; "), F.col("n").cast("string"), F.lit(" matched memor"), _plural(F.col("n"), "y", "ies"), F.lit("."))
    g = _in_order(dated.withColumn("line", line), ["at", "session_id"], [F.col("line")])
    order = F.array_join(F.transform("items", lambda x, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), x["session_id"], F.lit(" "), _day(x["at"]))), " → ")
    sequence = F.when(F.size("items") > 1, F.array(F.concat(F.lit("- Session order (oldest → newest): "), order, F.lit(".")))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.lit("- Temporal grounding (computed from all retrieved evidence):"))
    return _section(g, F.concat(head, F.transform("items", lambda x: x["line"]), sequence, _steps(F.lit("Elapsed"))), "temporal-grounding", False)


def index_notes(sessions: DataFrame) -> DataFrame:
    """``sessions`` as above: how many there are, their span, and one line each, in time where all are
    dated, else by rank."""
    g = _in_order(sessions, ["position"], [F.col("session_id"), F.col("earliest"), F.col("n")], F.min("earliest").alias("low"), F.max("earliest").alias("high"), F.count("earliest").alias("dated"))
    timed = F.transform(F.array_sort(F.transform("items", lambda x: F.struct(x["earliest"].alias("at"), x["session_id"].alias("s"), x.alias("x")))), lambda y: y["x"])
    g = g.withColumn("items", F.when(F.col("dated") == F.size("items"), timed).otherwise(F.col("items")))
    span = F.coalesce(F.concat(F.lit(", spanning "), _day(F.col("low")), F.lit(" → "), _day(F.col("high"))), F.lit(""))
    head = F.concat(F.lit("- Evidence index: "), F.size("items").cast("string"), F.lit(" distinct sessions matched"), span, F.lit("."))
    line = lambda x, i: F.concat(F.lit("- ("), (i + 1).cast("string"), F.lit(") "), x["session_id"], F.coalesce(F.concat(F.lit(" ("), _day(x["earliest"]), F.lit(")")), F.lit("")), F.lit(" — "), x["n"].cast("string"), F.lit(" matched memor"), _plural(x["n"], "y", "ies"), F.lit("."))
    return _section(g, F.concat(F.array(head), F.transform("items", line)), "evidence-index", False)


def checked_selection(evidence: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A model's choice of evidence, checked: (selected rows, outcome of each question).

    ``evidence(query_id, rank, .., content)`` with ranks from 1; ``replies(query_id, items
    array<struct<index, instance, date_text>>)``, indexes from 0.  An index out of range or said
    twice does not count, a date phrase that does not stand in the text is dropped, a missing
    instance gets a name.  Outcomes: ``selected``; ``empty`` (the model chose nothing); ``error`` (no
    reply, or nothing valid in it), where the plain notes take over.
    """
    shown = evidence.where(F.col("rank") <= MOST_LINES).withColumn("index", (F.col("rank") - 1).cast("int"))
    said = replies.select("query_id", F.posexplode("items").alias("place", "item")).select("query_id", "place", "item.*")
    said = said.groupBy("query_id", "index").agg(F.min_by(F.struct("instance", "date_text"), "place").alias("s"))
    met = shown.join(said, ["query_id", "index"])
    name = F.nullif(F.lower(F.trim("s.instance")), F.lit(""))
    phrase = F.nullif(F.trim("s.date_text"), F.lit(""))
    selected = met.withColumns({"instance": F.coalesce(name, F.concat(F.lit("instance-"), F.col("index").cast("string"))), "date_text": F.when(F.contains(F.col("content"), phrase), phrase)}).drop("s", "index")
    valid = selected.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    asked = evidence.select("query_id").distinct().join(replies.select("query_id", F.size("items").alias("said")), "query_id", "left").join(valid, "query_id", "left")
    outcome = F.when(F.col("n") > 0, "selected").when(F.col("said") == 0, "empty").otherwise("error")
    return selected, asked.select("query_id", outcome.alias("outcome"))


def synthesize(questions: DataFrame, evidence: DataFrame, sessions: DataFrame, replies: DataFrame | None = None, most_sessions: int | None = None) -> DataFrame:
    """(query_id, intent, method, text, evidence_count, selected): the notes of each question that calls
    for any.

    ``questions(query_id, query, now)``; ``evidence(query_id, rank, id, session_id, event_at,
    content)``; ``sessions(query_id, session_id, position, earliest, n)``; ``replies`` as in
    ``checked_selection``.
    """
    from palimpsest.functions import lexicon as L

    asked = questions.select("query_id", "now", L.synthesis_intent(F.col("query")).alias("compute"), L.preference_request(F.col("query")).alias("advice"))
    asked = asked.where("compute <> 'none' or advice")
    if most_sessions is not None:
        evidence = evidence_scope(evidence, sessions, most_sessions).where("session_id is not null")
        sessions = sessions.where(F.col("position") <= most_sessions)
    mine = evidence.join(asked, "query_id")
    groups = sessions.join(asked, "query_id").join(mine.select("query_id").distinct(), "query_id", "left_semi")
    plain = groups
    parts = []
    if replies is not None:
        chosen, outcomes = checked_selection(mine, replies)
        chosen = chosen.join(outcomes.where("outcome = 'selected'"), "query_id", "left_semi")
        parts += [temporal_notes(chosen.where("compute = 'temporal'")), aggregation_notes(chosen.where("compute = 'aggregation'"))]
        plain = groups.join(outcomes.where("outcome = 'error'"), "query_id", "left_semi")
    parts += [grounding_notes(plain.where("compute = 'temporal'")), index_notes(plain.where("compute = 'aggregation'"))]
    columns = ["query_id", "method", "text", "evidence_count", "selected"]
    computed = parts[0].select(*columns)
    for p in parts[1:]:
        computed = computed.unionByName(p.select(*columns))
    # a section with an invented date is worse than none
    days = mine.groupBy("query_id").agg(F.collect_set(_day(F.col("event_at"))).alias("days"), F.max("now").alias("now"))
    allowed = F.concat("days", F.array_compact(F.array(_day(F.col("now")))))
    computed = computed.join(days, "query_id").where(T.dates_anchored(F.col("text"), allowed)).select(*columns, F.lit(0).alias("place"))
    stated = mine.where("advice").where(L.preference_content(F.col("content")))
    limits = constraint_notes(stated).select(*columns, F.lit(1).alias("place"))
    both = computed.unionByName(limits).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "method", "text", "evidence_count", "selected"))).alias("parts"))
    whole = F.array_join(F.concat(F.array(F.lit(HEADER)), F.transform("parts", lambda x: x["text"])), "\n")
    first = F.get("parts", F.lit(0))["method"]
    out = both.join(asked, "query_id")
    intent = F.when((first == "constraint-surface") | (F.col("compute") == "none"), "preference").otherwise(F.col("compute"))
    count = F.aggregate("parts", F.lit(0), lambda n, x: n + x["evidence_count"])
    return out.select("query_id", intent.alias("intent"), first.alias("method"), whole.alias("text"), count.alias("evidence_count"), F.exists("parts", lambda x: x["selected"]).alias("selected"))
