from pyspark.sql import functions as F

from palimpsest.operators import rounds, synthesis

EVIDENCE = "query_id string, rank int, id string, session_id string, at string, content string"


def frames(spark, question, rows, now="2024-03-01"):
    q = spark.createDataFrame([("q", question, now)], "query_id string, query string, n string").select("query_id", "query", F.col("n").cast("timestamp").alias("now"))
    e = spark.createDataFrame([("q", *r) for r in rows], EVIDENCE).withColumn("event_at", F.col("at").cast("timestamp")).drop("at")
    s = e.where("session_id is not null").groupBy("query_id", "session_id").agg(F.min("event_at").alias("earliest"), F.count(F.lit(1)).alias("n"), F.min("rank").alias("position"))
    return q, e, s


ROWS = [(1, "a", "s1", "2024-01-02", "We moved on 2024-01-02 to Bern."), (2, "b", "s2", "2024-01-20", "Second trip to Bern."), (3, "c", "s2", None, "Undated trip.")]


def test_plain_notes_over_time(spark):
    got = synthesis.synthesize(*frames(spark, "How many days ago did we move?", ROWS)).collect()
    assert len(got) == 1 and got[0]["method"] == "temporal-grounding" and not got[0]["selected"]
    assert got[0]["text"].split("\n")[1:] == [
        "- Temporal grounding (computed from all retrieved evidence):",
        "- Session s1: 2024-01-02 (Tue) — 59 days (~8 weeks) before the question date; 1 matched memory.",
        "- Session s2: 2024-01-20 (Sat) — 41 days (~6 weeks) before the question date; 2 matched memories.",
        "- Session order (oldest → newest): (1) s1 2024-01-02 → (2) s2 2024-01-20.",
        "- Elapsed from (1) to (2): 18 days (~3 weeks).", "- Question anchor date: 2024-03-01.",
    ]


def test_selected_notes_over_time(spark):
    q, e, s = frames(spark, "How many days ago did we move?", ROWS)
    reply = lambda items: spark.createDataFrame([("q", items)], "query_id string, items array<struct<index:int,instance:string,date_text:string>>")
    got = synthesis.synthesize(q, e, s, reply([(0, None, "2024-01-02"), (1, None, "invented"), (2, None, None), (1, "again", None), (7, None, None)])).first()
    assert got["method"] == "date-arithmetic" and got["selected"] and got["evidence_count"] == 2
    assert got["text"].split("\n")[1:] == [
        '- "We moved on 2024-01-02 to Bern." — event dated 2024-01-02, 59 days (~8 weeks) before the question date (mentions "2024-01-02"); session s1.',
        '- "Second trip to Bern." — session s2, conversation dated 2024-01-20, 41 days (~6 weeks) before the question date.',
        "- Order by conversation date (events may be earlier than their conversations): (1) 2024-01-02 → (2) 2024-01-20.",
        "- Elapsed between conversations from (1) to (2): 18 days (~3 weeks).", "- Question anchor date: 2024-03-01.",
    ]
    # the model chose nothing: no notes; nothing valid: the plain ones
    assert synthesis.synthesize(q, e, s, reply([])).count() == 0
    assert synthesis.synthesize(q, e, s, reply([(9, None, None)])).first()["method"] == "temporal-grounding"


def test_counting_and_preferences(spark):
    q, e, s = frames(spark, "How many trips to Bern did we make in total?", ROWS)
    plain = synthesis.synthesize(q, e, s).first()
    assert plain["method"] == "evidence-index" and "2 distinct sessions matched, spanning 2024-01-02 → 2024-01-20." in plain["text"]
    items = spark.createDataFrame([("q", [(0, " Bern ", None), (1, "bern", None), (2, "Other", None)])], "query_id string, items array<struct<index:int,instance:string,date_text:string>>")
    got = synthesis.synthesize(q, e, s, items).first()
    assert "found in the selected evidence: 2 — (1) bern (s1, 2024-01-02); (2) other (s2)." in got["text"] and got["evidence_count"] == 3
    # an invented date in a section drops it
    bad = synthesis.synthesize(q, e.withColumn("event_at", F.lit(None).cast("timestamp")), s)
    assert bad.count() == 0
    assert synthesis.synthesize(*frames(spark, "Hello there", ROWS)).count() == 0
    assert synthesis.synthesize(q, e.limit(0), s).count() == 0


def test_rounds_end(spark):
    hits = {"one": [("a", "x", 1), ("b", "y", 2)], "two": [("c", "z", 1), ("a", "x", 2)]}
    recall = lambda text: spark.createDataFrame(hits[text], "id string, content string, rank int")
    got, asked = rounds.iterate("one", recall, lambda q, found: "two", 3, 10)
    assert asked == ["one", "two"] and [r["id"] for r in got.orderBy("position").collect()] == ["a", "c", "b"]
    assert rounds.second_pass_due(None, False, False) and not rounds.second_pass_due(0.5, False, False) and rounds.second_pass_due(0.9, True, False)
