import json

from pyspark.sql import functions as F

from conftest import rows
from palimpsest.sources import readers
from palimpsest.streaming import incremental


def test_question_files(spark, tmp_path):
    item = {"question_id": "q1", "question_type": "t", "question": "?", "haystack_session_ids": ["s1"], "haystack_dates": ["2023/05/20 (Sat) 02:21"], "haystack_sessions": [[{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]]}
    (tmp_path / "a.json").write_text(json.dumps([item]))
    (tmp_path / "b.json").write_text(json.dumps(item | {"question_id": "q2"}))
    q = readers.question_files(spark, str(tmp_path))
    assert rows(q.select("question_id")) == [("q1",), ("q2",)]
    assert [(r["session_id"], r["turn"], r["content"]) for r in readers.question_turns(q.where("question_id = 'q1'")).orderBy("turn").collect()] == [("s1", 0, "a"), ("s1", 1, "b")]


def test_dialogues_in_numeric_order(spark, tmp_path):
    turn = lambda i: [{"dia_id": f"D{i}:1", "speaker": "A", "text": str(i)}]
    (tmp_path / "d.json").write_text(json.dumps([{"sample_id": "x", "conversation": {"speaker_a": "A", "session_10": turn(10), "session_2": turn(2), "session_2_date_time": "noon"}}]))
    got = readers.dialogue_files(spark, str(tmp_path)).orderBy("session_no").select("session_no", "text", "date_time").collect()
    assert [tuple(r) for r in got] == [(2, "2", "noon"), (10, "10", None)]


def test_multihop_hops(spark, tmp_path):
    item = {"id": "i", "question": "?", "paragraphs": [{"idx": 0, "title": "a", "paragraph_text": "x", "is_supporting": True}, {"idx": 1, "title": "b", "paragraph_text": "y", "is_supporting": False}], "question_decomposition": [{"id": 1, "question": "", "paragraph_support_idx": 0}]}
    (tmp_path / "m.jsonl").write_text(json.dumps(item) + "\n")
    got = {r["idx"]: r["hop"] for r in readers.multihop_files(spark, str(tmp_path)).collect()}
    assert got == {0: 1, 1: None}


def test_transcripts(spark, tmp_path):
    lines = [{"role": "user", "content": "first question"}, {"role": "assistant", "content": "an answer"}, {"role": "user", "content": "last question"}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    turns = readers.transcript_turns(spark, str(tmp_path))
    assert turns.count() == 3
    assert {(r["role"], r["content"]) for r in readers.last_turns(turns).collect()} == {("user", "last question"), ("assistant", "an answer")}
    assert [r["content"] for r in readers.recent_turns(turns, budget=25).orderBy("line").collect()] == ["last question"]
    known = turns.select("file").distinct()
    assert readers.import_sessions(spark, str(tmp_path), known).count() == 0


def test_rejections(spark, tmp_path):
    log = spark.createDataFrame([("2024-01-01 00:00:00", "short", 0.99), ("2023-01-01 00:00:00", "old", 0.1)], "ts string, reason string, confidence double")
    readers.append_rejections(log, str(tmp_path / "log"))
    kept = readers.rejections(spark, str(tmp_path / "log"), "2024-01-05")
    assert {(r["facet"], r["value"]) for r in readers.rejection_stats(kept).collect()} == {("reason", "short"), ("confidence", "9")}



def test_primed_topics_batch(spark):
    turns = spark.createDataFrame([("s", n, ["a"] if n == 1 else ["b"] if n == 3 else []) for n in range(1, 9)], incremental.PRIMED)
    got = {r["turn"]: r["topics"] for r in incremental.primed_topics_batch(turns).collect()}
    assert got == {1: ["a"], 2: ["a"], 3: ["a", "b"], 4: ["a", "b"], 5: ["a", "b"], 6: ["b"], 7: ["b"], 8: []}


def test_primed_topics_stream_equals_batch(spark, tmp_path):
    turns = spark.createDataFrame([("s", n, ["a"] if n in (1, 4) else ["b"] if n == 3 else []) for n in range(1, 11)], incremental.PRIMED)
    turns.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = incremental.primed_topics_stream(incremental.file_stream(spark, str(tmp_path / "in"), incremental.PRIMED))
    query = out.writeStream.format("memory").queryName("primed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["turn"], r["topics"]) for r in spark.table("primed").collect()) == sorted((r["turn"], r["topics"]) for r in incremental.primed_topics_batch(turns).collect())


def test_index_stream_is_idempotent(spark, tmp_path):
    schema = "id string, created_at timestamp, n int"
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "id string, n int").select("id", F.lit("2024-01-01").cast("timestamp").alias("created_at"), "n")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = incremental.deduplicated(incremental.file_stream(spark, str(tmp_path / "in"), schema))
        incremental.maintain(stream, lambda b: b.select("id", "n"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("id", "n")) == [("a", 1), ("b", 2)]


def test_reconcile(spark):
    index = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    fresh = spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int")
    gone = spark.createDataFrame([("a",), ("z",)], "id string")
    assert rows(incremental.apply_changes(index, fresh, gone)) == [("b", 2), ("c", 2)]


def test_stream_windows(spark, tmp_path):
    df = spark.createDataFrame([("u", "2024-01-01 00:05:00"), ("u", "2024-01-01 00:20:00"), ("u", "2024-01-01 02:00:00")], "k string, t string").select("k", F.col("t").cast("timestamp").alias("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = incremental.file_stream(spark, str(tmp_path / "in"), "k string, at timestamp")
    for name, out in (("w", incremental.windowed(stream, "at", "k")), ("s", incremental.sessions(stream, "k", "at"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("complete" if name == "w" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("w").collect()) == [1, 2]
