import pytest
from pyspark.sql import functions as F

from palimpsest.api import Memory

NOW = "2024-02-01 00:00:00"
TEXTS = [
    ("1", "user", "The gateway in staging dropped packets again, remember this please."),
    ("2", "assistant", "We decided to move the gateway to the new cluster on Friday."),
    ("3", "user", "What about the database migration for the billing service?"),
    ("4", "assistant", "The database migration runs on Sunday after the backup is done."),
    ("5", "user", "ok"),
    ("6", "user", "Please keep the billing dashboards in the old project for now."),
    ("7", "assistant", "Noted, the billing dashboards stay in the old project until March."),
]


@pytest.fixture()
def memory(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/mem")
    rows = spark.createDataFrame([(i, "s1", r, t, f"2024-01-31 10:0{i}:00") for i, r, t in TEXTS], "id string, session_id string, role string, content string, at string")
    m.ingest(rows.withColumn("created_at", F.col("at").cast("timestamp")), NOW)
    return m


def count(m):
    return {r["tier"]: r["n"] for r in m.stats().collect()}


def test_ingest_drops_noise_and_links(memory):
    assert count(memory)["episodes"] == 6 and count(memory)["associations"] == 15
    memory.ingest(memory.table("episodes").select("id", "session_id", "role", "content", "created_at"), NOW)
    assert count(memory)["episodes"] == 6


def test_recall_commit_forget(memory):
    r = memory.recall("what did we decide about the gateway?", NOW)
    found = [x["id"] for x in r.memories.collect()]
    assert r.mode == "deep" and found[0] == "2" and "1" in found
    assert r.sessions.first()["session_id"] == "s1"
    memory.commit(r, NOW)
    assert memory.table("associations").where("edge_type = 'co_recalled'").count() >= 1
    assert memory.table("episodes").where("id = '1'").first()["access_count"] == 1
    gone = {x["id"] for x in memory.forget("database migration", NOW, confirm=True, min_relevance=0.3).collect()}
    assert gone and not gone & {x["id"] for x in memory.recall("tell me about the database migration", NOW).memories.collect()}


def test_consolidate(memory):
    memory.consolidate(NOW)
    assert count(memory)["digests"] == 1
    assert memory.table("episodes").where("consolidated_at is null").count() == 0
    assert memory.table("runs").count() == 4
    digest = memory.table("digests").first()
    assert memory.expand(digest["id"]).count() == 6
    memory.consolidate(NOW, "light")
    assert count(memory)["digests"] == 1


def test_empty_memory(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/empty")
    assert m.recall("anything about the gateway?", NOW).memories.count() == 0 and sum(count(m).values()) == 0
    assert m.timeline("x").count() == 0 and m.bridges("a", "b").count() == 0


def test_model_backed_steps(spark, memory):
    from palimpsest.api import Intelligence

    asked: list = []
    axes = {"gateway": [1.0, 0.0], "billing": [0.0, 1.0]}
    embed = lambda text: next((v for k, v in axes.items() if k in text), [0.1, 0.1])
    model = Intelligence(
        embed=embed, hypothetical=lambda q: asked.append(q) or "something about billing", expand=lambda q: ["dashboards"],
        rerank=lambda q, texts: [1.0 if "March" in t else 0.0 for t in texts], select=lambda q, lines, mode: [(0, "Friday move", None), (0, "again", None), (99, None, None)],
        propose=lambda q, found: "billing dashboards project" if len(found) < 6 else None,
    )
    m = Memory(spark, memory.folder, intelligence=model)
    got = m.recall("when did we decide about the gateway?", NOW)
    assert asked and {r["id"] for r in got.memories.collect()} >= {"2", "7"}
    top = got.memories.orderBy("relevance", ascending=False).first()
    assert top["id"] == "7"
    hops, queries = m.recall_rounds("gateway cluster", NOW, most=3)
    assert queries == ["gateway cluster", "billing dashboards project"]
    assert [r["position"] for r in hops.orderBy("position").collect()] == list(range(1, hops.count() + 1))
    notes = m.notes("how many times did we talk about the gateway?", got, NOW).collect()
    assert len(notes) == 1 and notes[0]["method"] == "count-enumerate" and "friday move" in notes[0]["text"] and "1 candidate instance from 1 selected evidence line across 1 session." in notes[0]["text"]
