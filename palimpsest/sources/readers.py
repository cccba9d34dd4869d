"""File sources: benchmark files, session transcripts, rejection logs.

Malformed lines are kept out by permissive reading; an absent optional field is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUESTION = "question_id string, question_type string, question string, question_date string, answer string, answer_session_ids array<string>, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"
HOPS = "id string, question string, answer string, answer_aliases array<string>, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>, question_decomposition array<struct<id:long,question:string,paragraph_support_idx:int>>"
TURN = "type string, role string, content string, session_id string, timestamp string"
REJECTION = "ts string, reason string, category string, role string, project string, confidence double, content string"


def question_files(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder of questions, each file an array or a single object."""
    return spark.read.schema(QUESTION).option("multiLine", True).json(path).where("question_id is not null")


def question_turns(questions: DataFrame) -> DataFrame:
    """(question_id, session_id, session_no, turn, role, content, date): the haystack's turns."""
    sessions = questions.select("question_id", "haystack_session_ids", "haystack_dates", F.posexplode("haystack_sessions").alias("session_no", "turns"))
    turns = sessions.select("question_id", F.get("haystack_session_ids", F.col("session_no")).alias("session_id"), F.get("haystack_dates", F.col("session_no")).alias("date"), "session_no", F.posexplode("turns").alias("turn", "t"))
    return turns.select("question_id", "session_id", "session_no", "turn", "t.role", "t.content", "date")


def dialogue_files(spark: SparkSession, path: str) -> DataFrame:
    """Dialogues whose sessions are keys named session_<n>: (sample_id, session_no, turn, dia_id,
    speaker, text, date_time), sessions in numeric order."""
    raw = spark.read.text(path, wholetext=True)
    each = raw.select(F.explode(F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))).alias("v"))
    fields = each.select(F.get_json_object("v", "$.sample_id").alias("sample_id"), F.from_json(F.get_json_object("v", "$.conversation"), "map<string,string>").alias("c"))
    entries = fields.select("sample_id", "c", F.explode(F.map_entries("c")).alias("e")).where(F.col("e.key").rlike(r"^session_\d+$"))
    rows = entries.select("sample_id", F.regexp_extract("e.key", r"(\d+)$", 1).cast("int").alias("session_no"), F.try_element_at("c", F.concat("e.key", F.lit("_date_time"))).alias("date_time"), F.posexplode(F.from_json("e.value", "array<struct<dia_id:string,speaker:string,text:string>>")).alias("turn", "t"))
    return rows.select("sample_id", "session_no", "turn", "t.dia_id", "t.speaker", "t.text", "date_time")


def multihop_files(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, idx, title, text, is_supporting, hop) from JSON lines; hop is the first step of
    the question's decomposition that a paragraph supports."""
    items = spark.read.schema(HOPS).json(path)
    steps = items.select("id", F.posexplode("question_decomposition").alias("step", "s")).groupBy("id", F.col("s.paragraph_support_idx").alias("idx")).agg((F.min("step") + 1).alias("hop"))
    parts = items.select("id", F.explode("paragraphs").alias("p")).select("id", "p.*")
    return parts.join(steps, ["id", "idx"], "left").select(F.col("id").alias("item_id"), "idx", "title", F.col("paragraph_text").alias("text"), "is_supporting", "hop")


def transcript_turns(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines transcript as (file, line, role, content, timestamp)."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("line"))
    rows = text.withColumn("t", F.from_json("value", TURN)).where("t.role is not null and t.content is not null")
    return rows.select("file", "line", "t.role", "t.content", "t.session_id", F.try_to_timestamp("t.timestamp").alias("timestamp"))


def last_turns(turns: DataFrame) -> DataFrame:
    """The last turn of each role of each file."""
    return turns.groupBy("file", "role").agg(F.max_by("content", "line").alias("content"), F.max("line").alias("line"))


def import_sessions(spark: SparkSession, path: str, imported: DataFrame) -> DataFrame:
    """Turns of session files not imported before (``imported(file)``)."""
    return transcript_turns(spark, path).join(imported.select("file"), "file", "left_anti")


def recent_turns(turns: DataFrame, budget: int = 40_000, turn_cap: int = 3_000, least: int = 10) -> DataFrame:
    """Newest turns first until the character budget is used, each cut to ``turn_cap``."""
    t = turns.where(F.length("content") >= least).withColumn("content", F.substring("content", 1, turn_cap))
    used = F.sum(F.length("content")).over(Window.partitionBy("file").orderBy(F.col("line").desc()))
    return t.withColumn("_used", used).where(F.col("_used") <= budget).drop("_used")


def rejections(spark: SparkSession, path: str, now: str, days: int = 30) -> DataFrame:
    log = spark.read.schema(REJECTION).json(path).withColumn("at", F.try_to_timestamp("ts"))
    return log.where(F.col("at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def append_rejections(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def rejection_stats(log: DataFrame) -> DataFrame:
    """(facet, value, n, percent): counts by reason, category, role, project and confidence decile."""
    facets = [("reason", F.col("reason")), ("category", F.col("category")), ("role", F.col("role")), ("project", F.col("project")), ("confidence", F.least(F.lit(9), F.floor(F.col("confidence") * 10)).cast("string"))]
    each = log.select(F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), c.alias("value")) for n, c in facets])).alias("f")).select("f.*").where("value is not null")
    n = each.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("facet")), 1))
