"""The driver tables as record tables, in DataFrames and as SQL views (common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RFC = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def mention(spark: SparkSession, d: str, daily: bool = False) -> DataFrame:
    """events as mentions; daily: one event uuid per user and day, so that events have several entities."""
    uuid = F.concat_ws("@", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")) if daily else F.col("event_id").cast("string")
    return table(spark, d, "events").select(
        F.col("event_type").alias("entity"),
        F.when(F.col("user_id") % 2 == 0, "command").otherwise("file").alias("entity_type"),
        uuid.alias("event_uuid"),
        F.col("user_id").cast("string").alias("session_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("project"),
        F.date_format("ts", _RFC).alias("timestamp"),
        F.col("event_id").alias("id"),
    )


def _mention_sql(uuid: str) -> str:
    return f"SELECT event_type AS entity, CASE WHEN user_id % 2 = 0 THEN 'command' ELSE 'file' END AS entity_type, {uuid} AS event_uuid, CAST(user_id AS VARCHAR) AS session_id, 'p' || CAST(user_id % 5 AS VARCHAR) AS project, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, event_id AS id FROM events"


def event(spark: SparkSession, d: str) -> DataFrame:
    """conversations as events: a turn is a block of the line conv_id; every third system turn has a skeleton grain."""
    return table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").cast("string").alias("uuid"),
        F.concat(F.lit("s"), (F.col("conv_id") % 20).cast("string")).alias("session_id"),
        "role",
        F.when((F.col("role") == "system") & (F.col("conv_id") % 3 == 0), "skeleton").otherwise("indexed").alias("grain"),
        "text",
        F.concat(F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit("Z")).alias("timestamp"),
        "turn",
    )


_EVENT = "SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS uuid, 's' || CAST(conv_id % 20 AS VARCHAR) AS session_id, role, CASE WHEN role = 'system' AND conv_id % 3 = 0 THEN 'skeleton' ELSE 'indexed' END AS grain, text, '2024-01-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || 'Z' AS timestamp, turn FROM conversations"


def session(spark: SparkSession, d: str) -> DataFrame:
    return event(spark, d).select("session_id").distinct().withColumn("project", F.concat(F.lit("p"), (F.substring("session_id", 2, 9).cast("int") % 4).cast("string")))


_SESSION = "SELECT DISTINCT session_id, 'p' || CAST(CAST(substr(session_id, 2) AS INTEGER) % 4 AS VARCHAR) AS project FROM event"


def artifact(spark: SparkSession, d: str) -> DataFrame:
    """documents as artifacts of the events of conversations (uuid doc_id % 50), with code lines put before the text."""
    code = F.concat(F.lit("pub async fn f"), F.col("doc_id").cast("string"), F.lit("() {\n  run --fast x  \nplain\nclassy thing\n  def g(x):\n"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("artifact_id"), F.col("lang").alias("language"), F.col("source").alias("path"), code.alias("content"), (F.col("doc_id") % 50).cast("string").alias("source_event_uuid"), (F.col("doc_id") % 70).cast("string").alias("request_bundle"), "doc_id")


_ARTIFACT = "SELECT 'a' || CAST(doc_id AS VARCHAR) AS artifact_id, lang AS language, source AS path, 'pub async fn f' || CAST(doc_id AS VARCHAR) || '() {' || chr(10) || '  run --fast x  ' || chr(10) || 'plain' || chr(10) || 'classy thing' || chr(10) || '  def g(x):' || chr(10) || coalesce(text, '') AS content, CAST(doc_id % 50 AS VARCHAR) AS source_event_uuid, CAST(doc_id % 70 AS VARCHAR) AS request_bundle, doc_id FROM documents"


def fts(spark: SparkSession, d: str) -> DataFrame:
    """documents as index documents: sessions s0 .. s19, source ids of events."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("content"), F.concat(F.lit("s"), (F.col("doc_id") % 20).cast("string")).alias("session_id"), F.lit("event").alias("source_type"), (F.col("doc_id") % 50).cast("string").alias("source_id"))


_FTS = "SELECT doc_id AS doc, text AS content, 's' || CAST(doc_id % 20 AS VARCHAR) AS session_id, 'event' AS source_type, CAST(doc_id % 50 AS VARCHAR) AS source_id FROM documents"


def vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("embedding", F.concat(F.lit("p"), F.col("label").cast("string")).alias("project"), F.lit("event").alias("unit_kind"), F.concat((F.col("vec_id") % 50).cast("string"), F.lit(":"), F.col("vec_id").cast("string")).alias("source_id"), "vec_id")


_VECTOR = "SELECT embedding, 'p' || CAST(label AS VARCHAR) AS project, 'event' AS unit_kind, CAST(vec_id % 50 AS VARCHAR) || ':' || CAST(vec_id AS VARCHAR) AS source_id, vec_id FROM embeddings"


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """A ledger made from vec_ids: every second unit, some failed, some of an older version."""
    v = F.col("vec_id")
    return vector(spark, d).filter(v % 2 == 0).select("unit_kind", "source_id", F.when(v % 10 == 0, "v1").otherwise("v2").alias("embedder_version"), F.lit("2024-01-01T00:00:00Z").alias("embedded_at"), F.when(v % 6 == 0, "failed").otherwise("done").alias("status"), (v % 7).alias("attempts"), F.when(v % 6 == 0, F.concat(F.lit("e"), v.cast("string"))).alias("last_error"))


_LEDGER = "SELECT unit_kind, source_id, CASE WHEN vec_id % 10 = 0 THEN 'v1' ELSE 'v2' END AS embedder_version, '2024-01-01T00:00:00Z' AS embedded_at, CASE WHEN vec_id % 6 = 0 THEN 'failed' ELSE 'done' END AS status, vec_id % 7 AS attempts, CASE WHEN vec_id % 6 = 0 THEN 'e' || CAST(vec_id AS VARCHAR) END AS last_error FROM vector WHERE vec_id % 2 = 0"

_VIEWS = {"mention": _mention_sql("CAST(event_id AS VARCHAR)"), "daily": _mention_sql("CAST(user_id AS VARCHAR) || '@' || strftime(ts, '%Y-%m-%d')"), "event": _EVENT, "session": _SESSION, "artifact": _ARTIFACT, "fts": _FTS, "vector": _VECTOR, "ledger": _LEDGER}


def sql(views: str, body: str) -> str:
    """body after the named views, in order."""
    own = ",\n".join(f"{v} AS ({_VIEWS[v]})" for v in views.split())
    rest = body.strip()
    if rest.startswith("WITH "):
        return f"WITH {own},\n{rest[5:]}"
    return f"WITH {own}\n{rest}"
