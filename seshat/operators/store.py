"""The store: record tables by session version, their index documents, incremental ingest, and resolving hits.

Parquet has no transaction over several tables. So each ingest writes its sessions' rows under a version, and the ledger
row that names the version last; readers keep rows whose version the ledger has for their session, so a pass that breaks
off leaves nothing visible, and replaced rows vanish at once. `vacuum` removes what no ledger row names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import RECORDS
from ..sources import archive
from ..sources.transcripts import Config, exists
from . import ledgers
from .normalize import normalize
from .profiles import spoken

LEDGER = "session_dir string, session_id string, project string, fingerprint string, ingested_at long, version string"
EXTRA = {"event": "id long", "session": "session_dir string"}


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _schema(spark: SparkSession, name: str):
    return spark.createDataFrame([], RECORDS[name]).selectExpr("*", *(f"cast(null as {x.split()[1]}) {x.split()[0]}" for x in EXTRA.get(name, "").split(", ") if x), "cast(null as string) _dir", "cast(null as string) _version").schema


def ledger(spark: SparkSession, cfg: Config) -> DataFrame:
    return ledgers.latest(_read(spark, f"{cfg.store}/ledger", LEDGER), ["project", "session_dir"], "version")


def tables(spark: SparkSession, cfg: Config) -> dict[str, DataFrame]:
    """Visible rows of session, event, artifact, mention, and fts derived from them. Of artifacts with one id the first session's stays."""
    now = ledger(spark, cfg).select(F.concat_ws("/", "project", "session_dir").alias("_dir"), F.col("version").alias("_version"))
    out = {}
    for name in RECORDS:
        out[name] = _read(spark, f"{cfg.store}/{name}", _schema(spark, name)).join(now, ["_dir", "_version"], "left_semi").drop("_version")
    out["fts"] = fts(out["event"], out["artifact"])
    first = F.row_number().over(Window.partitionBy("artifact_id").orderBy("_dir"))
    out["artifact"] = out["artifact"].withColumn("_n", first).filter("_n = 1").drop("_n")
    return out


def fts(event: DataFrame, artifact: DataFrame) -> DataFrame:
    """Documents of the index: indexed event texts, and artifacts once per session of their source event."""
    said = spoken(event).select(F.col("text").alias("content"), "session_id", F.lit("event").alias("source_type"), F.col("uuid").alias("source_id"), F.concat_ws("#", F.lit("e"), "session_id", "uuid", F.col("id").cast("string")).alias("doc"))
    made = artifact.join(event.select(F.col("uuid").alias("source_event_uuid"), "session_id").distinct(), "source_event_uuid").select("content", "session_id", F.lit("artifact").alias("source_type"), F.col("artifact_id").alias("source_id")).distinct()
    return said.unionByName(made.withColumn("doc", F.concat_ws("#", F.lit("a"), "session_id", "source_id")))


def ingest(spark: SparkSession, cfg: Config, version: str, now: int) -> int:
    """Normalise the sessions whose archive changed and replace them; returns how many. version must rise from pass to pass."""
    gens = archive.generations(spark, cfg)
    files = gens.select(F.concat_ws("/", "project", "session").alias("session_id"), F.concat_ws("/", "sub_path", F.col("nth").cast("string")).alias("path"), "size", F.col("sha256").alias("mtime"))
    found = ledgers.fingerprints(files)
    old = ledger(spark, cfg).select(F.concat_ws("/", "project", "session_dir").alias("session_id"), "fingerprint")
    changed = ledgers.changed_sessions(found, old).withColumnRenamed("session_id", "_dir")
    if not changed.limit(1).count():
        return 0
    # what this pass takes is written down first: a capture meanwhile waits for the next pass, with a fingerprint of its own
    taken = f"{cfg.store}/_taken-{version}"
    gens.withColumn("_dir", F.concat_ws("/", "project", "session")).join(changed, "_dir").write.mode("overwrite").parquet(taken)
    pending = spark.read.parquet(taken)
    changed = pending.select("_dir", "fingerprint").distinct()
    got = normalize(archive.generation_lines(pending.drop("_dir", "fingerprint")))
    session = got["session"]
    by_id = session.select("session_id", F.concat_ws("/", "project", "session_dir").alias("_dir"))
    for name, schema in RECORDS.items():
        df = got[name]
        if "session_dir" in df.columns:
            df = df.withColumn("_dir", F.concat_ws("/", "project", "session_dir"))
        else:
            df = df.join(by_id, "session_id")
        extra = [x.split()[0] for x in EXTRA.get(name, "").split(", ") if x]
        df.select(*(f.name for f in schema.fields), *extra, "_dir", F.lit(version).alias("_version")).write.mode("append").parquet(f"{cfg.store}/{name}")
    rows = session.withColumn("_dir", F.concat_ws("/", "project", "session_dir")).join(changed, "_dir").select("session_dir", "session_id", "project", "fingerprint", F.lit(now).cast("long").alias("ingested_at"), F.lit(version).alias("version"))
    rows.coalesce(1).write.mode("append").parquet(f"{cfg.store}/ledger")
    return ledger(spark, cfg).filter(F.col("version") == version).count()


def load(records: dict[str, DataFrame], cfg: Config) -> None:
    """Full rebuild from record tables: every table is overwritten; artifacts with one id keep the first."""
    for name, schema in RECORDS.items():
        df = records[name]
        if name == "event" and "id" not in df.columns:
            df = df.withColumn("id", F.row_number().over(Window.partitionBy("session_id").orderBy(F.asc_nulls_first("timestamp"), "uuid", "kind")).cast("long"))
        if name == "artifact":
            df = df.dropDuplicates(["artifact_id"])
        keep = [f.name for f in schema.fields] + (["id"] if name == "event" else [])
        df.select(*keep).write.mode("overwrite").parquet(f"{cfg.store}/loaded/{name}")


def loaded(spark: SparkSession, cfg: Config) -> dict[str, DataFrame]:
    out = {name: spark.read.parquet(f"{cfg.store}/loaded/{name}") for name in RECORDS}
    return out | {"fts": fts(out["event"], out["artifact"])}


def vacuum(spark: SparkSession, cfg: Config, scratch: str) -> None:
    """Rewrite the record tables without rows that no ledger row names."""
    for name in RECORDS:
        now = ledger(spark, cfg).select(F.concat_ws("/", "project", "session_dir").alias("_dir"), F.col("version").alias("_version"))
        kept = _read(spark, f"{cfg.store}/{name}", _schema(spark, name)).join(now, ["_dir", "_version"], "left_semi")
        kept.write.mode("overwrite").parquet(f"{scratch}/{name}")
        spark.read.schema(_schema(spark, name)).parquet(f"{scratch}/{name}").write.mode("overwrite").parquet(f"{cfg.store}/{name}")


class NotFound(LookupError):
    """A hit that does not resolve to a line."""


def resolve(spark: SparkSession, cfg: Config, records: dict[str, DataFrame], session_id: str, source_type: str, source_id: str) -> str:
    """The raw archived line of a hit: the first line with its uuid over the session's generations in stored order."""
    if source_type == "artifact":
        row = records["artifact"].filter(F.col("artifact_id") == source_id).select("source_event_uuid").first()
        if not row:
            raise NotFound(f"no artifact {source_id}")
        uuid = row.source_event_uuid
    elif source_type == "event":
        uuid = source_id
    else:
        raise ValueError(f"unknown target type {source_type!r}")
    session = records["session"].filter(F.col("session_id") == session_id).select("project", "session_dir").first()
    if not session:
        raise NotFound(f"no session {session_id}")
    gens = archive.generations(spark, cfg).filter((F.col("project") == session.project) & (F.col("session") == session.session_dir))
    row = pinpoint(archive.generation_lines(gens), uuid).first()
    if not row:
        raise NotFound(f"no line with uuid {uuid}")
    return row.line


def pinpoint(lines: DataFrame, uuid: str) -> DataFrame:
    """The first line, as it is, whose uuid is this one; lines that do not parse are passed over."""
    return lines.filter(F.get_json_object("line", "$.uuid") == uuid).orderBy("gen_ord", "line_no").limit(1)
