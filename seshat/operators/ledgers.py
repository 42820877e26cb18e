"""Work ledgers: what is to be embedded or ingested, what became of it, and how a run stands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GIVE_UP, STALE_SECONDS = 5, 120
UNIT = ["unit_kind", "source_id"]


def pending(units: DataFrame, ledger: DataFrame, version: str) -> DataFrame:
    """Units that this version has neither done nor given up."""
    over = ledger.filter((F.col("embedder_version") == version) & ((F.col("status") == "done") | (F.col("attempts") >= GIVE_UP)))
    return units.join(over, UNIT, "left_anti")


def upsert(ledger: DataFrame, news: DataFrame) -> DataFrame:
    """The ledger after outcomes (unit_kind, source_id, embedder_version, embedded_at, status, last_error): attempts add up."""
    old = ledger.select(*UNIT, F.struct("embedder_version", "embedded_at", "status", "attempts", "last_error").alias("old"))
    new = news.select(*UNIT, F.struct("embedder_version", "embedded_at", "status", "last_error").alias("new"))
    take = lambda c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    attempts = F.coalesce("old.attempts", F.lit(0)) + F.when(F.col("new").isNotNull(), 1).otherwise(0)
    return old.join(new, UNIT, "full").select(*UNIT, take("embedder_version"), take("embedded_at"), take("status"), attempts.cast("long").alias("attempts"), take("last_error"))


def current_vectors(vectors: DataFrame, ledger: DataFrame, version: str) -> DataFrame:
    """Vectors without those that the ledger has under another version."""
    return vectors.join(ledger.filter(F.col("embedder_version") != version), UNIT, "left_anti")


def changed_sessions(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Sessions (session_id, fingerprint) that are new or whose fingerprint differs."""
    old = ledger.select("session_id", F.col("fingerprint").alias("old"))
    return found.join(old, "session_id", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("old"))).drop("old")


def changed_files(found: DataFrame, watermark: DataFrame) -> DataFrame:
    """Files (path, mtime, size) that are new or differ from the watermark."""
    old = watermark.select("path", F.struct("mtime", "size").alias("old"))
    return found.join(old, "path", "left").filter(~F.struct("mtime", "size").eqNullSafe(F.col("old"))).drop("old")


def fingerprints(files: DataFrame) -> DataFrame:
    """Per session_id the sha256 of its sorted lines path|size|mtime (each with a line end)."""
    line = F.concat_ws("|", "path", F.col("size").cast("string"), F.col("mtime").cast("string"))
    return files.groupBy("session_id").agg(F.sort_array(F.collect_list(line)).alias("lines")).select("session_id", F.sha2(F.concat(F.array_join("lines", "\n"), F.lit("\n")), 256).alias("fingerprint"))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


@dataclass(frozen=True)
class Status:
    state: str
    done: int
    failed: int
    total: int
    line: str


def _utc(seconds: int) -> str:
    from datetime import UTC, datetime

    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def ledger_counts(ledger: DataFrame, version: str) -> DataFrame:
    """One row: done and failed of this version, and all rows."""
    own = F.col("embedder_version") == version
    return ledger.agg(F.count_if(own & (F.col("status") == "done")).alias("done"), F.count_if(own & (F.col("status") == "failed")).alias("failed"), F.count("*").alias("total"), F.min(F.when(own & (F.col("status") == "failed"), F.col("last_error"))).alias("error"))


def embed_status(ledger: DataFrame, runs: DataFrame, total: int, version: str, now: int) -> Status:
    """running > stalled > done > failed > not started. A finished run that left units out is "done with 0 failed"."""
    c = ledger_counts(ledger, version).first()
    run = runs.orderBy(F.desc("id")).limit(1).first()
    if run and run.state == "running":
        if now - run.heartbeat_at <= STALE_SECONDS:
            return Status("running", c.done, c.failed, total, f"running: {run.embedded}/{total} units embedded")
        return Status("stalled", c.done, c.failed, total, f"stalled: run pid {run.pid} started {_utc(run.started_at)}, last heartbeat {_utc(run.heartbeat_at)} (past the stale threshold)")
    if not run and not c.total:
        return Status("not-yet-embedded", 0, 0, total, f"not-yet-embedded: 0 of {total} assembled units embedded")
    if not c.failed and c.done == total:
        return Status("done", c.done, 0, total, f"done: {c.done}/{total} units embedded")
    return Status("failed", c.done, c.failed, total, f"done with {c.failed} failed" + (f": sample error: {c.error}" if c.error else ""))
