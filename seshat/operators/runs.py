"""Passes over a store: one at a time, with a run log that status reads.

A lock is a folder of numbered leases. Who holds the last one touches it while working; it is free when it is marked so
or has not been touched for STALE_SECONDS. Taking it over means creating the next number, which only one can, so nothing
is ever deleted under another's feet. Creating must be exclusive: so it is in HDFS and local folders, not in all object stores.

Vectors and their ledger are kept in SLICES parts by a hash of the unit, each written anew only when it has pending units
(vectors first, the ledger last); a part that breaks off leaves the one of an earlier run in force.
"""

from __future__ import annotations

import os
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EMBED_LEDGER, EMBED_RUN, META, VECTOR, VERSIONS
from ..sources import archive
from ..sources.transcripts import Config, exists
from . import embedding, ledgers, profiles, store

SLICES = 16


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _create(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if it is there already."""
    p, fs = _path(spark, path)
    if fs.getUri().getScheme() == "file":
        fs.mkdirs(p.getParent())
        try:
            os.close(os.open(p.toUri().getPath(), os.O_CREAT | os.O_EXCL))
            return True
        except FileExistsError:
            return False
    try:
        fs.create(p, False).close()
        return True
    except Exception:
        if fs.exists(p):
            return False
        raise


@dataclass
class Lock:
    spark: SparkSession
    folder: str
    number: int

    def held(self) -> bool:
        return max(_leases(self.spark, self.folder), default=0) == self.number

    def touch(self) -> None:
        if not self.held():
            raise RuntimeError(f"the lock {self.folder} was taken over after {ledgers.STALE_SECONDS} seconds without a sign")
        p, fs = _path(self.spark, f"{self.folder}/{self.number}")
        fs.setTimes(p, int(time.time() * 1000), -1)

    def release(self) -> None:
        _create(self.spark, f"{self.folder}/{self.number}.free")


def _leases(spark: SparkSession, folder: str) -> list[int]:
    return [int(n) for n in _names(spark, folder) if n.isdigit()]


def acquire(spark: SparkSession, folder: str, stale: float = ledgers.STALE_SECONDS) -> Lock | None:
    """The lock, or None while another holds it; never waits."""
    last = max(_leases(spark, folder), default=0)
    if last and f"{last}.free" not in _names(spark, folder):
        p, fs = _path(spark, f"{folder}/{last}")
        if time.time() - fs.getFileStatus(p).getModificationTime() / 1000 <= stale:
            return None
    return Lock(spark, folder, last + 1) if _create(spark, f"{folder}/{last + 1}") else None


def seed(spark: SparkSession, cfg: Config) -> dict[str, str]:
    """The versions that the store was made with; written when there are none yet."""
    if not exists(spark, f"{cfg.store}/meta"):
        spark.createDataFrame(sorted(VERSIONS.items()), META).coalesce(1).write.parquet(f"{cfg.store}/meta")
    return {r.key: r.value for r in spark.read.schema(META).parquet(f"{cfg.store}/meta").collect()}


def ingest_pass(spark: SparkSession, cfg: Config, captured_at: str, number: int, now: int) -> dict[str, int] | None:
    """Sweep, then replace what changed; None if another pass is at it. number must rise from pass to pass."""
    lock = acquire(spark, f"{cfg.store}/_lock-ingest")
    if not lock:
        return None
    try:
        seed(spark, cfg)
        swept = archive.sweep(spark, cfg, captured_at, number)
        lock.touch()
        return {"captured": swept, "sessions": store.ingest(spark, cfg, f"{number:09d}", now)}
    finally:
        lock.release()


def log(spark: SparkSession, cfg: Config, seq: int, **run) -> None:
    row = tuple(run[f.name] for f in EMBED_RUN.fields)
    spark.createDataFrame([row], EMBED_RUN).withColumn("seq", F.lit(seq).cast("long")).coalesce(1).write.mode("append").parquet(f"{cfg.store}/embed_run")


def runs(spark: SparkSession, cfg: Config) -> DataFrame:
    """The last record of each run."""
    path = f"{cfg.store}/embed_run"
    if not exists(spark, path):
        return spark.createDataFrame([], EMBED_RUN)
    return ledgers.latest(spark.read.schema(T.StructType([*EMBED_RUN.fields, T.StructField("seq", T.LongType())])).parquet(path), ["id"], "seq").drop("seq")


def _parts(spark: SparkSession, cfg: Config) -> dict[int, str]:
    """For each slice the folder of the last run that finished it."""
    out: dict[int, tuple[int, str]] = {}
    for name in _names(spark, f"{cfg.store}/embed"):
        run, k = map(int, name.split("-"))
        folder = f"{cfg.store}/embed/{name}"
        if run > out.get(k, (0, ""))[0] and exists(spark, f"{folder}/embed_ledger/_SUCCESS"):
            out[k] = run, folder
    return {k: folder for k, (_, folder) in out.items()}


def embedded(spark: SparkSession, cfg: Config, of: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Vectors and ledger in force, of one slice or all."""
    folders = [f for k, f in _parts(spark, cfg).items() if of in (None, k)]
    read = lambda name, schema: spark.read.schema(schema).parquet(*(f"{f}/{name}" for f in folders)) if folders else spark.createDataFrame([], schema)
    return read("vector", VECTOR), read("embed_ledger", EMBED_LEDGER)


def embed_pass(spark: SparkSession, cfg: Config, embedder: embedding.Embedder, clock=time.time) -> dict[str, int] | None:
    """Embed what is pending, slice by slice, with a heartbeat after each; None if another pass is at it."""
    lock = acquire(spark, f"{cfg.store}/_lock-embed")
    if not lock:
        return None
    try:
        began = int(clock())
        units_at = f"{cfg.store}/_units"
        profiles.assemble(store.tables(spark, cfg)).withColumn("slice", F.pmod(F.xxhash64("unit_kind", "source_id"), F.lit(SLICES)).cast("int")).write.mode("overwrite").partitionBy("slice").parquet(units_at)
        units = spark.read.parquet(units_at)
        number = max((r.id for r in runs(spark, cfg).select("id").collect()), default=0) + 1
        run = {"id": number, "started_at": began, "pid": os.getpid(), "state": "running", "total": units.count(), "embedded": 0, "skipped": 0, "failed": 0}
        log(spark, cfg, 0, heartbeat_at=began, **run)
        for k in range(SLICES):
            vectors, book = embedded(spark, cfg, k)
            own = units.filter(F.col("slice") == k).drop("slice")
            if not ledgers.pending(own, book, embedder.version).limit(1).count():
                run["skipped"] += own.count()
            else:
                folder = f"{cfg.store}/embed/{number}-{k}"

                def keep(df: DataFrame, name: str, folder: str = folder) -> DataFrame:
                    df.write.parquet(f"{folder}/{name}")
                    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

                _, _, counts = embedding.drain(own, vectors, book, embedder, str(int(clock())), keep)
                for c, n in counts.items():
                    run[c] += n
            lock.touch()
            log(spark, cfg, k + 1, heartbeat_at=int(clock()), **run)
        log(spark, cfg, SLICES + 1, heartbeat_at=int(clock()), **(run | {"state": "done"}))
        return {c: run[c] for c in ("embedded", "skipped", "failed")}
    finally:
        lock.release()


def status(spark: SparkSession, cfg: Config, version: str, now: int) -> ledgers.Status:
    """How embedding stands: the run log, the ledger in force and the units of the store."""
    total = profiles.assemble(store.tables(spark, cfg)).count()
    return ledgers.embed_status(embedded(spark, cfg)[1], runs(spark, cfg), total, version, now)
