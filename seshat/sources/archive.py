"""The archive: write-once generations of transcripts, deduplicated by content.

A generation is a row of a Parquet table (zstd), partitioned by project: key (project, session, sub_path), its number
from 0, kind, sha256, size, captured_at and the bytes as they were. A file that grew is a new generation beside the old.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .transcripts import Config, exists, files_at, lines_of, transcript_files

KEY = ["project", "session", "sub_path"]
SCHEMA = "project string, session string, sub_path string, nth int, kind string, sha256 string, size long, captured_at string, content binary"


def generations(spark: SparkSession, cfg: Config) -> DataFrame:
    path = f"{cfg.archive}/generations"
    return spark.read.schema(SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], SCHEMA)


def new_generations(files: DataFrame, old: DataFrame, kind: str, captured_at: str) -> DataFrame:
    """Files (KEY, content) whose content no generation of their key has yet; of equal contents one. Numbers go on from the key's last."""
    fresh = files.withColumn("sha256", F.sha2("content", 256)).dropDuplicates([*KEY, "sha256"])
    fresh = fresh.join(old.select(*KEY, "sha256"), [*KEY, "sha256"], "left_anti")
    last = old.groupBy(*KEY).agg(F.max("nth").alias("last"))
    n = F.row_number().over(Window.partitionBy(*KEY).orderBy("sha256"))
    return fresh.join(last, KEY, "left").select(*KEY, (F.coalesce("last", F.lit(-1)) + n).cast("int").alias("nth"), F.lit(kind).alias("kind"), "sha256", F.length("content").cast("long").alias("size"), F.lit(captured_at).alias("captured_at"), "content")


def append(rows: DataFrame, cfg: Config) -> None:
    rows.write.mode("append").option("compression", "zstd").partitionBy("project").parquet(f"{cfg.archive}/generations")


def watermark(spark: SparkSession, cfg: Config) -> DataFrame:
    """path, mtime, size of files as last captured; the latest row of a path counts."""
    from ..operators.ledgers import latest

    path = f"{cfg.archive}/watermark"
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, mtime long, size long")
    return latest(spark.read.schema("path string, mtime long, size long, swept long").parquet(path), ["path"], "swept").drop("swept")


def sweep(spark: SparkSession, cfg: Config, captured_at: str, sweep_no: int) -> int:
    """Capture files that are new or changed; returns how many. Generations are written before the watermark, so a sweep
    that breaks off is repeated and adds nothing twice."""
    from ..operators.ledgers import changed_files

    found = transcript_files(spark, cfg.root, content=False)
    changed = changed_files(found, watermark(spark, cfg)).select("path", "mtime", "size")
    paths = changed.collect()  # names of changed files, which the driver lists anyway
    if not paths:
        return 0
    rows = files_at(spark, cfg.root, [r.path for r in paths])
    append(new_generations(rows, generations(spark, cfg), "sweep", captured_at), cfg)
    spark.createDataFrame([(r.path, r.mtime, r.size, sweep_no) for r in paths], "path string, mtime long, size long, swept long").write.mode("append").parquet(f"{cfg.archive}/watermark")
    return len(paths)


def snapshot(spark: SparkSession, cfg: Config, payload: dict, captured_at: str) -> bool:
    """Capture the one transcript that a hook payload names (session_id, transcript_path, cwd). False if it is not there.

    A file outside the root is filed under the payload's session id and a project made from cwd; ids or a cwd that are
    empty or climb out of their place are refused."""
    path = payload.get("transcript_path") or ""
    if not path or not exists(spark, path):
        return False
    inside = f"{cfg.root.rstrip('/')}/projects/" in path
    if inside:
        rows = files_at(spark, cfg.root, [path])
    else:
        session, places = payload.get("session_id") or "", (payload.get("cwd") or "").strip("/").split("/")
        if any(x in ("", ".", "..") for x in [session, *places]) or "/" in session or "\\" in session:
            raise ValueError(f"unsafe session id or cwd: {session!r}, {payload.get('cwd')!r}")
        one = spark.read.format("binaryFile").load(path)
        rows = one.select(F.lit("-" + "-".join(places)).alias("project"), F.lit(session).alias("session"), F.lit("").alias("sub_path"), "content")
    append(new_generations(rows, generations(spark, cfg), "snapshot", captured_at), cfg)
    return True


def manifest(spark: SparkSession, cfg: Config) -> DataFrame:
    """Per session directory its parent's and subagents' generations in stored order, derived from the archive itself, so it cannot lag behind."""
    one = F.struct("sub_path", "nth", "kind", "sha256", "size", "captured_at")
    return generations(spark, cfg).drop("content").groupBy("project", "session").agg(F.sort_array(F.collect_list(one)).alias("generations"))


def generation_lines(gens: DataFrame) -> DataFrame:
    """Raw lines of generations: the parent's first, then each subagent's by path, each in order of number."""
    ref = F.concat(F.when(F.col("sub_path") != "", F.concat("sub_path", F.lit("/"))).otherwise(F.lit("")), F.lpad(F.col("nth").cast("string"), 4, "0"))
    order = F.concat(F.when(F.col("sub_path") == "", "0").otherwise("1"), "sub_path", F.lit("/"), F.lpad(F.col("nth").cast("string"), 9, "0"))
    return lines_of(gens.select("project", F.col("session").alias("session_dir"), order.alias("gen_ord"), ref.alias("gen_ref"), "content"))


def read_generation(spark: SparkSession, cfg: Config, project: str, session: str, ref: str) -> bytes | None:
    """The bytes of one generation; refs that climb out of their session are refused."""
    parts = ref.split("/")
    if any(p in ("", ".", "..") for p in [project, session, *parts]) or not parts[-1].isdigit():
        raise ValueError(f"unsafe reference {ref!r}")
    row = generations(spark, cfg).filter((F.col("project") == project) & (F.col("session") == session) & (F.col("sub_path") == "/".join(parts[:-1])) & (F.col("nth") == int(parts[-1]))).select("content").first()
    return bytes(row.content) if row else None


def read_zstd(spark: SparkSession, root: str) -> DataFrame:
    """Raw lines of <root>/<project>/<session>/[subagents/<agent>/]NNNN.zst files, as lines_of gives them."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="[0-9]*.zst").select("value", F.col("_metadata.file_path").alias("path"))
    rel = F.regexp_extract("path", "([^/]+)/([^/]+)/((?:subagents/.+/)?)([0-9]+)\\.zst$", 0)
    project, session, sub, nth = (F.regexp_extract(rel, "^([^/]+)/([^/]+)/((?:subagents/.+/)?)([0-9]+)\\.zst$", k) for k in range(1, 5))
    order = F.concat(F.when(sub == "", "0").otherwise("1"), sub, nth)
    return lines_of(files.select(project.alias("project"), session.alias("session_dir"), order.alias("gen_ord"), F.concat(sub, nth).alias("gen_ref"), F.col("value").alias("content")))
