"""Transcript files: finding them, their keys, their lines."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Where things are. archive must not be empty or a file system's root."""

    archive: str
    root: str = ""
    store: str = ""
    width: int = 64

    def __post_init__(self):
        path = self.archive.split("://", 1)[-1].strip("/")
        if not path:
            raise ValueError("the archive folder must not be empty or a root")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def archive_key(path: Column, root: str) -> dict[str, Column]:
    """project, session and sub_path of a transcript under <root>/projects, null for paths that are none."""
    under = re.sub(r"^\w+:/*", "/", root).rstrip("/")
    rel = F.regexp_extract(path, f"^.*?\\Q{under}\\E/projects/(.*?)(?:\\.jsonl)?$", 1)
    parts = F.split(rel, "/")
    safe = (F.size(parts) >= 2) & ~F.exists(parts, lambda s: s.isin("", ".", "..") | F.contains(s, F.lit("\\")))
    return {"project": F.when(safe, parts[0]), "session": F.when(safe, parts[1]), "sub_path": F.when(safe, F.array_join(F.slice(parts, 3, 1_000_000), "/"))}


FILES = "path string, modificationTime timestamp, length long, content binary"


def transcript_files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """path, mtime (microseconds), size, project, session, sub_path and content of each transcript under <root>/projects.

    A root that is not there has none. Files whose names begin with _ or . are not seen by Spark's readers."""
    if not exists(spark, f"{root}/projects"):
        found = spark.createDataFrame([], FILES)
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(f"{root}/projects")
    return _keyed(found, root, content)


def files_at(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """`transcript_files` of some paths under the root; no other file is listed or read."""
    plain = [re.sub(r"([{}\[\]*?\\])", r"\\\1", x) for x in paths]
    return _keyed(spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(plain), root, True)


def _keyed(found: DataFrame, root: str, content: bool) -> DataFrame:
    out = found.select("path", F.unix_micros("modificationTime").alias("mtime"), F.col("length").alias("size"), *(["content"] if content else []))
    out = out.withColumns(archive_key(F.col("path"), root))
    return out.filter("project is not null")


def lines_of(files: DataFrame) -> DataFrame:
    """Raw lines of files (project, session_dir, gen_ord, gen_ref, content as binary), numbered from 0 as they are; blank ones dropped."""
    cut = files.select("project", "session_dir", "gen_ord", "gen_ref", F.posexplode(F.split(F.col("content").cast("string"), "\n", -1)).alias("line_no", "line"))
    return cut.filter(F.length(F.trim("line")) > 0)


def read_records(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four tables of a tagged JSON-lines file; a malformed line fails the read, blank lines are skipped."""
    from ..schema import RECORDS

    out = {}
    tag = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    for kind, schema in RECORDS.items():
        own = tag.filter(F.get_json_object("value", "$.type") == kind).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
        out[kind] = own.select("r.*")
    return out
