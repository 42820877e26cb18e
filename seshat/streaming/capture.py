"""Capture and ingest as a stream of files: each trigger takes the files that are there and ends by itself.

Spark's file source follows names: a transcript that grows under its own name is not read again, so growing files are
swept by (path, time, size), see sources.archive.sweep; this source serves drop folders whose files never change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import archive
from ..sources.transcripts import FILES, Config, archive_key


def capture_stream(spark: SparkSession, cfg: Config, checkpoint: str, captured_at: str, after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Archive new transcripts under <root>/projects. Replays after a failure add nothing, as contents are deduplicated.

    after(batch) is called with the keys of each batch that had files (to ingest, or to start a drain).
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(f"{cfg.root}/projects")
    keyed = files.withColumns(archive_key(F.col("path"), cfg.root)).filter("project is not null")

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            if batch.limit(1).count():
                archive.append(archive.new_generations(batch, archive.generations(spark, cfg), "sweep", captured_at), cfg)
                if after:
                    after(batch.select("project", "session").distinct())
        finally:
            batch.unpersist()

    return keyed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
