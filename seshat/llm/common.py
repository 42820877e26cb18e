"""What the document operators share: keys, shared-folder tables and Arrow batch helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(2**63)  # the key of rows whose id is null
_staged: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset in local mode, as in tests, one in the warehouse."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_seshat_shared"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, so that its lineage is cut and it survives lost executors.

    The write's shuffle files are deleted as it ends; else they would stay until the driver collects garbage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    """How many tables `staged` has written in this process and kept."""
    return len(_staged)


def drop_staged(spark: SparkSession, since: int = 0, but_last: int = 0) -> None:
    """Delete the tables that `staged` wrote in this process after the first `since`, but for the last ones; results that still read them become unreadable."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    until = len(_staged) - but_last
    for name in _staged[since:until]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    del _staged[since:until]


def repeated_ids(df: DataFrame, id_col: str) -> bool:
    """Whether some id occurs in more than one row (null counts as an id)."""
    return bool(df.groupBy(id_col).count().filter("count > 1").limit(1).count())


def keyed(df: DataFrame, id_col: str, text_col: str, unique: bool | None = None) -> DataFrame:
    """Columns _d (id, null as the smallest long), _t (0, or a text hash where ids repeat) and _x (text as given).

    Rows that repeat an id with another text are separate documents, ordered by _t; rows that repeat both are one
    document, and a result has a row for each of them.
    """
    unique = not repeated_ids(df, id_col) if unique is None else unique
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_d"),
        (F.lit(0).cast("long") if unique else F.xxhash64(text_col)).alias("_t"),
        F.col(text_col).cast("string").alias("_x"),
    )


def id_of(d: str = "_d"):
    """The id again, null where it was null."""
    return F.when(F.col(d) != NO_ID, F.col(d))


def held_out(id_col: str = "doc_id"):
    """True for rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3. Null ids: false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(rows: DataFrame, key_col: str, most: int) -> DataFrame:
    """About `most` rows at most, picked by a hash of key_col; all rows where there are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key_col)), F.lit(1_000_000)) < int(1_000_000 * most / n))


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches take about BATCH_BYTES at most from now on, unless the session has a bound already.

    Spark's own bound is 10,000 rows; of texts these are tens of MB, several times over in an executor and in each worker."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after a task, beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow of a function of one batch; it may give one batch or several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
        give_back()

    return df.mapInArrow(run, schema)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string or binary column, end to end, and the offsets (n + 1) in them; null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose lengths add up to about `most`; a longer one stands alone."""
    if len(lengths) == 0:
        return
    total = np.cumsum(lengths)
    i = 0
    while i < len(lengths):
        j = int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right"))
        j = max(j, i + 1)
        yield i, j
        i = j
