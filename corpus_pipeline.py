"""Documents to training sequences: toxicity, near duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seshat.llm import decontam, near_copies, packing, queries, suffix_dedup, toxicity
from seshat.llm.common import drop_staged, repeated_ids, small_batches, staged, staged_so_far

NO_ID_FROM = 1 << 62  # keys of rows without an id
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage, whose result the caller writes: so the session keeps the bound on batches of texts after it."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, docs, sf_dir)

    return run


@stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold. The scorer learns from those that are labelled and not held out."""
    scorer = toxicity.learn(toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.without_toxic(docs, scorer).select(*COLUMNS)


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies (Jaccard of five-word shingles 0.8 or more).

    Rows without an id rank behind all ids, by a hash of their text. Of rows that repeat an id, or text without an id, the
    one that is smallest by text (null first), lang, source and n_chars stays."""
    rows = docs.withColumn("_k", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID_FROM).bitwiseOR(F.xxhash64("text").bitwiseAND(F.lit(NO_ID_FROM - 1)))))
    before, found = staged_so_far(), near_copies.near_copies(rows, "_k")
    keep = staged(found.filter(F.col("_k") == F.col("component_id")).select(F.col("_k").alias("_one")).distinct(), "one-of-each")
    drop_staged(spark, before, but_last=1)
    kept = rows.join(keep, F.col("_k") == F.col("_one"), "left_semi")
    if repeated_ids(rows, "_k"):
        kept = kept.groupBy("_k").agg(F.min(F.struct("text", "lang", "source", "n_chars", "doc_id")).alias("_r")).select("_r.*")
    return kept.select(*COLUMNS)


@stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without what an earlier one (or an earlier part) already says in 100 bytes or more."""
    return suffix_dedup.rewritten(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids."""
    return packing.pack(docs, queries.tokenizer_path(), with_ids=True)


STAGES = [("toxicity", reject_toxic), ("near_duplicates", one_of_each), ("repeated_passages", without_repeats), ("decontamination", without_leaks), ("packing", packed)]

#: SQL can express neither the learned scores nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again; returns the pieces of the packed sequences."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), staged_so_far()
    for name, f in STAGES[:-1]:
        docs = staged(f(spark, docs, sf_dir), name)
    out = staged(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
    drop_staged(spark, before, but_last=1)
    return out
