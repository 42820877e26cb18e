"""The operators' queries on the synthetic tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, licenses, line_dedup, packing, quality, quality_rules, simhash, suffix_dedup, toxicity
from .common import documents, staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scorer = toxicity.learn(toxicity.training_rows(docs, _table(spark, sf_dir, "labels")))
    return toxicity.score_toxicity(docs, scorer).select("doc_id", "held_out", "score", "predicted")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(documents(spark, sf_dir)))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = staged(quality.views(documents(spark, sf_dir)), "views")
    return quality.score_views(views, quality.learn_views(views, _table(spark, sf_dir, "labels")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir)).drop("detections")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.line_dedup(documents(spark, sf_dir))
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("+", x["start"], x["length"])), ",")
    return got.select("doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), chars.alias("removed_chars"), spans.alias("removed_spans"), "kept_text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).drop("failed")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_suffix_dedup, op3_language, op4_quality, op5_licenses, op6_line_dedup, op7_quality_rules, op8_packing, op9_simhash, op10_decontamination)}

SQL = {
    "op2_suffix_dedup": r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
size AS (SELECT doc_id, h, length(h) // 2 AS n FROM docs),
starts AS (SELECT doc_id, h, unnest(range(n - 99)) AS s FROM size WHERE n >= 100),
windows AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS w FROM starts),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS k FROM windows) WHERE k > 1),
steps AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS fresh FROM again),
runs AS (SELECT doc_id, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run, s FROM steps),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS z FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, z, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM spans),
per AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, min(a) AS first FROM spans GROUP BY doc_id),
rest AS (SELECT g.doc_id, string_agg(substr(h, 2 * z + 1, 2 * (coalesce(next, n) - z)), '' ORDER BY z) AS tail FROM gaps g JOIN size USING (doc_id) GROUP BY g.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(CASE WHEN first IS NULL THEN h ELSE substr(h, 1, 2 * first) || tail END)) AS kept_sha256
FROM size LEFT JOIN per USING (doc_id) LEFT JOIN rest USING (doc_id)
""",
    "op6_line_dedup": r"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
units AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS unit FROM cut),
placed AS (SELECT doc_id, unit, line, length(line) AS length,
    sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit) - length(line) - 1 AS start,
    trim(regexp_replace(lower(line), '[ \t\r\x0b\x0c]+', ' ', 'g'), ' ') AS norm FROM units),
ranked AS (SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, unit) > 1 AS gone FROM placed),
done AS (SELECT doc_id, count(*) FILTER (norm <> '') AS n_units, count(*) FILTER (gone) AS n_removed,
    coalesce(sum(length) FILTER (gone), 0) AS removed_chars,
    coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || '+' || CAST(length AS VARCHAR), ',' ORDER BY unit) FILTER (gone), '') AS removed_spans,
    coalesce(string_agg(line, chr(10) ORDER BY unit) FILTER (NOT gone), '') AS kept_text FROM ranked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars,
    coalesce(removed_spans, '') AS removed_spans, CASE WHEN d.text IS NOT NULL THEN coalesce(kept_text, '') END AS kept_text
FROM documents d LEFT JOIN done ON d.doc_id = done.doc_id
""",
}
