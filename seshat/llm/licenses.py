"""License scans by ordered signature rules, in DataFrame functions alone.

A text becomes words in lower case (A-Z) with single spaces. Each rule (see license_rules) is a hand-written regular
expression on them with a keyword that every match holds, a priority and a label; a detection that lies within another
one of equal or higher priority is suppressed, so "GNU Lesser General Public License, version 3" is not also the plain
"GPL".

A text is tried only if it holds one of a few gate words, and a rule only where its keyword occurs; this is part of the
scan over the documents, spread as they are, with every pattern a constant that is compiled once. What goes on is the few
texts with a match and the numbers of their rules. Detections are rows: matches get their place by a running sum, and
suppression is a running maximum over intervals in order, per priority. Nothing is compared pairwise, and a text with
very many detections is sorted by Spark, not held in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .license_rules import GATES, rules

# The base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
PRIORITIES = range(1, 6)


def _whole(pattern: str) -> str:
    """The pattern at whole words."""
    return f"(?<= )(?:{pattern})(?= )"


def words_of(text: Column) -> Column:
    """Words in lower case with a space before, between and after; a single space for none.

    The two letters outside A-Z whose lower case has A-Z in it are put out of its way."""
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u0130"), F.lit("\u0131")), F.lit("\u212a"), F.lit("\u0137"))
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(F.lower(plain), F.lit(" ")), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _base(norm: Column, phrase: str) -> tuple[Column, Column, Column, Column]:
    """Whether the phrase occurs, how often, and the first and last word it starts at."""
    spaced, n = f" {phrase} ", phrase.count(" ") + 1
    has = F.contains(norm, F.lit(spaced))
    count = F.when(has, F.regexp_count(norm, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0)
    first = F.when(has, _spaces(F.substring_index(norm, spaced, 1)))
    last = F.when(has, _spaces(norm) - 1 - _spaces(F.substring_index(norm, spaced, -1)) - n)
    return has, count, first, last


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row the id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections (label, start
    and end in characters of the spaced words, priority).

    Null and empty texts have no words, no labels (empty strings) and score 0. Rows with null or repeated ids are each
    scanned; other columns are ignored; an empty table gives none.
    """
    norm = F.col("w")
    found = [(label, *_base(norm, phrase)) for phrase, label in BASE]
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains(norm, F.lit(g))
    rows = docs.select(F.col(id_col).alias("d"), words_of(F.col(text_col).cast("string")).alias("w")).select(
        "d",
        F.monotonically_increasing_id().alias("r"),
        (_spaces(norm) - 1).cast("long").alias("n_words"),
        sum((c for _, _, c, _, _ in found), F.lit(0)).cast("long").alias("n_base"),
        F.least(*(f for *_, f, _ in found)).cast("long").alias("first_word"),
        F.greatest(*(x for *_, x in found)).cast("long").alias("last_word"),
        F.array_compact(F.array(*(F.when(has, label) for label, has, *_ in found))).alias("base"),
        F.when(gate, norm).alias("w"),
    )
    tried = F.array_compact(F.array(*(F.when(F.contains(norm, F.lit(k)) & norm.rlike(_whole(p)), i) for i, k, p, _, _ in rules())))
    rows = rows.withColumn("rules", F.when(norm.isNotNull(), tried)).withColumn("w", F.when(F.size("rules") > 0, norm))
    rows = staged(rows, "license-words")
    table = F.array(*(F.struct(F.lit(i).alias("rule"), F.lit(_whole(p)).alias("pattern"), F.lit(q).alias("priority"), F.lit(label).alias("label")) for i, _, p, q, label in rules()))
    tried = rows.filter(F.col("w").isNotNull()).select("r", "w", F.explode("rules").alias("rule")).select("r", "w", F.get(table, F.col("rule")).alias("x"))
    hits = tried.select("r", "x", F.split("w", F.col("x.pattern"), -1).alias("between"), F.expr("regexp_extract_all(w, x.pattern, 0)").alias("match")).filter(F.size("match") > 0)
    each = hits.select("r", "x", F.posexplode(F.arrays_zip(F.slice("between", 1, F.size("match")).alias("between"), F.col("match").alias("match"))).alias("n", "m"))
    size, gap = F.length("m.match"), F.length("m.between")
    so_far = Window.partitionBy("r", "x.rule").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    spans = each.select("r", "x.rule", "x.priority", "x.label", (F.sum(size + gap).over(so_far) - size).alias("start"), F.sum(size + gap).over(so_far).alias("end"))
    above = Window.partitionBy("r").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    for q in PRIORITIES:
        spans = spans.withColumn(f"upto{q}", F.max(F.when(F.col("priority") >= q, F.col("end"))).over(above))
    within = F.coalesce(F.coalesce(*(F.when(F.col("priority") == q, F.col(f"upto{q}")) for q in PRIORITIES)) >= F.col("end"), F.lit(False))
    detected = spans.filter(~within).groupBy("r").agg(F.sort_array(F.collect_list(F.struct("start", "end", "priority", "label"))).alias("detections"), F.sum("priority").alias("weight"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce(F.transform("detections", lambda x: x["label"]), F.array().cast("array<string>")))))
    return rows.drop("w", "rules").join(detected, "r", "left").select(
        F.col("d").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 0.3).otherwise(0.0), 1 - F.exp(-0.5 * F.coalesce("weight", F.lit(0)))).alias("score"),
        F.coalesce("detections", F.array().cast("array<struct<start:bigint,end:bigint,priority:int,label:string>>")).alias("detections"),
    )
