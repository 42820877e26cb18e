"""Quality rules with adaptive thresholds.

Each text gets a few measures. Instead of fixed cutoffs, every measure has fences per language and source, from
mergeable KLL quantile sketches: a sketch per group in one aggregation, and the sketch of everything by merging those.
A fence is FAR interquartile ranges beyond the quartiles, and never nearer to them than the measure's slack, the least
difference that matters. Fences of a group of n texts are drawn towards those of everything: their weight is
n^2 / (n^2 + PRIOR^2), at every size. The fences are then joined to the texts' measures and applied.

Measures are written once, so the texts are read once; what is joined and sketched are narrow rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import join
from .common import map_batches, staged

PRIOR = 100  # texts
FAR = 4.0
WINDOW = 8
# measure: slack
MEASURES = {"word_length": 3.0, "symbol_share": 0.1, "dup_line_share": 0.3, "repeat_share": 0.2, "log_words": 3.0}
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more."""
    if len(words) <= WINDOW:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    k = 1
    while k < WINDOW:
        h = join(h[:-k], h[k:])
        k *= 2
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h) + 1, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    again[-1] = False
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again[:-1])
    edge[at] += 1
    np.subtract.at(edge, at + WINDOW, 1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1] > 0))


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "ignore")
    words = raw.split()
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = raw.split(b"\n")
    own = [x for x in lines if x.strip()] if len(lines) > 1 else lines[:1] if words else []
    symbols = int(np.count_nonzero(_SYMBOL[np.frombuffer(raw, np.uint8)])) if any(c in text for c in "#*$%&|<>") else 0
    return len(words), len(text) - blanks, symbols, len(own) - len(set(own)), repeated_words(words), len(own)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of each row's text, with its id, lang and source."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([counts(x) for x in b.column(1).to_pylist()], np.int64).reshape(b.num_rows, 6)
        return pa.record_batch([b.column(0), b.column(2), b.column(3), *(pa.array(got[:, k]) for k in range(6))], names=["d", "lang", "source", *(c.split()[0] for c in COUNTS.split(", "))])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("x"), F.col("lang").cast("string"), F.col("source").cast("string")), fn, "d long, lang string, source string, " + COUNTS)


def fences(measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per language and source, and of everything: the lowest and highest value of each measure that passes."""
    sketches = measured.groupBy("lang", "source").agg(F.count("*").alias("texts"), *(F.kll_sketch_agg_double(m, 400).alias(m) for m in MEASURES))

    def limits(m: str, slack: float):
        q1, q3 = (F.kll_sketch_get_quantile_double(F.col(m), F.lit(q)) for q in (0.25, 0.75))
        far = F.greatest(FAR * (q3 - q1), F.lit(slack))
        return [(q1 - far).alias(f"{m}_low"), (q3 + far).alias(f"{m}_high")]

    whole = sketches.agg(F.sum("texts").alias("texts"), *(F.kll_merge_agg_double(m).alias(m) for m in MEASURES)).filter("texts > 0")
    every = [x for m, s in MEASURES.items() for x in limits(m, s)]
    weight = F.pow("texts", F.lit(2.0)) / (F.pow("texts", F.lit(2.0)) + PRIOR**2)
    return sketches.select("lang", "source", weight.alias("weight"), *every), whole.select(*every)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row the id, its counts, base_failed, kept, and failed, the measures beyond their fences.

    Null and empty texts have zero words and fail the base rule. A null language or source is a group of its own. Null
    and repeated ids are like others; other columns are ignored; an empty table gives none.
    """
    n = F.greatest("n_words", F.lit(1))
    rows = staged(measure(docs, id_col, text_col), "measures").withColumns(
        {
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "word_length": F.col("word_chars") / n,
            "symbol_share": F.col("n_symbols") / n,
            "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / n,
            "log_words": F.log1p("n_words"),
        }
    )
    own, whole = fences(rows.filter(~F.col("base_failed")))
    own = staged(own, "fences").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    of_all = whole.first()  # one row
    out = rows.join(own, rows["lang"].eqNullSafe(own["_lang"]) & rows["source"].eqNullSafe(own["_source"]), "left")
    toward = lambda own, all_: F.coalesce(F.col("weight") * own + (1 - F.col("weight")) * all_, all_)
    beyond = []
    for m in MEASURES:
        low, high = (toward(F.col(f"{m}_{x}"), F.lit(of_all[f"{m}_{x}"] if of_all else None).cast("double")) for x in ("low", "high"))
        beyond.append(F.when((F.col(m) < low) | (F.col(m) > high), m))
    failed = F.array_compact(F.array(*beyond))
    return out.select(F.col("d").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"), failed.alias("failed"))
