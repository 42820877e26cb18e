"""Substring deduplication by hashing lines or paragraphs.

A text is cut into units (lines, or paragraphs at blank lines). A unit is normalised (lower case, runs of blanks as one
space, trimmed) and stands for itself by a 128-bit digest. Digests are grouped over the whole corpus; the occurrence
that ranks first (smallest id, then place) stays and the others are removed, with their places in the original text
retained. Blank units are never removed; `least` can leave units of fewer words alone (by default none).

A hot digest never meets in one task: within PART bytes of texts only its earliest occurrence is compared with other
parts and the rest is decided at once, so a digest sends a row per part. The first one of each digest is a partial
aggregate (a row per task and digest), and digests of one row leave before the join that marks the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, keyed, map_batches, slices, staged, text_buffer

PART = 8 << 20  # bytes of texts whose units are compared at once
BLANK = " \t\r\x0b\x0c\n"
_BLANKS = re.compile(f"[{BLANK}]+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
UNITS = "h1 long, h2 long, d long, t long, u int, gone boolean"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def units(text: str | None, by: str = "line") -> list[tuple[int, int]]:
    """Start and end of each unit, in characters."""
    if not text:
        return []
    if by == "paragraph":
        cuts = [m.span() for m in _PARAGRAPH.finditer(text)]
        return list(zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(text)], strict=True))
    out, at = [], 0
    for part in text.split("\n"):
        out.append((at, at + len(part)))
        at += len(part) + 1
    return out


def normal(unit: str) -> str:
    return _BLANKS.sub(" ", unit.lower()).strip(" ")


def _later(h1: np.ndarray, h2: np.ndarray, d: np.ndarray, t: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Whether a unit's digest occurs earlier among these; repeated rows of one document are one."""
    o = np.lexsort((u, t, d, h2, h1))
    same = np.concatenate([[False], (h1[o][1:] == h1[o][:-1]) & (h2[o][1:] == h2[o][:-1])])
    head = o[np.maximum.accumulate(np.where(~same, np.arange(len(o)), 0))]
    out = np.zeros(len(o), bool)
    out[o] = same & ~((d[o] == d[head]) & (t[o] == t[head]) & (u[o] == u[head]))
    return out


def _digests(by: str, least: int):
    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, off = text_buffer(b.column(2))
        for p, q in slices(np.diff(off), PART):
            part = b.slice(p, q - p)
            hashes, own = [], []
            for k, x in enumerate(part.column(2).to_pylist()):
                for n, (s, e) in enumerate(units(x, by)):
                    unit = normal(x[s:e])
                    if unit and (least < 2 or unit.count(" ") + 1 >= least):
                        hashes.append(xxhash.xxh3_128_digest(unit.encode("utf-8", "ignore")))
                        own.append((k, n))
            if not own:
                continue
            h = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2).astype(np.int64)
            at = np.array(own, np.int64)
            d, t = (part.column(i).to_numpy(zero_copy_only=False)[at[:, 0]] for i in (0, 1))
            u = at[:, 1].astype(np.int32)
            yield pa.record_batch([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(d), pa.array(t), pa.array(u), pa.array(_later(h[:, 0], h[:, 1], d, t, u))], names=["h1", "h2", "d", "t", "u", "gone"])

    return fn


def _gone(texts: DataFrame, by: str, least: int) -> DataFrame:
    """For each document (_d, _t) with removed units their numbers."""
    rows = staged(map_batches(texts.filter(F.octet_length("_x") > 0), _digests(by, least), UNITS), "units")
    left = rows.filter("not gone")
    first = left.groupBy("h1", "h2").agg(F.min(F.struct("d", "t", "u")).alias("first"), F.count("*").alias("count")).filter("count > 1").drop("count")
    later = left.join(first, ["h1", "h2"]).filter(F.struct("d", "t", "u") > F.col("first"))
    return rows.filter("gone").select("d", "t", "u").unionByName(later.select("d", "t", "u")).groupBy(F.col("d").alias("_d"), F.col("t").alias("_t")).agg(F.collect_set("u").alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: str = "line", least: int = 1) -> DataFrame:
    """For each row the id, n_units (not blank), removed (start and length in characters of each removed unit in the
    original text, in order) and kept_text.

    kept_text is the units that stay, joined by line ends (paragraphs: each with the break before it). Null texts have
    no units and stay null, empty ones empty. A null id ranks first. Rows that repeat id and text are one document (each
    gets its result, none is a copy of another); rows with one id and different texts are ranked by a hash of the text.
    Very long texts are cut into units like others. Other columns are ignored; an empty table gives an empty result.
    """
    texts = keyed(docs, id_col, text_col)

    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, off = text_buffer(b.column(1))
        for p, q in slices(np.diff(off), PART):
            part = b.slice(p, q - p)
            kept, removed, n = [], [], []
            for x, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                spans, own = units(x, by), set(own or ())
                n.append(sum(bool(x[s:e].strip(BLANK)) for s, e in spans))
                removed.append([{"start": s, "length": e - s} for k, (s, e) in enumerate(spans) if k in own])
                if own:
                    stay = [k for k in range(len(spans)) if k not in own]
                    x = "".join((x[spans[k - 1][1] : spans[k][0]] if i else "") + x[spans[k][0] : spans[k][1]] for i, k in enumerate(stay))
                kept.append(x)
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(removed, SPANS), pa.array(kept, pa.string())], names=["_d", "n_units", "removed", "kept_text"])

    both = texts.join(_gone(texts, by, least), ["_d", "_t"], "left").select("_d", "_x", "gone")
    return map_batches(both, fn, "_d long, n_units long, removed array<struct<start:long,length:long>>, kept_text string").select(id_of().alias(id_col), "n_units", "removed", "kept_text")
