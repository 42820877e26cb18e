"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

A window of L bytes is repeated when an equal window starts earlier in the corpus (smaller id, or earlier in the
same document). Suffixes need sorting only through L bytes, most significant digit first, and a group that is equal
through all digits is one repeated window. Sorting every suffix would move many times the input, so the sort is
sparse: the leftmost smallest hash of the K-byte strings in a window is its anchor, equal windows have equal anchors
at equal places, and the consecutive windows that share an anchor (some dozens) travel as one row, a run.

* Digit 1, the anchor's K bytes. Runs alone in their group hold no repeated window and leave; of runs with the same
  bytes all but the earliest are repeated whole; the rest go on.
* Digit 2, the bytes common to BIN neighbouring windows of a run, with the same three outcomes.
* Digit 3, single windows: all but the earliest of each group are repeated.

A digit is compared as a 64-bit hash, together with a second one of all bytes a run covers (windows: two hashes of
64 of their bytes), so unequal strings meet with a chance of the order of 2^-64 a pair.

A hot group is thinned before it is shuffled: within PART bytes of texts, of equal runs only the earliest is compared
with other batches, and (before digit 3) a group of many different runs sends two of them and passes the others on undecided.
Those rows get a key of their own, so they spread; in digit 3 rows spread by both hashes. Groups are ranked by Spark's external sort, never held in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytehash import U, join, levels, mix, sliding_min
from .common import NO_ID, drop_staged, id_of, keyed, map_batches, repeated_ids, slices, staged, staged_so_far, text_buffer

K = 32  # bytes of an anchor
BIN = 8  # windows of a run that digit 2 takes together
BLOCK = 1 << 20  # bytes hashed at once
PART = 8 << 20  # bytes of texts whose runs are thinned together
SEGMENT = 8 << 20  # windows of one document hashed at once
MANY = 64  # rows of a group in one batch from which it is thinned
SETTLED, DUP, OPEN = 0, 1, 2
ROWS = "g long, c long, d long, t long, s long, w int, r int, f int"


def _rows(g, c, d, t, s, w, r, last: bool = False) -> pa.RecordBatch:
    """A batch of runs, thinned (in the last digit only equal ones, as no digit is left for undecided ones): g, c digit and whole hash; d, t document; s first window, w windows, r anchor's offset, f outcome so far."""
    f = np.zeros(len(g), np.int32)
    if len(g):
        o = np.argsort(g, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], g[o][1:] != g[o][:-1], [True]]))
        big = np.flatnonzero(np.diff(edge) > MANY)
        if len(big):
            i = np.concatenate([o[edge[b] : edge[b + 1]] for b in big])
            i = i[np.lexsort((s[i], t[i], d[i], c[i], g[i]))]
            same_g = np.concatenate([[False], g[i][1:] == g[i][:-1]])
            same = same_g & np.concatenate([[False], c[i][1:] == c[i][:-1]])
            # the earliest of each (g, c); repeated rows of one document are one
            head = np.maximum.accumulate(np.where(~same, np.arange(len(i)), 0))
            dup = same & ~((d[i] == d[i[head]]) & (t[i] == t[i[head]]) & (s[i] == s[i[head]]))
            number = np.cumsum(~same)
            first = np.maximum.accumulate(np.where(~same_g, number, 0))
            undecided = ~dup & (number - first >= 2) & (not last)
            f[i[dup]], f[i[undecided]] = DUP, OPEN
            own = i[dup | undecided]
            g[own] = mix(mix((d[own] + s[own] * 31).astype(np.uint64)) ^ U(0x5BD1E995) ^ g[own])
    return pa.record_batch([g.view(np.int64), c.view(np.int64), d, t, s, w.astype(np.int32), r.astype(np.int32), f], names=ROWS.replace(" long", "").replace(" int", "").split(", "))


def _anchors(buf: np.ndarray, off: np.ndarray, length: int):
    """Runs of the texts in buf: which text, first window, windows, anchor's offset from the first window, digit, whole."""
    out = []
    cut = []  # (text, from, to) of windows, so that one long text is hashed in pieces
    for i in np.flatnonzero(np.diff(off) >= length):
        n = int(off[i + 1] - off[i]) - length + 1
        cut += [(i, a, min(a + SEGMENT, n)) for a in range(0, n, SEGMENT)]
    if not cut:
        return None
    which, a, b = (np.array(x) for x in zip(*cut, strict=True))
    size = b - a + length - 1
    for p, q in slices(size, BLOCK):
        part = np.concatenate([buf[off[which[k]] + a[k] : off[which[k]] + b[k] + length - 1] for k in range(p, q)])
        start = np.concatenate([[0], np.cumsum(size[p:q])])
        hk, h64 = levels(part, K, 64)
        low = (hk & U(0xFFFFFFFF00000000)) | np.arange(len(hk), dtype=np.uint64)
        at = (sliding_min(low, length - K + 1) & U(0xFFFFFFFF)).astype(np.int64)
        inside = np.zeros(len(part) + 1, np.int32)
        inside[start[:-1]] += 1
        inside[start[1:] - length + 1] -= 1
        w = np.flatnonzero(np.cumsum(inside)[: len(at)] > 0)
        first = np.flatnonzero(np.concatenate([[True], at[w][1:] != at[w][:-1]]))
        s, e, pos = w[first], w[np.concatenate([first[1:], [len(w)]]) - 1], at[w[first]]
        n = length + e - s
        whole = join(join(join(h64[s], h64[s + np.minimum(52, n - 64)]), h64[e + length - 64]), ((pos - s) * 1000 + n).astype(np.uint64))
        k = np.searchsorted(start, s, "right") - 1
        out.append((which[p:q][k], s - start[k] + a[p:q][k], e - s + 1, pos - s, hk[pos], mix(whole)))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _first_digit(length: int):
    def fn(b: pa.RecordBatch):
        buf, off = text_buffer(b.column(2))
        d, t = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for p, q in slices(np.diff(off), PART):
            got = _anchors(buf[off[p] : off[q]], off[p : q + 1] - off[p], length)
            if got is not None:
                i, s, w, r, g, c = got
                yield _rows(g, c, d[p:q][i], t[p:q][i], s.astype(np.int64), w, r)

    return fn


def _runs(b: pa.RecordBatch):
    """Of a batch (d, t, text, runs): for each block of texts its bytes, the runs' texts, first windows (in the bytes), windows, offsets."""
    buf, off = text_buffer(b.column(2))
    d, t = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    runs = b.column(3)
    per = np.diff(runs.offsets.to_numpy())
    flat = runs.flatten()
    s, w, r = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
    upto = np.concatenate([[0], np.cumsum(per)])
    for p, q in slices(np.diff(off), BLOCK):
        i = np.repeat(np.arange(p, q), per[p:q])
        x = slice(upto[p], upto[q])
        yield buf[off[p] : off[q]], d[i], t[i], s[x], off[i] - off[p], w[x], r[x]


def _second_digit(length: int):
    def fn(b: pa.RecordBatch):
        for part, d, t, s, base, w, r in _runs(b):
            (h64,) = levels(part, 64)
            n = (r // BIN) - ((r - w + 1) // BIN) + 1  # bins of each run, by a window's distance to its anchor
            i = np.repeat(np.arange(len(s)), n)
            k = (r // BIN)[i] - (np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n))
            far, near = np.minimum(r[i], k * BIN + BIN - 1), np.maximum(r[i] - w[i] + 1, k * BIN)
            pos = s[i] + r[i] + base[i]
            a, z = pos - k * BIN, pos - k * BIN - BIN + 1 + length  # common to all windows of the bin
            lo, hi = pos - far, pos - near + length
            g = mix(join(join(h64[a], h64[z - 64]), (k * 1000 + length).astype(np.uint64)))
            c = mix(join(join(h64[lo], h64[hi - 64]), (far * 1000 + near).astype(np.uint64)))
            yield _rows(g, c, d[i], t[i], lo - base[i], far - near + 1, far)

    return fn


def _third_digit(length: int):
    def fn(b: pa.RecordBatch):
        for part, d, t, s, base, w, _ in _runs(b):
            (h64,) = levels(part, 64)
            i = np.repeat(np.arange(len(s)), w)
            at = s[i] + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
            one, two = h64[at + base[i]], h64[at + base[i] + length - 64]
            yield _rows(mix(one), mix(two), d[i], t[i], at, np.ones(len(i)), np.zeros(len(i)), last=True)

    return fn


def _sorted_groups(rows: DataFrame, last: bool) -> DataFrame:
    """The outcome of each run of a digit: repeated, or to be looked at by the next digit; settled ones go."""
    w = Window.partitionBy("g", "c").orderBy("d", "t", "s")
    out = rows.withColumn("k", F.rank().over(w))
    if last:
        return out.filter("f = 1 or f = 0 and k > 1").select("d", "t", "s", "w", F.lit(DUP).alias("f"))
    group = Window.partitionBy("g")
    out = out.withColumn("many", F.min("c").over(group) != F.max("c").over(group))
    f = F.when((F.col("f") == DUP) | (F.col("k") > 1), DUP).when((F.col("f") == OPEN) | F.col("many"), OPEN).otherwise(SETTLED)
    return out.select("d", "t", "s", "w", "r", f.alias("f")).filter("f > 0")


def _by_document(runs: DataFrame, *fields: str) -> DataFrame:
    return runs.groupBy(F.col("d").alias("_d"), F.col("t").alias("_t")).agg(F.collect_list(F.struct(*fields)).alias("runs"))


def _apply(length: int):
    def fn(b: pa.RecordBatch):
        buf, off = text_buffer(b.column(2))
        runs = b.column(3)
        lists = runs.to_pylist()
        data = buf.tobytes()
        n_bytes, spans, kept, text = [], [], [], []
        for k, own in enumerate(lists):
            x = data[off[k] : off[k + 1]]
            gone, rest, at = [], [], 0
            for s, e in sorted((r["s"], r["s"] + r["w"] - 1 + length) for r in own or ()):
                if gone and s <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], e)
                else:
                    gone.append([s, e])
            for s, e in gone:
                rest.append(x[at:s])
                at = e
            whole = b"".join([*rest, x[at:]])
            n_bytes.append(len(x))
            spans.append([{"start": s, "length": e - s} for s, e in gone])
            kept.append(whole)
            text.append(whole.decode("utf-8", "ignore"))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.record_batch([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(text, pa.string())], names=["_d", "n_bytes", "spans", "kept", "kept_text"])

    return fn


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """Texts without the bytes that a repeated `length`-byte string covers (`length` from 100 to 160).

    Returns a row for each input row: the id, n_bytes, spans (maximal removed runs as byte start and length in the
    original), kept (the other bytes) and kept_text (kept, without the stray bytes of a character that was cut).
    Null and empty texts have no bytes and keep that; texts shorter than `length` are kept whole. A null id counts as
    the smallest. Rows that repeat id and text are one document (each gets its result, none is a copy of another);
    rows with one id and different texts are separate, ordered by a hash of the text. Other columns are ignored.
    """
    texts = keyed(docs, id_col, text_col)
    final = texts.join(_repeated(texts, length), ["_d", "_t"], "left").select("_d", "_t", "_x", "runs")
    out = map_batches(final, _apply(length), "_d long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary, kept_text string")
    return out.select(id_of().alias(id_col), "n_bytes", "spans", "kept", "kept_text")


def rewritten(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """docs with kept_text of suffix_dedup in the place of each text that is not null; other columns as they were."""
    unique = not repeated_ids(docs, id_col)
    key = keyed(docs, id_col, text_col, unique)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_d"), (F.lit(0).cast("long") if unique else F.xxhash64(text_col)).alias("_t"), F.col(text_col).alias("_x"), F.struct(*docs.columns).alias("_row"))
    rows = rows.withColumn("_row", F.col("_row").dropFields(text_col)) if len(docs.columns) > 1 else rows
    before = staged_so_far()
    gone = staged(_repeated(key, length), "suffix-repeated")
    drop_staged(docs.sparkSession, before, but_last=1)
    final = rows.join(gone, ["_d", "_t"], "left").select("_d", "_t", "_x", "runs", "_row")
    apply, others = _apply(length), [c for c in docs.columns if c != text_col]
    kind = final.schema["_row"].dataType

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        text = apply(b).column(4)
        null = b.column(2).is_null()
        return pa.record_batch([pa.compute.if_else(null, pa.scalar(None, pa.string()), text), b.column(4)], names=["_x", "_row"])

    out = map_batches(final, fn, T.StructType([T.StructField("_x", T.StringType()), T.StructField("_row", kind)]))
    return out.select(*(F.col("_x").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns)) if others else out.select(F.col("_x").alias(text_col))


def _repeated(texts: DataFrame, length: int) -> DataFrame:
    """For each document (_d, _t) with repeated windows its runs of them: first window and count."""
    if not 100 <= length <= 160:
        raise ValueError("length must be from 100 to 160")
    first = staged(_sorted_groups(map_batches(texts.filter(F.octet_length("_x") >= length), _first_digit(length), ROWS), False), "suffix-runs")

    def with_text(runs: DataFrame) -> DataFrame:
        return texts.join(_by_document(runs, "s", "w", "r"), ["_d", "_t"]).select("_d", "_t", "_x", "runs")

    second = _sorted_groups(map_batches(with_text(first.filter(F.col("f") == OPEN)), _second_digit(length), ROWS), False)
    third = _sorted_groups(map_batches(with_text(second.filter(F.col("f") == OPEN)), _third_digit(length), ROWS), True)
    gone = first.filter(F.col("f") == DUP).select("d", "t", "s", "w").unionByName(second.filter(F.col("f") == DUP).select("d", "t", "s", "w")).unionByName(third.select("d", "t", "s", "w"))
    return _by_document(gone, "s", "w")


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of op2."""
    return result.select(id_col, "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
