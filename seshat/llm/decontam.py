"""Benchmark decontamination by the q-gram lemma.

Texts are brought to lower-case words with single spaces. If a benchmark item of m bytes occurs in a text with at most
e edits, the two share at least m + 1 - q - q*e of the item's q-byte strings, on diagonals (place in the text less
place in the item) that differ by at most e. So shared q-grams are counted in overlapping diagonal bands, bands that
reach the bound are kept, and each is verified by a banded alignment with free ends in the text. The filter loses
nothing: e is RATE of the item's bytes, rounded down, and q is 16, or 8 for items of fewer than LONG bytes, so that the
bound is 1 at least. Items of fewer than SHORT bytes have no edits to spend and match as whole words.

The benchmark is the stated query set: its texts go to the workers in blocks of about BLOCK bytes, one pass over the
documents each, and a worker builds the index of the block it works on (about 25 times the block's bytes) and keeps only
that one. The driver holds the benchmark's texts, never an index.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import C1, U, join, mix
from .common import drop_staged, map_batches, slices, staged, staged_so_far

RATE = 0.05
LONG = 80  # bytes from which q is 16: 16 * (m / 20 + 1) <= m
SHORT = 20  # bytes from which RATE allows an edit
BLOCK = 8 << 20  # bytes of benchmark text per pass (or one longer item)
PART = 1 << 20  # bytes of texts looked at together
HITS = 1 << 21  # shared q-grams counted at once
_SPACED = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "ignore").translate(_SPACED).split())


def _grams(buf: np.ndarray, q: int) -> np.ndarray:
    """A hash of every q-byte string, q 8 or 16."""
    n = len(buf) - 7
    if n < q - 7:
        return np.zeros(0, np.uint64)
    g = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        own = buf[r : r + (len(buf) - r) // 8 * 8].view("<u8")
        g[r::8] = own
    return mix(join(g[:-8], g[8:]) if q == 16 else g * C1)


def budget(m: int) -> int:
    """Edits allowed for an item of m bytes."""
    return int(RATE * m)


class _Table:
    """The q-grams of the items `which` of texts: distinct hashes in order, the items and places of each, and a bit map of the hashes."""

    def __init__(self, q: int, texts: list[bytes], which: list[int]):
        self.q = q
        grams = [_grams(np.frombuffer(texts[k], np.uint8), q) for k in which]
        count = np.array([len(g) for g in grams], np.int64)
        g = np.concatenate([np.zeros(0, np.uint64), *grams])
        order = np.argsort(g, kind="stable").astype(np.int32)
        self.item = np.repeat(np.array(which, np.int32), count)[order]
        self.pos = (np.arange(len(g)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)[order]
        self.grams, first = np.unique(g[order], return_index=True)
        self.first = np.append(first, len(g)).astype(np.int32)
        bits = max(16, int(np.ceil(np.log2(len(g) + 1))) + 5)
        self.shift = U(64 - bits)
        self.seen = np.zeros(1 << (bits - 3), np.uint8)
        slot = (self.grams * C1) >> self.shift
        np.bitwise_or.at(self.seen, slot >> U(3), (U(1) << (slot & U(7))).astype(np.uint8))

    def hits(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in buf whose q-gram some item has, and its number."""
        g = _grams(buf, self.q)
        if not len(g) or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = (g * C1) >> self.shift
        at = np.flatnonzero((self.seen[slot >> U(3)] >> (slot & U(7)).astype(np.uint8)) & 1)
        k = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        same = self.grams[k] == g[at]
        return at[same], k[same]


class Index:
    """The q-grams of some benchmark items, (item id, normalised text) each; items without a word are left out."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, t in items if t]
        self.texts = [t for _, t in items if t]
        size = np.array([len(t) for t in self.texts], np.int64)
        q = np.where(size < LONG, 8, 16)
        self.e = np.array([budget(int(m)) for m in size], np.int64)
        self.need = size + 1 - q - q * self.e
        self.words = [k for k, m in enumerate(size) if m < 8]
        tables = [_Table(x, self.texts, np.flatnonzero((q == x) & (size >= 8)).tolist()) for x in (8, 16)]
        self.tables = [t for t in tables if len(t.grams)]

    def bands(self, buf: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Text, item, first and last diagonal of each band of the texts at `start` in buf that reaches the item's bound."""
        for table in self.tables:
            yield from self._bands(table, buf, start)

    def _bands(self, table: _Table, buf: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        at, k = table.hits(buf)
        if not len(at):
            return
        of, many, found = np.searchsorted(start, at, "right") - 1, table.first[k + 1] - table.first[k], []
        for p, q in slices(many, HITS):
            n = many[p:q].astype(np.int64)
            place = np.repeat(table.first[k[p:q]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            text = np.repeat(of[p:q], n)
            diagonal = np.repeat(at[p:q] - start[of[p:q]], n) - table.pos[place]
            item = table.item[place].astype(np.int64)
            # a band of width e + 1 begins at each multiple of it and reaches e further, into the next
            width = self.e[item] + 1
            band, over = np.divmod(diagonal, width)
            again = over < self.e[item]
            item, text, band = (np.concatenate([x, x[again]]) for x in (item, text, band))
            band[len(diagonal) :] -= 1
            key = mix(join(join(text.astype(np.uint64), item.astype(np.uint64)), (band + (1 << 40)).astype(np.uint64)))
            key, one, count = np.unique(key, return_index=True, return_counts=True)
            found.append((key, text[one], item[one], band[one], count))
        key, text, item, band, count = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(found) > 1:
            _, one, group = np.unique(key, return_index=True, return_inverse=True)
            count = np.bincount(group, count).astype(np.int64)
            text, item, band = text[one], item[one], band[one]
        for i in np.flatnonzero(count >= self.need[item]).tolist():
            e = int(self.e[item[i]])
            low = int(band[i]) * (e + 1)
            yield int(text[i]), int(item[i]), low, low + 2 * e

    def matches(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each normalised text: item id, start and end in it, edits; one per item and place."""
        out = [[] for _ in texts]
        sizes = np.array([len(t) + 1 for t in texts])
        for p, q in slices(sizes, PART):
            joined = b"\0".join(texts[p:q])
            start = np.concatenate([[0], np.cumsum(sizes[p:q])[:-1]])
            tried: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for t, k, low, high in self.bands(np.frombuffer(joined, np.uint8), start):
                tried.setdefault((t, k), []).append((low, high))
            for (t, k), own in tried.items():
                out[p + t] += self._verify(texts[p + t], k, own)
            for k in self.words:
                for t in range(p, q):
                    out[t] += self._whole(texts[t], k, 0, len(texts[t]))
        return [sorted(set(x), key=lambda m: (m[1], m[2], str(m[0]))) for x in out]

    def _whole(self, text: bytes, k: int, low: int, high: int) -> list[tuple[int, int, int, int]]:
        """Occurrences of the item as whole words that start from low to high."""
        item, found = self.texts[k], []
        at = text.find(item, max(0, low), max(0, high + len(item)))
        while at >= 0:
            z = at + len(item)
            if (at == 0 or text[at - 1] == 32) and (z == len(text) or text[z] == 32):
                found.append((self.ids[k], at, z, 0))
            at = text.find(item, at + 1, max(0, high + len(item)))
        return found

    def _verify(self, text: bytes, k: int, bands: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        item, found = self.texts[k], []
        if len(item) < SHORT:
            return [x for low, high in bands for x in self._whole(text, k, low, high)]
        for low, high in sorted(bands):
            at = text.find(item, max(0, low), max(0, high + len(item)))
            got = (at, at + len(item), 0) if at >= 0 else align(item, text, low, high, int(self.e[k]))
            if got and not any(got[0] < b and a < got[1] for _, a, b, _ in found):
                found.append((self.ids[k], *got))
        return found


def align(item: bytes, text: bytes, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Start, end and edits of the best occurrence of item in text on diagonals low - most to high + most, if within `most` edits."""
    lo, hi = low - most, high + most
    p, w = np.frombuffer(item, np.uint8), hi - lo + 1
    padded = np.zeros(len(item) + w + 1, np.int16) - 1
    a, z = max(lo, 0), min(len(text), lo + len(padded))
    if z > a:
        padded[a - lo : z - lo] = np.frombuffer(text, np.uint8)[a:z]
    k, far = np.arange(w), 1 << 20
    row = np.where((k + lo >= 0) & (k + lo <= len(text)), 0, far).astype(np.int64)
    origin = k + lo
    for i in range(len(p)):
        t = padded[i : i + w]
        step = row + (p[i] != t) + np.where(t < 0, far, 0)
        drop = np.append(row[1:], far) + 1
        source = np.where(step <= drop, origin, np.append(origin[1:], 0))
        x = np.minimum(step, drop)
        y = x - k
        best = np.minimum.accumulate(y)
        row = best + k
        if row.min() > most:
            return None
        origin = source[np.maximum.accumulate(np.where(y == best, k, 0))]
        j = k + lo + i + 1
        row[(j < 0) | (j > len(text))] = far
    b = int(np.argmin(row))
    return (int(origin[b]), b + lo + len(p), int(row[b])) if row[b] <= most else None


_built: dict[str, Index] = {}


def _index(name: str, items: list[tuple[int, bytes]]) -> Index:
    """A block's index, built once in a worker; only the last one is kept."""
    if name not in _built:
        _built.clear()
        _built[name] = Index(items)
    return _built[name]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[str, list[tuple[int, bytes]]]]:
    """Name and items of each block."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("x")).filter("x is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    n = max(1, -(-size // BLOCK))
    for k in range(n):
        own = rows.filter(F.pmod(F.xxhash64("i", "x"), F.lit(n)) == k).collect()  # about BLOCK bytes
        yield uuid.uuid4().hex, [(r.i, normal(r.x)) for r in own]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each occurrence of a benchmark item in a text: the document's id, the item's id, start and end (characters
    of the lower-cased text), edits. Texts without one have no row.

    Null and empty texts and items match nothing; items of fewer than SHORT bytes match as whole words without edits;
    very long texts and items are looked at whole. Rows with null or repeated ids are looked at like others; other
    columns are ignored; equal benchmark rows count once.
    """
    rows, out = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("x")), None
    for name, items in _blocks(benchmark, item_col, item_text):

        def fn(b: pa.RecordBatch, name=name, items=items) -> pa.RecordBatch:
            texts = b.column(1).to_pylist()
            found = []
            for d, x, own in zip(b.column(0).to_pylist(), texts, _index(name, items).matches([normal(x) for x in texts]), strict=True):
                if own:
                    low, norm = x.lower(), normal(x)
                    words = [m.span() for m in _WORD.finditer(low)]
                    found += [(d, i, words[norm.count(b" ", 0, s)][0], words[norm.count(b" ", 0, max(s, e - 1))][1], edits) for i, s, e, edits in own]
            cols = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["d", "i", "start", "end", "edits"])

        part = map_batches(rows, fn, "d long, i long, start long, end long, edits int")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("d").alias(id_col), F.col("i").alias(item_col), "start", "end", "edits")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text holds a benchmark item, all columns as they were; see find_leaks.

    With several blocks what one leaves is written and read again, so that a worker holds one index."""
    at, before, first = docs.columns.index(text_col), staged_so_far(), True
    for name, items in _blocks(benchmark, item_col, item_text):
        if not first:
            docs = staged(docs, "clean")
            drop_staged(docs.sparkSession, before, but_last=1)
        first = False

        def fn(b: pa.RecordBatch, name=name, items=items) -> pa.RecordBatch:
            clean = [not own for own in _index(name, items).matches([normal(x) for x in b.column(at).to_pylist()])]
            return b.filter(pa.array(clean, pa.bool_()))

        docs = map_batches(docs, fn, docs.schema)
    return docs
