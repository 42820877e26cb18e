"""Near duplicates: 64-bit SimHash fingerprints and links at 3 differing bits or fewer, found by anchor-point covering.

A fingerprint is cut into two 32-bit halves. Two fingerprints within 3 bits agree in one half up to 1 bit. The
anchors of a half are the words of a covering code: the perfect Hamming code on 31 bits (covering radius 1), times
the last bit as it is. A fingerprint lives at its nearest anchor (within radius 1) and visits every anchor within
the radius plus the threshold of 1, which is 17 per half. So any two linked fingerprints meet at the home of either,
and only those at one anchor are compared.

Equal fingerprints are one before anything is replicated. At an anchor the homes are held in chunks of bounded size;
homes beyond the first chunk, and the visitors for them, go to a second round where each chunk is a group of its own.
Comparing gives at most one link per union of two groups, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_batches, staged
from .components import components

BITS = 3
CHUNK = 4096  # homes compared at once
SEED = 42
SHINGLE = 3

# Hamming code on bits 0..30 of a half: bit i has the syndrome i + 1.
_PARITY = [sum(1 << i for i in range(31) if (i + 1) >> k & 1) for k in range(5)]


def _syndrome(x: np.ndarray) -> np.ndarray:
    s = np.zeros(x.shape, np.uint64)
    for k, mask in enumerate(_PARITY):
        s |= (np.bitwise_count(x & np.uint64(mask)).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
    return s


def _home(half: np.ndarray) -> np.ndarray:
    s = _syndrome(half)
    return half ^ np.where(s > 0, np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1)), np.uint64(0))


def _visits(half: np.ndarray) -> np.ndarray:
    """Every anchor within 2 of each half, one row per fingerprint; where there are fewer, the home repeats."""
    home, s = _home(half), _syndrome(half)
    out = [home, home ^ np.uint64(1 << 31)]
    # half plus two bits i < j of the code with syndromes that cancel s; from a code word (s = 0) there are none
    for i in range(1, 32):
        j = s ^ np.uint64(i)
        ok = (s > 0) & (j > np.uint64(i))
        flip = np.where(ok, (np.uint64(1) << np.uint64(i - 1)) | (np.uint64(1) << (np.maximum(j, np.uint64(1)) - np.uint64(1))), np.uint64(0))
        out.append(np.where(ok, half ^ flip, home))
    return np.stack(out, axis=1)


PIECE = 1 << 16  # shingles looked at together


def majority(pieces: Iterator[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes of all pieces; 0 of none."""
    ones, n = np.zeros(64, np.int64), 0
    for h in pieces:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist()))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles' XXH64; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    pieces = ((at, min(n - at, PIECE)) for at in range(0, n, PIECE))
    return majority(np.fromiter((digest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, at + m)), np.uint64, m) for at, m in pieces)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The id and f, its text's fingerprint as a signed long, for each row; null texts have no words."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        f = np.array([fingerprint(x, shingle) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.record_batch([b.column(0), pa.array(f, pa.int64())], names=["_d", "f"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("_d"), F.col(text_col).cast("string").alias("_x")), fn, "_d long, f long")


def _replicate(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows at anchors: key (half and anchor), chunk 0, role 0 (home) or 1 (visitor), fingerprint."""
    for at in range(0, b.num_rows, 20_000):
        f = b.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False).view(np.uint64)
        key, role, own = [], [], []
        for k in (0, 1):
            half, tag = (f >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF), np.uint64(k << 32)
            home, visits = _home(half) | tag, np.sort(_visits(half), axis=1)
            new = np.concatenate([np.ones((len(f), 1), bool), visits[:, 1:] != visits[:, :-1]], axis=1)
            new &= (visits | tag) != home[:, None]  # at home it is already
            key += [home, (visits | tag)[new]]
            role += [np.zeros(len(f), np.int32), np.ones(int(new.sum()), np.int32)]
            own += [f, np.repeat(f, new.sum(axis=1))]
        key, own = np.concatenate(key).view(np.int64), np.concatenate(own).view(np.int64)
        yield pa.record_batch([key, np.zeros(len(key), np.int32), np.concatenate(role), own], names=["a", "chunk", "role", "f"])


class _Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def add(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _comparer(size: int):
    """Of rows sorted by anchor, chunk and role: links (kind 0: u, v), and rows for the next round (kind 1: u anchor, v fingerprint)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, homes, extra, union = None, np.zeros(0, np.uint64), 0, _Union()
        for b in batches:
            a, chunk, role, f = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            group = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (chunk[1:] != chunk[:-1]), [True]]))
            use = (role[group[:-1]] == 0) & (np.diff(group) > 1)
            use[:1] = use[-1:] = True  # these may go on in another batch
            out: list[tuple] = []
            for p, q in zip(group[:-1][use].tolist(), group[1:][use].tolist(), strict=True):
                if now != (key := (int(a[p]), int(chunk[p]))):
                    now, homes, extra, union = key, np.zeros(0, np.uint64), 0, _Union()
                cut = p + int(np.count_nonzero(role[p:q] == 0))
                new, more = f[p:cut].view(np.uint64), f[cut:q].view(np.uint64)
                room = size - len(homes)
                _link(new[:room], homes, union, out)
                _link(new[:room], new[:room], union, out)
                homes = np.concatenate([homes, new[:room]])
                # each later chunk of homes is a group of its own; its homes visit the chunks before it
                for x in new[room:].view(np.int64).tolist():
                    c = 1 + extra // size
                    out += [(1, key[0], x, c, 0)] + [(1, key[0], x, e, 1) for e in range(1, c)]
                    extra += 1
                for x in more.view(np.int64).tolist() if extra else ():
                    out += [(1, key[0], x, e, 1) for e in range(1, 2 + (extra - 1) // size)]
                _link(new[room:], homes, union, out)
                _link(more, homes, union, out)
            if out:
                kind, u, v, c, r = zip(*out, strict=True)
                yield pa.record_batch([pa.array(kind, pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(c, pa.int32()), pa.array(r, pa.int32())], names=["kind", "u", "v", "chunk", "role"])
        give_back()

    return compare


def _link(new: np.ndarray, homes: np.ndarray, union: _Union, out: list) -> None:
    if not len(homes):
        return
    for at in range(0, len(new), 512):
        part = new[at : at + 512]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ homes[None, :]) <= BITS)
        for x, y in zip(part[i].view(np.int64).tolist(), homes[j].view(np.int64).tolist(), strict=True):
            if x != y and union.add(x, y):
                out.append((0, x, y, 0, 0))


LINKS = "kind int, u long, v long, chunk int, role int"


def _meet(rows: DataFrame, size: int) -> DataFrame:
    return rows.repartition(F.col("a"), F.col("chunk")).sortWithinPartitions("a", "chunk", "role", "f").mapInArrow(_comparer(size), LINKS)


def links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """distinct: column f without repeats. Links u, v that connect exactly the fingerprints that 3 differing bits or fewer connect."""
    first = staged(_meet(map_batches(distinct.select("f"), _replicate, "a long, chunk int, role int, f long"), chunk), "simhash-links")
    found = first.filter("kind = 0").select("u", "v")
    rest = first.filter("kind = 1").select(F.col("u").alias("a"), "chunk", "role", F.col("v").alias("f"))
    if rest.limit(1).count():
        found = found.union(staged(_meet(rest, chunk), "simhash-links").filter("kind = 0").select("u", "v"))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """For each row its id, fingerprint (16 hex digits) and component_id, the smallest id its fingerprint reaches over links.

    Null and empty texts have the fingerprint zero and link like any other. Null ids take part but are never the
    smallest; a group with null ids alone has a null component_id. Repeated rows are each returned. An empty table
    gives an empty result. Other columns are ignored.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = prints.groupBy("f").agg(F.min("_d").alias("least"))
    roots = components(links(distinct))
    named = distinct.join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = named.select("f", "root").join(least, "root").select("f", "component_id")
    return prints.join(of_print, "f").select(F.col("_d").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
