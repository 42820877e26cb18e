"""Near copies for the corpus pipeline: SimHash with an exact check, links at a Jaccard similarity of 0.8 or more of the
sets of five-word shingles.

Candidates come from the SimHash operator first: fingerprints of the five-word shingles, linked by anchor-point covering
(see simhash). But 64 bits within three cannot find all of 0.8: at that similarity fingerprints differ in about ten bits,
and anchors within ten bits are nearly all anchors. So further candidates come from prefixes. Under one order of all
shingles, two sets of similarity 4/5 or more share one of their first n - ceil(4 n / 5) + 1 shingles (n in the set), so
only those are shuffled. The order puts shingles that are common in a sample last, and the rest by hash, so that similar
texts meet at shingles that few others have. Sets that meet at a shingle are not all paired with each other. First each
is compared with its neighbours in three orders (by size, and by either half of the fingerprint), and the nearest ones
become candidates: that joins nearly all groups with a bounded number of candidates a row. Then every pair that meets
there and is not yet in one component passes an exact bound: the parities of how many shingles fall in each of 512 classes
differ in at most as many places as the sets differ, and sets of similarity 4/5 differ in at most a ninth of both sizes.
Of large sets, 512 parities say little, so these are cut by the leading bits of the hashes: if two sets differ in at most a ninth
of both sizes, so they do in one of the pieces at least (else the sums would not). So pieces have prefixes and parities of
their own, and sets are compared by pieces wherever they are cut into equally many. What a set is cut into depends on its
size; one that a similar set of the next step may exceed is cut both ways. Pairs share many shingles of their prefixes, so
each row carries the first of its own, and a pair that shares one of those is a row at the first shared one only.
Before any text moves, all pairs pass the same bound on parities of as many classes as the sets have shingles, which 512
say little about when sets are large. Pairs within it are checked by their texts, first one for each two components. So
no link between components is lost, and no link is wrong.

Equal sets are one before anything is replicated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bounded_sample, drop_staged, give_back, map_batches, slices, staged, staged_so_far, text_buffer
from .components import components

SHINGLE = 5
NUM, DEN = 4, 5  # the least similarity, 4/5
SAMPLE = 20_000  # texts in which common shingles are counted
COMMON = 100_000  # common shingles at most
LEAST_COMMON = 3  # texts of the sample
SEED = 42
NEAR = 8  # neighbours that a set is compared with, in each order
FAR_BITS = 20  # differing bits beyond which sets of SURE shingles or more are not similar (at 0.8 about 10 are expected)
SURE = 64
CLASSES = 512  # of shingles, by hash, for the bound on how much two sets or pieces differ
WHOLE, SPLIT = 512, 4  # sets of up to WHOLE shingles are one piece, of up to SPLIT times as many SPLIT pieces, and so on; SPLIT is a power of two
PART = 4 << 20  # bytes of texts looked at together
LEAD = 4  # first shingles of a prefix that are known at each of its shingles
CELL = 2048  # sets of a shingle that are compared in one group; of more, each pair of parts is a group


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The set of hashes of the word shingles, ascending; a text of fewer words is one shingle, one without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n))


def cuts(n: int) -> list[int]:
    """Into how many pieces a set of n shingles is cut, in one or two ways; similar sets have one of them in common."""

    def number(m: int) -> int:
        k = 1
        while m > WHOLE * k:
            k *= SPLIT
        return k

    return sorted({number(n), number(DEN * n // NUM)})


def pieces(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The pieces of an ascending set, for each way that it is cut, with their numbers (from k on of k pieces); not empty ones."""
    for k in cuts(len(x)):
        ends = [*np.searchsorted(x, (np.arange(1, k, dtype=np.uint64) << np.uint64(65 - k.bit_length()))).tolist(), len(x)]
        for i, (p, q) in enumerate(zip([0, *ends], ends)):  # noqa: B905  one more start than ends
            if q > p:
                yield k + i, x[p:q]


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * both >= NUM * (len(x) + len(y) - both)


def parities(x: np.ndarray, classes: int = CLASSES) -> bytes:
    """For each class of shingles whether the set has an odd number of them. Those of two sets differ in at most as many classes as there are shingles in one set only."""
    return np.packbits(np.bincount(x % np.uint64(classes), minlength=classes).astype(np.uint8) & 1).tobytes()


def wide_parities(x: np.ndarray) -> bytes:
    """Parities of as many classes as x has shingles, rounded up to a power of two; at least CLASSES."""
    return parities(x, max(CLASSES, 1 << (len(x) - 1).bit_length()))


def differing(x: bytes, y: bytes) -> int:
    """In how many classes parities differ; those of more classes are folded to the other's number."""
    p, q = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(p ^ np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0)).sum(dtype=np.int64))


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample, ascending, and how common they are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([h[n > 1].view(np.int64), n[n > 1].astype(np.int64)], names=["h", "n"])

        held, size = [], 0
        for b in batches:
            for x in b.column(0):
                held.append(shingles(x.as_py()))
                size += len(held[-1])
                if size > 1 << 21:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)
        give_back()

    found = bounded_sample(texts, "_d", SAMPLE).select("_x").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = found.filter(F.col("n") >= LEAST_COMMON).orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h, n = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    return h[np.argsort(h)], n[np.argsort(h)]


def _prefixes(h: np.ndarray, n: np.ndarray):
    def prefix(x: np.ndarray) -> np.ndarray:
        take = len(x) - -(-NUM * len(x) // DEN) + 1 if len(x) else 0
        if not len(h):
            return x[:take]
        at = np.minimum(np.searchsorted(h, x), len(h) - 1)
        return x[np.argsort(np.where(h[at] == x, n[at], 0), kind="stable")][:take]

    def sets(b: pa.RecordBatch) -> pa.RecordBatch:
        g, size, f, wide, first, of, odd, lead, some, upto = [], [], [], [], [], [], [], [], [], [0]
        for x in b.column(1).to_pylist():
            own = shingles(x)
            g.append(xxhash.xxh3_64_intdigest(own.tobytes()))
            f.append(simhash.majority(own[at : at + simhash.PIECE] for at in range(0, len(own), simhash.PIECE)))
            size.append(len(own))
            wide.append(wide_parities(own))
            for piece, y in pieces(own):
                k = np.uint64(1 << piece.bit_length() >> 1)  # of how many; pieces of equally many meet
                first.append((prefix(y) ^ k).view(np.int64))
                lead.append(np.pad(first[-1][:LEAD], (0, max(0, LEAD - len(first[-1]))), constant_values=np.uint64(g[-1]).view(np.int64)).tobytes())  # g is nobody else's
                of.append(piece)
                odd.append(parities(y))
                some.append(len(y))
            upto.append(len(of))
        ends = pa.array(upto, pa.int32())
        off = np.concatenate([[0], np.cumsum([len(p) for p in first])]).astype(np.int32)
        flat = np.concatenate(first) if first else np.zeros(0, np.int64)
        cut = pa.StructArray.from_arrays([pa.array(of, pa.int64()), pa.array(some, pa.int64()), pa.array(odd, pa.binary()), pa.array(lead, pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=["piece", "m", "odd", "lead", "first"])
        return pa.record_batch([b.column(0), pa.array(np.array(g, np.uint64).view(np.int64)), pa.array(np.array(f, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(wide, pa.binary()), pa.ListArray.from_arrays(ends, cut), b.column(1)], names=["_d", "g", "f", "n", "wide", "pieces", "_x"])

    def fn(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for p, q in slices(np.diff(text_buffer(b.column(1))[1]), PART):
            yield sets(b.slice(p, q - p))

    return fn


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, g, n, f, piece in order of a, n, g: for each row the nearest of its neighbours at shingle a (of small sets all of
    them), in each of three orders, as u, v; and as u, a, piece every row that shares its shingle with another."""
    tail: list[np.ndarray] | None = None

    def met(cols, first: int, end: int) -> pa.RecordBatch:
        a, g, _, _, piece = cols
        same = np.concatenate([[False], a[1:] == a[:-1], [False]])
        at = first + np.flatnonzero(same[first:end] | same[first + 1 : end + 1])
        return pa.record_batch([pa.array(g[at]), pa.nulls(len(at), pa.int64()), pa.array(a[at]), pa.array(piece[at])], names=["u", "v", "a", "piece"])

    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        old = len(tail[0]) if tail else 0
        a, g, n, f, _ = cols = [np.concatenate(c) for c in zip(tail, cols, strict=True)] if tail else cols
        bits = f.view(np.uint64)
        us, vs = [], []
        for order in (np.arange(len(a)), np.lexsort((bits, a)), np.lexsort((bits << np.uint64(32) | bits >> np.uint64(32), a))):
            best, other = np.full(len(a), 99, np.int64), np.zeros(len(a), np.int64)
            for s in range(1, min(NEAR, len(a) - 1) + 1):
                x, y = order[s:], order[:-s]
                ok = (a[x] == a[y]) & (g[x] != g[y]) & ((x >= old) | (y >= old))
                if not ok.any():
                    break
                x, y = x[ok], y[ok]
                less, more = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                d = np.bitwise_count(bits[x] ^ bits[y]).astype(np.int64)
                alike = DEN * less >= NUM * more
                few = alike & (less < SURE)  # too few shingles for the bits to say much: every neighbour
                us.append(np.maximum(g[x[few]], g[y[few]]))
                vs.append(np.minimum(g[x[few]], g[y[few]]))
                d = np.where(alike & ~few & (d <= FAR_BITS), d, 99)
                closer = d < best[x]
                best[x[closer]], other[x[closer]] = d[closer], y[closer]
            own = np.flatnonzero(best < 99)
            us.append(np.maximum(g[own], g[other[own]]))
            vs.append(np.minimum(g[own], g[other[own]]))
        u, v = np.concatenate(us), np.concatenate(vs)
        if len(u):
            yield pa.record_batch([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int64())], names=["u", "v", "a", "piece"])
        yield met(cols, max(0, old - 1), len(a) - 1)  # the last row's successor is not known yet
        tail = [c[-NEAR:] for c in cols]
    if tail and len(tail[0]):
        yield met(tail, len(tail[0]) - 1, len(tail[0]))
    give_back()


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, cell, n, g, part, whole, root, odd, lead in order of a, cell, n (n: shingles of the piece): the pairs of a group
    (a, cell) with two roots (and, unless whole, of two parts) that the sizes and parities of their pieces allow to be similar.
    Pairs that share a leading shingle of their prefixes are left to the group of the first such."""
    tail = None

    def words(col: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(len(col), -1)

    for b in batches:
        if not b.num_rows:
            continue
        cols = [*(b.column(i).to_numpy(zero_copy_only=False) for i in range(7)), words(b.column(7)), words(b.column(8))]
        old = len(tail[0]) if tail else 0
        a, cell, n, g, part, whole, root, odd, lead = cols = [np.concatenate(c) for c in zip(tail, cols, strict=True)] if tail else cols
        us, vs, held = [], [], 0
        live, s = np.arange(old, len(a)), 1
        while len(live := live[live >= s]):
            x, y = live, live - s
            live = live[(a[x] == a[y]) & (cell[x] == cell[y]) & (DEN * n[y] >= NUM * n[x])]  # n ascends: further ones fail too
            x, y = live, live - s
            ok = (root[x] != root[y]) & (whole[x] | (part[x] != part[y]))
            x, y = x[ok], y[ok]
            for at in range(0, len(x), 1 << 16):
                i, j = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                near = (NUM + DEN) * np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64) <= n[i] + n[j]
                i, j = i[near], j[near]
                shared = (lead[i][:, :, None] == lead[j][:, None, :]).any(2)
                first = np.where(shared.any(1), lead[i, np.argmax(shared, axis=1)], a[i].view(np.uint64))
                here = first == a[i].view(np.uint64)
                i, j = i[here], j[here]
                us.append(np.maximum(g[i], g[j]))
                vs.append(np.minimum(g[i], g[j]))
                held += len(i)
            if held > 1 << 18:
                yield pa.record_batch([np.concatenate(us), np.concatenate(vs)], names=["u", "v"])
                us, vs, held = [], [], 0
            s += 1
        if held:
            yield pa.record_batch([np.concatenate(us), np.concatenate(vs)], names=["u", "v"])
        if len(a):
            start = len(a) - int(np.argmin(((a == a[-1]) & (cell == cell[-1]))[::-1])) if not ((a == a[-1]) & (cell == cell[-1])).all() else 0
            tail = [c[start:] for c in cols]
    give_back()


def _prints(texts: DataFrame) -> DataFrame:
    """For each row of _d, _x its set's digest g, fingerprint f, size n, parities of many classes, and pieces with their sizes, parities of few, and prefixes, once more the first of each."""
    return staged(map_batches(texts, _prefixes(*_common(texts)), "_d long, g long, f long, n long, wide binary, pieces array<struct<piece:long,m:long,odd:binary,lead:binary,first:array<long>>>, _x string"), "copies")


def _meetings(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows g, a, piece of sets that share a shingle a of their pieces' prefixes with another; and near neighbours at one, as u, v, shared."""
    sets = prints.select("g", "n", "f", F.expr("transform(pieces, x -> struct(x.piece, x.first))").alias("own")).dropDuplicates(["g"])
    rows = sets.select("g", "n", "f", F.inline("own")).select(F.explode("first").alias("a"), "g", "n", "f", "piece")
    found = staged(rows.repartition("a").sortWithinPartitions("a", "n", "g").mapInArrow(_neighbours, "u long, v long, a long, piece long"), "copies-met")
    near = found.filter("v is not null").groupBy("u", "v").agg(F.count("*").alias("shared"))
    return found.filter("v is null").select(F.col("u").alias("g"), "a", "piece"), staged(near, "copies-candidates")


def _still_apart(met: DataFrame, prints: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct pairs of sets that meet at a shingle of a piece's prefixes, are in different components and may be similar."""
    of = prints.select("g").distinct().join(roots.withColumnRenamed("node", "g"), "g", "left").withColumn("root", F.coalesce("root", "g"))
    cut = prints.select("g", F.expr("transform(pieces, x -> struct(x.piece, x.m, x.odd, x.lead))").alias("own")).dropDuplicates(["g"]).select("g", F.inline("own"))
    rooted = met.join(of, "g").repartition("a")
    mixed = rooted.groupBy("a").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count("*").alias("m")).filter("r <> s")
    parts = mixed.select("a", F.ceil(F.col("m") / CELL).cast("int").alias("parts"))
    rows = rooted.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("g"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.least("part", "other").cast("long") * F.col("parts") + F.greatest("part", "other")
    whole = cell % (F.col("parts") + 1) == 0  # both parts are one: cell is part * (parts + 1)
    rows = rows.withColumn("cell", cell).withColumn("whole", whole).join(cut, ["g", "piece"]).select("a", "cell", F.col("m").alias("n"), "g", "part", "whole", "root", "odd", "lead")
    return rows.repartition("a", "cell").sortWithinPartitions("a", "cell", "n").mapInArrow(_apart, "u long, v long").distinct()


def _possible(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Of distinct pairs u, v the ones that sizes and wide parities allow to be similar, and shared, which is larger the less they differ."""
    before = staged_so_far()
    pairs = staged(pairs.select("u", "v"), "copies-pairs")
    ends = pairs.select(F.col("u").alias("g")).union(pairs.select("v")).distinct()
    sets = staged(prints.select("g", "n", "wide").join(ends, "g", "left_semi").dropDuplicates(["g"]), "copies-wide")

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        d = np.fromiter((differing(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True)), np.int64, b.num_rows)
        m, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
        near = pa.array(((NUM + DEN) * d <= m + n) & (DEN * np.minimum(m, n) >= NUM * np.maximum(m, n)))
        return pa.record_batch([b.column(0).filter(near), b.column(1).filter(near), pa.array(-d).filter(near)], names=["u", "v", "shared"])

    both = pairs.join(sets.toDF("v", "m", "_p"), "v").join(sets.toDF("u", "n", "_q"), "u").select("u", "v", "m", "_p", "n", "_q")
    found = staged(map_batches(both, fn, "u long, v long, shared long"), "copies-possible")
    drop_staged(found.sparkSession, before, but_last=1)
    return found


def _verified(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Of distinct pairs u, v that may be similar the ones that are."""
    before = staged_so_far()
    pairs = staged(pairs, "copies-pairs")
    ends = pairs.select(F.col("u").alias("g")).union(pairs.select("v")).distinct()
    texts = staged(prints.select("g", "_x").join(ends, "g", "left_semi").dropDuplicates(["g"]), "copies-texts")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None  # pairs come in runs of one u
        for b in batches:
            ok = []
            for u, x, y in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if u != last:
                    last, mine = u, shingles(x.as_py())
                ok.append(similar(mine, shingles(y.as_py())))
            yield b.filter(pa.array(ok, pa.bool_())).select(["u", "v"])
        give_back()

    both = pairs.join(texts.toDF("v", "_y"), "v").join(texts.toDF("u", "_x"), "u").select("u", "v", "_x", "_y")
    links = staged(both.mapInArrow(fn, "u long, v long"), "copies-links")
    drop_staged(links.sparkSession, before, but_last=1)
    return links


def _by_fingerprint(prints: DataFrame) -> DataFrame:
    """Pairs of sets with one fingerprint, or with fingerprints that the operator links; one set stands for each fingerprint."""
    sets = prints.select("g", "f").dropDuplicates(["g"])
    one = staged(sets.groupBy("f").agg(F.min("g").alias("one")), "copies-prints")
    equal = sets.join(one, "f").filter("g <> one").select(F.col("g").alias("u"), F.col("one").alias("v"))
    near = simhash.links(one).join(one.toDF("u", "p"), "u").join(one.toDF("v", "q"), "v").select(F.col("p").alias("u"), F.col("q").alias("v"))
    return equal.union(near)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id and component_id, the smallest id that its text reaches over links.

    Texts without words are equal to each other. Null ids take part but are never the smallest; a group with null ids
    alone has a null component_id. Repeated rows are each returned. An empty table gives an empty result.
    """
    prints = _prints(docs.select(F.col(id_col).cast("long").alias("_d"), F.col(text_col).cast("string").alias("_x")))
    met, candidates = _meetings(prints)
    links = _verified(_possible(_by_fingerprint(prints), prints).select("u", "v"), prints)
    roots = components(links)
    for step in ("best", "all", "first", "rest"):  # the best candidate of each set, all whose ends are still apart; of all pairs that are, the best of each two components, all
        if step == "first":
            candidates = _possible(_still_apart(met, prints, roots), prints)
        of_u, of_v = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "uv")
        apart = candidates.join(of_u, "u", "left").join(of_v, "v", "left").withColumns({"p": F.coalesce("root_u", "u"), "q": F.coalesce("root_v", "v")}).filter("p <> q")
        if step == "best":
            apart = apart.groupBy("u").agg(F.max_by("v", F.struct("shared", "v")).alias("v"))
        elif step == "first":
            apart = apart.groupBy(F.least("p", "q"), F.greatest("p", "q")).agg(F.max_by(F.struct("u", "v"), F.struct("shared", "u", "v")).alias("_b")).select("_b.*")
        apart = (_possible(apart, prints) if step in ("best", "all") else apart).select("u", "v")
        more = _verified(apart, prints)
        if more.limit(1).count():
            links = links.union(more)
            roots = components(links)
    least = prints.groupBy("g").agg(F.min("_d").alias("least")).join(roots.withColumnRenamed("node", "g"), "g", "left").withColumn("root", F.coalesce("root", "g"))
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = least.select("g", "root").join(of_root, "root").select("g", "component_id")
    return prints.select("_d", "g").join(of_set, "g").select(F.col("_d").alias(id_col), "component_id")
