import random
import tempfile
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import seshat.llm.near_copies as m
from seshat.llm.common import CLEANUP, staged

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"


def slow_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_groups(rows):
    """rows: (id, text), ids distinct -> id: the smallest id that links of Jaccard 0.8 or more reach."""
    ids, sets = [i for i, _ in rows], {i: slow_set(x) for i, x in rows}
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("seed", [7, 8])
def test_matches_brute_force(spark, seed):
    r = random.Random(seed)
    rows, common = [], " ".join(f"foot{i}" for i in range(12))
    for i in range(60):
        w = [f"w{r.randrange(400)}" for _ in range(r.choice([0, 1, 3, 5, 6, 20, 60, 150]))]
        for k in range(r.choice([1, 2, 8])):  # edits that leave similarities on both sides of 0.8
            rows.append((i * 10 + k, " ".join(w) + (" " + common if i % 2 else "")))
            for _ in range(r.randrange(4)):
                if w:
                    w[r.randrange(len(w))] = f"x{r.randrange(400)}"
            w += ["more"] * (k % 2)
    rows.append((5000, None))
    want = slow_groups(rows)
    assert len(set(want.values())) < 0.9 * len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id: x.component_id for x in m.near_copies(df).collect()} == want


def test_last_pass_alone_loses_no_link(spark, monkeypatch):
    """Without any link known before, and with small groups: every similar pair of different sets is among the pairs."""
    monkeypatch.setattr(m, "CELL", 5)
    r, rows = random.Random(3), []
    for i in range(12):
        w = [f"w{i}_{k}" for k in range((12, 120, 900)[i % 3])]
        for _ in range(30):  # many sets that share most shingles
            x = list(w)
            for _ in range(r.randrange(1, 2 + len(w) // 60)):
                x[r.choice([-1, r.randrange(len(x))])] = f"x{r.randrange(9000)}"
            rows.append((len(rows), " ".join(x)))
    prints = m._prints(spark.createDataFrame(rows, "_d long, _x string").repartition(3))
    met, _ = m._meetings(prints)
    got = {(x.u, x.v) for x in m._still_apart(met, prints, spark.createDataFrame([], "node long, root long")).collect()}
    g = {x._d: x.g for x in prints.collect()}
    sets = {i: slow_set(x) for i, x in rows}
    similar = {(max(g[i], g[j]), min(g[i], g[j])) for i in sets for j in range(i) if g[i] != g[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(similar) > 500 and similar <= got and len(got) < 12 * 30 * 29 / 2


def test_large_sets_that_share_little_are_no_pairs(spark):
    """512 parities say nothing about them: each shares a tenth with the others, some of it in the prefixes; one pair is similar."""
    r, rows = random.Random(5), []
    for i in range(20):
        rows.append((i, " ".join([f"c{k}" for k in range(200)] + [f"w{i}_{k}" for k in range(1800)])))
    x = rows[4][1].split()
    for _ in range(20):
        x[r.randrange(300, 2000)] = "other"
    rows.append((20, " ".join(x)))
    prints = m._prints(spark.createDataFrame(rows, "_d long, _x string").repartition(3))
    met, _ = m._meetings(prints)
    none = spark.createDataFrame([], "node long, root long")
    g = {x._d: x.g for x in prints.collect()}
    one = {(max(g[4], g[20]), min(g[4], g[20]))}
    assert {(x.u, x.v) for x in m._still_apart(met, prints, none).collect()} == one
    pairs = spark.createDataFrame([(max(g[i], g[j]), min(g[i], g[j])) for i in g for j in range(i)], "u long, v long")
    assert {(x.u, x.v) for x in m._possible(pairs, prints).collect()} == one


def test_large_sets_make_no_rows_for_each_shingle_that_two_share(spark, monkeypatch):
    """Sets of 6,000 shingles, of which every two share 96 that no third has: nothing is left of them before rows are counted."""
    r, n, made = random.Random(6), 12, spark.sparkContext.accumulator(0)
    rows = [(i, " ".join(" ".join(f"p{min(i, j)}_{max(i, j)}_{k}" for k in range(100)) for j in range(n) if j != i) + " " + " ".join(f"w{i}_{k}" for k in range(4900))) for i in range(n)]
    x = rows[3][1].split()
    for _ in range(60):
        x[r.randrange(1100, 6000)] = f"other{r.randrange(900)}"
    rows.append((n, " ".join(x)))
    apart = m._apart

    def counted(batches):
        for b in apart(batches):
            made.add(b.num_rows)
            yield b

    monkeypatch.setattr(m, "_apart", counted)
    prints = m._prints(spark.createDataFrame(rows, "_d long, _x string").repartition(3))
    met, _ = m._meetings(prints)
    got = {(x.u, x.v) for x in m._still_apart(met, prints, spark.createDataFrame([], "node long, root long")).collect()}
    g = {x._d: x.g for x in prints.collect()}
    assert got == {(max(g[3], g[n]), min(g[3], g[n]))}
    assert 0 < made.value <= 16  # the one similar pair, once for each piece


def test_similar_sets_have_a_similar_piece():
    r, ways = np.random.default_rng(9), set()
    for n in (1, 5, 60, 400, 409, 410, 500, 512, 513, 600, 1640, 2040, 2060, 2500, 6000, 8190, 8200):
        for _ in range(20):
            x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            share = int(np.ceil(len(x) * r.uniform(0.8, 1)))
            y = np.unique(np.concatenate([r.permutation(x)[:share], r.integers(0, 1 << 63, int(max(0, share / 0.8 - len(x)) * r.uniform(0, 1))).astype(np.uint64) * np.uint64(2)]))
            assert m.similar(x, y)
            p, q = dict(m.pieces(x)), dict(m.pieces(y))
            assert np.array_equal(np.unique(np.concatenate(list(p.values()))), x)
            assert any(m.similar(p[k], q[k]) for k in p.keys() & q.keys())
            ways.add((len(m.cuts(len(x))), len(m.cuts(len(y)))))
    assert {(1, 1), (1, 2), (2, 1)} <= ways


def test_wide_parities_differ_in_no_more_classes_than_the_sets():
    r = np.random.default_rng(4)
    for n in (0, 1, 300, 512, 513, 1000, 1030, 5000):
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[n // 9 :], r.integers(0, 1 << 63, n // 7).astype(np.uint64)]))
        d, apart = m.differing(m.wide_parities(x), m.wide_parities(y)), len(np.setxor1d(x, y))
        assert apart / 2 <= d <= apart
    assert m.differing(m.wide_parities(np.arange(5000, dtype=np.uint64)), m.wide_parities(np.arange(400, dtype=np.uint64))) > 0


def test_a_staged_table_leaves_no_shuffle_files(spark):
    files = lambda: set(Path(tempfile.gettempdir()).glob("blockmgr-*/*/shuffle_*.data"))
    before = files()
    df = staged(spark.range(100_000).repartition("id").groupBy((F.col("id") % 1009).alias("k")).count(), "shuffled")
    for _ in range(50):  # they are deleted soon after
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and df.count() == 1009
    assert spark.conf.get(CLEANUP) == "false"


def test_pipeline_stage_is_brute_force_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = slow_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in dict(pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()} == set(want.values())


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "A b  c"), (3, "a b c"), (9, "x y z w"), (8, ""), (7, None)], "doc_id long, text string").selectExpr("doc_id", "text", "1 g", "2 root")
    got = sorted(((x.doc_id is None, x.doc_id or 0), x.component_id) for x in m.near_copies(df).collect())
    assert got == [((False, 3), 3), ((False, 3), 3), ((False, 7), 7), ((False, 8), 7), ((False, 9), 9), ((True, 0), 3)]
    assert m.near_copies(df.limit(0)).collect() == []
