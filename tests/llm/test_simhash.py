import random

import numpy as np
import pytest
import xxhash

import seshat.llm.simhash as m


def slow_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def slow_groups(prints):
    """prints: id -> fingerprint; gives id -> smallest id reachable."""
    ids, up = sorted(prints), {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    f = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(f[:k] ^ f[k]) <= 3):
            a, b = root(ids[j]), root(i)
            up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_fingerprint():
    for t in [None, "", " \t", "one", "one Two", "a b c", "É x y z z z", "w " * 70000 + "q"]:
        assert m.fingerprint(t) == slow_print(t)


def test_anchors_cover():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 32, 300).astype(np.uint64)
    home = m._home(x)
    assert (np.bitwise_count(home ^ x) <= 1).all() and (m._syndrome(home) == 0).all()
    for i in range(32):
        y = x ^ np.uint64(1 << i)
        assert ((m._visits(y) == home[:, None]).any(axis=1)).all()
    assert (np.bitwise_count(m._visits(x) ^ x[:, None]) <= 2).all()


@pytest.mark.parametrize("chunk", [4096, 3])
def test_links_match_brute_force(spark, chunk):
    r = random.Random(chunk)
    prints = set()
    for _ in range(60):  # chains and clouds of fingerprints
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 3, 40])):
            prints.add(x)
            y = x
            for _ in range(r.randrange(0, 5)):
                y ^= 1 << r.randrange(64)
            prints.add(y)
            x = r.choice([x, y])
    want = slow_groups(dict(zip(prints, prints, strict=True)))
    signed = [(np.uint64(p).astype(np.int64).item(),) for p in prints]
    found = m.links(spark.createDataFrame(signed, "f long").repartition(4), chunk)
    roots = {x.node: x.root for x in m.components(found).collect()}
    groups = {}
    for p, root in want.items():
        groups.setdefault(root, set()).add(np.uint64(p).astype(np.int64).item())
    for g in groups.values():
        assert len({roots.get(x, x) for x in g}) == 1
    assert len({roots.get(x[0], x[0]) for x in signed}) == len(groups)


def test_documents_match_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(200):
        w = [r.choice("abcdefgh") * r.randrange(1, 5) for _ in range(r.randrange(0, 80))]
        for k in range(r.choice([1, 1, 3])):
            rows.append((i * 10 + k, " ".join(w)))
            if w:
                w[r.randrange(len(w))] = "new"
    rows += [(5001, None), (5002, "")]
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: slow_print(t) for i, t in rows}
    groups = slow_groups(prints)
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i, _ in rows}


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (9, "x y z w")], "doc_id long, f string").selectExpr("doc_id", "f text", "1 f", "2 u")
    assert sorted(((x.doc_id is None, x.doc_id or 0), x.component_id) for x in m.near_duplicates(df).collect()) == [((False, 3), 3), ((False, 3), 3), ((False, 9), 9), ((True, 0), 3)]
    assert m.near_duplicates(df.limit(0)).collect() == []
