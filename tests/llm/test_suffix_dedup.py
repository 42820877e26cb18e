import hashlib
import random

import pytest

from seshat.llm.suffix_dedup import digest, suffix_dedup

L = 100


def brute(rows):
    """rows: (id, text), ids distinct -> id: (n_bytes, n_removed, n_spans, sha)."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - L + 1):
            w = b[s : s + L]
            if w in seen:
                gone[s : s + L] = b"\1" * L
            seen.add(w)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def run(spark, rows, schema="doc_id long, text string"):
    got = digest(suffix_dedup(spark.createDataFrame(rows, schema).repartition(3))).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}


def words(r, n, vocab=40):
    return " ".join(r.choice(["é", "ab", "xyz", "the", "ünd"]) + str(r.randrange(vocab)) for _ in range(n))


def test_matches_brute_force(spark):
    r = random.Random(5)
    passages = [words(r, 40) for _ in range(6)]
    rows = []
    for i in range(300):
        parts = [words(r, r.randrange(0, 60)) for _ in range(3)]
        parts += [p[: r.randrange(60, len(p) + 1)] for p in r.sample(passages, r.randrange(0, 3))]
        r.shuffle(parts)
        rows.append((i * 7 % 1009, " ".join(parts)))
    base = words(r, 200)
    for i in range(120):  # near copies, exact copies and copies that differ at the ends
        x = list(base)
        for _ in range(r.randrange(0, 4)):
            x[r.randrange(len(x))] = "Q"
        rows.append((2000 + i, "".join(x)))
    rows += [(3000, "ab" * 400), (3001, "a" * 1000), (3002, words(r, 3) * 90), (3003, "x" * 99), (3004, "x" * 100)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    p = words(random.Random(1), 60)
    rows = [(None, p), (1, None), (2, ""), (3, p), (4, "é" * 50), (5, "é" * 50), (6, p + "tail")]
    assert run(spark, rows) == brute(rows)


def test_long_text_is_cut_into_segments(spark, monkeypatch):
    import seshat.llm.suffix_dedup as m

    r = random.Random(3)
    p = words(r, 400)
    buf = (p + words(r, 50) + p).encode()
    import numpy as np

    a = m._anchors(np.frombuffer(buf, np.uint8), np.array([0, len(buf)]), L)
    monkeypatch.setattr(m, "SEGMENT", 64)
    monkeypatch.setattr(m, "BLOCK", 256)
    b = m._anchors(np.frombuffer(buf, np.uint8), np.array([0, len(buf)]), L)
    assert a[2].sum() == b[2].sum() == len(buf) - L + 1
    assert len(b[0]) > len(a[0])


def test_repeated_rows_empty_table_and_other_columns(spark):
    p = words(random.Random(2), 60)
    rows = [(1, p, "x"), (1, p, "x"), (2, p, None), (2, p + "!", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, g string").withColumnRenamed("g", "_d")
    got = sorted((r.doc_id, r.n_removed) for r in digest(suffix_dedup(df)).collect())
    assert got[:2] == [(1, 0), (1, 0)]
    assert [x[0] for x in got[2:]] == [2, 2] and all(x[1] >= 100 for x in got[2:])
    assert digest(suffix_dedup(df.limit(0))).collect() == []


def test_length_is_checked(spark):
    with pytest.raises(ValueError):
        suffix_dedup(spark.range(1).selectExpr("id doc_id", "'' text"), length=20)


def test_last_digit_of_hot_groups(monkeypatch):
    """One passage followed by a hundred names: over MANY different rows a group in each block; their outcomes, ranked as Spark does, against brute force."""
    import pyarrow as pa

    import seshat.llm.suffix_dedup as m

    monkeypatch.setattr(m, "BLOCK", 4096)
    monkeypatch.setattr(m, "MANY", 8)
    r = random.Random(11)
    passage, names = "p" * 20 + words(r, 14), [words(r, 12) for _ in range(100)]
    texts = [f"{passage} {names[i % 100]}" for i in range(300)]
    rows = []
    for at in range(0, 300, 60):  # several partitions
        part = [x.encode() for x in texts[at : at + 60]]
        runs = [[{"s": 0, "w": len(x) - L + 1, "r": 0}] for x in part]
        kind = pa.list_(pa.struct([("s", pa.int64()), ("w", pa.int32()), ("r", pa.int32())]))
        n = len(part)
        batch = pa.record_batch([pa.array(range(at, at + n), pa.int64()), pa.array([0] * n, pa.int64()), pa.array(part, pa.binary()), pa.array(runs, kind)], names=["_d", "_t", "_x", "runs"])
        for b in m._third_digit(L)(batch):
            rows += b.to_pylist()
    first = {}
    for x in sorted((x for x in rows if x["f"] == m.SETTLED), key=lambda x: (x["d"], x["s"])):
        first.setdefault((x["g"], x["c"]), (x["d"], x["s"]))
    got = {(x["d"], x["s"]) for x in rows if x["f"] == m.DUP or x["f"] == m.SETTLED and first[x["g"], x["c"]] != (x["d"], x["s"])}
    seen, want = set(), set()
    for d, x in enumerate(texts):
        b = x.encode()
        for s in range(len(b) - L + 1):
            if b[s : s + L] in seen:
                want.add((d, s))
            seen.add(b[s : s + L])
    assert got == want


def test_hot_prefix_over_several_partitions(spark):
    """Pairs of documents that share a phrase with all others and then go on in a way of their own; partitions are not coalesced."""
    r = random.Random(13)
    phrase = words(r, 40)[:90]
    rows = []
    for k in range(400):
        own = f"{k:04d}" + words(random.Random(k), 40)[:66]
        rows += [(k, f"{phrase}{own} first {k}"), (400 + (k * 7) % 400, f"other {k} {phrase}{own}")]
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_equals_sql(spark):
    from oracle import same

    from seshat.llm.queries import SQL, op2_suffix_dedup

    d = "/root/testdata/sf0.001"
    assert same(op2_suffix_dedup(spark, d), SQL["op2_suffix_dedup"], d) is None
