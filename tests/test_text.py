import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from seshat.functions import text as fx
from seshat.functions import vectors as vx
from seshat.operators import search


def test_bm25_equals_fts5(spark):
    docs = ["launch gadget now", "The launch_gadget tool; launch again and again", "Café déjà vu", "nothing here", "gadget launch", "launch launch launch gadget café", ""]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(content)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("INSERT INTO f(rowid, content) VALUES (?, ?)", list(enumerate(docs)))
    df = spark.createDataFrame(list(enumerate(docs)), "doc long, content string").selectExpr("*", "'s' session_id", "'event' source_type", "'x' source_id")
    index = search.build_index(df, "doc", "content")
    for q in ["launch", "launch-gadget", "cafe", "CAFÉ launch", "again and", 'quo"te', "* launch", "missing", 'AND OR "', "  "]:
        match = " ".join('"' + w.replace('"', '""') + '"' for w in q.split())
        want = {r[0]: r[1] for r in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))} if q.strip() else {}
        got = {r.doc: r.rank for r in search.keyword_search(index, df, q).collect()}
        assert got.keys() == want.keys(), q
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_scrub_keeps_prose(spark):
    secret = ["sk-" + "a" * 20, "postgres://u:p@h/d", 'api_key = "abc"', "Authorization: Bearer abc.def", "eyJa.b.c", "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----", '"client_secret": "x"']
    plain = ["secret: we had no plan", "a token of thanks", "https://example.org/path", "sk-short"]
    df = spark.createDataFrame([(x,) for x in secret + plain], "x string").select("x", fx.scrub(F.col("x")).alias("y"))
    for r in df.collect():
        assert (fx.REDACTED in r.y) == (r.x in secret), r


def test_commands_and_code(spark):
    cmd = {"A=1 B= cargo test": "cargo", "X=1": None, "  /bin/ls -l": "/bin/ls", "=x y": "=x", "": None, "1A=2 z": "1A=2"}
    for r in spark.createDataFrame([(c,) for c in cmd], "c string").select("c", fx.argv0(F.col("c")).alias("a")).collect():
        assert r.a == cmd[r.c], r
    assert fx.heredocs("cat <<-'EOF'\n a\n  EOF\ncat <<X\nopen") == [" a"] and fx.heredocs(None) == []
    assert fx.fences("```\na\n```\n  ```rs x\nb\nc\n```\n```\nopen") == [(None, "a"), ("rs x", "b\nc")]


def test_vectors(spark):
    r = np.random.default_rng(1)
    m = r.normal(size=(300, 100)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "source_id long, embedding array<float>")
    for row in df.limit(20).select("embedding", vx.quantize(F.col("embedding")).alias("c")).collect():
        assert row.c == vx.pack_bits(row.embedding)
    q = m[7].astype(float)
    dist = 1 - (m @ q) / np.linalg.norm(m, axis=1) / np.linalg.norm(q)
    want = np.argsort(dist, kind="stable")[:10].tolist()
    assert [x.source_id for x in search.exact_topk(df, q.tolist(), 10).collect()] == want
    near = [x.source_id for x in search.two_stage_topk(df, q.tolist(), 10).collect()]
    assert near[0] == 7 and len(set(near) & set(want)) >= 5


def test_line_ends_and_unclosed_blocks():
    assert fx.heredocs("cat <<EOF\r\na\x0cb c\r\nEOF\r\n") == ["a\x0cb c"]
    assert fx.heredocs("cat <<A\ncat <<B\nx\nB\n") == ["x"] and fx.heredocs("x << \"END\" y\nEND") == [""] and fx.heredocs("a <<< b\nb") == []
    assert fx.heredocs("cat <<ENDS\nEND\nENDS") == ["END"] and fx.heredocs("a <<A <<B\n1\nB\n2\nA") == ["1\nB\n2"]
    assert fx.fences("```py\na\x85b\n```\ntext\n  ```\n\n```") == [("py", "a\x85b"), (None, "")] and fx.fences("```\nopen\n") == []
    assert fx.fences("```a\n1\n``` b\n```c\n2") == [("a", "1")]


def test_archive_key_uses_the_root(spark):
    from seshat.sources.transcripts import archive_key

    df = spark.createDataFrame([("file:/data/projects/x/projects/p/s.jsonl",), ("file:/data/projects/x/projects/p/s/subagents/a.jsonl",), ("file:/data/projects/x/p.jsonl",)], "path string")
    got = [tuple(r) for r in df.select(*(c.alias(k) for k, c in archive_key(F.col("path"), "file:///data/projects/x/").items())).collect()]
    assert got == [("p", "s", ""), ("p", "s", "subagents/a"), (None, None, None)]


def test_batch_search_breaks_ties_by_key(spark):
    rows = [(40 - i, [1.0, 0.0] if i % 10 else [0.0, 0.0]) for i in range(40)]
    v = spark.createDataFrame(rows, "source_id long, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    batch = sorted(r.source_id for r in search.batch_vector_search(v, q, 3).collect())
    assert batch == [r.source_id for r in search.exact_topk(v, [1.0, 0.0], 3).collect()] == [1, 2, 3]
