import random

import numpy as np
import pytest

import seshat.llm.decontam as m


def distance(item, text):
    """Fewest edits of item against any part of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(item):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def words(r, n):
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randrange(2, 8))) for _ in range(n))


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        k = r.randrange(len(s))
        s[k : k + 1] = r.choice([[], ["z"], [s[k], "y"]])
    return "".join(s)


@pytest.mark.parametrize("hits", [1 << 21, 7])
def test_matches_brute_force(monkeypatch, hits):
    monkeypatch.setattr(m, "HITS", hits)
    r = random.Random(4)
    items = [(i, m.normal(words(r, r.randrange(2, 40) if i % 2 else r.randrange(2, 14)))) for i in range(40)]
    assert {len(t) < 8 or len(t) // 20 for _, t in items} > {0, 1, 2, 3, 5}
    index = m.Index(items)
    texts = []
    for _ in range(160):
        i, t = r.choice(items)
        t = edited(r, t.decode("utf-8", "ignore"), r.randrange(0, 3 if len(t) < 80 else 8))
        texts.append(m.normal(words(r, r.randrange(0, 20)) + " " + t + " " + words(r, r.randrange(0, 20))))
    texts += [b"", b"a"]
    got = index.matches(texts)
    hits = 0
    for x, own in zip(texts, got, strict=True):
        found = {i: e for i, _, _, e in own}
        for i, t in items:
            e = m.budget(len(t))
            d = distance(t, x) if len(t) >= m.SHORT else 0 if b" " + t + b" " in b" " + x + b" " else 1
            assert (i in found) == (d <= e), (i, d, e)
            if i in found:
                hits += 1
                assert found[i] >= d
        for i, s, z, e in own:
            assert distance(dict(items)[i], x[s:z]) <= e
    assert hits > 40


def test_align_prefers_fewest_edits():
    assert m.align(b"abcdefgh", b"xxabcdefghyy", 0, 4, 2) == (2, 10, 0)
    assert m.align(b"abcdefgh", b"xxabcdXfghyy", 0, 4, 2)[2] == 1
    assert m.align(b"abcdefgh", b"zzzzzzzzzz", 0, 2, 2) is None


def test_queries_in_documents(spark):
    bench = spark.createDataFrame([(1, "The Quick, brown fox jumps over the lazy dog again"), (2, None), (3, ""), (4, "tiny one"), (1, "The Quick, brown fox jumps over the lazy dog again")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "So: THE quick\nbrown fox -- jumps over the lazy dog again!", "a"), (2, None, "b"), (3, "", "c"), (4, "a tiny one.", "d"), (None, "xtiny one", "e"), (5, "the quick brown fxo jumps over the lazy dog again", "f"), (5, "clean", "g")],
        "doc_id long, text string, item_id string",
    )
    got = sorted((x.doc_id, x.item_id, x.edits) for x in m.find_leaks(docs, bench).collect())
    assert got == [(1, 1, 0), (4, 4, 0), (5, 1, 2)]
    one = next(x for x in m.find_leaks(docs, bench).collect() if x.doc_id == 1)
    assert (one.start, one.end) == (4, len("So: THE quick\nbrown fox -- jumps over the lazy dog again!") - 1)
    kept = m.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(x.item_id for x in kept.collect()) == ["b", "c", "e", "g"]
    assert m.find_leaks(docs.limit(0), bench).collect() == [] and m.find_leaks(docs, bench.limit(0)).collect() == []


def test_blocks(spark, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = sorted(map(tuple, m.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(m, "BLOCK", 3000)
    assert sorted(map(tuple, m.find_leaks(docs, bench).collect())) == whole
    assert sorted(r.doc_id for r in m.without_leaks(docs, bench).collect()) == sorted({r.doc_id for r in docs.collect()} - {x[0] for x in whole})
    exact = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if m.normal(b.text) in m.normal(d.text)}
    assert exact <= {(x[0], x[1]) for x in whole} and len(whole) < len(exact) + 5
    assert np.array(whole).size


def test_long_texts_and_index_size():
    r = random.Random(9)
    item = m.normal(words(r, 60))
    index = m.Index([(1, item), (2, m.normal(words(r, 200_000)))])
    assert [x[0] for x in index.matches([m.normal(words(r, 150_000)) + b" " + item])[0]] == [1]
    held = sum(a.nbytes for t in index.tables for a in (t.grams, t.first, t.item, t.pos, t.seen))
    assert held < 30 * sum(map(len, index.texts))
