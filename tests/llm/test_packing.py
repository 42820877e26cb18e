import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import seshat.llm.packing as m

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    odd = ["", " ", "It's DON'T we'll 12345 é É é ñ̃ İstanbul ß ẞ Σίσυφος ΑΣ 中文字 日本 👍🏽 a​b a b x　y", "a\x1cb \x85 c d", "<|endoftext|> x<|startoftext|>y <|", "ﬁ ŉ ǅ K Å", "ſ ĸ ŀ'S 'Re ''s", "a" * 3000, "...!!! -- #$%\t\n\r\x0b\x0c z", "०१२ Ⅷ ½ ²", "́x", "x ́", "İ", "ı I"]
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    r = random.Random(1)
    made = ["".join(r.choice("aé'sTß \n.,1中́İ|<>ſ") for _ in range(60)) for _ in range(300)]
    e = m.Encoder(PATH)
    for x in (odd, docs, made):
        assert [a.tolist() for a in e.batch(pa.array(x))] == [t.encode(y, add_special_tokens=False).ids for y in x]


def test_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(m, "CACHE", 5)
    e = m.Encoder(PATH)
    a = [x.tolist() for x in e.batch(pa.array(["one two three four five six seven"]))]
    assert [x.tolist() for x in e.batch(pa.array(["one two three four five six seven"]))] == a
    e.batch(pa.array(["eight"]))
    assert len(e.number) < 9


def test_cut():
    for n in [*range(1, 9000), 100_001]:
        c = m.cut(n)
        assert sum(c) == n and max(c) <= 4096
    assert m.cut(4096) == [4096] and m.cut(4097) == [4096, 1]


def check(rows, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, x in docs:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc.pop(i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    total = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        total += 4096
    return total


def test_round_trip_and_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = m.pack(docs.repartition(5), PATH, with_ids=True).collect()
    total = check(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    lengths = defaultdict(int)
    for r in rows:
        lengths[r.sequence_id] += r.length
    full = [n for n in lengths.values() if n > 2048]
    assert sum(n > 4000 for n in full) > 0.6 * len(full)
    assert total < 1.5 * sum(lengths.values())  # at this size the last sequence of each class counts
    assert zlib.crc32(np.array(rows[0].ids, "<u4").tobytes()) == rows[0].ids_crc32


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "", 6), (None, "a", 7)], "doc_id long, text string, length int")
    got = m.pack(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.length, r.doc_tokens) for r in got) == [(0, 2, 2), (1, 1, 1), (2, 1, 1), (2, 1, 1)]
    assert len({(r.sequence_id, r.offset) for r in got}) == 4
    assert m.pack(df.limit(0), PATH).collect() == []


def test_slices_of_plain_odd_null_and_long_texts(spark, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = ["Plain words, it's 42.", None, "", " \t\n", "中文 and plain", "a\x1cb", "ŉ É\xa0x", "one long text's words, " * 3000, "x" * 5000, "<|endoftext|>", "Plain words, it's 42."]
    docs = [(i, x) for i, x in enumerate(texts)]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc", "x"])
    monkeypatch.setattr(m.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    for size in (1, 30, 1 << 20):
        monkeypatch.setattr(m, "SLICE", size)
        for rows in (batch, batch.slice(2, 7), batch.slice(0, 0)):
            got = defaultdict(list)
            for b in m._pieces(PATH, True)(iter([rows])):
                for r in b.to_pylist():
                    assert r["length"] == len(r["ids"]) and r["start"] == len(got[r["doc"]]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
                    got[r["doc"]] += r["ids"]
            assert dict(got) == {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in docs if i in rows.column(0).to_pylist()}
