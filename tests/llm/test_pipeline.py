import zlib

import numpy as np
import pyarrow as pa
import pytest

from seshat.llm import decontam, suffix_dedup, toxicity
from seshat.llm.common import BATCH, BATCH_BYTES

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r.doc_id: r.text for r in docs.collect()}
    bench = [decontam.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    counts = [len(seen)]
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r.text for r in docs.collect()}
        counts.append(len(after))
        if name == "toxicity":
            scorer = toxicity.learn(toxicity.training_rows(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")))
            assert set(after) == {i for i, x in before.items() if scorer.score(x) < 0.7}
        elif name == "near_duplicates":
            pass  # held against brute-force Jaccard in test_near_copies
        elif name == "repeated_passages":
            assert set(after) == set(before) and sum(map(len, after.values())) < sum(map(len, before.values()))
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        else:
            assert set(after) == {i for i, x in before.items() if not any(b in decontam.normal(x) for b in bench)}
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]


def test_run(spark):
    got = pipeline.run(spark, SF).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)


def test_odd_documents(spark):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, long, "en", "s", 9), (2, long, "en", "s", 9), (None, long, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "tail " + long[300:], "en", "s", 1), (1, long, "en", "s", 9), (None, "own words here, twice and without an id", "en", "s", 1), (None, "own words here, twice and without an id", "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {}
    for name, stage in pipeline.STAGES:
        docs = out[name] = stage(spark, docs, SF)
    ids = sorted((r.doc_id for r in out["near_duplicates"].collect()), key=str)
    assert ids == [1, 3, 5, None]
    assert [r.lang for r in out["near_duplicates"].collect() if r.doc_id is None] == ["de"]
    assert suffix_dedup.rewritten(docs.limit(0).selectExpr("doc_id", "'' text")).collect() == []
    assert {r.doc_id for r in docs.collect()} == {1, 3, 5, None}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []


def test_stages_bound_the_batches_of_texts(spark):
    """Each worker and its executor hold several copies of a batch, so 10,000 long texts are not one."""
    docs = spark.range(3000).selectExpr("id doc_id", "repeat(concat('word', id, ' '), 1500) text", "'en' lang", "'x' source", "0L n_chars").coalesce(1)
    spark.conf.unset(BATCH)
    try:
        dict(pipeline.STAGES)["decontamination"](spark, docs, SF)

        def sizes(batches):
            for b in batches:
                yield pa.record_batch([[b.nbytes]], names=["n"])

        got = [r.n for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
        assert len(got) > 4 and max(got) < 1.25 * BATCH_BYTES
        spark.conf.set(BATCH, "12345")
        dict(pipeline.STAGES)["packing"](spark, docs.limit(1), SF)
        assert spark.conf.get(BATCH) == "12345"
    finally:
        spark.conf.unset(BATCH)
