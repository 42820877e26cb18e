"""Locks, run log and passes over a store; the archive's manifest and refused snapshots."""

import json
import time

import pytest

from seshat.operators import embedding, ledgers, runs, store
from seshat.sources import archive, transcripts
from seshat.sources.transcripts import Config


def line(uuid, text):
    return json.dumps({"type": "user", "uuid": uuid, "sessionId": f"S{uuid}", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": text}})


@pytest.fixture()
def cfg(tmp_path):
    d = tmp_path / "root" / "projects" / "p [1]"
    d.mkdir(parents=True)
    for k in range(3):
        (d / f"s{k}.jsonl").write_text(line(f"u{k}", f"words of session {k}") + "\n")
    return Config(f"{tmp_path}/archive", f"{tmp_path}/root", f"{tmp_path}/store")


def test_lock_is_exclusive_and_taken_over_when_stale(spark, tmp_path):
    at = f"{tmp_path}/lock"
    first = runs.acquire(spark, at)
    assert first and runs.acquire(spark, at) is None
    first.touch()
    first.release()
    second = runs.acquire(spark, at)
    assert second.number == 2
    time.sleep(1.1)
    third = runs.acquire(spark, at, stale=1)
    assert third.number == 3 and not second.held()
    with pytest.raises(RuntimeError):
        second.touch()


def test_passes_and_status(spark, cfg, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "SLICES", 2)
    assert runs.seed(spark, cfg) == runs.seed(spark, cfg) and runs.seed(spark, cfg)["schema_version"] == "1"
    busy = runs.acquire(spark, f"{cfg.store}/_lock-ingest")
    assert runs.ingest_pass(spark, cfg, "now", 1, 1) is None
    busy.release()
    assert runs.ingest_pass(spark, cfg, "now", 1, 1) == {"captured": 3, "sessions": 3}
    assert runs.ingest_pass(spark, cfg, "now", 2, 2) == {"captured": 0, "sessions": 0}
    assert archive.manifest(spark, cfg).filter("size(generations) = 1 and generations[0].kind = 'sweep'").count() == 3
    e = embedding.HashEmbedder(8)
    assert runs.status(spark, cfg, e.version, 0).state == "not-yet-embedded"
    busy = runs.acquire(spark, f"{cfg.store}/_lock-embed")
    assert runs.embed_pass(spark, cfg, e) is None
    busy.release()
    assert runs.embed_pass(spark, cfg, e, lambda: 100) == {"embedded": 3, "skipped": 0, "failed": 0}
    assert runs.status(spark, cfg, e.version, 100).line == "done: 3/3 units embedded"
    assert runs.embed_pass(spark, cfg, e, lambda: 200) == {"embedded": 0, "skipped": 3, "failed": 0}
    vectors, book = runs.embedded(spark, cfg)
    assert vectors.count() == 3 and {r.attempts for r in book.collect()} == {1}
    run = {r.id: r for r in runs.runs(spark, cfg).collect()}
    assert run[1].state == run[2].state == "done" and run[1].embedded == 3 and run[2].skipped == 3
    # a run that stopped without an end
    runs.log(spark, cfg, 0, **(run[2].asDict() | {"id": 3, "state": "running", "heartbeat_at": 300}))
    assert runs.status(spark, cfg, e.version, 301).state == "running"
    assert runs.status(spark, cfg, e.version, 301 + ledgers.STALE_SECONDS).state == "stalled"
    # one session grows: only its unit is embedded
    (tmp_path / "root/projects/p [1]/s1.jsonl").write_text(line("u1", "words of session 1") + "\n" + line("u9", "more words") + "\n")
    assert runs.ingest_pass(spark, cfg, "later", 3, 3) == {"captured": 1, "sessions": 1}
    assert runs.embed_pass(spark, cfg, e) == {"embedded": 1, "skipped": 3, "failed": 0}
    assert store.ledger(spark, cfg).count() == 3


def test_files_by_path_and_refused_snapshots(spark, cfg, tmp_path):
    got = transcripts.files_at(spark, cfg.root, [f"{tmp_path}/root/projects/p [1]/s2.jsonl"]).collect()
    assert [(r.project, r.session) for r in got] == [("p [1]", "s2")]
    outside = tmp_path / "x.jsonl"
    outside.write_text(line("u", "x"))
    for bad in ({"session_id": "s"}, {"session_id": "s", "cwd": ""}, {"session_id": "s", "cwd": "/a/../b"}, {"session_id": "../s", "cwd": "/a"}, {"cwd": "/a"}):
        with pytest.raises(ValueError):
            archive.snapshot(spark, cfg, bad | {"transcript_path": str(outside)}, "now")
    assert archive.generations(spark, cfg).count() == 0


def test_zstd_generations(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    d = tmp_path / "z" / "p" / "s"
    (d / "subagents" / "a").mkdir(parents=True)
    (d / "0000.zst").write_bytes(zstandard.compress(b"one\n\ntwo\n"))
    (d / "subagents" / "a" / "0000.zst").write_bytes(zstandard.compress(b"three"))
    got = [(r.line, r.gen_ref, r.line_no) for r in archive.read_zstd(spark, f"{tmp_path}/z").orderBy("gen_ord", "line_no").collect()]
    assert got == [("one", "0000", 0), ("two", "0000", 2), ("three", "subagents/a/0000", 0)]
