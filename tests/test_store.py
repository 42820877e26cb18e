"""Capture, normalization, ingest, search and resolve on hand-written transcripts."""

import json

import pytest

from seshat.operators import embedding, ledgers, normalize, profiles, search, store
from seshat.operators.filters import Filters
from seshat.schema import EMBED_LEDGER, EMBED_RUN, VECTOR
from seshat.sources import archive, transcripts
from seshat.sources.transcripts import Config
from seshat.streaming.capture import capture_stream

KEY = "AKIA" + "ABCDEFGHIJKLMNOP"


def line(kind, uuid, content, **more):
    return json.dumps({"type": kind, "uuid": uuid, "sessionId": "S1", "timestamp": f"2024-01-01T00:00:0{uuid[-1]}Z", "message": {"role": kind, "content": content}} | more)


PARENT = [
    json.dumps({"type": "ai-title", "sessionId": "S1", "aiTitle": "Widgets"}),
    line("user", "u1", f"Please launch_gadget with {KEY}", gitBranch="main", version="9"),
    line("assistant", "u2", [{"type": "thinking", "thinking": "hmm"}, {"type": "text", "text": "Sure:\n```py\ndef f():\n  pass\n```\n"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/repo/main.rs"}}]),
    line("user", "u3", [{"type": "tool_result", "tool_use_id": "t1", "content": "SKELETON_MARK body", "is_error": False}]),
    line("assistant", "u4", [{"type": "tool_use", "id": "t2", "name": "Bash", "input": {"command": "A=1 cargo test <<EOF\none\ntwo\nEOF"}}, {"type": "tool_use", "id": "t3", "name": "Write", "input": {"file_path": "/repo/Notes.TXT", "content": "l1\nl2"}}, {"type": "tool_use", "id": "t4", "name": "Task", "input": {"subagent_type": "scout"}}]),
    line("assistant", "u2", "a replay"),
    line("user", "u5", "noise", isMeta=True),
    line("user", "u6", "noise", hookInfos=None),
    line("user", "u7", [{"type": "tool_result", "tool_use_id": "t9", "content": [{"type": "text", "text": "x"}]}]),
    '{"torn": ',
]
SUB = [line("assistant", "u8", "from the side", isSidechain=True, agentId="g1"), line("assistant", "u9", [{"type": "tool_use", "id": "w", "name": "WebFetch", "input": {"url": "http://x"}}], isSidechain=True)]


@pytest.fixture()
def cfg(tmp_path):
    d = tmp_path / "root" / "projects" / "proj" / "dir1"
    d.mkdir(parents=True)
    (tmp_path / "root/projects/proj/dir1.jsonl").write_text("\n".join(PARENT) + "\n")
    (d / "subagents").mkdir()
    (d / "subagents" / "agent-1.jsonl").write_text("\n".join(SUB))
    return Config(f"{tmp_path}/archive", f"{tmp_path}/root", f"{tmp_path}/store")


def test_capture_ingest_search_resolve(spark, cfg, tmp_path):
    assert archive.sweep(spark, cfg, "now", 1) == 2 and archive.sweep(spark, cfg, "now", 2) == 0
    assert store.ingest(spark, cfg, "v1", 1) == 1 and store.ingest(spark, cfg, "v2", 2) == 0
    t = store.tables(spark, cfg)
    s = t["session"].first()
    assert (s.session_id, s.project, s.title, s.git_branch, s.started_at[-3:]) == ("S1", "proj", "Widgets", "main", "01Z")
    assert s.archive_refs == ["0000", "subagents/agent-1/0000"]
    e = {(r.uuid, r.kind): r for r in t["event"].collect()}
    assert e["u1", "text"].text == "Please launch_gadget with [REDACTED]" and ("u5", "text") not in e and ("u6", "text") not in e
    assert e["u2", "text"].text.startswith("Sure") and e["u2", "thinking"].text is None and e["u2", "thinking"].grain == "skeleton"
    assert e["u2", "tool_use"].text == "/repo/main.rs" and e["u3", "tool_result"].tool_name == "Read" and e["u3", "tool_result"].is_error is False
    assert e["u7", "tool_result"].tool_name is None
    assert e["u8", "text"].is_sidechain and e["u8", "text"].agent_type == "scout" and e["u9", "tool_use"].text == "http://x"
    m = {(r.entity, r.entity_type) for r in t["mention"].collect()}
    assert m == {("/repo/main.rs", "file"), ("cargo", "command"), ("/repo/Notes.TXT", "file")}
    a = {r.artifact_id: r for r in t["artifact"].collect()}
    assert a["u2-0"].kind == "snippet" and a["u2-0"].language == "py" and a["u2-0"].request_bundle == "u1"
    assert a["u4-0"].content == "one\ntwo" and a["u4-1"].language == "txt" and a["u4-1"].path == "/repo/Notes.TXT"
    words = " ".join(r.content for r in t["fts"].collect())
    assert "SKELETON_MARK" not in words and KEY not in words
    assert [r.session_id for r in search.exact_listing(t["mention"], "cargo", Filters("command", "proj")).collect()] == ["S1"]
    index = search.build_index(t["fts"], "doc", "content", f"{tmp_path}/index")
    hit = search.keyword_search(index, t["fts"], "launch-GADGET").collect()
    assert [(h.source_type, h.source_id) for h in hit] == [("event", "u1")]
    assert search.keyword_search(index, t["fts"], " * ").collect() == []
    assert store.resolve(spark, cfg, t, "S1", "event", "u1") == PARENT[1]
    assert store.resolve(spark, cfg, t, "S1", "artifact", "u4-1") == PARENT[4]
    for bad in (("S1", "artifact", "zz"), ("none", "event", "u1"), ("S1", "event", "zz")):
        with pytest.raises(store.NotFound):
            store.resolve(spark, cfg, t, *bad)
    with pytest.raises(ValueError):
        store.resolve(spark, cfg, t, "S1", "entity", "x")
    with pytest.raises(ValueError):
        archive.read_generation(spark, cfg, "proj", "dir1", "../0000")
    assert archive.read_generation(spark, cfg, "proj", "dir1", "0000").decode().split("\n")[1] == PARENT[1]
    # the transcript grows: a new generation, the session replaced, nothing twice
    p = tmp_path / "root/projects/proj/dir1.jsonl"
    p.write_text("\n".join([*PARENT[:-1], line("user", "u0", "later words")]) + "\n")
    assert archive.sweep(spark, cfg, "later", 3) == 1
    assert sorted(r.nth for r in archive.generations(spark, cfg).filter("sub_path = ''").collect()) == [0, 1]
    assert store.ingest(spark, cfg, "v3", 3) == 1
    after = store.tables(spark, cfg)["event"]
    assert after.filter("uuid = 'u1'").count() == 1 and after.filter("text = 'later words'").count() == 1
    n = after.count()
    store.vacuum(spark, cfg, f"{tmp_path}/scratch")
    assert store.tables(spark, cfg)["event"].count() == n
    valid, bad = normalize.split_valid(archive.generation_lines(archive.generations(spark, cfg)))
    assert bad.count() == 1


def test_records_round_trip(spark, cfg, tmp_path):
    archive.sweep(spark, cfg, "now", 1)
    got = normalize.normalize(archive.generation_lines(archive.generations(spark, cfg)))
    normalize.to_records(got).write.text(f"{tmp_path}/records")
    records = transcripts.read_records(spark, f"{tmp_path}/records")
    store.load(records, cfg)
    back = store.loaded(spark, cfg)
    assert back["event"].count() == got["event"].count() and back["artifact"].count() == got["artifact"].count()
    assert profiles.assemble(back).groupBy("unit_kind").count().count() == 3


def test_snapshot_and_stream(spark, cfg, tmp_path):
    outside = tmp_path / "x.jsonl"
    outside.write_text(PARENT[1])
    assert not archive.snapshot(spark, cfg, {"session_id": "s", "transcript_path": f"{tmp_path}/none"}, "now")
    assert archive.snapshot(spark, cfg, {"session_id": "s", "transcript_path": str(outside), "cwd": "/home/me"}, "now")
    assert archive.generations(spark, cfg).first().project == "-home-me"
    seen = []
    for _ in range(2):
        capture_stream(spark, cfg, f"{tmp_path}/checkpoint", "now", lambda keys: seen.append(keys.count())).awaitTermination()
    assert seen == [1] and archive.generations(spark, cfg).count() == 3
    assert transcripts.transcript_files(spark, f"{tmp_path}/nowhere").count() == 0
    with pytest.raises(ValueError):
        Config("/")


def test_drain_isolates_failures_and_gives_up(spark, tmp_path):
    class Picky(embedding.HashEmbedder):
        def documents(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("bad text")
            return super().documents(texts)

    n = [0]

    def keep(df, name):
        n[0] += 1
        df.write.parquet(f"{tmp_path}/{name}{n[0]}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}{n[0]}")

    units = spark.createDataFrame([("event", f"u{i}:1", "p", "bad" if i == 1 else f"text {i}") for i in range(3)], "unit_kind string, source_id string, project string, text string")
    vectors, book = spark.createDataFrame([], VECTOR), spark.createDataFrame([], EMBED_LEDGER)
    e = Picky(8)
    runs = spark.createDataFrame([], EMBED_RUN)
    assert ledgers.embed_status(book, runs, 3, e.version, 0).state == "not-yet-embedded"
    vectors, book, c = embedding.drain(units, vectors, book, e, "t", keep)
    assert c == {"embedded": 2, "failed": 1, "skipped": 0} and vectors.count() == 2
    for _ in range(4):
        vectors, book, c = embedding.drain(units, vectors, book, e, "t", keep)
        assert c == {"embedded": 0, "failed": 1, "skipped": 2}
    assert ledgers.pending(units, book, e.version).count() == 0
    done = spark.createDataFrame([(1, 0, 0, 7, "done", 3, 2, 0, 1), (2, 0, 50, 7, "running", 3, 1, 0, 0)], EMBED_RUN)
    assert ledgers.embed_status(book, done, 3, e.version, 100).line == "running: 1/3 units embedded"
    assert ledgers.embed_status(book, done, 3, e.version, 1000).state == "stalled"
    assert ledgers.embed_status(book, done.filter("id = 1"), 3, e.version, 0).line == "done with 1 failed: sample error: bad text"
    assert len(embedding.embed_query(e, "hello")) == 8
