"""Transcript lines to records: sessions, events, artifacts, mentions.

Input is a table of raw lines: project, session_dir, gen_ord (order of generations, parent before subagents), gen_ref,
line_no, line. The order (gen_ord, line_no) is carried everywhere; nothing relies on row order. Lines that are not JSON
objects are quarantined (see `split_valid`), so one torn line does not stop an ingest.

Departures: session_id of an event is its session's logical id (the line's own id stays in raw_session_id); subagent
transcripts are read at any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..schema import INDEXED, SKELETON

# Line types that carry no events, keys that summarise a tool call in order, tools whose results are kept.
NOISE = ["system", "attachment", "mode", "file-history-snapshot", "last-prompt", "queue-operation", "ai-title"]
SUMMARY_KEYS = ["file_path", "command", "pattern", "query", "url", "path", "notebook_path"]
WEB_TOOLS = ["WebFetch", "WebSearch"]
FILE_TOOLS = ["Read", "Edit", "Write"]
BLOCKS = ["text", "thinking", "tool_use", "tool_result"]
ORDER = ["gen_ord", "line_no"]


def _text(v: str, path: str) -> Column:
    """A string at path of the variant column v; null for any other type."""
    return F.when(_is(v, path, "STRING"), F.try_variant_get(v, path, "string"))


def _type(v: str, path: str = "$") -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is(v: str, path: str, kind: str) -> Column:
    return F.coalesce(_type(v, path) == kind, F.lit(False))


def _has(v: str, key: str) -> Column:
    """Whether the key is there, even with a null."""
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


def split_valid(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with v (the parsed object), and those that are no JSON object. Blank lines are in neither."""
    parsed = lines.filter(F.length(F.trim("line")) > 0).withColumn("v", F.try_parse_json("line"))
    good = F.col("v").isNotNull() & F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    return parsed.filter(good), parsed.filter(~F.coalesce(good, F.lit(False))).drop("v")


def sessions(valid: DataFrame) -> DataFrame:
    """One row per session directory that has a sessionId: first non-empty values in read order, time range, generations."""
    at = F.struct(*ORDER)
    first = lambda path, name: F.min_by(_text("v", path), F.when(F.coalesce(_text("v", path), F.lit("")) != "", at)).alias(name)
    ts = _text("v", "$.timestamp")
    refs = F.transform(F.array_sort(F.collect_set(F.struct("gen_ord", "gen_ref"))), lambda x: x["gen_ref"])
    out = valid.groupBy("project", "session_dir").agg(first("$.sessionId", "session_id"), first("$.gitBranch", "git_branch"), first("$.version", "cc_version"), F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), first("$.aiTitle", "title"), refs.alias("archive_refs"))
    return out.filter("session_id is not null").select("session_dir", "session_id", "project", "git_branch", "cc_version", "started_at", "ended_at", F.lit(None).cast("string").alias("end_reason"), "title", "archive_refs")


def message_lines(valid: DataFrame) -> DataFrame:
    """User and assistant lines that are not machine noise, the first of each uuid (lines without a uuid are all kept)."""
    meta = F.coalesce(F.try_variant_get("v", "$.isMeta", "boolean"), F.lit(False)) & _is("v", "$.isMeta", "BOOLEAN")
    kind = _text("v", "$.type")
    rows = valid.filter(kind.isin("user", "assistant") & ~meta & ~_has("v", "hookInfos") & ~_has("v", "hookErrors")).withColumn("uuid", _text("v", "$.uuid"))
    w = Window.partitionBy("project", "session_dir", "uuid").orderBy(*ORDER)
    return rows.withColumn("_n", F.when(F.coalesce("uuid", F.lit("")) != "", F.row_number().over(w)).otherwise(1)).filter("_n = 1").drop("_n")


def _attribution() -> Column:
    out = F.lit(None).cast("string")
    for key in ("attributionPlugin", "attributionAgent", "attributionSkill"):
        path = f"$.{key}"
        text, name = _text("v", path), _text("v", f"{path}.name")
        other = F.when(F.startswith(F.coalesce(_type("v", path), F.lit("VOID")), F.lit("VOID")), None).otherwise(F.to_json(F.try_variant_get("v", path, "variant")))
        value = F.when(_is("v", path, "STRING"), F.nullif(text, F.lit(""))).otherwise(F.coalesce(name, other))
        out = F.coalesce(value, out)
    return out


def blocks(messages: DataFrame) -> DataFrame:
    """A row per content block: block_no, block_type and b (the block); a string content is one text block."""
    content = F.try_variant_get("v", "$.message.content", "variant")
    parts = F.when(F.startswith(_type("v", "$.message.content"), F.lit("ARRAY")), F.try_variant_get("v", "$.message.content", "array<variant>")).when(_is("v", "$.message.content", "STRING"), F.array(content))
    rows = messages.select("*", F.posexplode(parts).alias("block_no", "b"))
    kind = F.when(_is("b", "$", "STRING"), F.when(_is("v", "$.message.content", "STRING"), "text")).otherwise(_text("b", "$.type"))
    return rows.withColumn("block_type", kind).filter(F.col("block_type").isin(*BLOCKS))


def _block_text() -> Column:
    """What a block says, before its grain is known."""
    result = F.when(_is("b", "$.content", "STRING"), F.try_variant_get("b", "$.content", "string")).when(
        F.startswith(_type("b", "$.content"), F.lit("ARRAY")),
        F.nullif(F.array_join(F.array_compact(F.transform(F.try_variant_get("b", "$.content", "array<variant>"), lambda x: F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(x, "$.text", "variant")) == "STRING", F.try_variant_get(x, "$.text", "string")), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))))), "\n"), F.lit("")),
    )
    return (
        F.when(F.col("block_type") == "text", F.coalesce(_text("b", "$.text"), _text("b", "$")))
        .when(F.col("block_type") == "thinking", F.coalesce(_text("b", "$.thinking"), _text("b", "$.text")))
        .when(F.col("block_type") == "tool_use", F.coalesce(*(_text("b", f"$.input.{k}") for k in SUMMARY_KEYS)))
        .otherwise(result)
    )


def tool_calls(block: DataFrame) -> DataFrame:
    """Per session and tool-call id its tool and subagent type; the last definition wins."""
    calls = block.filter("block_type = 'tool_use'").select("project", "session_dir", _text("b", "$.id").alias("call_id"), _text("b", "$.name").alias("name"), _text("b", "$.input.subagent_type").alias("subagent"), F.struct(*ORDER, "block_no").alias("at"))
    return calls.filter("call_id is not null").groupBy("project", "session_dir", "call_id").agg(F.max_by("name", "at").alias("answers"))


def single_subagent_type(block: DataFrame) -> DataFrame:
    """Per session the subagent type, if its calls name exactly one."""
    kinds = block.filter("block_type = 'tool_use'").groupBy("project", "session_dir").agg(F.collect_set(_text("b", "$.input.subagent_type")).alias("kinds"))
    return kinds.select("project", "session_dir", F.when(F.size("kinds") == 1, F.col("kinds")[0]).alias("subagent_type"))


def grain(kind: Column, tool: Column) -> Column:
    return F.when(kind.isin("text", "tool_use") | ((kind == "tool_result") & F.coalesce(tool.isin(*WEB_TOOLS), F.lit(False))), INDEXED).otherwise(SKELETON)


def events(block: DataFrame, session: DataFrame) -> DataFrame:
    """Events in order of id, which follows (session_dir, generation, line, block)."""
    known = session.select("project", "session_dir", F.col("session_id").alias("logical"))
    rows = block.withColumn("call_id", _text("b", "$.tool_use_id")).join(known, ["project", "session_dir"]).join(tool_calls(block), ["project", "session_dir", "call_id"], "left").join(single_subagent_type(block), ["project", "session_dir"], "left")
    kind = F.col("block_type")
    tool = F.when(kind == "tool_use", _text("b", "$.name")).when(kind == "tool_result", F.col("answers"))
    side = F.coalesce(F.when(_is("v", "$.isSidechain", "BOOLEAN"), F.try_variant_get("v", "$.isSidechain", "boolean")), F.lit(False))
    g = grain(kind, tool)
    error = F.when((kind == "tool_result") & _is("b", "$.is_error", "BOOLEAN"), F.try_variant_get("b", "$.is_error", "boolean"))
    out = rows.select(
        "project", "session_dir", *ORDER, "block_no",
        F.coalesce("uuid", F.lit("")).alias("uuid"),
        _text("v", "$.parentUuid").alias("parent_uuid"),
        F.col("logical").alias("session_id"),
        F.coalesce(F.nullif(_text("v", "$.sessionId"), F.lit("")), F.col("logical")).alias("raw_session_id"),
        F.coalesce(_text("v", "$.message.role"), _text("v", "$.type")).alias("role"),
        kind.alias("kind"),
        _text("v", "$.timestamp").alias("timestamp"),
        F.when(g == INDEXED, fx.scrub(_block_text())).alias("text"),
        tool.alias("tool_name"),
        error.alias("is_error"),
        _attribution().alias("attribution"),
        side.alias("is_sidechain"),
        _text("v", "$.agentId").alias("agent_id"),
        F.when(side, F.col("subagent_type")).alias("agent_type"),
        g.alias("grain"),
    )
    # ids rise within a session; across sessions they only differ, so no global sort is needed
    n = F.row_number().over(Window.partitionBy("project", "session_dir").orderBy(*ORDER, "block_no"))
    return out.withColumn("id", n.cast("long"))


def prompts(block: DataFrame) -> DataFrame:
    """Blocks with request_bundle, the uuid of the nearest user text event before (or at) them in the session."""
    asked = F.when((F.coalesce(_text("v", "$.message.role"), _text("v", "$.type")) == "user") & (F.col("block_type") == "text"), F.col("uuid"))
    w = Window.partitionBy("project", "session_dir").orderBy(*ORDER, "block_no").rowsBetween(Window.unboundedPreceding, 0)
    return block.withColumn("request_bundle", F.last(asked, ignorenulls=True).over(w))


def mentions(block: DataFrame, session: DataFrame) -> DataFrame:
    """Files of Read, Edit and Write calls, and the commands of Bash calls."""
    rows = block.filter("block_type = 'tool_use' and uuid <> ''").join(session.select("project", "session_dir", "session_id"), ["project", "session_dir"])
    name = _text("b", "$.name")
    entity = F.when(name.isin(*FILE_TOOLS), _text("b", "$.input.file_path")).when(name == "Bash", fx.argv0(_text("b", "$.input.command")))
    kind = F.when(name == "Bash", "command").otherwise("file")
    return rows.select(entity.alias("entity"), kind.alias("entity_type"), F.col("uuid").alias("event_uuid"), "session_id", "project", _text("v", "$.timestamp").alias("timestamp")).filter("entity is not null")


def artifacts(block: DataFrame) -> DataFrame:
    """Written files, heredocs and fenced code, numbered per source uuid in order. Content is scrubbed."""
    name, kind = _text("b", "$.name"), F.col("block_type")
    path = _text("b", "$.input.file_path")
    body = F.when(name == "Write", _text("b", "$.input.content")).when(name == "Edit", _text("b", "$.input.new_string"))
    item = lambda k, p, lang, c: F.struct(F.lit(k).alias("kind"), p.cast("string").alias("path"), lang.cast("string").alias("language"), c.alias("content"))
    null = F.lit(None)
    rows = prompts(block).filter("uuid <> ''").withColumns({"_cmd": F.when((kind == "tool_use") & (name == "Bash"), _text("b", "$.input.command")), "_said": F.when(kind == "text", _block_text()), "_body": F.when(kind == "tool_use", body), "_path": path})
    made = F.concat(
        F.when(F.col("_body").isNotNull(), F.array(item("file", F.col("_path"), fx.ext_language(F.col("_path")), F.col("_body")))).otherwise(F.array().cast("array<struct<kind:string,path:string,language:string,content:string>>")),
        F.transform(F.coalesce(F.when(F.contains("_cmd", F.lit("<<")), fx.heredoc_bodies("_cmd")), F.array().cast("array<string>")), lambda x: item("heredoc", null, null, x)),
        F.transform(F.coalesce(F.when(F.contains("_said", F.lit("```")), fx.fenced_blocks("_said")), F.array().cast("array<struct<language:string,body:string>>")), lambda x: item("snippet", null, x["language"], x["body"])),
    )
    rows = rows.select("project", "session_dir", "uuid", *ORDER, "block_no", "request_bundle", F.posexplode(made).alias("item", "m"))
    n = F.row_number().over(Window.partitionBy("project", "session_dir", "uuid").orderBy(*ORDER, "block_no", "item")) - 1
    return rows.select("project", "session_dir", F.concat("uuid", F.lit("-"), n.cast("string")).alias("artifact_id"), "m.kind", "m.path", "m.language", fx.scrub(F.col("m.content")).alias("content"), "request_bundle", F.col("uuid").alias("source_event_uuid"))


def normalize(lines: DataFrame) -> dict[str, DataFrame]:
    """session, event, artifact, mention and quarantine of a table of raw lines."""
    valid, bad = split_valid(lines)
    session = sessions(valid)
    block = blocks(message_lines(valid))
    return {"session": session, "event": events(block, session), "artifact": artifacts(block), "mention": mentions(block, session), "quarantine": bad}


def to_records(tables: dict[str, DataFrame]) -> DataFrame:
    """Tagged JSON lines of the four tables (column value)."""
    out = None
    from ..schema import RECORDS

    for kind, schema in RECORDS.items():
        cols = [F.col(f.name) for f in schema.fields]
        own = tables[kind].select(F.to_json(F.struct(F.lit(kind).alias("type"), *cols)).alias("value"))
        out = own if out is None else out.unionByName(own)
    return out
