"""Record tables. Timestamps are RFC 3339 text and compare as text; ids keep the three spaces that search joins on
(event uuid, event vector uuid:ordinal, entity vector type:entity)."""

from pyspark.sql import types as T


def _table(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "b": T.BooleanType(), "l": T.LongType(), "a": T.ArrayType(T.StringType()), "v": T.ArrayType(T.FloatType())}
    out = []
    for part in spec.split():
        name, kind = part.split(":")
        out.append(T.StructField(name, kinds[kind[0]], not kind.endswith("!")))
    return T.StructType(out)


SESSION = _table("session_id:s! project:s! git_branch:s cc_version:s started_at:s ended_at:s end_reason:s title:s archive_refs:a")
EVENT = _table("uuid:s! parent_uuid:s session_id:s! role:s kind:s timestamp:s text:s tool_name:s is_error:b attribution:s is_sidechain:b! agent_id:s agent_type:s grain:s!")
ARTIFACT = _table("artifact_id:s kind:s path:s language:s content:s! request_bundle:s source_event_uuid:s!")
MENTION = _table("entity:s! entity_type:s! event_uuid:s! session_id:s! project:s! timestamp:s")
FTS = _table("content:s session_id:s source_type:s source_id:s")
VECTOR = _table("embedding:v project:s unit_kind:s source_id:s")
INGEST_LEDGER = _table("session_id:s! project:s! fingerprint:s! ingested_at:l!")
EMBED_LEDGER = _table("unit_kind:s! source_id:s! embedder_version:s! embedded_at:s! status:s! attempts:l! last_error:s")
EMBED_RUN = _table("id:l started_at:l! heartbeat_at:l! pid:l! state:s! total:l! embedded:l! skipped:l! failed:l!")
META = _table("key:s value:s")
VERSIONS = {"schema_version": "1", "parser_version": "1", "scrub_version": "1"}

RECORDS = {"session": SESSION, "event": EVENT, "artifact": ARTIFACT, "mention": MENTION}
INDEXED, SKELETON = "indexed", "skeleton"
