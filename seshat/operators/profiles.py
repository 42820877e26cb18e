"""Profile documents: what entities, artifacts and events look like to the embedder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..schema import INDEXED

USAGE = 8
UNIT = ["unit_kind", "source_id", "project", "text"]


def spoken(event: DataFrame) -> DataFrame:
    return event.filter((F.col("grain") == INDEXED) & F.col("text").isNotNull())


def event_ordinals(event: DataFrame) -> DataFrame:
    """Indexed events with text, and source_id = uuid:ordinal, the place among those of one uuid by id."""
    n = F.row_number().over(Window.partitionBy("uuid").orderBy("id"))
    return spoken(event).withColumn("ordinal", n).withColumn("source_id", F.concat("uuid", F.lit(":"), F.col("ordinal").cast("string")))


def modal_project(mention: DataFrame) -> DataFrame:
    """Per entity its most frequent project; of several the first by name."""
    counts = mention.groupBy("entity_type", "entity", "project").count()
    best = Window.partitionBy("entity_type", "entity").orderBy(F.desc("count"), "project")
    return counts.withColumn("n", F.row_number().over(best)).filter("n = 1").select("entity_type", "entity", F.col("project").alias("modal_project"))


def aliases(mention: DataFrame) -> DataFrame:
    """Per entity the other spellings (equal but for case) of its type."""
    own = mention.select("entity_type", "entity").distinct().withColumn("low", F.lower("entity"))
    spelled = own.groupBy("entity_type", "low").agg(F.sort_array(F.collect_set("entity")).alias("every"))
    return own.join(spelled, ["entity_type", "low"]).select("entity_type", "entity", F.array_remove("every", F.col("entity")).alias("aliases"))


def cooccurring(mention: DataFrame) -> DataFrame:
    """Per entity the other entities of its events, sorted. Distinct mentions are joined, not rows."""
    m = mention.select("event_uuid", "entity_type", "entity").distinct()
    other = mention.select("event_uuid", F.col("entity").alias("other")).distinct()
    return m.join(other, "event_uuid").filter("other <> entity").groupBy("entity_type", "entity").agg(F.sort_array(F.collect_set("other")).alias("cooccurring"))


def usage(mention: DataFrame, event: DataFrame) -> DataFrame:
    """Per entity the earliest indexed text (undated first) and the first texts by order."""
    said = mention.select("entity_type", "entity", F.col("event_uuid").alias("uuid")).distinct().join(spoken(event).select("uuid", "text", "timestamp", "id"), "uuid")
    key = ["entity_type", "entity"]
    first = said.groupBy(*key).agg(F.min_by("text", F.struct(F.col("timestamp").isNotNull(), F.coalesce("timestamp", F.lit("")), "id")).alias("intro"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("text"))
    texts = said.select(*key, "text").distinct().withColumn("n", nth).filter(F.col("n") <= USAGE).groupBy(*key).agg(F.sort_array(F.collect_list("text")).alias("usage"))
    return first.join(texts, key)


def _list(label: str, items: str):
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(items, ", "), F.lit("\n")))


def entity_units(mention: DataFrame, event: DataFrame) -> DataFrame:
    key = ["entity_type", "entity"]
    out = mention.groupBy(*key).agg(F.sort_array(F.collect_set("project")).alias("projects"))
    for part in (modal_project(mention), aliases(mention), cooccurring(mention), usage(mention, event)):
        out = out.join(part, key, "left")
    used = F.when(F.size("usage") > 0, F.concat(F.lit("usage:\n"), F.array_join(F.transform("usage", lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")))
    text = F.concat_ws("", F.concat("entity_type", F.lit(": "), "entity", F.lit("\n")), _list("aliases", "aliases"), F.concat(F.lit("intro: "), "intro", F.lit("\n")), used, _list("co-occurring", "cooccurring"), _list("projects", "projects"))
    return out.select(F.lit("entity").alias("unit_kind"), F.concat_ws(":", *key).alias("source_id"), F.col("modal_project").alias("project"), text.alias("text"))


def artifact_units(artifact: DataFrame, event: DataFrame, session: DataFrame) -> DataFrame:
    """One unit per artifact with an event in a known session; the earliest event by id decides the project."""
    of_event = event.join(session.select("session_id", "project"), "session_id").groupBy(F.col("uuid").alias("source_event_uuid")).agg(F.min_by("project", "id").alias("project"))
    asked = event.filter("text is not null").groupBy(F.col("uuid").alias("request_bundle")).agg(F.min_by("text", "id").alias("request"))
    out = artifact.join(of_event, "source_event_uuid").join(asked, "request_bundle", "left").withColumn("signature", fx.signature_lines(F.col("content")))
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.col(c), F.lit("\n"))
    signed = F.when(F.size("signature") > 0, F.concat(F.lit("signature:\n"), F.array_join("signature", "\n"), F.lit("\n")))
    return out.select(F.lit("artifact").alias("unit_kind"), F.col("artifact_id").alias("source_id"), "project", F.concat_ws("", line("request", "request"), line("path", "path"), line("language", "language"), signed).alias("text"))


def event_units(event: DataFrame, session: DataFrame) -> DataFrame:
    return event_ordinals(event).join(session.select("session_id", "project"), "session_id").select(F.lit("event").alias("unit_kind"), "source_id", "project", "text")


def assemble(tables: dict[str, DataFrame]) -> DataFrame:
    """All units: unit_kind, source_id, project, text."""
    t = tables
    return entity_units(t["mention"], t["event"]).union(artifact_units(t["artifact"], t["event"], t["session"])).union(event_units(t["event"], t["session"]))
