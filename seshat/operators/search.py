"""Exact listing, BM25 keyword search, two-stage vector search and their fusion.

Keyword search works on an inverted index, (term, document, places, document length), written sorted by term, so that a
query reads the row groups of its terms and shuffles only their postings. Ties are broken by key throughout.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions import vectors as vx
from .filters import Filters

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
OVERFETCH, LEAST_COARSE = 8, 64
RRF, VECTOR_HITS = 60, 50


def exact_listing(mention: DataFrame, entity: str, filters: Filters = Filters()) -> DataFrame:
    """Every session that mentions the entity, with its first time; in order of time (nulls first), then id."""
    return exact_unordered(mention, entity, filters).orderBy(F.asc_nulls_first("first_ts"), "session_id")


def exact_unordered(mention: DataFrame, entity: str, filters: Filters = Filters()) -> DataFrame:
    return filters.apply(mention.filter(F.col("entity") == entity)).groupBy("session_id").agg(F.min("timestamp").alias("first_ts"))


@dataclass
class Index:
    """An inverted index: postings (term, doc, places, length), and the number and mean length of all documents.

    only, if set, makes the postings of some terms from the table itself, as nothing is written."""

    postings: DataFrame
    documents: int
    mean_length: float
    only: Callable[[list[str]], DataFrame] | None = None

    def of(self, words: list[str]) -> DataFrame:
        return self.only(words) if self.only else self.postings.filter(F.col("term").isin(words))


def postings(docs: DataFrame, key: str, content: str, words: list[str] | None = None) -> DataFrame:
    """term, doc, places (from 0) and the document's length in terms, of these words or all. One shuffle, of terms by document."""
    cut = docs.select(F.col(key).alias("doc"), fx.terms(F.col(content)).alias("t"))
    if words is not None:
        cut = cut.filter(F.arrays_overlap("t", F.array(*map(F.lit, words))) if words else F.lit(False))
    each = cut.select("doc", F.size("t").alias("length"), F.posexplode("t").alias("place", "term"))
    each = each if words is None else each.filter(F.col("term").isin(words))
    return each.groupBy("term", "doc").agg(F.sort_array(F.collect_list("place")).alias("places"), F.first("length").alias("length"))


def build_index(docs: DataFrame, key: str, content: str, path: str | None = None) -> Index:
    """The index of a table; with a path, written there in order of term and read back."""
    size = docs.agg(F.count("*").alias("n"), F.avg(fx.term_count(F.col(content))).alias("mean")).first()
    rows = postings(docs, key, content)
    if path:
        rows.repartitionByRange(F.col("term"), F.col("doc")).sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(path)
        rows = docs.sparkSession.read.parquet(path)
    return Index(rows, size["n"], size["mean"] or 0.0, None if path else lambda words: postings(docs, key, content, words))


def keyword_hits(index: Index, query: str) -> DataFrame:
    """doc and rank (BM25, more negative is better) of the documents where every phrase of the query occurs.

    A phrase's idf counts all documents, whatever filters follow. A query without a term finds nothing.
    """
    phrases = fx.query_phrases(query)
    words = sorted({w for p in phrases for w in p})
    rows = index.of(words)
    per = rows.groupBy("doc").agg(F.first("length").alias("length"), *(F.first(F.when(F.col("term") == w, F.col("places")), ignorenulls=True).alias(f"t{i}") for i, w in enumerate(words)))
    counts = []
    for k, p in enumerate(phrases):
        places = F.col(f"t{words.index(p[0])}")
        for shift, w in enumerate(p[1:], 1):
            back = F.expr(f"transform(t{words.index(w)}, x -> x - {shift})")  # where the phrase would begin
            places = F.array_intersect(places, back)
        counts.append(F.coalesce(F.size(places), F.lit(0)).alias(f"f{k}"))
    per = per.select("doc", "length", *counts)
    if not phrases:
        return per.select("doc", F.lit(0.0).alias("rank")).filter(F.lit(False))
    having = per.agg(*(F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(phrases)))).first()
    score = F.lit(0.0)
    for k in range(len(phrases)):
        n, f = having[k], F.col(f"f{k}")
        idf = F.log(F.lit((index.documents - n + 0.5) / (n + 0.5)))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / (index.mean_length or 1.0)))
    every = F.lit(True)
    for k in range(len(phrases)):
        every = every & (F.col(f"f{k}") > 0)
    return per.filter(every).select("doc", score.alias("rank"))


def keyword_search(index: Index, fts: DataFrame, query: str, filters: Filters = Filters(), session: DataFrame | None = None, event: DataFrame | None = None, artifact: DataFrame | None = None) -> DataFrame:
    """Hits of fts (doc, session_id, source_type, source_id) with rank, best first.

    A project keeps hits whose session belongs to it (semi-join). A time bound needs event and artifact: a hit's time is
    the earliest of its event, for an artifact that of its source event.
    """
    hits = keyword_hits(index, query).join(fts.select("doc", "session_id", "source_type", "source_id"), "doc")
    if filters.project is not None:
        hits = hits.join(session.filter(F.col("project") == filters.project), "session_id", "left_semi")
    if filters.timed:
        first = event.groupBy("uuid").agg(F.min("timestamp").alias("timestamp"))
        of_artifact = artifact.select(F.col("artifact_id").alias("source_id"), F.col("source_event_uuid").alias("_src"))
        hits = hits.join(of_artifact, "source_id", "left").withColumn("uuid", F.when(F.col("source_type") == "event", F.col("source_id")).otherwise(F.col("_src")))
        hits = filters.in_time(hits.join(first, "uuid", "left")).drop("uuid", "_src", "timestamp")
    return hits.orderBy("rank", "doc")


def exact_topk(vectors: DataFrame, query: list[float], k: int, key: str = "source_id") -> DataFrame:
    """The k nearest by cosine distance, then key."""
    return vectors.withColumn("distance", vx.cosine_distance(query)(F.col("embedding"))).filter("distance is not null").orderBy("distance", key).limit(k)


def two_stage_topk(vectors: DataFrame, query: list[float], k: int, key: str = "source_id") -> DataFrame:
    """max(8 k, 64) nearest by Hamming distance of sign bits, of which the k nearest by cosine distance."""
    code = F.array(*(F.lit(x).cast("long") for x in vx.pack_bits(query)))
    coded = vectors if "coarse" in vectors.columns else vectors.withColumn("coarse", vx.quantize(F.col("embedding")))
    near = coded.withColumn("bits", vx.hamming(F.col("coarse"), code)).orderBy("bits", key).limit(max(OVERFETCH * k, LEAST_COARSE))
    return exact_topk(near.drop("bits"), query, k, key)


def window_ids(filters: Filters, event: DataFrame, artifact: DataFrame, mention: DataFrame) -> DataFrame:
    """(unit_kind, source_id) of every unit with a time in the bounds: events by uuid:ordinal, artifacts, entities."""
    from .profiles import event_ordinals

    events = filters.in_time(event_ordinals(event)).select(F.lit("event").alias("unit_kind"), "source_id")
    artifacts = artifact.join(filters.in_time(event).select(F.col("uuid").alias("source_event_uuid")), "source_event_uuid", "left_semi").select(F.lit("artifact").alias("unit_kind"), F.col("artifact_id").alias("source_id"))
    entities = filters.in_time(mention).select(F.lit("entity").alias("unit_kind"), F.concat_ws(":", "entity_type", "entity").alias("source_id"))
    return events.union(artifacts).union(entities).distinct()


def vector_search(vectors: DataFrame, query: list[float], k: int = VECTOR_HITS, filters: Filters = Filters(), in_window: DataFrame | None = None) -> DataFrame:
    """Nearest units. Without a time bound two stages; with one, the units in it first and then exactly."""
    if filters.project is not None:
        vectors = vectors.filter(F.col("project") == filters.project)
    if in_window is not None:
        return exact_topk(vectors.join(in_window, ["unit_kind", "source_id"], "left_semi"), query, k)
    return two_stage_topk(vectors, query, k)


def batch_vector_search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "source_id", block: int = 2048) -> DataFrame:
    """query_id, key and distance of the k nearest vectors of each row of queries (query_id, embedding).

    The queries are a stated set and go over the vectors in blocks; each batch of vectors gives its k best per query,
    and the best of those remain, ties by key as in exact_topk. Zero vectors have no distance.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = max(1, -(-queries.count() // block))
    kind, out = vectors.schema[key].dataType.simpleString(), None
    for part in range(n):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == part).select("query_id", "embedding").collect()
        if not own:
            continue
        ids, q = [r.query_id for r in own], np.array([r.embedding for r in own], float)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def fn(batches, ids=ids, q=q):
            for b in batches:
                m = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, q.shape[1])
                size = np.linalg.norm(m, axis=1)
                m, b = m[size > 0] / size[size > 0, None], b.filter(pa.array(size > 0))  # a zero vector has no distance
                place = pc.sort_indices(b.column(0)).to_numpy()  # ties by key
                m, keys = m[place], b.column(0).take(pa.array(place)).to_pylist()
                top = np.argsort((d := 1 - q @ m.T).round(12), axis=1, kind="stable")[:, :k]
                yield pa.record_batch([pa.array(np.repeat(ids, top.shape[1])), pa.array([keys[j] for j in top.ravel()], b.schema.field(0).type), pa.array(np.take_along_axis(d, top, 1).ravel())], names=["query_id", key, "distance"])

        rows = vectors.filter("embedding is not null")
        best = rows.select(key, "embedding").mapInArrow(fn, f"query_id long, {key} {kind}, distance double")
        out = best if out is None else out.unionByName(best)
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 12), key)
    return out.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k)


def arm(hits: DataFrame, order: list[str]) -> DataFrame:
    """Sessions of one ranking in order of their best hit: session_id, target of that hit, place (from 1).

    One place per session, so the sort in one partition is over distinct sessions among the hits."""
    best = Window.partitionBy("session_id").orderBy(*order)
    first = hits.withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    return first.select("session_id", "target", F.row_number().over(Window.orderBy(*order, "session_id")).alias("place"))


def fuse(keyword: DataFrame, vector: DataFrame | None) -> DataFrame:
    """session_id, score (sum of 1 / (60 + place)) and target, the keyword one where there is one; best first."""
    both = keyword.withColumn("arm", F.lit(0))
    if vector is not None:
        both = both.unionByName(vector.withColumn("arm", F.lit(1)))
    return both.groupBy("session_id").agg(F.sum(1 / (F.lit(float(RRF)) + F.col("place"))).alias("score"), F.min_by("target", "arm").alias("target")).orderBy(F.desc("score"), "session_id")


def vector_sessions(hits: DataFrame, event: DataFrame, artifact: DataFrame, mention: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Vector hits (unit_kind, source_id, distance) as sessions with a target (type, id).

    An event resolves by its uuid, an artifact by its source event, an entity to every session whose mentions meet the
    same filters. Where an id belongs to several sessions the smallest is taken; hits without a session are dropped.
    """
    of_uuid = event.groupBy("uuid").agg(F.min("session_id").alias("session_id"))
    hit = hits.select("unit_kind", "source_id", "distance")
    target = lambda kind, i: F.struct(F.lit(kind).alias("source_type"), i.alias("source_id"))
    uuid = F.substring_index("source_id", ":", 1)
    events = hit.filter("unit_kind = 'event'").withColumn("uuid", uuid).join(of_uuid, "uuid").select("session_id", target("event", F.col("uuid")).alias("target"), "distance", "source_id")
    artifacts = hit.filter("unit_kind = 'artifact'").join(artifact.select(F.col("artifact_id").alias("source_id"), F.col("source_event_uuid").alias("uuid")), "source_id").join(of_uuid, "uuid").select("session_id", target("artifact", F.col("source_id")).alias("target"), "distance", "source_id")
    seen = filters.apply(mention, "entity_type").filter("event_uuid is not null").groupBy("entity_type", "entity", "session_id").agg(F.min("event_uuid").alias("event_uuid"))
    entities = hit.filter("unit_kind = 'entity'").withColumns({"entity_type": F.substring_index("source_id", ":", 1), "entity": F.expr("substring(source_id, instr(source_id, ':') + 1)")}).join(seen, ["entity_type", "entity"]).select("session_id", target("event", F.col("event_uuid")).alias("target"), "distance", "source_id")
    return events.union(artifacts).union(entities)


@dataclass
class Ranked:
    """Fused sessions, and whether (and why) the vector arm is missing."""

    sessions: DataFrame
    degraded: bool = False
    degraded_reason: str | None = None


def ranked_search(index: Index, tables: dict[str, DataFrame], query: str, embed: Callable[[str], list[float]], filters: Filters = Filters(), k: int = VECTOR_HITS) -> Ranked:
    """Keyword and vector arms fused by session. If the query can't be embedded, the keyword arm alone, marked degraded."""
    t = tables
    hits = keyword_search(index, t["fts"], query, filters, t["session"], t["event"], t["artifact"])
    keyword = arm(hits.withColumn("target", F.struct("source_type", "source_id")), ["rank", "doc"])
    try:
        q = embed(query)
    except Exception as e:  # the embedder is the caller's
        return Ranked(fuse(keyword, None), True, str(e))
    window = window_ids(filters, t["event"], t["artifact"], t["mention"]) if filters.timed else None
    near = vector_search(t["vector"], q, k, filters, window)
    vector = arm(vector_sessions(near, t["event"], t["artifact"], t["mention"], filters), ["distance", "source_id"])
    return Ranked(fuse(keyword, vector))
