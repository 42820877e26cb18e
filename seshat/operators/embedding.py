"""Embedders and the drain that keeps vectors in step with profile units."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ledgers

BATCH = 32
INSTRUCTION = "Instruct: Given a search query, retrieve passages of past sessions that answer it\nQuery: "


class Embedder(Protocol):
    version: str
    width: int

    def documents(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic embedder that needs no service: signed hashed words and word beginnings, of unit length."""

    def __init__(self, width: int = 64):
        self.width, self.version = width, f"hash-{width}/profile-2"

    def one(self, text: str) -> list[float]:
        v = np.zeros(self.width)
        for w in text.lower().split():
            for part in (w, w[:4]):
                h = zlib.crc32(part.encode())
                v[h % self.width] += 1 if h >> 31 else -1
        size = np.linalg.norm(v)
        return (v / size if size else v).tolist()

    def documents(self, texts: list[str]) -> list[list[float]]:
        return [self.one(t) for t in texts]

    def query(self, text: str) -> list[float]:
        return self.one(text)


def query_text(query: str) -> str:
    """A query with its instruction frame; documents have none."""
    return INSTRUCTION + query


def embed_query(embedder, query: str) -> list[float]:
    """Embedders with a query method get the query as it is, others the framed text."""
    own = embedder.query(query) if hasattr(embedder, "query") else embedder.documents([query_text(query)])[0]
    if len(own) != embedder.width:
        raise ValueError(f"the embedder gave {len(own)} numbers, not {embedder.width}")
    return own


def _checked(embedder: Embedder, texts: list[str]) -> list[list[float]]:
    got = embedder.documents(texts)
    if len(got) != len(texts) or any(len(v) != embedder.width for v in got):
        raise ValueError("the embedder gave another count or width than asked for")
    return got


def embed_units(units: DataFrame, embedder: Embedder) -> DataFrame:
    """Units with embedding or error. A batch that fails is tried again unit by unit, so one bad unit fails alone."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                texts = [x or "" for x in part.column(3).to_pylist()]
                try:
                    got = [(v, None) for v in _checked(embedder, texts)]
                except Exception:
                    got = []
                    for x in texts:
                        try:
                            got.append((_checked(embedder, [x])[0], None))
                        except Exception as e:
                            got.append((None, str(e)))
                yield pa.record_batch([*(part.column(k) for k in range(3)), pa.array([g[0] for g in got], pa.list_(pa.float32())), pa.array([g[1] for g in got], pa.string())], names=["unit_kind", "source_id", "project", "embedding", "last_error"])

    return units.select("unit_kind", "source_id", "project", "text").mapInArrow(run, "unit_kind string, source_id string, project string, embedding array<float>, last_error string")


def drain(units: DataFrame, vectors: DataFrame, ledger: DataFrame, embedder: Embedder, now: str, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Embed what is pending. Returns vectors and ledger after it, and counts of embedded, skipped and failed.

    `keep` writes a table (vectors before ledger) and reads it back, so that the embedder runs once per unit.
    """
    todo = ledgers.pending(units, ledger, embedder.version)
    got = keep(embed_units(todo, embedder), "embedded")
    fresh = got.filter("embedding is not null").select("embedding", "project", "unit_kind", "source_id")
    current = ledgers.current_vectors(vectors, ledger, embedder.version).join(fresh, ["unit_kind", "source_id"], "left_anti")
    after = keep(current.select("embedding", "project", "unit_kind", "source_id").unionByName(fresh), "vector")
    news = got.select("unit_kind", "source_id", F.lit(embedder.version).alias("embedder_version"), F.lit(now).alias("embedded_at"), F.when(F.col("embedding").isNotNull(), "done").otherwise("failed").alias("status"), "last_error")
    book = keep(ledgers.upsert(ledger, news), "embed_ledger")
    counts = got.agg(F.count("embedding").alias("ok"), F.count("*").alias("all")).first()
    return after, book, {"embedded": counts["ok"], "failed": counts["all"] - counts["ok"], "skipped": units.count() - counts["all"]}
