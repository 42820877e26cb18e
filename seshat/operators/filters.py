"""Structural predicates shared by every search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """Conditions that apply where they are set; bounds are inclusive, and a null timestamp fails any bound."""

    entity_type: str | None = None
    project: str | None = None
    since: str | None = None
    until: str | None = None

    @property
    def timed(self) -> bool:
        return self.since is not None or self.until is not None

    def apply(self, df: DataFrame, *skip: str) -> DataFrame:
        for name in ("entity_type", "project"):
            value = getattr(self, name)
            if value is not None and name not in skip:
                df = df.filter(F.col(name) == value)
        return self.in_time(df)

    def in_time(self, df: DataFrame, column: str = "timestamp") -> DataFrame:
        if self.since is not None:
            df = df.filter(F.col(column) >= self.since)
        if self.until is not None:
            df = df.filter(F.col(column) <= self.until)
        return df
