"""Vector functions: sign-bit codes, Hamming distance, cosine distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(v: Column) -> Column:
    """Signs (x > 0) packed into longs, 64 a word, first element in the lowest bit."""
    words = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 64).cast("int"))
    bits = F.transform(v, lambda x: F.when(x > 0, 1).otherwise(0))
    return F.transform(words, lambda w: F.aggregate(F.slice(bits, w * 64 + 1, 64), F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).alias("i")), lambda a, b: F.struct(a["x"].bitwiseOR(F.call_function("shiftleft", b.cast("long"), a["i"])).alias("x"), (a["i"] + 1).alias("i")))["x"])


def pack_bits(v: list[float]) -> list[int]:
    """quantize of a single vector, on the driver."""
    x = np.asarray(v) > 0
    x = np.concatenate([x, np.zeros(-len(x) % 64, bool)])
    return np.packbits(x.reshape(-1, 64), axis=1, bitorder="little").view(np.int64).ravel().tolist()


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def cosine_distance(query: list[float]):
    """A column function: 1 - cosine to the query, in double precision; null for a null or a zero vector."""
    q = np.asarray(query, float)
    q = q / (np.linalg.norm(q) or 1.0)

    @F.pandas_udf("double")
    def distance(v: pd.Series) -> pd.Series:
        ok = v.notna()
        out = pd.Series(np.nan, index=v.index)
        if ok.any():
            m = np.vstack(v[ok].to_numpy()).astype(float)
            size = np.linalg.norm(m, axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[ok] = 1 - (m @ q) / size
        return out.where(np.isfinite(out), None)

    return distance
