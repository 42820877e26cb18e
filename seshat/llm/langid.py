"""Language identification by multilingual mixture inference.

A text is a mixture of languages: each of its letter trigrams comes from language l with a share pi_l and is then drawn
with p(gram | l). Expectation-maximisation finds the shares of each text. The set of languages is the one among the
nested sets of the likeliest 1, 2 ... all languages with the best likelihood less PENALTY * log(trigrams) per language.

Likelihoods are learned from labelled texts, of which a bounded sample of at most SAMPLE rows is taken. As only ratios
between languages matter to the shares, every gram is replaced by its nearest of CODES vectors of such ratios, found by
weighted k-means; a text is then a histogram over the codes, and the EM of thousands of texts is one matrix product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import C1, U
from .common import bounded_sample, held_out, map_batches, slices, text_buffer

SAMPLE = 20_000
GRAMS = 15  # bits of a gram's number
CODES = 256
PENALTY = 3.0
ROUNDS = 12
SMOOTH = 0.5
BLOCK = 1 << 20
_LETTERS = np.array([b if 97 <= b < 123 or b >= 128 else 32 for b in range(256)], np.uint8)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the letter trigrams (in bytes, lower case) of all texts, and the text of each; never across texts."""
    buf, off = text_buffer(pa.array([" " + (x or "").lower() + " " for x in texts], pa.large_string()))
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _LETTERS[buf].astype(np.uint64)
    n = (((b[:-2] << U(16)) | (b[1:-1] << U(8)) | b[2:]) * C1) >> U(64 - GRAMS)
    of = np.repeat(np.arange(len(texts)), np.diff(off))[: len(n)]
    use = (b[1:-1] != 32) & (of == np.repeat(np.arange(len(texts)), np.diff(off))[2:])
    return n[use].astype(np.int64), of[use]


class Model:
    """languages, and for each gram the number of its code; codes: ratios of p(gram | language), rows adding up to 1."""

    def __init__(self, languages: list[str], code: np.ndarray, codes: np.ndarray):
        self.languages, self.code, self.codes = languages, code, codes

    def _shares(self, h: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of each text (rows of h are histograms over the codes) in its allowed languages, and the log-likelihood."""
        n = np.maximum(h.sum(axis=1, keepdims=True), 1)
        p = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
        for _ in range(ROUNDS):
            p = p * ((h / np.maximum(p @ self.codes.T, 1e-12)) @ self.codes) / n
        return p, (h * np.log(np.maximum(p @ self.codes.T, 1e-12))).sum(axis=1)

    def infer(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the shares of all languages (0 outside the selected set), and how many are selected."""
        count = len(self.languages)
        if not count:
            return np.zeros((len(texts), 0)), np.zeros(len(texts), int)
        h = np.zeros((len(texts), len(self.codes)))
        size = np.array([len(x or "") + 2 for x in texts])
        for p, q in slices(size, BLOCK):
            g, of = grams(texts[p:q])
            h[p:q] = np.bincount(of * len(self.codes) + self.code[g], minlength=(q - p) * len(self.codes)).reshape(q - p, -1)
        whole, _ = self._shares(h, np.ones((len(texts), count)))
        rank = np.argsort(np.argsort(-whole, axis=1, kind="stable"), axis=1)
        best, shares, chosen = np.full(len(texts), -np.inf), whole, np.zeros(len(texts), int)
        price = PENALTY * np.log(np.maximum(h.sum(axis=1), 2))
        for s in range(1, count + 1):
            p, ll = self._shares(h, (rank < s).astype(float))
            better = ll - s * price > best
            best = np.where(better, ll - s * price, best)
            shares, chosen = np.where(better[:, None], p, shares), np.where(better, s, chosen)
        return shares, chosen


def _codebook(ratio: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, and the centres: weighted k-means, begun at quantiles of the rows' order."""
    order = np.lexsort(ratio.T)
    upto = np.cumsum(weight[order])
    centres = ratio[order[np.minimum(np.searchsorted(upto, (np.arange(k) + 0.5) / k * upto[-1]), len(order) - 1)]]
    for _ in range(10):
        near = np.argmin((centres**2).sum(axis=1) - 2 * ratio @ centres.T, axis=1)
        w = np.bincount(near, weight, minlength=k)
        total = np.stack([np.bincount(near, weight * ratio[:, c], minlength=k) for c in range(ratio.shape[1])], axis=1)
        centres = np.where(w[:, None] > 0, total / np.maximum(w, 1e-9)[:, None], centres)
    near = np.argmin((centres**2).sum(axis=1) - 2 * ratio @ centres.T, axis=1)
    return near, centres


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> Model:
    """A model of the languages in lang_col of rows with text and language that are not held out."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("x"), F.col(lang_col).cast("string").alias("l")).filter(F.col("x").isNotNull() & F.col("l").isNotNull() & F.col("i").isNotNull() & ~held_out("i"))

    def fn(b: pa.RecordBatch):
        langs = b.column(2).to_pylist()
        names = sorted(set(langs))
        for p, q in slices(np.array([len(x) + 2 for x in b.column(1).to_pylist()]), BLOCK):
            g, of = grams(b.column(1).slice(p, q - p).to_pylist())
            own = np.array([names.index(x) for x in langs[p:q]], np.int64)[of] if len(of) else of
            n = np.bincount((own << GRAMS) | g)
            k = np.flatnonzero(n)
            yield pa.record_batch([pa.array([names[i] for i in k >> GRAMS], pa.string()), pa.array(k & ((1 << GRAMS) - 1), pa.int64()), pa.array(n[k], pa.int64())], names=["l", "g", "n"])

    counts = map_batches(bounded_sample(rows, "i", most), fn, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toPandas()  # at most 2^GRAMS rows a language
    languages = sorted(counts["l"].unique())
    if not languages:
        return Model([], np.zeros(1 << GRAMS, np.int64), np.zeros((CODES, 0)))
    n = np.zeros((1 << GRAMS, len(languages)))
    n[counts["g"].to_numpy(), [languages.index(x) for x in counts["l"]]] = counts["n"]
    p = (n + SMOOTH) / (n.sum(axis=0) + SMOOTH * len(n))
    code, codes = _codebook(p / p.sum(axis=1, keepdims=True), p.sum(axis=1), CODES)
    return Model(languages, code, codes)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row the id, held_out, lang_pred, score (the predicted language's share) and languages, the selected set with shares.

    Texts that are null or have no letter, and all texts under a model of no language, are `und` with score 0 and no
    languages. Ties go to the first language by name. Null or repeated ids are like others; other columns are ignored.
    """

    def fn(b: pa.RecordBatch):
        for at in range(0, b.num_rows, 2000):
            texts = b.column(1).slice(at, 2000).to_pylist()
            shares, chosen = model.infer(texts)
            pred, score, sets = [], [], []
            for x, p, s in zip(texts, shares, chosen, strict=True):
                if not x or not s or not any(map(str.isalpha, x)):
                    pred.append("und")
                    score.append(0.0)
                    sets.append([])
                    continue
                top = np.argsort(-p, kind="stable")[:s]
                pred.append(model.languages[top[0]])
                score.append(min(1.0, float(p[top[0]])))
                sets.append([{"lang": model.languages[k], "share": float(p[k])} for k in top])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.record_batch([b.column(0).slice(at, 2000), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, kind)], names=["d", "lang_pred", "score", "languages"])

    out = map_batches(docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("x")), fn, "d long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    return out.select(F.col("d").alias(id_col), held_out("d").alias("held_out"), "lang_pred", "score", "languages")
