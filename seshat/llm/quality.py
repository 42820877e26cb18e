"""Quality scores by co-training of two views.

The content view sees what a text is made of (shares of letters, capitals, digits, symbols, repeated words ...), the
metadata view what is known of its page (language, source, length, layout in lines). Each has a logistic classifier,
first learned from the labelled rows. In each round it labels all unlabelled rows it is sure of (beyond CONFIDENT) and
hands them to the other view, which takes a Newton step on labelled and handed rows together; the handed rows weigh half
a labelled row each, and together at most half of all labelled rows. In the end each view's logit is calibrated, and both
are combined, by logistic regression on labelled rows kept out of the rounds.

Labelled rows are a bounded sample of at most LABELLED (never held-out ones). The unlabelled rows are all that are not
held out: a round sums their gradients and Hessians where they are, and the driver gets one matrix per view. The numbers
of both views are written once, so the texts are read once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, map_batches, staged

LABELLED = 20_000
ROUNDS = 4
CONFIDENT = 0.95
HASHED = 32  # numbers for languages and sources together
_KIND = np.zeros(256, np.int64)  # classes of bytes: letter, capital, digit, white space, other mark, symbol, stop, bang
for _k, _s in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n\x0b\x0c", b"\"'(),-/:;?@[\\]^_`{}~+=", b"#*$%&|<>", b".", b"!"), 1):
    _KIND[list(_s)] = _k


def content(text: str | None) -> list[float]:
    x = text or ""
    raw = x.encode("utf-8", "ignore")
    k = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8) / max(1, len(raw))
    words = x.split()
    n = max(1, len(words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    loud = sum(ch.isupper() for ch in x) / max(1, len(x))
    return [*k[:8].tolist(), *np.sqrt(k[4:8]).tolist(), len(x) / n / 10, len(set(words)) / n, again, again**0.5, loud, min(1.0, 3 * loud), min(1.0, 20 * float(k[5])), float(not words)]


def metadata(text: str | None, lang: str | None, source: str | None) -> list[float]:
    lines = (text or "").split("\n")
    size = len(text or "")
    hashed = [0.0] * HASHED
    for name, v in (("lang", lang), ("source", source)):
        hashed[zlib.crc32(f"{name}={v}".encode()) % HASHED] += 1.0
    return [np.log1p(size), np.log1p(size) ** 2 / 10, np.log1p(len(lines)), np.log1p(size / len(lines)), len(set(lines)) / len(lines), sum(not s.strip() for s in lines) / len(lines), float(size == 0), *hashed]


class Logistic:
    """Ridge logistic regression on standardised columns, by Newton's method."""

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, ridge: float = 1.0) -> Logistic:
        w = np.ones(len(y)) if w is None else w
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        b = np.zeros(z.shape[1])
        penalty = np.eye(len(b)) * ridge
        penalty[-1, -1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = np.linalg.solve((z * (w * p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (w * (y - p)) - penalty @ b)
            b += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        self.b = b
        return self

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradient, Hessian and number of rows, flat: sums over rows, so those of parts add up."""
        z = np.hstack([np.clip((x - self.mean) / self.scale, -20, 20), np.ones((len(x), 1))])
        p = 1 / (1 + np.exp(-np.clip(z @ self.b, -30, 30)))
        return np.concatenate([z.T @ (y - p), ((z * (p * (1 - p) + 1e-9)[:, None]).T @ z).ravel(), [float(len(y))]])

    def step(self, total: np.ndarray, ridge: float = 1.0) -> Logistic:
        """The classifier one Newton step on, from (weighted) sums; steps are rounded, as the order of a sum is left to Spark."""
        n = len(self.b)
        penalty = np.eye(n) * ridge
        penalty[-1, -1] = 1e-6
        out = Logistic()
        out.mean, out.scale = self.mean, self.scale
        out.b = np.round(self.b + np.clip(np.linalg.solve(total[n:-1].reshape(n, n) + penalty, total[:n] - penalty @ self.b), -5, 5), 8)
        return out

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -20, 20)
        return np.clip(z @ self.b[:-1] + self.b[-1], -30, 30)

    def prob(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


class CoTrained:
    """Both views' classifiers and the combination. views: content and metadata matrices of the labelled rows.

    `handed` takes the two classifiers and gives, for each, the sums over the rows that the other one is sure of.
    """

    def __init__(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, handed: Callable[[list[Logistic]], list[np.ndarray]]):
        self.constant = None
        if len(y) < 10 or len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        kept = np.arange(len(y)) % 5 == 0  # for the calibration
        train = [(v[~kept], y[~kept]) for v in views]
        self.views = [Logistic().fit(*t) for t in train]
        for _ in range(ROUNDS):
            others = handed(self.views)
            weights = [min(0.5, 0.5 * len(t) / max(1.0, o[-1])) for (_, t), o in zip(train, others, strict=True)]
            self.views = [m.step(m.sums(*t) + w * o) for m, t, w, o in zip(self.views, train, weights, others, strict=True)]
        logits = [m.logit(v[kept]) for m, v in zip(self.views, views, strict=True)]
        self.calibrated = [Logistic().fit(s[:, None], y[kept]) for s in logits]
        self.both = Logistic().fit(np.stack([c.logit(s[:, None]) for c, s in zip(self.calibrated, logits, strict=True)], axis=1), y[kept])

    def score(self, views: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, and each view's calibrated probability."""
        if self.constant is not None:
            return (np.full(len(views[0]), self.constant),) * 3
        own = [c.logit(m.logit(v)[:, None]) for c, m, v in zip(self.calibrated, self.views, views, strict=True)]
        return self.both.prob(np.stack(own, axis=1)), 1 / (1 + np.exp(-own[0])), 1 / (1 + np.exp(-own[1]))


WIDE = len(content("")), len(metadata("", None, None))


def views(docs: DataFrame) -> DataFrame:
    """i (doc_id) and the numbers of both views, a and m, of each row of doc_id, text, lang, source."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, langs, sources = (b.column(k).to_pylist() for k in (1, 2, 3))
        a, m = [content(x) for x in texts], [metadata(*x) for x in zip(texts, langs, sources, strict=True)]
        return pa.record_batch([b.column(0), pa.array(a, pa.list_(pa.float32())), pa.array(m, pa.list_(pa.float32()))], names=["i", "a", "m"])

    rows = docs.select(F.col("doc_id").cast("long").alias("i"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")))
    return map_batches(rows, fn, "i long, a array<float>, m array<float>")


def _matrices(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(b.column(k).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, n) for k, n in zip((1, 2), WIDE, strict=True))


def _handed(pool: DataFrame, models: list[Logistic]) -> list[np.ndarray]:
    """For each view the sums over all pool rows that the other view is sure of, added up by Spark."""
    size = [n + 1 + (n + 1) ** 2 + 1 for n in WIDE]

    def run(batches):
        total = np.zeros(sum(size))
        for b in batches:
            x = _matrices(b)
            for k, at in ((0, 0), (1, size[0])):
                p = models[1 - k].prob(x[1 - k])
                sure = (p >= CONFIDENT) | (p <= 1 - CONFIDENT)
                if sure.any():
                    total[at : at + size[k]] += models[k].sums(x[k][sure], (p[sure] > 0.5).astype(float))
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["k", "v"])

    got = pool.select("i", "a", "m").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()  # a row per place of two matrices
    total = np.zeros(sum(size))
    total[got["k"].to_numpy(int)] = got["v"].to_numpy(float)
    return [total[: size[0]], total[size[0] :]]


def learn_views(rows: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = LABELLED) -> CoTrained:
    """From `views` and labels (doc_id, 0 or 1; other rows are left out) that are not held out."""
    own = rows.filter(F.col("i").isNotNull() & ~held_out("i"))
    y = labels.filter(F.col(label_col).isin(0, 1)).select(F.col("doc_id").cast("long").alias("i"), F.col(label_col).cast("double").alias("y")).groupBy("i").agg(F.min("y").alias("y")).filter(F.col("i").isNotNull() & ~held_out("i"))
    got = own.join(F.broadcast(bounded_sample(y, "i", most)), "i").toPandas()  # at most about `most` rows of numbers
    got["key"] = [(i, tuple(a), tuple(m)) for i, a, m in zip(got["i"], got["a"], got["m"], strict=True)]
    got = got.sort_values("key", kind="stable")
    known = tuple(np.array(got[c].tolist(), float).reshape(len(got), n) for c, n in zip("am", WIDE, strict=True))
    pool = staged(own.join(y, "i", "left_anti"), "unlabelled")
    return CoTrained(known, got["y"].to_numpy(float), lambda models: _handed(pool, models))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = LABELLED) -> CoTrained:
    return learn_views(staged(views(docs), "views"), labels, label_col, most)


def score_views(rows: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """`score_quality` of rows whose numbers `views` has written."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b.column(0), *(pa.array(v, pa.float64()) for v in model.score(_matrices(b)))], names=["i", "score", "content_score", "metadata_score"])

    out = map_batches(rows.select("i", "a", "m"), fn, "i long, score double, content_score double, metadata_score double")
    return out.select(F.col("i").alias("doc_id"), held_out("i").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "content_score", "metadata_score")


def score_quality(docs: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """For each row doc_id, held_out, score (0 to 1, higher: better), predicted (1 from the threshold on), content_score and metadata_score.

    Null texts are scored like empty ones, null languages and sources as a value of their own; null and repeated ids
    like others. Of few labels (under 10, or of one value) the score is their mean, or 0.5. Other columns are ignored.
    """
    return score_views(views(docs), model, threshold)
