"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, and the words of a clause become classes: insult, threat, person spoken to, person spoken
about, copula, intent, negation, report, other. Five small transducers read the same class sequence:

* insult     1 for an insult in a frame: soon after a person spoken to ("you idiot"), after a person and a copula
             ("they are scum"), before a person spoken to ("idiot, you ..."), or next to another insult;
             an insult outside every frame is only marked as lone;
* threat     1 for a threat that a person spoken to, or after a word of intent any person, follows within a few words;
* target     raises what stands near a person spoken to or about;
* negation   lowers what follows a negation within its reach;
* report     lowers what follows a report verb (said, called ...) in the clause.

They are composed once, as the product of their reachable states, into a single transducer whose weight is
(insult + threat) * target * negation * report. A text's clauses add up, with two exceptions: of all that negation or
report has lowered only the strongest counts, so quoting texts do not pass the threshold by length; and a lone insult
counts LONE once a word, however often it is repeated, so that it alone stays below the threshold and only several
different ones pass it. The score is a logistic function of that sum.

The insults are seeded with words that have no everyday use, and learned from labelled texts: words and word beginnings
(4 to 8 letters) whose odds in toxic texts are high. How often one occurs counts contexts (its neighbours) beside
documents, as a word repeated in copies of one text is no evidence. Labels also lower the seeds: one that is seen in
labelled texts weighs what its odds say. Learning takes a bounded sample of labelled rows, about SAMPLE at most; the
lexicon is whatever that sample holds.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, give_back, held_out, map_batches

SAMPLE = 20_000
PREFIXES = range(4, 9)
LEAST_ODDS = 3.0  # natural logarithm
FULL_ODDS = 6.0  # odds of weight 1
LEAST_CONTEXTS = 5
LONE = 0.4
MIDDLE, STEEP = 0.42, 10.0  # of the logistic function

# The seed words of the classes.
INSULTS = "idiot idiots moron morons imbecile imbeciles scum scumbag scumbags loser losers stupid worthless pathetic disgusting".split()
THREATS = "kill killing hurt destroy beat smash burn shoot stab crush punish eliminate".split()
SPOKEN_TO = "you your yours yourself u ya tu te toi vous usted du dich dir ihr euch".split()
SPOKEN_ABOUT = "he him his she her they them their those these people everyone everybody il elle ils er sie ella ellos".split()
COPULAS = "is are am was were be been being re s look looks sound sounds ist sind bist es est sont eres son".split()
INTENTS = "will ll gonna going must should want wants deserve deserves".split()
NEGATIONS = "not never isn't aren't wasn't don't doesn't didn't won't hardly".split()
REPORTS = "said says say saying called calls wrote writes claimed claims quoted quote reported reports alleged tweeted".split()

OTHER, INSULT, THREAT, YOU, THEY, COPULA, INTENT, NEGATION, REPORT = range(9)
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
CLAUSE = re.compile(r"[.!?;:\n|]+")


class Transducer:
    """A deterministic weighted machine over word classes: step(state, class) gives (state, weight)."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def _insult(reach: int = 4, near: int = 3) -> Transducer:
    """States: what frame is open (none, a person spoken to, a person waiting for a copula, one with it) and for how
    many words; words for which the last insult is near, and whether it still waits for a frame."""
    none, you, person, copula = range(4)

    def step(s, c):
        frame, left, close, waits = s
        weight = 0.0
        if c == INSULT:
            framed = frame in (you, copula) or close > 0
            weight, close, waits = float(framed), near, not framed
        else:
            if c == YOU and close > 0 and waits:
                weight, waits = 1.0, False
            close = max(0, close - 1)
            waits = waits and close > 0
        left -= 1
        if c in (YOU, THEY):
            frame, left = you if c == YOU else person, reach
        elif c == COPULA and frame in (you, person):
            frame, left = copula, reach
        elif left <= 0:
            frame, left = none, 0
        return (frame, left, close, waits), weight

    return Transducer((none, 0, 0, False), step)


def _threat(reach: int = 3, before: int = 4) -> Transducer:
    """States: words left since a word of intent, words left in which a target completes a threat, whether that had an intent."""

    def step(s, c):
        intent, open_, meant = s
        if c == INTENT:
            return (before, max(0, open_ - 1), meant and open_ > 1), 0.0
        left = max(0, intent - 1)
        if c == THREAT:
            return (left, reach, intent > 0), 0.0
        if open_ > 0 and (c == YOU or c == THEY and meant):
            return (left, 0, False), 1.0
        return (left, max(0, open_ - 1), meant and open_ > 1), 0.0

    return Transducer((0, 0, False), step)


def _near(marks: tuple[int, ...], weight: float, reach: int) -> Transducer:
    """weight within `reach` words after a word of these classes, else 1."""

    def step(s, c):
        return (reach, 1.0) if c in marks else (max(0, s - 1), weight if s > 0 else 1.0)

    return Transducer(0, step)


def compose(insult: Transducer, threat: Transducer, target: Transducer, negation: Transducer, report: Transducer) -> tuple[list[list[int]], list[list[tuple[float, float]]]]:
    """The product of the machines over its reachable states: tables [state][class] of the next state and of the weight and
    the part of it that negation and report leave (1: all)."""
    machines = (insult, threat, target, negation, report)
    first = tuple(m.start for m in machines)
    number, todo, nexts, weights = {first: 0}, [first], [], []
    for state in todo:
        to, w = [], []
        for c in range(9):
            got = [m.step(s, c) for m, s in zip(machines, state, strict=True)]
            after = tuple(g[0] for g in got)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            to.append(number[after])
            w.append(((got[0][1] + got[1][1]) * math.prod(g[1] for g in got[2:]), got[3][1] * got[4][1]))
        nexts.append(to)
        weights.append(w)
    return nexts, weights


MACHINES = (_insult(), _threat(), _near((YOU, THEY), 1.25, 4), _near((NEGATION,), 0.3, 3), _near((REPORT,), 0.3, 8))
GRAMMAR = compose(*MACHINES)


class Scorer:
    """Scores texts with a lexicon of insults: words {word: weight} and beginnings of words {beginning: weight}, weights 0 to 1."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = {w: x for w, x in {**{w: 1.0 for w in INSULTS}, **words}.items() if x > 0}, stems
        self.lengths = sorted({len(s) for s in stems})
        lists = ((THREAT, THREATS), (YOU, SPOKEN_TO), (THEY, SPOKEN_ABOUT), (COPULA, COPULAS), (INTENT, INTENTS), (NEGATION, NEGATIONS), (REPORT, REPORTS))
        self.classes = {w: k for k, ws in lists for w in ws}
        self.seen: dict[str, tuple[int, float]] = {}

    def kind(self, word: str) -> tuple[int, float]:
        got = self.seen.get(word)
        if got is None:
            weight = self.words.get(word, 0.0)
            for n in self.lengths:
                if len(word) > n:
                    weight = max(weight, self.stems.get(word[:n], 0.0))
            got = (INSULT, weight) if weight else (self.classes.get(word, OTHER), 1.0)
            if got[0] == OTHER and "'" in word:  # you're, they'll
                whole, _, end = word.rpartition("'")
                got = (self.classes.get(whole, OTHER), 1.0) if end in ("re", "s", "ll", "ve", "d") else got
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = got
        return got

    def clause(self, words: list[str]) -> tuple[float, float, dict[str, float]]:
        """What the clause adds: its whole weight, the strongest lowered step, and its lone insults with their weights."""
        nexts, weights = GRAMMAR
        state, whole, lowered, own = 0, 0.0, 0.0, 1.0
        lone: dict[str, float] = {}
        last = None
        for w in words:
            c, x = self.kind(w)
            weight, left = weights[state][c]
            state = nexts[state][c]
            if c == INSULT:
                last, own = w, x
                if not weight:
                    if left < 1:
                        lowered = max(lowered, LONE * left * x)
                    else:
                        lone[w] = LONE * x
            if weight:
                weight *= own if c in (INSULT, YOU) and last else 1.0
                if c == YOU and last:
                    lone.pop(last, None)
                if left < 1:
                    lowered = max(lowered, weight)
                else:
                    whole += weight
        return whole, lowered, lone

    def clauses(self, text: str | None) -> Iterator[tuple[int, int, float, float, dict[str, float]]]:
        """Start and end of each clause that matches, in characters of the lower-cased text, and what `clause` gives."""
        if not text:
            return
        low = text.lower()
        if not any(self.kind(w)[0] in (INSULT, THREAT) for w in set(WORD.findall(low))):
            return
        at = 0
        for m in [*CLAUSE.finditer(low), None]:
            end = m.start() if m else len(low)
            if end > at:
                words = WORD.findall(low, at, end)
                if any(self.kind(w)[0] in (INSULT, THREAT) for w in words):
                    whole, lowered, lone = self.clause(words)
                    if whole or lowered or lone:
                        yield at, end, whole, lowered, lone
            at = m.end() if m else end

    def total(self, clauses) -> float:
        """A text's score from what its clauses add."""
        whole, lowered, lone = 0.0, 0.0, {}
        for _, _, w, less, own in clauses:
            whole, lowered = whole + w, max(lowered, less)
            lone.update(own)
        return 1 / (1 + math.exp(STEEP * (MIDDLE - max(whole + sum(lone.values()), lowered))))

    def score(self, text: str | None) -> float:
        return self.total(self.clauses(text))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts and labels: for each word ('=word') or beginning, texts with label 1 and 0, and a 62-bit sketch of contexts in toxic ones."""
    names = ["f", "toxic", "clean", "ctx"]

    def flush(found):
        f, v = list(found), list(found.values())
        return pa.record_batch([pa.array(f, pa.string()), *(pa.array([x[i] for x in v], pa.int64()) for i in range(3))], names=names)

    found: dict[str, list[int]] = {}
    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own: dict[str, int] = {}
            words = WORD.findall((text or "").lower())
            padded = ["", *words, ""]
            for i, w in enumerate(words):
                ctx = 1 << (zlib.crc32(f"{padded[i]} {padded[i + 2]}".encode()) % 62) if label else 0
                own["=" + w] = own.get("=" + w, 0) | ctx
            for w, ctx in list(own.items()):
                for n in PREFIXES:
                    if len(w) - 1 > n:
                        p = w[1 : n + 1]
                        own[p] = own.get(p, 0) | ctx
            for f, ctx in own.items():
                x = found.setdefault(f, [0, 0, 0])
                x[0 if label else 1] += 1
                x[2] |= ctx
            if len(found) > 300_000:
                yield flush(found)
                found = {}
    if found:
        yield flush(found)
    give_back()


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """A scorer from rows with a text and a label of 0 or 1 (rows with another label or none are left out); of no rows, the seeds alone."""
    rows = labelled.select(F.col(text_col).cast("string").alias("x"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1)")
    totals = rows.groupBy("y").count().collect()
    n1, n0 = (next((r["count"] for r in totals if r["y"] == y), 0) for y in (1, 0))
    if not n1:
        return Scorer({}, {})
    counts = rows.mapInArrow(_counts, "f string, toxic long, clean long, ctx long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("ctx").alias("ctx"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    seed = F.col("f").isin(["=" + w for w in INSULTS])
    # what the bounded sample holds, and the seeds that it holds
    found = counts.withColumn("odds", odds).filter(seed | (F.bit_count("ctx") >= LEAST_CONTEXTS) & (F.col("odds") >= LEAST_ODDS)).collect()
    words, stems = {}, {}
    for r in sorted(found, key=lambda r: (len(r.f), r.f)):
        weight = max(0.0, min(1.0, r.odds / FULL_ODDS))
        if r.f[0] == "=":
            words[r.f[1:]] = weight
        elif not any(r.f[:k] in stems for k in PREFIXES):
            stems[r.f] = weight
    return Scorer(words, stems)


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = SAMPLE) -> DataFrame:
    """Texts with their label, of at most about `most` rows that are not held out."""
    own = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", label_col).dropDuplicates(["doc_id"])
    sample = bounded_sample(own, "doc_id", most)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most about `most` rows of two numbers


def score_toxicity(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """For each row the id, held_out, score (0 to 1), predicted (1 from the threshold on) and clauses, the matched clauses
    (start and end in characters of the lower-cased text; weight, that of its patterns; lone, its insults outside one). Null and empty texts score as a text without a match.
    Rows with null or repeated ids are scored like others; other columns are ignored; an empty table gives none."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        score, found = [], []
        for x in b.column(1).to_pylist():
            own = list(scorer.clauses(x))
            found.append([{"start": s, "end": e, "weight": w + less, "lone": sorted(lone)} for s, e, w, less, lone in own])
            score.append(scorer.total(own))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64()), ("lone", pa.list_(pa.string()))]))
        return pa.record_batch([b.column(0), pa.array(score, pa.float64()), pa.array(found, kind)], names=["_d", "score", "clauses"])

    out = map_batches(docs.select(F.col(id_col).cast("long").alias("_d"), F.col(text_col).cast("string").alias("_x")), fn, "_d long, score double, clauses array<struct<start:long,end:long,weight:double,lone:array<string>>>")
    return out.select(F.col("_d").alias(id_col), held_out("_d").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "clauses")


def without_toxic(docs: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose text scores at the threshold or above, all columns as they were."""
    at = docs.columns.index(text_col)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array([scorer.score(x) < threshold for x in b.column(at).to_pylist()], pa.bool_()))

    return map_batches(docs, fn, docs.schema)
