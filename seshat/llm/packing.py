"""Harmonic packing of token ids into sequences of at most CAPACITY tokens.

Lengths fall into reciprocal-capacity classes, and a class of length n fills its sequences with exactly
floor(CAPACITY / n) pieces each. A document is cut so that its pieces have class lengths: as long as more than
SMALL ids are left, the largest floor(CAPACITY / k) that fits is cut off; the last SMALL or fewer are one piece, in
the class of just their length. So a full sequence is padded by fewer than SMALL + 1 tokens, mostly none, and only the
last sequence of each class (CLASSES of them in the whole corpus) can be short.

Each worker numbers its own pieces class by class. A table of counts by worker and class, summed over the workers
before, turns those numbers into numbers of the whole class; no piece is sorted or gathered for that.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, slices, staged

CAPACITY = 4096
SMALL = 64
END = 2  # the id after each document
CACHE = 250_000  # words remembered, forgotten when so many
SLICE = 2 << 20  # bytes of texts encoded together
SEQUENCES = 1 << 40  # sequence ids of a class

# Fixed value: the word pattern of the vocabulary's pre-tokenizer.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# The same words but for those of letters, which then lie between them and white space.
BETWEEN = r"('s|'t|'re|'ve|'m|'ll|'d|\pN|[^\t\n\x0b\x0c\r \pL\pN]+)"
# What makes a text more than lower-casing of Latin letters between plain white space: other letters and marks,
# separators that libraries see differently, a letter of two in lower case, the vocabulary's own marks.
ODD = r"[^\x00-\x{17f}]|[\x1c-\x1f\x{85}\x{a0}\x{130}]|<\|"


class Encoder:
    """Ids of texts as the tokenizer file gives them, without special tokens.

    The vocabulary's words never cross white space. Plain texts (no ODD) are lower-cased and split into words by Arrow,
    whole slices at a time; only the distinct words of a slice are looked up, and only new ones reach the library. Odd
    texts go by white-space chunks: a chunk that is plain is split by PRETOKEN, any other goes to the library whole, as
    do texts with separators that Python and the library see differently.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = iter(range(256, 512))
        self.alphabet = {b: b if b in set(visible) else next(rest) for b in range(256)}
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {"": 0}  # of a word or odd chunk
        self.ids, self.ends = array("i"), array("i", [0, 0])

    def add(self, key: str, ids: list[int]) -> int:
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        self.number[key] = n = len(self.ends) - 2
        return n

    def word(self, w: str) -> int:
        """Number of a new word of plain letters, a digit, or signs."""
        shown = w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.alphabet)
        return self.add(w, [t.id for t in self.whole.model.tokenize(shown)])

    def chunk(self, c: str) -> list[int]:
        """Numbers of the words of a white-space chunk, or of the whole chunk if it is not plain."""
        low, get = c.lower(), self.number.get
        if "<|" not in c and all(ch < "\u0180" and ch != "\u0130" for ch in c):
            return [n if (n := get(w)) is not None else self.word(w) for w in PRETOKEN.findall(low)]
        key = f" {c}"  # no word begins with a space
        return [n if (n := get(key)) is not None else self.add(key, self.whole.encode(c, add_special_tokens=False).ids)]

    def known(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words known, end to end, and where each begins; copies, as the arrays grow."""
        return np.array(self.ids, np.int32), np.array(self.ends, np.int64)

    def plain(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of plain texts. Each distinct chunk is split into words once, each distinct word of those looked up once."""
        by_text = pc.ascii_split_whitespace(texts)
        chunks = by_text.flatten().dictionary_encode()
        by_chunk = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(chunks.dictionary), BETWEEN, r" \1 "))
        words, get = by_chunk.flatten().dictionary_encode(), self.number.get
        numbers = np.array([n if (n := get(w)) is not None else self.word(w) for w in words.dictionary.to_pylist()], np.int32)
        ids, ends = gathered(*self.known(), numbers[words.indices.to_numpy()])
        ids, ends = gathered(ids, ends[_ends(by_chunk)], chunks.indices.to_numpy())
        return np.split(ids, ends[_ends(by_text)[1:-1]])

    def odd(self, text: str) -> list[int]:
        """Numbers of what an odd text consists of."""
        if _SEPARATED(text):
            key = f"  {text}"
            n = self.add(key, self.whole.encode(text, add_special_tokens=False).ids)
            del self.number[key]  # texts are not remembered
            return [n]
        return [n for c in text.split() for n in self.chunk(c)]

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; none is null."""
        if len(self.ends) > CACHE:
            self.forget()
        odd = pc.match_substring_regex(texts, ODD)
        plain = iter(self.plain(texts.filter(pc.invert(odd))))
        numbers = {i: np.array(self.odd(texts[i].as_py()), np.int32) for i, o in enumerate(odd.to_pylist()) if o}
        known = self.known() if numbers else ()
        return [gathered(*known, numbers[i])[0] if i in numbers else next(plain) for i in range(len(texts))]


def gathered(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `which` of values, of which run i is from ends[i] to ends[i + 1], end to end, and their ends."""
    size = ends[which + 1] - ends[which]
    upto = np.concatenate([[0], np.cumsum(size)])
    return values[np.arange(upto[-1]) + np.repeat(ends[which] - upto[:-1], size)], upto


def _ends(lists: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)])


_SEPARATED = regex.compile(r"[\x1c-\x1f\x85\u180e\u200b\u2028\u2029\ufeff]").search


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder, whose memory of words lasts from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def class_length(left: int) -> int:
    """Length of the next piece of a document with so many ids left."""
    return left if left <= SMALL else CAPACITY // -(-CAPACITY // left) if left <= CAPACITY else CAPACITY


def cut(n: int) -> list[int]:
    out = []
    while n > 0:
        out.append(class_length(n))
        n -= out[-1]
    return out


PIECES = "part long, doc long, start long, length int, ids_crc32 long, doc_tokens long, nth long, ids array<int>"


def _pieces(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known, count = TaskContext.get().partitionId(), encoder(path), {}
        for b in batches:
            texts = b.column(1).fill_null("")
            for p, q in slices(pc.binary_length(texts).to_numpy(), SLICE):
                docs = b.column(0).slice(p, q - p).to_pylist()
                own = [np.append(x, END).astype("<u4") for x in known.batch(texts.slice(p, q - p))]
                rows = []
                for d, ids in zip(docs, own, strict=True):
                    start = 0
                    for n in cut(len(ids)):
                        count[n] = count.get(n, -1) + 1
                        rows.append((part, d, start, n, zlib.crc32(ids[start : start + n]), len(ids), count[n]))
                        start += n
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                if with_ids:  # pieces lie end to end, as the documents do
                    ends = np.cumsum([0, *(r[3] for r in rows)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).astype(np.int32))))
                else:
                    columns.append(pa.nulls(len(rows), pa.list_(pa.int32())))
                yield pa.record_batch(columns, names=[c.split()[0] for c in PIECES.split(", ")])
        give_back()

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: the id, start (ids before it), length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds ids.

    tokenizer is the path of the vocabulary file, which every executor can open. Null and empty texts are one piece,
    the end id alone. Rows with null or repeated ids are each packed; other columns are ignored; an empty table gives
    no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("x"))
    pieces = staged(rows.mapInArrow(_pieces(tokenizer, with_ids), PIECES), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    at = F.col("nth") + F.col("before")
    per = F.expr(f"{CAPACITY} div length")
    return pieces.join(before, ["part", "length"]).select(
        F.col("doc").alias(id_col),
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("length") * F.lit(SEQUENCES) + F.floor(at / per)).cast("long").alias("sequence_id"),
        (at % per * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
