"""Interpolated Kneser-Ney character models, one per class, in arrays sorted by hash.

Only n-grams of the highest order are counted from texts; the lower orders of such a model are made of distinct types,
so they follow from that table. Counting and the steps between orders are Spark aggregations over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayweave.llm.base import arrow, stored

ORDER = 4
#: Table cells (n-grams times classes) of a model that is to be ``bounded``; beyond, it is built with a lower order.
MODEL_CELLS = 20_000_000
START, GAP = 1, 32
#: Characters scored at a time.
SLICE = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """Code of each character: letters as 16 bits, all else the gap."""
    codes = np.full(0x110000, GAP, dtype=np.uint16)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()], dtype=np.int64)
    codes[letters] = np.where(letters < 0x10000, letters, 0xD800 + letters % 2048)
    return codes


def coded(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, lower-case, each after ``order - 1`` start codes, runs of other characters as one gap; and
    the number of codes of each text, starts included."""
    raw = [("\x01" * (order - 1) + t.lower()).encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.array([len(r) // 4 for r in raw], dtype=np.int64)
    points = np.frombuffer(b"".join(raw), dtype="<u4")
    codes = letter_codes()[np.minimum(points, 0x10FFFF)]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for k in range(order - 1):
        codes[starts + k] = START
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~((codes[1:] == GAP) & (codes[:-1] <= GAP))
    counts = np.add.reduceat(keep, starts) if len(starts) else sizes
    return codes[keep], counts


def grams(codes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Packed n-gram that ends at each code; of no use before the first full one."""
    out = codes.astype(np.uint64)
    for k in range(1, order):
        out[k:] |= codes[:-k].astype(np.uint64) << np.uint64(16 * k)
    return out


def count_grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of whole texts and how often each occurs. Some texts and a slice of their codes go at a time: the
    arrays between take some ten times the bytes of the text."""
    kinds, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at, size = 0, 0
    for end in range(1, len(texts) + 1):  # a text longer than a slice goes alone
        size += len(texts[end - 1])
        if size < SLICE and end < len(texts):
            continue
        codes, _ = coded(texts[at:end], order)
        at, size = end, 0
        for begin in range(0, len(codes), SLICE):
            before = min(begin, order - 1)  # codes that the first n-grams of the slice reach back to
            part = codes[begin - before:begin + SLICE]
            more, m = np.unique(grams(part, order)[before:][part[before:] != START], return_counts=True)
            kinds, row = np.unique(np.concatenate([kinds, more]), return_inverse=True)
            total = np.zeros(len(kinds), dtype=np.int64)
            np.add.at(total, row, np.concatenate([n, m]))
            n = total
    return kinds, n


def gram_counts(docs: DataFrame, class_col: str, text_col: str, order: int = ORDER) -> DataFrame:
    """``cls, gram, n`` over all rows with a text and a class."""
    schema = pa.schema([("cls", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(classes)):
                kinds, n = count_grams([t for c, t in zip(classes, texts) if c == name], order)
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(kinds), pa.string()), pa.array(kinds.view(np.int64)), pa.array(n)], schema=schema)

    rows = docs.select(F.col(class_col).cast("string").alias("cls"), F.col(text_col).alias("text")).filter(
        "cls is not null and text is not null")
    return stored(arrow(rows, count, "cls string, gram bigint, n bigint").groupBy("cls", "gram").agg(F.sum("n").alias("n")))


class HashArray:
    """Rows found by key: keys sorted by hash, with an index of the leading hash bits."""

    def __init__(self, keys: np.ndarray):
        spread = keys * _MIX
        self.order = np.argsort(spread, kind="stable")
        self.spread = spread[self.order]
        self.bits = max(1, int(len(keys)).bit_length() + 1)
        self.first = np.searchsorted(self.spread, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key in sorted order, -1 where it is unknown."""
        want = keys * _MIX  # an odd factor: different keys stay different
        at = self.first[(want >> np.uint64(64 - self.bits)).astype(np.int64)]
        out = np.full(len(keys), -1, dtype=np.int32)
        if not len(self.spread):
            return out
        last, open_ = len(self.spread) - 1, np.arange(len(keys))
        while len(open_):
            here = self.spread[np.minimum(at, last)]
            goal = want[open_]
            hit = (here == goal) & (at <= last)
            out[open_[hit]] = at[hit]
            more = (here < goal) & (at < last)
            open_, at = open_[more], at[more] + 1
        return out


class KneserNey:
    """Log probabilities of the last character of an n-gram, one column per class."""

    def __init__(self, classes: list[str], cls: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int = ORDER):
        self.classes, self.order = classes, order
        width = len(classes)
        levels = {order: (cls, gram, n)}
        for k in range(order - 1, 0, -1):  # continuation counts: distinct characters before
            c, g, _ = levels[k + 1]
            low = g & np.uint64((1 << (16 * k)) - 1)
            kinds, m = np.unique(np.stack([c.astype(np.uint64), low], 1), axis=0, return_counts=True)
            levels[k] = (kinds[:, 0].astype(np.int64), kinds[:, 1], m)
        alphabet = max(2, len(np.unique(levels[1][1])) + 1)
        self.tables: dict[int, tuple[HashArray, np.ndarray]] = {}
        self.backs: dict[int, tuple[HashArray, np.ndarray]] = {}
        self.floor = np.full(width, np.log(1 / alphabet), dtype=np.float32)
        for k in range(1, order + 1):
            c, g, m = levels[k]
            ones = np.bincount(c[m == 1], minlength=width).astype(float)
            twos = np.bincount(c[m == 2], minlength=width).astype(float)
            discount = np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5)
            discount = np.clip(discount, 0.05, 0.95)
            context = g >> np.uint64(16)
            contexts, inverse = np.unique(context, return_inverse=True)
            cell = inverse * width + c
            total = np.bincount(cell, weights=m, minlength=len(contexts) * width).reshape(len(contexts), width)
            kinds = np.bincount(cell, minlength=len(contexts) * width).reshape(len(contexts), width)
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            keys, row = np.unique(g, return_inverse=True)
            ctx_row = np.searchsorted(contexts, keys >> np.uint64(16))
            count = np.zeros((len(keys), width))
            count[row, c] = m
            lower = np.exp(self._score(keys & np.uint64((1 << (16 * (k - 1))) - 1), k - 1))
            own = np.maximum(count - discount, 0) / np.maximum(total[ctx_row], 1)
            prob = np.where(total[ctx_row] > 0, own + back[ctx_row] * lower, lower)
            table, backs = HashArray(keys), HashArray(contexts)
            self.tables[k] = (table, np.log(prob).astype(np.float32)[table.order])
            self.backs[k] = (backs, np.log(back).astype(np.float32)[backs.order])

    def _score(self, keys: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.broadcast_to(self.floor, (len(keys), len(self.classes)))
        table, logs = self.tables[k]
        row = table.rows(keys)
        out = logs[np.maximum(row, 0)]
        unseen = np.flatnonzero(row < 0)
        if len(unseen):
            own = keys[unseen]
            backs, weights = self.backs[k]
            at = backs.rows(own >> np.uint64(16))
            weight = np.where(at[:, None] >= 0, weights[np.maximum(at, 0)], 0)
            out[unseen] = weight + self._score(own & np.uint64((1 << (16 * (k - 1))) - 1), k - 1)
        return out

    def score(self, keys: np.ndarray) -> np.ndarray:
        """``len(keys)`` rows of log probabilities."""
        return self._score(keys & np.uint64((1 << (16 * self.order)) - 1), self.order)

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log probability per character of each text and class; and the characters of each text."""
        codes, counts = coded(texts, self.order)
        keys, text = grams(codes, self.order), np.repeat(np.arange(len(texts)), counts)
        keys, text = keys[codes != START], text[codes != START]
        sums = np.zeros((len(texts), len(self.classes)))
        for at in range(0, len(keys), SLICE):  # a slice of characters at a time, whole texts all the same
            logs, own = self.score(keys[at:at + SLICE]), text[at:at + SLICE]
            for k in range(len(self.classes)):
                sums[own[0]:own[-1] + 1, k] += np.bincount(own - own[0], weights=logs[:, k])
        chars = counts - (self.order - 1)
        return -sums / np.maximum(chars, 1)[:, None], chars


def fit(docs: DataFrame, class_col: str, text_col: str, order: int = ORDER, bounded: bool = True) -> KneserNey:
    """Model of all rows with a text and a class. The table of n-grams comes to the driver; if ``bounded``, its cells are
    counted first, and beyond ``MODEL_CELLS`` the order is lowered. The operators take the whole model of the one order."""
    counts = gram_counts(docs, class_col, text_col, order)
    classes = [r[0] for r in counts.select("cls").distinct().orderBy("cls").collect()]
    while bounded and order > 1 and counts.select("gram").distinct().count() * max(1, len(classes)) > MODEL_CELLS:
        order -= 1
        counts = stored(counts.groupBy("cls", F.col("gram").bitwiseAND((1 << (16 * order)) - 1).alias("gram")).agg(F.sum("n").alias("n")))
    # numbers alone, no text a row
    number = F.array_position(F.array(*map(F.lit, classes)), F.col("cls")) - 1 if classes else F.lit(0)
    got = counts.select(number.cast("bigint").alias("cls"), "gram", "n").toPandas()
    return KneserNey(classes, got["cls"].to_numpy(dtype=np.int64), got["gram"].to_numpy(dtype=np.int64).view(np.uint64),
                     got["n"].to_numpy(dtype=np.int64), order)
