"""Operator 5, packing by minimum bin slack.

Documents are cut at the window size; what remains of each is a length below it. The number of remainders of each
length, a table of at most ``capacity`` rows however many documents there are, is all the driver needs: bitset
subset-sum dynamic programming picks the multiset of lengths that fills a window closest to capacity, the counts are
traced back, and that window is repeated as often as the counts allow. So the plan is a bounded list of patterns.
Pieces are numbered per length (per task, plus the counts of the tasks before), and a number falls into one pattern,
repetition and slot by arithmetic. What no exact window takes lies end to end and is cut at window borders; the last
window is cut into powers of two.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayweave.llm.base import arrow, stored, text_of
from stayweave.llm.tokens import encoder

CAPACITY = 1024
PLACES = "array<struct<at:int,length:int,sequence_id:bigint,offset:int>>"


def best_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Multiset of the given lengths, the largest one in it, whose sum comes closest to ``capacity`` from below."""
    largest = max(counts)
    room = capacity - largest
    left = Counter(counts)
    left[largest] -= 1
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((n for n, c in left.items() if c and n <= room), reverse=True):
        many, chunk = min(left[length], room // length), 1
        while many:
            take = min(chunk, many)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            many, chunk = many - take, chunk * 2
        if reach >> room & 1:
            break
    total, found = reach.bit_length() - 1, Counter({largest: 1})
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            found[length] += take
            total -= length * take
    return dict(found)


def window_plan(counts: dict[int, int], capacity: int, cut: bool = True) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """``[(window, times)]`` and the lengths left over. With ``cut``, only windows without slack are taken, as the rest
    can be cut to fill; without it, every length is placed."""
    left, plan = {n: c for n, c in counts.items() if c}, []
    stuck: dict[int, int] = {}
    while left:
        window = best_window(left, capacity)
        if cut and sum(n * m for n, m in window.items()) < capacity:
            largest = max(left)  # no exact window holds this length any more
            stuck[largest] = left.pop(largest)
            continue
        times = min(left[n] // m for n, m in window.items())
        plan.append((window, times))
        for n, m in window.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return plan, stuck


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Layout:
    """Where the ``rank``-th piece of a length goes."""

    def __init__(self, counts: dict[int, int], capacity: int, cut: bool = True):
        plan, stuck = window_plan(counts, capacity, cut)
        self.capacity, ranges, used, sequence = capacity, {}, Counter(), 0
        for window, times in plan:
            offset = 0
            for length, many in sorted(window.items(), reverse=True):
                ranges.setdefault(length, []).append((used[length], many, sequence, offset))
                used[length] += many * times
                offset += length * many
            sequence += times
        self.ranges = {n: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for n, r in ranges.items()}
        self.tail_first, self.tail_at, at = dict(used), {}, 0
        for length in sorted(stuck, reverse=True):
            self.tail_at[length] = at
            at += length * stuck[length]
        self.tail_sequence, self.full = sequence, at // capacity
        self.last = powers_of_two(at % capacity)
        self.sequences = sequence + self.full + len(self.last)

    def _tail(self, at: int, length: int) -> list[tuple[int, int, int, int]]:
        done, out = 0, []
        while done < length:
            here = at + done
            number, offset = divmod(here, self.capacity)
            room = self.capacity - offset
            if number == self.full:  # the last window: sequences of powers of two
                for k, size in enumerate(self.last):
                    if offset < size:
                        number, room = number + k, size - offset
                        break
                    offset -= size
            take = min(room, length - done)
            out.append((done, take, self.tail_sequence + number, offset))
            done += take
        return out

    def places(self, lengths: np.ndarray, ranks: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
        out: list = [None] * len(lengths)
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            rank, n = ranks[rows], int(length)
            tail = rank >= self.tail_first.get(n, 0)
            for row, r in zip(rows[tail], rank[tail] - self.tail_first.get(n, 0)):
                out[row] = self._tail(self.tail_at[n] + int(r) * n, n)
            if n in self.ranges and not tail.all():
                first, many, sequence, offset = self.ranges[n]
                r = rank[~tail]
                k = np.searchsorted(first, r, side="right") - 1
                t, j = np.divmod(r - first[k], many[k])
                for row, s, o in zip(rows[~tail], (sequence[k] + t).tolist(), (offset[k] + j * n).tolist()):
                    out[row] = [(0, n, s, o)]
        return out


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Stored pieces of at most ``capacity`` ids, numbered per task and length."""
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()),
                        ("_part", pa.int32()), ("_rank", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words, seen = TaskContext.get().partitionId(), encoder(tokenizer), Counter()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.encode(text.as_py()) + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    rows.append((doc_id, start, length, n, part, seen[length], ids[4 * start:4 * (start + length)]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return stored(arrow(docs.select(F.col(id_col).cast("bigint").alias("_id"), text_of(text_col).alias("_text")), cut,
                        "doc_id bigint, start bigint, length int, doc_tokens bigint, _part int, _rank bigint, ids binary"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, cut: bool = True,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids``: every id of every document, each in one piece.

    A null text is empty and packs its ``end_id`` alone; rows that repeat an id are documents of their own; an empty
    table packs nothing; other columns are not read. With ``cut``, no sequence has padding: all hold ``capacity`` ids or
    a power of two. Without, remainders stay whole and windows keep the smallest slack found.
    """
    pieces = token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col)
    sums = stored(pieces.groupBy("_part", "length").agg(F.count("*").alias("_n")))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # at most one row per length up to the capacity
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    layout = Layout(counts, capacity, cut)

    @F.pandas_udf(PLACES)
    def place(length: pd.Series, rank: pd.Series) -> pd.Series:
        names = ("at", "length", "sequence_id", "offset")
        return pd.Series([[dict(zip(names, p)) for p in ps] for ps in layout.places(length.to_numpy(), rank.to_numpy())])

    placed = pieces.join(bases, ["_part", "length"]).withColumn(
        "_place", F.explode(place("length", F.col("_rank") + F.col("_base"))))
    whole = F.col("_place.length") == F.col("length")
    return placed.select(
        "doc_id", (F.col("start") + F.col("_place.at")).alias("start"), F.col("_place.length").cast("bigint").alias("length"),
        "doc_tokens", F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").cast("bigint").alias("offset"),
        F.when(whole, F.col("ids")).otherwise(
            F.substring("ids", F.col("_place.at") * 4 + 1, F.col("_place.length") * 4)).alias("ids"))
