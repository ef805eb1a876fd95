"""Operator 12, periodic runs of words, by scale-tiled distribution.

A run of period ``p`` is where word ``i`` equals word ``i + p`` over a stretch. Periods are taken by octave: those of
``[h, 2h)`` share boundaries every ``h`` words, and a stretch long enough to count holds a whole block between two of
them. Documents are exploded into overlapping tiles per octave. Within a tile, a block that fits ``p`` words ahead (told by
hashes, so false ones may come through but none is missed) is measured by Z-functions from its boundary forwards and
backwards, capped at the tile's overlap. Only these fragments are shuffled, by document and period, and stitched where they touch.

A period counts only where its word block is no power of a shorter one: then it is the run's smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayweave.llm.base import arrow, small_batches, stored, text_of
from stayweave.llm.shingles import mix

#: A run has at least this many words, and this many times its period.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Periods below ``FIRST`` form one octave. ``TILE`` words at least are a tile's own; longer documents have several per octave.
FIRST, TILE = 8, 1 << 16
#: Bytes of a text from which its tiles are dealt to other tasks.
GIANT_BYTES = 1 << 22
FRAGMENT = pa.struct([("period", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
FRAGMENTS = "array<struct<period:bigint,begin:bigint,end:bigint>>"
TILE_FIELDS = "_row bigint, h bigint, at bigint, own bigint, low bigint, codes array<int>"


def octaves(n: int) -> list[int]:
    """Block sizes for the periods a run among ``n`` words can have."""
    out, h = [], FIRST
    while n >= LEAST_WORDS and (h == FIRST or h * LEAST_TIMES <= n):
        out.append(h)
        h *= 2
    return out


def periods(h: int) -> tuple[int, int]:
    """First period of an octave and the first behind it. The lowest octave has all periods up to its end."""
    return (1 if h == FIRST else h), 2 * h


def tiles(codes: np.ndarray, tile: int = TILE) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """``h, at, own, low, words`` for each octave and tile: boundaries ``at`` to ``own`` are the tile's, and ``words`` begin
    at word ``low`` and go far enough to measure any of its fragments up to the neighbouring tiles' ones."""
    n = len(codes)
    for h in octaves(n):
        core = max(tile // h, 1) * h
        for at in range(0, n, core):
            own = min(at + core, n)
            low = max(0, at - h)
            yield h, at, own, low, codes[low:min(n, own + 4 * h)]


def z_function(words: list[int]) -> list[int]:
    """For each position, how many words from there on equal those from the begin on."""
    n = len(words)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and words[k] == words[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def block_hashes(codes: np.ndarray, h: int) -> np.ndarray:
    """Hash of the ``h`` words (a power of two) from each position on, as far as there are so many."""
    out, size = mix(codes.astype(np.uint64) + np.uint64(1)), 1
    while size < h:
        out = mix(out[:-size] * np.uint64(0x9E3779B97F4A7C15) + out[size:])
        size *= 2
    return out


def fitting_blocks(codes: np.ndarray, starts: np.ndarray, h: int, most: int = 1 << 20) -> dict[int, list[int]]:
    """For each start of a block that may occur again a period of the octave ahead: those periods."""
    lo, hi = periods(h)
    found: dict[int, list[int]] = {}
    if len(codes) < h:
        return found
    hashes = block_hashes(codes, h)
    starts = starts[starts < len(hashes)]
    padded = np.concatenate([hashes, np.zeros(hi, dtype=np.uint64)])
    step = max(1, most // hi)
    for k in range(0, len(starts), step):
        some = starts[k:k + step]
        row, period = np.nonzero(padded[some[:, None] + np.arange(lo, hi)] == hashes[some][:, None])
        for start, p in zip(some[row].tolist(), (period + lo).tolist()):
            if start + p + h <= len(codes):
                found.setdefault(start, []).append(p)
    return found


def measured(words: list[int], c: int, h: int, candidates: list[int]) -> list[tuple[int, int, int]]:
    """``period, begin, end`` of the stretch around the block at ``c`` where words equal those a period ahead, up to ``h``
    words before the block and behind it; only for periods whose word block is no power of a shorter one."""
    top = max(candidates)
    ahead = z_function(words[c:c + top + 2 * h])
    shorter = {}
    for q in range(1, top // 2 + 1):
        if ahead[q] + q >= max(2 * q, min(candidates)):  # the block of any multiple p with z[q] >= p - q is a power
            shorter[q] = ahead[q] + q
    out = []
    for p in candidates:
        if ahead[p] < h or any(p % q == 0 and reach >= p for q, reach in shorter.items() if q < p):
            continue
        back = z_function(words[max(0, c - h):c + p][::-1])
        before = min(back[p], h) if p < len(back) else 0
        out.append((p, c - before, c + min(ahead[p], 2 * h)))
    return out


def fragments(batch: list[tuple[int, int, int, int, np.ndarray]]) -> list[list[tuple[int, int, int]]]:
    """For each tile: fragments of period, first word and end of a stretch, joined where they touch within the tile.

    Tiles of one octave are searched together: their words are numbered apart, so blocks of different tiles never fit.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in batch]
    for h in {t[0] for t in batch}:
        members = [i for i, t in enumerate(batch) if t[0] == h]
        sizes = np.array([len(batch[i][4]) for i in members])
        begins = np.cumsum(sizes) - sizes
        tops = np.array([int(batch[i][4].max(initial=0)) + 1 for i in members], dtype=np.int64)
        codes = np.concatenate([batch[i][4] for i in members]) + np.repeat(np.cumsum(tops) - tops, sizes)
        starts = np.concatenate([np.arange(batch[i][1], batch[i][2], h) - batch[i][3] + b for i, b in zip(members, begins)])
        found = fitting_blocks(codes, starts, h)
        words: list[int] = []
        last = -1
        for start in sorted(found):
            k = int(np.searchsorted(begins, start, "right")) - 1
            if k != last:
                words, last, open_ = codes[begins[k]:begins[k] + sizes[k]].tolist(), k, {}
            tile = batch[members[k]]
            candidates = [p for p in found[start] if start + p + h <= begins[k] + sizes[k]]
            if not candidates:
                continue
            for p, a, b in measured(words, start - int(begins[k]), h, candidates):
                a, b = a + tile[3], b + tile[3]
                own = out[members[k]]
                at = open_.get(p)
                if at is not None and own[at][2] >= a:
                    own[at] = (p, min(own[at][1], a), max(own[at][2], b))
                else:
                    open_[p] = len(own)
                    own.append((p, a, b))
    return out


def word_codes(text: str) -> tuple[list[bytes], np.ndarray]:
    """Words of a text and a number for each that is equal for equal words only."""
    words = text.encode().split()  # of bytes: cut at the six white-space bytes
    known: dict[bytes, int] = {}
    return words, np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)


def _searched(texts: DataFrame) -> DataFrame:
    """``_row, _own_id, n, words, fragments`` of each text, all its tiles solved where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split, jobs, owner = [], [], []
            for i, text in enumerate(batch.column(2)):
                words, codes = word_codes(text.as_py())
                split.append(words)
                for tile in tiles(codes):
                    jobs.append(tile)
                    owner.append(i)
            per_row: list[list] = [[] for _ in split]
            for i, got in zip(owner, fragments(jobs)):
                per_row[i] += [{"period": p, "begin": a, "end": b} for p, a, b in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(w) for w in split], pa.int64()),
                 pa.array([b" ".join(w) for w in split], pa.binary()).cast(pa.string()), pa.array(per_row, pa.list_(FRAGMENT))],
                names=["_row", "_own_id", "n", "words", "fragments"])

    kind = texts.schema["_own_id"].dataType.simpleString()
    return arrow(texts, run, f"_row bigint, _own_id {kind}, n bigint, words string, fragments {FRAGMENTS}")


def _dealt(texts: DataFrame) -> DataFrame:
    """As ``_searched``, with tiles of giant texts dealt over all tasks as rows of their own."""
    tile = pa.schema([(n, pa.int64()) for n in ("_row", "h", "at", "own", "low")] + [("codes", pa.list_(pa.int32()))])
    piece = pa.schema([("_row", pa.int64()), ("fragments", pa.list_(FRAGMENT))])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                for h, at, own, low, codes in tiles(word_codes(text.as_py())[1]):
                    yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in (row, h, at, own, low)],
                                                      pa.array([codes.astype(np.int32)], pa.list_(pa.int32()))], schema=tile)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, h, at, own, low = (batch.column(c)[i].as_py() for c in range(5))
                codes = batch.column(5)[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                got = fragments([(h, at, own, low, codes)])[0]
                if got:
                    yield pa.RecordBatch.from_pylist(
                        [{"_row": row, "fragments": [{"period": p, "begin": a, "end": b} for p, a, b in got]}], schema=piece)

    dealt = arrow(texts, explode, TILE_FIELDS).repartition("_row", "h", "at")
    found = arrow(dealt, solve, f"_row bigint, fragments {FRAGMENTS}").groupBy("_row").agg(F.flatten(F.collect_list("fragments")).alias("fragments"))
    words = F.array_join(F.expr(r"regexp_extract_all(_own_text, '[^\\x20\\x09-\\x0D]+', 0)"), " ")
    n = F.when(F.col("words") == "", 0).otherwise(F.size(F.split("words", " "))).cast("bigint")
    return texts.select("_row", "_own_id", words.alias("words")).withColumn("n", n).join(found, "_row", "left").select(
        "_row", "_own_id", "n", "words", F.coalesce("fragments", F.array().cast(FRAGMENTS)).alias("fragments"))


def stitched(found: DataFrame) -> DataFrame:
    """``_row, start, length, period`` of all runs: fragments of a document and period that touch become one."""
    pieces = found.select("_row", F.explode("fragments").alias("f")).select("_row", "f.period", "f.begin", "f.end")
    by_start = Window.partitionBy("_row", "period").orderBy("begin", "end")
    reached = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("begin") <= F.col("_reached"), 0).otherwise(1)).over(by_start)
    merged = pieces.withColumn("_reached", reached).withColumn("_island", island).groupBy("_row", "period", "_island").agg(
        F.min("begin").alias("start"), F.max("end").alias("_end"))
    length = F.col("_end") + F.col("period") - F.col("start")
    return merged.select("_row", "start", length.alias("length"), "period").filter(
        F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_TIMES * F.col("period")))


def _collapsed(rows: DataFrame) -> DataFrame:
    """Words without those behind the first period of a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for words, runs in zip(batch.column(1), batch.column(2).to_pylist()):
                words = words.as_py().split(" ")
                change = np.zeros(len(words) + 1, dtype=np.int64)
                for r in runs:
                    change[r["start"] + r["period"]] += 1
                    change[r["start"] + r["length"]] -= 1
                stay = np.cumsum(change[:-1]) == 0
                kept.append(" ".join([words[i] for i in np.flatnonzero(stay).tolist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["_row", "collapsed"])

    small_batches(rows.sparkSession)
    return arrow(rows.select("_row", "words", "runs"), run, "_row bigint, collapsed string")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", giant_bytes: int = GIANT_BYTES) -> DataFrame:
    """``id, n_words, runs, collapsed`` of each row.

    ``runs`` is an array of ``start, length, period`` by start, then period: word number, words, smallest period of every
    stretch of at least 24 words and three periods that can't be extended. ``collapsed`` are the words, joined by one
    space, without those that a run holds after its first period. Words are runs without ASCII white space. Null and
    empty texts have no words and no runs; repeated rows and null ids are treated like others; an empty table gives none;
    other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_own_id"), text_of(text_col).alias("_own_text"))
    giant = F.octet_length("_own_text") >= giant_bytes
    giants = stored(rows.filter(giant))
    found = stored(_searched(rows.filter(~giant)).unionByName(_dealt(giants)))
    by_place = F.array_sort(F.collect_list(F.struct("start", "length", "period")), lambda x, y: F.when(
        (x["start"] < y["start"]) | (x["start"] == y["start"]) & (x["period"] < y["period"]), -1).otherwise(1))
    runs = stitched(found).groupBy("_row").agg(by_place.alias("runs"))
    has = F.size("fragments") > 0
    # the texts of documents with fragments alone meet the runs
    with_runs = stored(found.filter(has).join(runs, "_row").select("_row", "_own_id", "n", "words", "runs"))
    collapsed = with_runs.drop("words").join(_collapsed(with_runs), "_row")
    none = F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")
    left = found.filter(~has).unionByName(found.filter(has).join(runs, "_row", "left_anti"))
    out = collapsed.select(F.col("_own_id").alias(id_col), F.col("n").alias("n_words"), "runs", "collapsed")
    return out.unionByName(left.select(F.col("_own_id").alias(id_col), F.col("n").alias("n_words"), none.alias("runs"), F.col("words").alias("collapsed")))


def strongest(runs: str = "runs"):
    """The run with the most periods; of equal ones the first. Fractions are compared exactly."""
    return F.aggregate(F.col(runs), F.get(runs, 0), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
