"""Operator 10, suffix-array dedup with sparse suffixes.

Every passage of ``min_words`` words has a minimiser: its n-gram of least hash. Equal passages have it at the same place,
so only the suffixes that start at minimisers are kept, one row each, and of these only those whose n-gram occurs again.

1. The kept suffixes are sorted by their words. Ranges of the whole key are dealt to tasks of bounded size, so a group
   of any size spreads over many.
2. Neighbours are compared word by word to the right. Suffixes that agree over ``k`` words stand together.
3. Those are extended to the left, a word at a time. Two suffixes that agree over ``a`` words before the minimiser and
   ``min_words - a`` from it on hold the same passage. A twin may agree less to the right than the next neighbour
   does, and more to the left, so each length asks all suffixes that stand together. Longer matches have
   a minimiser in each of their passages, and touching passages are merged.
4. What stands together at a task's first or last row may go on in the next one: one row for each passage there and task,
   told by SHA-256, settles which is the earliest of all.

Words are told apart by their own bytes; hashes only choose the positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayweave.llm.base import arrow, stored, text_of
from stayweave.llm.shingles import window_hashes, word_hashes
from stayweave.session import broadcast_if_small, released

MIN_WORDS = 50
#: Words of the n-gram at a minimiser. With windows of ``MIN_WORDS - GRAM + 1`` n-grams every passage has one.
GRAM = 20
#: Suffixes of one task of the sort, suffixes of one batch, and words of a text whose passages are merged together.
TASK_ROWS = 25_000
SLICE = 4096
BLOCK = 4096
PLACE = "struct<_id:bigint,start:int,_check:bigint>"
FOUND = f"_id bigint, _check bigint, start int, stop int, later boolean, digest binary, low {PLACE}, high {PLACE}"


def _least(grams: np.ndarray, window: int) -> np.ndarray:
    """Position of the least hash (the first of equal ones) in each run of ``window`` n-grams."""
    if len(grams) < window:
        return np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.concatenate([view[at:at + 65536].argmin(axis=1) + np.arange(at, min(at + 65536, len(view))) for at in range(0, len(view), 65536)])


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash (the first of equal ones) in each run of ``window`` n-grams."""
    return np.unique(_least(grams, window))


def anchors(docs: DataFrame, min_words: int, gram: int) -> DataFrame:
    """``_id, _check, hashes, places``: the minimisers of each text, and of each its word number, how many words before it
    the first passage starts that it is the least of, and how many more start after that one, packed in base ``min_words``."""
    window = min_words - gram + 1
    schema = pa.schema([("_id", pa.int64()), ("_check", pa.int64()), ("hashes", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _, _, edges = word_hashes(batch.column(2).to_pylist(), lower=False)
            grams = window_hashes(words, gram)
            hashes, places = [], []
            for a, b in zip(edges[:-1], edges[1:]):
                own = grams[a:b - gram + 1] if b - a >= min_words else grams[:0]
                least = _least(own, window)  # never falls: windows of one minimiser follow each other
                at, first, n = np.unique(least, return_index=True, return_counts=True)
                hashes.append(own[at].view(np.int64))
                places.append((at * min_words + at - first) * min_words + n - 1)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int32))
            flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, flat(hashes)),
                pa.ListArray.from_arrays(offsets, flat(places))], schema=schema)

    return stored(arrow(docs, find, "_id bigint, _check bigint, hashes array<bigint>, places array<bigint>").filter(F.size("hashes") > 0))


def suffixes(texts: DataFrame, min_words: int) -> DataFrame:
    """``right, left, _id, _check, at, least, most``: the words from a minimiser on and those before it, nearest first,
    as far as passages reach that have it; and how many words before it they start."""
    names = ["right", "left", "_id", "_check", "at", "least", "most"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = batch.column(2)[row].as_py().encode("utf-8", "surrogatepass").split()
                packed = batch.column(3)[row].values.to_numpy()
                rest, more = np.divmod(packed, min_words)
                at, most = np.divmod(rest, min_words)
                least = most - more
                for k in range(0, len(at), SLICE):
                    here = list(zip(at[k:k + SLICE].tolist(), least[k:k + SLICE].tolist(), most[k:k + SLICE].tolist()))
                    right = [b" ".join([*words[p:p + min_words - a], b""]) for p, a, _ in here]
                    left = [b" ".join([*words[p - b:p][::-1], b""]) for p, _, b in here]
                    own = pa.array(np.full(len(here), row))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(right, pa.binary()), pa.array(left, pa.binary()), batch.column(0).take(own), batch.column(1).take(own),
                        *(pa.array(x[k:k + SLICE].astype(np.int32)) for x in (at, least, most))], names=names)

    return arrow(texts, cut, "right binary, left binary, _id bigint, _check bigint, at int, least int, most int")


def _codes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A row of word numbers for each value: equal numbers are equal words, -1 stands where there is no word."""
    lists = pc.split_pattern(column.cast(pa.large_binary()).combine_chunks(), b" ")
    sizes = lists.value_lengths().to_numpy() - 1  # every word is followed by a space, so equal words stand together when sorted
    flat = pc.dictionary_encode(lists.flatten())
    numbers = flat.indices.to_numpy(zero_copy_only=False)
    begins = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    out = np.full((len(sizes), width), -1, dtype=np.int32)
    for k in range(width):
        has = sizes > k
        out[has, k] = numbers[begins[has] + k]
    return out


def _ranks(rows: pa.Table) -> np.ndarray:
    """Order of the places (null id, id, word, text); a repeated input row has the same place."""
    none, ids = rows["_id"].is_null().to_numpy(), rows["_id"].fill_null(0).to_numpy()
    keys = [rows["_check"].to_numpy(), rows["at"].to_numpy(), ids, ~none]
    order = np.lexsort(keys)
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _digest(right: bytes, left: bytes, before: int, min_words: int) -> bytes:
    words = left.split()[:before][::-1] + right.split()[:min_words - before]
    return hashlib.sha256(b" ".join(words)).digest()


def _passages(min_words: int, width: int):
    """Sorted suffixes of one task: passages that occur again within it, and what must be settled with other tasks."""
    schema = pa.schema([
        ("_id", pa.int64()), ("_check", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("later", pa.bool_()),
        ("digest", pa.binary()), *((n, pa.struct([("_id", pa.int64()), ("start", pa.int32()), ("_check", pa.int64())]))
                                                       for n in ("low", "high"))])

    def out(**columns) -> Iterator[pa.RecordBatch]:
        n = len(next(iter(columns.values())))
        table = pa.table([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)
        yield from table.to_batches(max_chunksize=SLICE)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        n = len(rows)
        right, left, rank = _codes(rows["right"], min_words), _codes(rows["left"], width), _ranks(rows)
        at, least, most = (rows[k].to_numpy() for k in ("at", "least", "most"))
        agree = np.minimum.accumulate((right[1:] == right[:-1]) & (right[1:] >= 0), axis=1).sum(axis=1)
        del right
        again, later = np.zeros((n, width + 3), dtype=bool), np.zeros((n, width + 3), dtype=bool)
        before = np.zeros(n, dtype=np.int64)

        def place(of: np.ndarray, a: int) -> pa.StructArray:
            some = rows.take(pa.array(of)).combine_chunks()
            start = pa.array((at[of] - a).astype(np.int32))
            flat = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
            return pa.StructArray.from_arrays([flat(some["_id"]), start, flat(some["_check"])], names=["_id", "start", "_check"])

        for a in range(width + 1):
            if a:  # one word further to the left
                before = np.unique(before * (int(left.max(initial=0)) + 2) + left[:, a - 1] + 1, return_inverse=True)[1]
            own = np.flatnonzero((least <= a) & (a <= most))
            if not len(own):
                continue
            group = np.concatenate([[0], np.cumsum(agree < min_words - a)])
            kind = np.unique(group[own] * (int(before.max()) + 1) + before[own], return_inverse=True)[1]
            order = np.lexsort((rank[own], kind))
            first = np.flatnonzero(np.concatenate([[True], np.diff(kind[order]) > 0]))
            last = np.append(first[1:], len(order)) - 1
            low, high = own[order[first]], own[order[last]]
            edge = (group[low] == 0) | (group[low] == group[-1])
            again[own, a + 1] = (~edge & (rank[low] != rank[high]))[kind]
            later[own, a + 1] = rank[low][kind] != rank[own]  # whatever other tasks hold
            if edge.any():  # the earliest one here may be later than one elsewhere, or alone
                one = low[edge]
                digests = [_digest(rows["right"][k].as_py(), rows["left"][k].as_py(), a, min_words) for k in one.tolist()]
                yield from out(digest=pa.array(digests, pa.binary()), low=place(one, a), high=place(high[edge], a))
        for flag, found in ((True, later), (False, again & ~later)):
            step = np.diff(found.astype(np.int8), axis=1)
            (row, begin), (_, end) = np.nonzero(step == 1), np.nonzero(step == -1)
            if len(row):  # passages that start at words next to each other
                some = rows.take(pa.array(row))
                yield from out(_id=some["_id"], _check=some["_check"], start=pa.array((at[row] - end + 1).astype(np.int32)),
                               stop=pa.array((at[row] - begin + min_words).astype(np.int32)), later=pa.array(np.full(len(row), flag)))

    return scan


def matches(docs: DataFrame, min_words: int, gram: int) -> DataFrame:
    """``_id, _check, start, stop, later``: stretches of passages that occur again; a null id matches as the earliest."""
    found = anchors(docs, min_words, gram)
    each = found.select("_id", "_check", F.explode(F.arrays_zip("hashes", "places")).alias("a")).select(
        "_id", "_check", F.col("a.hashes").alias("hash"), F.col("a.places").alias("places"))
    again = stored(each.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    live = stored(each.join(again, "hash").groupBy("_id", "_check").agg(F.collect_set("places").alias("places")))
    wanted = broadcast_if_small(live.select(F.col("_check").alias("_want")).distinct())
    some = docs.join(wanted, F.col("_check") == F.col("_want"), "left_semi")
    texts = some.alias("t").join(live.alias("l"), F.col("t._id").eqNullSafe(F.col("l._id")) & (F.col("t._check") == F.col("l._check"))).select(
        F.col("t._id").alias("_id"), F.col("t._check").alias("_check"), "_text", "places")
    rows = stored(suffixes(texts, min_words))
    released(found, again, live)
    order = ["right", "left", "_id", "at", "_check"]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    near = stored(arrow(dealt, _passages(min_words, min_words - gram), FOUND))
    released(rows)
    # at the edges of tasks: the earliest of each task against the earliest of all
    ends = near.filter("digest is not null").select("digest", "low", "high")
    least = ends.groupBy("digest").agg(F.min("low").alias("_low"), F.max("high").alias("_high")).filter("not (_low <=> _high)")
    settled = ends.join(least, "digest").select("low.*", (F.col("low.start") + min_words).alias("stop"), (~F.col("low").eqNullSafe(F.col("_low"))).alias("later"))
    columns = ["_id", "_check", "start", "stop", "later"]
    return near.filter("digest is null").select(*columns).unionByName(settled.select(*columns))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stretches (``_id, _check, later, start, stop``) as one where they overlap or touch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        check, later, start, stop = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
        none, ids = batch.column(0).is_null().to_numpy(zero_copy_only=False), batch.column(0).fill_null(0).to_numpy()
        other = np.zeros(len(start), dtype=bool)
        for x in (later, check, none, ids):
            other[1:] |= x[1:] != x[:-1]
        other[1:] |= start[1:] < start[:-1]  # the next block of the same text
        text = np.cumsum(other).astype(np.int64) << 32
        reach = np.maximum.accumulate(text + stop)
        new = np.concatenate([[True], (text + start)[1:] > reach[:-1]])
        at = np.flatnonzero(new)
        ends = reach[np.append(at[1:], len(start)) - 1] & 0xFFFFFFFF
        rows = pa.array(at)
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(4)), pa.array(ends.astype(np.int32))],
                                         names=batch.schema.names)


def _merge(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start_word, stop_word, later``: passages of at least ``min_words`` words that occur again, in another
    document or in the same one, merged where they touch.

    ``later`` passages have an earlier twin (smaller id, then position) and can go; others are the first of their kind.
    Words are compared exactly, white space between them is not. Null, empty and short texts have no passages; a
    repeated input row is one document; an empty table gives none.
    """
    return _spans(docs, min_words, gram, id_col, text_col).drop("_check")


def _spans(docs: DataFrame, min_words: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """``repeated_spans`` with ``_check``, a hash of the text they lie in: texts may share an id."""
    own = docs.select(F.col(id_col).cast("bigint").alias("_id"), text_of(text_col).alias("_text"))
    own = own.select("_id", F.xxhash64("_text").alias("_check"), "_text")
    found = matches(own, min_words, gram).select("_id", "_check", "later", "start", "stop")
    near = found.repartition("_id", "_check", F.floor(F.col("start") / BLOCK)).sortWithinPartitions("_id", "_check", "later", "start")
    runs = arrow(near, _runs, "_id bigint, _check bigint, later boolean, start int, stop int")
    spans = runs.groupBy(F.col("_id").alias("doc_id"), "_check", "later").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def merged(spans: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "stop": b} for a, b in _merge([(s["start"], s["stop"]) for s in row])] for row in spans])

    return spans.select("doc_id", "_check", "later", F.explode(merged("spans")).alias("s")).select(
        "doc_id", "_check", F.col("s.start").alias("start_word"), F.col("s.stop").alias("stop_word"), "later")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                    size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with later passages cut out of their texts; columns unchanged, ``size_col`` counted anew for texts that
    changed. A document of which nothing is left goes; all others stay."""
    later = _spans(docs, min_words, gram, id_col, text_col).filter("later").groupBy(
        F.col("doc_id").alias("_cut_id"), F.col("_check").alias("_cut_check")).agg(F.collect_list(F.struct("start_word", "stop_word")).alias("_spans"))
    later = broadcast_if_small(stored(later))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans):
            raw = t.encode("utf-8", "surrogatepass")
            _, starts, ends, _ = word_hashes([t], lower=False)
            at, parts = 0, []
            for a, b in sorted((x["start_word"], x["stop_word"]) for x in s):
                parts.append(raw[at:starts[a]])
                at = starts[b] if b < len(starts) else len(raw)
            out.append((b"".join(parts) + raw[at:]).decode("utf-8", "surrogatepass"))
        return pd.Series(out)

    # as one that may differ it is not computed once more for the filter, by a second worker beside the first
    cut = cut.asNondeterministic()
    own = (F.col(id_col) == F.col("_cut_id")) & (F.xxhash64(text_of(text_col)) == F.col("_cut_check"))
    marked = docs.join(later, own, "left")
    changed = marked.filter("_spans is not null").withColumn(text_col, cut(text_col, "_spans")).filter(F.trim(text_col) != "")
    if size_col in docs.columns:
        changed = changed.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType))
    return marked.filter("_spans is null").select(docs.columns).unionByName(changed.select(docs.columns))
