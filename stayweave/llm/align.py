"""Operator 11, alignment of two tokenizers' tokens over the same bytes.

Both sides encode each text; the byte ranges of their tokens are put side by side, batch by batch, by two as-of joins
keyed by document: each token's start finds the token of the other side that covers it. The union of both directions
holds every overlap, and overlaps whose ends are equal close a group: up to there both sides have cut the same bytes.

How often an id pair is linked is counted over the whole corpus. A document's links are kept as distinct pairs, tasks count
theirs before the shuffle, and each document's pairs then meet the counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayweave.llm.base import arrow, stored, text_of
from stayweave.llm.bytepairs import ByteEncoder, byte_vocabulary

MARK = "▁"
#: Bytes of text whose tokens are joined at a time, pairs held at a time, bytes of counts that are broadcast, links of a row.
SLICE, PAIRS, BROADCAST_BYTES = 1 << 20, 1 << 20, 32 << 20
LINKS = 1 << 17
SIDES = ["a_ids", "b_ids", "a_sizes", "b_sizes"]
LINK = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])
ALIGNED = ", ".join(f"{n} array<int>" for n in SIDES) + ", links array<struct<a:int,b:int,n:int>>"
_SHIFT = 20


def _laid_out(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of entries, where each begins among the bytes of all, and those bytes."""
    sizes = np.array([len(b) for b in entries], dtype=np.int64)
    return sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(entries), dtype=np.uint8)


class BytePieces:
    """Side A: a byte-level tokenizer file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        ranks, _ = byte_vocabulary(path)
        self.encoder = ByteEncoder(ranks)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.sizes, self.first, self.flat = _laid_out(self.bytes)

    def encode(self, text: str) -> np.ndarray:
        return self.encoder.encode(" " + text)


class MarkedPieces:
    """Side B: a SentencePiece file that writes a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes, self.first, self.flat = _laid_out(self.bytes)
        # no piece goes over a mark that follows another sign, so such places cut a long text safely
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)

    def encode(self, text: str) -> np.ndarray:
        return np.array([i for part in self.parts(text) for i in self.model.encode(part, num_threads=1)], dtype="<u4")

    def parts(self, text: str, size: int = 1 << 16) -> Iterator[str]:
        """A long text in parts, without the space before each but the first: the model writes it itself."""
        at = 0
        while self.cuts and len(text) - at > size:
            end = text.find(" ", at + size)
            while 0 <= end and (text[end - 1] == " " or text[end + 1:end + 2] in (" ", "")):
                end = text.find(" ", end + 1)
            if end < 0:
                break
            yield text[at:end]
            at = end + 1
        yield text[at:]


@lru_cache(maxsize=1)
def sides(a_path: str, b_path: str) -> tuple[BytePieces, MarkedPieces]:
    return BytePieces(a_path), MarkedPieces(b_path)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """All overlapping tokens of two sides, each given by ``doc, start, end`` and sorted by ``start`` over all documents.

    Rows are ``a, b`` (positions in the frames) and ``closes``, whether both end at the same byte. Each token's start
    finds the covering token of the other side; where both start together, both directions find the same overlap.
    """
    place = {"a": np.arange(len(a)), "b": np.arange(len(b))}
    over_a = pd.merge_asof(a[["doc", "start"]], b[["doc", "start"]].assign(b=place["b"]), on="start", by="doc")["b"].to_numpy(dtype=np.int64)
    over_b = pd.merge_asof(b[["doc", "start"]], a[["doc", "start"]].assign(a=place["a"]), on="start", by="doc")["a"].to_numpy(dtype=np.int64)
    new = a["start"].to_numpy()[over_b] < b["start"].to_numpy()
    found_a, found_b = np.concatenate([place["a"], over_b[new]]), np.concatenate([over_a, place["b"][new]])
    return pd.DataFrame({"a": found_a, "b": found_b, "closes": a["end"].to_numpy()[found_a] == b["end"].to_numpy()[found_b]})


def _given_back(side: BytePieces | MarkedPieces, ids: np.ndarray, ends: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text, whether its tokens' bytes are its own; ``ends`` are bounds of its ids, ``bounds`` of its bytes."""
    sizes = side.sizes[ids]
    reach = np.concatenate([[0], np.cumsum(sizes)])
    same = np.diff(reach[ends]) == np.diff(bounds)
    if not same.all():  # without texts of another length the bytes stand in the same places
        keep = np.repeat(same, np.diff(ends))
        ids, sizes, raw = ids[keep], sizes[keep], raw[np.repeat(same, np.diff(bounds))]
    begin = np.cumsum(sizes) - sizes
    wrong = np.flatnonzero(side.flat[np.arange(len(raw)) + np.repeat(side.first[ids] - begin, sizes)] != raw)
    kept = np.flatnonzero(same)
    own = np.searchsorted(np.cumsum(np.diff(bounds)[kept]), wrong, "right")
    same[kept[own]] = False
    return same


def align_texts(texts: list[str], a_path: str, b_path: str) -> pa.RecordBatch:
    """``a_ids, b_ids`` of each text and, for each group in order, how many of them it holds."""
    pair = sides(a_path, b_path)
    raw = [(" " + t).encode() if t else b"" for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    found, whole = [], np.ones(len(texts), dtype=bool)
    for side in pair:
        ids = [side.encode(t) for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        flat = np.concatenate([*ids, np.zeros(0, dtype="<u4")]).astype(np.int64)
        whole &= _given_back(side, flat, ends, data, bounds)
        found.append((flat, np.diff(ends)))
    frames, kept = [], []
    for side, (flat, counts) in zip(pair, found):
        flat, counts = flat[np.repeat(whole, counts)], np.where(whole, counts, 0)
        ends = np.cumsum(side.sizes[flat])
        frames.append(pd.DataFrame({"doc": np.repeat(np.arange(len(texts)), counts), "start": ends - side.sizes[flat], "end": ends}))
        kept.append((flat, counts))
    closing = overlaps(*frames).query("closes")
    last_a, last_b = np.sort(closing["a"].to_numpy()), np.sort(closing["b"].to_numpy())
    groups = np.bincount(frames[0]["doc"].to_numpy()[last_a], minlength=len(texts))

    def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values.astype(np.int32)))

    return pa.RecordBatch.from_arrays(
        [*[lists(*k) for k in kept], *[lists(np.diff(last, prepend=-1), groups) for last in (last_a, last_b)]],
        names=["a_ids", "b_ids", "a_sizes", "b_sizes"])


def _padded(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The batch with nulls for the columns it lacks."""
    have = set(batch.schema.names)
    return pa.RecordBatch.from_arrays(
        [batch.column(f.name) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row, id, a_ids, b_ids, a_sizes, b_sizes, links``: a row per text with the tokens of both sides and the sizes of
    its groups, and rows with its ``links``: distinct linked id pairs and how often each is linked.

    A text without tokens (null, empty, or not given back by one side's tokens) has empty lists and no links. ``_row`` tells
    rows apart that share an id; null ids are aligned like others; an empty table gives none; other columns are not
    read. The result is stored, so that what is counted from it doesn't encode again.
    """
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(2), 0
            schema = pa.schema([("_row", pa.int64()), (id_col, batch.schema.field(1).type), *[(n, ints) for n in SIDES], ("links", pa.list_(LINK))])
            while at < batch.num_rows:
                some, size, end = [], 0, at
                while end < batch.num_rows and (not some or size < SLICE):
                    some.append(texts[end].as_py())
                    size += len(some[-1])
                    end += 1
                got, head = align_texts(some, a_path, b_path), batch.slice(at, end - at)
                yield _padded(pa.RecordBatch.from_arrays([head.column(0), head.column(1), *got.columns], names=["_row", id_col, *SIDES]), schema)
                for owners, pairs, n in linked_pairs(got):
                    for lo in range(0, len(owners), LINKS):
                        own, first = np.unique(owners[lo:lo + LINKS], return_index=True)
                        each = pa.StructArray.from_arrays(
                            [pa.array(x[lo:lo + LINKS].astype(np.int32)) for x in (pairs >> _SHIFT, pairs & ((1 << _SHIFT) - 1), n)], fields=list(LINK))
                        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(each)), pa.int32()), each)
                        yield _padded(pa.RecordBatch.from_arrays([head.column(0).take(pa.array(own)), lists], names=["_row", "links"]), schema)
                at = end

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias(id_col), text_of(text_col).alias("_own_text"))
    return stored(arrow(rows, run, f"_row bigint, `{id_col}` {rows.schema[1].dataType.simpleString()}, {ALIGNED}"))


# ---- links -----------------------------------------------------------------------------------------------------


def _summed(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their counts (or how often they occur)."""
    if counts is not None:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    else:
        keys = np.sort(keys)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first)


def _products(left: np.ndarray, right_first: np.ndarray, right_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every ``left`` row with each of the ``right_count`` rows from ``right_first`` on."""
    own = np.repeat(left, right_count)
    within = np.arange(len(own)) - np.repeat(np.cumsum(right_count) - right_count, right_count)
    return own, np.repeat(right_first, right_count) + within


def linked_pairs(batch: pa.RecordBatch, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct linked id pairs of each document: row of the batch, ``a << 20 | b``, number of links.

    Links of a group are all its pairs. Some documents are expanded at a time; one whose links outnumber ``most`` has its
    ids counted within groups first and is paired some side-A ids at a time, all pairs of one such id together.
    """
    a, b, a_sizes, b_sizes = (batch.column(n) for n in ("a_ids", "b_ids", "a_sizes", "b_sizes"))
    a, b, sa, sb = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (a, b, a_sizes, b_sizes))
    groups = np.concatenate([[0], np.cumsum(np.diff(a_sizes.offsets.to_numpy()))])
    links = np.concatenate([[0], np.cumsum(sa * sb)])[groups]
    a_first, b_first = (np.concatenate([[0], np.cumsum(x)]) for x in (sa, sb))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(links, links[at] + most, "right")) - 1)
        lo, hi = groups[at], groups[end]
        own = np.repeat(np.arange(lo, hi), sa[lo:hi])
        doc = np.repeat(np.arange(at, end), np.diff(groups[at:end + 1]))
        if links[end] - links[at] <= most:
            left, right = _products(np.arange(a_first[lo], a_first[hi]), b_first[own], sb[own])
            docs = np.repeat(doc[own - lo], sb[own])
            keys, n = _summed(docs << 2 * _SHIFT | a[left] << _SHIFT | b[right], None)
            yield keys >> 2 * _SHIFT, keys & ((1 << 2 * _SHIFT) - 1), n
        elif hi > lo:
            yield from _one_by_one(at, own - lo, a[a_first[lo]:a_first[hi]], np.repeat(np.arange(hi - lo), sb[lo:hi]),
                                   b[b_first[lo]:b_first[hi]], hi - lo, most)
        at = end


def _one_by_one(doc: int, a_group: np.ndarray, a: np.ndarray, b_group: np.ndarray, b: np.ndarray, groups: int, most: int):
    """``linked_pairs`` of one document, by ranges of side-A ids."""
    low = (1 << _SHIFT) - 1
    ka, ca = _summed(a_group << _SHIFT | a, None)
    kb, cb = _summed(b_group << _SHIFT | b, None)
    order = np.argsort(ka & low, kind="stable")
    ka, ca = ka[order], ca[order]
    b_first = np.searchsorted(kb >> _SHIFT, np.arange(groups + 1))
    cost = np.diff(b_first)[ka >> _SHIFT]
    begins = np.flatnonzero(np.diff(ka & low, prepend=-1))
    reach = np.cumsum(cost)[np.append(begins[1:], len(ka)) - 1]
    at = 0
    while at < len(begins):
        end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + most, "right")))
        rows = np.arange(begins[at], begins[end] if end < len(begins) else len(ka))
        left, right = _products(rows, b_first[ka[rows] >> _SHIFT], cost[rows])
        keys, n = _summed((ka[left] & low) << _SHIFT | kb[right] & low, ca[left] * cb[right])
        yield np.full(len(keys), doc), keys, n
        at = end


def _links(aligned: DataFrame) -> DataFrame:
    return aligned.filter("links is not null").select("_row", F.explode("links").alias("l")).select("_row", "l.a", "l.b", "l.n")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, n_docs, best``: documents that hold an id pair linked, and whether no pair of its side-A id has more."""
    # a document's pairs are distinct, so rows are documents; tasks add up their own before the shuffle
    counts = stored(_links(aligned).groupBy("a", "b").agg(F.count("*").alias("n_docs")))
    # a row per side-A id: the vocabulary bounds it
    best = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(F.broadcast(best), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def link_statistics(aligned: DataFrame) -> DataFrame:
    """``_row, n_best, count_sum`` of each document with links: links whose pair no other pair of its side-A id beats in
    documents, and the sum of the pairs' counts over all links."""
    counts = stored(pair_counts(aligned))
    if counts.count() * 24 <= BROADCAST_BYTES:  # two ids, a number and a flag a row; a larger table is joined by shuffle
        counts = F.broadcast(counts)
    return _links(aligned).join(counts, ["a", "b"]).groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"))


@lru_cache(maxsize=2)
def _written(n: int, inner: str, last: str) -> list[bytes]:
    return [f"{i}{mark}".encode() for mark in (inner, last) for i in range(n)]


def written_groups(aligned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``_row, id, n_a, n_b, n_groups, n_links, groups``: groups as text, ``a1,a2|b1;a3|b2,b3``; empty without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, sb = (batch.column(n) for n in ("a_ids", "b_ids", "a_sizes", "b_sizes"))
            flat = [c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (a, b, sa, sb)]
            top = int(max(flat[0].max(initial=0), flat[1].max(initial=0))) + 1
            size = 1 << max(16, top.bit_length())
            text = _written(size, ",", "|") + _written(size, ",", ";")
            # places of both sides' ids in one row: a group's ids of side A, then those of side B
            ends = np.cumsum(flat[2] + flat[3])
            line = np.empty(len(flat[0]) + len(flat[1]), dtype=np.int64)
            for ids, sizes, shift, base in ((flat[0], flat[2], ends - flat[2] - flat[3], 0), (flat[1], flat[3], ends - flat[3], 2 * size)):
                own = np.cumsum(sizes)
                at = np.arange(len(ids)) + np.repeat(shift - (own - sizes), sizes)
                codes = ids + base
                codes[own - 1] += size
                line[at] = codes
            edges = [np.concatenate([[0], np.cumsum(np.diff(c.offsets.to_numpy()))]) for c in (a, b, sa)]
            bounds = edges[0] + edges[1]
            groups = [b"".join(map(text.__getitem__, line[p:q].tolist()))[:-1] for p, q in zip(bounds, bounds[1:])]
            running = np.concatenate([[0], np.cumsum(flat[2] * flat[3])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(np.diff(e)) for e in edges], pa.array(np.diff(running[edges[2]])),
                 pa.array(groups, pa.binary()).cast(pa.string())], names=["_row", id_col, "n_a", "n_b", "n_groups", "n_links", "groups"])

    rows = aligned.filter("links is null").select("_row", id_col, *SIDES)
    return arrow(rows, run, f"_row bigint, `{id_col}` {rows.schema[1].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, "
                            "n_links bigint, groups string")
