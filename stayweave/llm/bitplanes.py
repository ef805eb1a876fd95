"""Operator 1, token ids as binary: bit-plane shuffled blocks, each plane compressed, with a chunk index.

Documents are dealt to shards by ranges of their id, so the order of the whole collection is the order of the shards.
A shard is a row of segments; a segment holds some million ids of whole documents in blocks of a fixed number of ids.
Each block is transposed into planes (bits or bytes of the same weight), each plane is compressed by zstandard, and
the segment's index says where every plane of every block lies. Segments are the rows of a Parquet folder, so they are
written by Spark's commit protocol to any store, survive lost executors, and a reader of the index alone does not
touch the planes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayweave.llm.base import arrow, stored, text_of
from stayweave.llm.tokens import encoder

BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 20
LEVEL = 3
CHUNKS = "array<struct<first:bigint,n:int,at:bigint,sizes:array<int>>>"
SEGMENT = ("shard int, segment int, shard_start bigint, n_ids bigint, plane string, doc_ids array<bigint>, "
           f"doc_tokens array<bigint>, chunks {CHUNKS}, planes binary")


def shuffle_planes(ids: np.ndarray, plane: str) -> list[bytes]:
    """Planes of one block, the lowest first; planes above the highest id in the block are left out."""
    raw = ids.astype("<u4")
    if plane == "byte":
        width = max(1, -(-int(raw.max(initial=0)).bit_length() // 8))
        return [p.tobytes() for p in raw.view(np.uint8).reshape(-1, 4).T[:width]]
    width = max(1, int(raw.max(initial=0)).bit_length())
    return [np.packbits((raw >> b).astype(np.uint8) & 1, bitorder="little").tobytes() for b in range(width)]


def join_planes(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    """Inverse of ``shuffle_planes``."""
    out = np.zeros(n, dtype="<u4")
    if plane == "byte":
        grid = out.view(np.uint8).reshape(-1, 4)
        for b, p in enumerate(planes):
            grid[:, b] = np.frombuffer(p, dtype=np.uint8)
        return out
    for b, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little").astype("<u4") << np.uint32(b)
    return out


def pack_segment(ids: np.ndarray, plane: str, block: int) -> tuple[list[dict], bytes]:
    """Chunk index and compressed planes of one segment."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    chunks, parts, at = [], [], 0
    for first in range(0, len(ids), block):
        own = ids[first:first + block]
        planes = [press.compress(p) for p in shuffle_planes(own, plane)]
        chunks.append({"first": first, "n": len(own), "at": at, "sizes": [len(p) for p in planes]})
        parts += planes
        at += sum(map(len, planes))
    return chunks, b"".join(parts)


def unpack_chunk(chunk: dict, planes: bytes, plane: str) -> np.ndarray:
    """Ids of one chunk, reading only its own planes."""
    open_, at, found = zstandard.ZstdDecompressor(), chunk["at"], []
    for size in chunk["sizes"]:
        found.append(open_.decompress(planes[at:at + size]))
        at += size
    return join_planes(found, chunk["n"], plane)


def unpack_range(chunks: list[dict], planes: bytes, plane: str, first: int, n: int) -> np.ndarray:
    """``n`` ids of a segment from ``first`` on, through the chunk index."""
    got = []
    for chunk in chunks:
        lo, hi = max(first, chunk["first"]), min(first + n, chunk["first"] + chunk["n"])
        if lo < hi:
            got.append(unpack_chunk(chunk, planes, plane)[lo - chunk["first"]:hi - chunk["first"]])
    return np.concatenate(got) if got else np.zeros(0, dtype="<u4")


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id",
              text_col: str = "text", plane: str = "byte", block: int = BLOCK_IDS, segment: int = SEGMENT_IDS,
              shards: int | None = None) -> None:
    """Encode whole texts and write them to ``path`` in ascending order of id.

    A null text is empty and still gets ``end_id``. Null ids come first; rows that repeat an id are ordered by the
    hash of their text. An empty table writes a folder without segments. Other columns are not read.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, words = TaskContext.get().partitionId(), encoder(tokenizer)
        done, number = 0, 0
        parts, ids, sizes, held = [], [], [], 0

        def flush():
            all_ids = np.frombuffer(b"".join(parts), dtype="<u4")
            chunks, planes = pack_segment(all_ids, plane, block)
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "segment": number, "shard_start": done, "n_ids": len(all_ids), "plane": plane,
                "doc_ids": ids, "doc_tokens": sizes, "chunks": chunks, "planes": planes}], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = words.encode(text.as_py()) + end
                parts.append(got)
                ids.append(doc_id)
                sizes.append(len(got) // 4)
                held += sizes[-1]
                if held >= segment:
                    yield flush()
                    done, number, parts, ids, sizes, held = done + held, number + 1, [], [], [], 0
        if parts:
            yield flush()

    schema = pa.schema([
        ("shard", pa.int32()), ("segment", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()),
        ("plane", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
        ("chunks", pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int32()), ("at", pa.int64()),
                                       ("sizes", pa.list_(pa.int32()))]))), ("planes", pa.binary())])
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), text_of(text_col).alias("_text"))
    parts = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartitionByRange(parts, "_id", F.xxhash64("_text")).sortWithinPartitions("_id", F.xxhash64("_text"))
    # planes are compressed already; a row group per few segments keeps readers of one segment small
    arrow(dealt, encode, SEGMENT).write.option("compression", "uncompressed").option(
        "parquet.block.size", str(16 << 20)).parquet(path)


def shard_starts(segments: DataFrame) -> DataFrame:
    """``shard, shard_at``: ids before each shard. One row per shard meets in one task."""
    from pyspark.sql import Window

    sums = segments.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("shard_at"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files; ``ids`` is binary, little-endian unsigned 32 bit."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                ids = unpack_range(one["chunks"], one["planes"], one["plane"], 0, one["n_ids"])
                ends = np.cumsum(np.array(one["doc_tokens"], dtype=np.int64))
                starts = ends - np.array(one["doc_tokens"], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(one["doc_ids"], pa.int64()), pa.array(starts + one["shard_start"] + one["shard_at"], pa.int64()),
                    pa.array(one["doc_tokens"], pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    segments = spark.read.schema(SEGMENT).parquet(path)
    starts = stored(shard_starts(spark.read.schema(SEGMENT).parquet(path).select("shard", "n_ids")))
    # one row per shard, a bound by the number of partitions written
    placed = segments.join(F.broadcast(starts), "shard")
    return arrow(placed, decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_range(spark: SparkSession, path: str, first: int, n: int) -> np.ndarray:
    """``n`` ids of the whole collection from ``first`` on. Only the index is read of other segments."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    starts = shard_starts(segments.select("shard", "n_ids"))
    at = F.col("shard_at") + F.col("shard_start")
    rows = segments.join(F.broadcast(starts), "shard").filter((at < first + n) & (at + F.col("n_ids") > first)).select(
        at.alias("at"), "n_ids", "plane", "chunks", "planes").orderBy("at").collect()
    got = []
    for row in rows:
        lo, hi = max(first, row["at"]), min(first + n, row["at"] + row["n_ids"])
        got.append(unpack_range([c.asDict() for c in row["chunks"]], bytes(row["planes"]), row["plane"], lo - row["at"], hi - lo))
    return np.concatenate(got) if got else np.zeros(0, dtype="<u4")
