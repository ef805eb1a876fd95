"""Readers and writers: raw pings, Parquet by batch, CSV, JDBC and geometry tables."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayweave.operators.filters import stable_hash

PING_SCHEMA = T.StructType([
    T.StructField("timestamp", T.LongType()), T.StructField("device_aid", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("location_method", T.StringType()),
])
GROUPS = 50


def read_raw_pings(spark: SparkSession, path: str, columns: list[str] | None = None,
                   schema: T.StructType = PING_SCHEMA) -> DataFrame:
    """Tab-separated pings, gzip or plain, with a header; ``path`` may be a glob over months and days.

    The first file's header decides the column order; a file with another order is an error. A gzip file is read by one task; the shuffle of
    ``write_pings`` or of the next step spreads its rows.
    """
    names = spark.read.csv(path, sep="\t", header=True, inferSchema=False).columns
    types = {f.name: f.dataType for f in schema}
    ordered = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
    rows = spark.read.csv(path, sep="\t", header=True, schema=ordered, enforceSchema=False)
    return rows.select(*(columns or [f.name for f in schema if f.name in names]))


def day_paths(spark: SparkSession, root: str) -> DataFrame:
    """Months, days and files present under ``root/month/day``; the folders decide which days exist."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -3).alias("month"), F.element_at(parts, -2).alias("day"), "path")


def write_pings(pings: DataFrame, path: str, groups: int = GROUPS, mode: str = "append") -> None:
    """Parquet by device group and day. The group is a hash of the device, computed per row."""
    placed = pings.withColumns({
        "grp": (stable_hash("device_aid") % groups).cast("int"),
        "day": F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd")})
    # The hour of the day in the key keeps one busy device and day from being one task.
    spread = placed.repartition("grp", "day", F.pmod(F.floor(F.col("timestamp") / 3600), F.lit(24)))
    spread.write.mode(mode).partitionBy("grp", "day").parquet(path)


def read_tables(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet files or folders as one table, only the named columns."""
    rows = spark.read.parquet(*paths)
    return rows.select(*columns) if columns else rows


def write_batches(rows: DataFrame, path: str, batch: str = "batch", mode: str = "overwrite", files: int = 4) -> None:
    """One Parquet folder per batch, of at most ``files`` files each."""
    rows.repartition(batch, F.pmod(F.xxhash64(*rows.columns), F.lit(files))).write.mode(mode).partitionBy(batch).parquet(path)


def write_table(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result table as Parquet."""
    rows.write.mode(mode).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).csv(path, header=True)


def read_transit_stops(spark: SparkSession, path: str) -> DataFrame:
    """GTFS ``stops.txt``: id and coordinates, whatever other columns the feed has."""
    rows = spark.read.csv(path, header=True)
    return rows.select("stop_id", F.col("stop_lat").cast("double").alias("latitude"),
                       F.col("stop_lon").cast("double").alias("longitude"))


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """Database table; ``partition`` is (column, lowest, highest, number of reads)."""
    options = dict(url=url, table=table, properties=properties or {})
    if partition:
        column, low, high, count = partition
        options.update(column=column, lowerBound=low, upperBound=high, numPartitions=count)
    return spark.read.jdbc(**options)


def write_jdbc(rows: DataFrame, url: str, table: str, mode: str = "append", properties: dict | None = None,
               batch_rows: int = 5000) -> None:
    """Append to or replace a database table."""
    rows.write.option("batchsize", batch_rows).jdbc(url, table, mode=mode, properties=properties or {})


# WKB: byte order, type, then for a polygon its rings (number of points and pairs of doubles), for a multipolygon its polygons.
WKB_POLYGON, WKB_MULTIPOLYGON = 3, 6
RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
RINGS = T.ArrayType(RING)


def _turns_left(points: np.ndarray) -> bool:
    x, y = points[:, 0], points[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) > 0


def _polygon(data: bytes, at: int, rings: list[np.ndarray]) -> int:
    """Read one polygon at ``at`` into ``rings``, outer ring counter-clockwise and holes clockwise; where it ends."""
    order = ">" if data[at] == 0 else "<"
    kind, count = struct.unpack_from(order + "II", data, at + 1)
    if kind != WKB_POLYGON:
        raise ValueError(f"WKB type {kind} in a multipolygon")
    at += 9
    for k in range(count):
        (n,) = struct.unpack_from(order + "I", data, at)
        points = np.frombuffer(data, dtype=order + "f8", count=2 * n, offset=at + 4).reshape(n, 2)
        rings.append(points if _turns_left(points) == (k == 0) else points[::-1])
        at += 4 + 16 * n
    return at


@F.arrow_udf(RINGS)
def wkb_to_rings(shapes: pa.Array) -> pa.Array:
    """All rings of WKB polygons and multipolygons, either byte order, parts after one another. NULL stays NULL; any
    other geometry is an error, so that no shape gets lost."""
    rings, counts, known = [], [], []
    for data in shapes.to_pylist():
        before = len(rings)
        if data is not None:
            order = ">" if data[0] == 0 else "<"
            kind, parts = struct.unpack_from(order + "II", data, 1)
            if kind == WKB_POLYGON:
                _polygon(data, 0, rings)
            elif kind == WKB_MULTIPOLYGON:
                at = 9
                for _ in range(parts):
                    at = _polygon(data, at, rings)
            else:
                raise ValueError(f"WKB type {kind} is no polygon")
        known.append(data is not None)
        counts.append(len(rings) - before)
    flat = np.concatenate(rings).astype("<f8") if rings else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["x", "y"])
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rings)]).astype(np.int32)), points)
    offsets = np.cumsum([0, *counts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), inner, mask=pa.array(~np.array(known, dtype=bool)))


@F.arrow_udf(T.BinaryType())
def rings_to_wkb(shapes: pa.Array) -> pa.Array:
    """``array<array<struct<x,y>>>`` to big-endian WKB: an outer ring (counter-clockwise) begins a part, the clockwise
    rings after it are its holes. Open rings are closed; one part is a polygon, more are a multipolygon."""
    out = []
    for shape in shapes:
        if not shape.is_valid:
            out.append(None)
            continue
        parts: list[list[bytes]] = []
        for ring in shape.values:
            points = np.stack([ring.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1)
            if (points[0] != points[-1]).any():
                points = np.concatenate([points, points[:1]])
            packed = struct.pack(">I", len(points)) + points.astype(">f8").tobytes()
            if not parts or _turns_left(points):
                parts.append([packed])
            else:
                parts[-1].append(packed)
        polygons = [struct.pack(">BII", 0, WKB_POLYGON, len(p)) + b"".join(p) for p in parts]
        out.append(polygons[0] if len(polygons) == 1 else struct.pack(">BII", 0, WKB_MULTIPOLYGON, len(polygons)) + b"".join(polygons))
    return pa.array(out, pa.binary())
