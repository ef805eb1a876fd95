"""Readers and writers on temporary folders."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayweave.operators import spatial
from stayweave.sources import tables

HEADER = "timestamp\tdevice_aid\tlatitude\tlongitude\tlocation_method\textra\n"


def raw(root):
    for month, day, rows in [("01", "31", 2), ("02", "29", 3)]:
        folder = root / month / day
        folder.mkdir(parents=True)
        lines = "".join(f"{1704067200 + i}\tdev{i}\t59.{i}\t18.{i}\tGPS\tz\n" for i in range(rows))
        (folder / "part.gz").write_bytes(gzip.compress((HEADER + lines).encode()))


def test_raw_pings_and_day_listing(spark, tmp_path):
    raw(tmp_path)
    rows = tables.read_raw_pings(spark, f"{tmp_path}/*/*", ["device_aid", "timestamp", "latitude"])
    assert rows.columns == ["device_aid", "timestamp", "latitude"] and rows.count() == 5
    assert dict(rows.dtypes)["timestamp"] == "bigint"
    days = {(r["month"], r["day"]) for r in tables.day_paths(spark, str(tmp_path)).collect()}
    assert days == {("01", "31"), ("02", "29")}


def test_pings_by_group_and_day(spark, tmp_path):
    raw(tmp_path / "raw")
    rows = tables.read_raw_pings(spark, f"{tmp_path}/raw/*/*")
    tables.write_pings(rows, f"{tmp_path}/out", groups=3)
    back = tables.read_tables(spark, f"{tmp_path}/out", columns=["device_aid", "grp", "day"])
    assert back.count() == 5 and back.select("device_aid", "grp").distinct().count() == 3
    assert {str(r["day"]) for r in back.collect()} == {"2024-01-01"}


def test_batches_csv_and_transit(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "k string, batch int, v double")
    tables.write_batches(df, f"{tmp_path}/b")
    assert tables.read_tables(spark, f"{tmp_path}/b", columns=["k", "batch"]).count() == 2
    tables.write_table(df, f"{tmp_path}/t")
    assert tables.read_tables(spark, f"{tmp_path}/t").count() == 2
    tables.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, tables.read_csv(spark, f"{tmp_path}/c", df.schema).collect())) == [("a", 1, 0.5), ("b", 2, None)]
    (tmp_path / "stops.txt").write_text("stop_id,stop_name,stop_lat,stop_lon\ns1,Stop,59.3,18.1\n")
    assert tuple(tables.read_transit_stops(spark, f"{tmp_path}/stops.txt").first()) == ("s1", 59.3, 18.1)


SHAPES = {
    "one": [[(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 0.0)]],
    "hole": [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)], [(3.0, 3.0), (3.0, 6.0), (6.0, 6.0), (6.0, 3.0), (3.0, 3.0)]],
    "parts": [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [(5.0, 0.0), (9.0, 0.0), (9.0, 4.0), (5.0, 0.0)],
              [(7.0, 1.0), (8.0, 2.0), (8.0, 1.0), (7.0, 1.0)]]}
RINGS = "array<array<struct<x:double,y:double>>>"


def little_endian(parts, flip):
    """A WKB multipolygon written by hand, its rings turned round where asked."""
    def polygon(rings):
        body = b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in (r[::-1] if flip else r)) for r in rings)
        return struct.pack("<BII", 1, 3, len(rings)) + body
    return struct.pack("<BII", 1, 6, len(parts)) + b"".join(map(polygon, parts))


def test_rings_survive_wkb(spark, tmp_path):
    df = spark.createDataFrame([*SHAPES.items(), ("none", None)], f"id string, rings {RINGS}")
    tables.write_table(df.select("id", tables.rings_to_wkb("rings").alias("geometry")), f"{tmp_path}/g")
    back = tables.read_tables(spark, f"{tmp_path}/g").select("id", tables.wkb_to_rings("geometry").alias("rings")).collect()
    assert {r.id: r.rings and [[tuple(p) for p in ring] for ring in r.rings] for r in back} == {**SHAPES, "none": None}


@pytest.mark.parametrize("flip", [False, True])
def test_wkb_of_either_order_and_turn(spark, flip):
    rings = SHAPES["parts"]
    df = spark.createDataFrame([(bytearray(little_endian([rings[:1], rings[1:]], flip)),)], "geometry binary")
    got = [[tuple(p) for p in r] for r in df.select(tables.wkb_to_rings("geometry").alias("r")).first().r]
    assert [set(r) for r in got] == [set(r) for r in rings]
    assert [tables._turns_left(np.array(r)) for r in got] == [True, True, False]


def test_other_geometry_is_an_error(spark):
    df = spark.createDataFrame([(bytearray(struct.pack("<BIdd", 1, 1, 0.0, 0.0)),)], "geometry binary")
    with pytest.raises(Exception, match="no polygon"):
        df.select(tables.wkb_to_rings("geometry")).collect()


def test_holes_and_parts(spark):
    rows = [(k, v, x, y, want) for k, x, y, want in [
        ("hole", 1.0, 1.0, 0.0), ("hole", 4.5, 4.0, 1.0), ("hole", -2.0, 4.0, 2.0), ("parts", 6.0, 0.5, 0.0), ("parts", 3.0, 0.0, 2.0),
        ("parts", 7.9, 1.5, 0.1)] for v in [SHAPES[k]]]
    df = spark.createDataFrame(rows, f"id string, rings {RINGS}, x double, y double, want double")
    far = spatial.polygon_distance(F.col("x"), F.col("y"), F.col("rings"), True)
    assert all(abs(r.far - r.want) < 1e-9 for r in df.select("want", far.alias("far")).collect())
    area = spatial.clipped_area(F.col("rings"), *[F.lit(v) for v in (0.0, 0.0, 5.0, 5.0)], many=True)
    got = {r.id: r.a for r in df.select("id", area.alias("a")).distinct().collect()}
    assert abs(got["hole"] - 21.0) < 1e-9 and abs(got["parts"] - 0.5) < 1e-9
