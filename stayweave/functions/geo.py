"""Geometry as Column expressions: distances, transverse Mercator, hexagonal grid."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayweave import constants as C

EARTH_RADIUS_KM = 6371


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance in kilometres between two points in degrees."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def in_box(lat, lon, box=C.CITY_BOX) -> Column:
    """True inside ``box`` (lon min, lat min, lon max, lat max), borders included."""
    west, south, east, north = box
    return _col(lat).between(south, north) & _col(lon).between(west, east)


def valid_coordinate(lat, lon) -> Column:
    """True for coordinates inside the limits of the projection; NULL stays NULL."""
    return _col(lat).between(C.MIN_LATITUDE, C.MAX_LATITUDE) & _col(lon).between(-C.MAX_LONGITUDE, C.MAX_LONGITUDE)


def is_finite(*cols) -> Column:
    """True when every column is a number: not NULL, not NaN, not infinite."""
    ok = F.lit(True)
    for c in map(_col, cols):
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return ok


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add long expressions as columns that filters and joins above do not copy into the scan.

    The optimizer moves filters, and the NULL checks of join keys, below a projection by writing
    its expressions out again. It does not move them below a one-row ``inline``.
    """
    row = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(row))


@dataclass(frozen=True)
class TransverseMercator:
    """Gauss-Krueger series on an ellipsoid, in metres, better than a millimetre near the meridian."""

    flattening: float
    semi_major: float = 6378137.0
    scale: float = 0.9996
    false_easting: float = 500000.0

    @property
    def third(self) -> float:
        return self.flattening / (2 - self.flattening)

    @property
    def e2(self) -> float:
        return self.flattening * (2 - self.flattening)

    @property
    def radius(self) -> float:
        n = self.third
        return self.scale * self.semi_major / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def project(self, df: DataFrame, lat, lon, meridian, x: str, y: str, false_northing=0.0) -> DataFrame:
        """Add ``x`` (easting) and ``y`` (northing) of a point in degrees.

        Intermediate values are columns of their own, so each is computed once per row and the
        expression stays small enough to compile.
        """
        n, e2 = self.third, self.e2
        c0, c1 = e2, (5 * e2**2 - e2**3) / 6
        c2, c3 = (104 * e2**3 - 45 * e2**4) / 120, 1237 * e2**4 / 1260
        terms = (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        )
        df = df.withColumns({
            "_tm_lat": F.radians(_col(lat)), "_tm_lon": F.radians(_col(lon) - meridian),
            "_tm_north": F.lit(0.0) + false_northing,
        }).withColumn("_tm_sin", F.sin("_tm_lat"))
        s2 = F.col("_tm_sin") * F.col("_tm_sin")
        series = F.lit(c0) + s2 * (F.lit(c1) + s2 * (F.lit(c2) + s2 * c3))
        df = df.withColumn("_tm_conf", F.col("_tm_lat") - F.col("_tm_sin") * F.cos("_tm_lat") * series)
        df = df.withColumns({
            "_tm_xi": F.atan(F.tan("_tm_conf") / F.cos("_tm_lon")),
            "_tm_eta": F.atanh(F.cos("_tm_conf") * F.sin("_tm_lon")),
        })
        xi, eta = F.col("_tm_xi"), F.col("_tm_eta")
        north, east = xi, eta
        for k, beta in enumerate(terms, start=1):
            north = north + beta * F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k))
            east = east + beta * F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k))
        df = computed_once(df, {
            x: east * self.radius + self.false_easting, y: north * self.radius + F.col("_tm_north")})
        return df.drop("_tm_lat", "_tm_lon", "_tm_north", "_tm_sin", "_tm_conf", "_tm_xi", "_tm_eta")

    def unproject(self, df: DataFrame, x, y, meridian, lat: str, lon: str, false_northing=0.0) -> DataFrame:
        """Add ``lat`` and ``lon`` in degrees of a point in metres."""
        n, e2 = self.third, self.e2
        terms = (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        )
        d0, d1 = e2 + e2**2 + e2**3 + e2**4, -(7 * e2**2 + 17 * e2**3 + 30 * e2**4) / 6
        d2, d3 = (224 * e2**3 + 889 * e2**4) / 120, -(4279 * e2**4) / 1260
        df = df.withColumns({
            "_tm_xi": (_col(y) - false_northing) * (1 / self.radius),
            "_tm_eta": (_col(x) - self.false_easting) * (1 / self.radius)})
        xi, eta = F.col("_tm_xi"), F.col("_tm_eta")
        xi0, eta0 = xi, eta
        for k, delta in enumerate(terms, start=1):
            xi0 = xi0 - delta * F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k))
            eta0 = eta0 - delta * F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k))
        df = df.withColumns({"_tm_x0": xi0, "_tm_e0": eta0}).withColumn(
            "_tm_conf", F.asin(F.sin("_tm_x0") / F.cosh("_tm_e0")))
        df = df.withColumn("_tm_s2", F.sin("_tm_conf") * F.sin("_tm_conf"))
        s2 = F.col("_tm_s2")
        series = F.lit(d0) + s2 * (F.lit(d1) + s2 * (F.lit(d2) + s2 * d3))
        return df.withColumns({
            lat: F.degrees(F.col("_tm_conf") + F.sin("_tm_conf") * F.cos("_tm_conf") * series),
            lon: F.degrees(F.atan(F.sinh("_tm_e0") / F.cos("_tm_x0"))) + meridian,
        }).drop("_tm_xi", "_tm_eta", "_tm_x0", "_tm_e0", "_tm_conf", "_tm_s2")


# National grid: GRS80, meridian 15 degrees east (EPSG:3006). UTM: WGS84, meridian by zone.
NATIONAL_MERIDIAN = 15.0
NATIONAL = TransverseMercator(flattening=1 / 298.257222101)
UTM = TransverseMercator(flattening=1 / 298.257223563)
UTM_SOUTH_NORTHING = 10_000_000.0


def with_degrees(df: DataFrame, x="x", y="y", lat="latitude", lon="longitude") -> DataFrame:
    """Add degrees of a point in national grid metres."""
    return NATIONAL.unproject(df, x, y, NATIONAL_MERIDIAN, lat, lon)


def utm_zone(lon) -> Column:
    """UTM zone number 1..60 of a longitude."""
    return (F.floor((_col(lon) + 180) / 6) % 60 + 1).cast("int")


def has_projection(lat, lon, meridian: float) -> Column:
    """True where a point is known, valid and less than a quarter turn from the meridian, which is
    where the projected coordinates are finite."""
    return is_finite(lat, lon) & valid_coordinate(lat, lon) & (F.abs(_col(lon) - meridian) < 90)


def with_national_xy(df: DataFrame, lat="latitude", lon="longitude", x="x", y="y") -> DataFrame:
    """Add national grid metres; points without a finite projection are dropped."""
    known = df.filter(has_projection(lat, lon, NATIONAL_MERIDIAN))
    return NATIONAL.project(known, lat, lon, NATIONAL_MERIDIAN, x, y)


def with_utm_xy(df: DataFrame, lat="latitude", lon="longitude", x="x", y="y") -> DataFrame:
    """Add UTM metres in the zone of each point; unknown or invalid points are dropped."""
    known = df.filter(is_finite(lat, lon) & valid_coordinate(lat, lon))
    meridian = (utm_zone(lon) * 6 - 183).cast("double")
    northing = F.when(_col(lat) < 0, UTM_SOUTH_NORTHING).otherwise(0.0)
    return UTM.project(known, lat, lon, meridian, x, y, northing)


# A cell id packs the two axial coordinates of a pointy-top hexagon into one bigint.
_OFFSET, _SPAN = 1 << 20, 1 << 21


def hex_cell(x, y, edge: float = C.HEX_EDGE_M) -> Column:
    """Id of the hexagon holding a projected point: cube rounding of axial coordinates."""
    x, y = _col(x), _col(y)
    q = (x * (math.sqrt(3) / 3) - y / 3) / edge
    r = y * (2 / 3) / edge
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    cell_q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    cell_r = F.when((dr >= dq) & (dr > ds), -rq - rs).otherwise(rr)
    return ((cell_q + _OFFSET) * _SPAN + cell_r + _OFFSET).cast("bigint")


def hex_axial(cell) -> tuple[Column, Column]:
    """Axial coordinates ``(q, r)`` of a cell id."""
    cell = _col(cell)
    q = F.floor(cell / F.lit(_SPAN)) - _OFFSET
    return q.cast("bigint"), (F.pmod(cell, F.lit(_SPAN)) - _OFFSET).cast("bigint")


def hex_center(cell, edge: float = C.HEX_EDGE_M) -> tuple[Column, Column]:
    """Projected centre ``(x, y)`` of a cell."""
    q, r = hex_axial(cell)
    return (q + r / 2) * (math.sqrt(3) * edge), r * (1.5 * edge)


def hex_boundary(cell, edge: float = C.HEX_EDGE_M) -> Column:
    """Six corners of a cell as ``array<struct<x,y>>``, counter-clockwise from the east side."""
    x, y = hex_center(cell, edge)
    corners = [math.radians(60 * k - 30) for k in range(6)]
    return F.array(*[
        F.struct((x + edge * math.cos(a)).alias("x"), (y + edge * math.sin(a)).alias("y")) for a in corners
    ])


def with_cell(df: DataFrame, lat="latitude", lon="longitude", cell="h3_id") -> DataFrame:
    """Add the hexagon id of a point in degrees; points without a projection are dropped."""
    placed = with_national_xy(df, lat, lon, "_hx", "_hy")
    return computed_once(placed, {cell: hex_cell("_hx", "_hy")}).drop("_hx", "_hy")
