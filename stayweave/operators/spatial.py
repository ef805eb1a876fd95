"""Spatial joins as bucket equi-joins with an exact test inside the bucket.

A ring is ``array<struct<x,y>>`` in metres, open or closed. A shape is one ``ring``, or ``rings``: the outer rings of
all its parts counter-clockwise and their holes clockwise, as ``tables.wkb_to_rings`` gives them. Repeated coordinates
are looked up once and joined back. Polygons are met through an index of the edges at each cell, never whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayweave import constants as C
from stayweave.functions import geo
from stayweave.operators.skew import salted_join
from stayweave.session import cut_lineage


def _edges(ring: Column, many: bool = False) -> Column:
    """Edges as ``array<struct<a,b>>`` of a ring, or of ``many`` rings; closing edges of open rings are included."""
    if many:
        return F.flatten(F.transform(ring, lambda one: _edges(one)))
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def with_rings(shapes: DataFrame) -> DataFrame:
    """Shapes with ``rings``; one ``ring`` becomes a list of it."""
    return shapes if "rings" in shapes.columns else shapes.withColumn("rings", F.array("ring")).drop("ring")


def ring_bounds(ring: str | Column, many: bool = False) -> dict[str, Column]:
    """Bounding box of a ring, or of ``many``."""
    ring = F.col(ring) if isinstance(ring, str) else ring
    ring = F.flatten(ring) if many else ring
    return {"x_min": F.array_min(ring["x"]), "x_max": F.array_max(ring["x"]),
            "y_min": F.array_min(ring["y"]), "y_max": F.array_max(ring["y"])}


def in_ring(x: Column, y: Column, ring: Column, many: bool = False) -> Column:
    """Ray casting: odd number of edges to the right of the point, so holes are outside and parts inside. Borders are
    not decided here."""
    def crosses(e):
        a, b = e["a"], e["b"]
        straddles = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return straddles & (x < at)
    return F.size(F.filter(_edges(ring, many), crosses)) % 2 == 1


def ring_distance(x: Column, y: Column, ring: Column, many: bool = False) -> Column:
    """Distance in metres from a point to the nearest line of the ring or rings."""
    return _nearest_edge(x, y, _edges(ring, many))


def _nearest_edge(x: Column, y: Column, edges: Column) -> Column:
    def to_edge(e):
        a, b = e["a"], e["b"]
        ex, ey = b["x"] - a["x"], b["y"] - a["y"]
        along = F.coalesce(F.try_divide((x - a["x"]) * ex + (y - a["y"]) * ey, ex * ex + ey * ey), F.lit(0.0))
        along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        dx, dy = x - a["x"] - along * ex, y - a["y"] - along * ey
        return F.sqrt(dx * dx + dy * dy)
    return F.array_min(F.transform(edges, to_edge))


def polygon_distance(x: Column, y: Column, ring: Column, many: bool = False) -> Column:
    """Zero inside the polygon, else the distance to its border."""
    return F.when(in_ring(x, y, ring, many), F.lit(0.0)).otherwise(ring_distance(x, y, ring, many))


def _index(value: Column, size: float) -> Column:
    """Bucket number; a product, which unlike a quotient is never NULL for a known value."""
    return F.floor(value * (1.0 / size))


def _point_bucket(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({"_bx": _index(F.col("x"), size), "_by": _index(F.col("y"), size)})


def _box_buckets(boxes: DataFrame, size: float, reach: float = 0.0) -> DataFrame:
    """Repeat rows with ``x_min..y_max`` once per bucket their box, grown by ``reach``, touches."""
    def span(low, high):
        return F.explode(F.sequence(_index(F.col(low) - reach, size), _index(F.col(high) + reach, size)))
    return boxes.withColumn("_bx", span("x_min", "x_max")).withColumn("_by", span("y_min", "y_max"))


def nearby_pois(stops: DataFrame, pois: DataFrame, radius: float = C.POI_RADIUS_M, k: int = C.POI_NEAREST) -> DataFrame:
    """Add the number of places within ``radius`` metres and the ids, categories and kinds of the
    nearest ``k``, sorted by distance and id; NULL lists where there is none.

    ``stops`` has latitude, longitude; ``pois`` has osm_id, primary, kind, latitude, longitude.
    """
    spots = geo.with_national_xy(stops.select("latitude", "longitude").distinct())
    placed = geo.with_national_xy(pois).select("osm_id", "primary", "kind", "x", "y")
    # All places at one point share a distance: only their k smallest ids can be listed.
    at_point = W.partitionBy("x", "y").orderBy("osm_id")
    listed = (
        placed.withColumn("_r", F.row_number().over(at_point)).filter(F.col("_r") <= k)
        .groupBy("x", "y").agg(F.collect_list(F.struct("osm_id", "primary", "kind")).alias("_members"))
    )
    counts = placed.groupBy("x", "y").agg(F.count("*").alias("_n"), F.min("osm_id").alias("_first"))
    points = listed.join(counts, ["x", "y"]).select(
        F.col("x").alias("px"), F.col("y").alias("py"), F.col("x").alias("x_min"), F.col("x").alias("x_max"),
        F.col("y").alias("y_min"), F.col("y").alias("y_max"), "_members", "_n", "_first")
    pairs = salted_join(_point_bucket(spots, radius), _box_buckets(points, radius, radius), ["_bx", "_by"])
    distance = F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2))
    pairs = pairs.select("latitude", "longitude", distance.alias("_d"), "_members", "_n", "_first").filter(
        F.col("_d") <= radius)
    totals = pairs.groupBy("latitude", "longitude").agg(F.sum("_n").alias("poi_num"))
    nearest = W.partitionBy("latitude", "longitude").orderBy("_d", "_first")
    members = F.transform("_members", lambda m: F.struct(F.col("_d").alias("d"), m["osm_id"].alias("osm_id"),
                                                         m["primary"].alias("primary"), m["kind"].alias("kind")))
    best = (
        pairs.withColumn("_r", F.row_number().over(nearest)).filter(F.col("_r") <= k)
        .groupBy("latitude", "longitude").agg(F.slice(F.array_sort(F.flatten(F.collect_list(members))), 1, k).alias("_p"))
    )
    found = totals.join(best, ["latitude", "longitude"]).select(
        "latitude", "longitude", "poi_num", F.col("_p")["osm_id"].alias("osm_id"),
        F.col("_p")["primary"].alias("primary"), F.col("_p")["kind"].alias("kind"))
    return stops.join(found, ["latitude", "longitude"], "left").withColumn(
        "poi_num", F.coalesce("poi_num", F.lit(0)))


def link_stops(stops: DataFrame, pois: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """Stops of the wanted devices with their hexagon and nearby places."""
    if devices is not None:
        stops = stops.join(devices.select("device_aid"), "device_aid", "left_semi")
    return geo.with_cell(nearby_pois(stops, pois))


# ---- polygons by the edges of a cell -----------------------------------------------------------------------------

#: Grid lines lie beside round coordinates, where corners and borders of shapes often are.
SHIFT = 0.381966
_SEGMENT = "struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>"


def _cell(value: Column, size: float) -> Column:
    return _index(value - SHIFT * size, size)


def _line(cell: Column, size: float) -> Column:
    """Lower border of a cell."""
    return cell * size + SHIFT * size


def _at(e: Column, of: str, by: str, value: Column) -> Column:
    """Coordinate ``of`` where an edge has ``value`` of the other one; NULL for an edge that keeps that one."""
    a, b = e["a"], e["b"]
    return a[of] + F.try_divide((value - a[by]) * (b[of] - a[of]), b[by] - a[by])


def _low(e: Column, axis: str) -> Column:
    return F.least(e["a"][axis], e["b"][axis])


def _high(e: Column, axis: str) -> Column:
    return F.greatest(e["a"][axis], e["b"][axis])


def edge_cells(shapes: DataFrame, size: float, reach: float = 0.0) -> DataFrame:
    """Index of polygons by cells of a grid: ``_sid, _bx, _by, _odd, _near`` from ``_sid, rings``.

    A cell on a border has the edges within ``reach`` of it and whether its lower left corner is inside (``_odd``); a cell
    inside has no edges. No row holds more of a shape than what lies at its cell, and cells outside have no row.

    A corner is inside if the lines of an odd number of edges cross the grid line through it further right. Such
    crossings are counted per cell and summed from the right, along one grid line of one shape.
    """
    grown = reach + 1e-6
    edges = shapes.select("_sid", F.explode(_edges(F.col("rings"), True)).alias("e"))
    e = F.col("e")
    rows = edges.withColumn("_by", F.explode(F.sequence(_cell(_low(e, "y") - grown, size), _cell(_high(e, "y") + grown, size))))
    held = lambda v: F.greatest(_low(e, "y"), F.least(_high(e, "y"), v))
    bottom = _line(F.col("_by"), size)
    ends = [F.coalesce(_at(e, "x", "y", held(v)), other) for v, other in (
        (bottom - grown, e["a"]["x"]), (bottom + size + grown, e["b"]["x"]))]
    touched = rows.withColumn("_bx", F.explode(F.sequence(_cell(F.least(*ends) - grown, size), _cell(F.greatest(*ends) + grown, size))))
    straddles = (e["a"]["y"] > bottom) != (e["b"]["y"] > bottom)
    crossed = edges.withColumn("_by", F.explode(F.sequence(_cell(_low(e, "y"), size), _cell(_high(e, "y"), size) + 1))).filter(straddles)
    column = F.ceil((_at(e, "x", "y", bottom) - SHIFT * size) * (1.0 / size)) - 1
    border = touched.select("_sid", "_by", "_bx", "e", F.lit(0).alias("n")).unionByName(
        crossed.select("_sid", "_by", column.alias("_bx"), F.lit(None).cast(_SEGMENT).alias("e"), F.lit(1).alias("n")))
    cells = border.groupBy("_sid", "_by", "_bx").agg(F.collect_list("e").alias("_near"), F.sum("n").alias("_n"))
    right = W.partitionBy("_sid", "_by").orderBy(F.col("_bx").desc())
    cells = cut_lineage(cells.withColumns({"_right": F.sum("_n").over(right), "_next": F.lag("_bx").over(right)}))
    odd = lambda n: n % 2 == 1
    between = cells.filter(odd(F.col("_right") - F.col("_n")) & (F.col("_next") > F.col("_bx") + 1)).select(
        "_sid", F.explode(F.sequence(F.col("_bx") + 1, F.col("_next") - 1)).alias("_bx"), "_by", F.lit(True).alias("_odd"),
        F.array().cast(f"array<{_SEGMENT}>").alias("_near"))
    return cells.select("_sid", "_bx", "_by", odd(F.col("_right")).alias("_odd"), "_near").unionByName(between)


def cell_distance(size: float) -> Column:
    """Zero inside, else the distance to the nearest edge of the row's cell: of a point ``x, y`` joined with its cell's row.

    From the cell's corner the way to the point goes up and then right; each edge it crosses changes sides.
    """
    x, y = F.col("x"), F.col("y")
    left, bottom = _line(F.col("_bx"), size), _line(F.col("_by"), size)

    def up(e):
        at = F.coalesce(_at(e, "y", "x", left), F.lit(float("inf")))
        return ((e["a"]["x"] > left) != (e["b"]["x"] > left)) & (at > bottom) & (at <= y)

    def along(e):
        at = F.coalesce(_at(e, "x", "y", y), F.lit(float("inf")))
        return ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (at > left) & (at <= x)

    changes = F.size(F.filter("_near", up)) + F.size(F.filter("_near", along))
    return F.when((changes % 2 == 1) != F.col("_odd"), F.lit(0.0)).otherwise(_nearest_edge(x, y, F.col("_near")))


def _at_polygons(points: DataFrame, shapes: DataFrame, size: float, reach: float) -> tuple[DataFrame, DataFrame]:
    """``latitude, longitude, _sid, _d`` of each distinct point and each shape within ``reach``; the numbered shapes."""
    numbered = cut_lineage(with_rings(shapes).withColumn("_sid", F.monotonically_increasing_id()))
    spots = geo.with_national_xy(points.select("latitude", "longitude").distinct())
    spots = spots.withColumns({"_bx": _cell(F.col("x"), size), "_by": _cell(F.col("y"), size)})
    met = salted_join(spots, cut_lineage(edge_cells(numbered.select("_sid", "rings"), size, reach)), ["_bx", "_by"])
    found = met.select("latitude", "longitude", "_sid", cell_distance(size).alias("_d")).filter(F.col("_d") <= reach)
    return found, numbered.drop("rings")


def nearest_building(homes: DataFrame, buildings: DataFrame, reach: float = C.BUILDING_BUFFER_M,
                     bucket: float = 250.0) -> DataFrame:
    """Add the nearest building within ``reach`` metres of each home: ``b_id, b_class, b_source``
    and the distance; NULL where there is none. Ties go to the smallest id.

    ``buildings`` has id, class, source and a shape.
    """
    found, numbered = _at_polygons(homes, buildings, bucket, reach)
    best = found.join(numbered, "_sid").groupBy("latitude", "longitude").agg(
        F.min_by(F.struct(F.col("id").alias("b_id"), F.col("class").alias("b_class"),
                          F.col("source").alias("b_source"), F.col("_d").alias("b_distance")), F.struct("_d", "id")).alias("_b"))
    return homes.join(best, ["latitude", "longitude"], "left").select(*homes.columns, "_b.*")


def within_zones(points: DataFrame, zones: DataFrame, attributes: list[str], bucket: float = 1000.0) -> DataFrame:
    """Add the attributes of every zone whose polygon touches the point; NULL where there is none.

    ``zones`` has a shape and the attributes.
    """
    found, numbered = _at_polygons(points, zones, bucket, 0.0)
    touched = found.join(numbered, "_sid").select("latitude", "longitude", *attributes)
    return points.join(touched, ["latitude", "longitude"], "left").select(*points.columns, *attributes)


def points_in_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points whose hexagon is among ``cells`` (``h3_id``), with that id."""
    return geo.with_cell(points).join(cells.select("h3_id").distinct(), "h3_id", "left_semi")


def held_area(edges: Column, x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    """Signed area in square metres between some ``edges`` of a polygon and the bottom of an axis-aligned rectangle.

    Summed over all edges, its size is the area of the polygon inside the rectangle: each edge gives the integral of its
    height, held between the rectangle's bottom and top, over its part between left and right. Any simple ring works;
    holes turn the other way and so count against their outer rings.
    """
    width, height = x_max - x_min, y_max - y_min

    def below(t):
        """Integral of the held height from minus infinity to t."""
        held = F.greatest(F.lit(0.0), F.least(height, t))
        return held * held / 2 + height * F.greatest(F.lit(0.0), t - height)

    def part(total, e):
        ax, ay = e["a"]["x"] - x_min, e["a"]["y"] - y_min
        bx, by = e["b"]["x"] - x_min, e["b"]["y"] - y_min
        cx, dx = (F.greatest(F.lit(0.0), F.least(width, v)) for v in (ax, bx))
        slope = F.try_divide(by - ay, bx - ax)
        cy, dy = ay + (cx - ax) * slope, ay + (dx - ax) * slope
        flat = F.greatest(F.lit(0.0), F.least(height, ay))
        mean = F.when(F.abs(dy - cy) < 1e-9, F.greatest(F.lit(0.0), F.least(height, (cy + dy) / 2))).otherwise(
            F.try_divide(below(dy) - below(cy), dy - cy))
        return total + F.when(bx == ax, 0.0).otherwise((dx - cx) * F.coalesce(mean, flat))

    return F.aggregate(edges, F.lit(0.0), part)


def clipped_area(ring: Column, x_min: Column, y_min: Column, x_max: Column, y_max: Column, many: bool = False) -> Column:
    """Area in square metres of a whole polygon inside an axis-aligned rectangle."""
    return F.abs(held_area(_edges(ring, many), x_min, y_min, x_max, y_max))


def strip_edges(shapes: DataFrame, size: float) -> DataFrame:
    """``_sid, _strip, _near``: edges of each shape in upright strips, cut at the strips' borders."""
    edges = shapes.select("_sid", F.explode(_edges(F.col("rings"), True)).alias("e")).filter("e.a.x <> e.b.x")
    e = F.col("e")
    cut = edges.withColumn("_strip", F.explode(F.sequence(_cell(_low(e, "x"), size), _cell(_high(e, "x"), size))))
    left = _line(F.col("_strip"), size)

    def held(end):
        x = F.greatest(left, F.least(left + size, end["x"]))
        return F.when(x == end["x"], end).otherwise(F.struct(x.alias("x"), _at(e, "y", "x", x).alias("y")))

    pieces = cut.select("_sid", "_strip", F.struct(held(e["a"]).alias("a"), held(e["b"]).alias("b")).alias("e"))
    return pieces.groupBy("_sid", "_strip").agg(F.collect_list("e").alias("_near"))


def overlay_squares(buildings: DataFrame, squares: DataFrame, size: float = 1000.0) -> DataFrame:
    """Intersection area in m2 of each building (id and shape) with each square (Ruta, x_min..y_max).

    Shapes and squares meet by their boxes; edges follow in strips, so a square gets those above, in and below it, and a
    long outline is never copied whole.
    """
    box = ["x_min", "y_min", "x_max", "y_max"]
    shapes = cut_lineage(with_rings(buildings).select("id", "rings").withColumns(ring_bounds("rings", True)).withColumn(
        "_sid", F.monotonically_increasing_id()))
    pieces = _box_buckets(shapes.drop("rings"), size).select("_bx", "_by", "id", "_sid", F.col("x_min").alias("_w"), F.col("x_max").alias("_e"),
                                                             F.col("y_min").alias("_s"), F.col("y_max").alias("_t"))
    tiles = _box_buckets(squares.select("Ruta", *box), size)
    # A pair that meets in several buckets is kept in the first bucket both cover.
    first = (
        (F.col("_bx") == _index(F.greatest("_w", "x_min"), size)) & (F.col("_by") == _index(F.greatest("_s", "y_min"), size)))
    overlap = (F.col("_w") < F.col("x_max")) & (F.col("_e") > F.col("x_min")) & (F.col("_s") < F.col("y_max")) & (F.col("_t") > F.col("y_min"))
    met = salted_join(pieces, tiles, ["_bx", "_by"]).filter(first & overlap)
    strips = met.withColumn("_strip", F.explode(F.sequence(
        _cell(F.greatest("_w", "x_min"), size), _cell(F.least("_e", "x_max"), size)))).select("id", "Ruta", *box, "_sid", "_strip")
    # the edges grow with the shapes, and their compressed file looks small enough to broadcast
    near = strip_edges(shapes.select("_sid", "rings"), size).hint("merge")
    parts = strips.join(near, ["_sid", "_strip"]).select(
        "_sid", "id", "Ruta", held_area(F.col("_near"), *map(F.col, box)).alias("area"))
    return parts.groupBy("_sid", "id", "Ruta").agg(F.abs(F.sum("area")).alias("area")).select("id", "Ruta", "area").filter("area > 0")
