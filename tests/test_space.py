"""Geometry, spatial joins, skew helpers, components and quantiles against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayweave import constants as C
from stayweave import session
from stayweave.functions import geo
from stayweave.functions import segregation as S
from stayweave.operators import census, cluster, components, quantiles, skew, spatial, weights


def test_projection_reference_point_and_inverse(spark):
    df = spark.createDataFrame([(57.0, 12.75), (59.33, 18.07), (69.0, 20.5)], "latitude double, longitude double")
    rows = geo.with_degrees(geo.with_national_xy(df), lat="la", lon="lo").orderBy("latitude").collect()
    assert abs(rows[0]["y"] - 6319636.937) < 0.001 and abs(rows[0]["x"] - 363331.554) < 0.001
    assert all(abs(r["la"] - r["latitude"]) < 1e-9 and abs(r["lo"] - r["longitude"]) < 1e-9 for r in rows)


def test_points_without_a_projection_fall_out(spark):
    df = spark.createDataFrame([(0.0, 105.0), (85.0, 18.0), (None, 18.0), (float("nan"), 18.0), (59.0, 18.0)],
                               "latitude double, longitude double")
    assert geo.with_national_xy(df).count() == 1


def test_box_borders_are_inside(spark):
    west, south, east, north = C.CITY_BOX
    df = spark.createDataFrame([(south, west), (north, east), (north + 1e-9, east)], "latitude double, longitude double")
    assert df.filter(geo.in_box("latitude", "longitude")).count() == 2


def test_points_are_within_their_cell(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(rnd.uniform(6.5e5, 7e5), rnd.uniform(6.5e6, 6.6e6)) for _ in range(500)], "x double, y double")
    cx, cy = geo.hex_center("cell")
    rows = df.withColumn("cell", geo.hex_cell("x", "y")).withColumns({"cx": cx, "cy": cy}).collect()
    assert all(math.hypot(r["x"] - r["cx"], r["y"] - r["cy"]) <= C.HEX_EDGE_M + 1e-6 for r in rows)


def test_nearest_places_with_ties_and_the_radius_edge(spark):
    stops = spark.createDataFrame([(59.3, 18.0), (59.3, 18.0), (60.0, 18.0)], "latitude double, longitude double")
    places = [(f"p{i:02d}", "a", "k", 59.3, 18.0) for i in range(25)] + [("far", "a", "k", 59.31, 18.0)]
    pois = spark.createDataFrame(places, "osm_id string, primary string, kind string, latitude double, longitude double")
    rows = spatial.nearby_pois(stops, pois).collect()
    near = [r for r in rows if r["latitude"] == 59.3]
    assert len(rows) == 3 and len(near) == 2
    assert all(r["poi_num"] == 25 and r["osm_id"] == [f"p{i:02d}" for i in range(10)] for r in near)
    assert [r["osm_id"] for r in rows if r["latitude"] == 60.0] == [None]
    # Sideways of the point by the radius: just inside and just outside.
    x, y = geo.with_national_xy(stops.limit(1)).select("x", "y").first()
    edge = geo.with_degrees(spark.createDataFrame([("in", x + 299.999, y), ("out", x + 300.001, y)], "osm_id string, x double, y double"))
    found = spatial.nearby_pois(stops.limit(1), edge.withColumns({"primary": F.lit("a"), "kind": F.lit("k")})).first()
    assert found["osm_id"] == ["in"]


RING = "array<struct<x:double,y:double>>"


def test_concave_polygon_inside_border_and_distance(spark):
    u = [(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (20.0, 30.0), (20.0, 10.0), (10.0, 10.0), (10.0, 30.0), (0.0, 30.0)]
    points = [(5.0, 5.0, 0.0), (15.0, 20.0, 5.0), (15.0, 10.0, 0.0), (30.0, 15.0, 0.0), (33.0, 34.0, 5.0), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame([(x, y, u, d) for x, y, d in points], f"x double, y double, ring {RING}, want double")
    got = df.select("want", spatial.polygon_distance(F.col("x"), F.col("y"), F.col("ring")).alias("d")).collect()
    assert all(abs(r["d"] - r["want"]) < 1e-9 for r in got)


def test_clipped_area_of_any_polygon(spark):
    u = [(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (20.0, 30.0), (20.0, 10.0), (10.0, 10.0), (10.0, 30.0), (0.0, 30.0)]
    tri = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]
    cases = [(u, -5.0, -5.0, 50.0, 50.0, 700.0), (u, 5.0, 5.0, 25.0, 20.0, 200.0), (tri, 0.0, 0.0, 5.0, 5.0, 25.0),
             (tri, 5.0, 5.0, 9.0, 9.0, 0.0), (list(reversed(tri)), 2.0, 2.0, 20.0, 20.0, 18.0), (tri, -9.0, -9.0, -1.0, -1.0, 0.0)]
    df = spark.createDataFrame(cases, f"ring {RING}, a double, b double, c double, d double, want double")
    got = df.select("want", spatial.clipped_area(*[F.col(c) for c in ("ring", "a", "b", "c", "d")]).alias("area")).collect()
    assert all(abs(r["area"] - r["want"]) < 1e-9 for r in got)


def test_overlay_never_exceeds_the_building(spark):
    ring = [(990.0, 995.0), (1010.0, 995.0), (1010.0, 1005.0), (990.0, 1005.0)]
    buildings = spark.createDataFrame([(1, ring)], f"id int, ring {RING}")
    tiles = [(f"{i}{j}", i * 1000.0, j * 1000.0, i * 1000.0 + 1000, j * 1000.0 + 1000) for i in range(2) for j in range(2)]
    squares = spark.createDataFrame(tiles, "Ruta string, x_min double, y_min double, x_max double, y_max double")
    areas = [r["area"] for r in spatial.overlay_squares(buildings, squares).collect()]
    assert sorted(areas) == [50.0] * 4


def test_repeated_square_without_a_big_one_is_dropped(spark):
    rows = [("a", 1000, 1, 10.0), ("a", 250, 2, 20.0), ("b", 250, 3, 5.0), ("c", 250, 1, 5.0), ("c", 250, 1, 5.0), ("d", 1000, 1, 0.0)]
    df = spark.createDataFrame(rows, "Ruta string, Rutstorl int, n int, MedianInk double")
    df = df.select("Ruta", "Rutstorl", "MedianInk", F.col("n").alias("Totalt"), *[F.col("n").alias(c) for c in census.INCOME],
                   *[F.lit(0.0).alias(b) for b in census.BOX])
    got = {r["Ruta"]: (r["Rutstorl"], r["Kvartil1"], round(r["MedianInk"], 6)) for r in census.merge_income_squares(df).collect()}
    assert got == {"a": (1000, 3, round((4 * 10 + 8 * 20) / 12, 6)), "b": (250, 3, 5.0)}


def test_index_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)], "a double, b double, o double")
    assert [r[0] for r in df.select(S.ice_income("a", "b", "o")).collect()] == [None, 1.0, -1.0]
    marks = spark.createDataFrame([(-0.3,), (-0.2,), (0.2,), (None,)], "v double")
    assert [r[0] for r in marks.select(S.ice_group("v")).collect()] == [0, 1, 2, 2]


def test_salted_join_equals_a_plain_join(spark):
    left = spark.createDataFrame([(0 if i % 3 else i % 7, i) for i in range(300)], "k int, v int")
    right = spark.createDataFrame([(k, w) for k in range(7) for w in range(k + 1)], "k int, w int")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, skew.salted_join(left, right, ["k"], rows_per_salt=20).collect())) == want


def test_quantiles_of_large_and_small_groups(spark):
    rnd = np.random.default_rng(4)
    values = {"big": rnd.lognormal(size=20_000), "ties": rnd.integers(0, 5, 9_000).astype(float),
              "two": np.array([1.0, 2.0]), "one": np.array([3.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"lo": 0.05, "mid": 0.5, "hi": 0.95, "all": 1.0}
    for row in quantiles.exact_quantiles(df, ["k"], "v", probs, small=500).collect():
        for name, p in probs.items():
            assert math.isclose(row[name], np.quantile(values[row["k"]], p), rel_tol=1e-12), (row["k"], name)


def test_ranks_where_a_sketch_would_miss(spark):
    # a third of the rows at two neighbouring doubles around the median, the rest over all magnitudes, infinite ones included
    rnd = np.random.default_rng(5)
    close = np.where(rnd.random(2000) < 0.5, 1.0, np.nextafter(1.0, 2))
    wide = np.concatenate([s * 2.0 ** rnd.integers(-1074, 1023, 1000) * (1 + rnd.random(1000)) for s in (1, -1)])
    values = np.concatenate([close, wide, [np.inf] * 300, [-np.inf] * 300, np.zeros(50), 1.0 + 2.0 ** -rnd.integers(1, 52, 800)])
    df = spark.createDataFrame([(None, float(v)) for v in values] + [("x", 1.0)], "k string, v double").repartition(5)
    ordered = np.sort(values)
    probs = {f"p{k}": k / (len(values) - 1) for k in rnd.integers(310, len(values) - 310, 6).tolist() + [0, 5, len(values) // 2, len(values) - 1]}
    got = quantiles.exact_quantiles(df, ["k"], "v", probs, small=20, buckets=16).filter("k is null").first()
    for name, p in probs.items():
        rank = p * (len(values) - 1)
        low, high = (float(ordered[int(f(rank))]) for f in (np.floor, np.ceil))
        want = low if low == high else low + (high - low) * (rank - np.floor(rank))
        assert got[name] == want or math.isnan(want) and math.isnan(got[name]), (name, got[name], want)
    assert quantiles.exact_quantiles(df.filter("v > 9e307 and v < -1"), [], "v", {"m": 0.5}).count() == 0


def test_medians_of_small_and_large_keys(spark):
    df = spark.range(3000).selectExpr("if(id < 2500, 'big', 'k' || id % 7) AS k", "pmod(hash(id), 1000) / 7.0 AS v", "id")
    got = quantiles.exact_medians(df, ["k"], {"m": "v"}, [F.count("*").alias("n")], small=100).collect()
    want = {r.k: (r.n, r.m) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.median("v").alias("m")).collect()}
    assert {r.k: (r.n, r.m) for r in got} == want


def test_busy_keys_become_rectangles(spark):
    left = spark.range(3000).selectExpr("if(id % 3 > 0, 0, id % 5) AS k", "id AS v").withColumn("twin", F.lit(1))
    right = spark.range(2000).selectExpr("if(id % 2 > 0, 0, id % 7) AS k", "id AS w")
    plain = left.join(right, "k").groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("w")).alias("s"))
    dealt = skew.salted_join(left, right, ["k"], rows_per_salt=100)
    assert sorted(map(tuple, dealt.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("w")).alias("s")).collect())) == sorted(
        map(tuple, plain.collect()))
    grid = {r.k: (r._r, r._s) for r in skew.busy_keys(left, right, ["k"], 100).collect()}
    assert grid[0] == (22, 12) and (1, 1) not in grid.values()


def star(rnd, x, y, corners, size, turn=1):
    angles = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(x + size * (0.2 + rnd.random()) * math.cos(a), y + size * (0.2 + rnd.random()) * math.sin(a)) for a in angles[::turn]]


def polygons(seed):
    rnd = random.Random(seed)
    out = []
    for k in range(25):
        x, y = rnd.uniform(-300, 300), rnd.uniform(-300, 300)
        rings = [star(rnd, x, y, rnd.randint(3, 30), rnd.choice([5, 40, 200]))]
        if k % 3 == 0:
            rings.append([(x + 900, y), (x + 1300, y), (x + 1300, y + 250), (x + 900, y + 250)])
            rings.append([(x + 1000, y + 50), (x + 1000, y + 200), (x + 1200, y + 200), (x + 1200, y + 50)])
        out.append((k, rings))
    out.append((98, [[(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0), (0.0, 0.0)]]))
    out.append((99, [[(-600.0, -600.0), (600.0, -600.0), (600.0, 600.0), (-600.0, 600.0)]]))
    return out


MANY = f"array<{RING}>"


@pytest.mark.parametrize("size, reach", [(100.0, 0.0), (64.0, 30.0), (5000.0, 10.0)])
def test_polygon_cells_equal_whole_polygons(spark, size, reach):
    rnd = random.Random(size)
    shapes = spark.createDataFrame(polygons(3), f"_sid long, rings {MANY}")
    spots = [(rnd.uniform(-700, 1700), rnd.uniform(-700, 700)) for _ in range(400)]
    spots += [(0.0, 0.0), (50.0, 0.0), (100.0, 30.0), (-600.0, 5.0), (600.0, 600.0), (0.0, 50.0), *[p for _, r in polygons(3)[:6] for p in r[0]]]
    points = spark.createDataFrame(spots, "x double, y double")
    whole = points.crossJoin(shapes).select("x", "y", "_sid", spatial.polygon_distance(F.col("x"), F.col("y"), F.col("rings"), True).alias("d"))
    want = {(r.x, r.y, r._sid): r.d for r in whole.filter(F.col("d") <= reach).collect()}
    placed = points.withColumns({"_bx": spatial._cell(F.col("x"), size), "_by": spatial._cell(F.col("y"), size)})
    met = placed.join(spatial.edge_cells(shapes, size, reach), ["_bx", "_by"]).select("x", "y", "_sid", spatial.cell_distance(size).alias("d"))
    got = {(r.x, r.y, r._sid): r.d for r in met.filter(F.col("d") <= reach).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_a_long_outline_is_never_copied_whole(spark):
    n = 20_000
    ring = [(5000 * math.cos(2 * math.pi * k / n) * (1 + 0.01 * (k % 2)), 5000 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    shapes = spark.createDataFrame([(1, [ring])], f"_sid long, rings {MANY}")
    cells = spatial.edge_cells(shapes, 500.0).select(F.size("_near").alias("n"), "_odd").collect()
    assert max(r.n for r in cells) < n / 20 and sum(r.n for r in cells) < 2 * n
    assert sum(r.n == 0 and r._odd for r in cells) > 200
    strips = spatial.strip_edges(shapes, 500.0).select(F.size("_near").alias("n")).collect()
    assert max(r.n for r in strips) < n / 4


def test_overlay_of_any_polygon(spark):
    shapes = spark.createDataFrame(polygons(4), f"id long, rings {MANY}")
    tiles = [(f"{i} {j} {s}", i * s, j * s, i * s + s, j * s + s) for s, r in ((250.0, 8), (1000.0, 2), (170.0, 3)) for i in range(-r, r) for j in range(-r, r)]
    squares = spark.createDataFrame(tiles, "Ruta string, x_min double, y_min double, x_max double, y_max double")
    whole = shapes.crossJoin(squares).select("id", "Ruta", spatial.clipped_area(F.col("rings"), *map(
        F.col, ["x_min", "y_min", "x_max", "y_max"]), many=True).alias("area"))
    want = {(r.id, r.Ruta): r.area for r in whole.filter("area > 1e-6").collect()}
    got = {(r.id, r.Ruta): r.area for r in spatial.overlay_squares(shapes, squares, 300.0).filter("area > 1e-6").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-6) for k in want)


def union_find(points, radius):
    parent = list(range(len(points)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if math.dist(points[i], points[j]) <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(points))]


def test_radius_components_equal_all_pairs(spark):
    rnd = random.Random(9)
    points = [(rnd.uniform(0, 400), rnd.uniform(0, 400)) for _ in range(220)] + [(5.0, 5.0)] * 3
    df = spark.createDataFrame([("d", i, x, y) for i, (x, y) in enumerate(points)], "k string, i int, x double, y double")
    got = {r["i"]: r["component"] for r in components.radius_components(df, ["k"], 20).collect()}
    want = union_find(points, 20)
    pairs = {(got[i], want[i]) for i in range(len(points))}
    assert len(pairs) == len(set(got.values())) == len(set(want))


def plain_dbscan(points, eps, least):
    near = [[j for j, q in enumerate(points) if math.dist(p, q) <= eps] for p in points]
    core = [len(n) >= least for n in near]
    label = [None] * len(points)
    group = 0
    for i in range(len(points)):
        if core[i] and label[i] is None:
            stack, label[i] = [i], group
            while stack:
                for j in near[stack.pop()]:
                    if core[j] and label[j] is None:
                        label[j] = group
                        stack.append(j)
            group += 1
    touching = [{label[j] for j in near[i] if core[j]} for i in range(len(points))]
    return core, label, touching


def test_dbscan_equals_the_definition(spark):
    rnd = random.Random(11)
    centres = [(rnd.uniform(0, 10), rnd.uniform(0, 10)) for _ in range(6)]
    points = [(rnd.gauss(cx, 0.3), rnd.gauss(cy, 0.3)) for cx, cy in centres for _ in range(40)]
    points += [(rnd.uniform(0, 10), rnd.uniform(0, 10)) for _ in range(60)] + [(20.0, 20.0)] * 7
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "i int, px double, py double")
    got = {r["i"]: r["cluster"] for r in cluster.dbscan(df, "i", "px", "py", 0.4, 5).collect()}
    core, label, touching = plain_dbscan(points, 0.4, 5)
    names = {(got[i], label[i]) for i in range(len(points)) if core[i]}
    assert len(names) == len({a for a, _ in names}) == len({b for _, b in names}) and -1 not in {a for a, _ in names}
    back = dict(names)
    for i in range(len(points)):
        if not core[i]:
            assert (got[i] == -1) if not touching[i] else back[got[i]] in touching[i]
    counts = cluster.cluster_counts(df.select("i", (F.col("i") % 3 - 1).alias("cluster"))).first()
    assert counts["clusters"] == 2


def test_two_dense_squares_that_touch(spark):
    rnd = np.random.default_rng(6)
    # each a square's worth of points; the closest two of the groups are just inside or just outside the radius
    a = rnd.random((60_000, 2)) * 0.15
    for shift, groups in ((1.14, 1), (1.16, 2)):
        b = rnd.random((60_000, 2)) * 0.15 + [shift, 0.0]
        both = np.concatenate([a, b])
        df = spark.createDataFrame(pd.DataFrame({"x": both[:, 0], "y": both[:, 1]})).repartition(8)
        gap = b[:, 0].min() - a[:, 0].max()
        assert (gap > 1) == (groups == 2)
        assert components.radius_components(df, [], 1.0).select("component").distinct().count() == groups


@pytest.mark.parametrize("leaf", [1, 30])
def test_quartered_pairs_equal_brute_force(spark, leaf, monkeypatch):
    rnd = random.Random(leaf)
    spots = [(cx + rnd.gauss(0, 0.1), cy + rnd.gauss(0, 0.1)) for cx, cy in ((0, 0), (1.3, 0), (2.5, 0.8), (5, 5), (6.2, 5.1)) for _ in range(40)]
    plain = components._near_pairs
    monkeypatch.setattr(components, "_near_pairs", lambda *a: plain(*a, leaf=leaf))
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)], "i int, x double, y double")
    got = {}
    for r in components.radius_components(df, [], 1.0).collect():
        got.setdefault(r.component, set()).add(r.i)
    want = {}
    for i, g in enumerate(union_find(spots, 1.0)):
        want.setdefault(g, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_edges_of_an_overlay_are_not_broadcast(spark):
    shapes = spark.range(4).selectExpr("id", "array(struct(id * 10e0 AS x, 0e0 AS y), struct(id * 10e0 + 5 AS x, 0e0 AS y), "
                                       "struct(id * 10e0 + 5 AS x, 4e0 AS y), struct(id * 10e0 AS x, 4e0 AS y)) AS ring")
    tiles = spark.createDataFrame([("a", -100.0, -100.0, 900.0, 900.0)], "Ruta string, x_min double, y_min double, x_max double, y_max double")
    out = spatial.overlay_squares(shapes, tiles)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert any("Merge" in line and "_strip" in line for line in plan.splitlines())
    assert [(r["id"], r["area"]) for r in out.orderBy("id").collect()] == [(i, 20.0) for i in range(4)]


def test_repeated_squares_are_not_broadcast(spark, monkeypatch):
    plans, plain = [], cluster.cut_lineage

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().splitlines())
        return plain(df)

    monkeypatch.setattr(cluster, "cut_lineage", kept)
    monkeypatch.setattr(components, "cut_lineage", kept)
    df = spark.range(400).selectExpr("id", "id % 20 / 10e0 AS px", "id div 20 / 10e0 AS py")
    out = cluster.dbscan(df, "id", "px", "py", 0.5)
    plans.append(out._jdf.queryExecution().executedPlan().toString().splitlines())
    assert out.select("cluster").distinct().count() == 1
    assert any("Generate" in line for plan in plans for line in plan)
    for plan in plans:
        for at, line in enumerate(plan):
            depth = line.find("BroadcastExchange")
            for below in plan[at + 1:] if depth >= 0 else []:
                if len(below) - len(below.lstrip(" :+-")) <= depth:
                    break
                assert "Generate explode" not in below


def test_many_rows_are_joined_by_shuffle_whatever_their_file_size(spark):
    rows = session.cut_lineage(spark.range(5000).selectExpr("id", "repeat('x', 200) AS text"))
    plan = lambda side: rows.join(side, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(rows.select("id"))
    assert "SortMergeJoin" in plan(session.broadcast_or_shuffle(rows, 4999)) and "Broadcast" not in plan(session.broadcast_or_shuffle(rows, 4999))
    assert "BroadcastHashJoin" in plan(session.broadcast_or_shuffle(rows, 5000))


def test_zone_cell_visits_derive_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(d):
        seen.add(1)
        return d

    rows = [(f"d{i % 7}", i % 3, 1 + i % 2, float(i * i % 11)) for i in range(60)] + [("d1", 9, 4, None), ("none", 0, 5, 1.0)]
    visits = spark.createDataFrame(rows, "device_aid string, h3_id int, freq int, d2home double").withColumn("d2home", counted("d2home"))
    zones = spark.createDataFrame([(f"d{i}", f"z{i % 2}") for i in range(7)] * 2, "device_aid string, deso_r string")
    got = {(r["deso_r"], r["h3_id"]): (r["freq"], r["d2home"]) for r in weights.zone_cell_visits(visits, zones).collect()}
    want = {}
    for device, cell, freq, d in rows[:60]:
        want.setdefault((f"z{int(device[1:]) % 2}", cell), []).append((freq, d))
    assert got == {k: (sum(f for f, _ in v), float(np.median([d for _, d in v]))) for k, v in want.items()}
    assert seen.value <= len(rows)
