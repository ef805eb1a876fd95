"""Stand-ins for the mobility tables, derived from the given tables, on both engines.

``Spark side``: functions of (spark, dir). ``SQL side``: named parts that ``with_parts`` joins into
one DuckDB statement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayweave.functions import geo
from stayweave.functions import time as T
from stayweave.operators import demographics, homes

PLACE = (
    "CASE WHEN event_id % 6 IN (0, 1) OR hour(ts) >= 22 OR hour(ts) < 7 THEN 100000 + user_id "
    "WHEN event_id % 6 IN (2, 3) THEN (event_id + user_id) % 4 "
    "ELSE 1000 + (user_id * 37 + event_id * 11) % 400 END"
)


def latitude(key: str) -> str:
    return (f"(59.1174841345e0 + (({key} * 7919) % 1000) / 1000e0 * 0.3576083805e0"
            f" + CASE WHEN {key} BETWEEN 1380 AND 1399 THEN 2e0 ELSE 0e0 END)")


def longitude(key: str) -> str:
    return f"(17.6799476147e0 + (({key} * 6101) % 1000) / 1000e0 * 0.7772827148e0)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def visit(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "user_id", "ts", "value").selectExpr(
        "event_id", "user_id", "value", f"CAST({PLACE} AS BIGINT) AS place_id",
        "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS t0")


def stays(spark, folder) -> DataFrame:
    """Raw stays: device, interval, place, epoch start and end, coordinates."""
    return visit(spark, folder).selectExpr(
        "CAST(user_id AS STRING) AS device_aid", "event_id AS interval", "place_id AS loc", "t0 AS start",
        "t0 + (10 + (event_id % 80) * 10) * 60 AS end", f"{latitude('place_id')} AS latitude",
        f"{longitude('place_id')} AS longitude", "event_id % 9 + 1 AS size", "user_id % 50 AS batch",
        "CAST(place_id >= 100000 AS INT) AS home")


def stops(spark, folder) -> DataFrame:
    """Enriched stops: stays with duration, local times, calendar and hexagon."""
    rows = T.with_local_times(homes.with_duration(stays(spark, folder)))
    parts = T.calendar_parts("localtime")
    rows = rows.withColumns({"h_s": parts["hour"], "weekday": parts["weekday"], "week": parts["week"],
                             "date": parts["date"], "year": parts["year"]})
    return geo.with_cell(rows)


def pings(spark, folder) -> DataFrame:
    """Six pings, five minutes apart, per event; some end with a jump."""
    rows = visit(spark, folder).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(6)])))
    return rows.selectExpr(
        "CAST(user_id AS STRING) AS device_aid", "t0 + 300 * k AS timestamp",
        f"{latitude('place_id')} + ((event_id * 31 + k * 17) % 11 - 5) * 0.00001e0"
        " + CASE WHEN event_id % 10 = 0 AND k = 5 THEN 0.01e0 ELSE 0e0 END AS latitude",
        f"{longitude('place_id')} AS longitude", "'GPS' AS location_method")


def home_building(spark, folder) -> DataFrame:
    users = table(spark, folder, "events").select("user_id").distinct()
    return users.selectExpr("CAST(user_id AS STRING) AS device_aid", "CAST(user_id % 25 AS INT) AS b_id")


def building_data(spark, folder) -> DataFrame:
    b = "n_nationkey"
    empty = f"CASE WHEN {b} = 24 THEN 0 ELSE "
    return table(spark, folder, "nation").selectExpr(
        f"{b} AS b_id", f"{empty}20 + ({b} * 7) % 50 END AS sweden", f"({b} * 3) % 6 AS nordic",
        f"{empty}({b} * 5) % 9 END AS eu", f"{empty}({b} * 11) % 40 END AS other",
        f"1 + ({b} * 13) % 30 AS Q1", f"1 + ({b} * 17) % 30 AS Q2",
        f"1 + ({b} * 19) % 30 AS Q3", f"1 + ({b} * 23) % 30 AS Q4")


def pois(spark, folder) -> DataFrame:
    return table(spark, folder, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS osm_id", "p_type AS primary", "p_name AS name", "p_brand AS kind",
        f"{latitude('(p_partkey * 13)')} AS latitude", f"{longitude('(p_partkey * 13)')} AS longitude")


def transit(spark, folder) -> DataFrame:
    return table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS stop_id", f"{latitude('(s_suppkey * 29)')} AS latitude",
        f"{longitude('(s_suppkey * 29)')} AS longitude")


def buildings(spark, folder) -> DataFrame:
    """Rectangles near the home coordinates: id, class, subtype, sources and ring."""
    key = "(100000 + c_custkey)"
    rows = table(spark, folder, "customer").selectExpr(
        "c_custkey AS id", "c_mktsegment AS class", "c_custkey % 7 <> 0 AS residential",
        f"{latitude(key)} AS latitude", f"{longitude(key)} AS longitude", "c_nationkey AS nation")
    rows = geo.with_national_xy(rows).selectExpr(
        "id", "class", "CASE WHEN residential THEN 'residential' ELSE 'other' END AS subtype",
        "array(struct(concat('set', nation % 3) AS dataset)) AS sources",
        "x + (id % 9) * 10e0 AS cx", "y AS cy", "5e0 + id % 20 AS hw", "4e0 + (id * 3) % 15 AS hh")
    corners = ["cx - hw AS x, cy - hh AS y", "cx + hw AS x, cy - hh AS y",
               "cx + hw AS x, cy + hh AS y", "cx - hw AS x, cy + hh AS y"]
    ring = "array(" + ", ".join(f"struct({c})" for c in corners) + ")"
    return rows.selectExpr("id", "class", "subtype", "sources", "sources[0].dataset AS source", f"{ring} AS ring")


def squares(spark, folder) -> DataFrame:
    """Census squares at the buildings: 1000 m each, some listed twice with a 250 m twin."""
    key = "(100000 + c_custkey)"
    points = geo.with_national_xy(table(spark, folder, "customer").selectExpr(
        f"{latitude(key)} AS latitude", f"{longitude(key)} AS longitude"))
    base = points.select(
        F.floor(F.col("x") / 1000).cast("bigint").alias("sx"), F.floor(F.col("y") / 1000).cast("bigint").alias("sy")
    ).distinct()
    both = base.withColumn("twin", F.explode(F.expr("CASE WHEN (sx + sy) % 4 = 0 THEN array(0, 1) ELSE array(0) END")))
    m = "sx * 7 + sy * 3 + twin * 5"
    return both.selectExpr(
        "concat(sx, '_', sy) AS Ruta", "CASE WHEN twin = 1 THEN 250 ELSE 1000 END AS Rutstorl",
        "sx * 1000e0 AS x_min", "sy * 1000e0 AS y_min",
        "sx * 1000e0 + CASE WHEN twin = 1 THEN 250e0 ELSE 1000e0 END AS x_max",
        "sy * 1000e0 + CASE WHEN twin = 1 THEN 250e0 ELSE 1000e0 END AS y_max",
        *[f"({m}) % {13 + k} + {k} AS Kvartil{k}" for k in (1, 2, 3, 4)],
        f"({m}) % 97 + 20 AS Totalt", f"CAST((({m}) % 11) * 1000 AS DOUBLE) AS MedianInk",
        f"({m}) % 50 + 10 AS Sverige", f"({m}) % 6 AS Norden_uto", f"({m}) % 9 AS EU_utom_No",
        f"({m}) % 31 AS Ovriga_var")


def zones(spark, folder) -> DataFrame:
    """A five by five patchwork of rectangles: code, population and rings. The middle one has a hole, the last one is
    two parts with a gap between them."""
    rows = table(spark, folder, "nation").selectExpr(
        "concat('01', CAST(n_nationkey % 5 AS STRING), CAST(n_nationkey DIV 5 AS STRING)) AS deso",
        "n_nationkey AS n", "100 + n_nationkey * 7 AS befolkning", "650000e0 + (n_nationkey % 5) * 10000e0 AS zx",
        "6555000e0 + (n_nationkey DIV 5) * 9000e0 AS zy")

    def box(left, low, right, high, hole=False):
        corners = [(left, low), (right, low), (right, high), (left, high)]
        return "array(" + ", ".join(f"struct(zx + {x}e0 AS x, zy + {y}e0 AS y)" for x, y in (reversed(corners) if hole else corners)) + ")"

    rings = (f"CASE n WHEN 12 THEN array({box(0, 0, 10000, 9000)}, {box(2000, 2000, 8000, 7000, True)}) "
             f"WHEN 24 THEN array({box(0, 0, 4000, 9000)}, {box(6000, 0, 10000, 9000)}) ELSE array({box(0, 0, 10000, 9000)}) END AS rings")
    return rows.selectExpr("deso", "befolkning", rings)


def device_homes(spark, folder) -> DataFrame:
    """Home point of every device."""
    return table(spark, folder, "events").select("user_id").distinct().selectExpr(
        "CAST(user_id AS STRING) AS device_aid", f"{latitude('(100000 + user_id)')} AS latitude",
        f"{longitude('(100000 + user_id)')} AS longitude")


def place_lists(spark, folder) -> DataFrame:
    """The category and kind lists of all parts at each place; every part is at one place."""
    return table(spark, folder, "part").groupBy((F.col("p_partkey") % 400).alias("place")).agg(
        F.flatten(F.collect_list(F.split("p_name", " "))).alias("primary"),
        F.flatten(F.collect_list(F.array("p_brand", "p_type"))).alias("kind"))


def linked_visits(spark, folder) -> DataFrame:
    """City visits with their place, where that has parts; the lists of a place are in ``place_lists``, once each."""
    visits = demographics.city_visits(stops(spark, folder)).withColumn("place", F.col("loc") % 400)
    known = table(spark, folder, "part").select((F.col("p_partkey") % 400).alias("place")).distinct()
    return visits.join(known, "place", "left_semi")


def device_groups(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select("user_id").distinct().selectExpr(
        "CAST(user_id AS STRING) AS device_aid", "CAST(user_id % 4 + 1 AS INT) AS group")


def loss(spark, folder) -> DataFrame:
    """A loss trace per user: step by event time."""
    return table(spark, folder, "events").selectExpr("user_id AS run", "event_id AS step", "value AS loss")


# ---------------------------------------------------------------------------------- SQL side

_N, _E2, _R = geo.NATIONAL.third, geo.NATIONAL.e2, geo.NATIONAL.radius


def national_sql(source: str, columns: str = "*", lat: str = "latitude", lon: str = "longitude") -> str:
    """SELECT that adds projected x, y to ``source``, in three nested steps."""
    n, e2 = _N, _E2
    c1, c2, c3 = (5 * e2**2 - e2**3) / 6, (104 * e2**3 - 45 * e2**4) / 120, 1237 * e2**4 / 1260
    beta = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280]
    north = " + ".join(f"{b!r}::DOUBLE * sin({2 * k} * _xi) * cosh({2 * k} * _et)" for k, b in enumerate(beta, 1))
    east = " + ".join(f"{b!r}::DOUBLE * cos({2 * k} * _xi) * sinh({2 * k} * _et)" for k, b in enumerate(beta, 1))
    return f"""
      SELECT * EXCLUDE (_f, _d, _c, _xi, _et),
             {_R!r}::DOUBLE * (_et + {east}) + 500000e0 AS x, {_R!r}::DOUBLE * (_xi + {north}) AS y
      FROM (SELECT *, atan(tan(_c) / cos(_d)) AS _xi, atanh(cos(_c) * sin(_d)) AS _et
      FROM (SELECT *, _f - sin(_f) * cos(_f) * ({e2!r}::DOUBLE + {c1!r}::DOUBLE * power(sin(_f), 2)
              + {c2!r}::DOUBLE * power(sin(_f), 4) + {c3!r}::DOUBLE * power(sin(_f), 6)) AS _c
      FROM (SELECT {columns}, radians({lat}) AS _f, radians({lon} - 15e0) AS _d FROM {source})))"""


def cell_sql(source: str) -> str:
    """SELECT that adds the hexagon id ``h3_id`` to a ``source`` with x, y; x and y are dropped."""
    e = "531.414e0"
    return f"""
      SELECT * EXCLUDE (x, y, _q, _r, _rq, _rr, _rs),
        ((CASE WHEN abs(_rq - _q) > abs(_rr - _r) AND abs(_rq - _q) > abs(_rs + _q + _r) THEN -_rr - _rs ELSE _rq END
          + 1048576) * 2097152
        + (CASE WHEN abs(_rq - _q) > abs(_rr - _r) AND abs(_rq - _q) > abs(_rs + _q + _r) THEN _rr
           WHEN abs(_rr - _r) > abs(_rs + _q + _r) THEN -_rq - _rs ELSE _rr END) + 1048576)::BIGINT AS h3_id
      FROM (SELECT *, floor(_q + 0.5e0)::BIGINT AS _rq, floor(_r + 0.5e0)::BIGINT AS _rr,
                   floor(-_q - _r + 0.5e0)::BIGINT AS _rs
      FROM (SELECT *, (x * (sqrt(3e0) / 3e0) - y / 3e0) / {e} AS _q, y * (2e0 / 3e0) / {e} AS _r FROM {source}))"""


_BIN = ("CASE WHEN hour({0}) >= 5 AND hour({0}) < 12 THEN 'morning' "
        "WHEN hour({0}) >= 12 AND hour({0}) < 18 THEN 'afternoon' ELSE 'evening' END")
_M = "(sx * 7 + sy * 3 + twin * 5)"

PARTS: dict[str, str] = {
    "visit": f"""SELECT event_id, user_id, value, CAST({PLACE} AS BIGINT) AS place_id,
                 CAST(floor(epoch(ts)) AS BIGINT) AS t0 FROM events""",
    "stays": f"""SELECT CAST(user_id AS VARCHAR) AS device_aid, event_id AS interval, place_id AS loc,
                 t0 AS "start", t0 + (10 + (event_id % 80) * 10) * 60 AS "end",
                 {latitude('place_id')} AS latitude, {longitude('place_id')} AS longitude,
                 event_id % 9 + 1 AS size, user_id % 50 AS batch, CAST(place_id >= 100000 AS INT) AS home FROM visit""",
    "timed": """SELECT *, ("end" - "start") / 60e0 AS dur,
                timezone('Europe/Stockholm', to_timestamp("start")) AS localtime_,
                timezone('Europe/Stockholm', to_timestamp("end")) AS l_localtime_ FROM stays""",
    "stops_xy": national_sql("timed"),
    "stops": "SELECT *, isodow(localtime_) - 1 AS weekday FROM (" + cell_sql("stops_xy") + ")",
    "pings": f"""SELECT CAST(user_id AS VARCHAR) AS device_aid, t0 + 300 * k AS timestamp,
                 {latitude('place_id')} + ((event_id * 31 + k * 17) % 11 - 5) * 0.00001e0
                 + CASE WHEN event_id % 10 = 0 AND k = 5 THEN 0.01e0 ELSE 0e0 END AS latitude,
                 {longitude('place_id')} AS longitude FROM visit, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k)""",
    "clean": """SELECT DISTINCT device_aid, timestamp, latitude, longitude FROM pings
                WHERE latitude BETWEEN -80 AND 84 AND longitude BETWEEN -180 AND 180""",
    "home_building": """SELECT DISTINCT CAST(user_id AS VARCHAR) AS device_aid, CAST(user_id % 25 AS INT) AS b_id
                        FROM events""",
    "building_data": """SELECT b AS b_id, CASE WHEN b = 24 THEN 0 ELSE 20 + (b * 7) % 50 END AS sweden,
        (b * 3) % 6 AS nordic, CASE WHEN b = 24 THEN 0 ELSE (b * 5) % 9 END AS eu,
        CASE WHEN b = 24 THEN 0 ELSE (b * 11) % 40 END AS other, 1 + (b * 13) % 30 AS Q1, 1 + (b * 17) % 30 AS Q2,
        1 + (b * 19) % 30 AS Q3, 1 + (b * 23) % 30 AS Q4 FROM (SELECT n_nationkey AS b FROM nation)""",
    "demographics": """SELECT device_aid,
        CASE WHEN born > 0 THEN sweden / born ELSE 0 END AS prop_sweden,
        CASE WHEN born > 0 THEN other / born ELSE 0 END AS prop_other,
        CASE WHEN born > 0 THEN (nordic + eu) / born ELSE 0 END AS prop_middle_birth,
        CASE WHEN earn > 0 THEN Q1 / earn ELSE 0 END AS prop_q1, CASE WHEN earn > 0 THEN Q4 / earn ELSE 0 END AS prop_q4,
        CASE WHEN earn > 0 THEN (Q2 + Q3) / earn ELSE 0 END AS prop_middle_income
        FROM (SELECT *, (sweden + nordic + eu + other)::DOUBLE AS born, (Q1 + Q2 + Q3 + Q4)::DOUBLE AS earn
              FROM home_building LEFT JOIN building_data USING (b_id))""",
    "city": """SELECT * FROM stops WHERE home <> 1 AND latitude BETWEEN 59.1174841345e0 AND 59.475092515e0
               AND longitude BETWEEN 17.6799476147e0 AND 18.4572303295e0""",
    "slots": f"""SELECT DISTINCT device_aid, h3_id, {_BIN.format('localtime_')} AS time_bin,
                 CASE WHEN weekday >= 5 THEN 'weekend' ELSE 'weekday' END AS day_type FROM city""",
    "cells": """SELECT h3_id, time_bin, day_type, count(DISTINCT device_aid) AS n_visitors,
        avg(prop_sweden) AS prop_sweden, avg(prop_other) AS prop_other, avg(prop_middle_birth) AS prop_middle_birth,
        avg(prop_q1) AS prop_q1, avg(prop_q4) AS prop_q4, avg(prop_middle_income) AS prop_middle_income
        FROM slots JOIN demographics USING (device_aid) GROUP BY ALL HAVING count(DISTINCT device_aid) >= 5""",
    "diversity": """SELECT h3_id, time_bin, day_type, n_visitors,
        (prop_sweden / 0.8044e0 - prop_other / 0.1107e0) / nullif(prop_sweden / 0.8044e0 + prop_other / 0.1107e0
          + prop_middle_birth / (1e0 - 0.8044e0 - 0.1107e0), 0) AS ice_birth,
        (prop_q1 - prop_q4) / 0.25e0 / nullif((prop_q1 + prop_q4) / 0.25e0 + prop_middle_income / 0.5e0, 0) AS ice_income,
        prop_sweden, prop_other, prop_q1, prop_q4 FROM cells""",
    "pois": f"""SELECT CAST(p_partkey AS VARCHAR) AS osm_id, p_type AS "primary", p_name AS name, p_brand AS kind,
                {latitude('(p_partkey * 13)')} AS latitude, {longitude('(p_partkey * 13)')} AS longitude FROM part""",
    "pois_xy": national_sql("pois"),
    "transit": f"""SELECT s_suppkey AS stop_id, {latitude('(s_suppkey * 29)')} AS latitude,
                   {longitude('(s_suppkey * 29)')} AS longitude FROM supplier""",
    "transit_xy": national_sql("transit"),
    "building_points": f"""SELECT c_custkey AS id, c_mktsegment AS class, c_custkey % 7 <> 0 AS residential,
        'set' || (c_nationkey % 3) AS source, {latitude('(100000 + c_custkey)')} AS latitude,
        {longitude('(100000 + c_custkey)')} AS longitude FROM customer""",
    "building_xy": national_sql("building_points"),
    "buildings": """SELECT id, class, CASE WHEN residential THEN 'residential' ELSE 'other' END AS subtype, source,
        x + (id % 9) * 10e0 AS cx, y AS cy, 5e0 + id % 20 AS hw, 4e0 + (id * 3) % 15 AS hh FROM building_xy""",
    "square_base": """SELECT DISTINCT floor(x / 1000)::BIGINT AS sx, floor(y / 1000)::BIGINT AS sy FROM building_xy""",
    "squares": f"""SELECT sx || '_' || sy AS Ruta, CASE WHEN twin = 1 THEN 250 ELSE 1000 END AS Rutstorl,
        sx * 1000e0 AS x_min, sy * 1000e0 AS y_min, sx * 1000e0 + CASE WHEN twin = 1 THEN 250e0 ELSE 1000e0 END AS x_max,
        sy * 1000e0 + CASE WHEN twin = 1 THEN 250e0 ELSE 1000e0 END AS y_max,
        {_M} % 14 + 1 AS Kvartil1, {_M} % 15 + 2 AS Kvartil2, {_M} % 16 + 3 AS Kvartil3, {_M} % 17 + 4 AS Kvartil4,
        {_M} % 97 + 20 AS Totalt, ({_M} % 11) * 1000e0 AS MedianInk, {_M} % 50 + 10 AS Sverige,
        {_M} % 6 AS Norden_uto, {_M} % 9 AS EU_utom_No, {_M} % 31 AS Ovriga_var
        FROM square_base, (SELECT unnest([0, 1]) AS twin) WHERE twin = 0 OR (sx + sy) % 4 = 0""",
    "income_squares": """SELECT Ruta, min(x_min) AS x_min, min(y_min) AS y_min, min(x_min) + 1000e0 AS x_max, min(y_min) + 1000e0 AS y_max,
        sum(Kvartil1) AS Kvartil1, sum(Kvartil2) AS Kvartil2, sum(Kvartil3) AS Kvartil3, sum(Kvartil4) AS Kvartil4
        FROM (SELECT *, Kvartil1 + Kvartil2 + Kvartil3 + Kvartil4 AS people FROM squares) GROUP BY Ruta
        HAVING CASE WHEN count(*) = 1 THEN max(MedianInk) ELSE sum(people * MedianInk) / sum(people) END > 0""",
    "birth_squares": """SELECT Ruta, min(x_min) AS x_min, min(y_min) AS y_min, min(x_min) + 1000e0 AS x_max, min(y_min) + 1000e0 AS y_max,
        sum(Sverige) AS Sverige, sum(Norden_uto) AS Norden_uto, sum(EU_utom_No) AS EU_utom_No, sum(Ovriga_var) AS Ovriga_var
        FROM squares GROUP BY Ruta""",
    "zones": """SELECT n_nationkey AS n, '01' || (n_nationkey % 5) || (n_nationkey // 5) AS deso, 100 + n_nationkey * 7 AS befolkning,
        650000e0 + (n_nationkey % 5) * 10000e0 AS zx, 6555000e0 + (n_nationkey // 5) * 9000e0 AS zy FROM nation""",
    "homes": f"""SELECT DISTINCT CAST(user_id AS VARCHAR) AS device_aid, {latitude('(100000 + user_id)')} AS latitude,
        {longitude('(100000 + user_id)')} AS longitude FROM events""",
    "homes_xy": national_sql("homes"),
    "linked": """SELECT city.*, prim, kinds FROM city JOIN (SELECT p_partkey % 400 AS place,
        flatten(list(string_split(p_name, ' '))) AS prim, flatten(list([p_brand, p_type])) AS kinds FROM part GROUP BY 1)
        ON place = loc % 400""",
    "groups": """SELECT DISTINCT CAST(user_id AS VARCHAR) AS device_aid, CAST(user_id % 4 + 1 AS INT) AS "group"
        FROM events""",
    "device_zone": """SELECT device_aid, deso, befolkning FROM homes_xy LEFT JOIN zones
        ON x BETWEEN zx AND zx + 10000 AND y BETWEEN zy AND zy + 9000
        AND NOT (n = 12 AND x > zx + 2000 AND x < zx + 8000 AND y > zy + 2000 AND y < zy + 7000)
        AND NOT (n = 24 AND x > zx + 4000 AND x < zx + 6000)""",
}

_NEEDS = {
    "stays": ["visit"], "timed": ["stays"], "stops_xy": ["timed"], "stops": ["stops_xy"], "pings": ["visit"],
    "clean": ["pings"], "demographics": ["home_building", "building_data"], "city": ["stops"], "slots": ["city"],
    "cells": ["slots", "demographics"], "diversity": ["cells"], "pois_xy": ["pois"], "transit_xy": ["transit"],
    "building_xy": ["building_points"], "buildings": ["building_xy"], "square_base": ["building_xy"],
    "squares": ["square_base"], "income_squares": ["squares"], "birth_squares": ["squares"], "homes_xy": ["homes"], "device_zone": ["homes_xy", "zones"], "linked": ["city"],
}


def with_parts(query: str, *parts: str, **extra: str) -> str:
    """Prefix ``query`` with the named parts, what they need, and ``extra`` parts in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for part in parts:
        add(part)
    pieces = [f"{name} AS ({PARTS[name]})" for name in ordered] + [f"{name} AS ({body})" for name, body in extra.items()]
    return (f"WITH {', '.join(pieces)} " if pieces else "") + query
