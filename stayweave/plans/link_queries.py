"""Queries on spatial links, census squares and distance-corrected weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayweave.operators import census, describe, filters, graph, spatial, weights
from stayweave.operators import demographics as D
from stayweave.plans import fixtures as X
from stayweave.plans.base_queries import rounded
from stayweave.plans.registry import query

_SPOTS = "SELECT DISTINCT latitude, longitude, x, y FROM stops_xy"
_NEAR = """SELECT s.latitude, s.longitude, osm_id, "primary" AS prim, kind,
    sqrt(power(s.x - p.x, 2) + power(s.y - p.y, 2)) AS d FROM spots s, pois_xy p
    WHERE sqrt(power(s.x - p.x, 2) + power(s.y - p.y, 2)) <= 300"""
_FOUND = """SELECT latitude, longitude, max(n) AS n, string_agg(osm_id, ',' ORDER BY r) AS ids,
    string_agg(prim, ',' ORDER BY r) AS prims, string_agg(kind, ',' ORDER BY r) AS kinds FROM
    (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY latitude, longitude) AS n FROM near
     WINDOW w AS (PARTITION BY latitude, longitude ORDER BY d, osm_id)) WHERE r <= 10 GROUP BY ALL"""


@query("poi_radius_top10", X.with_parts(
    """SELECT interval, coalesce(n, 0)::BIGINT AS poi_num, ids AS osm_id, prims AS "primary", kinds AS kind
       FROM stays LEFT JOIN found USING (latitude, longitude)""",
    "stops_xy", "pois_xy", spots=_SPOTS, near=_NEAR, found=_FOUND))
def poi_radius_top10(spark, folder):
    stops = X.stays(spark, folder).select("interval", "latitude", "longitude")
    out = spatial.nearby_pois(stops, X.pois(spark, folder))
    return out.select("interval", "poi_num", *[F.array_join(c, ",").alias(c) for c in ("osm_id", "primary", "kind")])


@query("linked_stops", X.with_parts(
    f"""SELECT device_aid, h3_id, count(*) AS stops, sum(coalesce(n, 0))::BIGINT AS pois FROM stops
        LEFT JOIN found USING (latitude, longitude) WHERE device_aid IN
        (SELECT device_aid FROM groups WHERE "group" <= 2) GROUP BY ALL""",
    "stops", "stops_xy", "pois_xy", "groups", spots=_SPOTS, near=_NEAR, found=_FOUND))
def linked_stops(spark, folder):
    wanted = X.device_groups(spark, folder).filter("group <= 2")
    out = spatial.link_stops(X.stays(spark, folder), X.pois(spark, folder), wanted)
    return out.groupBy("device_aid", "h3_id").agg(F.count("*").alias("stops"), F.sum("poi_num").alias("pois"))


@query("home_building_link", X.with_parts(
    """SELECT device_aid, id AS b_id, class AS b_class, source AS b_source, round(d, 3) AS b_distance FROM homes LEFT JOIN
       (SELECT *, row_number() OVER (PARTITION BY device_aid ORDER BY d, id) AS r FROM
         (SELECT device_aid, id, class, source, sqrt(power(greatest(abs(x - cx) - hw, 0), 2)
            + power(greatest(abs(y - cy) - hh, 0), 2)) AS d FROM homes_xy, buildings WHERE subtype = 'residential')
        WHERE d <= 50) USING (device_aid) WHERE r = 1 OR r IS NULL""", "homes_xy", "buildings"))
def home_building_link(spark, folder):
    out = spatial.nearest_building(X.device_homes(spark, folder), filters.residential(X.buildings(spark, folder)))
    return out.select("device_aid", "b_id", "b_class", "b_source", F.round("b_distance", 3).alias("b_distance"))


def _device_zones(spark, folder):
    return spatial.within_zones(X.device_homes(spark, folder), X.zones(spark, folder), ["deso", "befolkning"])


@query("zone_link", X.with_parts("SELECT device_aid, deso, befolkning FROM device_zone", "device_zone"))
def zone_link(spark, folder):
    return _device_zones(spark, folder).select("device_aid", "deso", "befolkning")


@query("pois_in_cells", X.with_parts(
    """SELECT h3_id, kind, count(*) AS n FROM poi_cells WHERE h3_id IN (SELECT h3_id FROM city) GROUP BY ALL""",
    "city", "pois_xy", poi_cells=X.cell_sql("pois_xy")))
def pois_in_cells(spark, folder):
    cells = D.city_visits(X.stops(spark, folder)).select("h3_id")
    return spatial.points_in_cells(X.pois(spark, folder), cells).groupBy("h3_id", "kind").agg(F.count("*").alias("n"))


_TYPES = ["ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE"]


@query("crosstab_cells", X.with_parts(
    "SELECT h3_id, " + ", ".join(f"count(*) FILTER (\"primary\" = '{t}') AS \"{t}\"" for t in _TYPES)
    + " FROM poi_cells GROUP BY h3_id", "pois_xy", poi_cells=X.cell_sql("pois_xy")))
def crosstab_cells(spark, folder):
    from stayweave.functions import geo
    return describe.crosstab(geo.with_cell(X.pois(spark, folder)), "h3_id", "primary", _TYPES)


@query("transit_cells", X.with_parts(
    """SELECT h3_id, coalesce(n, 0)::BIGINT AS count, CASE WHEN coalesce(n, 0) > 0 THEN 1 ELSE 0 END AS "group" FROM
       (SELECT DISTINCT h3_id FROM city) LEFT JOIN (SELECT h3_id, count(*) AS n FROM
       (SELECT DISTINCT latitude, longitude, h3_id FROM transit_cell) GROUP BY h3_id) USING (h3_id)""",
    "city", "transit_xy", transit_cell=X.cell_sql("transit_xy")))
def transit_cells(spark, folder):
    return graph.transit_cells(D.city_visits(X.stops(spark, folder)).select("h3_id"), X.transit(spark, folder))


def _pieces_sql(squares: str) -> str:
    return f"""SELECT id, Ruta, (least(cx + hw, x_max) - greatest(cx - hw, x_min)) * (least(cy + hh, y_max) - greatest(cy - hh, y_min))
        AS area FROM buildings, {squares} WHERE cx + hw > x_min AND cx - hw < x_max AND cy + hh > y_min AND cy - hh < y_max"""


def _weighted_sql(pieces: str, squares: str, values: list[tuple[str, str]]) -> str:
    means = ", ".join(f"CAST(ceil(round(sum({c} * area) / sum(area), 9)) AS BIGINT) AS {n}" for c, n in values)
    return f"SELECT id, {means} FROM {pieces} JOIN {squares} USING (Ruta) WHERE area > 0 GROUP BY id"


_INCOME = dict(income_pieces=_pieces_sql("income_squares"), income=_weighted_sql(
    "income_pieces", "income_squares", [(f"Kvartil{k}", f"Q{k}") for k in (1, 2, 3, 4)]))
_BIRTH = dict(birth_pieces=_pieces_sql("birth_squares"), birth=_weighted_sql(
    "birth_pieces", "birth_squares", [("Sverige", "sweden"), ("Norden_uto", "nordic"), ("EU_utom_No", "eu"), ("Ovriga_var", "other")]))


def _income_squares(spark, folder):
    return census.merge_income_squares(X.squares(spark, folder))


@query("overlay_area", X.with_parts(
    "SELECT id, Ruta, round(area, 3) AS area FROM income_pieces WHERE area > 0", "buildings", "income_squares", **_INCOME))
def overlay_area(spark, folder):
    return rounded(spatial.overlay_squares(X.buildings(spark, folder), _income_squares(spark, folder)), ["area"], 3)


def _weighted(spark, folder, squares, names):
    values = census.with_square_values(spatial.overlay_squares(X.buildings(spark, folder), squares), squares, names)
    return census.area_weighted(values, [v for v in names.values() if v != "grid_size"])


@query("area_weighted", X.with_parts("SELECT id, Q1, Q2, Q3, Q4 FROM income", "buildings", "income_squares", **_INCOME))
def area_weighted(spark, folder):
    return _weighted(spark, folder, _income_squares(spark, folder), census.INCOME_NAMES)


@query("building_table", X.with_parts(
    "SELECT id AS b_id, sweden, nordic, eu, other, Q1, Q2, Q3, Q4 FROM birth JOIN income USING (id)",
    "buildings", "income_squares", "birth_squares", **_INCOME, **_BIRTH))
def building_table(spark, folder):
    births = census.merge_birth_squares(X.squares(spark, folder))
    return census.building_table(
        _weighted(spark, folder, births, census.BIRTH_NAMES),
        _weighted(spark, folder, _income_squares(spark, folder), census.INCOME_NAMES))


_SUMS = "sum(Kvartil1)::BIGINT AS Kvartil1, sum(Kvartil2)::BIGINT AS Kvartil2, sum(Kvartil3)::BIGINT AS Kvartil3, " \
        "sum(Kvartil4)::BIGINT AS Kvartil4"


@query("census_dedupe", X.with_parts(
    f"""SELECT Ruta, Rutstorl, {", ".join(f"Kvartil{k}" for k in range(1, 5))}, Totalt_i, Totalt, round(MedianInk, 4) AS MedianInk
        FROM (SELECT Ruta, 1000 AS Rutstorl, {_SUMS}, sum(ti)::BIGINT AS Totalt_i, sum(Totalt)::BIGINT AS Totalt,
              CASE WHEN count(*) = 1 THEN max(MedianInk) ELSE sum(ti * MedianInk) / sum(ti) END AS MedianInk
              FROM (SELECT *, Kvartil1 + Kvartil2 + Kvartil3 + Kvartil4 AS ti FROM squares) GROUP BY Ruta)
        WHERE MedianInk > 0""", "squares"))
def census_dedupe(spark, folder):
    out = census.merge_income_squares(X.squares(spark, folder))
    return out.select("Ruta", "Rutstorl", *census.INCOME, "Totalt_i", "Totalt", F.round("MedianInk", 4).alias("MedianInk"))


@query("birth_dedupe", X.with_parts(
    """SELECT Ruta, 1000 AS Rutstorl, sum(Sverige)::BIGINT AS Sverige, sum(Norden_uto)::BIGINT AS Norden_uto,
       sum(EU_utom_No)::BIGINT AS EU_utom_No, sum(Ovriga_var)::BIGINT AS Ovriga_var FROM squares GROUP BY Ruta""", "squares"))
def birth_dedupe(spark, folder):
    return census.merge_birth_squares(X.squares(spark, folder)).select("Ruta", "Rutstorl", *census.BIRTH)


@query("single_squares", X.with_parts(
    "SELECT Ruta, min(Totalt)::BIGINT AS Totalt FROM squares GROUP BY Ruta HAVING count(*) = 1", "squares"))
def single_squares(spark, folder):
    return census.single_squares(X.squares(spark, folder)).select("Ruta", F.col("Totalt").cast("bigint").alias("Totalt"))


_IZONE = "SELECT device_aid, deso, substr(deso, 1, 3) AS deso_r FROM device_zone WHERE deso LIKE '01%'"


def _zoned(spark, folder):
    return weights.with_device_zone(X.stops(spark, folder), _device_zones(spark, folder), "01", 3)


@query("zone_devices", X.with_parts(
    "SELECT deso_r, count(DISTINCT device_aid) AS devices FROM stops JOIN zoned USING (device_aid) GROUP BY deso_r",
    "stops", "device_zone", zoned=_IZONE))
def zone_devices(spark, folder):
    return weights.devices_per_zone(_zoned(spark, folder))


_FREQ = """SELECT device_aid, latitude, longitude, count(*) AS freq, min(h3_id) AS h3_id FROM stops WHERE home = 0 GROUP BY ALL"""
_HOMES = "SELECT device_aid, min(latitude) AS hlat, min(longitude) AS hlon FROM stops JOIN zoned USING (device_aid) WHERE home = 1 GROUP BY device_aid"
_DIST = """SELECT device_aid, h3_id, freq, 2 * 6371 * asin(least(1e0, sqrt(power(sin(radians(hlat - latitude) / 2), 2)
    + cos(radians(latitude)) * cos(radians(hlat)) * power(sin(radians(hlon - longitude) / 2), 2)))) AS d2home
    FROM freqs JOIN hpoints USING (device_aid)"""
_CHAIN = dict(zoned=_IZONE, freqs=_FREQ, hpoints=_HOMES, dists=_DIST)


def _visits(spark, folder):
    homes = weights.home_points(_zoned(spark, folder))
    return weights.distance_from_home(weights.visit_frequency(X.stops(spark, folder)), homes)


def _zones3(spark, folder):
    return _device_zones(spark, folder).select("device_aid", F.substring("deso", 1, 3).alias("deso_r"))


@query("visit_distance", X.with_parts(
    "SELECT device_aid, h3_id, freq, round(d2home, 5) AS d2home FROM dists", "stops", "device_zone", **_CHAIN))
def visit_distance(spark, folder):
    return rounded(_visits(spark, folder).select("device_aid", "h3_id", "freq", "d2home"), ["d2home"], 5)


_ZC = """SELECT deso_r, h3_id, median(d2home) AS d2home, sum(freq)::BIGINT AS freq FROM dists JOIN zoned USING (device_aid)
    GROUP BY deso_r, h3_id"""


@query("zone_cell_visits", X.with_parts(
    "SELECT deso_r, h3_id, round(d2home, 5) AS d2home, freq FROM zc", "stops", "device_zone", **_CHAIN, zc=_ZC))
def zone_cell_visits(spark, folder):
    return rounded(weights.zone_cell_visits(_visits(spark, folder), _zones3(spark, folder)), ["d2home"], 5)


_ETA = "SELECT deso_r, -regr_slope(ln(freq), ln(d2home)) AS eta, count(*) AS n FROM zc WHERE d2home > 0 GROUP BY deso_r"


@query("distance_eta", X.with_parts(
    "SELECT deso_r, round(eta, 6) AS eta, n FROM eta", "stops", "device_zone", **_CHAIN, zc=_ZC, eta=_ETA))
def distance_eta(spark, folder):
    fit = weights.distance_decay(weights.zone_cell_visits(_visits(spark, folder), _zones3(spark, folder)))
    return rounded(fit.select("deso_r", "eta", "n"), ["eta"])


_EDGE = """SELECT device_aid, h3_id, freq * power(d, eta) AS freq_w FROM (SELECT device_aid, h3_id, sum(freq) AS freq,
    median(d2home) AS d FROM dists GROUP BY ALL) LEFT JOIN (SELECT device_aid, eta FROM zoned JOIN eta USING (deso_r))
    USING (device_aid)"""


def _edge_weights(spark, folder):
    from stayweave.session import cut_lineage
    visits, zones = cut_lineage(_visits(spark, folder)), cut_lineage(_zones3(spark, folder))
    eta = weights.distance_decay(weights.zone_cell_visits(visits, zones))
    return weights.corrected_weights(visits, zones, eta)


@query("edge_weight", X.with_parts(
    "SELECT device_aid, h3_id, round(freq_w, 5) AS freq_w FROM edge", "stops", "device_zone", **_CHAIN, zc=_ZC, eta=_ETA,
    edge=_EDGE))
def edge_weight(spark, folder):
    return rounded(_edge_weights(spark, folder), ["freq_w"], 5)


@query("quantile_trim", X.with_parts(
    """SELECT device_aid, h3_id, CAST(ceil(freq_w) AS INT) AS freq_wi FROM edge WHERE
       freq_w > (SELECT quantile_cont(freq_w, 0.05) FROM edge) AND freq_w < (SELECT quantile_cont(freq_w, 0.95) FROM edge)""",
    "stops", "device_zone", **_CHAIN, zc=_ZC, eta=_ETA, edge=_EDGE))
def quantile_trim(spark, folder):
    return weights.integer_weights(_edge_weights(spark, folder)).select("device_aid", "h3_id", "freq_wi")


def _hist_sql(log: bool) -> str:
    f = "log10({})" if log else "{}"
    back = "power(10e0, {})" if log else "{}"
    keep = "WHERE value > 0" if log else ""
    low, high = f.format("lo"), f.format("hi")
    edge = back.format(f"{low} + ({high} - {low}) * (bin + {{}}) / 49")
    return f"""SELECT bin, round({edge.format(0)}, 6) AS low, round({edge.format(1)}, 6) AS high, n,
        round(n / (total * (({edge.format(1)}) - ({edge.format(0)}))), 8) AS density FROM
        (SELECT bin, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi, any_value(total) AS total FROM
         (SELECT least(floor(({f.format('value')} - {low}) / ({high} - {low}) * 49), 48)::INT AS bin, lo, hi, total
          FROM (SELECT value FROM events {keep}), (SELECT min(value) AS lo, max(value) AS hi, count(*)::DOUBLE AS total
          FROM events {keep})) GROUP BY bin)"""


@query("histogram_lin", _hist_sql(False))
def histogram_lin(spark, folder):
    out = describe.histogram(X.table(spark, folder, "events"), "value", 50)
    return rounded(rounded(out, ["low", "high"]), ["density"], 8)


@query("histogram_log", _hist_sql(True))
def histogram_log(spark, folder):
    out = describe.histogram(X.table(spark, folder, "events"), "value", 50, log=True)
    return rounded(rounded(out, ["low", "high"]), ["density"], 8)


_SUM = """SELECT '{0}' AS "column", count({0}) AS count, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std,
    min({0})::DOUBLE AS min, max({0})::DOUBLE AS max, round(quantile_cont({0}, 0.25), 6) AS q25,
    round(quantile_cont({0}, 0.5), 6) AS q50, round(quantile_cont({0}, 0.75), 6) AS q75 FROM {1}"""


@query("summary_stats", _SUM.format("l_quantity", "lineitem") + " UNION ALL " + _SUM.format("l_extendedprice", "lineitem"))
def summary_stats(spark, folder):
    out = describe.summary(X.table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rounded(out, ["mean", "std", "q25", "q50", "q75"])


_VS = """SELECT '{0}' AS attribute, {0} AS value, count(*) AS n, round(count(*) / (sum(count(*)) OVER ()), 6) AS share
    FROM buildings GROUP BY {0}"""


@query("value_shares", X.with_parts(
    " UNION ALL ".join(f"SELECT * FROM ({_VS.format(c)})" for c in ("source", "subtype", "class")), "buildings"))
def value_shares(spark, folder):
    return rounded(describe.value_shares(X.buildings(spark, folder), ["source", "subtype", "class"]), ["share"])


@query("group_medians", """
    SELECT l_returnflag, round(median(l_quantity), 6) AS l_quantity, round(median(l_extendedprice), 6) AS l_extendedprice
    FROM lineitem GROUP BY l_returnflag""")
def group_medians(spark, folder):
    out = describe.group_medians(X.table(spark, folder, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"])
    return rounded(out, ["l_quantity", "l_extendedprice"])


@query("crosstab_shares", """
    SELECT event_type, cluster, n, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS share FROM
    (SELECT event_type, user_id % 5 AS cluster, count(*) AS n FROM events GROUP BY ALL)""")
def crosstab_shares(spark, folder):
    rows = X.table(spark, folder, "events").withColumn("cluster", F.col("user_id") % 5)
    return rounded(describe.crosstab_shares(rows, "event_type", "cluster"), ["share"])
