"""Queries on filters, time, geometry and the flagship diversity table."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayweave import constants as C
from stayweave.functions import geo
from stayweave.functions import segregation as S
from stayweave.functions import time as T
from stayweave.operators import demographics as D
from stayweave.operators import filters, homes
from stayweave.plans import fixtures as X
from stayweave.plans.registry import query

SHARE_COLUMNS = ["ice_birth", "ice_income", "prop_sweden", "prop_other", "prop_q1", "prop_q4"]


def rounded(df, names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def diversity(spark, folder):
    demo = D.device_demographics(X.home_building(spark, folder), X.building_data(spark, folder))
    return D.copresence_diversity(X.stops(spark, folder), demo)


@query("copresence_diversity", X.with_parts(
    "SELECT h3_id, time_bin, day_type, n_visitors, " + ", ".join(f"round({c}, 6) AS {c}" for c in SHARE_COLUMNS)
    + " FROM diversity", "diversity"))
def copresence_diversity(spark, folder):
    return rounded(diversity(spark, folder), SHARE_COLUMNS)


@query("cell_rollup", X.with_parts(
    "SELECT h3_id, sum(n_visitors)::BIGINT AS n_visitors, "
    + ", ".join(f"round(avg({c}), 6) AS {c}" for c in SHARE_COLUMNS) + " FROM diversity GROUP BY h3_id", "diversity"))
def cell_rollup(spark, folder):
    return rounded(D.cell_rollup(diversity(spark, folder)), SHARE_COLUMNS)


@query("device_demographics", X.with_parts(
    "SELECT device_aid, " + ", ".join(f"round({c}, 6) AS {c}" for c in D.SHARES) + " FROM demographics",
    "demographics"))
def device_demographics(spark, folder):
    return rounded(D.device_demographics(X.home_building(spark, folder), X.building_data(spark, folder)), D.SHARES)


_ICE = X.with_parts(
    """SELECT device_aid, round(other / po, 6) AS other_share, round(Q1 / pi, 6) AS q1_share,
       round((sweden / sa - other / sb) / (sweden / sa + other / sb + (po - sweden - other) / (1 - sa - sb)), 6) AS ice_b,
       round((Q1 - Q4) / 0.25e0 / ((Q1 + Q4) / 0.25e0 + (pi - Q1 - Q4) / 0.5e0), 6) AS ice_i,
       CASE WHEN (Q1 - Q4) / 0.25e0 / ((Q1 + Q4) / 0.25e0 + (pi - Q1 - Q4) / 0.5e0) < -0.2e0 THEN 0
            WHEN (Q1 - Q4) / 0.25e0 / ((Q1 + Q4) / 0.25e0 + (pi - Q1 - Q4) / 0.5e0) < 0.2e0 THEN 1 ELSE 2 END AS income_group
       FROM (SELECT *, (sweden + nordic + eu + other)::DOUBLE AS po, (Q1 + Q2 + Q3 + Q4)::DOUBLE AS pi,
             0.8044332515556147e0 AS sa, 0.11067529894925136e0 AS sb FROM home_building JOIN building_data USING (b_id))
       WHERE po > 0 AND pi > 0""", "home_building", "building_data")


@query("ice_device", _ICE)
def ice_device(spark, folder):
    rows = D.device_indices(X.home_building(spark, folder), X.building_data(spark, folder))
    rows = rows.select("device_aid", "other_share", "q1_share", "ice_b", "ice_i",
                       S.ice_group("ice_i").alias("income_group"))
    return rounded(rows, ["other_share", "q1_share", "ice_b", "ice_i"])


@query("device_attributes", X.with_parts(
    """SELECT device_aid, round(lat, 6) AS latitude, round(lon, 6) AS longitude, b_id, sweden, nordic, eu, other,
       Q1, Q2, Q3, Q4 FROM (SELECT device_aid, min(latitude) AS lat, min(longitude) AS lon FROM stays WHERE home = 1
       GROUP BY device_aid) LEFT JOIN home_building USING (device_aid) LEFT JOIN building_data USING (b_id)""",
    "stays", "home_building", "building_data"))
def device_attributes(spark, folder):
    out = D.device_attributes(X.stays(spark, folder), X.home_building(spark, folder), X.building_data(spark, folder))
    return rounded(out, ["latitude", "longitude"])


@query("time_enrich", X.with_parts(
    """SELECT interval AS event_id, strftime(localtime_, '%Y-%m-%d %H:%M:%S') AS localtime,
       strftime(l_localtime_, '%Y-%m-%d %H:%M:%S') AS l_localtime, hour(localtime_)::INT AS hour,
       month(localtime_)::INT AS month, year(localtime_)::INT AS year, (isodow(localtime_) - 1)::INT AS weekday,
       weekofyear(localtime_)::INT AS week, strftime(localtime_, '%Y-%m-%d') AS date FROM timed""", "timed"))
def time_enrich(spark, folder):
    rows = T.with_local_times(X.stays(spark, folder))
    p = T.calendar_parts("localtime")
    fmt = "yyyy-MM-dd HH:mm:ss"
    return rows.select(
        F.col("interval").alias("event_id"), F.date_format("localtime", fmt).alias("localtime"),
        F.date_format("l_localtime", fmt).alias("l_localtime"), p["hour"].alias("hour"), p["month"].alias("month"),
        p["year"].alias("year"), p["weekday"].alias("weekday"), p["week"].alias("week"),
        F.date_format("localtime", "yyyy-MM-dd").alias("date"))


@query("time_bins", X.with_parts(
    "SELECT " + X._BIN.format("localtime_") + """ AS time_bin,
       CASE WHEN isodow(localtime_) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, count(*) AS n
       FROM timed GROUP BY ALL""", "timed"))
def time_bins(spark, folder):
    rows = T.with_local_times(X.stays(spark, folder))
    return rows.groupBy(
        T.time_bin(F.hour("localtime")).alias("time_bin"), T.day_type(F.weekday("localtime")).alias("day_type")
    ).agg(F.count("*").alias("n"))


@query("lenient_timestamps", """
    SELECT event_id, strftime(try_cast(CASE WHEN event_id % 5 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S')
    END AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS parsed FROM events""")
def lenient_timestamps(spark, folder):
    text = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return X.table(spark, folder, "events").select(
        "event_id", F.date_format(T.lenient_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("stay_ticks", X.with_parts(
    """SELECT device_aid, loc, tick, strftime(timezone('Europe/Stockholm', to_timestamp(tick)), '%Y-%m-%d %H:%M:%S') AS time
       FROM (SELECT device_aid, loc, unnest(range("start", "end" + 1, 900)) AS tick FROM stays)""", "stays"))
def stay_ticks(spark, folder):
    rows = homes.stay_ticks(X.stays(spark, folder))
    return rows.select("device_aid", "loc", "tick", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"))


_COUNTRY = "latitude BETWEEN 55.3617373725e0 AND 69.1062472602e0 AND longitude BETWEEN 11.0273686052e0 AND 23.9033785336e0"
_CITY = "latitude BETWEEN 59.1174841345e0 AND 59.475092515e0 AND longitude BETWEEN 17.6799476147e0 AND 18.4572303295e0"


@query("bbox_filter", X.with_parts(
    f"""SELECT interval, CAST({_COUNTRY} AS INT) AS in_country, CAST({_CITY} AS INT) AS in_city FROM stays
        WHERE {_COUNTRY}""", "stays"))
def bbox_filter(spark, folder):
    rows = homes.domestic(X.stays(spark, folder))
    return rows.select(
        "interval", geo.in_box("latitude", "longitude", C.COUNTRY_BOX).cast("int").alias("in_country"),
        geo.in_box("latitude", "longitude", C.CITY_BOX).cast("int").alias("in_city"))


@query("valid_coordinates", X.with_parts(
    """SELECT interval, round(lat2, 6) AS latitude, round(longitude, 6) AS longitude FROM
       (SELECT *, latitude + CASE WHEN interval % 4 = 0 THEN 30e0 WHEN interval % 4 = 1 THEN NULL ELSE 0e0 END AS lat2 FROM stays)
       WHERE lat2 BETWEEN -80 AND 84 AND longitude BETWEEN -180 AND 180""", "stays"))
def valid_coordinates(spark, folder):
    shift = F.when(F.col("interval") % 4 == 0, 30.0).when(F.col("interval") % 4 == 1, None).otherwise(0.0)
    rows = X.stays(spark, folder).withColumn("latitude", F.col("latitude") + shift)
    kept = rows.filter(geo.valid_coordinate("latitude", "longitude")).filter(geo.is_finite("latitude", "longitude"))
    return rounded(kept.select("interval", "latitude", "longitude"), ["latitude", "longitude"])


@query("haversine", X.with_parts(
    """SELECT interval, round(2 * 6371 * asin(least(1e0, sqrt(power(sin(radians(latitude - 59.33e0) / 2), 2)
       + cos(radians(59.33e0)) * cos(radians(latitude)) * power(sin(radians(longitude - 18.07e0) / 2), 2)))), 5) AS km
       FROM stays""", "stays"))
def haversine(spark, folder):
    km = geo.haversine_km(F.lit(18.07), F.lit(59.33), "longitude", "latitude")
    return X.stays(spark, folder).select("interval", F.round(km, 5).alias("km"))


@query("project_national", X.with_parts(
    "SELECT interval, round(x, 3) AS x, round(y, 3) AS y FROM stops_xy", "stops_xy"))
def project_national(spark, folder):
    rows = geo.with_national_xy(X.stays(spark, folder))
    return rounded(rows.select("interval", "x", "y"), ["x", "y"], 3)


@query("inverse_projection", X.with_parts(
    "SELECT interval, round(latitude, 7) AS latitude, round(longitude, 7) AS longitude FROM stays", "stays"))
def inverse_projection(spark, folder):
    rows = geo.with_national_xy(X.stays(spark, folder)).select("interval", "x", "y")
    return rounded(geo.with_degrees(rows).select("interval", "latitude", "longitude"), ["latitude", "longitude"], 7)


@query("hex_cell", X.with_parts("SELECT interval, h3_id FROM stops", "stops"))
def hex_cell(spark, folder):
    return geo.with_cell(X.stays(spark, folder)).select("interval", "h3_id")


@query("hex_shapes", X.with_parts(
    """SELECT h3_id, k, round((q + r / 2e0) * sqrt(3e0) * 531.414e0 + 531.414e0 * cos(radians(60 * k - 30)), 3) AS x,
       round(r * 1.5e0 * 531.414e0 + 531.414e0 * sin(radians(60 * k - 30)), 3) AS y
       FROM (SELECT DISTINCT h3_id, h3_id // 2097152 - 1048576 AS q, h3_id % 2097152 - 1048576 AS r FROM stops),
       (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k)""", "stops"))
def hex_shapes(spark, folder):
    cells = X.stops(spark, folder).select("h3_id").distinct()
    corners = cells.select("h3_id", F.posexplode(geo.hex_boundary("h3_id")).alias("k", "c"))
    return rounded(corners.select("h3_id", "k", "c.x", "c.y"), ["x", "y"], 3)


@query("hex_centers", X.with_parts(
    """SELECT h3_id, round((q + r / 2e0) * sqrt(3e0) * 531.414e0, 3) AS x, round(r * 1.5e0 * 531.414e0, 3) AS y FROM
       (SELECT DISTINCT h3_id, h3_id // 2097152 - 1048576 AS q, h3_id % 2097152 - 1048576 AS r FROM stops)""", "stops"))
def hex_centers(spark, folder):
    x, y = geo.hex_center("h3_id")
    return rounded(X.stops(spark, folder).select("h3_id").distinct().select(
        "h3_id", x.alias("x"), y.alias("y")), ["x", "y"], 3)


@query("residential_buildings", X.with_parts(
    "SELECT id, class, source FROM buildings WHERE subtype = 'residential'", "buildings"))
def residential_buildings(spark, folder):
    return filters.residential(X.buildings(spark, folder)).select("id", "class", "source")


@query("poi_categories", """
    SELECT CAST(p_partkey AS VARCHAR) AS id, p_type AS "primary",
      CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE len(string_split(p_name, ' ')) END AS sec_l,
      CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE replace(p_name, ' ', ';') END AS sec_cat
    FROM part WHERE p_partkey % 10 <> 9""")
def poi_categories(spark, folder):
    alternate = F.when(F.col("p_partkey") % 3 != 0, F.split("p_name", " "))
    rows = X.table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.when(F.col("p_partkey") % 10 != 9, F.struct(F.col("p_type").alias("primary"), alternate.alias("alternate")))
        .alias("categories"))
    return filters.poi_categories(rows).select("id", "primary", "sec_l", "sec_cat")


@query("kind_names", """
    SELECT CAST(p_partkey AS VARCHAR) AS osm_id, p_type AS "primary", c.community, 'kind ' || c.community AS kind
    FROM part JOIN (SELECT p_type, min(p_size) % 3 AS community FROM part GROUP BY p_type) c USING (p_type)""")
def kind_names(spark, folder):
    parts = X.table(spark, folder, "part")
    communities = parts.groupBy(F.col("p_type").alias("primary")).agg((F.min("p_size") % 3).alias("community"))
    names = communities.select("community").distinct().withColumn("kind", F.concat(F.lit("kind "), "community"))
    pois = parts.select(F.col("p_partkey").cast("string").alias("osm_id"), F.col("p_type").alias("primary"))
    return filters.name_kinds(pois, communities, names).select("osm_id", "primary", "community", "kind")


@query("city_subset", X.with_parts("SELECT device_aid, h3_id, count(*) AS n FROM city GROUP BY ALL", "city"))
def city_subset(spark, folder):
    return D.city_visits(X.stops(spark, folder)).groupBy("device_aid", "h3_id").agg(F.count("*").alias("n"))


@query("city_stops", X.with_parts(
    f"""SELECT device_aid, h3_id, loc, round(dur, 4) AS dur, home, weekday::INT AS weekday,
        strftime(localtime_, '%Y-%m-%d') AS date FROM stops WHERE {_CITY}""", "stops"))
def city_stops(spark, folder):
    rows = filters.city_stops(X.stops(spark, folder))
    return rows.select("device_aid", "h3_id", "loc", F.round("dur", 4).alias("dur"), "home", "weekday",
                       F.date_format("date", "yyyy-MM-dd").alias("date"))


def _hash(key: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


@query("device_groups", f"""
    SELECT device_aid, ({_hash('device_aid', 0)} % 50)::INT AS grp
    FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS device_aid FROM events)""")
def device_groups(spark, folder):
    return filters.device_groups(filters.distinct_devices(X.pings(spark, folder)), 50)


@query("grouped_pings", X.with_parts(
    f"""SELECT ({_hash('device_aid', 0)} % 50)::INT AS grp, count(*) AS n FROM pings GROUP BY 1""", "pings"))
def grouped_pings(spark, folder):
    rows = X.pings(spark, folder)
    devices = filters.device_groups(filters.distinct_devices(rows), 50)
    return rows.join(devices, "device_aid", "left").groupBy("grp").agg(F.count("*").alias("n"))


@query("monthly_devices", """
    SELECT strftime(ts, '%m') AS month, CAST(user_id AS VARCHAR) AS device_aid FROM events GROUP BY ALL""")
def monthly_devices(spark, folder):
    return X.table(spark, folder, "events").select(
        F.date_format("ts", "MM").alias("month"), F.col("user_id").cast("string").alias("device_aid")).distinct()


@query("device_sample", X.with_parts(
    f"""SELECT device_aid, count(*) AS n FROM stays WHERE {_hash('device_aid', 42)} < {int(0.15 * 2**32)}
        GROUP BY device_aid""", "stays"))
def device_sample(spark, folder):
    return filters.sample_devices(X.stays(spark, folder), 0.15).groupBy("device_aid").agg(F.count("*").alias("n"))


@query("row_sample", f"""
    SELECT event_id, user_id FROM events ORDER BY {_hash('CAST(event_id AS VARCHAR)', 42)}, event_id LIMIT 500""")
def row_sample(spark, folder):
    return filters.sample_rows(X.table(spark, folder, "events").select("event_id", "user_id"), 500, "event_id")


@query("first_devices", X.with_parts(
    """SELECT device_aid, loc, count(*) AS n FROM stays WHERE device_aid IN
       (SELECT DISTINCT device_aid FROM stays ORDER BY device_aid LIMIT 10) GROUP BY ALL""", "stays"))
def first_devices(spark, folder):
    return filters.first_devices(X.stays(spark, folder), 10).groupBy("device_aid", "loc").agg(F.count("*").alias("n"))


@query("union_batches", X.with_parts(
    "SELECT batch, count(*) AS n, sum(size)::BIGINT AS size FROM stays GROUP BY batch", "stays"))
def union_batches(spark, folder):
    rows = X.stays(spark, folder)
    parts = filters.union_all([rows.filter(F.col("batch") % 3 == b) for b in range(3)])
    return parts.groupBy("batch").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query("first_per_device", X.with_parts(
    """SELECT device_aid, loc, "start" FROM (SELECT *, row_number() OVER (PARTITION BY device_aid ORDER BY "start", interval)
       AS r FROM stays) WHERE r = 1""", "stays"))
def first_per_device(spark, folder):
    return filters.first_per_key(
        X.stays(spark, folder).select("device_aid", "loc", "start", "interval"), ["device_aid"], ["start", "interval"]
    ).drop("interval")
