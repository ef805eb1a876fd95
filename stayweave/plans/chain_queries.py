"""One chain over real outputs: from pings to the diversity of the people present."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayweave.functions import geo
from stayweave.operators import census, filters, homes, spatial, stays
from stayweave.operators import demographics as D
from stayweave.plans import fixtures as X
from stayweave.plans.base_queries import _COUNTRY, SHARE_COLUMNS, rounded
from stayweave.plans.link_queries import _BIRTH, _INCOME
from stayweave.plans.registry import query
from stayweave.plans.stay_queries import _RUNS, _STEPS
from stayweave.session import stored

# A stay's place: a square of 0.002 degrees around its median.
_LOC = "CAST(round((latitude - 59) * 500) AS BIGINT) * 100000 + CAST(round((longitude - 17) * 500) AS BIGINT)"

_CHAIN = dict(
    steps=_STEPS, runs=_RUNS,
    found="""SELECT device_aid, run, min(timestamp) AS "start", max(timestamp) AS "end", count(*) AS size,
        median(latitude) AS latitude, median(longitude) AS longitude FROM runs
        GROUP BY device_aid, run HAVING max(timestamp) - min(timestamp) >= 900 AND count(*) >= 2""",
    long=f"""SELECT *, {_LOC} AS loc, timezone('Europe/Stockholm', to_timestamp("start")) AS localtime_ FROM found
        WHERE {_COUNTRY} AND "end" - "start" >= 900 AND "end" - "start" < 43200""",
    ticked="""SELECT device_aid, loc, timezone('Europe/Stockholm', to_timestamp(t)) AS w
        FROM (SELECT device_aid, loc, unnest(range("start", "end" + 1, 900)) AS t FROM long)""",
    living="""SELECT device_aid, loc FROM (SELECT *, row_number() OVER (PARTITION BY device_aid
        ORDER BY CASE WHEN any_night THEN night ELSE total END DESC, loc) AS r
        FROM (SELECT *, max(night) OVER (PARTITION BY device_aid) > 0 AS any_night
        FROM (SELECT device_aid, loc, count(*) AS total,
              count(*) FILTER (hour(w) >= 22 OR hour(w) * 3600 + minute(w) * 60 + second(w) <= 25200) AS night
              FROM ticked GROUP BY device_aid, loc))) WHERE r = 1""",
    flagged="""SELECT long.*, CAST(living.device_aid IS NOT NULL AS INT) AS home FROM long LEFT JOIN living USING (device_aid, loc)""",
    supported="""SELECT * FROM flagged WHERE device_aid IN (SELECT device_aid FROM flagged WHERE home = 1 GROUP BY device_aid
        HAVING count(DISTINCT CAST(timezone('UTC', to_timestamp("start")) AS DATE)) >= 3)""",
    points="""SELECT device_aid, arg_min(latitude, "start") AS latitude, arg_min(longitude, "start") AS longitude
        FROM supported WHERE home = 1 GROUP BY device_aid""",
    points_xy=X.national_sql("points"),
    housed="""SELECT device_aid, id AS b_id FROM (SELECT *, row_number() OVER (PARTITION BY device_aid ORDER BY d, id) AS r FROM
        (SELECT device_aid, id, sqrt(power(greatest(abs(x - cx) - hw, 0), 2) + power(greatest(abs(y - cy) - hh, 0), 2)) AS d
         FROM points_xy, buildings WHERE subtype = 'residential') WHERE d <= 50) WHERE r = 1""",
    **_INCOME, **_BIRTH,
    people="""SELECT device_aid, CASE WHEN born > 0 THEN sweden / born ELSE 0 END AS prop_sweden,
        CASE WHEN born > 0 THEN other / born ELSE 0 END AS prop_other, CASE WHEN born > 0 THEN (nordic + eu) / born ELSE 0 END AS prop_middle_birth,
        CASE WHEN earn > 0 THEN Q1 / earn ELSE 0 END AS prop_q1, CASE WHEN earn > 0 THEN Q4 / earn ELSE 0 END AS prop_q4,
        CASE WHEN earn > 0 THEN (Q2 + Q3) / earn ELSE 0 END AS prop_middle_income FROM
        (SELECT housed.device_aid, t.*, (sweden + nordic + eu + other)::DOUBLE AS born, (Q1 + Q2 + Q3 + Q4)::DOUBLE AS earn FROM housed
         LEFT JOIN (SELECT id AS b_id, sweden, nordic, eu, other, Q1, Q2, Q3, Q4 FROM birth JOIN income USING (id)) t USING (b_id))""",
    out_xy=X.national_sql("(SELECT *, isodow(localtime_) - 1 AS weekday FROM supported WHERE home <> 1 AND latitude BETWEEN "
                          "59.1174841345e0 AND 59.475092515e0 AND longitude BETWEEN 17.6799476147e0 AND 18.4572303295e0)"),
    out_cells=X.cell_sql("out_xy"),
    present=f"""SELECT DISTINCT device_aid, h3_id, {X._BIN.format('localtime_')} AS time_bin,
        CASE WHEN weekday >= 5 THEN 'weekend' ELSE 'weekday' END AS day_type FROM out_cells""",
    mixed=X.PARTS["cells"].replace("slots", "present").replace("demographics", "people"),
    result=X.PARTS["diversity"].replace("FROM cells", "FROM mixed"))


@query("pipeline_diversity", X.with_parts(
    "SELECT h3_id, time_bin, day_type, n_visitors, " + ", ".join(f"round({c}, 6) AS {c}" for c in SHARE_COLUMNS) + " FROM result",
    "clean", "buildings", "income_squares", "birth_squares", **_CHAIN))
def pipeline_diversity(spark, folder):
    """Pings, stays, length and country filter, homes, buildings, census, diversity: each step reads the one before."""
    found = stays.step_runs(stays.clean_pings(X.pings(spark, folder))).withColumn("loc", F.expr(_LOC))
    rows = stored(homes.load_stays(found))
    rows = homes.with_home_support(homes.mark_home(rows, homes.home_places(rows)))
    rows = stored(homes.enrich_stays(rows))
    buildings = X.buildings(spark, folder)
    linked = spatial.nearest_building(homes.home_table(rows), filters.residential(buildings)).filter("b_id is not null")
    tables = []
    for squares, names in ((census.merge_birth_squares(X.squares(spark, folder)), census.BIRTH_NAMES),
                           (census.merge_income_squares(X.squares(spark, folder)), census.INCOME_NAMES)):
        values = census.with_square_values(spatial.overlay_squares(buildings, squares), squares, names)
        tables.append(census.area_weighted(values, [v for v in names.values() if v != "grid_size"]))
    people = D.device_demographics(linked, census.building_table(*tables))
    return rounded(D.copresence_diversity(geo.with_cell(rows), people), SHARE_COLUMNS)
