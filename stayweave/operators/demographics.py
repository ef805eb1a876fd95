"""Visitor demographics by cell and time, and the concentration indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayweave import constants as C
from stayweave.functions import geo
from stayweave.functions import segregation as S
from stayweave.functions import time as T

BIRTH = ["sweden", "nordic", "eu", "other"]
INCOME = ["Q1", "Q2", "Q3", "Q4"]
SHARES = ["prop_sweden", "prop_other", "prop_middle_birth", "prop_q1", "prop_q4", "prop_middle_income"]


def device_demographics(home_building: DataFrame, building_data: DataFrame) -> DataFrame:
    """Population shares of each device's home building; zero where unknown or empty."""
    joined = home_building.select("device_aid", "b_id").join(building_data, "b_id", "left")
    born, earning = S.null_safe_sum(*BIRTH), S.null_safe_sum(*INCOME)
    return joined.select(
        "device_aid", S.share("sweden", born).alias("prop_sweden"), S.share("other", born).alias("prop_other"),
        S.share(F.col("nordic") + F.col("eu"), born).alias("prop_middle_birth"),
        S.share("Q1", earning).alias("prop_q1"), S.share("Q4", earning).alias("prop_q4"),
        S.share(F.col("Q2") + F.col("Q3"), earning).alias("prop_middle_income"))


def device_indices(home_building: DataFrame, building_data: DataFrame) -> DataFrame:
    """Shares and indices of each device with a fully known, inhabited home building."""
    known = home_building.select("device_aid", "b_id").join(building_data, "b_id").na.drop()
    known = known.withColumns({"pop_o": S.null_safe_sum(*BIRTH), "pop_i": S.null_safe_sum(*INCOME)}).filter(
        "pop_o > 0 and pop_i > 0")
    rest_o = F.col("pop_o") - F.col("sweden") - F.col("other")
    rest_i = F.col("pop_i") - F.col("Q1") - F.col("Q4")
    return known.withColumns({
        "other_share": F.col("other") / F.col("pop_o"), "q1_share": F.col("Q1") / F.col("pop_i"),
        "ice_b": S.ice("sweden", "other", rest_o, C.SHARE_NATIVE_FULL, C.SHARE_OTHER_FULL),
        "ice_i": S.ice_income("Q1", "Q4", rest_i)})


def city_visits(stops: DataFrame, box=C.CITY_BOX) -> DataFrame:
    """Visits away from home inside the city box."""
    return stops.filter(F.coalesce(F.col("home") != 1, F.lit(True)) & geo.in_box("latitude", "longitude", box))


def visit_slots(stops: DataFrame) -> DataFrame:
    """Distinct (device, cell, time bin, day type) of the visits."""
    return stops.select(
        "device_aid", "h3_id", T.time_bin(F.hour("localtime")).alias("time_bin"),
        T.day_type("weekday").alias("day_type")).distinct()


def cell_demographics(slots: DataFrame, demographics: DataFrame, min_visitors: int = C.MIN_VISITORS) -> DataFrame:
    """Distinct visitors and mean shares of each (cell, time bin, day type) with enough visitors."""
    return (
        slots.join(demographics, "device_aid").groupBy("h3_id", "time_bin", "day_type")
        .agg(F.count("*").alias("n_visitors"), *[F.avg(s).alias(s) for s in SHARES])
        .filter(F.col("n_visitors") >= min_visitors)
    )


def copresence_diversity(stops: DataFrame, demographics: DataFrame, min_visitors: int = C.MIN_VISITORS) -> DataFrame:
    """Diversity of the people present in each cell by time of day and day type.

    Repeat visits collapse before the demographics join, so the join and the means see at most one
    row per device, cell and slot.
    """
    cells = cell_demographics(visit_slots(city_visits(stops)), demographics, min_visitors)
    return cells.select(
        "h3_id", "time_bin", "day_type", "n_visitors",
        S.ice_birth("prop_sweden", "prop_other", "prop_middle_birth").alias("ice_birth"),
        S.ice_income("prop_q1", "prop_q4", "prop_middle_income").alias("ice_income"),
        "prop_sweden", "prop_other", "prop_q1", "prop_q4")


def cell_rollup(diversity: DataFrame) -> DataFrame:
    """Cell-level means of the indices and shares, and summed visitors."""
    return diversity.groupBy("h3_id").agg(
        *[F.avg(c).alias(c) for c in ("ice_birth", "ice_income")], F.sum("n_visitors").alias("n_visitors"),
        *[F.avg(c).alias(c) for c in ("prop_sweden", "prop_other", "prop_q1", "prop_q4")])


def device_attributes(stops: DataFrame, home_building: DataFrame, building_data: DataFrame) -> DataFrame:
    """One row per device at home: first home point, building and census attributes."""
    first = F.struct("latitude", "longitude")
    points = stops.filter("home = 1").groupBy("device_aid").agg(F.min(first).alias("_p")).select("device_aid", "_p.*")
    return points.join(home_building.select("device_aid", "b_id"), "device_aid", "left").join(
        building_data, "b_id", "left")
