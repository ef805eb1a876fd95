"""Home and work labels from daily shares of observed hours.

The rule is this library's own definition: hourly presence, day shares, centred day windows and
thresholds on missing days, mean share and visited days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayweave import constants as C
from stayweave.functions.time import local_time
from stayweave.session import cut_lineage

WORK_HOURS = (9, 17)


def hourly_presence(stays: DataFrame) -> DataFrame:
    """Distinct (device, place, local day, hour) a stay covers."""
    hours = F.sequence(F.floor(F.col("start") / 3600), F.floor(F.col("end") / 3600))
    at = local_time(F.col("_h") * 3600)
    return (
        stays.select("device_aid", "loc", F.explode(hours).alias("_h")).distinct()
        .select("device_aid", "loc", F.to_date(at).alias("day"), F.hour(at).alias("hour"),
                F.weekday(at).alias("weekday"), "_h")
    )


def _slot(kind: str) -> Column:
    if kind == "home":
        return (F.col("hour") >= C.NIGHT_START_HOUR) | (F.col("hour") < C.NIGHT_END_HOUR)
    return F.col("hour").between(WORK_HOURS[0], WORK_HOURS[1] - 1) & (F.col("weekday") < 5)


def daily_shares(presence: DataFrame, kind: str, min_hours: int) -> DataFrame:
    """Share of a device's observed night (or working) hours of a day spent at each place.

    Days with fewer than ``min_hours`` observed hours are left out.
    """
    relevant = presence.filter(_slot(kind))
    seen = relevant.groupBy("device_aid", "day").agg(F.countDistinct("_h").alias("observed"))
    at_place = relevant.groupBy("device_aid", "loc", "day").agg(F.count("*").alias("hours"))
    return (
        at_place.join(seen.filter(F.col("observed") >= min_hours), ["device_aid", "day"])
        .select("device_aid", "loc", "day", "hours", "observed",
                F.least(F.lit(1.0), F.col("hours") / F.col("observed")).alias("share"))
    )


def _labelled_days(shares: DataFrame, days: int, missing: float, share: float, visited: float) -> DataFrame:
    """Best place of each device day whose centred window passes the thresholds."""
    number = F.unix_date("day")
    near = (-(days // 2), days - days // 2 - 1)
    valid_days = shares.select("device_aid", "day").distinct().withColumn("_valid", F.count("*").over(
        W.partitionBy("device_aid").orderBy(number).rangeBetween(*near)))
    by_place = W.partitionBy("device_aid", "loc").orderBy(number).rangeBetween(*near)
    scored = (
        shares.withColumns({"_sum": F.sum("share").over(by_place), "_days": F.count("*").over(by_place)})
        .join(valid_days, ["device_aid", "day"])
        .withColumns({"_mean": F.round(F.col("_sum") / F.col("_valid"), 9), "_visited": F.col("_days") / F.col("_valid")})
        .filter((1 - F.col("_valid") / days <= missing) & (F.col("_mean") >= share) & (F.col("_visited") >= visited))
    )
    return scored.groupBy("device_aid", "day").agg(
        F.max_by("loc", F.struct("_mean", -F.col("loc"))).alias("loc"))


def label_stays(stays: DataFrame, home_days: int, work_days: int, min_hours: int, missing_home: float,
                missing_work: float, share_home: float, share_work: float, days_work: float) -> DataFrame:
    """Add ``location_type``: H, W or O by the label of the stay's place on its local start day."""
    presence = cut_lineage(hourly_presence(stays))
    homes = cut_lineage(_labelled_days(daily_shares(presence, "home", min_hours), home_days, missing_home, share_home, 0.0))
    work_shares = daily_shares(presence, "work", min_hours).join(
        homes.select("device_aid", "loc").distinct(), ["device_aid", "loc"], "left_anti")
    works = _labelled_days(work_shares, work_days, missing_work, share_work, days_work)
    days = homes.withColumn("location_type", F.lit("H")).unionByName(works.withColumn("location_type", F.lit("W")))
    return (
        stays.withColumn("day", F.to_date(local_time("start")))
        .join(days, ["device_aid", "loc", "day"], "left")
        .withColumn("location_type", F.coalesce("location_type", F.lit("O"))).drop("day")
    )


def workplaces(labelled: DataFrame) -> DataFrame:
    """Most frequent work place of each device and its number of stays; ties to the smallest place."""
    counts = labelled.filter("location_type = 'W'").groupBy("device_aid", "loc").agg(F.count("*").alias("n"))
    best = F.struct(F.col("n"), -F.col("loc"))
    return counts.groupBy("device_aid").agg(
        F.max_by("loc", best).alias("workplace_loc"), F.max("n").alias("workplace_count"))
