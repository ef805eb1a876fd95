"""Stay enrichment, retention reports and home detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayweave import constants as C
from stayweave.functions import geo
from stayweave.functions import time as T
from stayweave.operators.ordered import with_sequence


def domestic(stays: DataFrame, box=C.COUNTRY_BOX) -> DataFrame:
    """Stays inside the country box."""
    return stays.filter(geo.in_box("latitude", "longitude", box))


def with_duration(stays: DataFrame) -> DataFrame:
    """Add the stay length ``dur`` in minutes."""
    return stays.withColumn("dur", (F.col("end") - F.col("start")) / 60)


def usable_length(dur="dur"):
    low, high = C.STAY_MINUTES
    return (F.col(dur) >= low) & (F.col(dur) < high)


def load_stays(stays: DataFrame) -> DataFrame:
    """Domestic stays of usable length with local arrival, departure and the UTC date."""
    kept = with_duration(domestic(stays)).filter(usable_length())
    return T.with_local_times(kept).withColumn("date", T.utc_date("start"))


def retention(rows: DataFrame, steps: dict[str, F.Column], device: str = "device_aid") -> DataFrame:
    """Shares of rows and devices that pass each step among those that passed the ones before."""
    passed, names, kept = F.lit(True), list(steps), [F.count("*").alias("n_0")]
    for i, condition in enumerate(steps.values(), start=1):
        passed = passed & F.coalesce(condition, F.lit(False))
        kept.append(F.count_if(passed).alias(f"n_{i}"))
    # one row per device, then plain sums: no row is repeated for a distinct count
    known = F.col(device).isNotNull()
    totals = rows.groupBy(device).agg(*kept).agg(
        *[F.sum(f"n_{i}").alias(f"n_{i}") for i in range(len(kept))],
        *[F.count_if((F.col(f"n_{i}") > 0) & known).alias(f"d_{i}") for i in range(len(kept))])
    return totals.select(F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("step"), F.coalesce(f"n_{i}", F.lit(0)).alias("rows_kept"), F.col(f"d_{i}").alias("devices_kept"),
            F.try_divide(F.col(f"n_{i}").cast("double"), F.col(f"n_{i - 1}")).alias("row_share"),
            F.try_divide(F.col(f"d_{i}").cast("double"), F.col(f"d_{i - 1}")).alias("device_share"))
        for i, name in enumerate(names, start=1)
    ])).alias("r")).select("r.*")


def stay_ticks(stays: DataFrame, minutes: int = C.TICK_MINUTES) -> DataFrame:
    """One row per tick of each stay, with epoch ``tick`` and local ``time``."""
    return stays.withColumn("tick", F.explode(T.tick_epochs("start", "end", minutes))).withColumn(
        "time", T.local_time("tick"))


def _is_night(second):
    return (second >= C.NIGHT_START_HOUR * 3600) | (second <= C.NIGHT_END_HOUR * 3600)


def _night_ticks(tz: str = C.LOCAL_TZ):
    """Night ticks of a stay. The zone offset is looked up at both ends; only a stay across a clock
    change looks it up tick by tick."""
    def offset(epoch):
        return F.unix_timestamp(T.local_time(epoch, tz)) - epoch

    ticks, first, last = T.tick_epochs("start", "end"), F.col("_first_offset"), F.col("_last_offset")
    steady = F.size(F.filter(ticks, lambda t: _is_night(F.pmod(t + first, F.lit(86400)))))
    changing = F.size(F.filter(ticks, lambda t: _is_night(F.pmod(t + offset(t), F.lit(86400)))))
    return (
        {"_first_offset": offset(F.col("start")), "_last_offset": offset(F.col("end"))},
        F.when(first == last, steady).otherwise(changing),
    )


def home_places(stays: DataFrame) -> DataFrame:
    """Home of each device: the place with most night ticks, or most ticks when it has no night.

    Ties go to the smallest place. Ticks are counted inside each stay's array, so no row per tick
    is made.
    """
    offsets, night = _night_ticks()
    counted = stays.select("device_aid", "loc", "start", "end").withColumns(offsets).select(
        "device_aid", "loc", night.alias("_night"), F.size(T.tick_epochs("start", "end")).alias("_all"))
    per_place = counted.groupBy("device_aid", "loc").agg(F.sum("_night").alias("_night"), F.sum("_all").alias("_all"))
    return per_place.groupBy("device_aid").agg(
        F.max_by("loc", F.struct(F.col("_night"), -F.col("loc"))).alias("_by_night"),
        F.max_by("loc", F.struct(F.col("_all"), -F.col("loc"))).alias("_by_all"),
        F.max("_night").alias("_nights"),
    ).select("device_aid", F.when(F.col("_nights") > 0, F.col("_by_night")).otherwise(F.col("_by_all")).alias("loc"))


def mark_home(stays: DataFrame, homes: DataFrame) -> DataFrame:
    """Add the ``home`` flag (0/1): a stay at the device's home place."""
    marks = homes.select("device_aid", F.col("loc").alias("_home_loc"))
    return stays.join(marks, "device_aid", "left").withColumn(
        "home", F.coalesce((F.col("loc") == F.col("_home_loc")).cast("int"), F.lit(0))).drop("_home_loc")


def home_days(stays: DataFrame, date: str = "date") -> DataFrame:
    """Distinct days each device was at home."""
    return stays.filter("home = 1").groupBy("device_aid").agg(F.countDistinct(date).alias("h_count"))


def with_home_support(stays: DataFrame, min_days: int = C.MIN_HOME_DAYS) -> DataFrame:
    """Stays of devices seen at home on enough (UTC) days."""
    return stays.join(home_days(stays).filter(F.col("h_count") >= min_days), "device_aid", "left_semi")


def enrich_stays(stays: DataFrame) -> DataFrame:
    """Add hour, year, weekday, week, local date and the device sequence number."""
    parts = T.calendar_parts("localtime")
    out = stays.withColumns({
        "h_s": parts["hour"], "year": parts["year"], "weekday": parts["weekday"], "week": parts["week"],
        "date": parts["date"]})
    return with_sequence(out, ["device_aid"], "start", ["end", "loc"])


def home_table(stays: DataFrame) -> DataFrame:
    """One home per device, its coordinates and the number of local days spent there."""
    at_home = stays.filter("home = 1")
    first = F.struct(F.col("start"), F.col("end"), F.col("loc"))
    return at_home.groupBy("device_aid").agg(
        F.min_by("loc", first).alias("loc"), F.min_by("latitude", first).alias("latitude"),
        F.min_by("longitude", first).alias("longitude"),
        F.countDistinct(F.to_date("localtime")).alias("count"))
