"""Pings to stays: cleaning, gap filling, stationary runs, places, intervals, collapse."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayweave import constants as C
from stayweave.functions import geo
from stayweave.functions.time import utc_date
from stayweave.operators.components import radius_components
from stayweave.operators.ordered import sliced, with_neighbours, with_running_sum
from stayweave.operators.quantiles import exact_medians, exact_quantiles
from stayweave.session import broadcast_or_shuffle, cut_lineage

DEVICE, TS, LAT, LON = "device_aid", "timestamp", "latitude", "longitude"
PING = [DEVICE, TS, LAT, LON]
TIES = [LAT, LON]
#: Pings of a stretch that one task walks in order; longer stretches are cut into chunks of so many.
CHUNK = 200_000


def clean_pings(pings: DataFrame) -> DataFrame:
    """Drop NULLs, coordinates out of range and exact repeats of a device's (time, place)."""
    return (
        pings.select(DEVICE, F.col(TS).cast("bigint").alias(TS), LAT, LON)
        .na.drop().filter(geo.valid_coordinate(LAT, LON)).dropDuplicates(PING)
    )


def fill_gaps(pings: DataFrame, max_gap_hours: int = C.MAX_GAP_HOURS) -> DataFrame:
    """Add a copy of a ping one second before the gap limit when the next ping is later than that.

    A ping with a successor at the same second is dropped; the last ping of a device stays.
    """
    limit = max_gap_hours * 3600
    nearest = with_neighbours(pings, [DEVICE], TS, TIES, following={"next_ts": TS})
    until = F.least(F.coalesce("next_ts", F.col(TS) + 1), F.col(TS) + limit)
    ticks = F.filter(F.array(F.col(TS), F.col(TS) + limit - 1), lambda t: t < until)
    return nearest.select(DEVICE, F.explode(ticks).alias(TS), LAT, LON)


def displacement(pings: DataFrame) -> DataFrame:
    """Time, UTM offset and Euclidean distance from the previous ping of the device."""
    moved = with_neighbours(
        geo.with_utm_xy(pings), [DEVICE], TS, TIES, prev={"px": "x", "py": "y", "pt": TS})
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    return moved.filter("pt is not null").select(
        DEVICE, TS, (F.col(TS) - F.col("pt")).alias("tDelta"), dx.alias("xDelta"), dy.alias("yDelta"),
        F.sqrt(dx * dx + dy * dy).alias("displacement"))


def _with_steps(pings: DataFrame) -> DataFrame:
    """Add seconds and metres since the previous ping of the device; the rows stay sliced."""
    moved = with_neighbours(sliced(pings, [DEVICE], TS), [DEVICE], TS, TIES, prev={"_pt": TS, "_plat": LAT, "_plon": LON})
    return moved.withColumns({
        "gap_s": F.col(TS) - F.col("_pt"),
        "step_m": geo.haversine_km("_plon", "_plat", LON, LAT) * 1000,
    }).drop("_pt", "_plat", "_plon")


def _long_enough(runs: DataFrame) -> DataFrame:
    return runs.filter((F.col("end") - F.col("start") >= C.MIN_STAY_MINUTES * 60) & (F.col("size") >= C.MIN_STAY_POINTS))


def step_runs(pings: DataFrame, radius_m: float = C.STAY_RADIUS_M, max_gap_hours: int = C.MAX_GAP_HOURS) -> DataFrame:
    """Stays as stretches whose every step is short in time and space; built-in functions only."""
    cut = F.col("gap_s").isNull() | (F.col("gap_s") > max_gap_hours * 3600) | (F.col("step_m") > radius_m)
    runs = with_running_sum(_with_steps(pings), [DEVICE], TS, TIES, F.when(cut, 1).otherwise(0), "run")
    runs = cut_lineage(runs.select(DEVICE, "run", TS, LAT, LON))
    return _long_enough(exact_medians(runs, [DEVICE, "run"], {LAT: LAT, LON: LON}, [
        F.min(TS).alias("start"), F.max(TS).alias("end"), F.count("*").alias("size")]))


class _RunningMedian:
    """Median of a growing set: the lower half and the upper half as two heaps."""

    def __init__(self, first: float):
        self.low, self.high = [-first], []

    def push(self, value: float) -> None:
        heapq.heappush(self.high, -heapq.heappushpop(self.low, -value))
        if len(self.high) > len(self.low):
            heapq.heappush(self.low, -heapq.heappop(self.high))

    def get(self) -> float:
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2
    b = math.sin(math.radians(lon2 - lon1) / 2) ** 2
    chord = a + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * b
    return 2000 * geo.EARTH_RADIUS_KM * math.asin(min(1.0, math.sqrt(chord)))


def _number_runs(radius_m: float):
    """Number runs inside each stretch of sorted rows, carrying the open run across batches."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretch, run, walk = None, 0, None
        for batch in batches:
            numbers = []
            for device, part, lat, lon in zip(batch[DEVICE], batch["stretch"], batch[LAT], batch[LON]):
                if (device, part) != stretch:
                    stretch, run, walk = (device, part), 0, _Walk(radius_m)
                run += walk.step(lat, lon)
                numbers.append(run)
            yield batch.assign(run=pd.Series(numbers, index=batch.index, dtype="int64"))

    return work


class _Walk:
    """The open run of a walk through sorted pings: where it began and the medians of its pings so far."""

    def __init__(self, radius_m: float):
        self.radius, self.lat, self.lon = radius_m, None, None

    def step(self, lat: float, lon: float) -> bool:
        """Take the next ping; whether it opens a new run."""
        fresh = self.lat is None or _metres(self.lat.get(), self.lon.get(), lat, lon) >= self.radius
        if fresh:
            self.lat, self.lon = _RunningMedian(lat), _RunningMedian(lon)
        else:
            self.lat.push(lat)
            self.lon.push(lon)
        return fresh


def _guess_starts(radius_m: float):
    """``fresh`` of each ping as if its chunk began a run; rows come sorted by stretch, chunk and position."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, walk = None, None
        for batch in batches:
            marks = []
            for key, lat, lon in zip(zip(batch[DEVICE], batch["stretch"], batch["chunk"]), batch[LAT], batch[LON]):
                if key != at:
                    at, walk = key, _Walk(radius_m)
                marks.append(walk.step(lat, lon))
            yield batch.assign(fresh=pd.Series(marks, index=batch.index, dtype=bool))

    return work


def _walk_into(radius_m: float):
    """Walk from an earlier start into the chunk ``target``. Where a run starts that the guess starts as well, both are in
    the same state and the guess is right from there on."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, walk, met = None, None, False
        for batch in batches:
            marks, meets = [], []
            keys = zip(batch[DEVICE], batch["stretch"], batch["target"])
            for key, chunk, lat, lon, guess in zip(keys, batch["chunk"], batch[LAT], batch[LON], batch["fresh"]):
                if key != at:
                    at, walk, met = key, _Walk(radius_m), False
                fresh = guess if met else walk.step(lat, lon)
                met = met or bool(fresh and guess and chunk == key[2])
                marks.append(fresh)
                meets.append(met)
            out = batch.assign(fresh=pd.Series(marks, index=batch.index, dtype=bool), met=pd.Series(meets, index=batch.index, dtype=bool))
            yield out[out["chunk"] == out["target"]].drop(columns="target")

    return work


def label_long_stretches(rows: DataFrame, radius_m: float, chunk: int) -> DataFrame:
    """Runs of stretches of any length, chunk by chunk: ``rows`` with ``run``.

    Every chunk of ``chunk`` pings is labelled at once from a guessed fresh start. Then every chunk but the first is walked
    again from where the chunk before it, by its guess, opened its last run, until a run starts where the guess starts
    one. If that happens in the chunk before, this walk was right. Where it does not, the last run began elsewhere, and
    only the chunk behind is walked once more from there.
    """
    key = [DEVICE, "stretch"]
    placed = with_running_sum(rows, key, TS, TIES, F.lit(1), "pos").withColumn("chunk", F.floor((F.col("pos") - 1) / chunk))
    schema = f"{DEVICE} string, {TS} bigint, {LAT} double, {LON} double, stretch bigint, chunk bigint, pos bigint, fresh boolean"
    fields = [*PING, "stretch", "chunk", "pos"]
    guessed = cut_lineage(placed.select(*fields).repartition(*key, "chunk").sortWithinPartitions(*key, "chunk", "pos").mapInPandas(
        _guess_starts(radius_m), schema))
    last_start = F.max(F.when(F.col("fresh"), F.col("pos"))).alias("own")
    guesses = cut_lineage(guessed.groupBy(*key, "chunk").agg(last_start))
    before = F.lag("open").over(Window.partitionBy(*key).orderBy("chunk"))  # a row per chunk
    # ``open``: where the run open at the chunk's end began; ``entry``: from where the chunk was walked
    chunks = cut_lineage(guesses.select(*key, "chunk", "own", F.col("own").alias("open"), F.lit(None).cast("bigint").alias("entry")))
    labels = guessed.select(*key, "chunk", "pos", "fresh")
    while True:
        due = cut_lineage(chunks.withColumn("start", before).filter("chunk > 0 and not start <=> entry").select(*key, "chunk", "start"))
        if due.limit(1).count() == 0:
            break
        sources = due.select(*key, F.col("chunk").alias("target"), "start", F.explode(F.sequence(
            F.floor((F.col("start") - 1) / chunk), F.col("chunk"))).alias("chunk"))
        walked = guessed.join(sources, [*key, "chunk"]).filter("pos >= start").select(*fields, "fresh", "target").repartition(
            *key, "target").sortWithinPartitions(*key, "target", "pos").mapInPandas(_walk_into(radius_m), schema + ", met boolean")
        walked = cut_lineage(walked.select(*key, "chunk", "pos", "fresh", "met"))
        ends = walked.groupBy(*key, "chunk").agg(F.max("met").alias("met"), last_start.alias("walked"))
        ends = ends.join(due, [*key, "chunk"])
        # a chunk without any start stays in the run it was entered with
        opened = F.when(F.col("met"), F.col("own")).otherwise(F.coalesce("walked", "start"))
        chunks = cut_lineage(chunks.join(ends, [*key, "chunk"], "left").select(
            *key, "chunk", "own", F.when(F.col("start").isNull(), F.col("open")).otherwise(opened).alias("open"),
            F.coalesce("start", "entry").alias("entry")))
        labels = cut_lineage(labels.join(due.select(*key, "chunk"), [*key, "chunk"], "left_anti").unionByName(walked.drop("met")))
    marked = guessed.drop("fresh").join(labels.drop("chunk"), [*key, "pos"])
    return with_running_sum(marked, key, TS, TIES, F.col("fresh").cast("int"), "run").select(*PING, "stretch", "run")


def label_runs(pings: DataFrame, radius_m: float = C.STAY_RADIUS_M, max_gap_hours: int = C.MAX_GAP_HOURS,
               chunk: int = CHUNK) -> DataFrame:
    """Number stationary runs: a ping joins the open run when it is near the run's median so far.

    A long gap, or a step of twice the radius, always opens a new run, so a device splits into
    stretches that are independent of each other. A stretch whose bounding box has a diagonal
    below the radius is one run whatever the order. The rest are walked in time order as a stream
    of Arrow batches with two medians of state, those longer than ``chunk`` pings chunk by chunk.
    """
    cut = F.col("gap_s").isNull() | (F.col("gap_s") > max_gap_hours * 3600) | (F.col("step_m") >= 2 * radius_m)
    rows = with_running_sum(_with_steps(pings), [DEVICE], TS, TIES, F.when(cut, 1).otherwise(0), "stretch")
    rows = cut_lineage(rows.select(*PING, "stretch"))
    boxes = rows.groupBy(DEVICE, "stretch").agg(
        F.min(LAT).alias("_s"), F.max(LAT).alias("_n"), F.min(LON).alias("_w"), F.max(LON).alias("_e"), F.count("*").alias("_size"))
    # The widest parallel of the box bounds its diagonal from above.
    nearest_equator = F.when(F.col("_s") * F.col("_n") <= 0, 0.0).otherwise(F.least(F.abs("_s"), F.abs("_n")))
    high = F.radians(F.col("_n") - F.col("_s"))
    wide = F.radians(F.col("_e") - F.col("_w")) * F.cos(F.radians(nearest_equator))
    still = F.sqrt(high * high + wide * wide) * (1000 * geo.EARTH_RADIUS_KM) < radius_m * 0.999
    # Only stretches that move meet the rows again; the pings of the others stay where they are.
    moved = cut_lineage(boxes.filter(~still).select(DEVICE, "stretch", "_size"))
    away = broadcast_or_shuffle(moved)
    schema = f"{DEVICE} string, {TS} bigint, {LAT} double, {LON} double, stretch bigint, run bigint"
    out = rows.join(away.select(DEVICE, "stretch"), [DEVICE, "stretch"], "left_anti").select(
        *PING, "stretch", F.lit(1).cast("bigint").alias("run"))
    walked = rows.join(away, [DEVICE, "stretch"])
    moving = (
        walked.filter(F.col("_size") <= chunk).select(*PING, "stretch").repartition(DEVICE, "stretch")
        .sortWithinPartitions(DEVICE, "stretch", TS, *TIES).mapInPandas(_number_runs(radius_m), schema)
    )
    out = out.unionByName(moving)
    if moved.filter(F.col("_size") > chunk).limit(1).count():
        out = out.unionByName(label_long_stretches(walked.filter(F.col("_size") > chunk).select(*PING, "stretch"), radius_m, chunk))
    return out


def label_stops(pings: DataFrame, radius_m: float = C.STAY_RADIUS_M, place_radius_m: float = C.PLACE_RADIUS_M,
                max_gap_hours: int = C.MAX_GAP_HOURS) -> DataFrame:
    """Give every ping a place label ``loc`` (-1 while moving) and the median of its place.

    Runs that last long enough are stops; stops whose medians chain within ``place_radius_m`` are
    one place. Places are numbered per device from 1 by first arrival.
    """
    rows = cut_lineage(label_runs(pings, radius_m, max_gap_hours))
    run_key = [DEVICE, "stretch", "run"]
    stops = _long_enough(exact_medians(rows, run_key, {"mid_lat": LAT, "mid_lon": LON}, [
        F.min(TS).alias("start"), F.max(TS).alias("end"), F.count("*").alias("size")]))
    stops = geo.with_national_xy(stops, "mid_lat", "mid_lon")
    placed = cut_lineage(radius_components(stops, [DEVICE], place_radius_m, name="place").select(
        *run_key, "start", "place"))
    numbered = with_running_sum(
        placed.groupBy(DEVICE, "place").agg(F.min("start").alias("_first")),
        [DEVICE], "_first", ["place"], F.lit(1), "loc", slice_seconds=30 * 86400)
    numbered = placed.join(numbered.select(DEVICE, "place", F.col("loc").cast("int").alias("loc")), [DEVICE, "place"])
    labelled = rows.join(numbered.select(*run_key, "loc"), run_key, "left").select(
        *PING, F.coalesce("loc", F.lit(-1)).alias("loc"))
    middles = place_medians(labelled.filter("loc > 0"))
    return labelled.join(middles, [DEVICE, "loc"], "left").select(*PING, "loc", "stop_latitude", "stop_longitude")


def place_medians(labelled: DataFrame) -> DataFrame:
    """Median coordinates of each (device, place)."""
    return exact_medians(labelled, [DEVICE, "loc"], {"stop_latitude": LAT, "stop_longitude": LON}, [])


def number_intervals(labelled: DataFrame, max_gap_hours: int = C.MAX_GAP_HOURS) -> DataFrame:
    """Number visits per device from 1; moving pings use up numbers and are dropped afterwards."""
    moved = with_neighbours(sliced(labelled, [DEVICE], TS), [DEVICE], TS, TIES, prev={"_ploc": "loc", "_pts": TS})
    same = (F.col("loc") == F.col("_ploc")) & (F.col(TS) - F.col("_pts") < max_gap_hours * 3600)
    change = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return with_running_sum(moved, [DEVICE], TS, TIES, change, "interval").drop("_ploc", "_pts", "_slice").filter("loc > 0")


def collapse_stays(intervals: DataFrame) -> DataFrame:
    """One row per (device, interval): place, first and last second, location, ping count."""
    return intervals.groupBy(DEVICE, "interval").agg(
        F.min("loc").alias("loc"), F.min(TS).alias("start"), F.max(TS).alias("end"),
        F.min("stop_latitude").alias(LAT), F.min("stop_longitude").alias(LON), F.count("loc").alias("size"))


def detect_stays(pings: DataFrame, **limits) -> DataFrame:
    """Raw pings to stays: clean, fill gaps, label, number, collapse."""
    return collapse_stays(number_intervals(label_stops(fill_gaps(clean_pings(pings)), **limits)))


def device_stats(stays: DataFrame) -> DataFrame:
    """Distinct places, active UTC days, records and covered days of each device."""
    return stays.withColumn("_day", utc_date("start")).groupBy(DEVICE).agg(
        F.countDistinct("loc").alias("no_loc"), F.countDistinct("_day").alias("no_active_days"),
        F.count("*").alias("no_rec"),
        F.ceil((F.max("end") - F.min("start")) / 86400 + 1).cast("bigint").alias("total_days"))


def active_devices(stats: DataFrame) -> DataFrame:
    """Devices with enough places, records and days."""
    return stats.filter(
        (F.col("no_loc") > C.DEVICE_PLACES) & (F.col("no_rec") > C.DEVICE_RECORDS)
        & (F.col("no_active_days") > C.DEVICE_DAYS))


def gap_sweep(pings: DataFrame, hours: range = range(1, 13), radius_m: float = C.STAY_RADIUS_M) -> DataFrame:
    """Stay length and sampling rate summaries for each maximum gap.

    Pings are first joined into runs under the shortest gap. The runs of a longer gap are unions of
    those, so only run rows, not pings, are repeated per gap.
    """
    shortest = min(hours) * 3600
    long_step = F.coalesce(F.col("step_m") > radius_m, F.lit(True))
    cut = F.col("gap_s").isNull() | (F.col("gap_s") > shortest) | long_step
    runs = with_running_sum(_with_steps(pings), [DEVICE], TS, TIES, F.when(cut, 1).otherwise(0), "run")
    # A run has one row with a cut, its first.
    runs = runs.groupBy(DEVICE, "run").agg(
        F.min(TS).alias("start"), F.max(TS).alias("end"), F.count("*").alias("size"),
        F.max(F.when(cut, F.col("gap_s"))).alias("gap_s"), F.max(F.when(cut, long_step)).alias("moved"))
    # A run that no gap joins with its neighbours is a stay by itself under every gap; only the others are ordered again.
    hard = F.col("gap_s").isNull() | (F.col("gap_s") > max(hours) * 3600) | F.col("moved")
    runs = with_neighbours(runs.withColumn("_hard", hard), [DEVICE], "start", ["run"], following={"_next": "_hard"})
    runs = cut_lineage(runs.select(DEVICE, "run", "start", "end", "size", "gap_s", "moved", (
        F.col("_hard") & F.coalesce("_next", F.lit(True))).alias("_alone")))
    every = F.explode(F.array(*[F.lit(h) for h in hours])).alias("max_gap")
    apart = F.col("gap_s").isNull() | (F.col("gap_s") > F.col("max_gap") * 3600) | F.col("moved")
    joined = with_running_sum(
        runs.filter("not _alone").select("*", every), [DEVICE, "max_gap"], "start", ["run"], F.when(apart, 1).otherwise(0), "stay",
        slice_seconds=86400)
    stays = joined.groupBy(DEVICE, "max_gap", "stay").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("size").alias("size")).drop(DEVICE, "stay")
    stays = stays.unionByName(runs.filter("_alone").select(every, "start", "end", "size"))
    return stay_summary(_long_enough(stays))


def stay_summary(stays: DataFrame, by: str = "max_gap") -> DataFrame:
    """Range and median of stay minutes and pings per hour, with the shares over their limits."""
    stays = cut_lineage(stays.select(by, ((F.col("end") - F.col("start")) / 60).alias("dur"), "size").withColumn(
        "rate", F.try_divide(F.col("size").cast("double"), F.col("dur") / 60)))
    flat = stays.groupBy(by).agg(
        F.min("dur").alias("dur_min"), F.max("dur").alias("dur_max"),
        F.avg(F.when(F.col("dur") >= F.col(by) * 60, 1.0).otherwise(0.0)).alias("dur_thre"),
        F.min("rate").alias("sfre_min"), F.max("rate").alias("sfre_max"),
        F.avg(F.when(F.col("rate") >= 1, 1.0).otherwise(0.0)).alias("sfre_one"))
    return (
        flat.join(exact_quantiles(stays, [by], "dur", {"dur_med": 0.5}), by)
        .join(exact_quantiles(stays, [by], "rate", {"sfre_med": 0.5}), by, "left")
    )
