"""Edge cases and brute-force checks of stay, home and work detection."""

from __future__ import annotations

import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from stayweave.operators import homes, ordered, stays, work

PINGS = "device_aid string, timestamp bigint, latitude double, longitude double"


def pings(spark, rows):
    return spark.createDataFrame(rows, PINGS)


def test_gaps_at_the_limit(spark):
    rows = [("a", 0, 59.0, 18.0), ("a", 10799, 59.0, 18.0), ("a", 21599, 59.0, 18.0), ("a", 21599, 59.0, 18.1)]
    got = sorted(r["timestamp"] for r in stays.fill_gaps(pings(spark, rows)).collect())
    # 10,799 s adds nothing; 10,800 s adds a copy at +10,799; an equal time drops the earlier ping.
    assert got == [0, 10799, 21598, 21599]


def test_cleaning_drops_bad_and_repeated_pings(spark):
    rows = [("a", 1, 59.0, 18.0), ("a", 1, 59.0, 18.0), ("a", 2, 85.0, 18.0), ("a", 3, -81.0, 18.0),
            ("a", 4, 59.0, 181.0), ("a", 5, None, 18.0), ("b", 6, 90.0, 18.0), ("a", 7, 84.0, 180.0), ("a", 8, -80.0, 0.0)]
    assert sorted(r["timestamp"] for r in stays.clean_pings(pings(spark, rows)).collect()) == [1, 7, 8]


def test_neighbours_and_sums_equal_plain_windows(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("aab"), rnd.randrange(40), rnd.randrange(5), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t bigint, v int, i int")
    got = ordered.with_neighbours(df, ["k"], "t", ["i"], prev={"p": "v"}, following={"n": "v"}, slice_seconds=7)
    got = ordered.with_running_sum(got, ["k"], "t", ["i"], F.col("v"), "s", slice_seconds=3)
    want = {}
    for key in "ab":
        part, total = sorted((t, i, v) for k, t, v, i in rows if k == key), 0
        for pos, (_, i, v) in enumerate(part):
            total += v
            want[i] = (part[pos - 1][2] if pos else None, part[pos + 1][2] if pos + 1 < len(part) else None, total)
    assert {r["i"]: (r["p"], r["n"], r["s"]) for r in got.collect()} == want


def plain_runs(rows, radius, gap):
    """Direct reading of the rule: one pass per device with the whole run in memory."""
    out, run, members, last = {}, 0, [], None
    for device, ts, lat, lon in sorted(rows):
        mid = (median(m[0] for m in members), median(m[1] for m in members)) if members else None
        far = mid is None or stays._metres(*mid, lat, lon) >= radius
        if last is None or last[0] != device or ts - last[1] > gap or far:
            run, members = run + 1, []
        members.append((lat, lon))
        last = (device, ts)
        out[(device, ts, lat, lon)] = run
    return out


def test_runs_equal_one_pass_in_memory(spark):
    rnd = random.Random(5)
    rows, lat, lon, ts = [], 59.3, 18.0, 0
    for _ in range(600):
        ts += rnd.choice([60, 300, 900, 12000])
        if rnd.random() < 0.1:
            lat += rnd.uniform(-0.002, 0.002)
        rows.append((rnd.choice("ab"), ts, lat + rnd.gauss(0, 0.00012), lon + rnd.gauss(0, 0.0002)))
    got = stays.label_runs(pings(spark, rows)).collect()
    want = plain_runs(rows, 30, 10800)
    groups = {}
    for r in got:
        groups.setdefault((r["device_aid"], r["stretch"], r["run"]), set()).add(
            want[(r["device_aid"], r["timestamp"], r["latitude"], r["longitude"])])
    assert len(got) == len(rows)
    assert all(len(v) == 1 for v in groups.values())
    assert len(groups) == len(set(want.values()))


def test_running_median_matches_the_definition():
    rnd = random.Random(1)
    values = [rnd.random() for _ in range(200)]
    middle = stays._RunningMedian(values[0])
    for i, v in enumerate(values[1:], start=2):
        middle.push(v)
        assert math.isclose(middle.get(), median(values[:i]))


def test_places_chain_and_are_numbered_by_arrival(spark):
    # Two stays 20 m apart and one 40 m from the first chain into one place; a far one is another.
    def stay(start, lat):
        return [("a", start + 300 * k, lat, 18.0) for k in range(5)]
    step = 20 / 111_195
    rows = stay(0, 59.0) + stay(20_000, 59.1) + stay(40_000, 59.0 + step) + stay(60_000, 59.0 + 2 * step)
    got = stays.detect_stays(pings(spark, rows)).filter("end - start >= 900").orderBy("start").collect()
    # The last two visits are bridged by the copy of a ping before the gap limit.
    assert [(r["loc"], r["start"], r["end"]) for r in got] == [(1, 0, 11999), (2, 20_000, 31_999), (1, 40_000, 61_200)]


def test_stay_length_bounds(spark):
    rows = [(m, 0, m * 60, 59.3, 18.0) for m in (14, 15, 719, 720)]
    df = spark.createDataFrame(rows, "loc int, start bigint, end bigint, latitude double, longitude double")
    assert sorted(r["loc"] for r in homes.load_stays(df).collect()) == [15, 719]


STAYS = "device_aid string, loc bigint, start bigint, end bigint"


def test_home_ties_fallback_and_night_edges(spark):
    hour = 3600
    rows = [
        ("tie", 7, 22 * hour, 23 * hour), ("tie", 3, 46 * hour, 47 * hour),  # local 23-24 twice: smaller place
        ("day", 5, 9 * hour, 10 * hour), ("day", 6, 12 * hour, 14 * hour),   # no night: most ticks
        ("edge", 1, 6 * hour, 6 * hour + 60), ("edge", 2, 6 * hour + 900, 9 * hour),  # 07:00 is still night
    ]
    got = {r["device_aid"]: r["loc"] for r in homes.home_places(spark.createDataFrame(rows, STAYS)).collect()}
    assert got == {"tie": 3, "day": 6, "edge": 1}


def test_work_place_and_labels(spark):
    day, hour, rows = 86400, 3600, []
    first = 4 * day  # Monday 1970-01-05
    for d in range(26):
        t = first + d * day
        rows.append(("a", 1, t + 20 * hour, t + 30 * hour))
        if d % 7 < 5:
            rows.append(("a", 2, t + 8 * hour, t + 16 * hour))
    df = spark.createDataFrame(rows, STAYS)
    from stayweave.constants import WORK_PARAMS
    labelled = work.label_stays(df, **WORK_PARAMS["batch"])
    kinds = {(r["loc"], r["location_type"]) for r in labelled.collect()}
    assert (1, "H") in kinds and (2, "W") in kinds and (2, "H") not in kinds
    best = work.workplaces(labelled).collect()
    assert len(best) == 1 and best[0]["workplace_loc"] == 2 and best[0]["workplace_count"] >= 15


def drifting(n, metres, seed=None):
    """One device that never pauses: even steps, or random ones around a few spots."""
    rnd, rows, lat, lon = random.Random(seed), [], 59.0, 18.0
    for k in range(n):
        rows.append(("a" if seed is None or rnd.random() < 0.9 else "b", 60 * k, lat, lon))
        lat += metres / 111195 if seed is None else rnd.choice([0, 0, 0, 1, -1]) * metres / 111195
        lon += 0 if seed is None else rnd.choice([0, 0, 0, 0, 1, -1]) * metres / 57000
    return rows


@pytest.mark.parametrize("rows, chunk", [(drifting(70, 9), 11), (drifting(400, 12, 1), 60), (drifting(300, 20, 2), 11)])
def test_chunks_of_a_long_stretch_equal_the_plain_walk(spark, rows, chunk):
    rows = list({(d, t): (d, t, la, lo) for d, t, la, lo in rows}.values())
    got = stays.label_runs(pings(spark, rows).repartition(3), radius_m=30, max_gap_hours=3, chunk=chunk).collect()
    want = plain_runs(rows, 30, 3 * 3600)
    assert len(got) == len(rows)
    # numbers count within a stretch here: the same pings must share a run
    groups = lambda of: {frozenset(k for k, g in of.items() if g == x) for x in set(of.values())}
    assert groups({(r.device_aid, r.timestamp, r.latitude, r.longitude): (r.device_aid, r.stretch, r.run) for r in got}) == groups(want)


def test_slices_are_shuffled_once(spark):
    pings = spark.createDataFrame([("a", 1000 * i, 59.0, 18.0 + i % 3) for i in range(500)], "device_aid string, timestamp bigint, latitude double, longitude double")
    steps = stays._with_steps(stays.fill_gaps(pings))
    assert len(steps.collect()) >= 500
    plan = steps._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    # the slices of either step have two readers: those ordered in them, and their edges
    assert final.count("ReusedExchange") >= 2 and final.count("REPARTITION_BY_COL") >= 2


def test_pings_of_still_stretches_are_not_joined_with_their_boxes(spark, monkeypatch):
    written, plain = [], stays.cut_lineage

    def kept(df):
        written.append(plain(df))
        return written[-1]

    monkeypatch.setattr(stays, "cut_lineage", kept)
    # twenty still stretches, then one that drifts beyond the radius by short steps
    rows = [("a", 20_000 * k + 300 * i, 59.0 + k * 0.01, 18.0) for k in range(20) for i in range(4)]
    rows += [("a", 500_000 + 300 * i, 60.0 + 0.0001 * i, 18.0) for i in range(8)]
    got = stays.label_runs(pings(spark, rows), radius_m=30)
    assert [df.count() for df in written] == [len(rows), 1]
    assert got.count() == len(rows)
    want = plain_runs(rows, 30, 10800)
    groups = {(r["stretch"], r["run"], want[(r["device_aid"], r["timestamp"], r["latitude"], r["longitude"])]) for r in got.collect()}
    assert len(groups) == len({g[:2] for g in groups}) == len(set(want.values())) > 21


def test_the_sweep_orders_lone_runs_once(spark, monkeypatch):
    swept, plain = [], stays.with_running_sum

    def kept(df, keys, *args, **kwargs):
        swept.append(df.count() if "max_gap" in keys else 0)
        return plain(df, keys, *args, **kwargs)

    monkeypatch.setattr(stays, "with_running_sum", kept)
    rnd = random.Random(2)
    # places far apart; at some of them the device falls silent for half an hour to seven hours
    rows, ts, silent = [], 0, 0
    for place in range(40):
        for part in range(1 + (place % 8 == 0)):
            ts += rnd.choice([1900, 9000, 12000, 25000]) if part else rnd.choice([600, 90_000])
            silent += part
            for _ in range(6):
                rows.append(("ab"[place // 20], ts, 59 + place * 0.01, 18.0))
                ts += 300
    got = {r["max_gap"]: r for r in stays.gap_sweep(pings(spark, rows), hours=range(1, 5)).collect()}
    for hours in range(1, 5):
        found, last = [], None
        for device, t, lat, _ in rows:
            if last is None or last[0] != device or t - last[1] > hours * 3600 or lat != last[2]:
                found.append([t, t])
            found[-1][1], last = t, (device, t, lat)
        minutes = [(b - a) / 60 for a, b in found if b - a >= 900]
        r = got[hours]
        assert (r["dur_min"], r["dur_max"], r["dur_med"]) == (min(minutes), max(minutes), median(minutes))
    # a run per part of a place, and every run of a place with two parts that a gap of four hours joins
    assert 0 < sum(swept) <= 4 * 2 * silent
