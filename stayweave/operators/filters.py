"""Row selection: allow lists, samples, category and text columns, splits into groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayweave import constants as C
from stayweave.functions import geo
from stayweave.operators.quantiles import exact_quantiles
from stayweave.session import cut_lineage


def keep_listed(rows: DataFrame, allowed: DataFrame, key: str = "device_aid") -> DataFrame:
    """Rows whose key is on the list."""
    return rows.join(allowed.select(key), key, "left_semi")


def residential(buildings: DataFrame) -> DataFrame:
    """Residential buildings with the name of their first source."""
    return buildings.filter("subtype = 'residential'").withColumn("source", F.col("sources")[0]["dataset"])


def poi_categories(pois: DataFrame) -> DataFrame:
    """Flatten ``categories``: primary, alternates (the primary alone when there are none), their
    number and their ``;``-joined text. Places without categories are dropped."""
    known = pois.filter("categories is not null").withColumn("primary", F.col("categories.primary"))
    secondary = F.coalesce(F.col("categories.alternate"), F.array("primary"))
    return known.withColumns({
        "secondary": secondary, "sec_l": F.size(secondary), "sec_cat": F.array_join(secondary, ";")})


def name_kinds(pois: DataFrame, communities: DataFrame, names: DataFrame) -> DataFrame:
    """Category -> community -> name of the kind, by two lookups."""
    return pois.join(communities, "primary", "left").join(names, "community", "left")


def quantile_trim(rows: DataFrame, value: str, low: float = C.TRIM_QUANTILES[0],
                  high: float = C.TRIM_QUANTILES[1]) -> DataFrame:
    """Rows strictly between two quantiles of ``value``; NULLs fall out."""
    rows = cut_lineage(rows)
    limits = exact_quantiles(rows, [], value, {"_low": low, "_high": high}).first()
    return rows.filter((F.col(value) > F.lit(limits["_low"])) & (F.col(value) < F.lit(limits["_high"]))) if limits else rows


def stable_hash(key, seed: int = 0) -> Column:
    """Reproducible number in [0, 2^32) of a key, the same on every engine with MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def distinct_devices(rows: DataFrame, device: str = "device_aid") -> DataFrame:
    """Distinct non-NULL device ids."""
    return rows.select(device).filter(F.col(device).isNotNull()).distinct()


def device_groups(devices: DataFrame, groups: int, seed: int = 0, device: str = "device_aid") -> DataFrame:
    """Reproducible group number 0..groups-1 of each device; new devices do not move old ones."""
    return devices.withColumn("grp", (stable_hash(device, seed) % groups).cast("int"))


def sample_devices(rows: DataFrame, share: float, seed: int = 42, device: str = "device_aid") -> DataFrame:
    """All rows of a reproducible share of the devices; decided per row, without a join."""
    return rows.filter(stable_hash(device, seed) < int(share * 2**32))


def sample_rows(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows with the smallest hash of a unique key."""
    return rows.orderBy(stable_hash(key, seed), key).limit(n)


def first_devices(rows: DataFrame, n: int, device: str = "device_aid") -> DataFrame:
    """Rows of the first ``n`` device ids: a trial run."""
    return keep_listed(rows, distinct_devices(rows, device).orderBy(device).limit(n), device)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows of several batches, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in an explicit order, as one aggregate without a sort."""
    rest = [c for c in rows.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return rows.groupBy(*keys).agg(picked).select(*keys, "_first.*")


def city_stops(stops: DataFrame, box=C.CITY_BOX) -> DataFrame:
    """All stops inside the city box with their time columns."""
    return stops.filter(geo.in_box("latitude", "longitude", box))
