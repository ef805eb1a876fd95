"""Visit weights with the effect of distance taken out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayweave.functions import geo
from stayweave.operators.filters import first_per_key, quantile_trim
from stayweave.operators.quantiles import exact_medians
from stayweave.session import cut_lineage


def with_device_zone(stops: DataFrame, zones: DataFrame, prefix: str, length: int = 4) -> DataFrame:
    """Stops of devices whose home zone starts with ``prefix``, with the shortened code ``deso_r``."""
    return stops.join(zones.select("device_aid", "deso"), "device_aid", "left").filter(
        F.col("deso").startswith(prefix)).withColumn("deso_r", F.substring("deso", 1, length))


def devices_per_zone(stops: DataFrame) -> DataFrame:
    """Distinct devices of each shortened zone."""
    return stops.groupBy("deso_r").agg(F.countDistinct("device_aid").alias("devices"))


def visit_frequency(stops: DataFrame) -> DataFrame:
    """Visits of each device to each place away from home; the cell belongs to the place."""
    return stops.filter("home = 0").groupBy("device_aid", "latitude", "longitude").agg(
        F.count("*").alias("freq"), F.min("h3_id").alias("h3_id"))


def home_points(stops: DataFrame) -> DataFrame:
    """First home point of each device."""
    at_home = stops.filter("home = 1").select("device_aid", "latitude", "longitude")
    return first_per_key(at_home, ["device_aid"], ["latitude", "longitude"])


def distance_from_home(frequency: DataFrame, homes: DataFrame) -> DataFrame:
    """Visits of devices with a known home, with the distance in kilometres."""
    renamed = homes.select(
        "device_aid", F.col("latitude").alias("latitude_home"), F.col("longitude").alias("longitude_home"))
    return frequency.join(renamed, "device_aid").withColumn(
        "d2home", geo.haversine_km("longitude", "latitude", "longitude_home", "latitude_home"))


def zone_cell_visits(visits: DataFrame, device_zones: DataFrame) -> DataFrame:
    """Median distance and total visits of each (zone, cell).

    The zoned visits are written once: medians read their rows several times, which would derive them anew each time.
    """
    zoned = cut_lineage(visits.join(device_zones.select("device_aid", "deso_r").distinct(), "device_aid").select(
        "deso_r", "h3_id", "freq", "d2home").filter("deso_r is not null and h3_id is not null"))
    cells = exact_medians(zoned, ["deso_r", "h3_id"], {"d2home": "d2home"}, [F.sum("freq").alias("freq")])
    return cells.filter("d2home is not null").select("deso_r", "h3_id", "freq", "d2home")


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, c, d, value = 1e-300, 1.0, 0.0, 1.0
    for i in range(0, 400):
        m = i // 2
        if i == 0:
            numerator = 1.0
        elif i % 2 == 0:
            numerator = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            numerator = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + numerator * d or tiny)
        c = 1 + numerator / c or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (value - 1)


@F.pandas_udf(T.DoubleType())
def t_test_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation ``r`` over ``n`` pairs; for summary rows."""
    out = []
    for value, count in zip(r, n):
        df = count - 2
        if df <= 0 or np.isnan(value):
            out.append(np.nan)
        else:
            out.append(_incomplete_beta(df / 2, 0.5, max(0.0, 1 - value * value)))
    return pd.Series(out)


def distance_decay(visits: DataFrame) -> DataFrame:
    """Exponent ``eta`` of each zone: minus the log-log slope of visits on distance, and its p-value.

    Rows at distance zero are left out.
    """
    logs = visits.filter("d2home > 0").select(
        "deso_r", F.log("d2home").alias("log_r"), F.log(F.col("freq").cast("double")).alias("log_f"))
    fitted = logs.groupBy("deso_r").agg(
        (-F.regr_slope("log_f", "log_r")).alias("eta"), F.corr("log_f", "log_r").alias("_r"),
        F.count("*").alias("n"))
    return fitted.withColumn("eta_p", F.when(F.col("_r").isNotNull(), t_test_p("_r", "n"))).select(
        "deso_r", "eta", "eta_p", "n")


def corrected_weights(visits: DataFrame, device_zones: DataFrame, eta: DataFrame) -> DataFrame:
    """Weight of each (device, cell): total visits times the median distance to the power eta.

    The weight is NULL for a device without a zone.
    """
    exponents = device_zones.select("device_aid", "deso_r").distinct().join(eta, "deso_r").select("device_aid", "eta")
    cells = exact_medians(visits, ["device_aid", "h3_id"], {"d2home": "d2home"}, [F.sum("freq").alias("freq")])
    return cells.join(exponents, "device_aid", "left").withColumn(
        "freq_w", F.col("freq") * F.pow("d2home", "eta")).select("device_aid", "h3_id", "freq_w")


def integer_weights(weights: DataFrame) -> DataFrame:
    """Drop extreme weights and round the rest up."""
    return quantile_trim(weights, "freq_w").withColumn("freq_wi", F.ceil("freq_w").cast("int"))
