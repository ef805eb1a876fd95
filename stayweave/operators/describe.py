"""Counts, shares, tables and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayweave.operators.quantiles import exact_median, exact_quantiles
from stayweave.session import cut_lineage


def crosstab(rows: DataFrame, row: str, column: str, values: list | None = None) -> DataFrame:
    """Counts of ``row`` by ``column``, one output column per value, zero where absent."""
    table = rows.groupBy(row).pivot(column, values) if values else rows.groupBy(row).pivot(column)
    return table.count().na.fill(0)


def crosstab_shares(rows: DataFrame, row: str, column: str) -> DataFrame:
    """Long crosstab with counts and the share within each row."""
    cells = rows.groupBy(row, column).agg(F.count("*").alias("n"))
    totals = cells.groupBy(row).agg(F.sum("n").alias("_total"))
    return cells.join(totals, row).select(row, column, "n", (F.col("n") / F.col("_total")).alias("share"))


def value_shares(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows of each value of each column, in one pass over the rows."""
    cells = rows.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("c")).select("c.*").filter("value is not null")
    counts = cells.groupBy("attribute", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("attribute").agg(F.sum("n").alias("_total"))
    return counts.join(totals, "attribute").select(
        "attribute", "value", "n", (F.col("n") / F.col("_total")).alias("share"))


def group_medians(rows: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Median of each feature per group. Groups are few and large, so the medians are distributed."""
    long = rows.select(group, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features
    ])).alias("c")).select(group, "c.*")
    medians = exact_median(long, [group, "feature"], "value", "median")
    return medians.groupBy(group).pivot("feature", features).agg(F.first("median"))


def cluster_profile(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Mean indices and summed visitors per cluster, rounded, in order of mean ``ice_birth``."""
    return rows.groupBy(cluster).agg(
        F.round(F.avg("ice_birth"), 3).alias("ice_birth"), F.round(F.avg("ice_income"), 3).alias("ice_income"),
        F.sum("n_visitors").alias("n_visitors")).orderBy("ice_birth", cluster)


def summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles and max of each column."""
    long = cut_lineage(rows.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("c")).select("c.*").filter("value is not null"))
    flat = long.groupBy("column").agg(
        F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = exact_quantiles(long, ["column"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return flat.join(quartiles, "column")


def histogram(rows: DataFrame, value: str, points: int, log: bool = False) -> DataFrame:
    """Density over ``points - 1`` bins between the smallest and largest value; empty bins dropped.

    Bins are even, or even in the logarithm (positive values only). The last bin is closed.
    """
    known = rows.select(F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    known = cut_lineage(known.filter("_v > 0") if log else known)
    low, high, n = known.agg(F.min("_v"), F.max("_v"), F.count("*")).first()
    bins = points - 1
    if not n:
        return known.selectExpr("0 AS bin", "0D AS low", "0D AS high", "0L AS n", "0D AS density").filter("false")
    scale = (lambda c: F.log10(c)) if log else (lambda c: c)
    back = (lambda c: F.pow(F.lit(10.0), c)) if log else (lambda c: c)
    start, span = scale(F.lit(low)), scale(F.lit(high)) - scale(F.lit(low))
    position = F.floor(F.try_divide(scale(F.col("_v")) - start, span) * bins)
    counted = known.select(F.coalesce(F.least(position, F.lit(bins - 1)), F.lit(0)).cast("int").alias("bin")).groupBy(
        "bin").agg(F.count("*").alias("n"))
    edges = counted.withColumns({
        "low": back(start + span * F.col("bin") / bins), "high": back(start + span * (F.col("bin") + 1) / bins)})
    return edges.select("bin", "low", "high", "n",
                        F.try_divide(F.col("n"), n * (F.col("high") - F.col("low"))).alias("density"))
