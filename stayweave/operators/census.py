"""Census squares: duplicate merging, overlay attributes and area-weighted building values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INCOME = ["Kvartil1", "Kvartil2", "Kvartil3", "Kvartil4"]
INCOME_NAMES = {"Rutstorl": "grid_size", "Kvartil1": "Q1", "Kvartil2": "Q2", "Kvartil3": "Q3", "Kvartil4": "Q4"}
BIRTH = ["Sverige", "Norden_uto", "EU_utom_No", "Ovriga_var"]
BIRTH_NAMES = {"Rutstorl": "grid_size", "Sverige": "sweden", "Norden_uto": "nordic", "EU_utom_No": "eu",
               "Ovriga_var": "other"}
BOX = ["x_min", "y_min", "x_max", "y_max"]
BIG_SQUARE = 1000


def duplicated_squares(squares: DataFrame) -> DataFrame:
    """Square ids listed more than once."""
    return squares.groupBy("Ruta").agg(F.count("*").alias("n")).filter("n > 1").select("Ruta")


def single_squares(squares: DataFrame) -> DataFrame:
    """Squares listed exactly once."""
    return squares.join(duplicated_squares(squares), "Ruta", "left_anti")


def _merge(squares: DataFrame, sums: list[str], extra: dict) -> DataFrame:
    """One row per id: a repeated square takes the outline of its big entry and the summed counts;
    without a big entry it is dropped."""
    outline = F.struct("Rutstorl", *BOX)
    merged = squares.groupBy("Ruta").agg(
        F.count("*").alias("_n"), F.max(outline).alias("_own"),
        F.max(F.when(F.col("Rutstorl") == BIG_SQUARE, outline)).alias("_big"),
        *[F.sum(c).alias(c) for c in sums], *[e.alias(n) for n, e in extra.items()])
    return merged.withColumn("_o", F.when(F.col("_n") == 1, F.col("_own")).otherwise(F.col("_big"))).filter(
        "_o is not null").select("Ruta", "_o.*", *sums, *extra)


def merge_income_squares(squares: DataFrame) -> DataFrame:
    """Merge repeated income squares; median income is weighted by the counted people.

    Squares without a positive median are dropped.
    """
    counted = squares.withColumn("Totalt_i", sum((F.col(c) for c in INCOME), F.lit(0)))
    weighted = F.when(F.count("*") == 1, F.max("MedianInk")).otherwise(
        F.try_divide(F.sum(F.col("Totalt_i") * F.col("MedianInk")), F.sum("Totalt_i")))
    return _merge(counted, [*INCOME, "Totalt_i", "Totalt"], {"MedianInk": weighted}).filter("MedianInk > 0")


def merge_birth_squares(squares: DataFrame) -> DataFrame:
    """Merge repeated birth-background squares by summing the counts."""
    return _merge(squares, BIRTH, {})


def with_square_values(pieces: DataFrame, squares: DataFrame, names: dict[str, str]) -> DataFrame:
    """Attach renamed square attributes to overlay pieces."""
    return pieces.join(squares.select("Ruta", *names), "Ruta", "left").withColumnsRenamed(names)


def area_weighted(pieces: DataFrame, values: list[str]) -> DataFrame:
    """Area-weighted mean of each value per building, rounded up (float noise is cut first)."""
    return pieces.groupBy("id").agg(*[
        F.ceil(F.round(F.try_divide(F.sum(F.col(v) * F.col("area")), F.sum("area")), 9)).alias(v) for v in values])


def building_table(birth: DataFrame, income: DataFrame) -> DataFrame:
    """Buildings with both backgrounds known (outer join without gaps = inner join)."""
    return birth.join(income, "id").na.drop().withColumnRenamed("id", "b_id")
