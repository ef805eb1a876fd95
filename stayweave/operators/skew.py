"""Equi-joins that spread a very busy key over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayweave.session import broadcast_if_small, cut_lineage

#: Rows of either side that a task may get of one key.
ROWS_PER_SALT = 500_000


def _shares(rows: str, most: int):
    return F.greatest(F.lit(1), F.ceil(F.coalesce(rows, F.lit(0)) / most)).cast("int")


def busy_keys(left: DataFrame, right: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Keys with more than ``most`` rows on a side that the other side has as well: the rows and columns of their grid."""
    sides = left.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        right.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    both = sides.groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).filter((F.col("_a") > 0) & (F.col("_b") > 0))
    return both.filter((F.col("_a") > most) | (F.col("_b") > most)).select(
        *keys, _shares("_a", most).alias("_r"), _shares("_b", most).alias("_s"))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Inner join in which the rows of busy keys are dealt over a grid of tasks.

    A key with many rows on either side becomes a rectangle: its left rows are dealt by hash to the rows of the grid and
    repeated along its columns, its right rows the other way round, so every pair meets in one field and no field has more
    than about ``rows_per_salt`` rows of a side. Without busy keys this is a plain join.
    """
    busy = cut_lineage(busy_keys(left, right, keys, rows_per_salt))
    if busy.limit(1).count() == 0:
        return left.join(right, keys)
    busy = broadcast_if_small(busy)

    def dealt(side: DataFrame, own: str, own_shares: str, other: str, other_shares: str) -> DataFrame:
        place = F.pmod(F.xxhash64(*side.columns), F.coalesce(own_shares, F.lit(1))).cast("int")
        copies = F.sequence(F.lit(0), F.coalesce(other_shares, F.lit(1)) - 1)
        return side.join(busy, keys, "left").withColumn(own, place).withColumn(other, F.explode(copies)).drop("_r", "_s")

    return dealt(left, "_i", "_r", "_j", "_s").join(dealt(right, "_j", "_s", "_i", "_r"), [*keys, "_i", "_j"]).drop("_i", "_j")
