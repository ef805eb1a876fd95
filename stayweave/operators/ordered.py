"""Ordered per-key work that stays parallel inside one very busy key.

A plain window over a device puts all rows of that device in one task. Here rows are cut into
time slices, windows run per (key, slice), and only one summary row per slice is ordered over
the whole key. The result equals the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICE_SECONDS = 86400


def sliced(df: DataFrame, keys: list[str], ts: str, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Rows dealt by key and time slice, with ``_slice``. What is summed up per slice and what is ordered in it read this
    one shuffle, and so do further steps over the same keys and times that are given its rows.

    Rows without a key are left out here, and slices are joined from the left: else Spark adds filters to one reader of
    the shuffle alone and runs it twice.
    """
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    return df.filter(F.col(ts).isNotNull()).withColumn("_slice", F.floor(F.col(ts) / F.lit(slice_seconds))).repartition(*keys, "_slice")


def _inside(keys, ts, ties):
    return W.partitionBy(*keys, "_slice").orderBy(ts, *ties)


def _across(keys):
    return W.partitionBy(*keys).orderBy("_slice")


def with_neighbours(df: DataFrame, keys: list[str], ts: str, ties: list[str] = (), prev: dict[str, str] | None = None,
                    following: dict[str, str] | None = None, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Add values of the previous and the next row of each key in (ts, ties) order.

    ``prev`` and ``following`` map new names to source columns. The order must be total and
    the keys not NULL. Rows of ``sliced`` stay sliced.
    """
    here, within, across = _inside(keys, ts, ties), [*keys, "_slice"], _across(keys)
    given = "_slice" in df.columns
    out = rows = df if given else sliced(df, keys, ts, slice_seconds)
    for step, pick, names in ((F.lag, F.max_by, prev or {}), (F.lead, F.min_by, following or {})):
        if not names:
            continue
        # The last row of a slice is what the next slice looks back at, and the other way round.
        wanted = F.struct(*[F.col(c).alias(n) for n, c in names.items()])
        edges = rows.groupBy(*within).agg(pick(wanted, F.struct(ts, *ties)).alias("_row"))
        edges = edges.select(*within, *[step(F.col("_row")[n]).over(across).alias(f"_edge_{n}") for n in names])
        out = out.withColumns({"_at_edge": step(ts).over(here).isNull(), **{
            n: step(c).over(here) for n, c in names.items()}})
        out = out.join(edges.hint("merge"), within, "left").withColumns({
            n: F.when(F.col("_at_edge"), F.col(f"_edge_{n}")).otherwise(F.col(n)) for n in names
        }).drop("_at_edge", *[f"_edge_{n}" for n in names])
    return out if given else out.drop("_slice")


def with_running_sum(df: DataFrame, keys: list[str], ts: str, ties: list[str], value: Column, name: str,
                     slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Add the sum of ``value`` over all rows of the key up to and including this one. Rows of ``sliced`` stay sliced."""
    given = "_slice" in df.columns
    rows = (df if given else sliced(df, keys, ts, slice_seconds)).withColumn("_value", value.cast("bigint"))
    before = _across(keys).rowsBetween(W.unboundedPreceding, -1)
    summary = (
        rows.groupBy(*keys, "_slice").agg(F.sum("_value").alias("_total"))
        .select(*keys, "_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    )
    inside = _inside(keys, ts, ties).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        rows.withColumn("_here", F.sum("_value").over(inside))
        .join(summary.hint("merge"), [*keys, "_slice"], "left")
        .withColumn(name, (F.col("_here") + F.col("_before")).cast("bigint"))
        .drop("_value", "_here", "_before", *["_slice"] * (not given))
    )


def with_sequence(df: DataFrame, keys: list[str], ts: str, ties: list[str] = (), name: str = "seq",
                  slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Number the rows of each key from 1 in (ts, ties) order."""
    return with_running_sum(df, keys, ts, list(ties), F.lit(1), name, slice_seconds)
