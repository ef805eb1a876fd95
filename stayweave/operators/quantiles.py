"""Exact quantiles of groups of any size, by selecting ranks through bucket histograms.

Groups are counted first. A group of up to ``SMALL`` rows takes the built-in exact percentile, which holds no more than
those. In a larger one, each wanted rank is an interval of values and a rank inside it. Rows are counted per bucket of
that interval, map-side first; the bucket that holds the rank, with its own smallest and largest value, is the next
interval, until it has one value or few rows. Buckets are equal parts of the octaves an interval spans, then of its values,
so some eight rounds part any two doubles, and no task holds more than a group's buckets or a small interval's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayweave.session import broadcast_if_small, cut_lineage, released

#: Rows of a group, or of an interval, that one task may order. Buckets of an interval in one round.
SMALL, BUCKETS = 10_000, 1024


def _octave(value: Column) -> Column:
    """Signed binary logarithm, from 0 on for either sign; it never falls as the value rises."""
    # no double but zero has a magnitude below 2 ** -1074
    size = F.when(F.abs(value) == float("inf"), 2200.0).otherwise(F.log2(F.abs(value)) + 1075.0)
    return F.when(value == 0, 0.0).otherwise(F.signum(value) * size)


def _bucket(buckets: int) -> Column:
    """Bucket of ``_v`` in ``[_lo, _hi]``: equal parts of the octaves while there are several, then of the values."""
    part = lambda f: (f(F.col("_v")) - f(F.col("_lo"))) / (f(F.col("_hi")) - f(F.col("_lo"))) * buckets
    several = _octave(F.col("_hi")) - _octave(F.col("_lo")) > 1
    return F.floor(F.when(several, part(_octave)).otherwise(part(lambda v: v)))


def _selected(rows: DataFrame, targets: DataFrame, group: list[str], small: int, buckets: int) -> DataFrame:
    """``group, _name, _low, _high``: values at the two ranks around each quantile, for groups too large for one task.

    ``targets`` has an interval ``_lo, _hi`` of ``_n`` rows and a ``_rank`` inside it, for each group and ``_name``.
    """
    key = [*group, "_name", "_side"]
    wanted, settled, last = targets.count(), [], None
    while True:
        few = (F.col("_lo") == F.col("_hi")) | (F.col("_n") <= small)
        settled.append(cut_lineage(targets.filter(few)))
        wanted -= settled[-1].count()
        if not wanted:
            break
        open_ = broadcast_if_small(cut_lineage(targets.filter(~few)))
        inside = rows.join(open_, group).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counted = inside.withColumn("_bucket", _bucket(buckets)).groupBy(*key, "_rank", "_bucket").agg(
            F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
        before = F.sum("_n").over(W.partitionBy(*key).orderBy("_bucket")) - F.col("_n")  # a row per bucket
        held = counted.withColumn("_before", before).filter(
            (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        targets = cut_lineage(held.select(*key, (F.col("_rank") - F.col("_before")).alias("_rank"), "_lo", "_hi", "_n"))
        if last is not None:
            released(last)
        if targets.count() != wanted:
            raise RuntimeError("a rank lies in none of its buckets: the values change from one reading to the next")
        last = targets
    found = settled[0]
    for part in settled[1:]:
        found = found.unionByName(part)
    single, several = F.col("_lo") == F.col("_hi"), broadcast_if_small(found.filter("_lo < _hi"))
    ordered = rows.join(several, group).filter(F.col("_v").between(F.col("_lo"), F.col("_hi"))).groupBy(*key, "_rank").agg(
        F.array_sort(F.collect_list("_v")).alias("_all"))  # at most ``small`` rows
    values = found.filter(single).select(*key, F.col("_lo").alias("_at")).unionByName(
        ordered.select(*key, F.get("_all", F.col("_rank").cast("int")).alias("_at")))
    return values.groupBy(*group, "_name").agg(
        F.max(F.when(F.col("_side") == 0, F.col("_at"))).alias("_low"), F.max(F.when(F.col("_side") == 1, F.col("_at"))).alias("_high"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], small: int = SMALL,
                    buckets: int = BUCKETS) -> DataFrame:
    """One row per key with the linearly interpolated quantiles named in ``probs``.

    NULL values are ignored; a key with only NULLs has no row. Keys may be NULL. Without keys the result is one row, or
    none for no values. NaN counts as larger than any number in a small group and is refused in a large one.
    """
    group = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    names = [F.struct(F.col(k).alias("k")).alias(g) for k, g in zip(keys, group)] or [F.struct(F.lit(1).alias("k")).alias("_k0")]
    rows = df.filter(F.col(value).isNotNull()).select(*names, F.col(value).cast("double").alias("_v"))
    sizes = cut_lineage(rows.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    large = F.col("_n") > small
    out = [F.col(f"{g}.k").alias(k) for k, g in zip(keys, group)] + list(probs)
    few = lambda part: part.groupBy(*group).agg(*[F.percentile("_v", float(p)).alias(name) for name, p in probs.items()])
    bigs = sizes.filter(large)
    if bigs.limit(1).count() == 0:
        return few(rows).select(*out)
    bigs = broadcast_if_small(bigs)
    if bigs.filter(F.isnan("_hi")).limit(1).count():
        raise ValueError("NaN among the values of a large group")
    chosen = cut_lineage(rows.join(bigs.select(*group), group))
    targets = bigs.select(*group, "_n", "_lo", "_hi", F.explode(F.array(*[
        F.struct(F.lit(name).alias("_name"), F.lit(side).alias("_side"),
                 (F.floor if side == 0 else F.ceil)(F.lit(float(p)) * (F.col("_n") - 1)).cast("bigint").alias("_rank"))
        for name, p in probs.items() for side in (0, 1)])).alias("_t")).select(*group, "_t.*", "_n", "_lo", "_hi")
    picked = _selected(chosen, cut_lineage(targets), group, small, buckets).join(sizes.select(*group, "_n"), group)
    share = F.create_map(*[F.lit(x) for name, p in probs.items() for x in (name, float(p))])[F.col("_name")] * (F.col("_n") - 1)
    between = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(
        F.col("_low") + (F.col("_high") - F.col("_low")) * (share - F.floor(share)))
    wide = picked.withColumn("_q", between).groupBy(*group).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in probs])
    rest = few(rows.join(bigs.select(*group), group, "left_anti"))
    return rest.unionByName(wide).select(*out)


def exact_median(df: DataFrame, keys: list[str], value: str, name: str, small: int = SMALL) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5}, small)


def exact_medians(df: DataFrame, keys: list[str], values: dict[str, str], others: list[Column], small: int = SMALL) -> DataFrame:
    """Per key: aggregates ``others`` and the medians ``values`` (new name to column).

    Keys of up to ``small`` rows take the built-in median with all else in one aggregate; the rest are selected by rank.
    """
    sizes = cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > small).select(*keys))
    built_in = lambda part: part.groupBy(*keys).agg(*others, *[F.median(c).alias(n) for n, c in values.items()])
    if sizes.limit(1).count() == 0:
        return built_in(df)
    marked = broadcast_if_small(sizes)
    big = cut_lineage(df.join(marked, keys))
    out = big.groupBy(*keys).agg(*others)
    for name, column in values.items():
        out = out.join(exact_median(big, keys, column, name, small), keys, "left")
    rest = built_in(df.join(marked, keys, "left_anti"))
    return rest.unionByName(out.select(*rest.columns))
