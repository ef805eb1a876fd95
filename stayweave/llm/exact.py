"""Operator 8, exact dedup: tree merge of sorted digest runs, with DataFrame functions only.

Every input partition is a run of digests. In each round, ``fan`` neighbouring runs exchange their rows and become
one: equal digests merge, the identifier that stays is kept and the sizes add up. A round never holds more than
``fan`` rows of a digest, whatever the size of its group, and the rows of a run stay spread over all tasks by run and
digest. After the last round the result goes back down the same tree, run by run, so no join meets a hot digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayweave.llm.base import stored, text_of

#: A group is told by its SHA-256 digest, verified by length and a second, independent hash.
KEY = ["_digest", "_bytes", "_check"]
#: Runs merged into one per round.
FAN = 8


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row per document: its run (the input partition), row number, id and digest."""
    text = text_of(text_col)
    return docs.select(
        F.spark_partition_id().alias("_run"), F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_digest"),
        F.octet_length(text).alias("_bytes"), F.xxhash64(text).alias("_check"))


def _merged(rows: DataFrame, keep: str, best, size) -> DataFrame:
    choose = F.max if keep == "largest" else F.min
    return stored(
        rows.groupBy("_run", *KEY).agg(choose(best).alias("_best"), F.sum(size).alias("_size"))
        .sortWithinPartitions("_run", "_digest"))


def groups_of_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                     fan: int = FAN) -> DataFrame:
    """``_row, _id, keep_id, keep_row, group_size, _digest`` for each row of ``docs``.

    ``keep`` is "smallest" or "largest" identifier. Null texts equal empty ones. A null id counts as smaller than all
    others when the largest stays, and is never chosen before a known id when the smallest stays; rows that repeat an
    id are told apart by their place in the input. Empty tables give empty results; other columns are not read.
    """
    leaves = stored(digest_runs(docs, id_col, text_col))
    order = [F.col("_id"), F.col("_row")] if keep == "largest" else [F.col("_id").isNull(), F.col("_id"), F.col("_row")]
    best = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    levels = [_merged(leaves, keep, best, F.lit(1))]
    last = leaves.agg(F.max("_run")).first()[0] or 0
    while last > 0:
        up = levels[-1].withColumn("_run", F.floor(F.col("_run") / fan).cast("int"))
        levels.append(_merged(up, keep, F.col("_best"), F.col("_size")))
        last //= fan
    known = levels.pop()
    while levels:
        below = levels.pop().select("_run", *KEY).withColumn("_up", F.floor(F.col("_run") / fan).cast("int"))
        known = below.join(known.withColumnRenamed("_run", "_up"), ["_up", *KEY]).drop("_up")
    n = len(order)
    return leaves.join(known, ["_run", *KEY]).select(
        "_row", "_id", F.col(f"_best.k{n - 2}").alias("keep_id"), F.col(f"_best.k{n - 1}").alias("keep_row"),
        F.col("_size").alias("group_size"), "_digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` without exact copies, columns unchanged. Of rows that repeat both id and text, one stays."""
    found = groups_of_copies(docs, id_col, text_col, keep).filter("_row = keep_row").select(
        F.col("_id").alias("_keep_id"), F.col("_digest").alias("_keep_digest"))
    digest = F.unhex(F.sha2(text_of(text_col).cast("binary"), 256))
    stay = docs.withColumn("_own_digest", digest).join(
        found, F.col(id_col).eqNullSafe(F.col("_keep_id")) & (F.col("_own_digest") == F.col("_keep_digest")), "left_semi")
    return stay.dropDuplicates([id_col, "_own_digest"]).drop("_own_digest")
