"""Communities of a weighted undirected graph by local moves on modularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayweave.session import cut_lineage

RESOLUTION = 0.3


def _arcs(edges: DataFrame) -> DataFrame:
    """Both directions of ``(u, v, weight)``; a loop becomes one arc of twice its weight."""
    forth = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("weight").cast("double").alias("w"))
    back = forth.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return forth.unionByName(back).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """One row: the modularity of ``(node, community)`` on ``(u, v, weight)``."""
    return _modularity(_arcs(edges), membership, resolution)


def _modularity(arcs: DataFrame, membership: DataFrame, resolution: float) -> DataFrame:
    ends = arcs.join(membership.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(
        membership.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    per = ends.groupBy("a").agg(
        F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inner"), F.sum("w").alias("tot"))
    return per.agg(F.sum("inner").alias("_in"), F.sum(F.col("tot") * F.col("tot")).alias("_sq"),
                   F.sum("tot").alias("_m2")).select(
        (F.col("_in") / F.col("_m2") - resolution * F.col("_sq") / (F.col("_m2") * F.col("_m2"))).alias("modularity"))


def _local_moves(arcs: DataFrame, resolution: float) -> DataFrame:
    """Move nodes to the neighbouring community with the best gain, half of the nodes per round so
    that two neighbours do not swap; stop when a full turn does not raise the modularity."""
    strength = cut_lineage(arcs.groupBy("src").agg(F.sum("w").alias("k")).withColumnRenamed("src", "node"))
    m2 = strength.agg(F.sum("k")).first()[0]
    members = cut_lineage(strength.select("node", "k", F.col("node").alias("community")))
    best, stale, turn = None, 0, -1
    while stale < 2:
        turn += 1
        totals = members.groupBy("community").agg(F.sum("k").alias("tot"))
        near = arcs.filter("src <> dst").join(
            members.select(F.col("node").alias("dst"), F.col("community").alias("to")), "dst"
        ).groupBy("src", "to").agg(F.sum("w").alias("w"))
        own = members.select(F.col("node").alias("src"), "k", F.col("community").alias("from"))
        choices = near.join(own, "src").unionByName(
            own.select("src", F.col("from").alias("to"), F.lit(0.0).alias("w"), "k", "from"))
        scored = choices.groupBy("src", "to", "k", "from").agg(F.sum("w").alias("w")).join(
            totals.withColumnRenamed("community", "to"), "to", "left")
        others = F.coalesce("tot", F.lit(0.0)) - F.when(F.col("to") == F.col("from"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.col("k") * others / m2, 9)
        # The present community wins ties.
        picks = scored.withColumn("gain", gain).groupBy("src", "k", "from").agg(F.max_by(
            "to", F.struct("gain", (F.col("to") == F.col("from")).alias("stay"), "to")).alias("to"))
        turn_of = F.pmod(F.xxhash64("src"), F.lit(2)) == turn % 2
        moved = cut_lineage(picks.select(
            F.col("src").alias("node"), "k", F.when(turn_of, F.col("to")).otherwise(F.col("from")).alias("community")))
        value = _modularity(arcs, moved, resolution).first()[0]
        if best is None or value > best + 1e-9:
            best, members, stale = value, moved, 0
        else:
            stale += 1
    return members.select("node", "community")


def communities(edges: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """``(node, community)``: local moves, then the same on the graph of communities, until stable.

    A community is named by one of its nodes.
    """
    arcs = cut_lineage(_arcs(edges))
    membership = arcs.select(F.col("src").alias("node"), F.col("src").alias("community")).distinct()
    while True:
        found = _local_moves(arcs, resolution)
        membership = cut_lineage(membership.join(
            found.select(F.col("node").alias("community"), F.col("community").alias("upper")), "community"
        ).select("node", F.col("upper").alias("community")))
        merged = cut_lineage(
            arcs.join(found.select(F.col("node").alias("src"), F.col("community").alias("a")), "src")
            .join(found.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
            .groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
        if merged.select("src").distinct().count() == arcs.select("src").distinct().count():
            break
        arcs = merged
    return membership


def merge_small(membership: DataFrame, edges: DataFrame, min_nodes: int) -> DataFrame:
    """Move each community with fewer than ``min_nodes`` nodes into the large one it is tied to most."""
    sizes = membership.groupBy("community").agg(F.count("*").alias("n"))
    ends = _arcs(edges).join(membership.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(
        membership.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    small = sizes.filter(F.col("n") < min_nodes).select(F.col("community").alias("a"))
    large = sizes.filter(F.col("n") >= min_nodes).select(F.col("community").alias("b"))
    ties = ends.join(small, "a", "left_semi").join(large, "b", "left_semi").groupBy("a", "b").agg(F.sum("w").alias("w"))
    target = ties.groupBy("a").agg(F.max_by("b", F.struct("w", "b")).alias("into"))
    return membership.join(target.withColumnRenamed("a", "community"), "community", "left").select(
        "node", F.coalesce("into", "community").alias("community"))
