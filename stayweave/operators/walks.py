"""Metapath-guided random walks by edge weight: one equi-join per step, no neighbour lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayweave.operators.ordered import with_running_sum
from stayweave.session import broadcast_or_shuffle, by_shuffle, cut_lineage

# Metapaths of the four graph variants, as (start type, relations).
METAPATHS = {
    "visits": ("individual", ["visits", "visited_by"]),
    "visits_groups": ("group", ["includes", "visits", "visited_by", "belongs_to"]),
    "visits_kinds": ("individual", ["visits", "contains", "located_in", "visited_by"]),
    "visits_kinds_groups": ("group", ["includes", "visits", "contains", "located_in", "visited_by", "belongs_to"]),
    "places": ("individual", ["visits", "has_poi", "located_at", "visited_by"]),
}

# Types at the two ends of each relation.
ENDS = {
    "visits": ("individual", "hexagon"), "visited_by": ("hexagon", "individual"),
    "has_poi": ("hexagon", "poi_category"), "located_at": ("poi_category", "hexagon"),
    "contains": ("hexagon", "poi_category"), "located_in": ("poi_category", "hexagon"),
    "includes": ("group", "individual"), "belongs_to": ("individual", "group"),
}

# Multiplicative generator modulo a Mersenne prime. Products stay below 2^53.
PRIME, MULTIPLIER = 2147483647, 48271
SLOTS_PER_SLICE = 100_000
CHECKPOINT_STEPS = 10
#: Walks of one task. A node table of a few KB makes millions of walks, so Spark's guess by bytes leaves them in one task.
TASK_WALKS = 20_000


def metapath(kinds: bool = False, groups: bool = False) -> tuple[str, list[str]]:
    """Start type and relations of a graph variant."""
    return METAPATHS["visits" + "_kinds" * kinds + "_groups" * groups]


def index_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Replace the keys of ``(rel, src, dst, weight)`` by node numbers within their type. ``nodes`` should be cheap to count."""
    ends = F.create_map(*[F.lit(v) for rel, pair in ENDS.items() for v in (rel, F.array(*map(F.lit, pair)))])
    typed = edges.withColumn("_t", ends[F.col("rel")])
    nodes = broadcast_or_shuffle(nodes)
    source = nodes.select(F.col("node_type").alias("_st"), F.col("key").alias("src"), F.col("idx").alias("_s"))
    target = nodes.select(F.col("node_type").alias("_dt"), F.col("key").alias("dst"), F.col("idx").alias("_d"))
    return (
        typed.withColumns({"_st": F.col("_t")[0], "_dt": F.col("_t")[1]})
        .join(source, ["_st", "src"]).join(target, ["_dt", "dst"])
        .select("rel", F.col("_s").alias("src"), F.col("_d").alias("dst"), "weight")
    )


def edge_intervals(edges: DataFrame) -> DataFrame:
    """``rel, src, dst, begin, end``: the weights of each (rel, src) laid side by side from 0 on, by ``dst``. Neighbours are
    numbered in slices, so a hub is not one task; edges without weight fall out."""
    counted = with_running_sum(
        edges, ["rel", "src"], "dst", [], F.col("weight"), "end", slice_seconds=SLOTS_PER_SLICE)
    return counted.filter("weight > 0").select("rel", "src", "dst", (F.col("end") - F.col("weight")).alias("begin"), "end")


def weight_buckets(intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intervals by bucket, and ``rel, src, total, width`` of each node.

    The weight of a node is cut into as many equal buckets as it has edges, and an edge has a row for each bucket it
    reaches: at most twice as many rows as edges, whatever the weights. A drawn weight finds its edge in its bucket, among
    two on average.
    """
    nodes = intervals.groupBy("rel", "src").agg(F.max("end").alias("total"), F.count("*").alias("_n")).select(
        "rel", "src", "total", F.ceil(F.col("total") / F.col("_n")).cast("bigint").alias("width"))
    reach = F.sequence(F.expr("begin div width"), F.expr("(end - 1) div width"))
    return intervals.join(by_shuffle(nodes), ["rel", "src"]).select("rel", "src", "dst", "begin", "end", F.explode(reach).alias("bucket")), nodes


def _mix(walk: Column, step: int, node: Column, seed: int) -> Column:
    mixed = (walk * 7919 + F.lit(step * 104729 + seed * 15485863) + node * 1299709) % PRIME
    for turn in (1, 2):
        mixed = (mixed * MULTIPLIER + turn) % PRIME
    return mixed


def _draw(mixed: Column, total: Column) -> Column:
    """A number below ``total``; a total beyond the generator's range takes two of its numbers."""
    wide = mixed * PRIME + (mixed * MULTIPLIER + 3) % PRIME
    return F.when(total > PRIME, wide % total).when(total > 0, mixed % total)


def random_walks(nodes: DataFrame, edges: DataFrame, start_type: str, relations: list[str], walk_length: int,
                 walks_per_node: int, seed: int = 42) -> DataFrame:
    """Walks of up to ``walk_length`` steps as ``(walk, path)``, ``path`` holding node numbers.

    ``edges`` has numbered ends; the next node is drawn by weight. Each edge knows the total weight and bucket width of its
    target in the next relation, so a step is one equi-join on (node, bucket): the walks at a hub spread over its buckets.
    A node without an edge of the relation ends the walk; ended walks leave the loop whenever it stores its state.
    Edges are joined by counted rows: their files are far smaller than they are, and Spark would broadcast millions of them for each step.
    """
    intervals = cut_lineage(edge_intervals(edges.filter(F.col("rel").isin(list(relations)))))
    buckets, totals = (cut_lineage(t) for t in weight_buckets(intervals))
    hops = []
    for i, rel in enumerate(relations):
        follow = relations[(i + 1) % len(relations)]
        ahead = totals.filter(F.col("rel") == follow).select(
            F.col("src").alias("dst"), F.col("total").alias("_next_total"), F.col("width").alias("_next_width"))
        hops.append(broadcast_or_shuffle(cut_lineage(buckets.filter(F.col("rel") == rel).join(broadcast_or_shuffle(ahead), "dst", "left").select(
            F.col("src").alias("_at"), F.col("bucket").alias("_bucket"), "begin", "end", F.col("dst").alias("_to"),
            "_next_total", "_next_width"))))
    first = totals.filter(F.col("rel") == relations[0]).select(F.col("src").alias("idx"), "total", "width")
    starts = nodes.filter(F.col("node_type") == start_type)
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-starts.count() * walks_per_node // TASK_WALKS))
    walks = (
        starts.join(broadcast_or_shuffle(first), "idx", "left").repartition(tasks, "idx")
        .select("idx", "total", "width", F.explode(F.sequence(F.lit(0), F.lit(walks_per_node - 1))).alias("_k"))
        .select((F.col("idx") * walks_per_node + F.col("_k")).alias("walk"), F.col("idx").alias("_at"),
                "total", "width", F.array("idx").alias("path"))
    )
    ended = []
    for step in range(walk_length):
        drawn = walks.withColumn("_pick", _draw(_mix(F.col("walk"), step, F.col("_at"), seed), F.col("total")))
        # an ended walk draws nothing and asks for bucket -1, which no node has
        drawn = drawn.withColumn("_bucket", F.coalesce(F.expr("_pick div width"), F.lit(-1)))
        hop = hops[step % len(relations)]
        met = (drawn["_at"] == hop["_at"]) & (drawn["_bucket"] == hop["_bucket"]) & (
            drawn["_pick"] >= hop["begin"]) & (drawn["_pick"] < hop["end"])
        walks = drawn.join(hop, met, "left").select(
            "walk", F.coalesce("_to", drawn["_at"]).alias("_at"), F.col("_next_total").alias("total"), F.col("_next_width").alias("width"),
            F.when(F.col("_to").isNotNull(), F.concat("path", F.array("_to"))).otherwise(F.col("path")).alias("path"))
        if (step + 1) % CHECKPOINT_STEPS == 0 and step + 1 < walk_length:
            walks = cut_lineage(walks)
            ended.append(walks.filter("total is null").select("walk", "path"))
            walks = walks.filter("total is not null")
    out = walks.select("walk", "path")
    for part in ended:
        out = out.unionByName(part)
    return out


# A node id packs the type's number above 40 bits of node number, unique across types.
TYPE_BITS = 40
TYPES = ["individual", "hexagon", "poi_category", "group"]


def node_id(node_type: Column, idx: Column) -> Column:
    """Graph-wide id of a node; ids of one type are consecutive."""
    code = F.create_map(*[v for i, t in enumerate(TYPES) for v in (F.lit(t), F.lit(i).cast("bigint"))])[node_type]
    return F.shiftleft(code, TYPE_BITS) + idx


def with_node_ids(walks: DataFrame, start_type: str, relations: list[str]) -> DataFrame:
    """Add ``nodes``: the path with graph-wide node ids."""
    kinds = [start_type] + [ENDS[r][1] for r in relations]
    if kinds[0] != kinds[-1]:
        raise ValueError("a metapath has to return to the type it starts from")
    cycle = F.array(*[F.lit(TYPES.index(k) << TYPE_BITS) for k in kinds[:-1]])
    return walks.withColumn("nodes", F.transform(
        "path", lambda node, i: F.element_at(cycle, (i % len(relations) + 1).cast("int")) + node))
