"""Nodes and edges of the visit graph: devices, cells, categories and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayweave import constants as C
from stayweave.functions import geo
from stayweave.session import broadcast_if_small, cut_lineage

ROW_BITS = 33  # bits below the partition number in monotonically_increasing_id


def dense_ids(rows: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Number the distinct keys 0..n-1 in key order, without a global window.

    Keys are range partitioned and numbered inside their partition; only the partition sizes are
    summed up in one place.
    """
    spread = rows.select(key).filter(F.col(key).isNotNull()).distinct().repartitionByRange(key)
    tagged = cut_lineage(spread.sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", ROW_BITS)
    sizes = tagged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    # One row per partition: bounded by the number of tasks.
    return tagged.withColumn("_part", part).join(F.broadcast(starts), "_part").select(
        key, (F.col("_start") + F.col("_m") - F.shiftleft("_part", ROW_BITS)).cast("bigint").alias(name))


def node_table(stops: DataFrame, categories: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Nodes of every type as ``(node_type, key, idx)``, ids dense within the type."""
    parts = [("individual", stops.select(F.col("device_aid").alias("key"))),
             ("hexagon", stops.select(F.col("h3_id").cast("string").alias("key")))]
    if categories is not None:
        parts.append(("poi_category", categories.select(F.col("primary").alias("key"))))
    if groups is not None:
        parts.append(("group", groups.select(F.col("group").cast("string").alias("key"))))
    nodes = None
    for kind, keys in parts:
        table = dense_ids(keys, "key").select(F.lit(kind).alias("node_type"), "key", "idx")
        nodes = table if nodes is None else nodes.unionByName(table)
    return nodes


def both_ways(edges: DataFrame, forth: str, back: str) -> DataFrame:
    """``(rel, src, dst, weight)`` in both directions under two relation names."""
    return edges.select(F.lit(forth).alias("rel"), "src", "dst", "weight").unionByName(
        edges.select(F.lit(back).alias("rel"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def visit_edges(stops: DataFrame) -> DataFrame:
    """Device - cell edges, distinct, both directions."""
    pairs = stops.select(F.col("device_aid").alias("src"), F.col("h3_id").cast("string").alias("dst")).distinct()
    return both_ways(pairs.withColumn("weight", F.lit(1)), "visits", "visited_by")


def weighted_visit_edges(weights: DataFrame, weight: str = "freq_wi") -> DataFrame:
    """Device - cell edges whose weight stands for that many parallel edges."""
    return both_ways(weights.select(
        F.col("device_aid").alias("src"), F.col("h3_id").cast("string").alias("dst"),
        F.col(weight).cast("int").alias("weight")), "visits", "visited_by")


def list_items(stops: DataFrame, by: str, column: str, places: DataFrame | None = None) -> DataFrame:
    """``by, item, n``: how often each item is in the lists ``column`` of the stops of each ``by``; NULL items are left out.

    Stops hold their lists, or a ``place`` whose lists are in ``places``, one row each. Either way equal lists are counted
    first, so a list is read once for each ``by`` that has it and not once a stop.
    """
    if places is None:
        lists = stops.groupBy(by, column).agg(F.count("*").alias("_stops"))
        met = lists.select(by, "_stops", F.explode(column).alias("item"), F.lit(1).alias("_in_list")).filter("item is not null")
    else:
        items = places.select("place", F.explode(column).alias("item")).filter("item is not null").groupBy("place", "item").agg(
            F.count("*").alias("_in_list"))
        lists = stops.groupBy(by, "place").agg(F.count("*").alias("_stops"))
        met = lists.join(broadcast_if_small(cut_lineage(items)), "place")
    return met.groupBy(by, "item").agg(F.sum(F.col("_stops") * F.col("_in_list")).alias("n"))


def category_devices(stops: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Distinct devices seen at each category of the stops' lists."""
    return list_items(stops, "device_aid", "primary", places).groupBy(F.col("item").alias("primary")).agg(F.count("*").alias("devices"))


def valid_categories(stops: DataFrame, min_share: float = C.CATEGORY_DEVICE_SHARE, places: DataFrame | None = None) -> DataFrame:
    """Categories seen by at least the given share of all devices (share times devices, cut to an integer)."""
    total = stops.select(F.countDistinct("device_aid").alias("n")).select(
        F.floor(F.col("n") * F.lit(min_share)).alias("n")).scalar()
    return category_devices(stops, places).filter(F.col("devices") >= total)


def top_categories(stops: DataFrame, n: int = C.TOP_CATEGORIES, places: DataFrame | None = None) -> DataFrame:
    """The ``n`` categories with most devices."""
    return category_devices(stops, places).orderBy(F.desc("devices"), "primary").limit(n)


def category_edges(stops: DataFrame, categories: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Cell - category edges from the stops' lists, valid categories only, distinct, both directions."""
    pairs = (
        list_items(stops, "h3_id", "primary", places).select(F.col("h3_id").cast("string").alias("src"), F.col("item").alias("dst"))
        .join(categories.select(F.col("primary").alias("dst")), "dst", "left_semi")
    )
    return both_ways(pairs.withColumn("weight", F.lit(1)), "has_poi", "located_at")


def cell_kind_weights(stops: DataFrame, repeats: int = C.KIND_REPEATS, places: DataFrame | None = None) -> DataFrame:
    """Repeats of each kind in each cell: its share of the cell's kinds, in tenths, rounded up."""
    counts = list_items(stops, "h3_id", "kind", places).select("h3_id", F.col("item").alias("kind"), F.col("n").alias("count"))
    totals = counts.groupBy("h3_id").agg(F.sum("count").alias("_total"))
    share = F.col("count").cast("double") / F.col("_total") * repeats
    return counts.join(totals, "h3_id").select("h3_id", "kind", "count", F.ceil(share).cast("int").alias("count_n"))


def kind_edges(stops: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Cell - kind edges with the normalised repeats as weight, both directions."""
    return both_ways(cell_kind_weights(stops, places=places).select(
        F.col("h3_id").cast("string").alias("src"), F.col("kind").alias("dst"), F.col("count_n").alias("weight")),
        "contains", "located_in")


def group_edges(groups: DataFrame) -> DataFrame:
    """Group - device edges, both directions."""
    return both_ways(groups.select(
        F.col("group").cast("string").alias("src"), F.col("device_aid").alias("dst"), F.lit(1).alias("weight")),
        "includes", "belongs_to")


def node_labels(nodes: DataFrame, device_groups: DataFrame, space_groups: DataFrame) -> DataFrame:
    """Label devices with their population group and cells with their space group."""
    labels = device_groups.select(F.lit("individual").alias("node_type"), F.col("device_aid").alias("key"),
                                  F.col("group").cast("int").alias("label"))
    labels = labels.unionByName(space_groups.select(
        F.lit("hexagon").alias("node_type"), F.col("h3_id").cast("string").alias("key"),
        F.col("group").cast("int").alias("label")))
    return nodes.filter(F.col("node_type").isin("individual", "hexagon")).join(labels, ["node_type", "key"], "left")


def transit_cells(cells: DataFrame, transit: DataFrame) -> DataFrame:
    """Distinct transit stops in each of ``cells`` and the 0/1 space group; zero where none."""
    found = geo.with_cell(transit.select("latitude", "longitude").distinct()).groupBy("h3_id").agg(
        F.count("*").alias("count"))
    return cells.select("h3_id").distinct().join(found, "h3_id", "left").select(
        "h3_id", F.coalesce("count", F.lit(0)).alias("count"),
        F.when(F.coalesce("count", F.lit(0)) > 0, 1).otherwise(0).alias("group"))


def category_pairs(pois: DataFrame) -> DataFrame:
    """Weight of each (primary, secondary) pair of categories."""
    return pois.select("primary", F.explode("secondary").alias("secondary")).groupBy("primary", "secondary").agg(
        F.count("*").alias("weight"))


def undirected(pairs: DataFrame, a: str = "primary", b: str = "secondary") -> DataFrame:
    """Undirected ``(u, v, weight)``: both directions of a pair are summed."""
    return pairs.groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(F.sum("weight").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """Degree of each node of an undirected graph, largest first; a loop counts twice."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("label"))
    return ends.groupBy("label").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "label")
