"""Connected components and distance linkage as joins.

Hot spots never pair with themselves: points collapse into squares whose members are all linked.
Two squares at the edge of the radius that still belong to different components are quartered together until
boxes of points decide, and single points are compared only where few are left.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayweave.session import BROADCAST_ROWS, broadcast_or_shuffle, by_shuffle, cut_lineage, released, stored


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)``; a component is named by one of its nodes.

    ``nodes`` has ``node``; ``edges`` has ``src, dst``. Each round joins every node to the neighbour
    that comes first in a hashed order, follows those links for up to four steps, and contracts the
    graph, so that the edges left shrink by a large factor per round.
    """
    arcs = stored(
        edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        .filter("src <> dst").distinct())
    rounds = []
    while n_arcs := arcs.limit(BROADCAST_ROWS + 1).count():
        met = by_shuffle if n_arcs > BROADCAST_ROWS else lambda df: df
        rank = F.struct(F.xxhash64("dst").alias("h"), F.col("dst").alias("n"))
        own = F.struct(F.xxhash64("src").alias("h"), F.col("src").alias("n"))
        # the aggregate is shuffled once and reused by the joins of one plan
        links = arcs.groupBy("src").agg(F.min(rank).alias("_r")).select(
            F.col("src").alias("node"), F.when(F.col("_r") < own, F.col("_r.n")).otherwise(F.col("src")).alias("head"))
        for _ in range(2):
            links = links.join(met(links.select(F.col("node").alias("head"), F.col("head").alias("_further"))), "head").select(
                "node", F.col("_further").alias("head"))
        links = stored(links)
        rounds.append(met(links))
        before, arcs = arcs, stored(
            arcs.join(met(links.select(F.col("node").alias("src"), F.col("head").alias("_a"))), "src")
            .join(met(links.select(F.col("node").alias("dst"), F.col("head").alias("_b"))), "dst")
            .filter("_a <> _b").select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct())
        released(before)
    labels = nodes.select("node", F.col("node").alias("component")).distinct()
    for links in rounds:
        labels = labels.join(links.withColumnRenamed("node", "component"), "component", "left").select(
            "node", F.coalesce("head", "component").alias("component"))
    labels = stored(labels)
    released(arcs, *rounds)
    return labels


# Squares have side radius / (4 * sqrt(2)), so squares (dx, dy) apart lie wholly within the radius
# when (|dx|+1)^2 + (|dy|+1)^2 <= 32 and partly when (|dx|-1)^2 + (|dy|-1)^2 <= 32.
_SQUARES = 32


def square_of(value: str, radius: float):
    """Number of the square along one axis."""
    return F.floor(F.col(value) * (4 * math.sqrt(2) / radius)).cast("bigint")


def square_offsets() -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    sure, partial = [], []
    for dx in range(0, 7):
        for dy in range(-6, 7):
            if dx == 0 and dy <= 0:
                continue
            if (dx + 1) ** 2 + (abs(dy) + 1) ** 2 <= _SQUARES:
                sure.append((dx, dy))
            elif max(dx - 1, 0) ** 2 + max(abs(dy) - 1, 0) ** 2 <= _SQUARES:
                partial.append((dx, dy))
    return sure, partial


def _pairs(squares: DataFrame, keys: list[str], offsets) -> DataFrame:
    """Occupied square pairs at the given offsets as ``keys, sx, sy, tx, ty``."""
    moves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    out = squares.select(*keys, "sx", "sy", F.explode(moves).alias("m")).select(
        *keys, "sx", "sy", (F.col("sx") + F.col("m.dx")).alias("tx"), (F.col("sy") + F.col("m.dy")).alias("ty"))
    return out.join(broadcast_or_shuffle(squares).select(*keys, F.col("sx").alias("tx"), F.col("sy").alias("ty")), [*keys, "tx", "ty"])


def _square_name(keys: list[str], x: str, y: str):
    """Text that differs for different keys, NULL ones and ones with any sign in them included."""
    return F.to_json(F.struct(*keys, F.col(x).alias("sx"), F.col(y).alias("sy")))


#: Point pairs that two cells may compare; more descend into quarters.
LEAF_PAIRS = 1024


def _near_pairs(points: DataFrame, pairs: DataFrame, keys: list[str], radius: float, leaf: int = LEAF_PAIRS) -> DataFrame:
    """``src, dst`` of the cell pairs that hold two points within ``radius``.

    ``points`` has ``cx, cy, px, py``, ``pairs`` two cells ``ax, ay`` and ``bx, by`` with the labels to link. The boxes of
    the points in both cells decide most pairs: all near or all far. The rest compare points if these are few, or else both
    cells are quartered and the quarters judged the same way. Labels linked once are not looked at again.
    """
    found = []
    pairs = cut_lineage(pairs)
    while n_pairs := pairs.limit(BROADCAST_ROWS + 1).count():
        many = n_pairs > BROADCAST_ROWS
        few = by_shuffle if many else F.broadcast
        here = points.join(pairs.select(*keys, F.explode(F.array(
            F.struct(F.col("ax").alias("cx"), F.col("ay").alias("cy")), F.struct(F.col("bx").alias("cx"), F.col("by").alias("cy")))).alias("c"))
            .select(*keys, "c.*").distinct().transform(few), [*keys, "cx", "cy"], "left_semi")
        boxes = cut_lineage(here.groupBy(*keys, "cx", "cy").agg(
            F.count("*").alias("n"), *[f(c).alias(f"{c}_{n}") for c in ("px", "py") for n, f in (("low", F.min), ("high", F.max))]))
        side = lambda s: boxes.select(*keys, *[F.col(c).alias(f"{s}_{c}" if c[0] != "c" else s + c[1]) for c in boxes.columns if c not in keys])
        met = pairs.join(few(side("a")), [*keys, "ax", "ay"]).join(few(side("b")), [*keys, "bx", "by"])

        def span(c, far):
            one, two = F.col(f"a_{c}_high") - F.col(f"b_{c}_low"), F.col(f"b_{c}_high") - F.col(f"a_{c}_low")
            return F.greatest(one, two) if far else F.greatest(F.lit(0.0), -one, -two)

        reach = lambda far: F.pow(span("px", far), 2) + F.pow(span("py", far), 2)
        state = F.when(reach(True) <= radius * radius, "near").when(reach(False) > radius * radius, "far").when(
            F.col("a_n") * F.col("b_n") <= leaf, "leaf").otherwise("split")
        judged = cut_lineage(met.select(*keys, "ax", "ay", "bx", "by", "src", "dst", state.alias("state")).filter("state <> 'far'"))
        spot = lambda s: points.select(*keys, *[F.col(f"{p}{c}").alias(f"{s}{q}{c}") for p, q in (("c", ""), ("p", "p")) for c in "xy"])
        close = F.pow(F.col("apx") - F.col("bpx"), 2) + F.pow(F.col("apy") - F.col("bpy"), 2) <= radius * radius
        compared = by_shuffle(judged.filter("state = 'leaf'")).join(spot("a"), [*keys, "ax", "ay"]).join(
            by_shuffle(spot("b")), [*keys, "bx", "by"]).filter(close)
        found.append(cut_lineage(judged.filter("state = 'near'").select("src", "dst").unionByName(compared.select("src", "dst")).distinct()))
        left = cut_lineage(judged.filter("state = 'split'").join(few(found[-1]), ["src", "dst"], "left_anti"))
        released(boxes, judged, pairs)
        pairs = left
        if not left.limit(1).count():
            break
        # a quarter's number halves to its cell's, so both children of a pair come by joins on the parents
        points = cut_lineage(points.join(left.select(*keys, F.explode(F.array(
            F.struct(F.col("ax").alias("cx"), F.col("ay").alias("cy")), F.struct(F.col("bx").alias("cx"), F.col("by").alias("cy")))).alias("c"))
            .select(*keys, "c.*").distinct().transform(few), [*keys, "cx", "cy"], "left_semi").select(
            *keys, F.floor(F.col("px") * (4 * math.sqrt(2) / radius) * 2.0 ** len(found)).cast("bigint").alias("cx"),
            F.floor(F.col("py") * (4 * math.sqrt(2) / radius) * 2.0 ** len(found)).cast("bigint").alias("cy"), "px", "py"))
        quarters = points.select(*keys, "cx", "cy").distinct()
        child = lambda s: quarters.select(*keys, F.shiftright("cx", 1).alias(f"{s}x"), F.shiftright("cy", 1).alias(f"{s}y"),
                                          F.col("cx").alias(f"_{s}x"), F.col("cy").alias(f"_{s}y"))
        pairs = cut_lineage(left.join(by_shuffle(child("a")), [*keys, "ax", "ay"]).join(by_shuffle(child("b")), [*keys, "bx", "by"]).select(
            *keys, F.col("_ax").alias("ax"), F.col("_ay").alias("ay"), F.col("_bx").alias("bx"), F.col("_by").alias("by"), "src", "dst"))
    if not found:
        return pairs.select("src", "dst")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct()


def radius_components(points: DataFrame, keys: list[str], radius: float, x: str = "x", y: str = "y",
                      name: str = "component") -> DataFrame:
    """Label ``points`` so that two points of a key share a label when a chain of steps of at most
    ``radius`` joins them. Labels are strings, equal within and different across components."""
    placed = points.withColumns({"sx": square_of(x, radius), "sy": square_of(y, radius)})
    node = _square_name(keys, "sx", "sy")
    other = _square_name(keys, "tx", "ty")
    distinct = cut_lineage(placed.select(*keys, "sx", "sy", F.col(x).alias("px"), F.col(y).alias("py")).distinct())
    squares = cut_lineage(distinct.select(*keys, "sx", "sy").distinct())
    nodes = squares.select(node.alias("node"))
    sure, partial = square_offsets()
    sure_labels = connected_components(nodes, _pairs(squares, keys, sure).select(node.alias("src"), other.alias("dst")))
    sure_labels = sure_labels.withColumnRenamed("component", "_piece")
    labelled = cut_lineage(squares.join(broadcast_or_shuffle(sure_labels), node == F.col("node")).select(*keys, "sx", "sy", "_piece"))
    pieces = broadcast_or_shuffle(labelled)
    open_pairs = (
        _pairs(squares, keys, partial)
        .join(pieces.withColumnRenamed("_piece", "_from"), [*keys, "sx", "sy"])
        .join(pieces.select(*keys, F.col("sx").alias("tx"), F.col("sy").alias("ty"),
                              F.col("_piece").alias("_to")), [*keys, "tx", "ty"])
        .filter("_from <> _to")
    )
    links = _near_pairs(distinct.select(*keys, F.col("sx").alias("cx"), F.col("sy").alias("cy"), "px", "py"), open_pairs.select(
        *keys, F.col("sx").alias("ax"), F.col("sy").alias("ay"), F.col("tx").alias("bx"), F.col("ty").alias("by"),
        F.col("_from").alias("src"), F.col("_to").alias("dst")), keys, radius)
    merged = connected_components(sure_labels.select(F.col("_piece").alias("node")).distinct(), links)
    final = labelled.join(broadcast_or_shuffle(merged), F.col("_piece") == F.col("node")).select(
        *keys, "sx", "sy", F.col("component").alias(name))
    return placed.join(broadcast_or_shuffle(cut_lineage(final)), [*keys, "sx", "sy"]).drop("sx", "sy")
