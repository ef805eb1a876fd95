"""Operator 2, embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine ``c`` are ``2 - 2c`` apart (squared). A fixed rotation spreads the difference evenly, and the
rotated vector is cut into low-dimensional blocks; at least one block then differs by no more than its proportional
share of that budget. So each block is range-joined under its share: its leading coordinates place a vector in a cell as
wide as the share allows, and a cell is joined with itself and the cells around it. A pair counts in the first block
that admits it, told by integer codes, and is verified by its exact cosine there.

The vectors of a label are dealt to tiles of about ``CELL_ROWS``. Every two tiles meet once, in turns like those of a
tournament: a task gets two tiles and joins all blocks of them, so a turn sends each vector once, and its shuffle files
go before the next turn. Tasks give back counts of links and a spanning forest of what they linked, never the pairs, so
a group of near copies of any size stays linear. Equal vectors are one point with a weight.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayweave.llm.base import stored, union_all
from stayweave.operators.components import connected_components
from stayweave.session import broadcast_if_small, broadcast_or_shuffle, by_shuffle, released, shuffles_removed

BLOCK_DIMS = 8
#: Vectors of a tile, about; a task joins two tiles.
CELL_ROWS = 10_000
#: Steps of the integer codes per unit.
STEPS = 1 << 14
#: Gridded coordinates of a block at most; a task of fewer rows than this many compares all of a block.
MOST_GRID, GRID_ROWS = 3, 1000
#: Distances computed at once.
AT_ONCE = 1 << 21
#: Turns after which counts and forests are merged.
MERGED_TURNS = 8


def rotation(dims: int) -> np.ndarray:
    """The same random rotation everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(20240229).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _units(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    scale = np.abs(wide).max(axis=1, keepdims=True)
    wide = wide / scale  # else squares of very large or small numbers leave the range
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def usable_vectors(rows: DataFrame, vec_col: str) -> DataFrame:
    """Adds ``_v``, the vector as floats or else doubles: null without a label, for a zero vector and for one with numbers
    that are null or not finite."""
    narrow = isinstance(rows.schema[vec_col].dataType.elementType, T.FloatType)
    v = F.col(vec_col).cast("array<float>" if narrow else "array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.withColumn("_v", F.when(F.col("_label").isNotNull() & F.coalesce(ok, F.lit(False)), v))


def _budgets(dims: int, least_cosine: float) -> tuple[list[tuple[int, int]], list[float]]:
    """Blocks ``(from, to)`` and the squared code distance each may have. A coordinate is off by half a step in either
    vector at most, which the budget allows for."""
    blocks = [(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]
    total = 2 - 2 * least_cosine + 1e-9
    return blocks, [(np.sqrt(total * (b - a) / dims) * STEPS + np.sqrt(b - a)) ** 2 for a, b in blocks]


def _met_cells(block: np.ndarray, left: np.ndarray, right: np.ndarray, width: int, grid: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows ``(left, right)`` of each cell and the cells around it; between them lie all pairs within ``width``. Where ``left``
    is ``right``, the cells around are those after it, and its own rows come first on both sides."""
    alone = left is right
    cell = block[:, :grid].astype(np.int64) // width + (1 << 14)
    key = np.zeros(len(block), dtype=np.int64)
    for j in range(grid):
        key = (key << 16) + cell[:, j]
    left, right = left[np.argsort(key[left], kind="stable")], right[np.argsort(key[right], kind="stable")]
    starts, near = np.flatnonzero(np.diff(key[left], prepend=-1)), min(grid, 1)
    around = []
    for move in itertools.product((0, 1, -1), repeat=max(grid - 1, 0)):  # along the last coordinate, cells lie side by side
        shift = sum(m << 16 * (len(move) - j) for j, m in enumerate(move))
        if shift >= 0 or not alone:
            own = key[left[starts]] + shift
            around.append((np.searchsorted(key[right], own - (near if shift or not alone else 0)), np.searchsorted(key[right], own + near, side="right")))
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(left)])):
        yield left[a:b], np.concatenate([right[lo[k]:hi[k]] for lo, hi in around])


def _pairs(codes: np.ndarray, left: np.ndarray, right: np.ndarray, least_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows ``(i, j)`` of the pairs between ``left`` and ``right``, which may be the same, that some block admits. Each pair
    comes once, in the first such block."""
    blocks, budgets = _budgets(codes.shape[1], least_cosine)
    grid = MOST_GRID if len(right) > GRID_ROWS else 0
    for k, ((a, b), budget) in enumerate(zip(blocks, budgets)):
        block = codes[:, a:b]
        # half of what is left of the budget, in single precision; the slack is far above its error
        half = ((block * block).sum(axis=1) / 2 - budget / 4 - STEPS * STEPS * 1e-5)[:, None]
        one, two = (np.concatenate(x, axis=1).astype(np.float32) for x in ((block, -half, np.ones_like(half)), (block, np.ones_like(half), -half)))
        for rows, met in _met_cells(block, left, right, int(np.sqrt(budget)) + 1, min(grid, b - a)):
            facing = np.ascontiguousarray(two[met].T)
            step = max(1, AT_ONCE // max(1, len(met)))
            for at in range(0, len(rows), step):
                some = rows[at:at + step]
                x, y = np.divmod(np.flatnonzero(one[some] @ facing >= 0), max(1, len(met)))
                if left is right:  # rows of one cell once, and none with itself
                    x, y = x[y > x + at], y[y > x + at]
                i, j = some[x], met[y]
                # whole numbers: sums of squares of codes are exact in doubles
                apart = lambda e: ((codes[i, blocks[e][0]:blocks[e][1]] - codes[j, blocks[e][0]:blocks[e][1]]) ** 2).sum(axis=1)
                fresh = apart(k) <= budget
                i, j = i[fresh], j[fresh]
                for earlier in range(k):
                    fresh = apart(earlier) > budgets[earlier]
                    i, j = i[fresh], j[fresh]
                if len(i):
                    yield i, j


def _united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (each row's least known row, itself if none) after the pairs are linked as well."""
    while True:
        one, two = root[i], root[j]
        apart = one != two
        if not apart.any():
            return root
        i, j, one, two = i[apart], j[apart], one[apart], two[apart]
        root[np.maximum(one, two)] = np.minimum(one, two)
        while not np.array_equal(root, further := root[root]):
            root = further


def _linked(node: np.ndarray, weight: np.ndarray, raw: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]],
            least_cosine: float) -> pa.Table:
    """``node, links, to`` of the rows with links between the ``sides``; ``to`` is the root of the row's tree."""
    unit = _units(raw)
    codes = np.rint(unit @ rotation(raw.shape[1]) * STEPS)
    links, root = np.zeros(len(node)), np.arange(len(node))
    for left, right in sides:
        for i, j in _pairs(codes, left, right, least_cosine):
            good = np.concatenate([(unit[i[s:s + 65536]] * unit[j[s:s + 65536]]).sum(axis=1) >= least_cosine for s in range(0, len(i), 65536)])
            i, j = i[good], j[good]
            # sums of whole numbers below 2^53, so exact
            links += np.bincount(i, weight[j], len(node)) + np.bincount(j, weight[i], len(node))
            root = _united(root, i, j)
    got = np.flatnonzero(links)
    return pa.table({"node": node[got], "links": links[got].astype(np.int64), "to": node[root[got]]})


def _dealt(points: DataFrame, turn: int) -> DataFrame:
    """The points of a turn by the two tiles that meet, ``p`` and ``q``. In all turns together every two tiles of a label
    meet once, as teams do that move around a table; with an odd number of tiles one rests in each turn. The first turn
    has all points, as it joins the tiles with themselves, too."""
    last = F.col("tiles") + F.col("tiles") % 2 - 1
    facing = F.pmod(F.lit(turn) - F.col("tile"), last)
    other = F.when(F.col("tile") == last, F.pmod(F.lit(turn) * F.expr("(tiles + 1) div 2"), last)).when(facing == F.col("tile"), last).otherwise(facing)
    met = points.filter(F.lit(turn) < last).withColumn("_other", other.cast("int")).filter(F.lit(turn == 0) | (F.col("_other") < F.col("tiles")))
    return met.select("_label", F.least("tile", "_other").alias("p"), F.greatest("tile", "_other").alias("q"), "tile", "node", "weight", "_v")


def _merged(found: list[DataFrame]) -> DataFrame:
    """``node, links, to`` of several turns as one row a node."""
    rows = union_all(found)
    edges = rows.filter("node <> to").select(F.col("node").alias("src"), F.col("to").alias("dst"))
    trees = connected_components(rows.select("node").distinct(), edges)
    out = stored(rows.groupBy("node").agg(F.sum("links").alias("links")).join(by_shuffle(trees), "node").select(
        "node", "links", F.col("component").alias("to")))
    released(*found)
    return out


def _joined(dims: int, least_cosine: float, first: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """The join of the two tiles of a group; ``first``: and of each with itself."""

    def link(key: tuple, group: pa.Table) -> pa.Table:
        raw = np.concatenate([c.flatten().to_numpy() for c in group["_v"].chunks]).reshape(-1, dims)
        own = group["tile"].to_numpy() == key[1].as_py()
        rows = np.arange(len(own))
        sides = [(rows, rows)] if first else [(rows[own], rows[~own])]
        return _linked(group["node"].to_numpy(), group["weight"].to_numpy(), raw, sides, least_cosine)

    return link


def _met(points: DataFrame, dims: int, least_cosine: float) -> list[DataFrame]:
    """``node, links, to`` of the points of one length that have links."""
    many = stored(points.groupBy("_label").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("tiles")))
    most = many.agg(F.max("tiles")).first()[0]
    dealt = points.join(broadcast_if_small(many), "_label").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    found = []
    for turn in range(most + most % 2 - 1):
        groups = _dealt(dealt, turn).groupBy("_label", "p", "q")
        found.append(stored(groups.applyInArrow(_joined(dims, least_cosine, turn == 0), "node bigint, links bigint, to bigint")))
        if len(found) > MERGED_TURNS:
            found = [_merged(found)]
    return found


def near_copies(rows: DataFrame, least_cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding",
                label_col: str = "label") -> DataFrame:
    """``id, n_links, component_id, kept`` for each row.

    Vectors are compared only within equal labels, in double precision. Vectors that are null or zero, hold null or
    non-finite numbers or have no label link with nothing, nor do vectors of different lengths; each length is joined
    by itself. Equal vectors link like others, rows that repeat an id included. An empty table gives an empty result.
    """
    base = rows.select(F.col(id_col).alias("_id"), F.col(label_col).cast("string").alias("_label"), F.col(vec_col).alias("_raw"))
    same: Column = F.unhex(F.sha2(F.array_join("_v", ","), 256))
    base = usable_vectors(base, "_raw").select("_id", "_label", "_v", same.alias("_same"))
    with shuffles_removed(rows.sparkSession):
        points = base.filter("_v is not null").groupBy("_label", "_same").agg(
            F.min("_id").alias("least_id"), F.count("*").alias("weight"), F.first("_v").alias("_v"))
        points = stored(points.withColumn("node", F.monotonically_increasing_id()))
        lengths = [r["d"] for r in points.groupBy(F.size("_v").alias("d")).agg(F.count("*").alias("n")).filter("n > 1").orderBy("d").collect()]
        found = [t for d in lengths for t in _met(points.filter(F.size("_v") == d), d, least_cosine)]
        nodes = points.select("node", "_label", "_same", "least_id", "weight")
        if found:
            links = _merged(found)
            nodes = nodes.join(by_shuffle(links), "node", "left")
        else:
            nodes = nodes.withColumns({"links": F.lit(0), "to": F.col("node")})
        nodes = stored(nodes.select("_label", "_same", "least_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                                    F.coalesce("to", "node").alias("_class")))
        # written first, so that the rows of a large class are split over tasks
        least = stored(nodes.groupBy("_class").agg(F.min("least_id").alias("component_id")))
        classes = stored(nodes.join(broadcast_or_shuffle(least), "_class").select("_label", "_same", "n_links", "component_id"))
        released(points, nodes, least)
    out = base.select("_id", "_label", "_same").join(by_shuffle(classes), ["_label", "_same"], "left").select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "_id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
