"""Operator 3, n-gram Jaccard join with R-trees over count vectors.

Shingles are hashed into ``GROUPS`` groups; the group counts of a document are a point. Two sets share at most the sum
of the coordinate minima of their points, and a tree node whose points lie below a corner shares at most the minima
with that corner, so subtrees and pairs that can't reach the threshold are never looked at. What survives is verified
on the texts.

Points are dealt to trees without losing a pair: in hash order, two sets of the wanted similarity share a shingle
among the first few of either (as many as may be missing, and one). Documents with equal sets are one point. A shingle
that very many documents begin with is left out wherever a document keeps enough others for the argument to hold.
Each document is first held against one leader; trees are searched only for pairs that still lie in two classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayweave.llm.base import arrow, stored, text_of
from stayweave.llm.shingles import mix, shingle_sets
from stayweave.operators.components import connected_components
from stayweave.session import broadcast_if_small, released

GROUPS = 64
#: Sets of this many shingles have this many groups instead: many shingles in few groups would all look alike. Points of
#: either kind compare after folding the larger one.
LONG = 1024
#: A shingle first among more documents than this is frequent.
FREQUENT = 128
#: Points of one tree; larger trees are built in parts and every pair of parts is searched.
TREE_POINTS = 2000
LEAF = 16
#: How many of the trees that a document is in before this one its row there names.
BEFORE = 8


def least_shared(n: int, num: int, den: int) -> int:
    """Shingles a set of ``n`` must share with any partner."""
    return -(-num * n // den)


def spare(n: int, num: int, den: int) -> int:
    """Further leading shingles of a set of ``n``, so that frequent ones can be left out."""
    return 2 + (n - least_shared(n, num, den)) // 5


def signatures(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """``_id, _check, _row, n, h1, h2, point, coarse, keys, may_drop`` of each row; ``_check`` is a hash of the text, ``coarse``
    the point in ``GROUPS`` groups."""
    schema = pa.schema([("_id", pa.int64()), ("_check", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("point", pa.binary()),
                        ("coarse", pa.binary()), ("keys", pa.list_(pa.int64())), ("may_drop", pa.int32())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, points, coarse, keys, drops = [], [], [], [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                size = len(s)
                n.append(size)
                h1.append(int(mix(s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64)) if size else 0)
                h2.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(0xA0761D6478BD642F))).view(np.int64)) if size else 0)
                groups = LONG if size >= LONG else GROUPS
                points.append(np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups).clip(0, 65535).astype("<u2").tobytes())
                coarse.append(np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype("<u4").tobytes())
                first = size - least_shared(size, num, den) + 1 + spare(size, num, den)
                keys.append(s[:first].view(np.int64) if size else s.view(np.int64))
                drops.append(spare(least_shared(size, num, den), num, den))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(points, pa.binary()),
                pa.array(coarse, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(drops, pa.int32())], schema=schema)

    found = arrow(docs.select(F.col(id_col).cast("bigint").alias("_id"), text_of(text_col).alias("_text"), F.xxhash64(text_of(text_col))), sign,
                  "_id bigint, _check bigint, n bigint, h1 bigint, h2 bigint, point binary, coarse binary, keys array<bigint>, may_drop int")
    return stored(found.withColumn("_row", F.monotonically_increasing_id()))


def minima_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap of each row of ``a`` with each row of ``b``."""
    out = np.zeros((len(a), len(b)), dtype=np.int32)
    for g in range(a.shape[1]):
        out += np.minimum(a[:, g, None], b[None, :, g])
    return out


def _points(column) -> np.ndarray:
    """Points as rows of ``GROUPS`` counts."""
    return np.stack([np.frombuffer(p, dtype="<u2").reshape(-1, GROUPS).sum(axis=0, dtype=np.int32) for p in column])


def _most_shared(a: bytes, b: bytes) -> int:
    """Sum of the coordinate minima of two points, as finely as both are known."""
    if len(a) != len(b):
        a, b = _points([a])[0], _points([b])[0]
    else:
        a, b = np.frombuffer(a, dtype="<u2"), np.frombuffer(b, dtype="<u2")
    return int(np.minimum(a, b).sum(dtype=np.int64))


class PointTree:
    """Packed two-level R-tree: leaves of points near in size and then in their leading coordinates; a leaf is known by
    its upper corner and its least size, which is all the bound needs."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        slab = np.lexsort((points[:, 0], sizes))
        strip = max(1, int(np.sqrt(len(slab) / LEAF))) * LEAF
        self.order = np.concatenate([part[np.lexsort((points[part, 1], points[part, 0]))]
                                     for part in np.split(slab, range(strip, len(slab), strip))])
        starts = np.arange(0, len(slab), LEAF)
        self.leaves = np.split(self.order, starts[1:])
        self.corner = np.maximum.reduceat(points[self.order], starts, axis=0)
        self.least = np.minimum.reduceat(sizes[self.order], starts)
        self.points, self.sizes = points, sizes

    def search(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the query and of the tree whose bound reaches the threshold, leaf by leaf."""
        top = minima_sums(points, self.corner)
        may = top * (num + den) >= num * (sizes[:, None] + self.least[None, :])
        for k, leaf in enumerate(self.leaves):
            rows = np.flatnonzero(may[:, k])
            if len(rows):
                bound = minima_sums(points[rows], self.points[leaf])
                i, j = np.nonzero(bound * (num + den) >= num * (sizes[rows][:, None] + self.sizes[leaf][None, :]))
                yield rows[i], leaf[j]


def _trees_before(lists: pa.ListArray, keys: np.ndarray) -> np.ndarray:
    """``BEFORE`` keys a row; where there are fewer, the row's own one stands for none."""
    out = np.repeat(keys[:, None], BEFORE, axis=1)
    sizes = lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(keys)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def _search_trees(num: int, den: int):
    """Over rows sorted by tree: pairs of different labels whose bound reaches the threshold. Near copies share many trees:
    a pair is left to an earlier tree where both rows name one. In the first tree that holds both there is none to name."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def near(rows: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = rows["n"]
        ok = (rows["label"][i] != rows["label"][j]) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)
        return i[ok], j[ok]

    def first(rows: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fresh = np.ones(len(i), dtype=bool)
        for at in range(0, len(i), 1 << 15):
            part = slice(at, at + (1 << 15))
            one, two, key = rows["before"][i[part]], rows["before"][j[part]], rows["key"][i[part], None]
            for k in range(BEFORE):
                fresh[part] &= ~((one == two[:, k:k + 1]) & (one != key)).any(axis=1)
        return i[fresh], j[fresh]

    def pairs(rows: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = rows["node"][i], rows["node"][j]
        return np.stack([np.minimum(a, b), np.maximum(a, b)], 1)

    def one_leaf(rows: dict, starts: np.ndarray, size: int) -> Iterator[np.ndarray]:
        """All trees of one size that are a leaf each."""
        one, two = np.triu_indices(size, 1)
        i, j = first(rows, *near(rows, (starts[:, None] + one).ravel(), (starts[:, None] + two).ravel()))
        if len(i):
            _, fresh = np.unique(pairs(rows, i, j), axis=0, return_index=True)
            i, j = i[fresh], j[fresh]
        for at in range(0, len(i), 1 << 15):
            x, y = i[at:at + (1 << 15)], j[at:at + (1 << 15)]
            most = np.minimum(rows["point"][x], rows["point"][y]).sum(axis=1)
            ok = most * (num + den) >= num * (rows["n"][x] + rows["n"][y])
            yield pairs(rows, x[ok], y[ok])

    def large(rows: dict, start: int, stop: int) -> Iterator[np.ndarray]:
        p, q = rows["p"][start], rows["q"][start]
        here = np.arange(start, stop)
        left, right = (here, here) if p == q else (here[rows["own"][start:stop] == p], here[rows["own"][start:stop] == q])
        if len(left) and len(right):
            tree = PointTree(rows["point"][right], rows["n"][right])
            for i, j in tree.search(rows["point"][left], rows["n"][left], num, den):
                x, y = first(rows, *near(rows, left[i], right[j]))
                keep = (x < y) if p == q else slice(None)
                yield pairs(rows, x[keep], y[keep])

    def found(rows: dict, starts: np.ndarray, stops: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = stops - starts
        for size in np.unique(sizes):
            own = starts[sizes == size]
            parts = one_leaf(rows, own, int(size)) if size <= 2 * LEAF and (rows["q"][own] == 0).all() else (
                part for s in own for part in large(rows, int(s), int(s + size)))
            for part in parts:
                if len(part):
                    yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], schema=schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {n: batch.column(n).to_numpy() for n in ("key", "p", "q", "own", "node", "label", "n")} | {
                "point": np.stack([np.frombuffer(p, dtype="<u4") for p in batch.column("coarse").to_pylist()]).astype(np.int32),
                "before": _trees_before(batch.column("before"), batch.column("key").to_numpy())}
            rows = new if held is None else {k: np.concatenate([held[k], v]) for k, v in new.items()}
            change = np.flatnonzero((rows["key"][1:] != rows["key"][:-1]) | (rows["p"][1:] != rows["p"][:-1]) | (rows["q"][1:] != rows["q"][:-1])) + 1
            edges = np.concatenate([[0], change])
            yield from found(rows, edges[:-1], edges[1:])
            held = {k: v[edges[-1]:] for k, v in rows.items()}  # the last tree may go on
        if held is not None:
            yield from found(held, np.array([0]), np.array([len(held["key"])]))

    return search


def _bound_ok(num: int, den: int):
    @F.pandas_udf("boolean")
    def check(pa_: pd.Series, pb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        most = np.array([_most_shared(a, b) for a, b in zip(pa_, pb)], dtype=np.int64)
        return pd.Series(most * (num + den) >= num * (na.to_numpy() + nb.to_numpy()))

    return check


_WORDS = re.compile(r"[^ \t-\r]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def shingles_of(text: str, width: int) -> set:
    words = _WORDS.findall(text.translate(_LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width))))


def _verified(num: int, den: int, width: int):
    @F.pandas_udf("boolean")
    def check(left: pd.Series, right: pd.Series) -> pd.Series:
        known: dict[str, set] = {}
        out = []
        for a, b in zip(left, right):
            if a not in known:
                known = {a: shingles_of(a, width)}
            one, two = known[a], shingles_of(b, width)
            both = len(one & two)
            out.append(den * both >= num * (len(one) + len(two) - both))
        return pd.Series(out, dtype=bool)

    return check


class JaccardJoin:
    """Classes of documents linked by ``den * |intersection| >= num * |union|`` of their shingle sets."""

    def __init__(self, docs: DataFrame, width: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text"):
        self.docs = docs.select(F.col(id_col).cast("bigint").alias("_id"), text_of(text_col).alias("_text"))
        self.width, self.num, self.den = width, num, den
        self.rows = signatures(docs, width, num, den, id_col, text_col)

    def run(self) -> DataFrame:
        """``_row, _id, _check, n, component_id, keep_check`` for each row; the last two tell the row of a class that stays."""
        num, den = self.num, self.den
        filled = self.rows.filter("n > 0")
        known_id = F.when(F.col("_id").isNotNull(), F.struct("_id", "_check"))
        self.nodes = stored(filled.groupBy("h1", "h2").agg(F.min("_row").alias("node"), F.min(known_id).alias("least")))
        one = filled.join(self.nodes.select(F.col("node").alias("_row")), "_row", "left_semi")
        self.points = stored(one.select(F.col("_row").alias("node"), "_id", "n", "point", "coarse", "may_drop"))
        leading = one.select(F.col("_row").alias("node"), "may_drop", F.explode("keys").alias("key"))
        often = stored(leading.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1"))
        met = stored(leading.join(often, "key"))
        frequent = F.col("many") > FREQUENT
        full = met.groupBy("node").agg(F.sum(frequent.cast("int")).alias("hot"), F.max("may_drop").alias("may_drop")).filter("hot > may_drop")
        # rows of a frequent shingle stay only for documents that have too many of those
        stay = met.filter(~frequent).select("key", "node").unionByName(
            met.filter(frequent).join(full, "node", "left_semi").select("key", "node"))
        members = stored(stay)
        released(often, met)
        leaders = members.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("many")).filter("many > 1").drop("many")
        star = members.join(leaders, "key").filter("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("times"))
        best = star.groupBy("node").agg(F.max(F.struct(F.col("times"), (-F.col("leader")).alias("minus"))).alias("best")).select(
            F.col("node").alias("a"), (-F.col("best.minus")).alias("b"))
        links = self._links(best)
        # a document goes by its leader's leader: close enough to tell which pairs are linked anyway
        up = links.select(F.col("a").alias("node"), F.col("b").alias("up"))
        labels = up.join(links.select(F.col("a").alias("up"), F.col("b").alias("top")), "up", "left").select(
            "node", F.coalesce("top", "up").alias("component"))
        pairs = self._searched(members, labels)
        released(members)
        more = self._links(pairs)
        released(pairs, self.points)
        return self._classes(self._labels(links.unionByName(more)))

    def _labels(self, links: DataFrame) -> DataFrame:
        edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        return connected_components(ends, edges)

    def _links(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs, those that the bound lets through and the texts confirm."""
        point = lambda end: self.points.select(F.col("node").alias(end), F.col("n").alias("n" + end), F.col("point").alias("p" + end))
        near = pairs.join(point("a"), "a").join(point("b"), "b").filter(
            (F.least("na", "nb") * self.den >= F.greatest("na", "nb") * self.num)).filter(
            _bound_ok(self.num, self.den)("pa", "pb", "na", "nb")).select("a", "b")
        near = stored(near)
        ends = stored(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
                      .join(self.points.select("node", "_id"), "node"))
        wanted = broadcast_if_small(ends.select(F.col("_id").alias("_want")).distinct())
        texts = self.docs.join(wanted, F.col("_id").eqNullSafe(F.col("_want")), "left_semi")
        texts = stored(self._named(texts, ends))
        text = lambda end: texts.select(F.col("node").alias(end), F.col("_text").alias("t" + end))
        joined = near.join(text("a"), "a").join(text("b"), "b").filter(_verified(self.num, self.den, self.width)("ta", "tb"))
        links = stored(joined.select("a", "b").distinct())
        released(near, ends, texts)
        return links

    def _named(self, texts: DataFrame, ends: DataFrame) -> DataFrame:
        """``node, _text``: rows that share an id are told apart by their set."""
        width = self.width

        # a function as a column would be computed once more for the join's null check, by a second worker beside the first
        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = [int(mix(s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0
                        for s in shingle_sets(batch.column(0).to_pylist(), width)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], names=["_text", "h1"])

        own = ends.join(self.nodes.select("node", "h1"), "node").select("node", "h1")
        return arrow(texts.select("_text"), hashed, "_text string, h1 bigint").join(own, "h1").select("node", "_text").dropDuplicates(["node"])

    def _searched(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs of different classes that the trees of open shingles let through."""
        num, den = self.num, self.den
        marked = members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
        marked = stored(marked)
        h = F.xxhash64("node")
        open_ = marked.groupBy("key").agg(
            F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("many"), F.sum(h % 1_000_000_007).alias("s1"),
            F.bit_xor(h).alias("s2")).filter("lo <> hi")
        # near copies share many shingles: of trees with the same documents, one is searched
        open_ = stored(open_.groupBy("many", "lo", "hi", "s1", "s2").agg(F.min("key").alias("key")).select("key", "many"))
        # a large tree is built in parts; a point goes to every pair of parts it is in
        parts = F.ceil(F.col("many") / TREE_POINTS).cast("int")
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        before = F.collect_list("key").over(Window.partitionBy("node").orderBy("key").rowsBetween(-BEFORE, -1))
        placed = marked.join(open_, "key").withColumn("before", before).join(self.points.select("node", "n", "coarse"), "node")
        rows = placed.withColumn("parts", parts).withColumn("own", own).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
            "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "label", "n", "coarse", "before")
        trees = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
        pairs = stored(arrow(trees, _search_trees(self.num, self.den), "a bigint, b bigint").distinct())
        released(marked, open_)
        return pairs

    def _classes(self, labels: DataFrame) -> DataFrame:
        known = self.nodes.join(labels, "node", "left").select("h1", "h2", "least", F.coalesce("component", "node").alias("label"))
        least = stored(known.groupBy("label").agg(F.min("least").alias("one")))
        named = stored(known.join(least, "label").select("h1", "h2", F.col("one._id").alias("component_id"), F.col("one._check").alias("keep_check")))
        linked = self.rows.filter("n > 0").select("_row", "_id", "_check", "n", "h1", "h2").join(named, ["h1", "h2"]).select(
            "_row", "_id", "_check", "n", "component_id", "keep_check")
        alone = self.rows.filter("n = 0").select(
            "_row", "_id", "_check", "n", F.col("_id").alias("component_id"), F.col("_check").alias("keep_check"))
        return linked.unionByName(alone)


def jaccard_classes(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` for each row: the smallest id reachable by links, itself included.

    Null and empty texts have no shingles and link with nothing. Rows with equal sets link, rows that repeat an id
    included; a class of only null ids has a null class id. An empty table gives an empty result; other columns are
    not read.
    """
    return JaccardJoin(docs, width, num, den, id_col, text_col).run().select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, that of the smallest id; columns unchanged. Documents without words
    and null ids all stay. Rows that share an id but not a text are documents of their own."""
    found = JaccardJoin(docs, width, num, den, id_col, text_col).run().filter("_id <> component_id or _check <> keep_check")
    gone = broadcast_if_small(stored(found.select(F.col("_id").alias("_gone"), F.col("_check").alias("_gone_check")).distinct()))
    same = (F.col(id_col) == F.col("_gone")) & (F.xxhash64(text_of(text_col)) == F.col("_gone_check"))
    return docs.join(gone, same, "left_anti")
