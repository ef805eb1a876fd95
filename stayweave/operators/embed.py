"""Node embeddings from walks: skip-gram with negative samples, trained block by block.

Nodes are hashed into blocks, and node pairs into cells of two blocks. In a turn every block meets one other, so the
cells of a turn share no vector and are trained side by side: a task gets the vectors of its two blocks and streams the
cell's pairs, in hash order, through small steps of Adam with negatives drawn from the same blocks. One shuffle brings both
together; turns follow until every two blocks, and each block alone, have met. A block's size is bounded, so more nodes
make more blocks and more tasks; the pairs of a hub spread over all cells of its block and are never held at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayweave import constants as C
from stayweave.functions.geo import hex_boundary
from stayweave.operators.walks import TYPE_BITS
from stayweave.session import cut_lineage, released

# Adam's decay rates and guard.
DECAY_1, DECAY_2, GUARD = 0.9, 0.999, 1e-8
#: Nodes of a block (a task holds two), blocks at least (an even number), and pairs of a step.
BLOCK_NODES, MIN_BLOCKS, BATCH = 50_000, 4, 1024
#: Negatives a batch draws for each one a pair is to have: pairs share them.
POOL = 32


def context_pairs(walks: DataFrame, context: int = C.CONTEXT_SIZE) -> DataFrame:
    """Weighted ``(src, dst, weight)``: how often ``dst`` follows ``src`` within the window."""
    nodes = F.col("nodes")
    pairs = F.flatten(F.transform(nodes, lambda n, i: F.transform(
        F.slice(nodes, i + 2, F.lit(context - 1)), lambda m: F.struct(n.alias("src"), m.alias("dst")))))
    return walks.select(F.explode(pairs).alias("p")).groupBy("p.src", "p.dst").agg(F.count("*").alias("weight"))


class BlockTrainer:
    """Vectors of the nodes a task holds, and steps of Adam over batches of weighted pairs of them."""

    def __init__(self, ids: np.ndarray, state: list[np.ndarray], rate: float, negatives: int, seed: list[int]):
        order = np.argsort(ids)
        self.ids, (self.vec, self.m, self.v, self.n) = ids[order], [x[order] for x in state]
        self.rate, self.negatives, self.draws = rate, negatives, np.random.default_rng(seed)
        kinds = self.ids >> TYPE_BITS
        # ids of one type are neighbours here, so a negative of a node's type is a draw from a range
        self.low = np.searchsorted(kinds, kinds, "left")
        self.size = np.searchsorted(kinds, kinds, "right") - self.low

    def step(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> float:
        """One step; the loss of the batch before it. The pairs of a batch with targets of one type share a pool of drawn
        nodes of that type, the negatives of each of them."""
        s, d = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        w = (weight / weight.sum()).astype(np.float32)
        a, b = self.vec[s], self.vec[d]
        near = 1 / (1 + np.exp(-np.einsum("ij,ij->i", a, b)))
        loss = -(w * np.log(near + 1e-15)).sum()
        g = ((near - 1) * w)[:, None]
        rows, pulls, from_pool = [s, d], [g * b, g * a], np.zeros_like(a)
        low = self.low[d]
        for first in np.unique(low):
            own = np.flatnonzero(low == first)
            pool = first + (self.draws.random(self.negatives * POOL) * self.size[d[own[0]]]).astype(np.int64)
            c = self.vec[pool]
            far = 1 / (1 + np.exp(-(a[own] @ c.T)))
            loss -= (w[own] * np.log(1 - far + 1e-15).mean(axis=1)).sum()
            h = far * (w[own] / len(pool))[:, None]
            from_pool[own] = h @ c
            rows.append(pool)
            pulls.append(h.T @ a[own])
        pulls[0] += from_pool
        rows, pulls = np.concatenate(rows), np.concatenate(pulls)
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.diff(rows[order], prepend=-1))
        self._move(rows[order][first], np.add.reduceat(pulls[order], first, axis=0))
        return float(loss)

    def _move(self, rows: np.ndarray, grad: np.ndarray) -> None:
        """Adam on the rows of a batch alone; each row corrects by how often it has moved."""
        self.n[rows] += 1
        m = self.m[rows] = np.float32(DECAY_1) * self.m[rows] + np.float32(1 - DECAY_1) * grad
        v = self.v[rows] = np.float32(DECAY_2) * self.v[rows] + np.float32(1 - DECAY_2) * grad * grad
        turns = self.n[rows].astype(np.float64)
        pace = (self.rate / (1 - DECAY_1**turns)).astype(np.float32)[:, None]
        spread = (1 / np.sqrt(1 - DECAY_2**turns)).astype(np.float32)[:, None]
        self.vec[rows] -= pace * m / (np.sqrt(v) * spread + np.float32(GUARD))


def _partner(blocks: int, turn: int) -> list[int]:
    """For each block, the lower number of the pair it is in: of a tournament where every two blocks meet once, and the
    last turn leaves each block alone."""
    if turn == blocks - 1:
        return list(range(blocks))
    last, ring = blocks - 1, blocks - 1
    out = []
    for b in range(blocks):
        other = turn * (blocks // 2) % ring if b == last else (turn - b) % ring
        out.append(min(b, last if other == b else other))
    return out


def _turn(low: Column, high: Column, blocks: int) -> Column:
    """The turn in which two blocks meet."""
    ring = max(blocks - 1, 1)
    met = F.when(high == blocks - 1, (2 * low) % ring).otherwise((low + high) % ring)
    return F.when(low == high, blocks - 1).otherwise(met)


def _first_vectors(ids: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Small vectors that depend on the node's id alone."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x += np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24) - np.float32(0.5)) / np.float32(dim**0.5)


def _trained(rows: DataFrame, dim: int, rate: float, negatives: int, batch: int, log_steps: int, seed: list[int]) -> DataFrame:
    """Train each partition's pairs on its vectors. A partition has its nodes first, then the pairs in their order.

    A node's ``state`` is its vector and Adam's two means as 32-bit floats, NULL before the first turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, trainer, losses = [], None, []
        left = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]

        def begun() -> BlockTrainer:
            ids, n = (np.concatenate([h[k] for h in held] + [np.zeros(0, dtype=np.int64)]) for k in (0, 2))
            state = np.zeros((len(ids), 3, dim), dtype=np.float32)
            at = 0
            for own, raw, _ in held:
                for k, one in enumerate(raw):
                    if one is None:
                        state[at + k, 0] = _first_vectors(own[k:k + 1], dim, seed[0])[0]
                    else:
                        state[at + k] = np.frombuffer(one, dtype="<f4").reshape(3, dim)
                at += len(own)
            return BlockTrainer(ids, [*(np.ascontiguousarray(state[:, k]) for k in range(3)), n], rate, negatives,
                                [*seed, TaskContext.get().partitionId()])

        def train(pairs: list[np.ndarray], least: int) -> list[np.ndarray]:
            at = 0
            while len(pairs[0]) - at >= least and at < len(pairs[0]):
                src, dst, weight = (x[at:at + batch] for x in pairs)
                losses.append((trainer.step(src, dst, weight), weight.sum()))
                at += batch
            return [x[at:] for x in pairs]

        for part in batches:
            is_pair = part.column("is_pair").to_numpy(zero_copy_only=False)
            nodes, pairs = part.filter(pa.array(~is_pair)), part.filter(pa.array(is_pair))
            if nodes.num_rows:
                held.append((nodes.column("id").to_numpy(), nodes.column("state").to_pylist(), nodes.column("n").to_numpy().astype(np.int64)))
            if pairs.num_rows:
                trainer = trainer or begun()
                own = [pairs.column(c).to_numpy() for c in ("src", "dst", "weight")]
                left = train([np.concatenate(x) for x in zip(left, own)], batch)
        if trainer is None and held:
            trainer = begun()
        if trainer is not None:
            train(left, 1)
            state = np.stack([trainer.vec, trainer.m, trainer.v], axis=1).astype("<f4")
            for at in range(0, len(state), 4096):
                own = state[at:at + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(trainer.ids[at:at + 4096]), pa.array([x.tobytes() for x in own], pa.binary()),
                     pa.array(trainer.n[at:at + 4096], pa.int32()), pa.nulls(len(own), pa.int32()), pa.nulls(len(own), pa.float64()),
                     pa.nulls(len(own), pa.float64())], names=names)
        if losses:
            loss, weight = (np.array(x) for x in zip(*losses))
            edges = np.arange(0, len(loss), log_steps)
            total, mass = np.add.reduceat(loss * weight, edges), np.add.reduceat(weight, edges)
            k = len(edges)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32()),
                 pa.array(np.minimum(edges + log_steps, len(loss)), pa.int32()), pa.array(total), pa.array(mass)], names=names)

    names = ["id", "state", "n", "step", "loss", "mass"]
    return rows.mapInArrow(run, "id bigint, state binary, n int, step int, loss double, mass double")


def _vectors(state: DataFrame, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.frombuffer(b, dtype="<f4")[:dim].astype(np.float64) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["id", "vec"])

    return state.select("id", "state").mapInArrow(run, "id bigint, vec array<double>")


def skip_gram(nodes: DataFrame, walks: DataFrame, dim: int = C.EMBEDDING_DIM, context: int = C.CONTEXT_SIZE,
              negatives: int = C.NEGATIVE_SAMPLES, epochs: int = 6, rate: float = 0.01, patience: int = 5,
              min_delta: float = 0.0005, seed: int = 42, batch: int = BATCH, log_steps: int = 50,
              blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Embed the nodes seen by the walks: ``(id, vec)`` and the loss history ``(epoch, step, loss)``.

    ``nodes`` has ``id`` for every node, ``walks`` has ``nodes``. An epoch goes once over all pairs in batches of
    ``batch``; every ``log_steps`` batches give a row of the history, the mean over the tasks that ran side by side. Within
    an epoch, ``patience`` such rows in a row that don't fall by ``min_delta`` end the training after that epoch.
    """
    spark = nodes.sparkSession
    if blocks is None:
        needed = -(-nodes.count() // BLOCK_NODES)
        blocks = max(MIN_BLOCKS, needed + needed % 2)
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(blocks)).cast("int")
    low, high = F.least(block("src"), block("dst")), F.greatest(block("src"), block("dst"))
    pairs = cut_lineage(context_pairs(walks, context).select(
        "src", "dst", F.col("weight").cast("double").alias("weight"), low.alias("task"), _turn(low, high, blocks).alias("turn")))
    state, written = nodes.select("id", F.lit(None).cast("binary").alias("state"), F.lit(0).alias("n")), None
    history, stop = [], False
    for epoch in range(1, epochs + 1):
        done = 0
        for turn in range(blocks):
            place = F.array(*map(F.lit, _partner(blocks, turn)))
            own = state.withColumns({"task": F.get(place, block("id")), "is_pair": F.lit(False), "key": F.lit(0).cast("bigint")})
            met = pairs.filter(F.col("turn") == turn).drop("turn").withColumns(
                {"is_pair": F.lit(True), "key": F.xxhash64("src", "dst", F.lit(seed), F.lit(epoch))})
            rows = own.unionByName(met, allowMissingColumns=True).repartitionById(blocks, "task").sortWithinPartitions(
                "is_pair", "key", "src", "dst")
            after = cut_lineage(_trained(rows, dim, rate, negatives, batch, log_steps, [seed, epoch, turn]))
            losses = after.filter(F.col("id").isNull()).groupBy("step").agg(F.sum("loss"), F.sum("mass")).collect()  # a row per 50 batches
            if written is not None:
                released(written)
            written, state = after, after.filter(F.col("id").isNotNull()).select("id", "state", "n")
            history += [(epoch, done + r[0], r[1] / r[2]) for r in sorted(losses)]
            done += max((r[0] for r in losses), default=0)
        if stalled([r[2] for r in history if r[0] == epoch], patience, min_delta):
            break
    return _vectors(state, dim), spark.createDataFrame(history, "epoch int, step int, loss double")


def stalled(losses: list[float], patience: int, min_delta: float) -> bool:
    """Whether ``patience`` losses in a row were no gain of ``min_delta`` over the best before."""
    best, waited = float("inf"), 0
    for loss in losses:
        best, waited = (loss, 0) if loss < best - min_delta else (best, waited + 1)
        if waited >= patience:
            return True
    return False


def export_embeddings(vectors: DataFrame, nodes: DataFrame, node_type: str, labels: DataFrame | None = None,
                      wide: bool = False) -> DataFrame:
    """Vectors of one node type with number, key and, if given, label; ``wide`` spreads them to x0, x1, ..."""
    out = nodes.filter(F.col("node_type") == node_type).join(vectors, "id").select(
        F.col("idx").alias("node_idx"), "key", "vec")
    if labels is not None:
        out = out.join(labels, "key", "left")
    if not wide:
        return out
    dim = F.size("vec")
    width = out.select(dim.alias("d")).first()["d"]
    return out.select(*[c for c in out.columns if c != "vec"], *[F.col("vec")[i].alias(f"x{i}") for i in range(width)])


def with_zone_and_home(embeddings: DataFrame, zones: DataFrame, homes: DataFrame, prefix: str, length: int = 3) -> DataFrame:
    """Device embeddings of the zones that start with ``prefix``, with the shortened zone and the home point."""
    zoned = embeddings.join(zones.select("device_aid", "deso"), "device_aid", "left").filter(
        F.col("deso").startswith(prefix))
    return zoned.withColumn("deso_r", F.substring("deso", 1, length)).join(
        homes.select("device_aid", "latitude", "longitude"), "device_aid", "left")


def with_cell_shapes(clusters: DataFrame, cells: DataFrame) -> DataFrame:
    """Every row of the cluster table with the outline of its cell, where ``cells`` has one."""
    shapes = cells.select("h3_id").distinct().withColumn("outline", hex_boundary("h3_id"))
    return shapes.join(clusters, "h3_id", "right")
