"""Scaling, principal components, k-means, silhouettes and density clusters."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayweave.operators.components import radius_components, square_of, square_offsets
from stayweave.operators.filters import sample_rows
from stayweave.operators.graph import dense_ids
from stayweave.session import broadcast_or_shuffle, by_shuffle, cut_lineage, released


def standardise(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with mean 0 and population standard deviation 1; a constant column becomes 0."""
    stats = rows.agg(*[f(c).alias(f"{p}{c}") for c in columns for p, f in (("m_", F.avg), ("s_", F.stddev_pop))]).first()
    return rows.withColumns({
        c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns})


def min_max(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to [0, 1]; a constant column becomes 0."""
    stats = rows.agg(*[f(c).alias(f"{p}{c}") for c in columns for p, f in (("l_", F.min), ("h_", F.max))]).first()
    out = {}
    for c in columns:
        span = (stats[f"h_{c}"] - stats[f"l_{c}"]) or 1.0
        out[c] = (F.col(c) - F.lit(stats[f"l_{c}"])).cast("double") / F.lit(float(span))
    return rows.withColumns(out)


def to_vector(rows: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return rows.withColumn(name, array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))


def principal_components(rows: DataFrame, dims: int, keep: float | None = None, k: int | None = None,
                         features: str = "features") -> tuple[DataFrame, list[float]]:
    """Add ``pca`` (array) of centred features and return the variance ratios.

    Give ``k`` components, or the share of variance to ``keep``.
    """
    model = PCA(k=dims if keep is not None else k, inputCol=features, outputCol="_pca").fit(rows)
    ratios = [float(v) for v in model.explainedVariance]
    if keep is not None:
        k = min(int(np.searchsorted(np.cumsum(ratios), keep - 1e-12) + 1), dims)
    projected = model.transform(rows).withColumn("pca", F.slice(vector_to_array("_pca"), 1, k)).drop("_pca")
    middle = projected.agg(*[F.avg(F.col("pca")[i]) for i in range(k)]).first()
    centred = F.array(*[F.col("pca")[i] - F.lit(middle[i]) for i in range(k)])
    return projected.withColumn("pca", centred), ratios[:k]


#: Iterations after which a fit gives up, with a warning.
MAX_ITER = 300


def _fitted(kmeans: KMeans, rows: DataFrame):
    model = kmeans.fit(rows)
    if model.summary.numIter >= kmeans.getMaxIter():
        warnings.warn(f"k = {kmeans.getK()}: not converged after {kmeans.getMaxIter()} iterations", stacklevel=3)
    return model


def k_means(rows: DataFrame, k: int, features: str = "features", name: str = "group", seed: int = 42,
            first_label: int = 0, max_iter: int = MAX_ITER) -> DataFrame:
    """Add the cluster number of each row, counted from ``first_label``."""
    model = _fitted(KMeans(k=k, seed=seed, initMode="k-means||", featuresCol=features, predictionCol=name, maxIter=max_iter), rows)
    return model.transform(rows).withColumn(name, F.col(name) + first_label)


def k_sweep(rows: DataFrame, ks: range, features: str = "features", seed: int = 42) -> DataFrame:
    """Cost and silhouette (squared Euclidean, all rows) for each number of clusters."""
    rows = cut_lineage(rows.select(features))
    judge = ClusteringEvaluator(featuresCol=features, predictionCol="group")
    scores = []
    for k in ks:
        model = _fitted(KMeans(k=k, seed=seed, featuresCol=features, predictionCol="group", maxIter=MAX_ITER), rows)
        scores.append((k, float(model.summary.trainingCost), float(judge.evaluate(model.transform(rows)))))
    return rows.sparkSession.createDataFrame(scores, "k int, cost double, silhouette double")


def silhouette(rows: DataFrame, vector: str, label: str, key: str, sample: int = 10_000, seed: int = 42) -> DataFrame:
    """One row: mean Euclidean silhouette of a sample, each sampled row against the whole sample.

    ``vector`` is an array column. The sample is the bound of what is broadcast.
    """
    drawn = cut_lineage(sample_rows(rows.select(key, vector, label), sample, key, seed))
    local = drawn.toPandas()
    points = np.array(local[vector].tolist(), dtype=float)
    labels, codes = np.unique(local[label].to_numpy(), return_inverse=True)
    shared = rows.sparkSession.sparkContext.broadcast((points, codes, len(labels), {v: i for i, v in enumerate(labels)}))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        others, code, groups, number = shared.value
        sizes = np.bincount(code, minlength=groups)
        norms = (others * others).sum(axis=1)
        for batch in batches:
            mine = np.array(batch[vector].tolist(), dtype=float)
            own = batch[label].map(number).to_numpy()
            squared = (mine * mine).sum(axis=1)[:, None] + norms[None, :] - 2 * mine @ others.T
            far = np.sqrt(np.maximum(squared, 0.0))
            sums = np.stack([far[:, code == g].sum(axis=1) for g in range(groups)], axis=1)
            at = np.arange(len(mine))
            inner = sums[at, own] / np.maximum(sizes[own] - 1, 1)
            means = sums / sizes[None, :]
            means[at, own] = np.inf
            outer = means.min(axis=1)
            top = np.maximum(inner, outer)
            value = np.where((sizes[own] > 1) & (top > 0), (outer - inner) / np.where(top > 0, top, 1.0), 0.0)
            yield pd.DataFrame({"s": value})

    return drawn.repartition(F.col(key)).mapInPandas(score, "s double").agg(F.avg("s").alias("silhouette"))


def dbscan(points: DataFrame, key: str, x: str, y: str, eps: float, min_samples: int = 5) -> DataFrame:
    """Add ``cluster``: a number from 0 per dense cluster, -1 for noise. Two dimensions.

    Points fall into squares so small that squares near each other lie wholly within ``eps``. A
    square with enough company needs no distance at all; exact distances are only taken for points
    of thin squares, of which each square has fewer than ``min_samples``. A border point joins the
    smallest cluster it touches.
    """
    rows = points.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).withColumns({
        "sx": square_of("x", eps), "sy": square_of("y", eps)})
    spots = cut_lineage(rows.groupBy("x", "y", "sx", "sy").agg(F.count("*").alias("n")))
    squares = cut_lineage(spots.groupBy("sx", "sy").agg(F.sum("n").alias("n")))
    sure, partial = square_offsets()

    def around(table: DataFrame, offsets, own: bool) -> DataFrame:
        """Rows repeated for every square at the offsets, both signs, as ``tx, ty``."""
        moves = [(dx, dy) for a, b in offsets for dx, dy in ((a, b), (-a, -b))] + [(0, 0)] * own
        moves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in moves])
        return table.withColumn("_m", F.explode(moves)).withColumns({
            "tx": F.col("sx") + F.col("_m.dx"), "ty": F.col("sy") + F.col("_m.dy")}).drop("_m")

    occupied = broadcast_or_shuffle(squares)
    company = around(squares.select("sx", "sy"), sure, True).join(
        occupied.select(F.col("sx").alias("tx"), F.col("sy").alias("ty"), "n"), ["tx", "ty"]
    ).groupBy("sx", "sy").agg(F.sum("n").alias("near"))
    placed = cut_lineage(spots.join(by_shuffle(company), ["sx", "sy"]))
    thin = placed.filter(F.col("near") < min_samples)
    held = broadcast_or_shuffle(spots)
    far = held.select(F.col("sx").alias("tx"), F.col("sy").alias("ty"), F.col("x").alias("ox"), F.col("y").alias("oy"), "n")
    close = F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2) <= eps * eps
    counted = around(thin.select("x", "y", "sx", "sy"), partial, False).join(far, ["tx", "ty"]).filter(close).groupBy(
        "x", "y").agg(F.sum("n").alias("more"))
    judged = cut_lineage(placed.join(by_shuffle(counted), ["x", "y"], "left").withColumn(
        "core", F.col("near") + F.coalesce("more", F.lit(0)) >= min_samples).select("x", "y", "sx", "sy", "core"))
    released(spots, squares, placed)
    core = cut_lineage(radius_components(judged.filter("core").select("x", "y"), [], eps, name="_c").select(
        "x", "y", square_of("x", eps).alias("sx"), square_of("y", eps).alias("sy"), "_c"))
    border = judged.filter("not core").select("x", "y", "sx", "sy")
    core_squares = broadcast_or_shuffle(cut_lineage(
        core.select(F.col("sx").alias("tx"), F.col("sy").alias("ty"), "_c").distinct()))
    touched = around(border, sure, True).join(core_squares, ["tx", "ty"]).select("x", "y", "_c")
    core_points = broadcast_or_shuffle(core).select(
        F.col("sx").alias("tx"), F.col("sy").alias("ty"), F.col("x").alias("ox"), F.col("y").alias("oy"), "_c")
    touched = touched.unionByName(
        around(border, partial, False).join(core_points, ["tx", "ty"]).filter(close).select("x", "y", "_c"))
    labelled = core.select("x", "y", "_c").unionByName(touched.groupBy("x", "y").agg(F.min("_c").alias("_c")))
    numbers = cut_lineage(dense_ids(core.select("_c"), "_c", "cluster"))
    named = labelled.join(broadcast_or_shuffle(numbers), "_c").select("x", "y", "cluster")
    return rows.join(by_shuffle(named), ["x", "y"], "left").select(
        key, "x", "y", F.coalesce(F.col("cluster").cast("int"), F.lit(-1)).alias("cluster"))


def cluster_counts(labelled: DataFrame, label: str = "cluster") -> DataFrame:
    """Number of clusters and of noise points."""
    return labelled.agg(
        F.countDistinct(F.when(F.col(label) >= 0, F.col(label))).alias("clusters"),
        F.count_if(F.col(label) < 0).alias("noise"))
