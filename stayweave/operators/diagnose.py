"""Prediction from embeddings, reports on predictions, and checks of embeddings and training."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayweave import constants as C
from stayweave.operators.cluster import principal_components
from stayweave.operators.filters import sample_rows, stable_hash
from stayweave.operators.graph import dense_ids
from stayweave.operators.weights import t_test_p
from stayweave.session import cut_lineage


def predict_labels(rows: DataFrame, features: str, label: str, key: str, test_share: float = 0.2,
                   seed: int = 42, max_iter: int = 500) -> DataFrame:
    """Held-out rows with ``prediction`` of a class-balanced logistic regression.

    The split is a hash of the key, so it repeats. A fit that reaches ``max_iter`` before it converges warns.
    """
    held = stable_hash(key, seed) < int(test_share * 2**32)
    rows = cut_lineage(rows.select(key, features, F.col(label).cast("double").alias("label"), held.alias("_test")))
    train = rows.filter("not _test")
    sizes = cut_lineage(train.groupBy("label").agg(F.count("*").alias("_c")))
    n, classes = sizes.agg(F.sum("_c"), F.count("*")).first()
    # One row per class.
    weighted = train.join(F.broadcast(sizes), "label").withColumn("_w", F.lit(float(n)) / (F.lit(classes) * F.col("_c")))
    model = LogisticRegression(featuresCol=features, labelCol="label", weightCol="_w", regParam=1.0 / n,
                               standardization=False, maxIter=max_iter).fit(weighted)
    if model.summary.totalIterations >= max_iter:
        warnings.warn(f"not converged after {max_iter} iterations", stacklevel=2)
    return model.transform(rows.filter("_test")).select(
        key, F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


def confusion(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Count and share within the true label of each (label, prediction)."""
    cells = rows.groupBy(label, prediction).agg(F.count("*").alias("n"))
    totals = cells.groupBy(label).agg(F.sum("n").alias("_t"))
    return cells.join(totals, label).select(label, prediction, "n", (F.col("n") / F.col("_t")).alias("share"))


def classification_report(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per label, with accuracy, macro and weighted rows."""
    cells = rows.groupBy(F.col(label).cast("string").alias("a"), F.col(prediction).cast("string").alias("b")).agg(
        F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("true"), F.lit(0).cast("bigint").alias("said")),
        F.struct(F.col("b").alias("label"), F.lit(0).cast("bigint").alias("true"), F.col("n").alias("said")))).alias("s"),
        F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("hit"))
    per = sides.select("s.*", "hit").groupBy("label").agg(
        F.sum("true").alias("support"), F.sum("said").alias("said"), (F.sum("hit") / 2).alias("hit"))
    zero = F.lit(0.0)
    per = per.withColumns({
        "precision": F.coalesce(F.try_divide("hit", "said"), zero),
        "recall": F.coalesce(F.try_divide("hit", "support"), zero)})
    per = per.withColumn("f1", F.coalesce(F.try_divide(
        2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))
    scores = ["precision", "recall", "f1"]
    n = F.sum("support")
    macro = per.agg(*[F.avg(s).alias(s) for s in scores], n.alias("support")).select(
        F.lit("macro avg").alias("label"), *scores, "support")
    weighted = per.agg(*[(F.sum(F.col(s) * F.col("support")) / n).alias(s) for s in scores], n.alias("support")).select(
        F.lit("weighted avg").alias("label"), *scores, "support")
    accuracy = per.agg((F.sum("hit") / n).alias("f1"), n.alias("support")).select(
        F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), "f1", "support")
    return per.select("label", *scores, "support").unionByName(accuracy).unionByName(macro).unionByName(weighted)


def embedding_stats(rows: DataFrame, vector: str) -> DataFrame:
    """One row: mean, std, min, max, mean L2 norm, and the number of dimensions with little variance."""
    long = rows.select(F.posexplode(F.col(vector)).alias("d", "v")).withColumn("v", F.col("v").cast("double"))
    per_dim = long.groupBy("d").agg(
        F.var_pop("v").alias("var"), F.count("v").alias("n"), F.avg("v").alias("own"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # variances within the dimensions and of their means: no difference of large squares
    centre = F.sum(F.col("n") * F.col("own")) / F.sum("n")
    flat = per_dim.agg(
        centre.alias("mean"), F.collect_list(F.struct("n", "own", "var")).alias("_dims"), F.min("lo").alias("min"),
        F.max("hi").alias("max"), F.count_if(F.col("var") < C.LOW_VARIANCE).alias("low_var_dims"))
    apart = F.aggregate("_dims", F.lit(0.0), lambda s, d: s + d["n"] * (d["var"] + F.pow(d["own"] - F.col("mean"), 2)))
    total = F.aggregate("_dims", F.lit(0.0), lambda s, d: s + d["n"])
    flat = flat.select("mean", F.sqrt(apart / total).alias("std"), "min", "max", "low_var_dims")
    squares = F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    norms = rows.agg(F.avg(F.sqrt(squares)).alias("l2")).select("l2").scalar()
    return flat.withColumn("l2_mean", norms)


def _unit(vector: str):
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def cosine_summary(rows: DataFrame, vector: str, key: str, sample: int = C.COSINE_SAMPLE, seed: int = 42,
                   blocks: int = 8) -> DataFrame:
    """One row: mean, std, min and max of the cosine similarity of all pairs in a sample.

    The sample is the feature and bounds the pairs. Rows fall into blocks, and block pairs are the
    keys of the join, so each pair is made once and the work spreads over tasks.
    """
    drawn = cut_lineage(sample_rows(rows.select(key, vector), sample, key, seed).select(
        F.col(key).alias("id"), _unit(vector).alias("u"), (stable_hash(key, seed + 1) % blocks).cast("int").alias("blk")))
    left = drawn.select(F.col("id").alias("i"), F.col("u").alias("a"), F.col("blk").alias("bi"),
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("bj"))
    right = drawn.select(F.col("id").alias("j"), F.col("u").alias("b"), F.col("blk").alias("bj"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("bi"))
    cosine = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = left.join(right, ["bi", "bj"]).filter("i < j").select(cosine.alias("c"))
    return pairs.agg(F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"), F.min("c").alias("min"),
                     F.max("c").alias("max"), F.count("*").alias("pairs")).withColumn(
        "verdict", F.when(F.col("mean") > C.COSINE_HIGH, "collapsed").when(F.col("mean") < C.COSINE_LOW, "diverse")
        .otherwise("moderate"))


def correlations(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson r, number of pairs and two-sided p-value of each column pair."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.corr(a, b).alias(f"r{i}"), F.count_if(both).alias(f"n{i}")]
    flat = rows.agg(*aggs).select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
        for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")
    return flat.withColumn("p", F.when(F.col("r").isNotNull(), t_test_p("r", "n"))).withColumn(
        "significant", F.coalesce(F.col("p") < 0.05, F.lit(False)))


def _fold_grams(width: int):
    """Per fold, the cross products of (1, features, target): one small table per task."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z = np.column_stack([np.ones(len(batch)), np.array(batch["f"].tolist(), dtype=float), batch["y"]])
            fold = batch["fold"].to_numpy()
            for f in np.unique(fold):
                part = z[fold == f]
                sums[f] = sums.get(f, 0) + part.T @ part
        for f, gram in sums.items():
            i, j = np.divmod(np.arange(width * width), width)
            yield pd.DataFrame({"fold": int(f), "i": i, "j": j, "v": gram.ravel()})

    return work


def ridge_cv(rows: DataFrame, features: str, target: str, key: str, alpha: float = 1.0, folds: int = 5,
             min_rows: int = 50) -> DataFrame:
    """R2 of each held-out fold of a ridge regression; empty with ``min_rows`` rows or fewer.

    Folds are consecutive blocks of rows in key order. Each task adds up cross products of its rows;
    only those small square tables, one per fold, are solved on the driver.
    """
    known = cut_lineage(rows.filter(F.col(target).isNotNull()).select(key, F.col(features).alias("f"),
                                                                      F.col(target).cast("double").alias("y")))
    n = known.count()
    spark = rows.sparkSession
    if n <= min_rows:
        return spark.createDataFrame([], "fold int, r2 double")
    width = len(known.select("f").first()["f"]) + 2
    # The first n % folds folds take one row more.
    size, extra = divmod(n, folds)
    cut = extra * (size + 1)
    fold = F.when(F.col("idx") < cut, F.floor(F.col("idx") / (size + 1))).otherwise(
        extra + F.floor((F.col("idx") - cut) / size)).cast("int")
    numbered = known.join(dense_ids(known, key), key).select(fold.alias("fold"), "f", "y")
    table = numbered.mapInPandas(_fold_grams(width), "fold int, i int, j int, v double").groupBy(
        "fold", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    grams = np.zeros((folds, width, width))
    grams[table["fold"], table["i"], table["j"]] = table["v"]
    scores = []
    for f in range(folds):
        train, test = grams.sum(axis=0) - grams[f], grams[f]
        count, mean = train[0, 0], train[0, 1:] / train[0, 0]
        centred = train[1:, 1:] - count * np.outer(mean, mean)
        beta = np.linalg.solve(centred[:-1, :-1] + alpha * np.eye(width - 2), centred[:-1, -1])
        w = np.concatenate([[mean[-1] - beta @ mean[:-1]], beta, [-1.0]])
        residual = w @ test @ w
        spread = test[-1, -1] - test[0, -1] ** 2 / test[0, 0]
        scores.append((f, float(1 - residual / spread)))
    return spark.createDataFrame(scores, "fold int, r2 double")


def ridge_index(rows: DataFrame, features: str, targets: list[str], key: str, alpha: float = 1.0, folds: int = 5,
                min_rows: int = 50) -> DataFrame:
    """``target, n, mean, std, verdict``: held-out R2 of a ridge regression of each target over ``folds`` folds.

    Rows count where all targets are known. A mean above ``RIDGE_SIGNAL`` is a signal; with ``min_rows`` rows or
    fewer nothing is fitted, and the verdict says so.
    """
    known = rows.filter(" and ".join(f"`{t}` is not null and not isnan(`{t}`)" for t in targets)).select(key, features, *targets)
    known = cut_lineage(known)
    n, out = known.count(), []
    for target in targets:
        scores = [r["r2"] for r in ridge_cv(known, features, target, key, alpha, folds, min_rows).collect()]  # a row per fold
        if not scores:
            out.append((target, n, None, None, "too few rows"))
        else:
            mean = float(np.mean(scores))
            out.append((target, n, mean, float(np.std(scores)), "signal" if mean > C.RIDGE_SIGNAL else "little"))
    return rows.sparkSession.createDataFrame(out, "target string, n bigint, mean double, std double, verdict string")


def component_correlations(rows: DataFrame, features: str, targets: list[str], k: int = 2) -> DataFrame:
    """``a, b, r, n, p, significant``: each target against each of the first ``k`` principal components of an array column.

    A component has no sign of its own; it gets the one by which its r with the first target is not negative.
    """
    known = cut_lineage(rows.select(*targets, array_to_vector(F.transform(features, lambda v: v.cast("double"))).alias("features")))
    parts, _ = principal_components(known, k, k=k)
    names = [f"pc{i + 1}" for i in range(k)]
    wide = parts.select(*targets, *[F.col("pca")[i].alias(n) for i, n in enumerate(names)])
    found = correlations(wide, [(t, n) for t in targets for n in names])
    first = found.filter(F.col("a") == targets[0]).select("b", F.when(F.col("r") < 0, -1.0).otherwise(1.0).alias("_s"))
    return found.join(F.broadcast(first), "b").select("a", "b", (F.col("r") * F.col("_s")).alias("r"), "n", "p", "significant")  # k rows


def loss_checks(losses: DataFrame, run: str = "run") -> DataFrame:
    """First and last loss of each run, the reduction in percent and whether it converged."""
    ends = losses.groupBy(run).agg(
        F.count("*").alias("steps"), F.min_by("loss", "step").alias("first_loss"),
        F.max_by("loss", "step").alias("last_loss"))
    return ends.withColumns({
        "reduction": 100 * (1 - F.try_divide("last_loss", "first_loss")),
        "converged": ~(F.col("last_loss") > F.col("first_loss") * C.LOSS_CONVERGED)})


def health_issues(cells: DataFrame, cosine: DataFrame, losses: DataFrame) -> DataFrame:
    """Issues found, one row each: loss not converged, embeddings collapsed, too few cells."""
    return losses.filter("not converged").limit(1).select(F.lit("loss did not converge").alias("issue")).unionByName(
        cosine.filter(F.col("mean") > C.COSINE_COLLAPSED).select(F.lit("embeddings collapsed").alias("issue"))
    ).unionByName(cells.agg(F.count("*").alias("n")).filter(F.col("n") < C.MIN_CELLS).select(
        F.lit("few cells").alias("issue")))
