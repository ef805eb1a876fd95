"""Operator 7, language identification by character models.

Each language has an interpolated Kneser-Ney model of its training texts; a text gets the language of the lowest
cross-entropy per character. A language's own training texts say how high that may be before it is doubted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayweave.llm.base import arrow, stored, text_of
from stayweave.llm.charlm import ORDER, fit, letter_codes

UNDETERMINED = "und"
#: Share of a language's own training texts that the calibrated rejection may doubt.
REJECT_SHARE = 0.005
#: How far a difference of cross-entropy (nats per character) moves the score.
SHARPNESS = 10.0


def predict(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str = "lang", order: int = ORDER, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, lang_pred, score, cross_entropy`` and the columns in ``keep``.

    ``training`` gives texts and languages; null texts and languages there are left out. A text that is null or has no
    letter gets ``und`` and score 0, as do all where nothing was learned. Equal cross-entropies go to the language that
    comes first in the alphabet. Repeated rows and null ids are predicted like others.
    """
    model = fit(training, lang_col, text_col, order, bounded=False)
    classes = model.classes
    shared = docs.sparkSession.sparkContext.broadcast(model)  # grows with the distinct n-grams
    schema = docs.select(F.col(id_col), *keep).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kn = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lettered = np.array([bool((letter_codes()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")] != 32).any())
                                 if t else False for t in texts], dtype=bool)
            n = len(texts)
            langs, scores, costs = np.full(n, UNDETERMINED, dtype=object), np.zeros(n), np.full(n, np.nan)
            if lettered.any() and classes:
                h, _ = kn.cross_entropy([t for t, a in zip(texts, lettered) if a])
                best = h.argmin(axis=1)
                low = h.min(axis=1)
                langs[lettered] = np.array(classes, dtype=object)[best]
                scores[lettered] = 1 / np.exp(-SHARPNESS * (h - low[:, None])).sum(axis=1)
                costs[lettered] = low
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs.tolist(), pa.string()), pa.array(scores), pa.array(costs, from_pandas=True)],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "cross_entropy"])

    return arrow(docs.select(F.col(id_col), *keep, text_of(text_col).alias("_text")), score,
                 f"{fields}, lang_pred string, score double, cross_entropy double")


def with_rejection(scored: DataFrame, lang_col: str, trained_col: str, share: float = REJECT_SHARE) -> DataFrame:
    """Adds ``rejected``: the cross-entropy lies above what all but ``share`` of the language's own training texts
    have. Limits come from all training rows, one row per language."""
    limits = scored.filter(F.col(trained_col) & (F.col(lang_col) == F.col("lang_pred"))).groupBy("lang_pred").agg(
        F.percentile_approx("cross_entropy", 1 - share, 1000).alias("_limit"))
    return scored.join(F.broadcast(limits), "lang_pred", "left").withColumn(
        "rejected", F.coalesce(F.col("cross_entropy") > F.col("_limit"), F.lit(True))).drop("_limit")


def predict_and_reject(docs: DataFrame, trained_on, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows where the Column ``trained_on`` holds, score all rows once, and calibrate on those rows."""
    marked = docs.withColumn("_trained", F.coalesce(trained_on, F.lit(False)))
    scored = stored(predict(marked, marked.filter("_trained"), id_col, text_col, lang_col, keep=(lang_col, "_trained")))
    return with_rejection(scored, lang_col, "_trained").drop(lang_col)
