"""Corpus cleaning as a chain of stages; each stage's rows are stored and read again by the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayweave.llm import exact, jaccard, packing, suffixes, toxicity
from stayweave.llm.base import stored, table
from stayweave.session import configure


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; learned from all labelled documents. Null and empty texts stay."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.drop_predicted(docs, scored)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact copies go; of each group the smallest ``doc_id`` stays."""
    return exact.drop_copies(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over shingles of five words, one stays."""
    return jaccard.keep_one(docs, width=5, num=80, den=100)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has as well are cut out."""
    return suffixes.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in windows of 1024: the pieces of each sequence with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [("toxicity", clean), ("exact dedup", distinct), ("n-gram Jaccard join", dissimilar), ("suffix-array dedup", unrepeated),
          ("packing", packed)]
#: No SQL: the first stage learns a model, and packing runs a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(configure(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs) if k < len(STAGES) - 1 else docs
    return docs
