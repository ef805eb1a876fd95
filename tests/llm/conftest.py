"""Small tables with the odd cases every operator must take."""

from __future__ import annotations

import pytest

ODD = [
    (0, "one two three four five six seven", "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n ", "de", "s", 4),
    (4, "word " * 30000, "en", "s", 150000), (5, "one two three four five six seven", "en", "s", 1), (None, "no id here at all", "fr", "t", 3),
    (6, "é ́x 日本語 \U0001F600 ﬁ", "fr", None, 9), (7, "one two three four five six seven", "en", "s", 1), (7, "one two three four five six seven", "en", "s", 1),
    (8, "12345 !!! ...", "en", "s", 5), (9, "x", "en", "s", 1), (10, "y" * 5000, "en", "s", 5000)]
#: Columns that a careless join or rename would meet.
CLASHES = ["node", "label", "_id", "_text", "key", "ids", "score", "n", "hash", "_row", "component"]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return rows.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
