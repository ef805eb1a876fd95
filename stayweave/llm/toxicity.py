"""Operator 9, toxicity through a noisy channel.

Written words may hide what they say: letters as look-alike signs, letters repeated, letters spaced apart. Every such
word, and every stretch of single signs, is a lattice of characters, in which white space and marks between letters
are either dropped or end a word. Viterbi decoding under a character model of all texts picks what was meant. Evidence for
the label is then weighed on the restored words.

1. A Kneser-Ney character model of all texts of the corpus.
2. Distinct labelled training texts, restored: how many toxic and how many other texts hold each word and word
   beginning. Log odds, kept where they are significant.
3. Logistic regression on what a text's distinct words bring, fitted on all labelled training rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayweave.llm.base import arrow, stored, text_of
from stayweave.llm.charlm import GAP, START, KneserNey, fit, letter_codes
from stayweave.session import broadcast_if_small

# Signs that are written for letters.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
              "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Log cost of each sign read as a letter, of dropping the repeats of a letter or keeping them, and of dropping what separates letters.
SIGN_COST, COLLAPSE_COST, KEEP_COST, JOIN_COST = -0.5, -0.7, -2.0, -1.0
#: Lengths of word beginnings that carry evidence of their own.
BEGINNINGS = (4, 5, 6)
#: A feature is kept if its log odds are at least this many standard errors above zero, and at least this high.
LEAST_Z, LEAST_ODDS = 2.5, 1.5
#: Share of the toxic texts that a feature must be in.
LEAST_SHARE = 1e-3
CACHE_WORDS = 400_000

# three or more signs that stand alone: where words may be spaced apart
_PIECES = re.compile(r"""(?<![^\s"'(])\S(?:\s+\S){2,}(?=[\s.,;:!?"')]|$)""")
_PROSE = ".,;:?!'\"*%&#"
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_INNER = re.compile(r"[\W_]+")


def _separates(sign: str) -> bool:
    return sign not in LOOKALIKES and not sign.isalnum()


class Restorer:
    """What a written word most likely says."""

    def __init__(self, model: KneserNey):
        self.model, self.known = model, {}

    def _log(self, context: tuple[int, ...], code: int) -> float:
        key = (context, code)
        if key not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            packed = 0
            for c in (*context, code):
                packed = packed << 16 | c
            self.known[key] = float(self.model.score(np.array([packed], dtype=np.uint64))[0, 0])
        return self.known[key]

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """Alternatives of each written sign or run of signs."""
        out, at = [], 0
        while at < len(word):
            sign, end = word[at], at + 1
            if _separates(sign):
                while end < len(word) and _separates(word[end]):
                    end += 1
                out.append([("", JOIN_COST), (" ", 0.0)])
                at = end
                continue
            while end < len(word) and word[end] == sign:
                end += 1
            letters = LOOKALIKES.get(sign, "") if not sign.isalpha() else sign
            cost = 0.0 if sign.isalpha() else SIGN_COST
            run = end - at
            if not letters:  # a digit that stands for nothing: drop it
                out.append([("", SIGN_COST)])
            elif run < (3 if sign.isalpha() else 2):
                out += [[(c, cost) for c in letters]] * run
            else:
                out.append([(c * k, cost + (COLLAPSE_COST if k < run else KEEP_COST)) for c in letters for k in (1, 2, run)])
            at = end
        return out

    def decode(self, word: str) -> str:
        """Viterbi: the best path through the lattice, the state being the characters the model looks back on."""
        codes, back = letter_codes(), self.model.order - 1
        states: dict = {((START,) * (back - 1) + (GAP,) if back else ()): (0.0, None)}
        for options in [*self.lattice(word), [(" ", 0.0)]]:
            after: dict = {}
            for context, (total, path) in states.items():
                for letters, cost in options:
                    now, gain = context, cost
                    for letter in letters:
                        code = int(codes[ord(letter)])
                        gain += self._log(now, code)
                        now = (*now, code)[1:] if back else ()
                    if now not in after or total + gain > after[now][0]:
                        after[now] = (total + gain, (path, letters))
            states = after
        path, out = max(states.values(), key=lambda s: s[0])[1], []
        while path:
            path, letters = path
            out.append(letters)
        return "".join(reversed(out)).strip()

    def words(self, written: str) -> list[str]:
        """The words that a lower-case token, or a stretch of single signs, stands for."""
        signs = written.strip(_PROSE)
        if signs.isalpha():
            return [self.decode(signs)] if _RUN.search(signs) else [signs]
        if not any(c.isalpha() for c in signs):
            return []
        got = [w for w in _INNER.split(signs) if w]
        # marks inside a word hide it if what they part is no word: a letter or two
        parted = len(got) > 1 and min(map(len, got)) <= 2
        if parted or any(c in LOOKALIKES for c in signs) or _RUN.search(signs):
            got += self.decode(signs).split()
        return got


def features(word: str) -> list[str]:
    """The word itself and its beginnings, told apart by their first sign."""
    return ["=" + word, *(str(n) + word[:n] for n in BEGINNINGS if len(word) >= n)]


def tokens_of(text: str) -> set[str]:
    """Distinct lower-case tokens, and stretches of single signs."""
    low = text.lower()
    return {*low.split(), *(found.group() for found in _PIECES.finditer(low))}


class _Cached(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[key] = self.make(key)
        return value


def feature_counts(texts: DataFrame, model, only=None) -> DataFrame:
    """``feature, n``: in how many texts each feature is, over all rows; with ``only``, of those features alone."""
    schema = pa.schema([("feature", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, wanted = Restorer(model.value), only.value if only else None
        words = _Cached(lambda t: tuple({f for w in restorer.words(t) for f in features(w) if wanted is None or f in wanted}))
        for batch in batches:
            sums: Counter = Counter()
            for text in batch.column(0).to_pylist():
                sums.update({f for found in map(words.__getitem__, tokens_of(text)) for f in found})
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], schema=schema)

    return arrow(texts, count, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))


def feature_weights(texts: DataFrame, model, pos: int, neg: int) -> dict[str, float]:
    """Significant log odds of ``_text`` and ``_label`` rows.

    A feature needs ``LEAST_SHARE`` of the toxic texts. So there are at most 1 / ``LEAST_SHARE`` times the features of
    an average text, however many texts there are, and their table can go to the driver and to all workers.
    """
    spark = texts.sparkSession
    least = max(2, LEAST_SHARE * pos)
    often = {r["feature"]: r["n"] for r in feature_counts(texts.filter("_label = 1").select("_text"), model).filter(F.col("n") >= least).collect()}
    wanted = spark.sparkContext.broadcast(set(often))
    rare = {r["feature"]: r["n"] for r in feature_counts(texts.filter("_label = 0").select("_text"), model, wanted).collect()}
    out = {}
    for feature, p in often.items():
        n = rare.get(feature, 0)
        odds = math.log((p + 0.5) / (pos + 1)) - math.log((n + 0.5) / (neg + 1))
        if odds >= LEAST_ODDS and odds >= LEAST_Z * math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5)):
            out[feature] = odds
    return out


def evidence(docs: DataFrame, model, weights, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``_x``: the strongest word, the sum, the number of words with evidence, and their density."""
    kept = docs.select(*keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, table = Restorer(model.value), weights.value
        worth = _Cached(lambda t: max((table.get(f, 0.0) for w in restorer.words(t) for f in features(w)), default=0.0))
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                tokens = tokens_of(text)
                found = [v for v in map(worth.__getitem__, tokens) if v]
                out.append([max(found, default=0.0), float(np.log1p(sum(found))), float(np.log1p(len(found))),
                            sum(found) / (len(tokens) + 5)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))],
                                             names=[*batch.schema.names[:-1], "_x"])

    return arrow(docs.select(*keep, text_of(text_col).alias("_text")), weigh, f"{fields}, _x array<double>")


def score_toxicity(docs: DataFrame, labels: DataFrame, trained_on, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """``id, score, predicted, text_hash`` for each row of ``docs``.

    Labels are learned only from rows of ``docs`` where the Column ``trained_on`` holds; null labels and ids are left
    out there. Null and empty texts get the score of a text without evidence, as do all texts when no label, or only
    one kind of label, is known. Repeated rows are scored alike; other columns, clashing names included, are not read.
    """
    spark = docs.sparkSession
    mine = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    model = spark.sparkContext.broadcast(fit(mine.withColumn("_all", F.lit("all")), "_all", "_text", bounded=False))
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna().groupBy("_id").agg(
        F.max("_label").alias("_label"))
    marked = docs.withColumn("_trained", F.coalesce(trained_on, F.lit(False))).select(
        F.col(id_col).alias("_id"), "_trained", text_of(text_col).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    trained = marked.filter("_trained")
    # exact copies of one text would count as many witnesses; only digests move
    known = trained.select("_id", F.sha2("_text", 256).alias("_digest")).join(marks, "_id")
    single = stored(known.groupBy("_digest").agg(F.min(F.struct("_id", "_label")).alias("one")).select("one.*"))
    sides = {r["_label"]: r["count"] for r in single.groupBy("_label").count().collect()}
    if len(sides) < 2:
        return mine.select(F.col("_id").alias(id_col), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.xxhash64("_text").alias("text_hash"))
    texts = trained.join(broadcast_if_small(single), "_id").select("_text", "_label")
    weights = spark.sparkContext.broadcast(feature_weights(texts, model, sides.get(1, 0), sides.get(0, 0)))
    weighed = stored(evidence(marked, model, weights, "_text", ["_id", "_trained", "_hash"]))
    rows = weighed.filter("_trained").join(marks, "_id").select(F.col("_label").cast("double").alias("label"), array_to_vector("_x").alias("features"))
    fitted = LogisticRegression(maxIter=100, regParam=1e-3).fit(rows)
    # the fitted line as an expression: no Python when scoring
    line = F.lit(float(fitted.intercept))
    for k, w in enumerate(fitted.coefficients):
        line = line + F.lit(float(w)) * F.col("_x")[k]
    scored = weighed.select(F.col("_id").alias(id_col), (1 / (1 + F.exp(-line))).alias("score"), F.col("_hash").alias("text_hash"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_predicted(docs: DataFrame, scored: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic; columns unchanged. Rows are told by id, null ones included, and text, so
    a clean text that shares the id of a toxic one stays."""
    gone = broadcast_if_small(stored(scored.filter("predicted = 1").select(
        F.col(id_col).alias("_gone"), F.col("text_hash").alias("_gone_hash")).distinct()))
    same = F.col(id_col).eqNullSafe(F.col("_gone")) & (F.xxhash64(text_of(text_col)) == F.col("_gone_hash"))
    return docs.join(gone, same, "left_anti")
