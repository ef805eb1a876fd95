"""Language and toxicity models: held-out accuracy, arithmetic by brute force, odd rows; and the pipeline."""

from __future__ import annotations

import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from stayweave.llm import charlm, langid, queries, toxicity

LARGER = SMALL.replace("0.001", "0.01")


def plain_kneser_ney(texts, order):
    """The same model with dictionaries."""
    codes, counts = charlm.coded(texts, order)
    top, at = Counter(), 0
    for n in counts:
        own = [int(c) for c in codes[at:at + n]]
        for k in range(order - 1, n):
            top[tuple(own[k - order + 1:k + 1])] += 1
        at += n
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    alphabet = max(2, len(levels[1]) + 1)
    discounts, totals, kinds = {}, defaultdict(Counter), defaultdict(Counter)
    for k, table in levels.items():
        ones, twos = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
        discounts[k] = min(0.95, max(0.05, ones / (ones + 2 * twos) if ones else 0.5))
        for g, c in table.items():
            totals[k][g[:-1]] += c
            kinds[k][g[:-1]] += 1

    def prob(g):
        k = len(g)
        if not k:
            return 1 / alphabet
        lower = prob(g[1:])
        total = totals[k][g[:-1]]
        if not total:
            return lower
        return max(levels[k][g] - discounts[k], 0) / total + discounts[k] * kinds[k][g[:-1]] / total * lower

    return prob, top


def test_model_by_brute_force(spark):
    texts = ["the cat sat on the mat", "a cat and a hat, that's all", "tttt"]
    rows = spark.createDataFrame([("x", t) for t in texts], "cls string, text string")
    for order in (2, 4):
        model = charlm.fit(rows, "cls", "text", order)
        prob, top = plain_kneser_ney(texts, order)
        seen = list(top)[:60]
        unseen = [(*g[:-1], ord("q")) for g in seen[:20]] + [(*g[:-2], ord("z"), g[-1]) for g in seen[:20]]
        pack = lambda g: sum(c << (16 * (len(g) - 1 - k)) for k, c in enumerate(g))
        got = model.score(np.array([pack(g) for g in seen + unseen], dtype=np.uint64))[:, 0]
        assert got == pytest.approx([math.log(prob(g)) for g in seen + unseen], abs=1e-4)


@pytest.mark.parametrize("size", [1, 2, 7, 50, 1 << 19])
def test_grams_by_slices(monkeypatch, size):
    texts = ["the cat sat on the mat", "", "a cat and a hat, that's all" * 3, "t", "  \x01 ", "日本語 日本", "the cat"]
    codes, _ = charlm.coded(texts)
    kinds, n = np.unique(charlm.grams(codes)[codes != charlm.START], return_counts=True)
    monkeypatch.setattr(charlm, "SLICE", size)
    got = charlm.count_grams(texts)
    assert np.array_equal(got[0], kinds) and np.array_equal(got[1], n)
    assert not len(charlm.count_grams([])[0])


def test_counting_grams_takes_little_memory(spark, monkeypatch):
    counting, plain = [], charlm.arrow
    monkeypatch.setattr(charlm, "arrow", lambda df, function, schema: counting.append(function) or plain(df, function, schema))
    charlm.gram_counts(spark.createDataFrame([("x", "a cat")], "cls string, text string"), "cls", "text")
    texts = [" ".join(str(k * 7919 + j).translate(str.maketrans("0123456789", "abcdefghij")) for j in range(400)) for k in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * len(texts)), pa.array(texts)], names=["cls", "text"])
    tracemalloc.start()
    list(counting[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * sum(map(len, texts))


def test_order_falls_with_size(spark, monkeypatch):
    rows = spark.createDataFrame([("x", "the cat sat on the mat"), ("y", "le chat est là")], "cls string, text string")
    monkeypatch.setattr(charlm, "MODEL_CELLS", 30)
    assert charlm.fit(rows, "cls", "text").order < charlm.ORDER


def test_operators_keep_the_order_at_any_size(odd, monkeypatch):
    def scored():
        langs = langid.predict_and_reject(odd, F.lit(True)).select("doc_id", "lang_pred", "score").collect()
        marks = odd.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
        tox = toxicity.score_toxicity(odd, marks, F.lit(True)).select("doc_id", "score").collect()
        return sorted(map(repr, langs)), sorted(map(repr, tox))

    orders, plain = [], charlm.fit
    for module in (langid, toxicity):
        monkeypatch.setattr(module, "fit", lambda *a, **b: orders.append(plain(*a, **b)) or orders[-1])
    before = scored()
    monkeypatch.setattr(charlm, "MODEL_CELLS", 30)
    assert scored() == before
    assert [m.order for m in orders] == [charlm.ORDER] * 4


def test_language_held_out(spark):
    found = queries.QUERIES["op7_language_id"](spark, LARGER).join(
        spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_odd_rows(odd, none):
    got = {r.doc_id: r for r in langid.predict_and_reject(odd, F.lit(True)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 8))
    assert got[0].lang_pred == "en" and not got[0].rejected and got[1].rejected
    assert langid.predict_and_reject(odd, F.lit(True)).count() == odd.count()
    nothing = langid.predict_and_reject(odd, F.lit(False)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.predict_and_reject(none, F.lit(True)).count() == 0


@pytest.fixture(scope="module")
def restorer(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").withColumn("cls", F.lit("all"))
    return toxicity.Restorer(charlm.fit(docs, "cls", "text"))


@pytest.mark.parametrize(("written", "meant"), [
    ("1d10t", "idiot"), ("m0r0n", "moron"), ("tr4sh", "trash"), ("$tupid", "stupid"), ("l00ser", "loser"), ("p@thet1c!!", "pathetic"),
    ("stuuuupid", "stupid"), ("trash", "trash")])
def test_restored(restorer, written, meant):
    assert meant in restorer.words(written)


def test_plain_words_stay(restorer):
    assert restorer.words("loser,") == ["loser"] and restorer.words("2024") == [] and restorer.words("***") == []


@pytest.mark.parametrize(("written", "meant"), [
    ("such an i d i o t, indeed", "idiot"), ("a m.o.r.o.n indeed", "moron"), ("an i d ! o t here", "idiot"), ("so $ t u p 1 d", "stupid"),
    ("i d i o t m o r o n", "moron"), ("i d i o t m o r o n", "idiot"), ("you l  o  s  e  r", "loser"), ("what tr.ash", "trash"),
    ("i-d-i-o-t", "idiot"), ("it is in", "is"), ("well-known", "known")])
def test_spacing_is_read_by_the_lattice(restorer, written, meant):
    assert meant in {w for t in toxicity.tokens_of(written) for w in restorer.words(t)}


def test_a_long_stretch_of_letters(restorer):
    assert "idiot" in restorer.words(" ".join("idiot" * 4000))


def test_viterbi_finds_the_best_path(restorer):
    word = "c10wn"
    def cost(letters, options):
        context, total = (charlm.START,) * 2 + (charlm.GAP,), 0.0
        for c, own in zip(letters + " ", [*options, 0.0]):
            code = int(charlm.letter_codes()[ord(c)])
            total += own + restorer._log(context, code)
            context = (*context, code)[1:]
        return total
    import itertools

    paths = itertools.product(*restorer.lattice(word))
    best = max(paths, key=lambda p: cost("".join(c for c, _ in p), [w for _, w in p]))
    assert restorer.decode(word) == "".join(c for c, _ in best)


def test_toxicity_held_out(spark):
    found = queries.QUERIES["op9_toxicity"](spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").filter("held_out").collect()
    pairs = [(a.score, b.score) for a in found if a.toxic for b in found if not b.toxic]
    assert sum((a > b) + 0.5 * (a == b) for a, b in pairs) >= 0.95 * len(pairs)
    assert all(r.predicted == (r.score >= 0.3) for r in found)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (5, 1), (6, 0), (7, 0), (9, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd, labels, F.lit(True)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert scores[1] == scores[2] == scores[3]
    assert {r.predicted for r in toxicity.score_toxicity(odd, labels.limit(0), F.lit(True)).collect()} == {0}
    assert toxicity.score_toxicity(none, labels, F.lit(True)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from stayweave.llm.base import stored

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "exact dedup":
            assert len(after) == len(set(after.values())) == len(set(before.values()))
            assert all(min(j for j, u in before.items() if u == t) == i for i, t in after.items())
        if name != "suffix-array dedup":
            assert all(before[i] == t for i, t in after.items())
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == set(before)


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_a_clean_text_with_a_toxic_ones_id_stays(spark):
    docs = spark.createDataFrame([(1, "bad", "x"), (1, "good", "y"), (None, "bad", "z"), (2, None, "u")], "doc_id long, text string, extra string")
    scored = docs.select("doc_id", F.when(F.col("text") == "bad", 1).otherwise(0).alias("predicted"),
                         F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    left = toxicity.drop_predicted(docs, scored)
    assert left.columns == docs.columns and sorted(r.extra for r in left.collect()) == ["u", "y"]
    assert toxicity.drop_predicted(docs.limit(0), scored.limit(0)).count() == 0
