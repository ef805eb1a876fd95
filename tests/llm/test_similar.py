"""Jaccard join, embedding join and suffix dedup against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL
from oracle import compare, duck

from stayweave.llm import jaccard, neardup, queries, suffixes


class Classes:
    def __init__(self, members):
        self.up = {m: m for m in members}

    def of(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = sorted((self.of(a), self.of(b)))
        self.up[b] = a


def brute_jaccard(texts, width, num, den):
    sets = {i: jaccard.shingles_of(t or "", width) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    classes, seen = Classes(sets), set()
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                        classes.link(a, b)
    return {i: (len(s), classes.of(i)) for i, s in sets.items()}


def near_texts(seed, n=120):
    """Groups of copies that differ a little more with every step."""
    rng, out = random.Random(seed), {}
    for g in range(6):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 8, 30, 60, 120]))]
        for k in range(n // 6):
            if rng.random() < 0.7:
                words = list(words)
                words[rng.randrange(len(words))] = f"v{rng.randint(0, 50)}"
            if rng.random() < 0.2:
                words.append("tail")
            out[g * 1000 + k] = " ".join(words)
    return out


@pytest.mark.parametrize(("seed", "width", "num"), [(1, 3, 90), (2, 5, 80)])
def test_jaccard_classes(spark, monkeypatch, seed, width, num):
    texts = near_texts(seed)
    monkeypatch.setattr(jaccard, "FREQUENT", 6)  # so that most shingles are frequent and trees come in parts
    monkeypatch.setattr(jaccard, "TREE_POINTS", 5)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(rows, width, num).collect()}
    assert got == brute_jaccard(texts, width, num, 100)


def test_jaccard_odd_rows(odd, none):
    got = jaccard.jaccard_classes(odd, 3, 90).collect()
    assert len(got) == odd.count()
    classes = {r.doc_id: r.component_id for r in got}
    assert (classes[0], classes[5], classes[7], classes[9]) == (0, 0, 0, 9)
    assert {r.doc_id: r.n_shingles for r in got}[1] == 0 and classes[2] == 2
    kept = jaccard.keep_one(odd, 3, 90)
    assert kept.columns == odd.columns and 5 not in {r.doc_id for r in kept.collect()}
    assert jaccard.jaccard_classes(none).count() == 0


def test_jaccard_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op3_ngram_jaccard"](spark, SMALL).collect()}
    assert got == brute_jaccard(texts, 3, 90, 100)


@pytest.mark.parametrize("tree", [2000, 7])
def test_near_copies_are_paired_in_one_tree(spark, monkeypatch, tree):
    # copies that stay just below the threshold share many trees
    rng, base = random.Random(3), [f"w{k}" for k in range(300)]
    texts = {i: " ".join(w if rng.random() > 0.02 else f"{w}x{i}" for w in base) for i in range(40)}
    monkeypatch.setattr(jaccard, "TREE_POINTS", tree)
    counts, plain = [], jaccard.arrow

    def counted(df, function, schema):
        out = plain(df, function, schema)
        if schema.startswith("a bigint"):
            counts.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(jaccard, "arrow", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 90).collect()}
    assert got == brute_jaccard(texts, 3, 90, 100)
    assert counts[0][1] > 50 and counts[0][0] <= 1.5 * counts[0][1]


def evaluations(df):
    return len(re.findall(r"EvalPython|InArrow", df._jdf.queryExecution().executedPlan().toString()))


def test_no_step_takes_two_python_workers(spark, monkeypatch):
    """A worker lives on after its task: two in a task are twice the memory for all that follows."""
    steps, plain = [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df: steps.append(evaluations(df)) or plain(df))
    rng = random.Random(5)
    words = [f"w{rng.randrange(300)}" for _ in range(400)]
    rows = [(k, " ".join(words[:200 + k])) for k in range(4)] + [(9, " ".join(words[300:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in jaccard.keep_one(docs).collect()) == [0, 9]
    assert max(steps) == 1
    left = suffixes.without_repeats(docs)
    assert evaluations(left) == 1
    kept = {r["doc_id"]: r["text"].split() for r in left.collect()}
    assert kept[0] == words[:200] and kept[9] == words[300:]
    assert all(kept[k] == words[199 + k:200 + k] for k in (1, 2, 3))


def test_tree_finds_all():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 6, (20, jaccard.GROUPS))
    points = np.clip(np.repeat(base, 9, axis=0) + rng.integers(-1, 2, (180, jaccard.GROUPS)), 0, None).astype(np.int32)
    sizes = points.sum(axis=1)
    want = {(i, j) for i in range(180) for j in range(180)
            if np.minimum(points[i], points[j]).sum() * 190 >= 90 * (sizes[i] + sizes[j])}
    got = {(int(i), int(j)) for a, b in jaccard.PointTree(points, sizes).search(points, sizes, 90, 100) for i, j in zip(a, b)}
    assert got == want


def brute_vectors(rows, least):
    good = [(i, np.array(v, dtype=float), c) for i, v, c in rows if v is not None and c is not None and None not in v
            and np.isfinite(np.array(v, dtype=float)).all() and np.any(np.array(v, dtype=float))]
    links, classes = defaultdict(int), Classes([r[0] for r in rows])
    for k, (i, v, c) in enumerate(good):
        for j, w, d in good[:k]:
            if c == d and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                links[i] += 1
                links[j] += 1
                classes.link(i, j)
    return {r[0]: (links[r[0]], classes.of(r[0]), classes.of(r[0]) == r[0]) for r in rows}


def vectors(seed):
    rng, rows = np.random.default_rng(seed), []
    for g in range(12):
        centre = rng.standard_normal(32)
        for _ in range(15):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.standard_normal(32) * rng.choice([0.1, 0.27, 0.4])], int(g % 3)))
    same = rows[0][1]
    for extra in (same, same, [2 * x for x in same], None, [0.0] * 32, [None] + same[1:], [float("nan")] + same[1:], [float("inf")] + same[1:], same[:5]):
        rows.append((len(rows), extra, 0))
    return [*rows, (len(rows), same, None), (len(rows) + 1, same, None)]


@pytest.mark.parametrize("cell", [2000, 20])
def test_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(neardup, "CELL_ROWS", cell)
    rows = vectors(cell)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_copies(table).collect()}
    assert got == brute_vectors(rows, 0.93)
    assert neardup.near_copies(table.limit(0)).count() == 0


def test_vectors_of_two_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(d)], i % 2) for i, d in enumerate([16] * 12 + [8] * 6)]
    rows += [(100 + i, [x * 1.01 for x in v], c) for i, v, c in rows]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_copies(table).collect()}
    assert got == brute_vectors(rows, 0.93) and got[112] == (1, 12, False)


@pytest.mark.parametrize("tiles", [1, 2, 5, 6])
def test_every_two_tiles_meet_once(spark, tiles):
    points = spark.createDataFrame([("x", tiles, t, t, 1, [1.0]) for t in range(tiles)],
                                   "_label string, tiles int, tile int, node long, weight long, _v array<float>")
    met = Counter()
    for turn in range(tiles + tiles % 2 - 1):
        rows = neardup._dealt(points, turn).collect()
        assert len({r.node for r in rows}) == len(rows)
        met.update({(r.p, r.q) for r in rows if r.q < tiles})
    assert met == Counter((p, q) for q in range(tiles) for p in range(q))


def test_no_step_repeats_the_vectors(spark, monkeypatch):
    rows, sizes, plain = vectors(7), [], neardup.stored

    def counted(df, *name):
        out = plain(df, *name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(neardup, "stored", counted)
    monkeypatch.setattr(neardup, "CELL_ROWS", 6)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_copies(table).collect()}
    assert got == brute_vectors(rows, 0.93)
    assert max(sizes) <= len(rows)  # a row for each block and cell of a vector before


def test_vector_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.QUERIES["op2_embedding_neardup"](spark, SMALL).collect()}
    assert got == brute_vectors(rows, 0.93)


def brute_repeats(texts, least):
    places = defaultdict(list)
    for i, t in sorted(texts.items()):
        words = [w for w in re.split(r"[ \t-\r]+", t or "") if w]
        for p in range(len(words) - least + 1):
            places[tuple(words[p:p + least])].append((i, p))
    again, later = defaultdict(set), defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for k, (i, p) in enumerate(sorted(found)):
                again[i].update(range(p, p + least))
                if k:
                    later[i].update(range(p, p + least))
    return {k: v for k, v in again.items()}, {k: v for k, v in later.items()}


def covered(rows):
    again, later = defaultdict(set), defaultdict(set)
    for r in rows:
        again[r.doc_id].update(range(r.start_word, r.stop_word))
        if r.later:
            later[r.doc_id].update(range(r.start_word, r.stop_word))
    return dict(again), dict(later)


def passages(seed):
    rng, out = random.Random(seed), {}
    shared = [" ".join(f"p{k}x{rng.randint(0, 999)}" for _ in range(n)) for k, n in enumerate((12, 13, 20, 45))]
    for i in range(60):
        parts = [" ".join(f"u{i}y{rng.randint(0, 99999)}" for _ in range(rng.randint(0, 25)))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(shared), " ".join(f"u{i}z{rng.randint(0, 99999)}" for _ in range(rng.randint(1, 9)))]
        out[i] = "\n".join(parts)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats(spark, seed):
    texts = passages(seed)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert covered(suffixes.repeated_spans(rows, min_words=12, gram=6).collect()) == brute_repeats(texts, 12)
    cut = {r.doc_id: r.text for r in suffixes.without_repeats(rows, min_words=12, gram=6).collect()}
    _, later = brute_repeats(texts, 12)
    for i, t in texts.items():
        words = [w for w in t.split() if w]
        assert cut.get(i, "").split() == [w for k, w in enumerate(words) if k not in later.get(i, ())]


def tails(seed, own, foot):
    """Passages of ``own`` words and a common footer, each in two documents that go on differently."""
    rng, out = random.Random(seed), {}
    footer = " ".join(f"f{k}" for k in range(foot))
    word = lambda: f"r{rng.randint(0, 999999)}"
    for g in range(60):
        passage = " ".join(word() for _ in range(own)) + " " + footer
        for half in (0, 1):
            out[g + 1000 * half] = " ".join([*(word() for _ in range(rng.randint(0, 9))), passage, *(word() for _ in range(rng.randint(20, 60)))])
    return out


@pytest.mark.parametrize(("own", "foot"), [(10, 45), (6, 45), (20, 40)])
def test_repeats_with_a_shared_tail(spark, own, foot):
    texts = tails(own, own, foot)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert covered(suffixes.repeated_spans(rows).collect()) == brute_repeats(texts, 50)


def test_repeats_odd_rows(odd, none):
    got = suffixes.repeated_spans(odd).collect()
    assert {r.doc_id for r in got} == {4}  # one document repeats itself
    cut = suffixes.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert suffixes.repeated_spans(none).count() == 0


def test_minimisers_reach_every_window():
    rng = np.random.default_rng(8)
    grams = rng.integers(0, 40, 3000).astype(np.uint64)
    at = suffixes.minimisers(grams, 31)
    assert np.diff(at).max() <= 31 and at[0] < 31 and at[-1] >= 3000 - 31


def test_repeat_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert covered(queries.QUERIES["op10_suffix_dedup"](spark, SMALL).collect()) == brute_repeats(texts, 50)


@pytest.mark.parametrize("rows", [3, 40])
def test_repeats_over_many_tasks(spark, monkeypatch, rows):
    """One passage in most texts, after and before others: it spans tasks, and twins are seldom neighbours."""
    rng = random.Random(rows)
    word = lambda: f"r{rng.randint(0, 99999)}"
    common, heads = [word() for _ in range(9)], [[word() for _ in range(5)] for _ in range(4)]
    texts = {k: " ".join([*(word() for _ in range(rng.randint(0, 4))), *rng.choice(heads), *common, *rng.choice(heads), word()])
             for k in range(120)}
    monkeypatch.setattr(suffixes, "TASK_ROWS", rows)
    docs = spark.createDataFrame([*texts.items(), *list(texts.items())[:9]], "doc_id long, text string").repartition(3)
    assert covered(suffixes.repeated_spans(docs, min_words=12, gram=6).collect()) == brute_repeats(texts, 12)


@pytest.mark.parametrize("name", ["op2_embedding_neardup", "op3_ngram_jaccard"])
def test_queries_match_sql(spark, name):
    ok, note = compare(spark, duck(SMALL), SMALL, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, note


def thue_morse(n, a, b):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_words_that_a_polynomial_hash_confuses(spark):
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_classes(docs, 3, 90).collect()} == {1: 1, 2: 2}
    words = [f"w{k}" for k in range(60)]
    long = [(k, " ".join([*words[:30], x, *words[30:]])) for k, x in ((1, one), (2, two))]
    assert suffixes.repeated_spans(spark.createDataFrame(long, "doc_id long, text string")).count() == 0


def test_texts_that_share_an_id(spark):
    rng = random.Random(3)
    draw = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    base, other, short = draw(200), draw(200), draw(10)
    near = base.replace(" ", "  ").rsplit(" ", 1)[0] + " changed"
    docs = spark.createDataFrame([(1, base), (2, near), (2, other), (3, short)], "doc_id long, text string")
    kept = sorted((r.doc_id, r.text) for r in jaccard.keep_one(docs, 3, 90).collect())
    assert kept == sorted([(1, base), (2, other), (3, short)])
    twice = spark.createDataFrame([(2, near), (2, base), (5, other)], "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one(twice, 3, 90).collect()) == [2, 5]
    cut = Counter((r.doc_id, r.text.split()[-1] if r.text else "") for r in suffixes.without_repeats(docs).collect())
    assert cut == Counter([(1, base.split()[-1]), (2, "changed"), (2, other.split()[-1]), (3, short.split()[-1])])
