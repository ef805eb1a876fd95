"""Graph, walks, embeddings, communities and statistics: properties and small exact cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayweave.operators import cluster, community, describe, diagnose, embed, filters, graph, walks, weights
from stayweave.session import cut_lineage


def test_dense_ids_follow_key_order(spark):
    df = spark.createDataFrame([(f"k{i % 50:03d}",) for i in range(200)] + [(None,)], "key string")
    rows = graph.dense_ids(df, "key").orderBy("key").collect()
    assert [r["idx"] for r in rows] == list(range(50))


def small_graph(spark):
    stops = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 3), ("c", 3)], "device_aid string, h3_id bigint")
    nodes = graph.node_table(stops)
    return stops, nodes, walks.index_edges(graph.visit_edges(stops), nodes)


def test_walks_use_edges_and_start_everywhere(spark):
    _, nodes, edges = small_graph(spark)
    start, path = walks.metapath()
    rows = walks.random_walks(nodes, edges, start, path, 6, 5).collect()
    there = {(r["rel"], r["src"], r["dst"]) for r in edges.collect()}
    assert len(rows) == 3 * 5 and len({r["walk"] for r in rows}) == 15
    for r in rows:
        assert len(r["path"]) == 7 and r["path"][0] == r["walk"] // 5
        assert all((path[i % 2], a, b) in there for i, (a, b) in enumerate(zip(r["path"], r["path"][1:])))


def test_dead_end_ends_the_walk(spark):
    stops = spark.createDataFrame([("a", 1), ("b", 2)], "device_aid string, h3_id bigint")
    kinds = spark.createDataFrame([("1", "x", 2)], "src string, dst string, weight int")
    nodes = graph.node_table(stops, spark.createDataFrame([("x",)], "primary string"))
    edges = walks.index_edges(graph.visit_edges(stops).unionByName(graph.both_ways(kinds, "contains", "located_in")), nodes)
    start, path = walks.metapath(kinds=True)
    lengths = {r["path"][0]: len(r["path"]) for r in walks.random_walks(nodes, edges, start, path, 8, 1).collect()}
    assert lengths == {0: 9, 1: 2}


def test_walks_of_a_small_node_table_spread_over_tasks(spark, monkeypatch):
    stops = spark.createDataFrame([(f"d{i:02d}", c) for i in range(40) for c in range(3)], "device_aid string, h3_id bigint")
    nodes = cut_lineage(graph.node_table(stops).coalesce(1))
    edges = cut_lineage(walks.index_edges(graph.visit_edges(stops), nodes).coalesce(1))
    start, path = walks.metapath()
    made = {}
    for bound in (100, walks.TASK_WALKS):
        monkeypatch.setattr(walks, "TASK_WALKS", bound)
        rows = walks.random_walks(nodes, edges, start, path, 2, 100).withColumn("task", F.spark_partition_id())
        assert rows.groupBy("task").count().agg(F.max("count")).first()[0] <= 2000
        made[bound] = {(r["walk"], *r["path"]) for r in rows.collect()}
    assert len(made[100]) == 4000 and made[100] == made[walks.TASK_WALKS]


def test_edges_of_small_files_are_not_broadcast(spark):
    pairs = spark.range(250_000).selectExpr("id div 500 as src", "id % 500 as dst", "1 as weight")
    edges = cut_lineage(graph.both_ways(pairs, "visits", "visited_by"))
    nodes = spark.range(1000).selectExpr("if(id < 500, 'individual', 'hexagon') as node_type", "id % 500 as idx")
    start, path = walks.metapath()
    rows = walks.random_walks(nodes, edges, start, path, 1, 2)
    assert rows._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1
    assert all(len(r["path"]) == 2 for r in rows.collect()) and rows.count() == 1000


def test_weights_lie_side_by_side_across_slices(spark, monkeypatch):
    edges = spark.createDataFrame([("visits", 0, d, 1 + d % 3) for d in range(30)] + [("visits", 1, 2, 0)],
                                  "rel string, src bigint, dst bigint, weight int")
    monkeypatch.setattr(walks, "SLOTS_PER_SLICE", 7)
    rows = walks.edge_intervals(edges).orderBy("begin").collect()
    assert [s for r in rows for s in range(r["begin"], r["end"])] == list(range(60))
    assert [r["dst"] for r in rows for _ in range(r["end"] - r["begin"])] == [d for d in range(30) for _ in range(1 + d % 3)]
    buckets, nodes = walks.weight_buckets(walks.edge_intervals(edges))
    width = nodes.first()["width"]
    for r in buckets.collect():
        assert r["begin"] < (r["bucket"] + 1) * width and r["end"] > r["bucket"] * width
    assert sum(1 for _ in buckets.collect()) <= 60


def test_a_weight_of_ten_billion(spark):
    nodes = spark.createDataFrame([("individual", i) for i in range(200)] + [("hexagon", i) for i in range(51)], "node_type string, idx bigint")
    edges = spark.createDataFrame(
        [("visits", i, c, 10_000_000_000 if c == 50 else 1_000_000_000 if c == 49 else 1) for i in range(200) for c in range(51)]
        + [("visited_by", c, c, 1) for c in range(51)], "rel string, src bigint, dst bigint, weight bigint")
    assert walks.weight_buckets(walks.edge_intervals(edges))[0].count() <= 2 * edges.count()
    paths = [r["path"] for r in walks.random_walks(nodes, edges, "individual", ["visits", "visited_by"], 1, 10).collect()]
    ends = [p[1] for p in paths]
    assert len(paths) == 2000 and set(ends) == {49, 50} and abs(ends.count(49) / 2000 - 1 / 11) < 0.03


def test_context_pairs(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2],)], "nodes array<bigint>")
    got = {(r["src"], r["dst"]): r["weight"] for r in embed.context_pairs(df, 3).collect()}
    assert got == {(1, 2): 2, (1, 3): 1, (2, 3): 1}


def test_training_lowers_the_loss_and_pulls_neighbours_together(spark):
    # Two groups that are never visited together.
    stops = spark.createDataFrame([(f"d{i}", i % 2 * 10 + c) for i in range(8) for c in range(3)], "device_aid string, h3_id bigint")
    nodes = graph.node_table(stops).withColumn("id", walks.node_id(F.col("node_type"), F.col("idx")))
    start, path = walks.metapath()
    paths = walks.random_walks(nodes, walks.index_edges(graph.visit_edges(stops), nodes), start, path, 6, 6)
    vectors, losses = embed.skip_gram(nodes.select("id"), walks.with_node_ids(paths, start, path), dim=8, epochs=12, patience=12, rate=0.05, batch=16)
    trace = [r["loss"] for r in losses.orderBy("epoch", "step").collect()]
    assert trace[-1] < 0.9 * trace[0]
    out = embed.export_embeddings(vectors, nodes, "individual").collect()
    unit = {int(r["key"][1:]): np.array(r["vec"]) / np.linalg.norm(r["vec"]) for r in out}
    same = np.mean([unit[i] @ unit[j] for i in unit for j in unit if i < j and (i - j) % 2 == 0])
    other = np.mean([unit[i] @ unit[j] for i in unit for j in unit if i < j and (i - j) % 2])
    assert same > other + 0.2
    assert embed.export_embeddings(vectors, nodes, "hexagon", wide=True).columns == ["node_idx", "key", *[f"x{i}" for i in range(8)]]


@pytest.mark.parametrize("blocks", [1, 2, 4, 6, 10])
def test_every_two_blocks_meet_once(spark, blocks):
    seen = []
    for turn in range(blocks):
        low = embed._partner(blocks, turn)
        pairs = {b: [c for c in range(blocks) if low[c] == b] for b in set(low)}
        assert all(min(members) == b and len(members) <= 2 for b, members in pairs.items())
        seen += [(min(m), max(m), turn) for m in pairs.values() if turn == blocks - 1 or len(m) == 2]
    assert len({s[:2] for s in seen}) == len(seen) == blocks * (blocks + 1) // 2
    df = spark.createDataFrame(seen, "low int, high int, turn int")
    assert df.filter(embed._turn(F.col("low"), F.col("high"), blocks) != F.col("turn")).count() == 0


def test_training_goes_over_every_pair_and_keeps_every_node(spark):
    walked = spark.createDataFrame([([i, (1 << walks.TYPE_BITS) + i % 3] * 4,) for i in range(40)], "nodes array<long>")
    nodes = walked.select(F.explode("nodes").alias("id")).distinct()
    pairs = embed.context_pairs(walked).count()
    runs = [embed.skip_gram(nodes, walked, dim=8, epochs=2, batch=16, log_steps=3, blocks=b) for b in (1, 4)]
    for vectors, losses in runs:
        assert vectors.count() == nodes.count() == vectors.select("id").distinct().count()
        assert losses.filter("epoch = 1 and loss is null").count() == 0
    assert runs[0][1].filter("epoch = 1").agg(F.max("step")).first()[0] == -(-pairs // 16)
    again = embed.skip_gram(nodes, walked, dim=8, epochs=2, batch=16, log_steps=3, blocks=4)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, runs[1][0].collect()))


def test_training_stops_where_the_loss_does():
    assert not embed.stalled([1.0, 0.9, 0.9, 0.9, 0.8], 3, 0.01) and embed.stalled([1.0, 0.9, 0.9, 0.9, 0.895], 3, 0.01)


def test_planted_groups_are_told_apart(spark):
    # sixty devices of three groups, each with its own ten cells
    stops = spark.createDataFrame([(f"d{i:02d}", 100 * (i % 3) + (i * 7 + k) % 10) for i in range(60) for k in range(4)], "device_aid string, h3_id bigint")
    nodes = graph.node_table(stops).withColumn("id", walks.node_id(F.col("node_type"), F.col("idx"))).persist()
    start, path = walks.metapath()
    paths = walks.random_walks(nodes, walks.index_edges(graph.visit_edges(stops), nodes), start, path, 20, 20)
    vectors, losses = embed.skip_gram(nodes.select("id"), walks.with_node_ids(paths, start, path), dim=16, batch=64, epochs=6)
    trace = [r["loss"] for r in losses.orderBy("epoch", "step").collect()]
    assert trace[0] > 1.3 and np.mean(trace[-4:]) < 1.05
    out = embed.export_embeddings(vectors, nodes, "individual").collect()
    unit = {int(r["key"][1:]): np.array(r["vec"]) / np.linalg.norm(r["vec"]) for r in out}
    same = [unit[i] @ unit[j] for i in unit for j in unit if i < j and (i - j) % 3 == 0]
    other = [unit[i] @ unit[j] for i in unit for j in unit if i < j and (i - j) % 3]
    assert np.mean(same) > 0.5 and np.mean(same) > np.mean(other) + 0.5


def test_node_embeddings_are_registered_whole(spark, monkeypatch):
    from conftest import SMALL

    from stayweave.plans import graph_queries

    seen, plain = [], walks.random_walks
    monkeypatch.setattr(walks, "random_walks", lambda *a: seen.append(a[4:]) or plain(*a[:4], 1, 1))
    monkeypatch.setattr(embed, "skip_gram", lambda *a, **b: seen.append(b) or (None, None))
    graph_queries._embedded(spark, SMALL)
    assert seen == [(20, 20), {"dim": 64, "epochs": 6}]


def test_communities_of_two_cliques(spark):
    cliques = [(f"{p}{i}", f"{p}{j}", 1) for p in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", 1)]
    edges = spark.createDataFrame(cliques, "u string, v string, weight int")
    found = community.communities(edges, resolution=1.0)
    parts = {}
    for r in found.collect():
        parts.setdefault(r["community"], set()).add(r["node"][0])
    assert len(parts) == 2 and all(len(v) == 1 for v in parts.values())
    assert abs(community.modularity(edges, found, 1.0).first()[0] - (40 / 42 - 0.5)) < 1e-9


def test_category_threshold_is_cut_to_an_integer(spark):
    rows = [(f"d{i}", ["x"] if i < 2 else ["y", "x"] if i < 3 else None) for i in range(5)]
    stops = spark.createDataFrame(rows, "device_aid string, primary array<string>")
    assert {r["primary"] for r in graph.valid_categories(stops, 0.59).collect()} == {"x"}
    assert {r["primary"] for r in graph.valid_categories(stops, 0.39).collect()} == {"x", "y"}


def test_lists_of_a_place_count_for_every_stop_there(spark):
    lists = {1: ["x", "y", "x", None], 2: ["y"], 3: []}
    at = [("a", 7, 1)] * 3 + [("b", 7, 2), ("b", 8, 1), ("c", 8, 3), ("c", 7, 2), ("d", 9, 4)]
    places = spark.createDataFrame([(p, v, v) for p, v in lists.items()], "place int, primary array<string>, kind array<string>")
    visits = spark.createDataFrame(at, "device_aid string, h3_id bigint, place int").filter("place < 4")
    whole = visits.join(places, "place")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(graph.category_devices(visits, places)) == rows(graph.category_devices(whole)) == [("x", 2), ("y", 3)]
    assert rows(graph.cell_kind_weights(visits, places=places)) == rows(graph.cell_kind_weights(whole)) == [
        (7, "x", 6, 6), (7, "y", 5, 5), (8, "x", 2, 7), (8, "y", 1, 4)]
    valid = graph.valid_categories(visits, 0.9, places)
    assert rows(valid) == rows(graph.valid_categories(whole, 0.9)) and rows(graph.top_categories(visits, 1, places)) == [("y", 3)]
    assert rows(graph.category_edges(visits, valid, places)) == rows(graph.category_edges(whole, valid))


def test_a_long_list_is_not_repeated_at_every_stop(spark):
    # 10^10 items if every stop brought its list along
    places = spark.range(1).select(F.col("id").alias("place"), F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: i.cast("string")).alias("primary"))
    visits = spark.range(100_000).select((F.col("id") % 2).cast("string").alias("device_aid"), (F.col("id") * 0).alias("place"))
    assert {r["devices"] for r in graph.category_devices(visits, places).select("devices").distinct().collect()} == {2}


def test_distance_zero_is_left_out_and_p_value(spark):
    rows = [("z", d, f) for d, f in [(0.0, 9), (1.0, 10), (2.0, 6), (4.0, 4), (8.0, 1)]]
    fit = weights.distance_decay(spark.createDataFrame(rows, "deso_r string, d2home double, freq bigint")).first()
    x, y = np.log([1, 2, 4, 8]), np.log([10, 6, 4, 1])
    assert fit["n"] == 4 and math.isclose(fit["eta"], -np.polyfit(x, y, 1)[0])
    # For two degrees of freedom the t distribution has a closed form.
    r = np.corrcoef(x, y)[0, 1]
    assert math.isclose(fit["eta_p"], 1 - abs(r), rel_tol=1e-9)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 1.0, 10.0, 100.0, 1000.0]], "v double")
    lin = describe.histogram(df, "v", 4).collect()
    assert sum(r["n"] for r in lin) == 5 and math.isclose(sum(r["density"] * (r["high"] - r["low"]) for r in lin), 1)
    log = {r["bin"]: r["n"] for r in describe.histogram(df, "v", 4, log=True).collect()}
    assert log == {0: 2, 1: 1, 2: 2}
    assert describe.histogram(df.filter("v < 0"), "v", 4).count() == 0


def test_ridge_equals_the_direct_solution(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(103, 4))
    y = x @ [1, 2, 0, -1] + rnd.normal(size=103)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(103)], "i int, f array<double>, y double")
    got = {r["fold"]: r["r2"] for r in diagnose.ridge_cv(df, "f", "y", "i").collect()}
    for fold, test in enumerate(np.array_split(np.arange(103), 5)):
        train = np.setdiff1d(np.arange(103), test)
        mx, my = x[train].mean(0), y[train].mean()
        a = x[train] - mx
        beta = np.linalg.solve(a.T @ a + np.eye(4), a.T @ (y[train] - my))
        left = y[test] - my - (x[test] - mx) @ beta
        assert math.isclose(got[fold], 1 - (left**2).sum() / ((y[test] - y[test].mean()) ** 2).sum(), rel_tol=1e-9)
    assert diagnose.ridge_cv(df.limit(50), "f", "y", "i").count() == 0


def test_label_prediction_learns(spark):
    from pyspark.ml.functions import array_to_vector
    rows = [(i, [float(i % 2) * 3 + (i * 37 % 11) / 11, 1.0], i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, f array<double>, y int").withColumn("f", array_to_vector("f"))
    out = diagnose.predict_labels(df, "f", "y", "i").collect()
    assert 30 < len(out) < 90 and np.mean([r["label"] == r["prediction"] for r in out]) > 0.9


def test_samples_repeat_and_keep_whole_devices(spark):
    df = spark.createDataFrame([(f"d{i % 100}", i) for i in range(1000)], "device_aid string, i int")
    one, two = (sorted(map(tuple, filters.sample_devices(df, 0.3).collect())) for _ in range(2))
    assert one == two and len(one) % 10 == 0 and 100 < len(one) < 500
    assert len(filters.sample_rows(df, 17, "i").collect()) == 17


def vectors_of(spark, points):
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    names = [f"f{j}" for j in range(len(points[0]))]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} double" for n in names))
    return cluster.to_vector(df, names)


def test_components_match_the_covariance(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(80, 4)) @ np.diag([5.0, 2.0, 0.5, 0.1]) + 7
    out, ratios = cluster.principal_components(vectors_of(spark, x), 4, keep=0.95)
    values, directions = np.linalg.eigh(np.cov(x.T))
    order = np.argsort(values)[::-1]
    want = values[order] / values.sum()
    k = int(np.searchsorted(np.cumsum(want), 0.95) + 1)
    assert len(ratios) == k and np.allclose(ratios, want[:k])
    got = np.array([r["pca"] for r in out.orderBy("i").collect()])
    assert np.allclose(np.abs(got), np.abs((x - x.mean(0)) @ directions[:, order[:k]]))


def test_k_means_finds_blobs_and_the_sweep_prefers_them(spark):
    rnd = np.random.default_rng(5)
    points = np.concatenate([rnd.normal(c, 0.2, size=(30, 2)) for c in [(0, 0), (10, 0), (0, 10)]])
    rows = vectors_of(spark, points)
    labels = [r["group"] for r in cluster.k_means(rows, 3, first_label=1).orderBy("i").collect()]
    assert set(labels) == {1, 2, 3} and all(len(set(labels[a:a + 30])) == 1 for a in (0, 30, 60))
    scores = {r["k"]: (r["cost"], r["silhouette"]) for r in cluster.k_sweep(rows, range(2, 5)).collect()}
    assert max(scores, key=lambda k: scores[k][1]) == 3 and scores[2][0] > scores[3][0]
