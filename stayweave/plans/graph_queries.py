"""Queries on the visit graph, walks, embeddings, communities, clusters and diagnostics."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from stayweave.operators import cluster, community, describe, diagnose, embed, graph, spatial, walks
from stayweave.operators import demographics as D
from stayweave.plans import fixtures as X
from stayweave.plans.base_queries import diversity, rounded
from stayweave.plans.registry import query
from stayweave.session import cut_lineage, shuffles_removed

_CAT = "SELECT \"primary\", count(DISTINCT device_aid) AS devices FROM (SELECT device_aid, unnest(prim) AS \"primary\" FROM linked) GROUP BY 1"
_VALID = "SELECT * FROM cat WHERE devices >= (SELECT floor(count(DISTINCT device_aid) * {0}) FROM linked)"


@query("category_filter", X.with_parts(
    'SELECT "primary", devices FROM valid', "linked", cat=_CAT, valid=_VALID.format(0.3)))
def category_filter(spark, folder):
    return graph.valid_categories(X.linked_visits(spark, folder), 0.3, X.place_lists(spark, folder))


@query("top_categories", X.with_parts(
    'SELECT "primary", devices FROM cat ORDER BY devices DESC, "primary" LIMIT 20', "linked", cat=_CAT))
def top_categories(spark, folder):
    return graph.top_categories(X.linked_visits(spark, folder), places=X.place_lists(spark, folder))


_NODES = """SELECT node_type, key, row_number() OVER (PARTITION BY node_type ORDER BY key) - 1 AS idx FROM (
    SELECT DISTINCT 'individual' AS node_type, device_aid AS key FROM linked
    UNION SELECT 'hexagon', CAST(h3_id AS VARCHAR) FROM linked
    UNION SELECT 'poi_category', "primary" FROM valid
    UNION SELECT 'group', CAST("group" AS VARCHAR) FROM groups)"""


def _places(spark, folder):
    """Linked stops, the lists of their places, valid categories and the node table of the full graph."""
    stops = cut_lineage(X.linked_visits(spark, folder).select("device_aid", "h3_id", "place"))
    lists = X.place_lists(spark, folder)
    valid = cut_lineage(graph.valid_categories(stops, 0.01, lists))
    nodes = cut_lineage(graph.node_table(stops, valid, X.device_groups(spark, folder)))
    return stops, lists, valid, nodes


@query("graph_nodes", X.with_parts(
    "SELECT node_type, key, idx FROM nodes", "linked", "groups", cat=_CAT, valid=_VALID.format(0.01), nodes=_NODES))
def graph_nodes(spark, folder):
    return _places(spark, folder)[3]


_EDGES = """SELECT 'visits' AS rel, device_aid AS src, CAST(h3_id AS VARCHAR) AS dst, 1 AS weight FROM (SELECT DISTINCT device_aid, h3_id FROM linked)
    UNION ALL SELECT 'visited_by', CAST(h3_id AS VARCHAR), device_aid, 1 FROM (SELECT DISTINCT device_aid, h3_id FROM linked)
    UNION ALL SELECT 'has_poi', CAST(h3_id AS VARCHAR), p, 1 FROM hp UNION ALL SELECT 'located_at', p, CAST(h3_id AS VARCHAR), 1 FROM hp"""
_HP = """SELECT DISTINCT h3_id, p FROM (SELECT h3_id, unnest(prim) AS p FROM linked) WHERE p IN (SELECT "primary" FROM valid)"""


def _edges(stops, lists, valid):
    return graph.visit_edges(stops).unionByName(graph.category_edges(stops, valid, lists))


@query("graph_edges", X.with_parts(
    "SELECT rel, src, dst, weight FROM edges", "linked", cat=_CAT, valid=_VALID.format(0.01), hp=_HP, edges=_EDGES))
def graph_edges(spark, folder):
    stops, lists = cut_lineage(X.linked_visits(spark, folder).select("device_aid", "h3_id", "place")), X.place_lists(spark, folder)
    return _edges(stops, lists, graph.valid_categories(stops, 0.01, lists))


@query("hex_kind_weights", X.with_parts(
    """SELECT h3_id, kind, n AS count, CAST(ceil(n::DOUBLE / sum(n) OVER (PARTITION BY h3_id) * 10) AS INT) AS count_n FROM
       (SELECT h3_id, kind, count(*) AS n FROM (SELECT h3_id, unnest(kinds) AS kind FROM linked) GROUP BY ALL)""", "linked"))
def hex_kind_weights(spark, folder):
    return graph.cell_kind_weights(X.linked_visits(spark, folder), places=X.place_lists(spark, folder))


@query("weighted_edges", X.with_parts(
    """SELECT rel, src, dst, weight FROM (SELECT 'visits' AS rel, device_aid AS src, CAST(h3_id AS VARCHAR) AS dst, n::INT AS weight FROM c
       UNION ALL SELECT 'visited_by', CAST(h3_id AS VARCHAR), device_aid, n::INT FROM c)""",
    "city", c="SELECT device_aid, h3_id, count(*) AS n FROM city GROUP BY ALL"))
def weighted_edges(spark, folder):
    visits = D.city_visits(X.stops(spark, folder)).groupBy("device_aid", "h3_id").agg(F.count("*").alias("freq_wi"))
    return graph.weighted_visit_edges(visits)


@query("group_edges", X.with_parts(
    """SELECT 'includes' AS rel, CAST("group" AS VARCHAR) AS src, device_aid AS dst, 1 AS weight FROM groups
       UNION ALL SELECT 'belongs_to', device_aid, CAST("group" AS VARCHAR), 1 FROM groups""", "groups"))
def group_edges(spark, folder):
    return graph.group_edges(X.device_groups(spark, folder))


@query("node_labels", X.with_parts(
    """SELECT node_type, key, idx, CASE WHEN node_type = 'individual' THEN g."group" ELSE s.label END AS label FROM nodes
       LEFT JOIN groups g ON node_type = 'individual' AND key = g.device_aid
       LEFT JOIN (SELECT CAST(h3_id AS VARCHAR) AS h, CAST(max(weekday >= 5)::INT AS INT) AS label FROM linked GROUP BY 1) s
         ON node_type = 'hexagon' AND key = s.h WHERE node_type IN ('individual', 'hexagon')""",
    "linked", "groups", cat=_CAT, valid=_VALID.format(0.01), nodes=_NODES))
def node_labels(spark, folder):
    space = X.linked_visits(spark, folder).groupBy("h3_id").agg(
        F.max((F.col("weekday") >= 5).cast("int")).alias("group"))
    return graph.node_labels(_places(spark, folder)[3], X.device_groups(spark, folder), space)


_PAIRS = """SELECT "primary", secondary, count(*) AS weight FROM
    (SELECT p_type AS "primary", unnest(string_split(p_name, ' ')) AS secondary FROM part) GROUP BY ALL"""


def _pairs(spark, folder):
    return graph.category_pairs(X.table(spark, folder, "part").select(
        F.col("p_type").alias("primary"), F.split("p_name", " ").alias("secondary")))


@query("category_cooccur", X.with_parts('SELECT "primary", secondary, weight FROM pairs', pairs=_PAIRS))
def category_cooccur(spark, folder):
    return _pairs(spark, folder)


@query("category_degrees", X.with_parts(
    """SELECT label, count(*) AS degree FROM (SELECT unnest([u, v]) AS label FROM (SELECT DISTINCT least("primary", secondary) AS u,
       greatest("primary", secondary) AS v FROM pairs)) GROUP BY label""", pairs=_PAIRS))
def category_degrees(spark, folder):
    return graph.degrees(graph.undirected(_pairs(spark, folder)))


_MOD = """SELECT round(sum(inn) / sum(tot) - 0.3e0 * sum(tot * tot) / power(sum(tot), 2), 6) AS modularity FROM
    (SELECT length(src) % 3 AS c, sum(CASE WHEN length(src) % 3 = length(dst) % 3 THEN weight ELSE 0 END) AS inn,
     sum(weight)::DOUBLE AS tot FROM (SELECT "primary" AS src, secondary AS dst, weight FROM pairs
     UNION ALL SELECT secondary, "primary", weight FROM pairs) GROUP BY 1)"""


@query("modularity", X.with_parts(_MOD, pairs=_PAIRS))
def modularity(spark, folder):
    edges = graph.undirected(_pairs(spark, folder))
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return rounded(community.modularity(edges, nodes.withColumn("community", F.length("node") % 3)), ["modularity"])


@query("communities")
def communities(spark, folder):
    edges = cut_lineage(graph.undirected(_pairs(spark, folder)))
    return community.merge_small(community.communities(edges), edges, 2)


_WNODES = """SELECT node_type, key, row_number() OVER (PARTITION BY node_type ORDER BY key) - 1 AS idx FROM (
    SELECT DISTINCT 'individual' AS node_type, device_aid AS key FROM city UNION SELECT 'hexagon', CAST(h3_id AS VARCHAR) FROM city)"""
_SLOTS = """SELECT rel, src, dst, row_number() OVER (PARTITION BY rel, src ORDER BY dst) - 1 AS slot, count(*) OVER (PARTITION BY rel, src) AS deg
    FROM (SELECT DISTINCT 'visits' AS rel, a.idx AS src, b.idx AS dst FROM city JOIN nodes a ON a.node_type = 'individual' AND a.key = device_aid
          JOIN nodes b ON b.node_type = 'hexagon' AND b.key = CAST(h3_id AS VARCHAR)
          UNION SELECT DISTINCT 'visited_by', b.idx, a.idx FROM city JOIN nodes a ON a.node_type = 'individual' AND a.key = device_aid
          JOIN nodes b ON b.node_type = 'hexagon' AND b.key = CAST(h3_id AS VARCHAR))"""


def _step_sql(step: int, rel: str, before: str) -> str:
    mixed = f"(walk * 7919 + {step * 104729 + 42 * 15485863} + pos * 1299709) % 2147483647"
    for turn in (1, 2):
        mixed = f"(({mixed}) * 48271 + {turn}) % 2147483647"
    return f"""SELECT walk, e.dst AS pos, path || '-' || e.dst AS path FROM
        (SELECT s.*, ({mixed}) % d.deg AS pick FROM {before} s JOIN
         (SELECT DISTINCT src, deg FROM slots WHERE rel = '{rel}') d ON d.src = s.pos)
        JOIN slots e ON e.rel = '{rel}' AND e.src = pos AND e.slot = pick"""


_WALK = dict(
    nodes=_WNODES, slots=_SLOTS,
    s0="SELECT idx * 4 + k AS walk, idx AS pos, CAST(idx AS VARCHAR) AS path FROM nodes, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE node_type = 'individual'",
    s1=_step_sql(0, "visits", "s0"), s2=_step_sql(1, "visited_by", "s1"), s3=_step_sql(2, "visits", "s2"))


def _visit_graph(spark, folder):
    stops = cut_lineage(D.city_visits(X.stops(spark, folder)).select("device_aid", "h3_id").distinct())
    nodes = cut_lineage(graph.node_table(stops))
    return nodes, walks.index_edges(graph.visit_edges(stops), nodes)


@query("walks_3_steps", X.with_parts("SELECT walk, path FROM s3", "city", **_WALK))
def walks_3_steps(spark, folder):
    nodes, edges = _visit_graph(spark, folder)
    start, path = walks.metapath()
    return walks.random_walks(nodes, edges, start, path, 3, 4).select("walk", F.array_join("path", "-").alias("path"))


# Edges by key with their weights: visits repeat, kinds of a cell have their normalised repeats.
_W_EDGES = """SELECT 'visits' AS rel, device_aid AS src, CAST(h3_id AS VARCHAR) AS dst, n AS w FROM vc
    UNION ALL SELECT 'visited_by', CAST(h3_id AS VARCHAR), device_aid, n FROM vc
    UNION ALL SELECT 'has_poi', CAST(h3_id AS VARCHAR), p, 1 FROM hp UNION ALL SELECT 'located_at', p, CAST(h3_id AS VARCHAR), 1 FROM hp
    UNION ALL SELECT 'contains', CAST(h3_id AS VARCHAR), kind, n FROM hk UNION ALL SELECT 'located_in', kind, CAST(h3_id AS VARCHAR), n FROM hk
    UNION ALL SELECT 'includes', CAST("group" AS VARCHAR), device_aid, 1 FROM groups
    UNION ALL SELECT 'belongs_to', device_aid, CAST("group" AS VARCHAR), 1 FROM groups"""
_HK = """SELECT h3_id, kind, CAST(ceil(n::DOUBLE / sum(n) OVER (PARTITION BY h3_id) * 10) AS BIGINT) AS n FROM
    (SELECT h3_id, kind, count(*) AS n FROM (SELECT h3_id, unnest(kinds) AS kind FROM linked) WHERE kind IS NOT NULL GROUP BY ALL)"""
_W_NODES = """SELECT node_type, key, row_number() OVER (PARTITION BY node_type ORDER BY key) - 1 AS idx FROM (
    SELECT DISTINCT 'individual' AS node_type, device_aid AS key FROM linked UNION SELECT 'hexagon', CAST(h3_id AS VARCHAR) FROM linked
    UNION SELECT 'poi_category', "primary" FROM valid UNION SELECT 'kind', kind FROM hk UNION SELECT 'group', CAST("group" AS VARCHAR) FROM groups)"""
_W_ENDS = {rel: tuple("kind" if t == "poi_category" and rel in ("contains", "located_in") else t for t in ends)
           for rel, ends in walks.ENDS.items()}
_W_INTERVALS = f"""SELECT rel, a.idx AS src, b.idx AS dst, sum(w) OVER o - w AS lo, sum(w) OVER o AS hi, sum(w) OVER (PARTITION BY rel, a.idx) AS total
    FROM we JOIN (VALUES {", ".join(f"('{r}', '{a}', '{b}')" for r, (a, b) in _W_ENDS.items())}) AS ends(r, s, d) ON rel = r
    JOIN wn a ON a.node_type = s AND a.key = src JOIN wn b ON b.node_type = d AND b.key = dst
    WINDOW o AS (PARTITION BY rel, a.idx ORDER BY b.idx)"""


def _weighted_step(step: int, rel: str, before: str) -> str:
    """One step of every walk; ended walks have no position and keep their path."""
    mixed = f"(walk * 7919 + {step * 104729 + 42 * 15485863} + pos * 1299709) % 2147483647"
    for turn in (1, 2):
        mixed = f"(({mixed}) * 48271 + {turn}) % 2147483647"
    return f"""SELECT walk, e.dst AS pos, path || coalesce('-' || e.dst, '') AS path FROM
        (SELECT s.*, ({mixed}) % t.total AS pick FROM {before} s LEFT JOIN
         (SELECT DISTINCT src, total FROM iv WHERE rel = '{rel}') t ON t.src = s.pos) q
        LEFT JOIN iv e ON e.rel = '{rel}' AND e.src = pos AND pick >= e.lo AND pick < e.hi"""


def _weighted_parts() -> dict[str, str]:
    parts = dict(vc="SELECT device_aid, h3_id, count(*) AS n FROM linked GROUP BY ALL", hk=_HK, we=_W_EDGES, wn=_W_NODES, iv=_W_INTERVALS)
    for name, (start, rels) in walks.METAPATHS.items():
        parts[f"{name}_0"] = f"""SELECT idx * 2 + k AS walk, idx AS pos, CAST(idx AS VARCHAR) AS path FROM wn,
            (SELECT unnest([0, 1]) AS k) WHERE node_type = '{start}'"""
        for i in range(len(rels) + 1):
            parts[f"{name}_{i + 1}"] = _weighted_step(i, rels[i % len(rels)], f"{name}_{i}")
    return parts


@query("weighted_walks", X.with_parts(
    " UNION ALL ".join(f"SELECT '{n}' AS metapath, walk, path FROM {n}_{len(r) + 1}" for n, (_, r) in walks.METAPATHS.items()),
    "linked", "groups", cat=_CAT, valid=_VALID.format(0.01), hp=_HP, **_weighted_parts()))
def weighted_walks(spark, folder):
    """Once around each of the five metapaths and a step further, two walks a node."""
    stops, lists, valid, nodes = _places(spark, folder)
    groups = X.device_groups(spark, folder)
    visits = graph.weighted_visit_edges(stops.groupBy("device_aid", "h3_id").agg(F.count("*").alias("freq_wi")))
    kinds = cut_lineage(graph.kind_edges(stops, lists))
    kind_nodes = cut_lineage(graph.node_table(stops, kinds.filter("rel = 'contains'").select(F.col("dst").alias("primary")).distinct(), groups))
    edges = visits.unionByName(graph.group_edges(groups).withColumn("weight", F.col("weight").cast("int")))
    by_place = cut_lineage(walks.index_edges(edges.unionByName(graph.category_edges(stops, valid, lists)), nodes))
    by_kind = cut_lineage(walks.index_edges(edges.unionByName(kinds), kind_nodes))
    out = None
    for name, (start, path) in walks.METAPATHS.items():
        walked = walks.random_walks(nodes, by_kind if "kinds" in name else by_place, start, path, len(path) + 1, 2)
        with shuffles_removed(spark):  # the steps of one metapath at a time
            walked = cut_lineage(walked.select(F.lit(name).alias("metapath"), "walk", F.array_join("path", "-").alias("path")))
        out = walked if out is None else out.unionByName(walked)
    return out


def _embedded(spark, folder, epochs=6, dim=64, length=20, per_node=20):
    stops, lists, valid, nodes = _places(spark, folder)
    start, path = walks.METAPATHS["places"]
    walked = walks.random_walks(nodes, walks.index_edges(_edges(stops, lists, valid), nodes), start, path, length, per_node)
    ids = nodes.filter("node_type <> 'group'").withColumn("id", walks.node_id(F.col("node_type"), F.col("idx")))
    ids = cut_lineage(ids)
    vectors, losses = embed.skip_gram(ids.select("id"), walks.with_node_ids(walked, start, path), dim=dim, epochs=epochs)
    return ids, vectors, losses


@query("node_embeddings")
def node_embeddings(spark, folder):
    ids, vectors, _ = _embedded(spark, folder)
    return embed.export_embeddings(vectors, ids, "hexagon", wide=True)


@query("embedding_stats", """
    SELECT round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, round(min(v), 5) AS min, round(max(v), 5) AS max,
      (SELECT count(*) FROM (SELECT var_pop(v) AS p FROM (SELECT generate_subscripts(embedding, 1) AS d,
        unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY d) WHERE p < 0.001) AS low_var_dims,
      (SELECT round(avg(n), 5) FROM (SELECT sqrt(sum(v * v)) AS n FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v
        FROM embeddings) GROUP BY vec_id)) AS l2_mean
    FROM (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings)""")
def embedding_stats(spark, folder):
    out = diagnose.embedding_stats(X.table(spark, folder, "embeddings"), "embedding")
    return rounded(out, ["mean", "std", "min", "max", "l2_mean"], 5)


@query("cosine_pairs", """
    WITH s AS (SELECT vec_id, embedding FROM embeddings
      ORDER BY ('0x' || substr(md5('42:' || vec_id), 1, 8))::BIGINT, vec_id LIMIT 1000)
    SELECT round(avg(c), 5) AS mean, round(stddev_pop(c), 5) AS std, round(min(c), 5) AS min, round(max(c), 5) AS max,
      count(*) AS pairs, CASE WHEN avg(c) > 0.95 THEN 'collapsed' WHEN avg(c) < 0.1 THEN 'diverse' ELSE 'moderate' END AS verdict
    FROM (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c
          FROM s a JOIN s b ON a.vec_id < b.vec_id)""")
def cosine_pairs(spark, folder):
    out = diagnose.cosine_summary(X.table(spark, folder, "embeddings"), "embedding", "vec_id")
    return rounded(out, ["mean", "std", "min", "max"], 5)


@query("silhouette", """
    WITH d AS (SELECT a.vec_id, a.label, b.label AS other, avg(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))
                 FILTER (a.vec_id <> b.vec_id) AS m, count(*) AS n FROM embeddings a, embeddings b GROUP BY ALL)
    SELECT round(avg(CASE WHEN n > 1 THEN (o - i) / greatest(i, o) ELSE 0 END), 5) AS silhouette FROM
      (SELECT vec_id, max(m) FILTER (label = other) AS i, max(n) FILTER (label = other) AS n, min(m) FILTER (label <> other) AS o
       FROM d GROUP BY vec_id)""")
def silhouette(spark, folder):
    rows = X.table(spark, folder, "embeddings")
    return rounded(cluster.silhouette(rows, "embedding", "label", "vec_id"), ["silhouette"], 5)


@query("embedding_metrics", X.with_parts(
    """SELECT vec_id, h3_id, n_visitors, round(ice_birth, 6) AS ice_birth FROM embeddings JOIN
       (SELECT h3_id, sum(n_visitors)::BIGINT AS n_visitors, avg(ice_birth) AS ice_birth, row_number() OVER (ORDER BY h3_id) - 1 AS r,
        count(*) OVER () AS n FROM diversity GROUP BY h3_id) ON vec_id % n = r""", "diversity"))
def embedding_metrics(spark, folder):
    cells = cut_lineage(D.cell_rollup(diversity(spark, folder)).select("h3_id", "n_visitors", "ice_birth"))
    numbered = cells.join(graph.dense_ids(cells, "h3_id", "number"), "h3_id")
    # every vector stands for a cell; several may share one
    vectors = X.table(spark, folder, "embeddings").select("vec_id", (F.col("vec_id") % cells.count()).alias("number"))
    return rounded(vectors.join(numbered, "number").select("vec_id", "h3_id", "n_visitors", "ice_birth"), ["ice_birth"])


@query("cluster_profile", X.with_parts(
    """SELECT (h3_id % 5)::BIGINT AS cluster, round(avg(b), 3) AS ice_birth, round(avg(i), 3) AS ice_income,
       sum(n)::BIGINT AS n_visitors FROM (SELECT h3_id, avg(ice_birth) AS b, avg(ice_income) AS i, sum(n_visitors) AS n
       FROM diversity GROUP BY h3_id) GROUP BY 1""", "diversity"))
def cluster_profile(spark, folder):
    cells = D.cell_rollup(diversity(spark, folder)).withColumn("cluster", F.col("h3_id") % 5)
    return describe.cluster_profile(cells)


@query("pearson_ice", X.with_parts(
    " UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM roll"""
                       for a, b in [("ice_birth", "n_visitors"), ("ice_income", "n_visitors"), ("ice_birth", "ice_income")]),
    "diversity", roll="""SELECT h3_id, avg(ice_birth) AS ice_birth, avg(ice_income) AS ice_income, sum(n_visitors) AS n_visitors
                        FROM diversity GROUP BY h3_id"""))
def pearson_ice(spark, folder):
    cells = D.cell_rollup(diversity(spark, folder))
    out = diagnose.correlations(cells, [("ice_birth", "n_visitors"), ("ice_income", "n_visitors"), ("ice_birth", "ice_income")])
    return rounded(out.select("a", "b", "r", "n"), ["r"])


def _cell_vectors(spark, folder):
    """Vectors with the diversity of the cell each stands for; several may share one."""
    cells = cut_lineage(D.cell_rollup(diversity(spark, folder)).select("h3_id", "ice_birth", "ice_income"))
    numbered = cells.join(graph.dense_ids(cells, "h3_id", "number"), "h3_id")
    vectors = X.table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), (F.col("vec_id") % cells.count()).alias("number"))
    return vectors.join(numbered, "number")


# The leading direction of a covariance matrix, by squaring it until only that direction is left.
_LEADING = """SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT unnest(m) AS v FROM (
    WITH RECURSIVE sq AS (SELECT 0 AS k, m FROM {0} UNION ALL
      SELECT k + 1, list_transform(t, lambda r: list_transform(r, lambda x: x / s)) FROM
        (SELECT k, t, sqrt(list_dot_product(flatten(t), flatten(t))) AS s FROM
          (SELECT k, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c))) AS t FROM sq WHERE k < 24)))
    SELECT m FROM sq WHERE k = 24)) ORDER BY list_dot_product(v, v) DESC LIMIT 1"""
_PCA = dict(
    cv="""SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, ice_birth, ice_income FROM embeddings JOIN
        (SELECT avg(ice_birth) AS ice_birth, avg(ice_income) AS ice_income, row_number() OVER (ORDER BY h3_id) - 1 AS r,
         count(*) OVER () AS n FROM diversity GROUP BY h3_id) ON vec_id % n = r""",
    un="SELECT vec_id, generate_subscripts(x, 1) AS d, unnest(x) AS v FROM cv",
    c1="""SELECT list(m ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS m FROM (SELECT a.d AS i, b.d AS j, covar_pop(a.v, b.v) AS c
        FROM un a JOIN un b USING (vec_id) GROUP BY ALL) GROUP BY i)""",
    v1=_LEADING.format("c1"),
    c2="""SELECT list_transform(m, lambda r, i: list_transform(r, lambda c, j: c - l * v[i] * v[j])) AS m FROM
        (SELECT m, v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM c1, v1)""",
    v2=_LEADING.format("c2"),
    pcs="SELECT cv.*, list_dot_product(x, v1.v) AS pc1, list_dot_product(x, v2.v) AS pc2 FROM cv, v1, v2")


@query("pearson_components", X.with_parts(
    " UNION ALL ".join(f"""SELECT '{t}' AS a, '{c}' AS b, round(corr({t}, {c}) * CASE WHEN corr(ice_birth, {c}) < 0 THEN -1 ELSE 1 END, 5) AS r,
        count(*) AS n FROM pcs""" for t in ("ice_birth", "ice_income") for c in ("pc1", "pc2")), "diversity", **_PCA))
def pearson_components(spark, folder):
    out = diagnose.component_correlations(_cell_vectors(spark, folder), "embedding", ["ice_birth", "ice_income"])
    return rounded(out.select("a", "b", "r", "n"), ["r"], 5)


@query("ridge_index")
def ridge_index(spark, folder):
    return diagnose.ridge_index(_cell_vectors(spark, folder), "embedding", ["ice_birth", "ice_income"], "vec_id")


@query("loss_checks", """
    SELECT run, steps, first_loss, last_loss, round(100 * (1 - last_loss / first_loss), 4) AS reduction,
      NOT (last_loss > first_loss * 0.9) AS converged FROM (SELECT user_id AS run, count(*) AS steps,
      arg_min(value, event_id) AS first_loss, arg_max(value, event_id) AS last_loss FROM events GROUP BY user_id)""")
def loss_checks(spark, folder):
    return rounded(diagnose.loss_checks(X.loss(spark, folder)), ["reduction"], 4)


@query("health_issues", X.with_parts(
    """SELECT 'loss did not converge' AS issue WHERE EXISTS (SELECT 1 FROM (SELECT arg_min(value, event_id) AS a,
         arg_max(value, event_id) AS b FROM events GROUP BY user_id) WHERE b > a * 0.9)
       UNION ALL SELECT 'embeddings collapsed' WHERE (WITH s AS (SELECT vec_id, embedding FROM embeddings
         ORDER BY ('0x' || substr(md5('42:' || vec_id), 1, 8))::BIGINT, vec_id LIMIT 1000)
         SELECT avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) FROM s a JOIN s b ON a.vec_id < b.vec_id) > 0.95
       UNION ALL SELECT 'few cells' WHERE (SELECT count(DISTINCT h3_id) FROM diversity) < 100""", "diversity"))
def health_issues(spark, folder):
    cosine = diagnose.cosine_summary(X.table(spark, folder, "embeddings"), "embedding", "vec_id")
    return diagnose.health_issues(
        D.cell_rollup(diversity(spark, folder)), cosine, diagnose.loss_checks(X.loss(spark, folder)))


def _predictions(spark, folder):
    return X.table(spark, folder, "embeddings").select(
        "label", F.when(F.col("vec_id") % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int").alias("prediction"))


_PRED = "SELECT label, CAST(CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS INT) AS prediction FROM embeddings"


@query("confusion_report", X.with_parts(
    """SELECT label, prediction, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM
       (SELECT label, prediction, count(*) AS n FROM pred GROUP BY ALL)""", pred=_PRED))
def confusion_report(spark, folder):
    return rounded(diagnose.confusion(_predictions(spark, folder)), ["share"])


@query("classification_report", X.with_parts(
    """SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s::BIGINT AS support FROM (
       SELECT CAST(l AS VARCHAR) AS label, p, r, f, s FROM per
       UNION ALL SELECT 'accuracy', NULL, NULL, (SELECT avg((label = prediction)::INT) FROM pred), sum(s) FROM per
       UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM per
       UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM per)""",
    pred=_PRED, per="""SELECT l, s, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM (
        SELECT l, count(*) FILTER (label = l) AS s,
        coalesce(count(*) FILTER (label = l AND prediction = l) / nullif(count(*) FILTER (prediction = l), 0)::DOUBLE, 0) AS p,
        coalesce(count(*) FILTER (label = l AND prediction = l) / nullif(count(*) FILTER (label = l), 0)::DOUBLE, 0) AS r
        FROM pred, (SELECT DISTINCT label AS l FROM pred UNION SELECT DISTINCT prediction FROM pred) GROUP BY l)"""))
def classification_report(spark, folder):
    return rounded(diagnose.classification_report(_predictions(spark, folder)), ["precision", "recall", "f1"])


_SCALE = ["Q1", "Q4", "sweden", "other"]


def _features(spark, folder):
    return D.device_indices(X.home_building(spark, folder), X.building_data(spark, folder)).select(
        "device_aid", *[F.col(c).cast("double").alias(c) for c in _SCALE])


@query("standardise", X.with_parts(
    "SELECT device_aid, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in _SCALE)
    + " FROM home_building JOIN building_data USING (b_id) WHERE sweden + nordic + eu + other > 0",
    "home_building", "building_data"))
def standardise(spark, folder):
    return rounded(cluster.standardise(_features(spark, folder), _SCALE), _SCALE)


@query("min_max", X.with_parts(
    "SELECT device_aid, " + ", ".join(
        f"round(({c} - min({c}) OVER ())::DOUBLE / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in _SCALE)
    + " FROM home_building JOIN building_data USING (b_id) WHERE sweden + nordic + eu + other > 0",
    "home_building", "building_data"))
def min_max(spark, folder):
    return rounded(cluster.min_max(_features(spark, folder), _SCALE), _SCALE)


_GROUP = ["Q1", "Q2", "Q3", "Q4", "sweden", "nordic", "eu", "other"]


def _population(spark, folder):
    rows = D.device_indices(X.home_building(spark, folder), X.building_data(spark, folder))
    return cut_lineage(cluster.to_vector(cluster.standardise(rows, _GROUP), _GROUP))


@query("pca_95")
def pca_95(spark, folder):
    rows, _ = cluster.principal_components(_population(spark, folder), len(_GROUP), keep=0.95)
    return rows.select("device_aid", F.size("pca").alias("components"), F.round(F.col("pca")[0], 6).alias("pc1"))


@query("kmeans_groups")
def kmeans_groups(spark, folder):
    rows, _ = cluster.principal_components(_population(spark, folder), len(_GROUP), keep=0.95)
    rows = rows.select("device_aid", array_to_vector("pca").alias("features"))
    return cluster.k_means(rows, 4, first_label=1).groupBy("group").agg(F.count("*").alias("n"))


@query("kmeans_sweep")
def kmeans_sweep(spark, folder):
    return cluster.k_sweep(_population(spark, folder), range(2, 10))


@query("dbscan")
def dbscan(spark, folder):
    rows = X.table(spark, folder, "events").select("event_id", "value", (F.col("event_id") % 997 / 10).alias("y"))
    return cluster.dbscan(rows, "event_id", "value", "y", 0.5)


@query("label_prediction")
def label_prediction(spark, folder):
    rows = X.table(spark, folder, "embeddings").withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    return diagnose.predict_labels(rows, "features", "label", "vec_id")


@query("ridge_cv")
def ridge_cv(spark, folder):
    rows = X.table(spark, folder, "embeddings").withColumn("features", F.col("embedding").cast("array<double>"))
    return diagnose.ridge_cv(rows, "features", "label", "vec_id")


@query("embedding_zones", X.with_parts(
    """SELECT vec_id, device_aid, substr(deso, 1, 3) AS deso_r, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude
       FROM (SELECT vec_id, device_aid FROM embeddings JOIN (SELECT device_aid, row_number() OVER (ORDER BY device_aid) - 1 AS r,
         count(*) OVER () AS n FROM homes) ON vec_id % n = r) JOIN device_zone USING (device_aid)
       LEFT JOIN homes USING (device_aid) WHERE deso LIKE '01%'""", "device_zone", "homes"))
def embedding_zones(spark, folder):
    homes = X.device_homes(spark, folder)
    zones = spatial.within_zones(homes, X.zones(spark, folder), ["deso", "befolkning"])
    numbered = graph.dense_ids(homes, "device_aid", "number")
    vectors = X.table(spark, folder, "embeddings").select("vec_id", (F.col("vec_id") % homes.count()).alias("number"))
    vectors = vectors.join(numbered, "number").select("vec_id", "device_aid")
    out = embed.with_zone_and_home(vectors, zones, homes, "01")
    return rounded(out.select("vec_id", "device_aid", "deso_r", "latitude", "longitude"), ["latitude", "longitude"])


@query("cluster_shapes", X.with_parts(
    """SELECT h3_id, (h3_id % 5)::BIGINT AS cluster, CASE WHEN h3_id IN (SELECT h3_id FROM city) THEN 6 END AS corners
       FROM (SELECT DISTINCT h3_id FROM stops)""", "stops", "city"))
def cluster_shapes(spark, folder):
    stops = X.stops(spark, folder)
    clusters = stops.select("h3_id").distinct().withColumn("cluster", F.col("h3_id") % 5)
    out = embed.with_cell_shapes(clusters, D.city_visits(stops))
    return out.select("h3_id", "cluster", F.when(F.col("outline").isNotNull(), F.size("outline")).alias("corners"))
