"""Nearest-neighbour graphs over the distance table of the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import DIST_CTE, Catalog, distances, table
from catalog.windowing import lengths
from cladeflow.operators import graph

catalog = Catalog()

K = 3
KNN_CTE = f"""{DIST_CTE}, two AS (SELECT a AS id, b AS neighbour, d FROM dist UNION ALL SELECT b, a, d FROM dist),
knn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS rank FROM two QUALIFY rank <= {K}),
scale AS (SELECT id, min(d) AS rho, max(d) AS sigma FROM knn GROUP BY id),
w AS (SELECT k.id AS src, k.neighbour AS dst, exp((s.rho - k.d) / s.sigma) AS p, exp((t.rho - k.d) / t.sigma) AS q
  FROM knn k JOIN scale s ON k.id = s.id JOIN scale t ON k.neighbour = t.id)"""


def knn(spark, sf):
    return graph.knn_graph(distances(spark, sf).select("a", "b", "d"), K)


def links(spark, sf):
    """First neighbours only, both directions: a graph of several components."""
    first = knn(spark, sf).where("rank = 1")
    return graph.both_directions(first, "id", "neighbour")


@catalog.add("g06_fuzzy_graph", f"WITH {KNN_CTE} SELECT src, dst, round(p + q - p * q, 6) AS p FROM w")
def fuzzy_graph(spark, sf):
    return graph.fuzzy_graph(knn(spark, sf)).withColumn("p", F.round("p", 6))


@catalog.add("g07_components", f"""
WITH RECURSIVE {KNN_CTE}, e AS (SELECT id AS s, neighbour AS t FROM knn WHERE rank = 1
  UNION SELECT neighbour, id FROM knn WHERE rank = 1),
reach AS (SELECT DISTINCT s AS id, s AS other FROM e UNION SELECT r.id, e.t FROM reach r JOIN e ON r.other = e.s)
SELECT id, min(other) AS component FROM reach GROUP BY id""")
def components(spark, sf):
    return graph.components(links(spark, sf))


@catalog.add("g08_bfs_order", f"""
WITH RECURSIVE {KNN_CTE}, e AS (SELECT id AS s, neighbour AS t FROM knn WHERE rank = 1
  UNION SELECT neighbour, id FROM knn WHERE rank = 1),
reach AS (SELECT DISTINCT s AS id, s AS other FROM e UNION SELECT r.id, e.t FROM reach r JOIN e ON r.other = e.s),
comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id),
walk AS (SELECT DISTINCT component, component AS id, 0 AS level FROM comp
  UNION SELECT w.component, e.t, w.level + 1 FROM walk w JOIN e ON w.id = e.s WHERE w.level < 60),
lv AS (SELECT component, id, min(level) AS level FROM walk GROUP BY component, id)
SELECT component, id, level, row_number() OVER (ORDER BY component, level, id) - 1 AS position FROM lv""")
def bfs_order(spark, sf):
    return graph.bfs_order(links(spark, sf))


@catalog.add("g09_partition_graph")
def partition_graph(spark, sf):
    edges = graph.fuzzy_graph(knn(spark, sf))
    doubled = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    sizes = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").cast("bigint").alias("size"))
    parts, inside = graph.partition_graph(doubled, sizes, 4)
    kept = inside.groupBy("part").agg(F.count(F.lit(1)).alias("n_edges"))
    report = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("size").alias("size"))
    return report.join(kept, "part", "left")


@catalog.add("g11_edge_pairs")
def edge_pairs(spark, sf):
    edges = graph.fuzzy_graph(knn(spark, sf))
    windows = lengths(spark, sf).select((F.col("seq_id") % 100).alias("label"), F.col("seq_id").alias("window_id"))
    return graph.edge_pairs(edges, windows, 500, 13)
