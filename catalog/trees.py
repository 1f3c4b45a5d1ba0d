"""The region–nation–customer tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import CLOSURE_CTE, EDGES_CTE, Catalog, table, tree_edges
from cladeflow.operators import taxonomy, trees

catalog = Catalog()

# Asked pairs: the customers of successive orders.
TIP_PAIRS_CTE = """tip_pairs AS (SELECT DISTINCT 'c' || x.o_custkey AS a, 'c' || y.o_custkey AS b FROM orders x
  JOIN orders y ON y.o_orderkey = x.o_orderkey + 1)"""
PATRISTIC_CTE = CLOSURE_CTE + f""", {TIP_PAIRS_CTE},
tip_dist AS (SELECT p.a, p.b, min(x.dist + y.dist) AS d FROM tip_pairs p JOIN closure x ON x.node = p.a
  JOIN closure y ON y.node = p.b AND y.ancestor = x.ancestor GROUP BY p.a, p.b)"""


def tip_pairs(spark, sf):
    """Distinct pairs of customers whose orders have successive keys."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("c"))
    after = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("c").alias("b"))
    return orders.withColumnRenamed("c", "a").join(after, "o_orderkey").select("a", "b").distinct()


@catalog.add("g01_ancestor_closure", f"""
WITH RECURSIVE {CLOSURE_CTE} SELECT node, ancestor, hops, round(dist, 6) AS dist FROM closure""")
def ancestor_closure(spark, sf):
    return trees.ancestor_closure(tree_edges(spark, sf)).withColumn("dist", F.round("dist", 6))


@catalog.add("g02_patristic", f"WITH RECURSIVE {PATRISTIC_CTE} SELECT a, b, round(d, 6) AS d FROM tip_dist")
def patristic(spark, sf):
    return trees.patristic(trees.lift(tree_edges(spark, sf)), tip_pairs(spark, sf)).withColumn("d", F.round("d", 6))


@catalog.add("g03_all_node_distances", f"""
WITH RECURSIVE {CLOSURE_CTE}, p AS (SELECT DISTINCT 'c' || o_custkey AS a, 'n' || o_custkey % 25 AS b FROM orders
  UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation)
SELECT p.a, p.b, round(min(x.dist + y.dist), 6) AS d FROM p JOIN closure x ON x.node = p.a
JOIN closure y ON y.node = p.b AND y.ancestor = x.ancestor GROUP BY p.a, p.b""")
def all_node_distances(spark, sf):
    def text(prefix, col):
        return F.concat(F.lit(prefix), col.cast("string"))

    customers = table(spark, sf, "orders").select(text("c", F.col("o_custkey")).alias("a"), text("n", F.col("o_custkey") % 25).alias("b"))
    inner = table(spark, sf, "nation").select(text("r", F.col("n_regionkey")).alias("a"), text("n", F.col("n_nationkey")).alias("b"))
    return trees.patristic(trees.lift(tree_edges(spark, sf)), customers.unionByName(inner)).withColumn("d", F.round("d", 6))


@catalog.add("g04_phylo_stats", f"""
WITH RECURSIVE {CLOSURE_CTE}, meta AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS nation, c_mktsegment AS segment,
  CASE WHEN c_custkey % 50 = 0 THEN 'odd' ELSE 'n' || c_nationkey END AS mixed FROM customer),
m AS (SELECT node, 'nation' AS rank, nation AS taxon FROM meta UNION ALL SELECT node, 'segment', segment FROM meta
  UNION ALL SELECT node, 'mixed', mixed FROM meta),
s AS (SELECT rank, taxon, count(*) AS size FROM m GROUP BY ALL),
h AS (SELECT rank, taxon, ancestor, count(*) AS k FROM m JOIN closure USING (node) GROUP BY ALL),
t AS (SELECT ancestor, count(*) AS tips FROM closure WHERE node IN (SELECT node FROM meta) GROUP BY ancestor),
c AS (SELECT rank, taxon, min(tips) AS c FROM h JOIN s USING (rank, taxon) JOIN t USING (ancestor) WHERE k = size GROUP BY ALL)
SELECT rank, round(sum(c) / (SELECT count(*) FROM meta), 6) AS score FROM c GROUP BY rank""")
def phylo_stats(spark, sf):
    nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    meta = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("tip"),
        nation.alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_custkey") % 50 == 0, "odd").otherwise(nation).alias("mixed"),
    )
    return trees.phylo_stats(trees.lift(tree_edges(spark, sf)), meta, ["nation", "segment", "mixed"]).withColumn("score", F.round("score", 6))


def moved_edges(spark, sf):
    """The tree with a tenth of the customers of four nations under the next nation, and other lengths."""
    key = F.substr("child", F.lit(2)).cast("bigint")
    moved = F.col("is_tip") & (key % 10 == 0) & F.col("parent").isin("n1", "n6", "n7", "n20")
    other = F.concat(F.lit("n"), ((F.substr("parent", F.lit(2)).cast("int") + 1) % 25).cast("string"))
    return tree_edges(spark, sf).select(
        "child", F.when(moved, other).otherwise(F.col("parent")).alias("parent"), (F.col("length") * 2 + 1).alias("length"), "is_tip"
    )


MOVED_CTE = """edges2 AS (SELECT child, CASE WHEN is_tip AND CAST(substr(child, 2) AS BIGINT) % 10 = 0
  AND parent IN ('n1', 'n6', 'n7', 'n20') THEN 'n' || (CAST(substr(parent, 2) AS INT) + 1) % 25 ELSE parent END AS parent, length * 2 + 1 AS length, is_tip FROM edges),
up2 AS (SELECT child AS node, child AS ancestor, CAST(0 AS DOUBLE) AS dist FROM edges2
  UNION ALL SELECT u.node, e.parent, u.dist + e.length FROM up2 u JOIN edges2 e ON u.ancestor = e.child)"""


@catalog.add("g05_compare_trees", f"""
WITH RECURSIVE {PATRISTIC_CTE}, {MOVED_CTE},
t2 AS (SELECT p.a, p.b, min(x.dist + y.dist) AS d FROM tip_pairs p JOIN up2 x ON x.node = p.a
  JOIN up2 y ON y.node = p.b AND y.ancestor = x.ancestor GROUP BY p.a, p.b),
c1 AS (SELECT DISTINCT string_agg(node, ',' ORDER BY node) AS clade FROM up WHERE node LIKE 'c%' AND ancestor <> 'root'
  GROUP BY ancestor HAVING count(*) > 1),
c2 AS (SELECT DISTINCT string_agg(node, ',' ORDER BY node) AS clade FROM up2 WHERE node LIKE 'c%' AND ancestor <> 'root'
  GROUP BY ancestor HAVING count(*) > 1),
n AS (SELECT (SELECT count(*) FROM c1) AS n1, (SELECT count(*) FROM c2) AS n2,
  (SELECT count(*) FROM c1 JOIN c2 USING (clade)) AS n_shared, (SELECT corr(x.d, y.d) FROM tip_dist x JOIN t2 y USING (a, b)) AS r)
SELECT n1, n2, n_shared, round((1 - r) / 2, 6) AS tip_distance, round(1 - 2 * n_shared / (n1 + n2), 6) AS subset_distance FROM n""")
def compare_trees(spark, sf):
    tips = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("tip"))
    first, second = (trees.lift(e) for e in (tree_edges(spark, sf), moved_edges(spark, sf)))
    found = trees.compare_trees(first, second, tips, tip_pairs(spark, sf))
    return found.select(
        "n1", "n2", "n_shared", F.round("tip_distance", 6).alias("tip_distance"), F.round("subset_distance", 6).alias("subset_distance")
    )


@catalog.add("g10_tree_nodes", f"""
WITH {EDGES_CTE} SELECT child AS node, parent, round(length, 6) AS length, coalesce(c_custkey, -1) AS genome FROM edges
LEFT JOIN customer ON child = 'c' || c_custkey UNION ALL SELECT 'root', NULL, NULL, -1""")
def tree_nodes(spark, sf):
    genomes = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"))
    nodes = trees.tree_nodes(tree_edges(spark, sf), genomes, "name", "c_custkey")
    return nodes.withColumn("length", F.round("length", 6))


SHEAR_SQL = f"""
WITH RECURSIVE {CLOSURE_CTE}, w AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_acctbal > 9000),
kept AS (SELECT DISTINCT ancestor AS node FROM closure WHERE node IN (FROM w)),
forks AS (SELECT parent AS node FROM edges WHERE child IN (FROM kept) GROUP BY parent HAVING count(*) > 1),
retained AS (FROM w UNION FROM forks)
SELECT node AS child, arg_min(ancestor, hops) AS parent, round(arg_min(dist, hops), 6) AS length FROM closure
WHERE hops > 0 AND node IN (FROM retained) AND ancestor IN (FROM retained) GROUP BY node"""


@catalog.add("p10_shear_tree", SHEAR_SQL)
def shear_tree(spark, sf):
    tips = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("tip"))
    sheared = trees.shear_tree(trees.lift(tree_edges(spark, sf)), tips)
    return sheared.withColumn("length", F.round("length", 6))


@catalog.add("j04_restrict_to_tree", f"""
WITH {EDGES_CTE}, meta AS (SELECT 'c' || o_custkey AS tip, count(*) AS n FROM orders GROUP BY 1
  UNION ALL SELECT 'n' || n_nationkey, 0 FROM nation)
SELECT tip, n FROM meta WHERE tip IN (SELECT child FROM edges WHERE is_tip)""")
def restrict_to_tree(spark, sf):
    tip = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    meta = table(spark, sf, "orders").groupBy(tip.alias("tip")).agg(F.count(F.lit(1)).alias("n"))
    inner = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("tip"), F.lit(0).cast("bigint").alias("n"))
    return taxonomy.restrict_to_tree(meta.unionByName(inner), tree_edges(spark, sf), "tip")
