"""Class counts, hierarchy checks and sampling of genomes by taxon."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import LINEAGE_CTE, REPS_CTE, Catalog, lineage, members, table
from cladeflow.operators import taxonomy

catalog = Catalog()

EXTREMES_SQL = f"""
WITH {REPS_CTE}, m AS (SELECT * FROM members WHERE accession <> rep),
p1 AS (SELECT arg_min(accession, (contig_count, accession)) AS accession FROM m GROUP BY rep
  UNION SELECT arg_min(accession, (-contig_count, accession)) FROM m GROUP BY rep),
m2 AS (SELECT * FROM m WHERE accession NOT IN (FROM p1)),
p2 AS (SELECT arg_min(accession, (contig_count, accession)) AS accession FROM m2 GROUP BY rep
  UNION SELECT arg_min(accession, (-contig_count, accession)) FROM m2 GROUP BY rep)
SELECT accession, 1 AS round FROM p1 UNION ALL SELECT accession, 2 FROM p2"""


@catalog.add("a14_extreme_members", EXTREMES_SQL)
def extreme_members(spark, sf):
    return taxonomy.extreme_members(members(spark, sf), "rep", "accession", "contig_count", rounds=2)


@catalog.add("a15_level_cardinality", f"""
WITH {LINEAGE_CTE} SELECT 'domain' AS level, count(DISTINCT r_name) AS n_classes FROM lineage
UNION ALL SELECT 'phylum', count(DISTINCT n_name) FROM lineage UNION ALL SELECT 'species', count(DISTINCT s_name) FROM lineage
""")
def level_cardinality(spark, sf):
    taxa = lineage(spark, sf).select(
        F.col("r_name").alias("domain"), F.col("n_name").alias("phylum"), F.col("s_name").alias("species")
    )
    return taxonomy.level_cardinality(taxa, ["domain", "phylum", "species"])


@catalog.add("a16_outputs_map", f"""
WITH {LINEAGE_CTE} SELECT 'nation' AS kind, n_name AS child, min(r_name) AS parent, count(DISTINCT r_name) AS n_parents
FROM lineage GROUP BY n_name
UNION ALL SELECT 'brand', p_brand, min(p_type), count(DISTINCT p_type) FROM part GROUP BY p_brand""")
def outputs_map(spark, sf):
    strict = taxonomy.outputs_map(lineage(spark, sf), "r_name", "n_name")
    loose = taxonomy.outputs_map(table(spark, sf, "part"), "p_type", "p_brand")
    named = [
        df.select(F.lit(kind).alias("kind"), F.col(child).alias("child"), F.col(parent).alias("parent"), "n_parents")
        for df, kind, child, parent in ((strict, "nation", "n_name", "r_name"), (loose, "brand", "p_brand", "p_type"))
    ]
    return named[0].unionByName(named[1])


@catalog.add("j17_sample_nonreps", f"""
WITH {REPS_CTE}, asked AS (SELECT DISTINCT rep FROM members WHERE rep % 2 = 0),
r AS (SELECT rep, accession, row_number() OVER (PARTITION BY rep ORDER BY accession) AS rn FROM members
  WHERE accession <> rep AND rep IN (FROM asked)),
n AS (SELECT asked.rep, count(accession) AS n FROM asked LEFT JOIN r USING (rep) GROUP BY asked.rep)
SELECT rep, accession, 'strain' AS kind FROM r WHERE rn <= 4 UNION ALL SELECT rep, rep, 'strain' FROM asked
UNION ALL SELECT rep, n, 'short' FROM n WHERE n < 80""")
def sample_nonreps(spark, sf):
    meta = members(spark, sf)
    asked = meta.where("rep % 2 = 0")
    strains = taxonomy.sample_nonreps(meta, asked, "accession", "rep", "accession", 4, include_self=True)
    short = taxonomy.strain_shortages(meta, asked, "accession", "rep", 80)
    rows = strains.select("rep", "accession", F.lit("strain").alias("kind"))
    return rows.unionByName(short.select("rep", F.col("n_found").alias("accession"), F.lit("short").alias("kind")))


@catalog.add("w07_sample_taxa", """
WITH s AS (SELECT p_type, p_brand, p_name, count(*) AS ns, min(p_partkey) AS p_partkey FROM part GROUP BY ALL),
g AS (SELECT p_type, p_brand, sum(ns) AS ng FROM s GROUP BY ALL), c AS (SELECT p_type, sum(ng) AS nc FROM g GROUP BY ALL),
tc AS (SELECT * FROM c ORDER BY nc DESC, p_type LIMIT 3),
tg AS (SELECT * FROM (SELECT g.*, nc, row_number() OVER (PARTITION BY p_type ORDER BY ng DESC, p_brand) AS rn
  FROM g JOIN tc USING (p_type)) WHERE rn <= 4),
ts AS (SELECT * FROM (SELECT s.*, ng, nc, row_number() OVER (PARTITION BY s.p_type, s.p_brand ORDER BY ns DESC, p_name) AS rs
  FROM s JOIN tg ON s.p_type = tg.p_type AND s.p_brand = tg.p_brand) WHERE rs <= 5)
SELECT p_type, p_brand, p_name, p_partkey FROM ts ORDER BY nc DESC, p_type, ng DESC, p_brand, ns DESC, p_name LIMIT 50""")
def sample_taxa(spark, sf):
    return taxonomy.sample_taxa(table(spark, sf, "part"), ("p_type", "p_brand", "p_name"), "p_partkey", 3, 4, 5, 50)
