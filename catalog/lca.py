"""Alignment-hit baseline: hits to ORF taxa to sequence taxa."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import HITS_CTE, TAX_CTE, Catalog, hits, subject_taxonomy, table
from cladeflow.operators import lca

catalog = Catalog()

RANKS = ("domain", "phylum", "species")

ORF_CTE = f"""{HITS_CTE}, {TAX_CTE},
near AS (SELECT *, max(bitscore) OVER (PARTITION BY orf) AS best FROM hits QUALIFY bitscore >= CAST(0.9 AS DOUBLE) * best),
orf_lca AS (SELECT orf, count(*) AS n_hits, avg(bitscore) AS bitscore,
  CASE WHEN count(DISTINCT domain) = 1 THEN min(domain) END AS domain,
  CASE WHEN count(DISTINCT phylum) = 1 THEN min(phylum) END AS phylum,
  CASE WHEN count(DISTINCT species) = 1 THEN min(species) END AS species
  FROM near LEFT JOIN tax USING (subject) GROUP BY orf)"""


def orf_taxa(spark, sf):
    return lca.hits_lca(hits(spark, sf), subject_taxonomy(spark, sf), ["orf"], "subject", "bitscore", RANKS)


@catalog.add("j06_join_hits", f"""
WITH {HITS_CTE}, {TAX_CTE} SELECT orf, subject, bitscore, domain, phylum, species FROM hits LEFT JOIN tax USING (subject)""")
def join_hits(spark, sf):
    return lca.join_hits(hits(spark, sf), subject_taxonomy(spark, sf), "subject")


@catalog.add("a18_hits_lca", f"""
WITH {ORF_CTE} SELECT orf, n_hits, bitscore, domain, phylum, species FROM orf_lca""")
def hits_lca(spark, sf):
    return orf_taxa(spark, sf)


@catalog.add("a19_aggregate_orfs", f"""
WITH {ORF_CTE}, o AS (SELECT o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS score, domain, phylum, species
  FROM orders JOIN orf_lca ON o_orderkey = orf),
t AS (SELECT o_custkey, sum(score) AS total FROM o GROUP BY o_custkey),
l AS (SELECT o_custkey, rank, taxon, sum(score) AS s FROM (
    SELECT o_custkey, score, 'domain' AS rank, domain AS taxon FROM o
    UNION ALL SELECT o_custkey, score, 'phylum', phylum FROM o
    UNION ALL SELECT o_custkey, score, 'species', species FROM o) WHERE taxon IS NOT NULL GROUP BY ALL),
w AS (SELECT o_custkey, rank, arg_min(taxon, (-s, taxon)) AS taxon FROM l JOIN t USING (o_custkey) WHERE s >= 0.5 * total
  GROUP BY ALL)
SELECT t.o_custkey, max(taxon) FILTER (rank = 'domain') AS domain, max(taxon) FILTER (rank = 'phylum') AS phylum,
  max(taxon) FILTER (rank = 'species') AS species FROM t LEFT JOIN w USING (o_custkey) GROUP BY t.o_custkey""")
def aggregate_orfs(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("orf"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("score")
    )
    orfs = orders.join(orf_taxa(spark, sf).drop("bitscore", "n_hits"), "orf")
    return lca.aggregate_orfs(orfs, ["o_custkey"], "score", RANKS)
