"""Lowest common ancestor of alignment hits, and taxa of sequences from those of their ORFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def join_hits(hits: DataFrame, tax: DataFrame, subject: str) -> DataFrame:
    """Hits with the lineage of their subject, NULL ranks where it has none; repeated subjects stay repeated."""
    return hits.join(tax, subject, "left")


def near_best(hits: DataFrame, key: Sequence[str], score: str, frac: float) -> DataFrame:
    """Hits of at least `frac` of the best of their ORF; only best scores travel to meet the hits."""
    best = hits.groupBy(*key).agg(F.max(score).alias("_best"))
    return hits.join(best, list(key)).where(F.col(score) >= F.lit(frac) * F.col("_best")).drop("_best")


def hits_lca(
    hits: DataFrame,
    tax: DataFrame,
    key: Sequence[str],
    subject: str,
    score: str,
    ranks: Sequence[str],
    frac: float = 0.9,
) -> DataFrame:
    """Per ORF, the ranks on which all near-best hits with a lineage agree, and the mean score of all near-best hits.

    A hit counts when its score is at least `frac` of the best. ORFs none of whose hits has a lineage stay, with NULL
    ranks. Hits are combined by (ORF, score) before and after the shuffle; the window then sees one row per distinct
    score, so an ORF with very many hits needs no path of its own.
    """
    known = F.lit(True).alias("_known")
    named = hits.join(tax.select("*", known), subject, "left")
    known_rows = F.count("_known")
    bounds = [f(r).alias(f"_{name}_{r}") for r in ranks for name, f in (("low", F.min), ("high", F.max))]
    filled = [F.count(r).alias(f"_n_{r}") for r in ranks]
    by_score = named.groupBy(*key, score).agg(F.count(F.lit(1)).alias("_rows"), known_rows.alias("_with"), *bounds, *filled)
    best = F.max(score).over(Window.partitionBy(*key))
    near = by_score.withColumn("_best", best).where(F.col(score) >= F.lit(frac) * F.col("_best"))
    agreed = [
        F.when((F.min(f"_low_{r}") == F.max(f"_high_{r}")) & (F.sum(f"_n_{r}") == F.sum("_with")), F.min(f"_low_{r}")).alias(r) for r in ranks
    ]
    mean = F.sum(F.col(score) * F.col("_rows")) / F.sum("_rows")
    return near.groupBy(*key).agg(F.sum("_rows").alias("n_hits"), mean.alias(score), *agreed)


def aggregate_orfs(orfs: DataFrame, key: Sequence[str], score: str, ranks: Sequence[str], cutoff: float = 0.5) -> DataFrame:
    """Per sequence and rank, the taxon that holds at least `cutoff` of the total score, else NULL.

    ORFs without a taxon count in the total. Among several taxa the greater score wins, then the first name.
    """
    pairs = F.array(*[F.struct(F.lit(r).alias("rank"), F.col(r).alias("taxon")) for r in ranks])
    long = orfs.select(*key, score, F.explode(pairs).alias("_p")).select(*key, score, "_p.*")
    # NULL taxa are kept as a group of their own: the total of a rank is then the sum over its groups.
    by_taxon = long.groupBy(*key, "rank", "taxon").agg(F.sum(score).alias("_score"))
    picks = []
    for r in ranks:
        here = F.col("rank") == r
        named = here & F.col("taxon").isNotNull()
        order = F.when(named, F.struct(-F.col("_score"), F.col("taxon")))
        enough = F.max(F.when(named, F.col("_score"))) >= F.lit(cutoff) * F.sum(F.when(here, F.col("_score")))
        picks.append(F.when(enough, F.min_by("taxon", order)).alias(r))
    return by_taxon.groupBy(*key).agg(*picks)
