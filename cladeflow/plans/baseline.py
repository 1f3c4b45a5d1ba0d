"""Classification by alignment hits, from the hits to accuracy per domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cladeflow.functions import names
from cladeflow.operators import evaluate, lca
from cladeflow.sources import tables


def input_sequences(records: DataFrame) -> DataFrame:
    """`accession, seq_name` of all inputs, from headers `accession-length-name`."""
    parts = F.split("seq_id", "-", 3)
    return records.select(F.get(parts, F.lit(0)).alias("accession"), F.get(parts, F.lit(2)).alias("seq_name")).distinct()


def classify_by_hits(
    hits: DataFrame, taxonomy: DataFrame, ranks: Sequence[str] = names.RANKS, frac: float = 0.9, cutoff: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """(ORF taxa, sequence taxa) of `query, subject, bitscore` rows; `taxonomy` is `accession` and the ranks.

    An ORF takes the names on which all hits within `frac` of its best agree; a sequence takes, per rank, the name that
    holds `cutoff` of the scores of its ORFs.
    """
    split = tables.split_hits(hits)
    lineages = taxonomy.select(F.col("accession").alias("hit"), *ranks)
    orfs = lca.hits_lca(split, lineages, ["accession", "seq_name", "orf_id"], "hit", "bitscore", ranks, frac)
    return orfs, lca.aggregate_orfs(orfs, ["accession", "seq_name"], "bitscore", ranks, cutoff)


def hit_accuracy(inputs: DataFrame, classified: DataFrame, taxonomy: DataFrame, ranks: Sequence[str] = names.RANKS) -> DataFrame:
    """`rank, domain, share, accuracy, n` below the first rank, overall (`domain` NULL) and per true domain.

    Every input counts in the share, also one without a hit; accuracy is that of the classified ones. Inputs of genomes
    without a lineage are left out.
    """
    found = classified.select("accession", "seq_name", *[F.col(r).alias(f"pred_{r}") for r in ranks])
    truth = taxonomy.select("accession", *[F.col(r).alias(f"truth_{r}") for r in ranks])
    rows = inputs.join(found, ["accession", "seq_name"], "left").join(truth, "accession")
    return evaluate.report_by_domain(rows, f"truth_{ranks[0]}", ranks[1:])


def alignment_baseline(
    hits: DataFrame, records: DataFrame, taxonomy: DataFrame, ranks: Sequence[str] = names.RANKS, frac: float = 0.9, cutoff: float = 0.5
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ORF taxa, sequence taxa, accuracy) of hits against the sequences in `records`."""
    orfs, classified = classify_by_hits(hits, taxonomy, ranks, frac, cutoff)
    return orfs, classified, hit_accuracy(input_sequences(records), classified, taxonomy, ranks)
