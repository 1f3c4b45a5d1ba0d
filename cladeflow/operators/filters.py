"""Row filters and set operations keyed by columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cladeflow.functions import names


def filter_ncbi(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose accession columns all come from the NCBI archives."""
    return df.where(reduce(lambda a, b: a & b, [names.is_ncbi(F.col(c)) for c in cols]))


def filter_reps(df: DataFrame, accession: str, rep: str, keep: bool = True) -> DataFrame:
    """Only the representatives, or (`keep=False`) everything but them."""
    is_rep = F.col(accession) == F.col(rep)
    return df.where(is_rep if keep else ~is_rep)


def keep_keys(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, on, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, on, "left_anti")


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def missing_keys(asked: DataFrame, found: DataFrame, on) -> DataFrame:
    """Keys asked for but not found."""
    return asked.join(found, on, "left_anti").distinct()


def merge_tables(*dfs: DataFrame) -> DataFrame:
    """Concatenate by name; a column that a table lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def filter_min_len(df: DataFrame, seq: str, minimum: int) -> DataFrame:
    """Strictly longer than `minimum`."""
    return df.where(F.length(seq) > minimum)


def protein_qc(df: DataFrame, seq: str, max_bad: float = 0.25) -> DataFrame:
    """At most one stop, and a share of degenerate residues and gaps of at most `max_bad`; trailing stop trimmed.

    Gaps count only in a sequence that has a degenerate residue, and shares are of the trimmed length.
    """
    # Degenerate amino acids, gap characters, stop.
    degenerate, gap, stop = "[BZXJ]", "[.-]", r"\*"
    body = F.regexp_replace(seq, r"\*$", "")
    n_degenerate = F.regexp_count(body, F.lit(degenerate))
    bad = (n_degenerate + F.regexp_count(body, F.lit(gap))) / F.length(body)
    kept = df.where(F.regexp_count(seq, F.lit(stop)) <= 1).where((n_degenerate == 0) | (bad <= max_bad))
    return kept.withColumn(seq, body)


def drop_unlabelled(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull())


def labelled_share(df: DataFrame, label: str) -> DataFrame:
    """`n, n_kept, share` of the labelled rows."""
    kept = F.count(label)
    return df.agg(F.count(F.lit(1)).alias("n"), kept.alias("n_kept"), F.try_divide(kept, F.count(F.lit(1))).alias("share"))


def filter_score(df: DataFrame, score: str, minimum: float) -> DataFrame:
    return df.where(F.col(score) >= minimum)


def drop_nan_pairs(df: DataFrame, *cols: str) -> DataFrame:
    """Rows where none of the columns is NULL or NaN."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in cols]))


def named_taxa(taxa: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Taxa split by whether their name has an underscore: (kept, rejected)."""
    has_mark: Column = F.col(name).contains("_")
    return taxa.where(has_mark), taxa.where(~has_mark)


def trim_distances(d: DataFrame, taxa: DataFrame, key: str) -> DataFrame:
    """Distance pairs of which both ends are in `taxa`."""
    ends = taxa.select(F.col(key).alias("_end"))
    for end in ("a", "b"):
        d = d.join(ends, F.col(end) == F.col("_end"), "left_semi")
    return d


def get_rows(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the asked ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi")
