"""Delimited text and Parquet tables, all with declared schemas."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cladeflow.functions import names
from cladeflow.operators import filters

# Column layouts of the exchanged files.
METADATA = {
    "accession": "string",
    "gtdb_taxonomy": "string",
    "gtdb_genome_representative": "string",
    "contig_count": "int",
    "checkm_completeness": "double",
}
HITS = ("query string, subject string, identity double, length int, mismatches int, gaps int, q_start int, q_end int, "
        "s_start int, s_end int, evalue double, bitscore double")  # fmt: skip
CLASSIFICATIONS = {
    "kmer": "ID string, status string, superkingdom string, phylum string, `class` string, `order` string, family string, "
    "genus string, species string, strain string",
    "model": "filename string, ID string, domain string, phylum string, `class` string, `order` string, family string, "
    "genus string, species string, score double",
}
METRICS = {
    "epoch": "int",
    "step": "bigint",
    "time": "double",
    "training_loss": "double",
    "training_acc": "double",
    "validation_loss": "double",
    "validation_acc": "double",
    "lr": "double",
}


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    return spark.read.text(path).first()[0].split(sep)


def read_metadata(spark: SparkSession, path: str, cols: Sequence[str] = tuple(METADATA), epithet: bool = False) -> DataFrame:
    """Genome metadata from a tab-separated file: source tags stripped, lineage split into its ranks.

    The file may hold any other columns; only the asked ones are parsed.
    """
    schema = ", ".join(f"`{c}` {METADATA.get(c, 'string')}" for c in _header(spark, path, "\t"))
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema).select(*cols)
    for col in ("accession", "gtdb_genome_representative"):
        if col in cols:
            rows = rows.withColumn(col, names.strip_tag(F.col(col)))
    if "gtdb_taxonomy" in cols:
        rows = rows.select(*[c for c in cols if c != "gtdb_taxonomy"], *names.split_lineage(F.col("gtdb_taxonomy"), epithet))
    return rows


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """`query, subject, bitscore` of twelve-column tabular alignments."""
    return spark.read.csv(path, sep="\t", schema=HITS).select("query", "subject", "bitscore")


def split_hits(hits: DataFrame) -> DataFrame:
    """Hits with their ids taken apart: `accession, seq_name, orf_id, hit, bitscore`."""
    accession, _, seq_name, orf_id = names.parse_query_id(F.col("query"))
    return hits.select(accession, seq_name, orf_id, names.parse_subject_id(F.col("subject")).alias("hit"), "bitscore")


def read_classifications(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Sequence classifications of a k-mer tool (`kmer`) or of a model (`model`), empty names as NULL."""
    rows = spark.read.csv(path, header=True, schema=CLASSIFICATIONS[fmt])
    if fmt == "kmer":
        rows = rows.withColumnRenamed("superkingdom", "domain").drop("strain")
    ranks = [F.when(F.trim(r) != "", F.col(r)).alias(r) for r in names.RANKS]
    others = [c for c in rows.columns if c not in names.RANKS]
    return rows.select(*others, *ranks)


def read_metrics(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Training logs, each with its own subset of the columns; what a log lacks is NULL."""
    logs = []
    for path in paths:
        schema = ", ".join(f"`{c}` {METRICS.get(c, 'double')}" for c in _header(spark, path, ","))
        logs.append(spark.read.csv(path, header=True, schema=schema))
    return filters.merge_tables(*logs)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.csv(path, sep=sep, header=True)


def write_vectors(df: DataFrame, path: str, name: str, vec: str) -> None:
    """Named vectors `name, vec`."""
    df.select(F.col(name).cast("string").alias("name"), F.col(vec).cast("array<float>").alias("vec")).write.parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, vec array<float>").parquet(path)


def write_distances(d: DataFrame, path: str) -> None:
    """Distance pairs `a, b, d`, the ends in order."""
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    d.select(*ends, F.col("d").cast("float").alias("d")).write.parquet(path)


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("a", "b", "d")


def write_tnf(freq: DataFrame, path: str) -> None:
    """k-mer frequencies in long form, `name, kmer, freq`."""
    freq.write.parquet(path)


def read_tnf(spark: SparkSession, path: str, vectors: DataFrame | None = None) -> DataFrame:
    """k-mer frequencies, with the target vector of each name when given."""
    freq = spark.read.schema("name string, kmer string, freq double").parquet(path)
    return freq if vectors is None else freq.join(vectors, "name")


def write_summary(tables: Mapping[str, DataFrame], path: str) -> None:
    """Result tables side by side in one folder."""
    for name, df in tables.items():
        df.write.parquet(os.path.join(path, name))


def read_summary(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(path, name))


# -- the linked tables of a data set -----------------------------------------------------------------------------


def write_dataset(path: str, sequences: DataFrame, taxa: DataFrame, genomes: DataFrame, n_buckets: int = 64, **extra: DataFrame) -> None:
    """`sequences`, `taxa`, `genomes` and any of `distances`, `tree_edges`.

    Sequences are spread over buckets by record, so that one large genome does not end in one file, and sorted by
    genome inside them, so that a filter on the genome skips row groups.
    """
    # A bucket has as many tasks as the input has partitions for it.
    tasks = math.ceil(sequences.rdd.getNumPartitions() / n_buckets)
    bucket = F.pmod(F.xxhash64("seq_id"), F.lit(n_buckets)).cast("int")
    part = F.pmod(F.xxhash64("seq_id", F.lit(1)), F.lit(tasks)).cast("int")
    dealt = sequences.withColumn("bucket", bucket).repartitionById(n_buckets * tasks, F.col("bucket") * tasks + part)
    spread = dealt.sortWithinPartitions("bucket", "genome_id")
    spread.write.partitionBy("bucket").parquet(os.path.join(path, "sequences"))
    for name, df in {"taxa": taxa, "genomes": genomes, **extra}.items():
        df.write.parquet(os.path.join(path, name))


def read_dataset(spark: SparkSession, path: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(path, name))
    return df.drop("bucket") if name == "sequences" else df
