"""Accession lists and the files that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cladeflow.functions import names

# File name endings by kind of record.
SUFFIX = {"genomic": "_genomic.fna.gz", "cds": "_cds_from_genomic.fna.gz", "protein": "_protein.faa.gz"}


def read_accessions(spark: SparkSession, path: str) -> DataFrame:
    """One accession per line; blank lines and source tags are dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias("accession")).where("accession <> ''")
    return lines.select(names.strip_tag(F.col("accession")).alias("accession"))


def single_accession(spark: SparkSession, accession: str) -> DataFrame:
    return spark.range(1).select(names.strip_tag(F.lit(accession)).alias("accession"))


def accessions_of(df: DataFrame, col: str | Column) -> DataFrame:
    """Distinct accessions of a metadata column, of tree tips or of a genome table."""
    column = F.col(col) if isinstance(col, str) else col
    return df.select(names.strip_tag(column).alias("accession")).distinct()


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """`path, modified, length` of every file below `root`; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def latest_per_key(listing: DataFrame, key: str, path: str, modified: str) -> DataFrame:
    """The most recently modified path of each key, the greatest path on ties, with the number of candidates."""
    newest = F.max_by(path, F.struct(modified, path))
    return listing.groupBy(key).agg(newest.alias(path), F.count(F.lit(1)).alias("n_files"))


def locate_files(listing: DataFrame, accessions: DataFrame, kind: str = "genomic") -> DataFrame:
    """`accession, path, n_files, status` for every asked accession.

    Several genomic files give the newest one (`newest of several`); several files of another kind, or none, have a
    NULL path and the reason in `status`.
    """
    base = F.substring_index("path", "/", -1)
    wanted = base.endswith(SUFFIX[kind])
    if kind == "genomic":
        wanted = wanted & ~base.contains("cds_from") & ~base.contains("rna_from")
    files = listing.where(wanted).withColumn("accession", names.path_accession(F.col("path")))
    asked = accessions.select(names.strip_tag(F.col("accession")).alias("accession")).distinct()
    found = asked.join(latest_per_key(files, "accession", "path", "modified"), "accession", "left").na.fill(0, ["n_files"])
    several = F.lit("newest of several" if kind == "genomic" else "several files")
    status = F.when(F.col("n_files") == 0, "no file").when(F.col("n_files") > 1, several).otherwise("found")
    usable = F.col("n_files") == 1 if kind != "genomic" else F.col("n_files") >= 1
    return found.withColumn("path", F.when(usable, F.col("path"))).withColumn("status", status)


def require_files(located: DataFrame) -> DataFrame:
    """The located files; fails when an accession has no usable one."""
    message = F.concat(F.lit("accession "), "accession", F.lit(": "), "status")
    return located.withColumn("path", F.coalesce("path", F.raise_error(message).cast("string")))
