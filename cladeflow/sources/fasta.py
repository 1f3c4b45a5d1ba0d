"""FASTA records as rows, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cladeflow.functions import sequence as S

# A record ends where a line starts with the header mark.
RECORD_SEPARATOR = "\n>"


def parse_records(raw: DataFrame) -> DataFrame:
    """`path, seq_id, description, sequence, length` out of raw record text in `value` and its `path`."""
    text = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    header = F.substring_index("_text", "\n", 1)
    body = F.when(F.instr("_text", "\n") > 0, F.expr("substr(_text, instr(_text, '\n') + 1)")).otherwise("")
    rows = raw.select("path", text.alias("_text")).where(F.trim("_text") != "")
    return rows.select(
        "path",
        F.regexp_extract(header, r"^(\S*)", 1).alias("seq_id"),
        F.trim(F.regexp_extract(header, r"^\S*\s*(.*)$", 1)).alias("description"),
        F.regexp_replace(body, r"\s", "").alias("sequence"),
    ).withColumn("length", F.length("sequence"))


def read_fasta(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """One row per record of plain or gzipped FASTA files; residues are not checked against an alphabet.

    Plain files are split at records. A gzipped file is one task: keep such files small and many.
    """
    reader = spark.read.option("lineSep", RECORD_SEPARATOR).option("recursiveFileLookup", recursive)
    paths = [paths] if isinstance(paths, str) else list(paths)
    return parse_records(reader.text(paths).select("value", F.col("_metadata.file_path").alias("path")))


def format_records(df: DataFrame, header: Column, seq: str, width: int = 100) -> DataFrame:
    """FASTA text of every row, in `value`; a record without residues is its header alone."""
    body = F.when(F.length(seq) > 0, F.concat(F.lit("\n"), S.wrap(F.col(seq), width))).otherwise("")
    return df.select(F.concat(F.lit(">"), header, body).alias("value"))


def write_fasta(df: DataFrame, path: str, header: Column, seq: str, width: int = 100, compression: str = "none") -> None:
    """Records with the given header and lines of `width` residues."""
    format_records(df, header, seq, width).write.option("compression", compression).text(path)


def write_splits(df: DataFrame, path: str, bucket: str = "bucket") -> None:
    """One folder of plain lists per bucket; the remaining single column holds the entries.

    Tasks take ranges of (bucket, entry): a bucket is written by as many tasks as its size asks for.
    """
    df.repartitionByRange(bucket, *[c for c in df.columns if c != bucket]).write.partitionBy(bucket).text(path)
