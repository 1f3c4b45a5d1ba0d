"""Profiler tables inside text logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from cladeflow.operators import ordering

# How cells are set apart, and what the file name tells.
DELIMITER = r"\s*\|[_\s]*"
NAME_FIELDS = {"n_nodes": r"n(\d+)_", "n_gpu": r"_g(\d+)_", "batch_size": r"_b(\d+)_"}


def parse_profile_logs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """`path, n_nodes, n_gpu, batch_size, rank, action, total` for every row of every table.

    A table starts at a line with `Action`; its column with `Total` in the heading holds the time. It has all rows up to
    the first line that is neither a row nor a ruler, and a row `Total`, which becomes the action `total`. Tables of a
    file are numbered from 0 as ranks.
    """
    files = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    buckets, order = [F.shiftright("pos", 12)], [F.col("pos")]
    is_head = F.col("line").startswith("Action")
    is_ruler = F.col("line").startswith("-----")
    ends = ~is_head & ~is_ruler & ~F.col("line").contains("|")
    # After a line that ends a table, its rows are over until the next heading.
    mark = F.when(is_head, F.col("line")).when(ends, F.lit(""))
    lines = ordering.prefix(lines, ["path"], buckets, order, sums={"_table": is_head.cast("int")}, lasts={"_head": mark})
    lines = lines.where((F.col("_head") != "") & ~is_head & ~is_ruler & F.col("line").contains("|"))
    cells = F.split("line", DELIMITER)
    # The last heading with `Total` counts, as later headings overwrite earlier ones.
    at = F.array_max(F.filter(F.sequence(F.lit(0), F.size("_heads") - 1), lambda i: F.get("_heads", i).contains("Total")))
    lines = lines.withColumn("_heads", F.split("_head", DELIMITER)).withColumn("_at", at)
    is_total = F.col("line").startswith("Total")
    rows = lines.select("path", "pos", "_table", is_total.alias("_total"), F.get(cells, F.lit(0)).alias("action"), F.get(cells, F.col("_at")).alias("total"))
    fields = [F.regexp_extract("path", pattern, 1).try_cast("int").alias(name) for name, pattern in NAME_FIELDS.items()]
    action = F.when(F.col("_total"), "total").otherwise(F.trim("action"))
    return rows.select("path", *fields, (F.col("_table") - 1).alias("rank"), action.alias("action"), F.trim("total").try_cast("double").alias("total"))


def pivot_actions(rows: DataFrame, actions: Sequence[str]) -> DataFrame:
    """One row per file and rank, a column per asked action."""
    return rows.groupBy("path", "n_nodes", "n_gpu", "batch_size", "rank").pivot("action", list(actions)).agg(F.first("total"))
