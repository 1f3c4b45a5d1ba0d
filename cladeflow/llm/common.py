"""What several operators share: row numbers, buckets and connected components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cladeflow.session import remove, scratch, settle

__all__ = ["table", "text_of", "number_rows", "power_buckets", "components", "settle", "WORD"]

# Fixed value: a word is a run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str) -> Column:
    """A text column, null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def number_rows(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """Add the 0-based position in a total order as `name`.

    Rows are dealt by ranges of the order, numbered inside each range and shifted by the number of rows before it, so no
    task holds more than a range. Rows that tie in the whole order meet in one range.
    """
    parted = settle(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return parted.join(offsets, "_range").withColumn(name, F.col("_offset") + inside - 1).drop("_range", "_offset")


def power_buckets(rows: int, per_bucket: int, least: int, most: int) -> int:
    """A power of two of buckets with about `per_bucket` rows in each, between 2^least and 2^most."""
    return 1 << min(most, max(least, math.ceil(math.log2(max(1, rows / per_bucket)))))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """`node, component`: the least node reachable over undirected edges, for each node that has an edge.

    Each round hands every node the least label among its neighbours and then the label of that label, so the number of
    rounds grows with the logarithm of a chain's length. Labels are written to the shared folder between rounds; the
    loop ends when no label has changed. Minima are combined before the shuffle, and joins on a node with many edges are
    left to adaptive skew handling.
    """
    spark = edges.sparkSession
    one_way = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("src"), F.col(b).alias("dst"))
    links = settle(one_way.union(one_way.select("dst", "src")).distinct(), "links")
    labels = settle(links.groupBy(F.col("src").alias("node")).agg(F.least("node", F.min("dst")).alias("component")), "labels")
    last = None
    while True:
        offers = links.join(labels, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("_offer"))
        lower = labels.join(offers, "node").select("node", "component", F.least("component", "_offer").alias("_least"))
        roots = labels.select(F.col("node").alias("_least"), F.col("component").alias("_jump"))
        moved = lower.join(roots, "_least", "left").select(
            "node", F.least("_least", F.coalesce("_jump", "_least")).alias("_new"), F.col("component").alias("_old")
        )
        folder = scratch(spark, "labels")
        moved.write.parquet(folder)
        new = spark.read.schema(moved.schema).parquet(folder)
        if last is not None:
            remove(spark, last)
        last, labels = folder, new.select("node", F.col("_new").alias("component"))
        if new.where("_new != _old").isEmpty():
            return labels
