"""Joins that are not plain equality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cladeflow.operators import ordering


def locate(points: DataFrame, at: str, spans: DataFrame, start: str, end: str, bin_size: int) -> DataFrame:
    """Each point with the span `[start, end)` that holds it.

    Both sides are cut into bins and joined on the bin, so no pair outside a common bin is ever built.
    """
    last = F.expr(f"({end} - 1) div {bin_size}")
    first = F.expr(f"{start} div {bin_size}")
    binned = spans.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(first, last)))
    asked = points.withColumn("_bin", F.expr(f"{at} div {bin_size}"))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return asked.join(binned, "_bin").where(inside).drop("_bin")


def asof_last(
    left: DataFrame,
    right: DataFrame,
    on: str,
    values: Mapping[str, Column],
    keys: Sequence[str],
    left_id: str,
) -> DataFrame:
    """For every left row the last value of each kind in `right` at or before it (backward as-of join).

    `values` maps an output name to an expression over the right columns that is NULL where the row does not count.
    Both tables are merged and swept once in time order, by bucket, so a hot key is not held in one task.
    """
    marks = left.select(*keys, on, left_id, F.lit(1).alias("_side"))
    ticks = right.select(*keys, on, F.lit(0).alias("_side"), *[c.alias(n) for n, c in values.items()])
    events = ticks.unionByName(marks, allowMissingColumns=True)
    renamed = {n: f"_v{n}" for n in values}
    for name, column in renamed.items():
        events = events.withColumnRenamed(name, column)
    order = [F.col(on), F.col("_side"), F.col(left_id)]
    buckets = ordering.sketch_buckets(events, keys, order)
    swept = ordering.prefix(events, list(keys), buckets, order, lasts={n: F.col(c) for n, c in renamed.items()})
    return swept.where("_side = 1").select(*keys, on, left_id, *values)


def reconcile(stored: DataFrame, source: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Where two record sets differ: `…keys, status` with `only_stored`, `only_source` or `content`.

    Digests are compared, so residues stay where they were read.
    """
    a = stored.select(*keys, F.sha2(seq, 256).alias("_a"))
    b = source.select(*keys, F.sha2(seq, 256).alias("_b"))
    status = (
        F.when(F.col("_b").isNull(), "only_stored")
        .when(F.col("_a").isNull(), "only_source")
        .when(F.col("_a") != F.col("_b"), "content")
    )
    return a.join(b, list(keys), "full_outer").withColumn("status", status).where("status IS NOT NULL").drop("_a", "_b")
