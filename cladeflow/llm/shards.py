"""Contiguous shards of least maximal size over ordered atomic groups, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cladeflow.llm.common import power_buckets, settle, text_of

SHARDS = 8
#: Capacities tried in one pass of the search.
PROBES = 15


def _bucket(digest: str, buckets: int) -> Column:
    """The leading bits of a hexadecimal digest, as a bucket that follows the digest's order."""
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("long") * F.lit(buckets) / F.lit(65536)


def cumulate(groups: DataFrame, key: str, weight: str, per_bucket: int = 50_000) -> DataFrame:
    """Add `_end`, the sum of `weight` up to and with each row in the order of `key`, a hexadecimal digest.

    Digests are evenly spread, so buckets of their leading bits are even as well; the only window without a partition
    runs over bucket totals, of which there are 65,536 at most.
    """
    buckets = power_buckets(groups.count(), per_bucket, 10, 16)
    rows = groups.withColumn("_bucket", F.floor(_bucket(key, buckets)))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_bucket").agg(F.sum(weight).alias("_sum")).select("_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, "_bucket").withColumn("_end", F.col("_before") + F.sum(weight).over(inside)).drop("_bucket", "_before")


def greedy_cuts(ends: DataFrame, capacities: list[int], shards: int) -> list[list[int]]:
    """For each capacity the cut points of the greedy filling: every shard takes groups while they fit.

    One pass over `_end` fills the next shard of all capacities: its cut is the greatest end that the capacity reaches.
    """
    cuts: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards):
        reach = [(c[-1] if c else 0) + capacity for c, capacity in zip(cuts, capacities)]
        row = ends.agg(*[F.max(F.when(F.col("_end") <= r, F.col("_end"))).alias(f"c{i}") for i, r in enumerate(reach)]).first()
        for c, found in zip(cuts, row):
            c.append(max(found or 0, c[-1] if c else 0))
    return cuts


def least_capacity(ends: DataFrame, total: int, heaviest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity at which greedy filling needs at most `shards` shards, and its cut points.

    Search by halving intervals, `PROBES` capacities at a time. A capacity of the mean plus the heaviest group always
    suffices, and none below the mean or the heaviest group does. Cut points grow with the capacity, so after the first
    pass only the ends between the cuts of the greatest failing and the least sufficient capacity can still be cuts; the
    passes that follow read those alone.
    """
    low, high = max(heaviest, -(-total // shards)) - 1, -(-total // shards) + heaviest
    best = greedy_cuts(ends, [low, high], shards)
    low_cuts, high_cuts = best
    near = ends
    while high - low > 1:
        between = reduce(lambda x, y: x | y, [F.col("_end").between(a, b) for a, b in zip(low_cuts, high_cuts)])
        near = settle(near.where(between).select("_end"), "ends")
        step = max(1, (high - low) // (PROBES + 1))
        probes = list(range(low + step, high, step))[:PROBES]
        for capacity, cuts in zip(probes, greedy_cuts(near, probes, shards)):
            if cuts[-1] >= total:
                high, high_cuts = capacity, cuts
                break
            low, low_cuts = capacity, cuts
    return high, high_cuts


def minimax_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, size, text_crc32, law, shard, slot, grown_shard`: shards of nearly equal bytes that keep equal texts together.

    Size is the UTF-8 length plus 1. Equal texts are one atomic group; groups stand in the order of the MD5 digest of
    their text. Contiguous runs of groups become shards such that the largest shard is as small as it can be. Null texts
    count as empty, null ids are kept, rows that repeat stay apart rows of one group. Fewer groups than shards leave the
    last shards empty; an empty table gives no rows. `slot` counts from 0 inside a shard in the order of the id's
    digest. The law is `bytes`, so `grown_shard` is null.
    """
    base = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text_of(text_col)) + 1).cast("long").alias("size"),
            F.crc32(text_of(text_col)).alias("text_crc32"),
            F.md5(text_of(text_col)).alias("_key"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("_slot_key"),
        ),
        "sizes",
    )
    groups = base.groupBy("_key").agg(F.sum("size").alias("_weight"))
    ends = settle(cumulate(groups, "_key", "_weight"), "ends")
    known = ends.agg(F.sum("_weight").alias("total"), F.max("_weight").alias("heaviest"), F.count(F.lit(1)).alias("n")).first()
    shard = F.lit(0)
    if known["n"]:
        _, cuts = least_capacity(ends, known["total"], known["heaviest"], shards)
        last_keys = [r["_key"] for r in ends.where(F.col("_end").isin(sorted(set(cuts[:-1])))).select("_key").collect()]
        for key in last_keys:
            shard = shard + (F.col("_key") > key).cast("int")
    placed = base.withColumn("shard", shard.cast("int"))
    return _slots(placed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0, in buckets of the id's digest."""
    buckets = power_buckets(placed.count(), 400_000, 10, 16)
    rows = placed.withColumn("_bucket", F.floor(_bucket("_slot_key", buckets)))
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "_bucket").count()
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_slot_key", "_key"))
    return rows.join(offsets, ["shard", "_bucket"]).withColumn("slot", F.col("_before") + inside - 1)
