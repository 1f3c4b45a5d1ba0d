"""Neighbour graphs as edge tables: weights, components, traversal order and balanced parts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from cladeflow.operators import distance, ordering
from cladeflow.session import cut_lineage, scratch


def both_directions(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`src, dst` for both directions of every edge; loops are dropped."""
    ends = F.explode(F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")), F.struct(F.col(b).alias("src"), F.col(a).alias("dst"))))
    return edges.where(F.col(a) != F.col(b)).select(ends.alias("_e")).select("_e.*").distinct()


def knn_graph(d: DataFrame, k: int, nodes: DataFrame | None = None) -> DataFrame:
    """The k nearest neighbours of each node in a distance table: `id, neighbour, d, rank`; fewer where there are fewer.

    `nodes` (column `id`) restricts the graph to some nodes.
    """
    ends = F.array(
        F.struct(F.col("a").alias("id"), F.col("b").alias("neighbour")), F.struct(F.col("b").alias("id"), F.col("a").alias("neighbour"))
    )
    edges = d.select("d", F.explode(ends).alias("_e")).select("_e.*", "d")
    if nodes is not None:
        edges = edges.join(nodes.select("id").distinct(), "id", "left_semi")
        edges = edges.join(nodes.select(F.col("id").alias("neighbour")).distinct(), "neighbour", "left_semi")
    return distance.rank_neighbours(edges.select("id", "neighbour", "d"), "id", k)


def fuzzy_graph(knn: DataFrame) -> DataFrame:
    """Symmetric weights of the edges of a k-nearest graph: `src, dst, p`.

    With ρ the least and σ the greatest kept distance of a node, `p_ij = exp((ρ_i − d)/σ_i)`, and the weight of an edge
    is `p_ij + p_ji − p_ij·p_ji`, with the scale of either end.
    """
    scale = knn.groupBy("id").agg(F.min("d").alias("rho"), F.max("d").alias("sigma"))
    rows = knn.select("id", "neighbour", "d").join(scale, "id")
    other = scale.select(F.col("id").alias("neighbour"), F.col("rho").alias("_rho"), F.col("sigma").alias("_sigma"))
    rows = rows.join(other, "neighbour")

    def weight(rho, sigma):
        return F.when(sigma > 0, F.exp((rho - F.col("d")) / sigma)).otherwise(F.lit(1.0))

    p, q = weight(F.col("rho"), F.col("sigma")), weight(F.col("_rho"), F.col("_sigma"))
    return rows.select(F.col("id").alias("src"), F.col("neighbour").alias("dst"), (p + q - p * q).alias("p"))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """`id, component`: the smallest id of the connected component.

    Every round takes the least label among a node and its neighbours, then jumps to the label of that label; labels
    are written out between rounds, and the loop ends when no label has changed.
    """
    links = cut_lineage(edges)
    found = links.select(F.col("src").alias("id")).distinct()
    if nodes is not None:
        found = found.union(nodes.select("id")).distinct()
    labels = cut_lineage(found.withColumn("component", F.col("id")))
    while True:
        offered = links.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("_offer"))
        least = labels.join(offered, "id", "left").select("id", "component", F.least("component", "_offer").alias("_least"))
        roots = least.select(F.col("id").alias("_least"), F.col("_least").alias("_jump"))
        jumped = least.join(roots, "_least", "left")
        new = cut_lineage(jumped.select("id", F.least("_least", "_jump").alias("_new"), "component"))
        labels = new.select("id", F.col("_new").alias("component"))
        if new.where(F.col("_new") != F.col("component")).isEmpty():
            return labels


def bfs_levels(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """`component, id, level`: steps from the smallest node of each component.

    Edges go both ways, so the neighbours of a level lie in it, in the one before or in the next: only the last two
    levels are looked up. Each level is a folder of its own; the loop ends with the first empty one.
    """
    spark, links, folder = edges.sparkSession, cut_lineage(edges), scratch(edges.sparkSession, "levels")
    start = comps.where(F.col("id") == F.col("component")).select("id", "component")

    def level(step: int, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{folder}/level={step}")
        return spark.read.schema(start.schema).parquet(f"{folder}/level={step}")

    before, last, step = start.limit(0), level(0, start), 0
    while not last.isEmpty():
        step += 1
        frontier = last.select(F.col("id").alias("src"), "component")
        reached = links.join(frontier, "src").select(F.col("dst").alias("id"), "component").distinct()
        before, last = last, level(step, reached.join(last.union(before).select("id"), "id", "left_anti").select("id", "component"))
    return spark.read.schema(f"id {start.schema['id'].dataType.simpleString()}, component {start.schema['id'].dataType.simpleString()}, level int").parquet(
        folder
    ).select("component", "id", "level")


def _walk_buckets():
    """The order (component, level, id) from blocks of components down to blocks of ids."""
    block = ordering.BLOCK_BITS
    return [F.shiftright("component", block), F.col("component"), F.col("level"), F.shiftright("id", block)]


def bfs_order(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Breadth-first position of every node over all components, in the order (component, level, id): `…, position`."""
    levels = bfs_levels(edges, components(edges, nodes))
    buckets = _walk_buckets()
    ranked = ordering.global_rank(levels, buckets, [F.col("id")])
    return ranked.withColumn("position", F.col("rank") - 1).drop("rank")


def partition_graph(edges: DataFrame, sizes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Cut the breadth-first order at multiples of the mean size: (`id, part, size`, edges inside one part).

    `sizes` is `id, size`; nodes without size are left out, as are their edges. The last part is closed, so it keeps
    the node that reaches the total.
    """
    weighed = sizes.where("size > 0")
    for end in ("src", "dst"):
        edges = edges.join(weighed.select(F.col("id").alias(end)), end, "left_semi")
    levels = bfs_levels(edges.select("src", "dst"), components(edges.select("src", "dst"), weighed))
    rows = levels.join(weighed, "id")
    buckets = _walk_buckets()
    placed = ordering.prefix(rows, [], buckets, [F.col("id")], sums={"_cum": F.col("size")})
    mean = weighed.agg(F.sum("size") / n).scalar()
    parts = placed.withColumn("part", F.least(F.floor(F.col("_cum") / mean), F.lit(n - 1)).cast("int"))
    parts = cut_lineage(parts.select("id", "part", "size"))
    inside = edges
    for end in ("src", "dst"):
        inside = inside.join(parts.select(F.col("id").alias(end), F.col("part").alias(f"_{end}")), end)
    return parts, inside.where(F.col("_src") == F.col("_dst")).withColumn("part", F.col("_src")).drop("_src", "_dst")


def edge_pairs(edges: DataFrame, windows: DataFrame, n: int, seed: int, replace: bool = False) -> DataFrame:
    """n sampled edges with a window for either end: `pair, side, label, window_id, p`.

    Without replacement each edge is used once before any is used again. Every use of a label takes its next window in
    a random order of the windows of that label, starting over when all were used.
    """
    count = edges.count()
    epochs = 1 if replace else math.ceil(n / max(count, 1))
    edges = edges.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))) if not replace else edges.withColumn("_epoch", F.lit(0))
    digest = ordering.order_digest(seed, "_epoch", "src", "dst")
    drawn = edges.withColumn("_digest", digest)
    ranked = ordering.global_rank(drawn, [F.col("_epoch"), *ordering.hash_buckets(F.col("_digest"))], [F.col("_digest"), F.col("src"), F.col("dst")])
    ranked = ranked.withColumn("_at", F.col("rank") - 1).drop("rank", "_digest", "_epoch")
    if replace:
        draws = edges.sparkSession.range(n).withColumnRenamed("id", "pair")
        leading = F.conv(F.substring(ordering.order_digest(seed, "pair"), 1, 12), 16, 10).cast("bigint")
        picked = draws.withColumn("_at", leading % count).join(ranked, "_at")
    else:
        picked = ranked.where(F.col("_at") < n).withColumnRenamed("_at", "pair")
    picked = cut_lineage(picked.select("pair", "src", "dst", "p"))
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("src").alias("label")), F.struct(F.lit(1).alias("side"), F.col("dst").alias("label")))
    uses = picked.select("pair", "p", F.explode(ends).alias("_e")).select("pair", "p", "_e.*")
    uses = uses.withColumn("_order", F.col("pair") * 2 + F.col("side"))
    uses = ordering.global_rank(uses, ordering.id_buckets("_order"), [F.col("_order")], ["label"])
    shuffled = windows.withColumn("_digest", ordering.order_digest(seed, "label", "window_id"))
    shuffled = ordering.global_rank(shuffled, ordering.hash_buckets(F.col("_digest")), [F.col("_digest"), F.col("window_id")], ["label"])
    shuffled = shuffled.select("label", "window_id", (F.col("rank") - 1).alias("_slot"))
    counts = windows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    used = uses.groupBy("label").agg(F.count(F.lit(1)).alias("_rows"))
    slotted = ordering.salted_join(uses, counts.join(used, "label"), ["label"], spread=["pair"])
    slotted = slotted.withColumn("_slot", (F.col("rank") - 1) % F.col("_n"))
    return slotted.join(shuffled, ["label", "_slot"]).select("pair", "side", "label", "window_id", "p")
