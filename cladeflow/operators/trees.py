"""Trees as edge tables `child, parent, length`.

Questions about pairs, groups and subtrees are answered with jumps of 2^k steps (`lift`), in rounds that grow with the
logarithm of the depth. `ancestor_closure` is for those who want every pair of a node and an ancestor as the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cladeflow.operators import distance, ordering
from cladeflow.session import cut_lineage, settle


def ancestor_closure(edges: DataFrame, include_self: bool = True) -> DataFrame:
    """`node, ancestor, hops, dist` for every node and ancestor, by doubling the path length in each round.

    A tree of depth h takes log2(h) rounds, each one join of the longest paths with all paths known so far.
    """
    known = edges.select(
        F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("hops"), F.col("length").cast("double").alias("dist")
    )
    known, reach = cut_lineage(known), 1
    while True:
        upper = known.select(
            F.col("node").alias("ancestor"), F.col("ancestor").alias("_up"), F.col("hops").alias("_h"), F.col("dist").alias("_d")
        )
        longest = known.where(F.col("hops") == reach)
        if longest.isEmpty():
            break
        longer = longest.join(upper, "ancestor").select(
            "node", F.col("_up").alias("ancestor"), (F.col("hops") + F.col("_h")).alias("hops"), (F.col("dist") + F.col("_d")).alias("dist")
        )
        known, reach = cut_lineage(known.unionByName(longer)), reach * 2
        if not known.where(F.col("node") == F.col("ancestor")).isEmpty():
            raise ValueError("the edges do not form a tree: a node is its own ancestor")
    if not include_self:
        return known
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    own = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("hops"), F.lit(0.0).alias("dist"))
    return known.unionByName(own)


@dataclass
class Lifted:
    """A forest with jumps: `nodes` is `node, depth, dist, root`; `jumps[k]` is `node, up, dist`, the ancestor 2^k steps up.

    Rows are the nodes times the logarithm of the greatest depth, whatever the shape of the trees.
    """

    edges: DataFrame
    nodes: DataFrame
    jumps: list[DataFrame]


def lift(edges: DataFrame) -> Lifted:
    """Jumps of every node by doubling: each round joins the nodes that have not reached a root with the rows they point to."""
    given = edges.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.col("length").cast("double").alias("dist"))
    roots = given.select(F.col("up").alias("node")).distinct().join(given.select("node"), "node", "left_anti")
    roots = settle(roots, "roots")
    flagged = given.join(roots.select(F.col("node").alias("up"), F.lit(True).alias("_top")), "up", "left")
    rows = flagged.select("node", "up", "dist", F.lit(1).cast("long").alias("hops"), F.coalesce("_top", F.lit(False)).alias("top"))
    own = roots.select("node", F.col("node").alias("up"), F.lit(0.0).alias("dist"), F.lit(0).cast("long").alias("hops"), F.lit(True).alias("top"))
    state, reach, jumps, limit = settle(rows.unionByName(own), "jumps"), 1, [], None
    while True:
        level, going = state.where(F.col("hops") == reach).select("node", "up", "dist"), state.where(~F.col("top"))
        ends = going.isEmpty()
        if not ends or not level.isEmpty():
            jumps.append(level)
        if ends:
            break
        limit = limit or state.count()
        if reach > limit:
            raise ValueError("the edges do not form a tree: a node is its own ancestor")
        ahead = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("dist").alias("_d"), F.col("hops").alias("_h"), F.col("top").alias("_t"))
        further = going.join(ahead, "up").select(
            "node", F.col("_up").alias("up"), (F.col("dist") + F.col("_d")).alias("dist"), (F.col("hops") + F.col("_h")).alias("hops"), F.col("_t").alias("top")
        )
        state, reach = settle(state.where("top").unionByName(further), "jumps"), reach * 2
    return Lifted(edges, state.select("node", F.col("hops").alias("depth"), "dist", F.col("up").alias("root")), jumps)


#: Joins in a row before rows are written, so that plans of deep trees stay short.
STEPS_A_PLAN = 4


class _Climb:
    """Rows whose node columns move up; each move is one join on the node, and rows that stay keep keys of their own."""

    def __init__(self, rows: DataFrame):
        self.rows, self.steps = rows, 0

    def jump(self, tree: Lifted, k: int, columns: Sequence[str], moves: Column, keep_old: bool = False) -> None:
        """Move `columns` 2^k steps up where `moves`; `keep_old` puts the new nodes into `_<column>`."""
        if k >= len(tree.jumps):
            return
        self.rows = self.rows.withColumn("_moves", F.coalesce(moves, F.lit(False)))
        for c in columns:
            up = tree.jumps[k].select(F.col("node").alias(c), F.lit(True).alias("_moves"), F.col("up").alias("_up"))
            met = self.rows.join(up, [c, "_moves"], "left")
            self.rows = met.withColumn(*((f"_{c}", F.col("_up")) if keep_old else (c, F.coalesce("_up", c)))).drop("_up")
        self.rows = self.rows.drop("_moves")
        self.steps += len(columns)
        if self.steps >= STEPS_A_PLAN:
            self.rows, self.steps = settle(self.rows, "climb"), 0


def lowest_common(tree: Lifted, pairs: DataFrame) -> DataFrame:
    """`a, b, lca, d`: the lowest common ancestor of each pair, and the path length between its ends.

    The deeper end is lifted to the depth of the other; then both are lifted together by falling powers of two as long as
    they stay apart. Pairs in different trees, or with an end that is in no tree, give no row.
    """
    ends = pairs.select("a", "b").distinct()
    for end in ("a", "b"):
        ends = ends.join(tree.nodes.select(F.col("node").alias(end), F.col("depth").alias(f"_d{end}"), F.col("root").alias(f"_r{end}")), end)
    ends = ends.where("_ra = _rb")
    swap = F.col("_da") < F.col("_db")
    rows = ends.select(
        "a", "b", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("low"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("high"),
        F.abs(F.col("_da") - F.col("_db")).alias("_above"), F.least("_da", "_db").alias("_depth"),
    )
    climb = _Climb(rows)
    for k in range(len(tree.jumps)):
        climb.jump(tree, k, ["low"], F.col("_above").bitwiseAND(F.lit(1 << k).cast("long")) != 0)
    for k in reversed(range(len(tree.jumps))):
        climb.jump(tree, k, ["low", "high"], (F.col("low") != F.col("high")) & (F.col("_depth") >= 1 << k), keep_old=True)
        apart = F.col("_low") != F.col("_high")
        climb.rows = climb.rows.withColumns({
            **{c: F.when(apart, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("low", "high")},
            "_depth": F.when(apart, F.col("_depth") - (1 << k)).otherwise(F.col("_depth")),
        }).drop("_low", "_high")
    climb.jump(tree, 0, ["low"], F.col("low") != F.col("high"))
    # From distances to the root: exact to the rounding of these, and never below zero.
    below = tree.nodes.select(F.col("node").alias("_n"), F.col("dist").alias("_t"))
    rows = climb.rows.select("a", "b", F.col("low").alias("lca"))
    for end in ("a", "b", "lca"):
        rows = rows.join(below.select(F.col("_n").alias(end), F.col("_t").alias(f"_t{end}")), end)
    return rows.select("a", "b", "lca", F.greatest(F.col("_ta") + F.col("_tb") - 2 * F.col("_tlca"), F.lit(0.0)).alias("d"))


def patristic(tree: Lifted, pairs: DataFrame) -> DataFrame:
    """Path length between the ends of given pairs `a, b`: `a, b, d`. Any nodes, tips or internal."""
    return lowest_common(tree, pairs).select("a", "b", "d")


def subtree_sums(tree: Lifted, weights: DataFrame, names: Sequence[str]) -> DataFrame:
    """`node` and the sums of the columns `names` of `weights` (one row per `node`) over all that is below a node, itself included.

    What is less than 2^k steps below a node is known after k rounds; the next round adds what is known of the nodes 2^k
    steps below. Nodes whose sums hold no row of `weights` are left out.
    """
    known = settle(weights.join(tree.nodes.select("node"), "node", "left_semi").select("node", *names), "sums")
    for jumps in tree.jumps:
        lifted = known.join(jumps.select("node", "up"), "node").groupBy(F.col("up").alias("node")).agg(*[F.sum(n).alias(n) for n in names])
        both = known.unionByName(lifted.select(*[F.col(n).cast(known.schema[n].dataType).alias(n) for n in known.columns]))
        known = settle(both.groupBy("node").agg(*[F.sum(n).cast(known.schema[n].dataType).alias(n) for n in names]), "sums")
    return known


def tip_counts(tree: Lifted, tips: DataFrame) -> DataFrame:
    """`ancestor, n_tips`; a tip counts itself."""
    ones = tips.select(F.col("tip").alias("node")).distinct().withColumn("n_tips", F.lit(1).cast("long"))
    return subtree_sums(tree, ones, ["n_tips"]).withColumnRenamed("node", "ancestor")


def common_ancestors(tree: Lifted, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys, ancestor`: the lowest common ancestor of the `node` rows of each group.

    Members are lifted to the depth of the highest one and from there together, as long as some of them stay apart; members
    that have met go on as one. Groups with a member outside the tree, or in several trees, and NULL keys give no row.
    """
    rows = members.select(*keys, "node").distinct().join(tree.nodes.select("node", "depth", "root"), "node", "left")
    facts = rows.groupBy(*keys).agg(
        F.min("depth").alias("_depth"), F.count(F.lit(1)).alias("_rows"), (F.count_if(F.col("depth").isNull()) == 0).alias("_in"),
        (F.min("root") == F.max("root")).alias("_one"),
    )
    facts = facts.where("_in and _one").drop("_in", "_one")
    rows = ordering.salted_join(rows.drop("root"), facts, keys, ["node"])
    climb = _Climb(rows.withColumn("_above", F.col("depth") - F.col("_depth")).drop("depth"))
    for k in range(len(tree.jumps)):
        climb.jump(tree, k, ["node"], F.col("_above").bitwiseAND(F.lit(1 << k).cast("long")) != 0)
    rows = settle(climb.rows.select(*keys, "node", "_depth").distinct(), "members")
    for k in reversed(range(len(tree.jumps))):
        up = tree.jumps[k].select("node", F.col("up").alias("_up"))
        ahead = settle(rows.where(F.col("_depth") >= 1 << k).join(up, "node"), "ahead")
        apart = ahead.groupBy(*keys).agg((F.min("_up") != F.max("_up")).alias("_apart"), F.count(F.lit(1)).alias("_rows")).where("_apart")
        moved = ordering.salted_join(ahead, apart, keys, ["node"]).select(*keys, F.col("_up").alias("node"), (F.col("_depth") - (1 << k)).alias("_depth"))
        hot = [F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in keys]
        stay = rows.join(apart.select(*[F.col(c).alias(f"_k{c}") for c in keys]), hot, "left_anti")
        rows = settle(stay.unionByName(moved.distinct()), "members")
    last = rows.groupBy(*keys).agg(F.min("node").alias("node"), (F.min("node") != F.max("node")).alias("_apart"))
    climb = _Climb(last)
    climb.jump(tree, 0, ["node"], F.col("_apart"))
    return climb.rows.select(*keys, F.col("node").alias("ancestor"))


def phylo_stats(tree: Lifted, meta: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """Per rank, the tips under the lowest common ancestor of each taxon, summed and divided by all tips: 1.0 when all are clades.

    `meta` is `tip` and the rank columns.
    """
    pairs = F.array(*[F.struct(F.lit(r).alias("rank"), F.col(r).cast("string").alias("taxon")) for r in ranks])
    members = meta.select(F.col("tip").alias("node"), F.explode(pairs).alias("_p")).select("node", "_p.*").where("taxon is not null")
    common = common_ancestors(tree, members, ["rank", "taxon"])
    spans = common.join(tip_counts(tree, meta), "ancestor")
    total = meta.agg(F.count(F.lit(1))).scalar()
    return spans.groupBy("rank").agg((F.sum("n_tips") / total).alias("score"))


def clade_prints(tree: Lifted, tips: DataFrame, root: str) -> DataFrame:
    """Clades of the inner nodes but the root, as distinct fingerprints of their tip sets of more than one tip.

    A fingerprint is the size and two order-free sums over independent 60-bit digests: no tip set is ever gathered.
    """
    digest = F.md5(F.col("node").cast("string"))
    halves = [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]
    names = ["n", "h1", "h2"]
    weights = tips.select(F.col("tip").alias("node")).distinct().select("node", *[x.alias(n) for x, n in zip((F.lit(1).cast("long"), *halves), names)])
    prints = subtree_sums(tree, weights, names).where(F.col("node") != root)
    return prints.where("n > 1").select(*names).distinct()


def compare_trees(first: Lifted, second: Lifted, tips: DataFrame, pairs: DataFrame, root: str = "root") -> DataFrame:
    """`n1, n2, n_shared, subset_distance, tip_distance` of two trees over the same tips.

    The first distance is one minus the share of common clades (Dice); the second is (1 − r)/2 for the correlation r of
    the tip distances over the given pairs.
    """
    a, b = clade_prints(first, tips, root), clade_prints(second, tips, root)
    shared = a.join(b, ["n", "h1", "h2"], "left_semi")

    def size(df):
        return df.agg(F.count(F.lit(1))).scalar()

    correlation = distance.distance_correlation(patristic(first, pairs), patristic(second, pairs))
    counted = correlation.select(
        size(a).alias("n1"), size(b).alias("n2"), size(shared).alias("n_shared"), ((1 - F.col("pearson")) / 2).alias("tip_distance")
    )
    return counted.withColumn("subset_distance", F.coalesce(1 - F.try_divide(2 * F.col("n_shared"), F.col("n1") + F.col("n2")), F.lit(1.0)))


def shear_tree(tree: Lifted, tips: DataFrame) -> DataFrame:
    """The tree over given tips: other tips go, inner nodes left with one branch are contracted and lengths added up.

    Nodes above a tip that are neither tip nor fork pass on the pointer of their parent, twice as far in each round.
    """
    wanted = tips.select(F.col("tip").alias("node")).distinct().join(tree.nodes.select("node"), "node", "left_semi")
    kept = subtree_sums(tree, wanted.withColumn("n", F.lit(1).cast("long")), ["n"]).select("node")
    edges = tree.edges.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.col("length").cast("double").alias("dist"))
    edges = settle(edges.join(kept, "node", "left_semi"), "kept")
    forks = edges.groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("node")
    retained = settle(wanted.union(forks).distinct().withColumn("_stop", F.lit(True)), "retained")
    stops = retained.withColumnRenamed("node", "up")
    state = settle(edges.join(stops, "up", "left").select("node", "up", "dist", F.coalesce("_stop", F.lit(False)).alias("stop")), "pointers")
    while True:
        going = state.where("not stop")
        ahead = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("dist").alias("_d"), F.col("stop").alias("_s"))
        further = going.join(ahead, "up").select("node", F.col("_up").alias("up"), (F.col("dist") + F.col("_d")).alias("dist"), F.col("_s").alias("stop"))
        # A pointer to a root that is no fork ends there and takes nothing over.
        further = settle(further, "pointers")
        state = settle(state.where("stop").unionByName(further), "pointers")
        if further.where("not stop").isEmpty():
            break
    rows = state.where("stop").join(retained.select("node"), "node", "left_semi")
    return rows.select(F.col("node").alias("child"), F.col("up").alias("parent"), F.col("dist").alias("length"))


def tree_nodes(edges: DataFrame, genomes: DataFrame, name: str, index: str) -> DataFrame:
    """Node table with the genome of each leaf, −1 where there is none: `node, parent, length, genome`."""
    leaves = genomes.select(F.col(name).alias("node"), F.col(index).alias("_g"))
    nodes = edges.select(F.col("child").alias("node"), "parent", "length")
    roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    rows = nodes.unionByName(roots, allowMissingColumns=True).join(leaves, "node", "left")
    return rows.select("node", "parent", "length", F.coalesce("_g", F.lit(-1)).cast("bigint").alias("genome"))
