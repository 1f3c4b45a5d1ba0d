"""Jumps over trees against walks in plain Python, on bushes, chains, ladders and forests."""

import random

import pytest
from pyspark.sql import functions as F

from cladeflow.operators import trees


def forest(kind, n=120, seed=1):
    """Parents by node, `n` nodes: nodes 0 (and, in a forest, 1) are roots."""
    rng = random.Random(seed)
    if kind == "chain":
        return {i: i - 1 for i in range(1, n)}
    if kind == "ladder":  # a spine with one tip on every rung
        return {**{i: i - 2 for i in range(2, n, 2)}, **{i: i - 1 for i in range(1, n, 2)}}
    if kind == "star":
        return {i: 0 for i in range(1, n)}
    roots = 2 if kind == "forest" else 1
    return {i: rng.randrange(i if rng.random() < 0.5 else max(1, i // 4)) for i in range(roots, n)}


def frame(spark, parent):
    rows = [(c, p, 1.0 + c % 5) for c, p in parent.items()]
    return spark.createDataFrame(rows, "child long, parent long, length double")


def path(parent, x):
    out = [x]
    while out[-1] in parent:
        out.append(parent[out[-1]])
    return out


def nodes_of(parent):
    return sorted(set(parent) | set(parent.values()))


KINDS = ["bush", "chain", "ladder", "star", "forest"]


@pytest.mark.parametrize("kind", KINDS)
def test_depths_common_ancestors_and_distances(spark, kind):
    parent = forest(kind)
    tree = trees.lift(frame(spark, parent))
    nodes = nodes_of(parent)
    paths = {x: path(parent, x) for x in nodes}
    length = {x: sum(1.0 + y % 5 for y in p[:-1]) for x, p in paths.items()}
    found = {r["node"]: (r["depth"], r["dist"], r["root"]) for r in tree.nodes.collect()}
    assert found == {x: (len(p) - 1, length[x], p[-1]) for x, p in paths.items()}
    rng = random.Random(5)
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(300)] + [(0, 0), (0, nodes[-1]), (9999, 0)]
    got = {(r["a"], r["b"]): (r["lca"], r["d"]) for r in trees.lowest_common(tree, spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {}
    for a, b in pairs:
        common = [x for x in paths.get(a, []) if x in paths.get(b, [])]
        if common:
            want[a, b] = (common[0], length[a] + length[b] - 2 * length[common[0]])
    assert got == want


@pytest.mark.parametrize("kind", KINDS)
def test_sums_and_ancestors_of_groups(spark, kind):
    parent = forest(kind, seed=2)
    tree = trees.lift(frame(spark, parent))
    nodes = nodes_of(parent)
    paths = {x: path(parent, x) for x in nodes}
    tips = [x for x in nodes if x not in set(parent.values())]
    got = {r["ancestor"]: r["n_tips"] for r in trees.tip_counts(tree, spark.createDataFrame([(t,) for t in [*tips, 5555]], "tip long")).collect()}
    want = {}
    for t in tips:
        for x in paths[t]:
            want[x] = want.get(x, 0) + 1
    assert got == want
    rng = random.Random(6)
    groups = {g: [rng.choice(nodes) for _ in range(rng.choice([1, 2, 3, 40]))] for g in range(12)}
    groups[12] = [0, 7777]
    rows = spark.createDataFrame([(str(g), x) for g, xs in groups.items() for x in xs], "g string, node long")
    got = {int(r["g"]): r["ancestor"] for r in trees.common_ancestors(tree, rows, ["g"]).collect()}
    want = {}
    for g, xs in groups.items():
        common = [x for x in paths[xs[0]] if all(x in paths.get(y, []) for y in xs)]
        if common:
            want[g] = common[0]
    assert got == want


@pytest.mark.parametrize("kind", KINDS)
def test_shearing_equals_walks(spark, kind):
    parent = forest(kind, seed=3)
    tree = trees.lift(frame(spark, parent))
    nodes = nodes_of(parent)
    tips = [x for x in nodes if x not in set(parent.values())][::3]
    kept = {x for t in tips for x in path(parent, t)}
    branches = {}
    for x in kept:
        if x in parent:
            branches[parent[x]] = branches.get(parent[x], 0) + 1
    retained = set(tips) | {x for x, n in branches.items() if n > 1}
    want = set()
    for x in retained:
        length, at = 0.0, x
        while at in parent:
            length, at = length + 1.0 + at % 5, parent[at]
            if at in retained:
                want.add((x, at, length))
                break
    got = {(r["child"], r["parent"], r["length"]) for r in trees.shear_tree(tree, spark.createDataFrame([(t,) for t in tips], "tip long")).collect()}
    assert got == want


def test_a_ladder_of_100_000_nodes(spark):
    n = 100_000
    spine = spark.range(2, n, 2).select(F.col("id").alias("child"), (F.col("id") - 2).alias("parent"))
    rungs = spark.range(1, n, 2).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    tree = trees.lift(spine.union(rungs).withColumn("length", F.lit(1.0)))
    assert len(tree.jumps) == 16 and sum(j.count() for j in tree.jumps) < 17 * n
    rng = random.Random(7)
    pairs = [tuple(rng.sample(range(n), 2)) for _ in range(500)]
    got = {(r["a"], r["b"]): (r["lca"], r["d"]) for r in trees.lowest_common(tree, spark.createDataFrame(pairs, "a long, b long")).collect()}
    for a, b in pairs:
        spine_a, spine_b = a - a % 2, b - b % 2
        # Two ends on different rungs meet at the higher of their places on the spine.
        low = min(spine_a, spine_b)
        assert got[a, b] == (low, (spine_a + spine_b - 2 * low) / 2 + a % 2 + b % 2)
    assert trees.tip_counts(tree, spark.createDataFrame([(n - 1,)], "tip long")).count() == n // 2 + 1
