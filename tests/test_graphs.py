import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.operators import distance, filters, graph, neighbours, ordering, trees


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(4).normal(size=(60, 5))
    x[7] = x[3]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), x


def brute(x, metric):
    diff = x[:, None, :] - x[None, :, :]
    square = (diff**2).sum(axis=2)
    if metric == "sqeuclidean":
        return square
    if metric == "euclidean":
        return np.sqrt(square)
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1)
        return 1 - x @ x.T / np.outer(n, n)
    s = np.sqrt(1 + (x**2).sum(axis=1))
    b = np.outer(s, s) - x @ x.T
    return np.arccosh(np.where(np.abs(b - 1) < 1e-6, 1.0, b))


@pytest.mark.parametrize("metric", distance.METRICS)
@pytest.mark.parametrize("blocks", [1, 3])
def test_blocks_equal_the_full_matrix(vectors, metric, blocks):
    df, x = vectors
    d = brute(x, metric)
    for r in distance.distance_profile(df, "id", "v", metric, blocks).collect():
        others = np.delete(d[r["id"]], r["id"])
        assert r["n"] == 59
        assert [r["mean_d"], r["min_d"], r["max_d"]] == pytest.approx([others.mean(), others.min(), others.max()], abs=1e-7)
    pairs = distance.pairwise(df, "id", "v", metric, blocks).collect()
    assert len({(r["a"], r["b"]) for r in pairs}) == len(pairs) == 60 * 59 // 2
    assert all(r["d"] == pytest.approx(d[r["a"], r["b"]], abs=1e-7) for r in pairs)


def test_nearest_of_another_table(vectors):
    df, x = vectors
    d = brute(x, "euclidean")
    found = neighbours.nearest(df.where("id < 10"), df.where("id >= 10"), "id", "v", 4, blocks=2).collect()
    for i in range(10):
        mine = sorted((r["rank"], r["neighbour"]) for r in found if r["id"] == i)
        assert [n for _, n in mine] == (np.argsort(d[i, 10:], kind="stable")[:4] + 10).tolist()


def test_whitening_gives_mahalanobis(vectors):
    df, x = vectors
    inverse = np.linalg.inv(np.cov(x.T))
    pairs = distance.pairwise(distance.whiten(df, "v"), "id", "v", "euclidean", 2).collect()
    for r in pairs[:200]:
        diff = x[r["a"]] - x[r["b"]]
        assert r["d"] == pytest.approx(np.sqrt(max(diff @ inverse @ diff, 0)), abs=1e-7)


@pytest.mark.parametrize("members,expected", [
    ([("b", "b"), ("c", "c"), ("a", "a")], [[0, 3, 1], [3, 0, 2], [1, 2, 0]]),
    ([("b", "b"), ("c", "c"), ("d", "b"), ("a", "a")], [[0, 3, 0, 1], [3, 0, 3, 2], [0, 3, 0, 1], [1, 2, 1, 0]]),
])
def test_toy_expansion(spark, members, expected):
    d = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 3.0)], "a string, b string, d double")
    names = [m for m, _ in members]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    found = distance.expand_distances(pairs, spark.createDataFrame(members, "accession string, rep string"), d).collect()
    got = {(r["a"], r["b"]): r["d"] for r in found}
    assert [[got[a, b] for b in names] for a in names] == expected


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate((3.0, 1.0, 3.0, 2.0, 3.0))], "id long, x double")
    found = {r["id"]: r["rank"] for r in distance.average_ranks(df, "x", "rank").collect()}
    assert found == {0: 4.0, 1: 1.0, 2: 4.0, 3: 2.0, 4: 4.0}
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, x double")
    assert {r["rank"] for r in distance.average_ranks(flat, "x", "rank").collect()} == {1.5}


def test_hinge_counts_excess_only(spark):
    vecs = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [5.0])], "id long, v array<double>")
    d = spark.createDataFrame([(1, 2, 4.0), (1, 3, 2.0)], "a long, b long, d double")
    row = distance.distance_error(d, vecs, "id", "v", "hinge").first()
    assert row["error"] == pytest.approx((0 + 24.5) / 2)
    with pytest.raises(ValueError):
        distance.distance_error(d, vecs, "id", "v", "other")


EDGES = [("a", "c", 1.0), ("b", "c", 2.0), ("d", "f", 4.0), ("e", "f", 5.0), ("f", "c", 6.0)]


def test_four_leaf_tree(spark):
    edges = spark.createDataFrame(EDGES, "child string, parent string, length double")
    order = "abdecf"
    want = [[0, 3, 11, 12, 1, 7], [3, 0, 12, 13, 2, 8], [11, 12, 0, 9, 10, 4], [12, 13, 9, 0, 11, 5], [1, 2, 10, 11, 0, 6], [7, 8, 4, 5, 6, 0]]
    tree = trees.lift(edges)
    pairs = spark.createDataFrame([(x, y) for x in order for y in order], "a string, b string")
    got = {(r["a"], r["b"]): r["d"] for r in trees.patristic(tree, pairs).collect()}
    assert [[got[x, y] for y in order] for x in order] == want


def test_closure_of_a_deep_chain(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(37)], "child long, parent long, length double")
    closure = trees.ancestor_closure(edges)
    assert closure.count() == 38 * 39 // 2
    assert closure.where("dist <> hops OR ancestor - node <> hops").isEmpty()


def test_shearing_contracts_and_drops_the_old_root(spark):
    # root → x → y → (a, b); root → c
    rows = [("x", "root", 1.0), ("y", "x", 2.0), ("a", "y", 3.0), ("b", "y", 4.0), ("c", "root", 5.0)]
    edges = spark.createDataFrame(rows, "child string, parent string, length double")
    tree = trees.lift(edges)
    whole = spark.createDataFrame([("a",), ("b",), ("c",)], "tip string")
    got = {(r["child"], r["parent"], r["length"]) for r in trees.shear_tree(tree, whole).collect()}
    assert got == {("a", "y", 3.0), ("b", "y", 4.0), ("y", "root", 3.0), ("c", "root", 5.0)}
    part = whole.where("tip <> 'c'")
    got = {(r["child"], r["parent"], r["length"]) for r in trees.shear_tree(tree, part).collect()}
    assert got == {("a", "y", 3.0), ("b", "y", 4.0)}


def test_a_clade_scores_one_and_a_scattered_taxon_more(spark):
    edges = spark.createDataFrame(EDGES, "child string, parent string, length double")
    meta = spark.createDataFrame([("a", "x", "m"), ("b", "x", "n"), ("d", "y", "m"), ("e", "y", "n")], "tip string, good string, bad string")
    stats = {r["rank"]: r["score"] for r in trees.phylo_stats(trees.lift(edges), meta, ["good", "bad"]).collect()}
    # Under the root c, the tips a and b have no clade of their own.
    assert stats == {"good": (4 + 2) / 4, "bad": (4 + 4) / 4}


def test_equal_trees_are_at_distance_zero(spark):
    rows = [("x", "root", 1.0), ("y", "root", 2.0), ("a", "x", 3.0), ("b", "x", 4.0), ("c", "y", 5.0), ("d", "y", 1.0)]
    edges = spark.createDataFrame(rows, "child string, parent string, length double")
    tree = trees.lift(edges)
    tips = spark.createDataFrame([(t,) for t in "abcd"], "tip string")
    pairs = spark.createDataFrame([(a, b) for a in "abcd" for b in "abcd" if a < b], "a string, b string")
    row = trees.compare_trees(tree, tree, tips, pairs).first()
    assert (row["n1"], row["n_shared"], row["subset_distance"]) == (2, 2, 0.0) and row["tip_distance"] == pytest.approx(0)
    swapped = [(c, {"b": "y", "c": "x"}.get(c, p), n) for c, p, n in rows]
    other = trees.lift(spark.createDataFrame(swapped, "child string, parent string, length double"))
    assert trees.compare_trees(tree, other, tips, pairs).first()["subset_distance"] == 1.0


def brute_components(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components_of_a_hub_a_chain_and_loose_nodes(spark):
    rng = random.Random(8)
    edges = [(50, i) for i in range(60, 100)] + [(i, i + 1) for i in range(20)] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(15)]
    df = graph.both_directions(spark.createDataFrame(edges, "a long, b long"))
    nodes = spark.range(150)
    found = {r["id"]: r["component"] for r in graph.components(df, nodes).collect()}
    assert found == dict(enumerate(brute_components(150, edges)))
    levels = {r["id"]: r["level"] for r in graph.bfs_levels(df, graph.components(df, nodes)).collect()}
    assert levels[50] == 0 and levels[60] == 1 and levels[20] == 20 and levels[149] == 0 and len(levels) == 150


def test_a_long_chain_is_one_component(spark):
    df = graph.both_directions(spark.createDataFrame([(i, i + 1) for i in range(299)], "a long, b long"))
    assert {r["component"] for r in graph.components(df).collect()} == {0}


def test_parts_are_balanced_and_cover_all_nodes(spark):
    edges = graph.both_directions(spark.createDataFrame([(i, i + 1) for i in range(99)], "a long, b long"))
    sizes = spark.range(100).withColumn("size", F.lit(10).cast("long"))
    parts, inside = graph.partition_graph(edges, sizes, 4)
    counts = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(counts.values()) == 100 and set(counts) == {0, 1, 2, 3} and max(counts.values()) <= 26
    assert inside.count() == 2 * (99 - 3)


def test_windows_of_a_label_are_used_in_turn(spark):
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.25), (2, 0, 0.75)], "src long, dst long, p double")
    windows = spark.createDataFrame([(label, 10 * label + i) for label in range(3) for i in range(4)], "label long, window_id long")
    rows = graph.edge_pairs(edges, windows, 7, 1).collect()
    assert len(rows) == 14 and {r["pair"] for r in rows} == set(range(7))
    assert all(r["window_id"] // 10 == r["label"] for r in rows)
    first = [r["window_id"] for r in rows if r["pair"] < 6]
    assert len(set(first)) == len(first) == 12  # four uses of each label, four windows
    drawn = graph.edge_pairs(edges, windows, 20, 1, replace=True)
    assert drawn.count() == 40


def test_trimmed_pairs_need_both_ends(spark):
    d = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.7)], "a long, b long, d double")
    taxa = spark.createDataFrame([(1, "GCF_1"), (2, "GCF_2"), (3, "other")], "id long, name string")
    kept, rejected = filters.named_taxa(taxa, "name")
    assert [(r["a"], r["b"]) for r in filters.trim_distances(d, kept, "id").collect()] == [(1, 2)]
    assert [r["name"] for r in rejected.collect()] == ["other"]


def test_knn_is_reduced_when_there_are_few(spark):
    d = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.7)], "a long, b long, d double")
    knn = graph.knn_graph(d, 5)
    assert {(r["id"], r["neighbour"]) for r in knn.collect()} == {(1, 2), (1, 3), (2, 1), (3, 1)}
    p = {(r["src"], r["dst"]): r["p"] for r in graph.fuzzy_graph(knn).collect()}
    assert p[1, 2] == pytest.approx(p[2, 1]) and all(0 < v <= 1 for v in p.values())
    assert graph.knn_graph(d, 5, spark.createDataFrame([(1,), (2,)], "id long")).count() == 2
    assert ordering.BLOCK_BITS == 16


def test_null_and_zero_vectors_fail_nothing(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, 1.0])], "id long, v array<double>")
    found = {r["id"]: (r["n"], r["min_d"], r["max_d"]) for r in distance.distance_profile(rows, "id", "v", "cosine").collect()}
    assert set(found) == {0, 1, 3} and found[1] == (2, 1.0, 1.0) and found[0][0] == 2 and not any(v != v for r in found.values() for v in r)


def test_a_cycle_is_no_tree(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("c", "a", 1.0)], "child string, parent string, length double")
    for build in (trees.ancestor_closure, trees.lift):
        with pytest.raises(ValueError, match="own ancestor"):
            build(edges)


def test_whitening_leaves_null_vectors_null(spark):
    x = np.random.default_rng(5).normal(size=(50, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, None)]
    found = {r["id"]: r["v"] for r in distance.whiten(spark.createDataFrame(rows, "id long, v array<double>"), "v").collect()}
    assert found.pop(50) is None
    w = np.array([found[i] for i in range(50)])
    assert np.allclose(np.cov(w.T), np.eye(3))
