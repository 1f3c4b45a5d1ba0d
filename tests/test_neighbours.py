"""Pruned nearest neighbours against all pairs, and how much of the pairs they look at."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.operators import distance, graph, neighbours


def clustered(n=1500, clusters=30, d=6, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d)) * 10
    x = centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, d)) * 0.3
    x[n // 2 : n // 2 + 200] = x[0]  # copies: ties, and one large group
    x[7] = 0.0
    return x


def frame(spark, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def all_pairs(x, y, ids, others, metric, k):
    d = distance.between_vectors(metric)(x, y)
    d[ids[:, None] == others[None, :]] = np.inf
    out = []
    for i, row in zip(ids, d):
        order = np.lexsort((others, row))[:k]
        out += [(int(i), int(others[j]), round(float(row[j]), 7), rank + 1) for rank, j in enumerate(order) if np.isfinite(row[j])]
    return sorted(out)


@pytest.mark.parametrize("metric", distance.METRICS)
def test_pruned_equals_all_pairs(spark, metric):
    x = clustered(600) / 10
    df, ids = frame(spark, x), np.arange(len(x))
    found = neighbours.nearest(df, df, "id", "v", 6, metric, block_rows=25).collect()
    # Distances equal to rounding may change places between a product of blocks and that of the whole.
    got = {(r["id"], r["rank"]): r["d"] for r in found}
    want = {(i, rank): d for i, _, d, rank in all_pairs(x, x, ids, ids, metric, 6)}
    assert got.keys() == want.keys() and all(abs(got[key] - want[key]) < 1e-6 for key in want)
    if metric == "euclidean":
        assert sorted((r["id"], r["neighbour"], round(r["d"], 7), r["rank"]) for r in found) == all_pairs(x, x, ids, ids, metric, 6)


def test_two_tables_and_k_beyond_their_rows(spark):
    x = clustered(300)
    df, ids = frame(spark, x), np.arange(len(x))
    left, right = df.where("id % 5 = 0"), df.where("id % 5 <> 0")
    a, b = ids % 5 == 0, ids % 5 != 0
    for k in (3, 500):
        found = neighbours.nearest(left, right, "id", "v", k, block_rows=20)
        assert sorted((r["id"], r["neighbour"], round(r["d"], 7), r["rank"]) for r in found.collect()) == all_pairs(x[a], x[b], ids[a], ids[b], "euclidean", k)


def test_most_pairs_of_clustered_vectors_are_not_visited(spark):
    x = clustered()
    df = frame(spark, x)
    search = neighbours.build(df, "id", "v", "euclidean", block_rows=20)
    first = neighbours.first_visits(df, search, 5).withColumn("kth", F.lit(float("inf")))
    kth = neighbours.rank_neighbours(neighbours._visit(first, search, 5, "long"), "id", 5).groupBy("id").agg(F.max("d").alias("kth"))
    later = neighbours.later_visits(first.drop("kth").join(kth, "id").select("id", "v", "kth", "visits"), search)
    size = {b: n for b, n in enumerate(search.counts)}
    visited = sum(size[b] for rows in (first, later) for r in rows.select("visits").collect() for b in r["visits"])
    assert len(search.counts) >= 70 and visited < len(x) ** 2 / 3


def test_groups_beyond_a_block_are_split(spark):
    x = np.concatenate([np.zeros((300, 3)), np.random.default_rng(1).normal(size=(60, 3))])
    df, ids = frame(spark, x), np.arange(len(x))
    found = neighbours.nearest(df, df, "id", "v", 4, block_rows=30, blocks=4)
    assert sorted((r["id"], r["neighbour"], round(r["d"], 7), r["rank"]) for r in found.collect()) == all_pairs(x, x, ids, ids, "euclidean", 4)


def test_odd_tables(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    some = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [0.0, 1.0])], "id long, v array<double>")
    assert neighbours.nearest(some, none, "id", "v", 3).count() == 0 and neighbours.nearest(none, some, "id", "v", 3).count() == 0
    rows = neighbours.nearest(some, some, "id", "v", 3, "cosine").collect()
    assert sorted((r["id"], r["neighbour"], r["rank"]) for r in rows) == [(1, 3, 1), (3, 1, 1)]


def test_a_neighbour_graph_of_vectors_gets_fuzzy_weights(spark):
    x = clustered(200)
    edges = graph.fuzzy_graph(neighbours.nearest(frame(spark, x), frame(spark, x), "id", "v", 3, block_rows=20))
    assert edges.count() == 600 and edges.where("p is null or p < 0 or p > 1").count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_profiles_visit_each_pair_of_blocks_once(spark, metric):
    x = clustered(90)[20:]
    df = frame(spark, x)
    d = distance.between_vectors(metric)(x, x)
    got = {r["id"]: r for r in distance.distance_profile(df, "id", "v", metric, 4).collect()}
    for i in range(len(x)):
        others = np.delete(d[i], i)
        assert [got[i]["n"], got[i]["mean_d"], got[i]["min_d"], got[i]["max_d"]] == pytest.approx([len(x) - 1, others.mean(), others.min(), others.max()], abs=1e-7)
        assert d[i, got[i]["nearest"]] == pytest.approx(others.min(), abs=1e-7)
    first, _ = distance._block_pairs(df, "id", "v", 4)
    assert first.count().where("bi > bj").count() == 0


def test_distances_of_blocks_are_never_held_whole():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    names = ["id", "n", "total", "min_d", "nearest", "max_d"]
    x, y = rng.normal(size=(700, 4)), rng.normal(size=(500, 4))
    x[300] = y[400]
    y[1] = np.nan

    def side(ids, v):
        return pa.table({"id": pa.array(ids), "v": pa.array(v.tolist())})

    between = distance.between_vectors("euclidean")
    held = []
    task = distance._block_function("euclidean", "profile", names)
    cell = next(c for n, c in zip(task.__code__.co_freevars, task.__closure__) if n == "between")
    cell.cell_contents = lambda a, b: held.append(len(a) * len(b)) or between(a, b)
    got = task((pa.scalar(0), pa.scalar(1)), side(range(700), x), side(range(1000, 1500), y)).to_pandas().set_index("id")
    assert len(got) == 1200 and max(held) <= distance.STRIP_ROWS * 500
    d = between(x, y)
    assert got.loc[300, "min_d"] != got.loc[300, "min_d"]  # NaN is the least
    others = got.loc[[1000 + j for j in range(500) if j != 1]]
    whole = np.delete(d, 1, axis=1)
    assert np.allclose(others["total"], whole.sum(axis=0)) and (others["n"] == 700).all()
    assert (others["min_d"] == whole.min(axis=0)).all() and (others["nearest"] == whole.argmin(axis=0)).all() and (others["max_d"] == whole.max(axis=0)).all()


def test_profiles_of_several_metrics_meet_once(spark):
    x = clustered(120)
    x[7] = x[3] + 1e-9  # a difference that is lost in a matrix product
    df = frame(spark, x + 40.0)
    rows = distance.distance_profile(df, "id", "v", distance.METRICS, 3)
    assert rows._jdf.queryExecution().executedPlan().toString().count("FlatMapCoGroupsInArrow") == 1
    got = {(r["metric"], r["id"]): r for r in rows.collect()}
    assert len(got) == len(distance.METRICS) * len(x)
    for metric in distance.METRICS:
        d = distance.between_vectors(metric)(x + 40.0, x + 40.0)
        for i in range(len(x)):
            others = np.delete(d[i], i)
            r = got[metric, i]
            assert [r["n"], r["mean_d"], r["max_d"]] == pytest.approx([len(x) - 1, others.mean(), others.max()], rel=1e-9, abs=1e-9)
            if metric in ("euclidean", "sqeuclidean"):
                assert r["min_d"] == others.min() and d[i, r["nearest"]] == others.min()


def test_blocks_are_visited_in_rounds(spark, monkeypatch):
    assert neighbours.rounds({}, 10) == [] and neighbours.rounds({3: 4, 1: 5, 7: 2, 9: 30, 10: 1}, 10) == [(1, 3), (7, 7), (9, 9), (10, 10)]
    x = np.random.default_rng(2).normal(size=(200, 12))  # nothing can be left out
    df, ids = frame(spark, x), np.arange(200)
    visit, seen = neighbours._visit, []

    def counted(left, *rest):
        seen.append(left.selectExpr("sum(size(visits)) AS n").first()["n"])
        return visit(left, *rest)

    monkeypatch.setattr(neighbours, "_visit", counted)
    monkeypatch.setattr(neighbours, "ROUND_ROWS", 1)
    found = neighbours.nearest(df, df, "id", "v", 4, block_rows=20)
    assert sorted((r["id"], r["neighbour"], round(r["d"], 7), r["rank"]) for r in found.collect()) == all_pairs(x, x, ids, ids, "euclidean", 4)
    assert len(seen) > 3 and max(seen) <= 2 * 200
