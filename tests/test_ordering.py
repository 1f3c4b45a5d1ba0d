import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cladeflow.operators import aggregate, joins, ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows and more share one key."""
    rng = random.Random(7)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}", rng.randrange(5), rng.randrange(100)) for i in range(3000)]
    pdf = pd.DataFrame(rows, columns=["id", "key", "kind", "v"])
    return spark.createDataFrame(pdf).repartition(5).cache(), pdf


@pytest.mark.parametrize("bits", [2, 5, 16])
def test_prefix_equals_a_sorted_sweep(skewed, bits):
    df, pdf = skewed
    out = ordering.prefix(
        df, ["key"], ordering.id_buckets("id", bits), [F.col("id")], sums={"s": F.col("v")}, lasts={"l": F.when(F.col("v") > 90, F.col("v"))}
    ).toPandas().sort_values("id")
    want = pdf.groupby("key")["v"].cumsum()
    assert (out["s"].to_numpy() == want.to_numpy()).all()
    last = pdf["v"].where(pdf["v"] > 90).groupby(pdf["key"]).ffill()
    assert np.array_equal(out["l"].to_numpy(dtype=float), last.to_numpy(dtype=float), equal_nan=True)


def test_global_offsets(skewed):
    df, pdf = skewed
    out = ordering.cum_offsets(df, "v", ordering.id_buckets("id", 4), [F.col("id")]).toPandas().sort_values("id")
    assert (out["end_offset"].to_numpy() == pdf["v"].cumsum().to_numpy()).all()
    assert (out["start_offset"].to_numpy() == (pdf["v"].cumsum() - pdf["v"]).to_numpy()).all()


def test_runs_and_moving_means(skewed):
    df, pdf = skewed
    order, buckets = [F.col("id")], ordering.id_buckets("id", 3)
    runs = ordering.islands(df, "kind", order, buckets, ["key"]).toPandas().sort_values("id")
    change = (pdf["kind"] != pdf.groupby("key")["kind"].shift()).groupby(pdf["key"]).cumsum()
    assert (runs["run"].to_numpy() == change.to_numpy()).all()
    means = ordering.moving_mean(df, "v", 4, order, buckets, ["key"]).toPandas().sort_values("id")
    want = pdf.groupby("key")["v"].rolling(4, min_periods=1).mean().reset_index(level=0, drop=True).sort_index()
    assert np.allclose(means["moving_mean"].to_numpy(), want.to_numpy())


def test_moving_mean_across_position_blocks(skewed, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK_BITS", 3)
    df, pdf = skewed
    means = ordering.moving_mean(df, "v", 6, [F.col("id")], ordering.id_buckets("id", 3), ["key"]).toPandas().sort_values("id")
    want = pdf.groupby("key")["v"].rolling(6, min_periods=1).mean().reset_index(level=0, drop=True).sort_index()
    assert np.allclose(means["moving_mean"].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("n", [1, 7, 2999, 4000])
def test_even_split_matches_array_split(skewed, n):
    df, pdf = skewed
    out = ordering.even_split(df, n, ordering.id_buckets("id", 5), [F.col("id")]).toPandas().sort_values("id")
    want = np.concatenate([[i] * len(part) for i, part in enumerate(np.array_split(pdf["id"], n))])
    assert (out["part"].to_numpy() == want).all()


def test_salted_join_with_and_without_hot_keys(skewed):
    df, pdf = skewed
    sizes = df.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"), F.max("v").alias("top"))
    want = pdf.merge(pdf.groupby("key")["v"].max().rename("top"), on="key")
    for hot_rows in (100, 10**9):
        out = ordering.salted_join(df, sizes, ["key"], ["id"], hot_rows=hot_rows).toPandas()
        assert sorted(zip(out["id"], out["top"])) == sorted(zip(want["id"], want["top"]))
    cold, hot = ordering.split_hot(df, ["key"], sizes, hot_rows=1000)
    assert {r["key"] for r in hot.select("key").distinct().collect()} == {"hot"}
    assert cold.count() + hot.count() == len(pdf)


def test_epoch_order_visits_every_row_once(skewed):
    df, pdf = skewed
    for shuffle in (True, False):
        out = ordering.epoch_order(df.select("id"), "id", 4, 1, shuffle=shuffle).toPandas()
        assert sorted(out["position"]) == list(range(len(pdf)))
        assert (out["part"] == out["id"] % 4).all()
        by_part = out.groupby("part")["position"]
        assert ((by_part.max() - by_part.min() + 1) == by_part.count()).all()
    capped = ordering.epoch_order(df.select("id"), "id", 4, 1, max_samples=10)
    assert capped.count() == 10


def test_buckets_are_balanced(skewed):
    df, _ = skewed
    for mode, bound in (("serpentine", 1.02), ("local", 1.05)):
        loads = ordering.balance_report(ordering.balanced_buckets(df, "id", "v", 6, mode), "v", 6).collect()
        assert len(loads) == 6 and loads[0]["max_over_mean"] < bound
        assert sum(r["n_items"] for r in loads) == 3000


def test_exact_quantile_inside_a_bracket(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"key": ["hot"] * 4001 + ["b"] * 4, "p": np.concatenate([rng.random(4001), [4.0, 1.0, 3.0, 2.0]])})
    pdf.loc[100:900, "p"] = 0.5  # many equal values
    df = spark.createDataFrame(pdf)
    for accuracy in (200, 10000):
        found = {r["key"]: r["median"] for r in aggregate.exact_quantile(df, ["key"], "p", accuracy=accuracy).collect()}
        assert found == pytest.approx(pdf.groupby("key")["p"].median().to_dict())
    quarter = {r["key"]: r["quantile"] for r in aggregate.exact_quantile(df, ["key"], "p", 0.25, accuracy=200).collect()}
    assert quarter == pytest.approx(pdf.groupby("key")["p"].quantile(0.25).to_dict())


def test_locate_points_in_spans(spark):
    spans = spark.createDataFrame([(0, 0, 10), (1, 10, 10), (2, 10, 5000), (3, 5000, 5001)], "row int, s long, e long")
    points = spark.createDataFrame([(i, p) for i, p in enumerate((0, 9, 10, 4095, 4096, 4999, 5000))], "id int, at long")
    found = joins.locate(points, "at", spans, "s", "e", 64).collect()
    assert {r["id"]: r["row"] for r in found} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 2, 6: 3}


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "b", 1)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 7, None), ("a", 11, 3.0), ("b", 2, 4.0)], "k string, t long, v double")
    found = joins.asof_last(left, right, "t", {"last": F.col("v")}, ["k"], "id")
    assert {r["id"]: r["last"] for r in found.collect()} == {1: 1.0, 2: 1.0, 3: None}


def test_sampling_is_repeatable(skewed):
    df, _ = skewed
    a, b = ({r["id"] for r in ordering.sample_rows(df.repartition(n), "id", 50, 9).collect()} for n in (2, 7))
    assert a == b and len(a) == 50
    share = ordering.sample_fraction(df, "id", 0.3, 9).count()
    assert 0.25 < share / 3000 < 0.35


def test_small_partitions_fill_all_buckets(spark):
    items = spark.range(4000).withColumn("w", F.lit(1).cast("long")).repartition(1000)
    report = ordering.balance_report(ordering.balanced_buckets(items, "id", "w", 64, mode="local"), "w", 64).collect()
    assert len(report) == 64 and report[0]["max_over_mean"] <= 1.6


def test_null_keys_and_orders_keep_their_rows(spark):
    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", None, 7), ("a", 3, 8)], "k string, o long, v long")
    found = ordering.prefix(rows, ["k"], [F.shiftright("o", 4)], [F.col("o")], sums={"total": F.col("v")}).collect()
    assert sorted((r["k"] or "", r["o"] or 0, r["total"]) for r in found) == [("", 1, 5), ("", 2, 11), ("a", 0, 7), ("a", 3, 15)]
