"""Permutations that are formulas."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from cladeflow.operators import ordering, windows


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 4097])
def test_every_place_is_taken_once(spark, n):
    rows = spark.range(n).crossJoin(spark.range(4).withColumnRenamed("id", "seed"))
    keys = ordering.permutation_keys(3, "seed")
    found = rows.withColumn("p", ordering.permuted(F.col("id"), F.lit(n), keys)).toPandas()
    orders = [tuple(g.sort_values("id").p) for _, g in found.groupby("seed")]
    assert all(sorted(o) == list(range(n)) for o in orders)
    assert n < 7 or len(set(orders)) == 4


def test_places_look_random(spark):
    n = 20_000
    rows = spark.range(n).withColumn("p", ordering.permuted(F.col("id"), F.lit(n), ordering.permutation_keys(1, F.lit("x"))))
    place = rows.orderBy("id").toPandas().p.to_numpy()
    assert abs(np.corrcoef(np.arange(n), place)[0, 1]) < 0.03 and abs(np.corrcoef(place[1:], place[:-1])[0, 1]) < 0.03
    # Each tenth of the numbers is spread over the tenths of the places.
    counts = np.histogram2d(np.arange(n), place, bins=10)[0]
    assert counts.min() > 120 and counts.max() < 280
    assert len(set(np.diff(place))) > n / 4


def test_a_record_of_two_million_windows(spark):
    n = 2_000_000
    record = spark.createDataFrame([("r", n * 100 + 60)], "k string, L long")
    split = windows.split_windows(record, "k", "L", 200, 100, seed=5)
    assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()
    facts = split.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("perm").alias("places"), F.min("perm").alias("low"), F.max("perm").alias("high"),
        F.count_if(F.col("split") == "val").alias("val"), F.count_distinct("start").alias("starts"),
    ).first()
    assert tuple(facts) == (n, n, 0, n - 1, n // 5, n)


@pytest.mark.parametrize("shift", [0, 5])
def test_epochs_of_an_index_with_and_without_gaps(spark, shift):
    df = spark.range(100).select((F.col("id") * (1 if not shift else 3) + shift).alias("i"))
    out = ordering.epoch_order(df, "i", 7, 11)
    assert ("Exchange" in out._jdf.queryExecution().executedPlan().toString()) == bool(shift)
    found = out.toPandas().sort_values("position")
    assert found.position.tolist() == list(range(100)) and (found.part == found.i % 7).all()
    assert (found.part != found.part.shift()).sum() == 7
    plain = ordering.epoch_order(df, "i", 1, 11, shuffle=False).toPandas().sort_values("position")
    assert plain.i.is_monotonic_increasing
    assert ordering.epoch_order(df.where("false"), "i", 7, 11).count() == 0


def test_the_permutation_of_a_partition_is_worked_out_once(spark):
    # 150,000 rows took minutes while each round of each row hashed the name of its partition again.
    import time

    start = time.time()
    out = ordering.epoch_order(spark.range(150_000).toDF("i"), "i", 7, 11)
    found = out.agg(F.count_distinct("position").alias("n"), F.min("position").alias("low"), F.max("position").alias("high")).first()
    assert tuple(found) == (150_000, 0, 149_999)
    assert time.time() - start < 45
    one = out.where("part = 3").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("part")))
    plain = ordering.permuted(F.expr("i div 7"), F.col("n"), ordering.permutation_keys(11, "part"))
    shifts = one.where("i < 700").select((F.col("position") - plain).alias("start")).distinct().collect()
    assert len(shifts) == 1
