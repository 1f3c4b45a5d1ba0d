"""Buckets between sampled splitters: even whatever the values, and equal to a sorted sweep."""

import random
import re
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cladeflow.operators import distance, evaluate, joins, ordering

ROWS = 4000


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 200)


@pytest.fixture(scope="module")
def busy(spark):
    """All rows in one hour, most of them of one key, some orders and keys NULL."""
    rng = random.Random(3)
    start = datetime(2024, 1, 1, 5)
    rows = []
    for i in range(ROWS):
        ts = None if rng.random() < 0.02 else start + timedelta(microseconds=rng.randrange(10**9))
        rows.append((i, ts, "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), rng.randrange(100)))
    return spark.createDataFrame(rows, "id long, ts timestamp, key string, kind string, v long").repartition(6), rows


def order():
    return [F.col("ts"), F.col("id")]


def swept(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or datetime.min, r[0])):
        out.setdefault(r[2], []).append(r)
    return out


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_buckets_are_even_and_monotone(busy, keys):
    df, rows = busy
    bucket = ordering.sketch_buckets(df, keys, order(), 100)[0]
    placed = df.withColumn("b", bucket).groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*keys, "ts", "id")).alias("low"), F.max(F.struct(*keys, "ts", "id")).alias("high"))
    placed = placed.orderBy("b")
    sizes = [r["n"] for r in placed.collect()]
    assert len(sizes) == 40 and max(sizes) < 2 * np.mean(sizes)
    assert placed.withColumn("before", F.lag("high").over(ordering.Window.orderBy("b"))).where("before >= low").isEmpty()


def test_a_sample_stands_for_more_rows_than_it_holds(spark, monkeypatch):
    monkeypatch.setattr(ordering, "MOST_BUCKETS", 16)
    df = spark.range(50_000).select(F.lit("k").alias("k"), (F.col("id") / 1e9).alias("score"))
    sizes = [r["count"] for r in df.groupBy(ordering.sketch_buckets(df, ["k"], [F.col("score")], 1000)[0].alias("b")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * np.mean(sizes)


def test_sums_lasts_and_runs_equal_a_sweep(busy, small_buckets):
    df, rows = busy
    buckets = ordering.sketch_buckets(df, ["key"], order())
    found = ordering.prefix(df, ["key"], buckets, order(), sums={"s": F.col("v")}, lasts={"l": F.when(F.col("v") > 95, F.col("v"))}).collect()
    runs = {r["id"]: r["run"] for r in ordering.islands(df, "kind", order(), buckets, ["key"]).collect()}
    sums, lasts = {r["id"]: r["s"] for r in found}, {r["id"]: r["l"] for r in found}
    assert len(found) == len(runs) == ROWS
    for own in swept(rows).values():
        total, last, run, before = 0, None, 0, object()
        for i, _, _, kind, v in own:
            total, last = total + v, v if v > 95 else last
            run, before = run + (kind != before), kind
            assert (sums[i], lasts[i], runs[i]) == (total, last, run)


def test_few_exchanges_and_one_row_shuffle(busy, small_buckets):
    df, _ = busy
    buckets = ordering.sketch_buckets(df, ["key"], order())
    for out in (ordering.prefix(df, ["key"], buckets, order(), sums={"s": F.col("v")}), ordering.islands(df, "kind", order(), buckets, ["key"])):
        text = out._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange (?:hash|range)partitioning|Exchange SinglePartition", text)) <= 4 + text.count("RoundRobin")


def test_scores_in_one_range(spark, small_buckets):
    rng = np.random.default_rng(2)
    score, y = 0.999 + rng.random(3000) / 1000, rng.integers(0, 2, 3000)
    df = spark.createDataFrame(pd.DataFrame({"score": score, "y": y}))
    got = evaluate.roc_curve(df, "y", "score").toPandas().sort_values("threshold", ascending=False)
    by = np.argsort(-score)
    assert np.allclose(got.tpr, y[by].cumsum() / y.sum()) and np.allclose(got.fpr, (1 - y[by]).cumsum() / (1 - y).sum())
    # Scores beyond [0, 1] have their place as well.
    wide = evaluate.roc_auc(df.withColumn("score", F.col("score") * 1000 - 999.5), "y", "score").first()["auc"]
    assert wide == pytest.approx(evaluate.roc_auc(df, "y", "score").first()["auc"])


def test_ranks_beside_an_outlier(spark, small_buckets):
    values = [1e300, -5.0, *np.random.default_rng(1).normal(size=3000).round(2).tolist()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, x double")
    got = {r["id"]: r["rank"] for r in distance.average_ranks(df, "x", "rank").collect()}
    want = pd.Series(values).rank()
    assert all(got[i] == want[i] for i in range(len(values)))


def test_asof_of_one_busy_hour(spark, busy, small_buckets):
    df, rows = busy
    left, right = df.where("id % 10 = 0"), df.where("id % 10 <> 0")
    found = joins.asof_last(left.select("key", "ts", "id"), right.select("key", "ts", "v"), "ts", {"last": F.col("v")}, ["key"], "id").collect()
    times = {}
    for i, ts, key, _, v in rows:
        if i % 10:
            times.setdefault((key, ts), []).append(v)
    got = {r["id"]: r["last"] for r in found}
    assert len(got) == ROWS // 10
    for i, ts, key, _, _ in rows:
        if i % 10 == 0:
            before = [t for k, t in times if k == key and (t is None or ts is not None and t <= ts)]
            latest = max(before, key=lambda t: (t is not None, t or datetime.min), default="none")
            assert got[i] is None if latest == "none" else got[i] in times[key, latest]
