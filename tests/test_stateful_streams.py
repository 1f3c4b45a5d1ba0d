"""Streams with state: keys that end, and hit taxa kept up to date, over several micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from catalog.streams import in_turn
from cladeflow.operators import lca
from cladeflow.streaming import incremental, stateful


def batches(spark, path):
    return {b: df for b, df in ((int(f.name.split("=")[1]), spark.read.parquet(str(f))) for f in path.iterdir() if f.name.startswith("batch="))}


def test_keys_come_out_once_when_they_have_ended(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"k{i // 7}", i // 7, [float(i), rng.random()], i) for i in range(140)]
    df = spark.createDataFrame(rows, "key string, at long, v array<double>, i long")
    # Cuts at every 45 rows fall inside keys.
    parts = [df.where(f"i div 45 = {n}").drop("i") for n in range(4)]
    late = spark.createDataFrame([("k0", 0, [1e9, 1e9])], parts[0].schema)
    stream = in_turn(spark, [*parts[:3], parts[3].unionByName(late), stateful.end_mark(df.drop("i"), "at")])
    means = stateful.ended_means(stream, "key", "at", "v")
    seen = []

    def write(batch, batch_id):
        seen.append(sorted(r["key"] for r in batch.collect()))
        batch.write.parquet(f"{tmp_path}/out/batch={batch_id}")

    means.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sum(bool(keys) for keys in seen) >= 4
    found = {r["key"]: (r["v"], r["n_chunks"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert sorted(k for keys in seen for k in keys) == sorted(found) and len(found) == 20
    for k in range(20):
        own = [v for _, at, v, _ in rows if at == k]
        vector, n = found[f"k{k}"]
        assert n == 7 and vector == pytest.approx([sum(x) / 7 for x in zip(*own)])


def test_hit_taxa_change_only_where_hits_came(spark, tmp_path):
    rng = random.Random(2)
    tax = spark.createDataFrame([(s, f"d{s % 2}", f"s{s % 5}" if s % 7 else None) for s in range(20)], "subject long, domain string, species string")
    rows = [(f"o{rng.randrange(30)}", rng.randrange(24), rng.randrange(50, 100), rng.randrange(5)) for _ in range(600)]
    df = spark.createDataFrame(rows, "orf string, subject long, score long, part int")
    parts = [df.where(f"part = {n}").drop("part") for n in range(4)] + [df.where("part = 4 and orf < 'o11'").drop("part")]
    taxa = stateful.carried_lca(in_turn(spark, parts), tax, "orf", "subject", "score", ["domain", "species"])
    incremental.write_updates(taxa, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    by_batch = batches(spark, tmp_path / "out")
    assert len(by_batch) >= 5
    assert {r["orf"] for r in by_batch[4].collect()} == {r["orf"] for r in parts[4].select("orf").distinct().collect()}
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    want = lca.hits_lca(whole, tax, ["orf"], "subject", "score", ["domain", "species"]).collect()
    got = incremental.latest_updates(spark, f"{tmp_path}/out", ["orf"]).collect()
    key = lambda r: (r["orf"], r["n_hits"], round(r["score"], 9), r["domain"], r["species"])
    assert sorted(map(key, got), key=str) == sorted(map(key, want), key=str)


def test_hits_without_a_key_or_score_and_keys_of_one_bucket(spark, tmp_path):
    tax = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", "y")], "subject long, domain string, species string")
    rows = [("p", 1, 90, 0), ("p", 2, 100, 1), ("q", 3, None, 0), ("q", 9, None, 1), (None, 2, 50, 0), (None, 3, 10, 1), ("r", 9, -5, 0), ("s", 2, 7, 0), ("s", 2, 7, 1)]
    df = spark.createDataFrame(rows, "orf string, subject long, score long, part int")
    parts = [df.where(f"part = {n}").drop("part") for n in range(2)]
    taxa = stateful.carried_lca(in_turn(spark, parts), tax, "orf", "subject", "score", ["domain", "species"], buckets=1)
    incremental.write_updates(taxa, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {tuple(r) for r in incremental.latest_updates(spark, f"{tmp_path}/out", ["orf"]).collect()}
    assert got >= {("p", 2, 95.0, "a", None), (None, 1, 50.0, "a", "x"), ("s", 2, 7.0, "a", "x")}
    assert "q" not in {r[0] for r in got}


def test_many_keys_of_a_few_hits_take_no_call_each(spark, tmp_path):
    import time

    tax = spark.createDataFrame([(s, f"d{s % 2}") for s in range(10)], "subject long, domain string")
    hits = spark.range(120_000).selectExpr("id div 2 AS orf", "id % 10 AS subject", "100 + id % 2 AS score")
    taxa = stateful.carried_lca(in_turn(spark, [hits]), tax, "orf", "subject", "score", ["domain"], buckets=16)
    start = time.time()
    incremental.write_updates(taxa, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 60_000
    assert time.time() - start < 30


def test_state_of_hits_holds_a_name_once(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") % 5_000).alias("orf"), (F.col("id") % 7).alias("subject"), F.lit(100).cast("bigint").alias("score"))
    tax = spark.range(7).select(F.col("id").alias("subject"), F.lit("d" * 300).alias("domain"), F.concat(F.lit("s" * 300), "id").alias("species"))
    taxa = stateful.carried_lca(in_turn(spark, [rows.where("id < 9000"), rows.where("id >= 9000")]), tax, "orf", "subject", "score", ["domain", "species"], buckets=4)
    query = incremental.write_updates(taxa, f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 4
    assert query.lastProgress["stateOperators"][0]["memoryUsedBytes"] < 1_000_000
    found = incremental.latest_updates(spark, f"{tmp_path}/out", ["orf"])
    assert found.count() == 5_000 and found.where(F.col("domain") == "d" * 300).where("n_hits = 4").count() == 5_000
