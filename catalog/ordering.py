"""Runs, running means, sorted reports and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import Catalog, table
from cladeflow.operators import filters, ordering

catalog = Catalog()


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


def by_time():
    return [F.col("ts"), F.col("event_id")]


@catalog.add("w02_islands", """
WITH c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts,
  event_id) THEN 0 ELSE 1 END AS change FROM events)
SELECT event_id, user_id, event_type, CAST(sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run
FROM c""")
def islands(spark, sf):
    rows = events(spark, sf)
    runs = ordering.islands(rows, "event_type", by_time(), ordering.sketch_buckets(rows, ["user_id"], by_time()), ["user_id"])
    return runs.select("event_id", "user_id", "event_type", "run")


@catalog.add("w03_running_mean", """
WITH e AS (SELECT event_id, user_id, ts, CAST(round(value * 100) AS BIGINT) AS v FROM events)
SELECT event_id, user_id, avg(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running_mean,
  avg(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS moving_mean
FROM e""")
def running_mean(spark, sf):
    rows = events(spark, sf).withColumn("value", F.round(F.col("value") * 100).cast("bigint"))
    buckets = ordering.sketch_buckets(rows, ["user_id"], by_time())
    running = ordering.running_mean(rows, "value", by_time(), buckets, ["user_id"])
    moving = ordering.moving_mean(rows, "value", 5, by_time(), buckets, ["user_id"]).select("event_id", "moving_mean")
    return running.join(moving, "event_id").select("event_id", "user_id", "running_mean", "moving_mean")


@catalog.add("w04_abs_delta", """
SELECT event_id, round(abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id)), 6) AS abs_delta
FROM events""")
def abs_delta(spark, sf):
    rows = events(spark, sf)
    deltas = ordering.abs_delta(rows, "value", by_time(), ordering.sketch_buckets(rows, ["event_type"], by_time()), ["event_type"])
    return deltas.select("event_id", F.round("abs_delta", 6).alias("abs_delta"))


@catalog.add("w08_first_n", """
SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn
  FROM part) WHERE rn <= 3""")
def first_n(spark, sf):
    parts = table(spark, sf, "part").select("p_brand", "p_partkey")
    return ordering.first_n(parts, ["p_brand"], [F.col("p_partkey")], 3)


@catalog.add("w09_latest_file", """
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS path, count(*) AS n_files FROM orders GROUP BY o_custkey
""")
def latest_file(spark, sf):
    from cladeflow.sources.files import latest_per_key

    listing = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return latest_per_key(listing, "o_custkey", "o_orderkey", "o_orderdate").withColumnRenamed("o_orderkey", "path")


@catalog.add("o01_value_counts", """
SELECT p_type, n, row_number() OVER (ORDER BY n DESC, p_type) AS position
FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)""")
def value_counts(spark, sf):
    counts = ordering.value_counts(table(spark, sf, "part"), "p_type")
    # The values of a column are few next to its rows; their position is the prefix over the counts.
    at = ordering.global_rank(counts, [-F.col("n")], [F.col("n").desc(), F.col("p_type")])
    return at.select("p_type", "n", F.col("rank").alias("position"))


@catalog.add("o03_limit", """
SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 50""")
def limit(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_size")
    return parts.orderBy(F.desc("p_size"), "p_partkey").limit(50)


@catalog.add("u01_merge_tables", """
SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
UNION ALL SELECT s_name, s_nationkey, NULL, s_acctbal FROM supplier""")
def merge_tables(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")
    )
    return filters.merge_tables(customers, suppliers)


@catalog.add("u02_union_distinct", """
SELECT p_brand AS key FROM part UNION SELECT p_type FROM part""")
def union_distinct(spark, sf):
    parts = table(spark, sf, "part")
    return filters.merge_tables(parts.select(F.col("p_brand").alias("key")), parts.select(F.col("p_type").alias("key"))).distinct()


@catalog.add("u03_drop_keys", """
SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)""")
def drop_keys(spark, sf):
    keys = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return filters.drop_keys(table(spark, sf, "part").select("p_partkey"), keys, "p_partkey")


@catalog.add("u04_common_keys", """
SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000
INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000""")
def common_keys(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    b = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    return filters.common_keys(a, b)


@catalog.add("u05_missing_keys", """
SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000""")
def missing_keys(spark, sf):
    asked = table(spark, sf, "customer").select("c_custkey")
    found = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return filters.missing_keys(asked, found, "c_custkey")
