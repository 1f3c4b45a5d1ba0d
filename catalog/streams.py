"""Streams over the given tables, each replayed from files in small micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.aggregating import scored
from catalog.common import CHUNKS_CTE, Catalog, hits, sequences, subject_taxonomy, table
from catalog.files import header
from catalog.lca import ORF_CTE, RANKS
from catalog.models import CLASSES, SCORED_CTE, STEP, WIDTH, linear_model
from cladeflow import scratch, spread
from cladeflow.operators import aggregate
from cladeflow.plans import inference
from cladeflow.session import settle
from cladeflow.sources import fasta
from cladeflow.streaming import incremental, stateful

catalog = Catalog()


def per_trigger(df, n_batches):
    """Files of a micro-batch, when the rows are written by the tasks they have now."""
    return max(1, -(-df.rdd.getNumPartitions() // n_batches))


def replay(spark, df, n_batches):
    """The rows as a stream of about `n_batches` micro-batches, in no particular order."""
    path, rows = scratch(spark, "stream"), spread(df)
    rows.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_trigger(rows, n_batches)).parquet(path)


@catalog.add("t01_stream_mean", """
SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, count(*) AS n,
  avg(CAST(round(value * 100) AS BIGINT)) AS mean FROM events GROUP BY user_id""")
def stream_mean(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.round(F.col("value") * 100).cast("bigint").alias("value"))
    out = scratch(spark, "means")
    means = incremental.stream_mean(replay(spark, rows, 4), ["user_id"], "value")
    incremental.write_updates(means, out, scratch(spark, "query")).awaitTermination()
    return incremental.latest_updates(spark, out, ["user_id"])


def in_turn(spark, parts):
    """A stream that brings each of the given tables in a micro-batch of its own, in their order."""
    path = scratch(spark, "stream")
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


@catalog.add("t01_ended_means", f"""
WITH {CHUNKS_CTE} SELECT seq_id, class, round(avg(p), 6) AS p, count(*) AS n_chunks FROM probs GROUP BY seq_id, class""")
def ended_means(spark, sf):
    rows = settle(scored(spark, sf).select("seq_id", "chunk_id", "p"))
    # Cuts of the order of sequences that also fall inside one: its sums are carried over.
    last = rows.agg(F.max("seq_id")).first()[0]
    cuts = [last * i // 5 for i in range(1, 5)]
    part = sum(((F.col("seq_id") > c) | ((F.col("seq_id") == c) & (F.col("chunk_id") % 2 == 1))).cast("int") for c in cuts)
    parts = [rows.where(part == i) for i in range(5)]
    stream = in_turn(spark, [*parts, stateful.end_mark(rows, "seq_id")])
    marked = stream.withColumn("order", F.col("seq_id")).withColumn("seq_id", F.when(F.col("p").isNotNull(), F.col("seq_id")))
    out = scratch(spark, "means")
    incremental.write_append(stateful.ended_means(marked, "seq_id", "order", "p"), out, scratch(spark, "query")).awaitTermination()
    long = aggregate.long_outputs(spark.read.parquet(out), ["seq_id", "n_chunks"], "p")
    return long.select("seq_id", F.col("class").cast("bigint").alias("class"), F.round("p", 6).alias("p"), "n_chunks")


@catalog.add("t02_stream_hits_lca", f"""
WITH {ORF_CTE} SELECT orf, n_hits, bitscore, domain, phylum, species FROM orf_lca""")
def stream_hits_lca(spark, sf):
    out = scratch(spark, "hits")
    stream = replay(spark, hits(spark, sf), 4)
    taxa = stateful.carried_lca(stream, subject_taxonomy(spark, sf), "orf", "subject", "bitscore", RANKS)
    incremental.write_updates(taxa, out, scratch(spark, "query")).awaitTermination()
    return incremental.latest_updates(spark, out, ["orf"])


@catalog.add("t03_stream_metrics", """
WITH e AS (SELECT event_type, ts, CAST(round(value * 100) AS BIGINT) AS value,
  CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, max(epoch_us(ts)) OVER () - 3600000000 AS mark FROM events)
SELECT day, event_type, count(*) AS n, avg(value) AS mean, arg_max(value, ts) AS last,
  round((max(epoch_us(ts)) - min(epoch_us(ts))) / 3600000000, 5) AS hours FROM e
WHERE (day + 1) * 86400000000 <= mark GROUP BY day, event_type""")
def stream_metrics(spark, sf):
    value = F.round(F.col("value") * 100).cast("bigint").alias("value")
    rows = settle(table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", value))
    # Four parts in the order of time, each with some rows of the part before it that the watermark still lets in.
    span = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    part = F.least(F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(span["a"]))) * 4 / (F.unix_micros(F.lit(span["b"])) - F.unix_micros(F.lit(span["a"])))), F.lit(3))
    behind = F.floor((F.unix_micros("ts") + F.lit(1_800_000_000) - F.unix_micros(F.lit(span["a"]))) * 4 / (F.unix_micros(F.lit(span["b"])) - F.unix_micros(F.lit(span["a"]))))
    place = F.when(F.col("event_type") == "click", F.least(behind, F.lit(3))).otherwise(part)
    late = rows.where(part == 0).withColumn("value", F.lit(10**9).cast("bigint"))
    parts = [rows.where(place == i) for i in range(3)] + [rows.where(place == 3).unionByName(late)]
    out = scratch(spark, "metrics")
    windows = incremental.stream_metrics(in_turn(spark, parts), "ts", "value", ["event_type"])
    incremental.write_append(windows, out, scratch(spark, "query")).awaitTermination()
    found = spark.read.parquet(out)
    day = F.floor(F.unix_seconds("start") / 86400)
    return found.select(day.alias("day"), "event_type", "n", "mean", "last", F.round("hours", 5).alias("hours"))


@catalog.add("t04_stream_fasta", f"""
WITH {SCORED_CTE} SELECT CAST(seq_id AS VARCHAR) AS seq_id, count(*) AS n_chunks, round(avg(p0), 6) AS p0, round(avg(p1), 6) AS p1,
  round(avg(p2), 6) AS p2 FROM p GROUP BY seq_id""")
def stream_fasta(spark, sf):
    incoming, out = scratch(spark, "incoming"), scratch(spark, "scored")
    seqs = sequences(spark, sf)
    fasta.write_fasta(seqs, incoming, header(), "seq")

    def infer(records):
        return inference.infer_sequences(records, "sequence", WIDTH, STEP, linear_model(), CLASSES)

    scored = incremental.stream_scored(incremental.stream_fasta(spark, incoming, per_trigger(seqs, 3)), infer)
    incremental.write_append(scored, out, scratch(spark, "query")).awaitTermination()
    outputs = spark.read.parquet(out).withColumn("seq_id", F.element_at(F.split("seq_id", "-"), -1))
    means = aggregate.mean_outputs(outputs, ["seq_id"], "p")
    return means.select("seq_id", "n_chunks", *[F.round(F.get("p", i), 6).alias(f"p{i}") for i in range(CLASSES)])
