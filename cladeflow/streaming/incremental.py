"""Incremental forms of the batch operators, as Structured Streaming jobs.

Sinks are folders written once per micro-batch id, so a repeated micro-batch replaces its own output. Checkpoints of the
queries belong in the shared folder.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from cladeflow.operators import lca
from cladeflow.sources import fasta


def stream_mean(stream: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Running sum, count and mean per key; a key may come back at any time. For `update` mode."""
    return stream.groupBy(*keys).agg(
        F.sum(value).alias("total"), F.count(value).alias("n"), F.avg(value).alias("mean")
    )


def write_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every changed key of every micro-batch, below `path/batch=<id>`; ends when all present input is read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))

    writer = stream.writeStream.outputMode("update").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key out of the written updates."""
    rows = spark.read.parquet(path)
    values = F.struct(*[c for c in rows.columns if c not in (*keys, "batch")])
    return rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("_v")).select(*keys, "_v.*")


def stream_hits(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], score: str, frac: float = 0.9) -> StreamingQuery:
    """Keep, of every micro-batch of hits, those that may still decide the taxon of their ORF.

    The best hit of an ORF can only rise, so one that is not near the best of its own micro-batch can never count.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        lca.near_best(batch, key, score, frac).write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_lca(spark: SparkSession, path: str, tax: DataFrame, key: Sequence[str], subject: str, score: str, ranks: Sequence[str], frac: float = 0.9) -> DataFrame:
    """ORF taxa from all hits kept so far; an ORF may have been cut anywhere by the micro-batches."""
    return lca.hits_lca(spark.read.parquet(path).drop("batch"), tax, key, subject, score, ranks, frac)


def stream_metrics(stream: DataFrame, ts: str, value: str, keys: Sequence[str] = (), width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Per tumbling window: rows, mean, last value and duration in hours; rows later than `late` are dropped.

    For `append` mode: a window comes out once, after the watermark has passed its end.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    timed = stream.withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), *keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        F.max_by(value, ts).alias("last"),
        ((F.max(seconds) - F.min(seconds)) / 3600).alias("hours"),
    ).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "mean", "last", "hours")


def write_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append rows to a Parquet folder with exactly-once file commits; ends when all present input is read."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_fasta(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Records of FASTA files as they arrive in a folder."""
    reader = spark.readStream.option("lineSep", fasta.RECORD_SEPARATOR)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return fasta.parse_records(reader.text(path).select("value", F.col("_metadata.file_path").alias("path")))


def stream_scored(records: DataFrame, infer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Window outputs of arriving records: `infer` maps records to scored windows and must not aggregate."""
    return infer(records.select("path", "seq_id", "sequence"))
