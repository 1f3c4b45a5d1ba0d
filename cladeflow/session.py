"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and a UTC clock; `conf` wins over the defaults."""
    builder = SparkSession.builder.appName("cladeflow")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, else one beside the tables of the session's warehouse.

    Without either of them on a shared file system a cluster cannot read back what its executors write, which is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured is None:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        fs, path = _file_system(spark, configured)
        if fs.getScheme() == "file" and not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share; {configured} is local")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
        fs, path = _file_system(spark, context.getCheckpointDir())
        fs.deleteOnExit(path)
    return configured


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the session ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    fs, path = _file_system(spark, folder)
    fs.deleteOnExit(path)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    fs, path = _file_system(spark, folder)
    fs.delete(path, True)


def remove_read(*settled: DataFrame) -> None:
    """Delete what `settle` wrote, once the rows that are made of it are settled themselves."""
    for df in settled:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write rows to the shared folder and read them back: compressed, readable by column, safe from lost executors.

    The shuffle files of the write are of no further use and go with it.
    """
    spark = df.sparkSession
    folder = scratch(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: truncates the plan and survives the loss of an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deal rows over all cores when the scan has fewer partitions than there are cores; else leave them where they are.

    For work that is heavy per row, such as cutting long sequences. A large table has far more splits than cores and is
    not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *cols) if df.rdd.getNumPartitions() < cores else df
