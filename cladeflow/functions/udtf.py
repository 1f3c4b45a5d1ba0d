"""Table functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def window_udtf():
    """`cut_windows(seq, window, step, min_len)` → `start, end, window`.

    DataFrame code should call `operators.windows.window_sequences`, which stays in the JVM.
    """

    class CutWindows:
        def eval(self, seq: str, window: int, step: int, min_len: int):
            if seq is None:
                return
            for start in range(0, len(seq) - min_len + 1, step):
                residues = seq[start : start + window]
                yield start, start + len(residues), residues

    return udtf(CutWindows, returnType="start bigint, end bigint, window string")


def register(spark: SparkSession, name: str = "cut_windows") -> None:
    spark.udtf.register(name, window_udtf())
