"""Cutting sequences into windows, and assigning windows to training and validation.

Sequences are residue strings, one byte per residue. Slices are taken from the bytes, where a position is an offset;
on a string every slice would count characters from the start again. Records of many megabases are first cut into
overlapping tiles, so that no single row holds all windows of a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cladeflow.functions import sequence as S, vectors as V
from cladeflow.operators import ordering

MIN_LEN = 100
WINDOWS_PER_TILE = 2048
NUMBERS_PER_BLOCK = 8192


def tile(df: DataFrame, seq: str, span: int, overlap: int, start: str = "tile_start") -> DataFrame:
    """Cut `seq` into tiles that start every `span` residues and share `overlap` residues with the next one.

    Every run of `overlap + 1` residues lies whole in exactly one tile. Sequences not longer than `overlap` give none.
    """
    starts = F.transform(_ordinals(F.ceil((F.length(seq) - overlap) / span)), lambda i: i * span)
    rows = df.withColumn(start, F.explode(starts))
    return rows.withColumn(seq, slice_seq(F.col(seq), F.col(start), F.lit(span + overlap)))


def _ordinals(n: Column, step: int = 1) -> Column:
    """0, step, 2·step… below n; empty for n ≤ 0.

    Empty arrays end a row inside the generator. A filter on the length would be pushed below and compute a derived
    sequence a second time.
    """
    n = n.cast("bigint")
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def _numbered(df: DataFrame, n: Column, name: str) -> DataFrame:
    """One row per number 0 … n - 1, from blocks of numbers: no row holds all of a long record."""
    blocks = df.withColumn("_n", n).withColumn("_first", F.explode(_ordinals(F.col("_n"), NUMBERS_PER_BLOCK)))
    here = F.least(F.col("_n") - F.col("_first"), F.lit(NUMBERS_PER_BLOCK))
    return blocks.withColumn("_at", F.explode(_ordinals(here))).withColumn(name, F.col("_first") + F.col("_at")).drop("_n", "_first", "_at")


def slice_seq(seq: Column, start: Column, length: Column) -> Column:
    """Residues `[start, start + length)`, 0-based, by byte offset."""
    return F.substring(seq.cast("binary"), start.cast("int") + 1, length.cast("int")).cast("string")


def window_count(length: Column, step: int, min_len: int = MIN_LEN) -> Column:
    """How many windows a sequence gives; never negative."""
    return F.when(length >= min_len, F.floor((length - min_len) / step) + 1).otherwise(F.lit(0).cast("bigint"))


def window_counts(df: DataFrame, seq_len: str, window: int, step: int | None = None, min_len: int = MIN_LEN) -> DataFrame:
    """Adds `n_windows` and `kept`, the share of the windows without a minimum length, both in closed form."""
    step = _check(window, step, min_len)
    length = F.col(seq_len)
    every = F.ceil(length / step)
    n = window_count(length, step, min_len)
    return df.withColumn("n_windows", n).withColumn("kept", F.when(every > 0, F.col("n_windows") / every))


def window_sequences(
    df: DataFrame, seq: str, window: int, step: int | None = None, min_len: int = MIN_LEN
) -> DataFrame:
    """One row per window: the columns of `df` but for `seq`, then `start, end, window`.

    Starts run over 0, step, 2·step… and a window ends at the end of its sequence; windows shorter than `min_len` are
    never generated.
    """
    step = _check(window, step, min_len)
    carried = [c for c in df.columns if c != seq]
    n = window_count(F.length(seq), step, min_len)
    tiles = df.select(*carried, seq, n.alias("_n"))
    tiles = tiles.withColumn("_first", F.explode(_ordinals(F.col("_n"), WINDOWS_PER_TILE)))
    here = F.least(F.col("_n") - F.col("_first"), F.lit(WINDOWS_PER_TILE))
    span = (WINDOWS_PER_TILE - 1) * step + window
    body = F.substring(F.col(seq).cast("binary"), (F.col("_first") * step).cast("int") + 1, F.lit(span))

    def cut(residues):
        def one(i):
            return F.struct(
                ((F.col("_first") + i) * step).alias("start"),
                F.substring(residues, (i * step).cast("int") + 1, F.lit(window)).cast("string").alias("window"),
            )

        return F.transform(F.sequence(F.lit(0).cast("bigint"), here - 1), one)

    cuts = tiles.select(*carried, F.explode(V.bind(body, cut)).alias("_w"))
    start, residues = F.col("_w.start"), F.col("_w.window")
    return cuts.select(*carried, start.alias("start"), (start + F.length(residues)).alias("end"), residues.alias("window"))


def window_spans(df: DataFrame, seq_len: str, window: int, step: int | None = None, min_len: int = MIN_LEN) -> DataFrame:
    """`start, end` of every window from the length alone: no residues are read or moved."""
    step = _check(window, step, min_len)
    n = window_count(F.col(seq_len), step, min_len)
    rows = _numbered(df, n, "start").withColumn("start", F.col("start") * step)
    return rows.withColumn("end", F.least(F.col("start") + window, F.col(seq_len)))


def both_strands(df: DataFrame, seq: str) -> DataFrame:
    """Twice the rows, `strand` + and −; the reverse windows are those of the reverse-complemented sequence."""
    strands = F.array(
        F.struct(F.lit("+").alias("strand"), F.col(seq).alias("seq")),
        F.struct(F.lit("-").alias("strand"), S.revcomp(F.col(seq)).alias("seq")),
    )
    others = [c for c in df.columns if c != seq]
    doubled = df.select(*others, F.explode(strands).alias("_s"))
    return doubled.select(*others, F.col("_s.strand").alias("strand"), F.col("_s.seq").alias(seq))


def window_ids(windows: DataFrame, name: str) -> DataFrame:
    """Adds the positional id `name|start-end`."""
    return windows.withColumn("window_id", F.format_string("%s|%d-%d", F.col(name).cast("string"), "start", "end"))


def window_for_inference(df: DataFrame, seq: str, window: int, step: int | None = None) -> DataFrame:
    """Every window, the short ones too, padded to the window length."""
    cuts = window_sequences(df, seq, window, step, min_len=1)
    return cuts.withColumn("window", S.pad_seq(F.col("window"), window))


def batch_ids(windows: DataFrame, key: str, step: int, batch: int) -> DataFrame:
    """Number of the batch of `batch` consecutive windows a window belongs to, within its sequence."""
    ordinal = F.floor(F.col("start") / step)
    return windows.withColumn("batch", F.floor(ordinal / batch))


def split_windows(
    df: DataFrame,
    key: str,
    seq_len: str,
    window: int,
    step: int | None = None,
    min_len: int = MIN_LEN,
    val_frac: float = 0.2,
    seed: int = 0,
) -> DataFrame:
    """Training or validation for every window, stratified within its sequence: `…, start, perm, split`.

    The windows of a sequence follow from its length, and the place of a window in their permutation from its number:
    no shuffle, and no list of the windows of a sequence. The first `n - round_half_even(val_frac · n)` places are for
    training.
    """
    step = _check(window, step, min_len)
    n = window_count(F.col(seq_len), step, min_len)
    first, second = ordering.permutation_keys(seed, key)
    rows = _numbered(df.withColumns({"_count": n, "_k1": first, "_k2": second}), F.col("_count"), "_i")
    place = ordering.permuted(F.col("_i"), F.col("_count"), (F.col("_k1"), F.col("_k2")))
    n_val = F.bround(F.col("_count") * F.lit(val_frac), 0)
    rows = rows.withColumn("perm", place)
    split = F.when(F.col("perm") < F.col("_count") - n_val, "train").otherwise("val")
    return rows.select(*df.columns, (F.col("_i") * step).alias("start"), "perm", split.alias("split"))


def dataset_stats(
    df: DataFrame,
    taxon: str,
    seq_len: str,
    window: int,
    step: int | None = None,
    min_len: int = MIN_LEN,
    val_frac: float = 0.2,
    both: bool = False,
) -> DataFrame:
    """Taxa, sequences, windows, discarded windows and split sizes in one aggregation, without any window."""
    step = _check(window, step, min_len)
    copies = 2 if both else 1
    n = window_count(F.col(seq_len), step, min_len)
    n_val = F.bround(n * F.lit(val_frac), 0).cast("bigint")
    return df.agg(
        F.count_distinct(F.when(n > 0, F.col(taxon))).alias("n_taxa"),
        F.count(F.lit(1)).alias("n_seqs"),
        (F.sum(n) * copies).alias("n_windows"),
        (F.sum(F.ceil(F.col(seq_len) / step) - n) * copies).alias("n_discarded"),
        (F.sum(n - n_val) * copies).alias("n_train"),
        (F.sum(n_val) * copies).alias("n_val"),
    )


def _check(window: int, step: int | None, min_len: int) -> int:
    if min_len < 1 or window < min_len:
        raise ValueError(f"window {window} must be at least the minimum length {min_len}, and that at least 1")
    step = window if step is None else step
    if step < 1:
        raise ValueError(f"step {step} must be positive")
    return step
