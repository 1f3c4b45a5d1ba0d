"""Grouped statistics of sequences, k-mers, assemblies and class vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F, types as T

from cladeflow.functions import sequence as S, vectors as V
from cladeflow.operators import ordering, windows


def scale_by_max(df: DataFrame, col: str, out: str) -> DataFrame:
    """`col` divided by its maximum over the table."""
    return df.withColumn(out, F.col(col) / df.agg(F.max(col)).scalar())


# -- sequences ---------------------------------------------------------------------------------------------------


def count_sequence(df: DataFrame, file: str, length: str) -> DataFrame:
    """Records and bases per file, with the total in the row whose file is NULL."""
    return df.rollup(file).agg(F.count(F.lit(1)).alias("n_records"), F.sum(length).cast("bigint").alias("n_bases"))


def genome_lengths(df: DataFrame, key: str, length: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(length).cast("bigint").alias("length"))


def assembly_stats(df: DataFrame, key: str, length: str, compat: bool = False) -> DataFrame:
    """Contig count, maximum, mean, and the 50 % and 90 % statistics per genome.

    The statistic sits at the first contig, longest first, where the running sum is strictly greater than the share of
    the total. Equal lengths are counted first, so the running sum runs over distinct lengths; a genome with many of
    them is spread over buckets of similar length. `compat` names the length `l50` and the 0-based rank `n50`.
    """
    by_length = df.groupBy(key, length).agg(F.count(F.lit(1)).alias("_n"))
    by_length = by_length.withColumn("_bases", F.col(length) * F.col("_n"))
    step = -F.floor(F.log2(F.col(length) + 1) * 16)
    running = ordering.prefix(
        by_length,
        keys=[key],
        buckets=[step],
        order=[F.col(length).desc()],
        sums={"_cum": F.col("_bases"), "_rank": F.col("_n")},
    )
    totals = by_length.groupBy(key).agg(
        F.sum("_n").alias("n_ctgs"),
        F.max(length).alias("max_len"),
        (F.sum("_bases") / F.sum("_n")).alias("mean_len"),
        F.sum("_bases").alias("_total"),
    )
    rows = ordering.same_keys_join(running, totals, [key])
    picks = []
    for share in (50, 90):
        above = F.col("_cum") > F.col("_total") * (share / 100.0)
        before = F.col("_cum") - F.col("_bases")
        # Contigs of this length needed to pass the threshold, after all longer ones.
        needed = F.floor((F.col("_total") * (share / 100.0) - before) / F.nullif(F.col(length), F.lit(0))) + 1
        rank = F.col("_rank") - F.col("_n") + needed
        picks += [
            F.max(F.when(above, F.col(length))).alias(f"_len{share}"),
            F.max_by(F.when(above, rank), F.when(above, F.col(length))).cast("bigint").alias(f"_rank{share}"),
        ]
    stats = rows.groupBy(key).agg(
        *[F.first(c).alias(c) for c in ("n_ctgs", "max_len", "mean_len")], *picks
    )
    if compat:
        named = [("_len50", "l50", 0), ("_rank50", "n50", 1), ("_len90", "l90", 0), ("_rank90", "n90", 1)]
    else:
        named = [("_len50", "n50_len", 0), ("_rank50", "n50_rank", 0), ("_len90", "n90_len", 0), ("_rank90", "n90_rank", 0)]
    return stats.select(
        key, "n_ctgs", "max_len", "mean_len", *[(F.col(c) - shift if shift else F.col(c)).alias(n) for c, n, shift in named]
    )


# -- k-mers ------------------------------------------------------------------------------------------------------


def canonical_kmers(k: int = 4) -> list[str]:
    """All canonical k-mers over A, C, G, T in name order."""
    from itertools import product

    swap = str.maketrans("ACGT", "TGCA")
    words = ("".join(p) for p in product("ACGT", repeat=k))
    return sorted({min(w, w.translate(swap)[::-1]) for w in words})


def _kmer_counter(k: int, n_keys: int):
    """The task that counts k-mers per key in an Arrow batch. Self-contained, so that workers need numpy and arrow only."""
    flat, most_counters, most_residues = S._flat(), 1 << 22, S.PIECE

    def count(batch):
        import numpy as np
        import pyarrow as pa

        data, offsets = flat(batch.column(n_keys))
        keys = [batch.column(i).dictionary_encode() for i in range(n_keys)]
        group = np.zeros(batch.num_rows, dtype=np.int64)
        for key in keys:
            indices = key.indices.fill_null(len(key.dictionary)).to_numpy(zero_copy_only=False)
            group = np.unique(group * (len(key.dictionary) + 1) + indices, return_inverse=True)[1]
        groups, first = np.unique(group, return_index=True)
        starts, ends = offsets[:-1], np.maximum(offsets[1:] - k + 1, offsets[:-1])
        sizes = ends - starts
        at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        # Residues that occur, numbered; a k-mer is a number in that base.
        used = np.flatnonzero(np.bincount(data, minlength=256))
        base, rank = max(1, len(used)), np.zeros(256, dtype=np.int64)
        rank[used] = np.arange(len(used))
        if not len(at):
            return np.zeros(0, dtype=np.int64), [], []
        if base**k * len(groups) < 2**62:
            small, word = rank[data], np.zeros(len(at), dtype=np.int64)
            for j in range(k):
                word = word * base + small[at + j]
            word += np.repeat(group, sizes) * base**k
            if base**k * len(groups) <= most_counters:
                counts = np.bincount(word, minlength=base**k * len(groups))
                found = np.flatnonzero(counts)
                counts = counts[found]
            else:
                found, counts = np.unique(word, return_counts=True)
            owner, number = found // base**k, found % base**k
            letters = np.empty((len(found), k), dtype=np.uint8)
            for j in reversed(range(k)):
                letters[:, j], number = used[number % base], number // base
        else:
            rows = np.concatenate([np.repeat(group, sizes).astype(">i8").view(np.uint8).reshape(-1, 8), data[at[:, None] + np.arange(k)]], axis=1)
            rows, counts = np.unique(rows, axis=0, return_counts=True)
            owner, letters = rows[:, :8].copy().view(">i8").ravel(), rows[:, 8:].copy()
        offsets = pa.py_buffer((np.arange(len(letters) + 1) * k).astype(np.int32).tobytes())
        words = pa.Array.from_buffers(pa.string(), len(letters), [None, offsets, pa.py_buffer(letters.tobytes())])
        return first[owner], words, counts

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for whole in batches:
            # The arrays of numbers beside a piece are many times its residues: pieces are bounded by these, not by rows.
            lengths = pc.fill_null(pc.binary_length(whole.column(n_keys)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // most_residues, prepend=-1)).tolist()
            for start, end in zip(cuts, [*cuts[1:], whole.num_rows]):
                batch = whole.slice(start, end - start)
                rows, words, counts = count(batch)
                if len(rows):
                    names = [*batch.schema.names[:n_keys], "kmer", "n"]
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(rows)) for i in range(n_keys)], words, pa.array(counts, pa.int64())], names=names)

    return run


def kmer_counts(df: DataFrame, keys: Sequence[str], seq: str, k: int = 4, canonical: bool = False) -> DataFrame:
    """`keys, kmer, n`: overlapping k-mers of residues, one byte each.

    Tasks count per batch of tiles in an array of counters, and only these are shuffled. The canonical form is taken after
    counting, on distinct k-mers.
    """
    tiles = windows.tile(df.select(*keys, seq), seq, span=1 << 16, overlap=k - 1).select(*keys, seq)
    schema = T.StructType([*[tiles.schema[key] for key in keys], T.StructField("kmer", T.StringType()), T.StructField("n", T.LongType())])
    counted = tiles.mapInArrow(_kmer_counter(k, len(keys)), schema).groupBy(*keys, "kmer").agg(F.sum("n").alias("n"))
    if not canonical:
        return counted
    merged = counted.withColumn("kmer", S.canonical_kmer(F.col("kmer")))
    return merged.groupBy(*keys, "kmer").agg(F.sum("n").alias("n"))


def fill_kmers(counts: DataFrame, keys: Sequence[str], k: int = 4) -> DataFrame:
    """One row per key and canonical k-mer; a missing count is 0.

    The grid is a generator over the constant k-mer list, not a join.
    """
    words = F.array(*[F.lit(w) for w in canonical_kmers(k)])
    grid = counts.select(*keys).distinct().select(*keys, F.explode(words).alias("kmer"))
    return grid.join(counts, [*keys, "kmer"], "left").na.fill(0, ["n"])


def tetramer_freq(df: DataFrame, keys: Sequence[str], seq: str, norm: str = "kept", k: int = 4) -> DataFrame:
    """Canonical k-mer frequencies `keys, kmer, freq`.

    `norm="kept"` divides by the unambiguous k-mers, `norm="all"` by every k-mer of the sequence; `norm="both"` gives
    the second one as `freq_all`, from the same count.
    """
    counts = kmer_counts(df, keys, seq, k, canonical=True)
    ambiguous = F.col("kmer").rlike("[^ACGT]")
    # After counting, a key holds at most one row per distinct k-mer: a window over it is small.
    whole = Window.partitionBy(*keys)
    rows = counts.select(
        "*", F.sum("n").over(whole).alias("_all"), F.sum(F.when(~ambiguous, F.col("n"))).over(whole).alias("_kept")
    ).where(~ambiguous)
    kept, every = F.col("n") / F.col("_kept"), F.col("n") / F.col("_all")
    shares = [kept.alias("freq"), every.alias("freq_all")] if norm == "both" else [(every if norm == "all" else kept).alias("freq")]
    return rows.select(*keys, "kmer", *shares)


def tetramer_table(df: DataFrame, keys: Sequence[str], seq: str, norm: str = "kept", k: int = 4) -> DataFrame:
    """The frequencies as one row per key with a column per canonical k-mer."""
    freq = tetramer_freq(df, keys, seq, norm, k)
    return freq.groupBy(*keys).pivot("kmer", canonical_kmers(k)).agg(F.first("freq")).na.fill(0.0)


# -- class vectors -----------------------------------------------------------------------------------------------


def mean_outputs(df: DataFrame, keys: Sequence[str], vec: str, weight: str | None = None, pool: str = "mean") -> DataFrame:
    """Mean (optionally weighted) or maximum class vector per key, plus the number of windows.

    Partial sums of whole vectors are combined before the shuffle, which moves one vector per key and map task.
    """
    rows = df.withColumn("_v", array_to_vector(F.col(vec)))
    metric = Summarizer.max if pool == "max" else Summarizer.mean
    pooled = metric(F.col("_v"), F.col(weight).cast("double")) if weight else metric(F.col("_v"))
    return rows.groupBy(*keys).agg(vector_to_array(pooled).alias(vec), F.count(F.lit(1)).alias("n_chunks"))


def var_outputs(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """Population variance per key and class."""
    rows = df.withColumn("_v", array_to_vector(F.col(vec)))
    sample = rows.groupBy(*keys).agg(
        vector_to_array(Summarizer.variance(F.col("_v"))).alias(vec), F.count(F.lit(1)).alias("n_chunks")
    )
    shrink = (F.col("n_chunks") - 1) / F.col("n_chunks")
    return sample.withColumn(vec, V.bind(shrink, lambda s: F.transform(vec, lambda x: x * s)))


def long_outputs(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """`keys, class, p`, one row per class."""
    exploded = df.select(*keys, F.posexplode(vec).alias("class", "p"))
    return exploded.withColumn("class", F.col("class").cast("int"))


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.5, accuracy: int = 10000) -> DataFrame:
    """Exact interpolated quantile per key, without sorting a whole group in one task.

    A mergeable sketch brackets the wanted ranks; its rank error is at most n / accuracy, so the exact value lies
    inside the bracket. Rows below the bracket are only counted, and only rows inside it are ranked, after equal values
    have been counted together.
    """
    slack = 2.0 / accuracy
    low, high = max(share - slack, 0.0), min(share + slack, 1.0)
    bracket = df.groupBy(*keys).agg(
        F.percentile_approx(value, [low, high], accuracy).alias("_q"), F.count(value).alias("_n")
    )
    bracket = bracket.withColumn("_pos", (F.col("_n") - 1) * share)
    # A bracket has to hold the neighbours used for interpolation too: widen it to the extremes in small groups.
    small = F.col("_n") <= accuracy
    bracket = bracket.select(
        *keys,
        "_n",
        "_pos",
        F.when(small, F.lit(float("-inf"))).otherwise(F.col("_q")[0]).alias("_low"),
        F.when(small, F.lit(float("inf"))).otherwise(F.col("_q")[1]).alias("_high"),
    )
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    placed = ordering.salted_join(counted, bracket.join(sizes, list(keys)), list(keys), spread=[value])
    below = placed.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col(value) < F.col("_low"), F.col("_c"))), F.lit(0)).alias("_below")
    )
    inside = placed.where((F.col(value) >= F.col("_low")) & (F.col(value) <= F.col("_high")))
    order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_cum", F.sum("_c").over(order)).join(below, list(keys))
    last = F.col("_below") + F.col("_cum") - 1
    first = last - F.col("_c") + 1
    at = [F.floor("_pos"), F.ceil("_pos")]
    picked = ranked.groupBy(*keys).agg(
        F.max(F.when((first <= at[0]) & (at[0] <= last), F.col(value))).alias("_a"),
        F.max(F.when((first <= at[1]) & (at[1] <= last), F.col(value))).alias("_b"),
        F.first(F.col("_pos") - F.floor("_pos")).alias("_f"),
    )
    # A bracket that missed its rank would leave a gap: that must not pass as a NULL.
    missed = F.raise_error(F.lit("the quantile lies outside its bracket")).cast("double")
    exact = F.coalesce(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f"), missed)
    return picked.select(*keys, exact.alias("median" if share == 0.5 else "quantile"))


def median_outputs(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """Exact median per key and class: `keys, class, median`."""
    return exact_quantile(long_outputs(df, keys, vec), [*keys, "class"], "p")


def votes(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """`keys, pred, n, share`: how many windows have each class as their greatest."""
    counted = df.select(*keys, V.argmax(F.col(vec)).alias("pred")).groupBy(*keys, "pred").agg(F.count(F.lit(1)).alias("n"))
    # After counting, a key holds at most one row per class.
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def majority_vote(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """The class most windows vote for; the smallest class wins a tie."""
    ballot = F.struct(F.col("n"), -F.col("pred"))
    return votes(df, keys, vec).groupBy(*keys).agg(F.max_by("pred", ballot).alias("pred"))


def mixed_labels(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one label."""
    spread = df.groupBy(key).agg(F.min(label).alias("first_label"), F.max(label).alias("last_label"))
    return spread.where(F.col("first_label") != F.col("last_label"))


def pick_label(df: DataFrame, key: str, label: str) -> DataFrame:
    """The label of each key; fails on a key with more than one."""
    spread = df.groupBy(key).agg(F.min(label).alias("_a"), F.max(label).alias("_b"))
    message = F.concat(F.lit("more than one label for "), F.col(key).cast("string"))
    return spread.select(key, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.raise_error(message)).alias(label))


def top_classes(df: DataFrame, keys: Sequence[str], vec: str, k: int = 2) -> DataFrame:
    """Greatest class and the k greatest probabilities of each vector, all inside the row."""
    return df.select(*keys, V.argmax(F.col(vec)).alias("pred"), V.top_k(F.col(vec), k).alias("maxprob"))


def aggregate_chunks(
    df: DataFrame,
    key: str,
    vec: str,
    label: str,
    length: str,
    weighted: bool = False,
    softmax: bool = False,
    both_strands: bool = False,
) -> DataFrame:
    """Windows to sequences in one grouping: mean and variance vector, prediction, votes, label and length.

    Lengths are halved when the windows of both strands were used.
    """
    rows = df.withColumn(vec, V.softmax(F.col(vec))) if softmax else df
    rows = rows.withColumn("_v", array_to_vector(F.col(vec)))
    mean = Summarizer.mean(F.col("_v"), F.col(length).cast("double")) if weighted else Summarizer.mean(F.col("_v"))
    # Per key and voted class first: at most one row per class is left for the second grouping.
    grouped = rows.groupBy(key).agg(
        vector_to_array(mean).alias("mean"),
        vector_to_array(Summarizer.variance(F.col("_v"))).alias("_var"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.min(label).alias("label"),
        F.sum(length).alias("length"),
    )
    shrink = (F.col("n_chunks") - 1) / F.col("n_chunks")
    ballots = majority_vote(rows.select(key, vec), [key], vec).withColumnRenamed("pred", "vote")
    return grouped.join(ballots, key).select(
        key,
        "mean",
        V.bind(shrink, lambda s: F.transform("_var", lambda x: x * s)).alias("variance"),
        V.argmax(F.col("mean")).alias("pred"),
        "vote",
        "label",
        "n_chunks",
        ((F.col("length") / 2) if both_strands else F.col("length")).cast("bigint").alias("length"),
    )


def aggregate_seqs(df: DataFrame, label: str, vec: str, length: str) -> DataFrame:
    """Length-weighted mean vector and total length per label."""
    rows = df.withColumn("_v", array_to_vector(F.col(vec)))
    mean = Summarizer.mean(F.col("_v"), F.col(length).cast("double"))
    return rows.groupBy(label).agg(vector_to_array(mean).alias(vec), F.sum(length).cast("bigint").alias("length"))
