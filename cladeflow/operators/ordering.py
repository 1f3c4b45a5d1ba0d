"""Ordered operators that never need a whole key in one task.

Running values are built from buckets. A bucket is a monotone function of the sort order (a block of ids, the leading
characters of a hash, or where these say nothing of the rows a range between sampled splitters), so that each (key, bucket) can be ordered by itself while the totals of the earlier
buckets are added from a table of bucket totals. A hot key is spread over its buckets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cladeflow.session import spread

BLOCK_BITS = 16
HOT_ROWS = 2_000_000
SALTS = 64


def id_buckets(col: str | Column, bits: int = BLOCK_BITS) -> list[Column]:
    """Two levels of blocks of ascending integer ids: at most 2**bits distinct ids in each fine block."""
    value = F.col(col) if isinstance(col, str) else col
    return [F.shiftright(value, 2 * bits), F.shiftright(value, bits)]


def hash_buckets(digest: Column) -> list[Column]:
    """Two levels by the leading characters of a hexadecimal digest: 256, then 65,536 even buckets."""
    return [F.substring(digest, 1, 2), F.substring(digest, 1, 4)]


#: Rows that a bucket should hold, the most buckets, and how many rows of the sample stand for a bucket.
BUCKET_ROWS, MOST_BUCKETS, SAMPLES = 1_000_000, 1 << 12, 32


def sketch_buckets(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket_rows: int | None = None) -> list[Column]:
    """One level of buckets with about `bucket_rows` rows each, whatever the values: splitters of the order `(keys, order)`.

    The splitters are quantiles of the rows with the least hashes of `(keys, order)`: a uniform sample of bounded size that
    every task cuts for itself before samples are merged, and whose greatest hash tells how many rows there are. At most
    `MOST_BUCKETS` splitters reach the driver, and a row finds its bucket in two steps of at most 64 comparisons. `order` are
    plain ascending columns; NULL is smallest. Rows that tie in all of them share a bucket.
    """
    bucket_rows = bucket_rows or BUCKET_ROWS
    place = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[c.alias(f"o{i}") for i, c in enumerate(order)])
    size = MOST_BUCKETS * SAMPLES
    sample = df.select(place.alias("p"), F.xxhash64(place).alias("h")).orderBy("h").limit(size)
    found = sample.agg(F.sort_array(F.collect_list("p")).alias("p"), F.max("h").alias("h"), F.count(F.lit(1)).alias("n"))
    # With fewer rows than the sample may hold all rows are in it; else the share of the hash range that it fills tells.
    filled = (F.col("h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    rows = F.when(F.col("n") < size, F.col("n")).otherwise(F.col("n") / filled)
    wanted = F.least(F.greatest(F.ceil(rows / bucket_rows), F.lit(1)), F.lit(MOST_BUCKETS), F.greatest(F.floor(F.col("n") / SAMPLES), F.lit(1)))
    at = F.transform(F.sequence(F.lit(1), F.col("w")), lambda i: F.element_at("p", F.least(F.floor(i * F.col("n") / F.col("w")) + 1, F.col("n")).cast("int")))
    splitters = found.where("n > 0").select("p", "n", wanted.cast("int").alias("w")).select(at.alias("p")).first()
    values = splitters["p"][:-1] if splitters else []
    if not values:
        return [F.lit(0)]
    kinds = [f.dataType for f in df.select(place.alias("p")).schema["p"].dataType]
    literal = [F.struct(*[F.lit(x).cast(kind).alias(name) for x, kind, name in zip(v, kinds, v.__fields__)]) for v in values]
    step = math.isqrt(len(literal)) + 1
    first = F.array(*literal[step - 1 :: step])
    groups = F.array(*[F.array(*literal[g : g + step - 1]) for g in range(0, len(literal) + 1, step) if literal[g : g + step - 1]], F.array(literal[-1]))

    def before(values: Column) -> Column:
        return F.size(F.filter(values, lambda x: x <= place))

    coarse = before(first)
    inside = F.when(coarse * step < len(literal), before(F.element_at(groups, coarse + 1))).otherwise(0)
    return [coarse * step + inside]


def order_digest(seed: int, *cols: str | Column) -> Column:
    """Repeatable random order: the digest of the seed and the key columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


# The rounds of a permutation, the prime that folds numbers, and odd multipliers below 2^31.
ROUNDS, PRIME, MULTIPLIERS = 32, 2_147_483_647, (1_103_515_245, 1_540_483_477, 1_566_083_941)


def permutation_keys(seed: int, *cols: str | Column) -> tuple[Column, Column]:
    """Two numbers below 2^31 that name a permutation: the halves of a digest of the seed and the columns."""
    digest = order_digest(seed, *cols)
    return tuple(F.conv(F.substring(digest, at, 7), 16, 10).cast("bigint") for at in (1, 9))


def permutation_rounds(n: Column, keys: tuple[Column, Column]) -> Column:
    """What the rounds of a permutation of 0 … n - 1 need beside the number itself, in an array."""
    a, b, c = MULTIPLIERS
    first, second = keys

    def drawn(r: Column) -> Column:
        k = F.pmod((first + r * second) % PRIME * a % PRIME * (PRIME + 2) + (second + r * first) % PRIME * b % PRIME, n.cast("bigint"))
        return F.struct(k.alias("k"), ((first + r * c) % PRIME).alias("m"))

    return F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: drawn(r.cast("bigint")))


def permuted(i: Column, n: Column, keys: tuple[Column, Column] | Column) -> Column:
    """The place of `i` in a permutation of 0 … n - 1: a formula, with no table of the others.

    In each round a number x pairs with (k - x) mod n, for a k of that round, and both change places or do not, as a bit
    drawn from the greater of them says. That maps [0, n) onto itself for any n. `keys` name the permutation; where many
    numbers share one, a column of its `permutation_rounds` takes their place and is worked out once.
    """
    a, b, _ = MULTIPLIERS
    n = n.cast("bigint")
    rounds = permutation_rounds(n, keys) if isinstance(keys, tuple) else keys

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(r["k"] - x, n)
        mixed = (F.greatest(x, other) % PRIME).bitwiseXOR(r["m"]) * a % (PRIME + 1)
        drawn = mixed.bitwiseXOR(F.shiftright(mixed, 13)) * b % (PRIME + 1)
        return F.when(F.shiftright(drawn, 16).bitwiseAND(F.lit(1).cast("bigint")) == 1, other).otherwise(x)

    return F.when(n > 0, F.aggregate(rounds, i.cast("bigint"), step))


def hot_keys(counts: DataFrame, keys: Sequence[str], rows: str = "_rows", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `hot_rows` rows out of a table of row counts.

    There are fewer of them than all rows divided by `hot_rows`, which bounds what is broadcast.
    """
    return counts.where(F.col(rows) > hot_rows).select(*keys)


def split_hot(df: DataFrame, keys: Sequence[str], counts: DataFrame, rows: str = "_rows", hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows of the other keys, rows of the hot keys). A group of the first fits a task; one of the second may not."""
    hot = F.broadcast(hot_keys(counts, keys, rows, hot_rows))
    return df.join(hot, list(keys), "left_anti"), df.join(hot, list(keys), "left_semi")


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[str], rows: str = "_rows", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join of rows to a table with one row per key and its row count `rows`.

    The rows of a hot key are dealt over `SALTS` tasks by a hash of the `spread` columns, and only the rows of the right
    side that belong to hot keys are copied. The count is dropped.
    """
    hot = F.broadcast(hot_keys(right, keys, rows, hot_rows).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(0).cast("int")
    salted = left.join(hot, list(keys), "left").withColumn("_salt", salt).drop("_hot")
    last = F.when(F.col(rows) > hot_rows, SALTS - 1).otherwise(0)
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop(rows)
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def same_keys_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys of which NULL equals NULL."""
    right = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    met = [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys]
    return (left.join(right, met) if met else left.crossJoin(right)).drop(*[f"_same_{k}" for k in keys])


def _carry(totals: DataFrame, keys: list[str], levels: list[str], sums: list[str], lasts: list[str]) -> DataFrame:
    """Per bucket, what all earlier buckets of the same key add up to."""
    inner_keys, at = keys + levels[:-1], levels[-1]
    earlier = Window.partitionBy(*inner_keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        *levels,
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sums],
        *[F.last(c, ignorenulls=True).over(earlier).alias(c) for c in lasts],
    )
    if len(levels) == 1:
        return carried
    coarse = totals.groupBy(*inner_keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in lasts],
    )
    above = _carry(coarse, keys, levels[:-1], sums, lasts)
    renamed = above.select(*inner_keys, *[F.col(c).alias(f"_up{c}") for c in sums + lasts])
    return same_keys_join(carried, renamed, inner_keys).select(
        *keys,
        *levels,
        *[(F.col(c) + F.col(f"_up{c}")).alias(c) for c in sums],
        *[F.coalesce(c, f"_up{c}").alias(c) for c in lasts],
    )


def with_buckets(df: DataFrame, buckets: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """Bucket columns made once, for several running values over the same order: they then share one shuffle."""
    levels = [f"_bucket{i}" for i in range(len(buckets))]
    for name, bucket in zip(levels, buckets):
        df = df.withColumn(name, bucket)
    return df, levels


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    buckets: Sequence[Column],
    order: Sequence[Column],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Running sums and last non-NULL values per key in the order `(buckets, order)`.

    `inclusive=False` leaves the current row out, which turns a running last value into a lag. Bucket columns must be
    monotone in `order`, NULL where it is and so first. NULL keys are one key.
    """
    rows, levels = with_buckets(df, buckets)
    return prefix_over(rows, keys, levels, order, sums, lasts, inclusive).drop(*levels)


def prefix_over(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """`prefix` over bucket columns that `with_buckets` has made; they stay in the result."""
    sums, lasts, levels = dict(sums or {}), dict(lasts or {}), list(levels)
    place = [*keys, *levels]
    # Running last values need plain ascending columns: a struct of them finds the last row of a bucket.
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]) if lasts else None
    totals = df.groupBy(*place).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_c{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_c{n}") for n, c in lasts.items()],
    )
    carry = _carry(totals, list(keys), levels, [f"_c{n}" for n in sums], [f"_c{n}" for n in lasts])
    local = Window.partitionBy(*place).orderBy(*order)
    local = local.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    running = df.select(
        "*",
        *[F.coalesce(F.sum(c).over(local), F.lit(0)).alias(f"_l{n}") for n, c in sums.items()],
        *[F.last(c, ignorenulls=True).over(local).alias(f"_l{n}") for n, c in lasts.items()],
    )
    joined = same_keys_join(running, carry, place)
    return joined.select(
        *df.columns,
        *[(F.col(f"_l{n}") + F.col(f"_c{n}")).alias(n) for n in sums],
        *[F.coalesce(f"_l{n}", f"_c{n}").alias(n) for n in lasts],
    )


def global_rank(df: DataFrame, buckets: Sequence[Column], order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """1-based position in the given order, over the table or per key."""
    return prefix(df, keys, buckets, order, sums={"rank": F.lit(1)})


def cum_offsets(df: DataFrame, size: str, buckets: Sequence[Column], order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Exclusive end offset of every row, and its start."""
    out = prefix(df, keys, buckets, order, sums={"end_offset": F.col(size).cast("bigint")})
    return out.withColumn("start_offset", F.col("end_offset") - F.col(size))


def islands(df: DataFrame, value: str, order: Sequence[Column], buckets: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Number the runs of equal `value` in order, from 1; NULL equals NULL.

    Inside its bucket a row is compared with the one before it. The first row of a bucket is compared with the last one of
    the bucket before, in the table of buckets, which also carries the changes so far: rows are shuffled once.
    """
    rows, levels = with_buckets(df, buckets)
    keys, place = list(keys), [*keys, *levels]
    local = Window.partitionBy(*place).orderBy(*order)
    change = F.when(F.row_number().over(local) == 1, 0).when(F.lag(value).over(local).eqNullSafe(F.col(value)), 0).otherwise(1)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_change", change).withColumn("_inside", F.sum("_change").over(upto)).withColumn("_at", F.row_number().over(local))
    totals = rows.groupBy(*place).agg(
        F.sum("_change").alias("_changes"), F.min_by(F.struct(value), "_at").alias("_first"), F.max_by(F.struct(value), "_at").alias("_last")
    )
    before = Window.partitionBy(*keys).orderBy(*levels)
    border = F.when(F.lag("_last").over(before).eqNullSafe(F.col("_first")), 0).otherwise(1)
    totals = totals.withColumn("_border", border)
    sofar = F.sum(F.col("_changes") + F.col("_border")).over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_changes")
    carry = totals.select(*place, sofar.alias("_sofar"))
    joined = same_keys_join(rows, carry, place)
    return joined.select(*df.columns, (F.col("_sofar") + F.col("_inside")).alias("run"))


def running_mean(df: DataFrame, value: str, order: Sequence[Column], buckets: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Mean of everything up to and including the row."""
    out = prefix(df, keys, buckets, order, sums={"_sum": F.col(value), "_n": F.when(F.col(value).isNotNull(), 1)})
    return out.withColumn("running_mean", F.col("_sum") / F.col("_n")).drop("_sum", "_n")


def moving_mean(df: DataFrame, value: str, n: int, order: Sequence[Column], buckets: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the last n rows.

    Rows get their position per key; position blocks of a fixed size are windows of their own, and each block also
    receives the last n-1 rows of the block before it.
    """
    place = global_rank(df, buckets, order, keys).withColumnRenamed("rank", "_pos")
    size = max(1 << BLOCK_BITS, n)
    block = F.expr(f"cast((_pos - 1) div {size} as bigint)")
    # A row near the end of its block is needed again by the next one.
    needed = F.when((F.col("_pos") - 1) % size >= size - (n - 1), F.array(block, block + 1)).otherwise(F.array(block))
    spread = place.withColumn("_block", F.explode(needed))
    window = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(-(n - 1), 0)
    out = spread.withColumn("moving_mean", F.avg(value).over(window))
    return out.where(F.col("_block") == block).drop("_pos", "_block")


def abs_delta(df: DataFrame, value: str, order: Sequence[Column], buckets: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Absolute difference from the row before; NULL on the first row of a key."""
    lagged = prefix(df, keys, buckets, order, lasts={"_previous": F.col(value)}, inclusive=False)
    return lagged.withColumn("abs_delta", F.abs(F.col(value) - F.col("_previous"))).drop("_previous")


def even_split(df: DataFrame, n: int, buckets: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """Contiguous split into n parts, 0-based; the first `rows % n` parts hold one row more."""
    ranked = global_rank(df, buckets, order)
    rows = ranked.withColumn("_total", df.agg(F.count(F.lit(1))).scalar())
    small, extra = F.expr(f"_total div {n}"), F.col("_total") % n
    at = F.col("rank") - 1
    split = F.when(at < extra * (small + 1), F.floor(at / (small + 1))).otherwise(
        extra + F.floor((at - extra * (small + 1)) / F.greatest(small, F.lit(1)))
    )
    return rows.withColumn("part", split.cast("int")).drop("rank", "_total")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per key; every map task passes on at most n rows of a key."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rn") <= n).drop("_rn")


#: Up to so many partitions of an epoch are written into its plan.
PLANNED_PARTITIONS = 64


def epoch_order(df: DataFrame, index: str, n_partitions: int, seed: int, max_samples: int | None = None, shuffle: bool = True) -> DataFrame:
    """Sampling order without replacement: `part, position`.

    Partition p owns the rows with `index % n_partitions = p`; partitions are visited in random order and rows inside
    them in random order. `shuffle=False` gives the sequential order of the index. `position` is 0-based. Where the index
    runs from 0 without gaps, a position is a formula of the index and no row moves; else rows are numbered first.
    """
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("low"), F.max(index).alias("high"), F.count_distinct(index).alias("values")).first()
    rows = df.withColumn("part", F.pmod(F.col(index), F.lit(n_partitions)).cast("int"))
    if facts["n"] and (facts["low"], facts["high"], facts["values"]) == (0, facts["n"] - 1, facts["n"]):
        ordinal = F.expr(f"`{index}` div {n_partitions}")
        sizes = {p: (facts["n"] - p + n_partitions - 1) // n_partitions for p in range(n_partitions)}
    else:
        ordinal = None
        sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    # The partitions, of which there are few, are put in order here.
    visits = sorted(sizes, key=lambda p: (hashlib.md5(f"{seed}:{p}".encode()).hexdigest(), p) if shuffle else p)
    starts, upto = {}, 0
    for p in visits:
        starts[p], upto = upto, upto + sizes[p]
    if not visits:
        return rows.withColumn("position", F.lit(0).cast("bigint"))
    # What names and moves the rows of a partition is worked out once for it, not in every round of every row.
    owns = rows.sparkSession.createDataFrame([(p, starts[p], sizes[p]) for p in visits], "part int, _start long, _n long")
    owns = owns.withColumn("_rounds", permutation_rounds(F.col("_n"), permutation_keys(seed, "part")))
    columns = [*df.columns, "part"]
    if ordinal is None:
        rows = global_rank(rows, id_buckets(index), [F.col(index)], ["part"]).withColumn("_i", F.col("rank") - 1)
        rows = rows.join(F.broadcast(owns), "part")
    else:
        rows = spread(rows).withColumn("_i", ordinal.cast("bigint"))
        if n_partitions <= PLANNED_PARTITIONS:
            # What is known of a few partitions is a constant of the plan, an array by their numbers.
            known = owns.orderBy("part").select(F.to_json(F.struct("_start", "_n", "_rounds")).alias("j")).collect()
            kind = owns.select(F.array(F.struct("_start", "_n", "_rounds")).alias("a")).schema["a"].dataType
            constant = F.from_json(F.lit(f"[{','.join(r['j'] for r in known)}]"), kind)
            rows = rows.withColumns({c: F.get(constant, F.col("part"))[c] for c in ("_start", "_n", "_rounds")})
        else:
            rows = rows.join(F.broadcast(owns), "part")
    inside = permuted(F.col("_i"), F.col("_n"), F.col("_rounds")) if shuffle else F.col("_i")
    out = rows.select(*columns, (F.col("_start") + inside).alias("position"))
    return out if max_samples is None else out.where(F.col("position") < max_samples)


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Seeded sample of n rows; each task keeps its own n smallest digests before they are merged."""
    digest = order_digest(seed, key)
    return df.withColumn("_digest", digest).orderBy("_digest", key).limit(n).drop("_digest")


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Seeded sample of a share of the rows, decided row by row."""
    leading = F.conv(F.substring(order_digest(seed, key), 1, 8), 16, 10).cast("bigint")
    return df.where(leading < int(fraction * (1 << 32)))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Values by descending frequency, then by name."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(col))


def balanced_buckets(df: DataFrame, key: str, weight: str, n: int, mode: str = "serpentine") -> DataFrame:
    """Assign rows to n buckets of nearly equal weight: column `bucket`.

    `serpentine` deals the weight-descending rank back and forth over the buckets and depends on the rows alone.
    `local` gives each item, heaviest first, to the least loaded bucket inside its partition; no global order is needed.
    Partitions start at different buckets, so that many small ones fill all buckets alike.
    """
    if mode == "serpentine":
        w = F.col(weight).cast("bigint")
        # Many items of one weight are cut further, by blocks of ids or by the leading characters of a name.
        is_text = dict(df.dtypes)[key] == "string"
        block = F.substring(key, 1, 8) if is_text else F.shiftright(key, BLOCK_BITS)
        levels = [-F.floor(F.log2(w + 1) * 64), -w, block]
        ranked = global_rank(df, levels, [F.col(weight).desc(), F.col(key)])
        lap, at = F.floor((F.col("rank") - 1) / n), (F.col("rank") - 1) % n
        bucket = F.when(lap % 2 == 0, at).otherwise(n - 1 - at).cast("int")
        return ranked.withColumn("bucket", bucket).drop("rank")

    at = df.columns.index(weight)

    def deal(batches):
        import heapq

        import numpy as np
        import pyarrow as pa

        from pyspark import TaskContext

        first = TaskContext.get().partitionId() * 7919 % n
        loads = [(0.0, turn, (first + turn) % n) for turn in range(n)]
        for batch in batches:
            weights = batch.column(at).to_numpy(zero_copy_only=False).astype(float)
            picked = np.empty(len(weights), dtype=np.int32)
            for i in np.argsort(-weights, kind="stable"):
                load, turn, slot = heapq.heappop(loads)
                picked[i] = slot
                heapq.heappush(loads, (load + weights[i], turn, slot))
            columns = list(batch.columns) + [pa.array(picked)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "bucket"])

    from pyspark.sql.types import IntegerType, StructType

    schema = StructType([*df.schema.fields]).add("bucket", IntegerType())
    return df.sortWithinPartitions(F.col(weight).desc()).mapInArrow(deal, schema)


def balance_report(df: DataFrame, weight: str, n: int) -> DataFrame:
    """Load per bucket, and the ratio of the greatest load to the mean one in `max_over_mean`."""
    loads = df.groupBy("bucket").agg(F.sum(weight).cast("bigint").alias("load"), F.count(F.lit(1)).alias("n_items"))
    return loads.withColumn("max_over_mean", loads.agg(F.try_divide(F.max("load") * n, F.sum("load"))).scalar())
