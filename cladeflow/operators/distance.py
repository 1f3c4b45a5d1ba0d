"""Vector distances, distance tables and comparisons between them.

A distance table is long: `a, b, d` with `a < b`. Work on an existing table is linear in its rows. Work on all pairs of
vectors is cut into blocks: each unordered pair of blocks meets in one task, where a matrix product replaces a row-by-row
join, and what leaves the task is the reduced answer (a profile), not the pairs. Nearest neighbours, for which most pairs
need not be looked at, are in `neighbours`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cladeflow.functions import vectors as V
from cladeflow.operators import ordering
from cladeflow.session import cut_lineage, settle

METRICS = ("euclidean", "sqeuclidean", "cosine", "hyperbolic")
BLOCK_ROWS, STRIP_ROWS = 4096, 256
#: Of profiles, which hold no matrix of a pair of blocks: numbers in the vectors of a block, and distances in a strip.
BLOCK_NUMBERS, STRIP_CELLS = 1 << 20, 1 << 20


def n_blocks(df: DataFrame, block_rows: int = BLOCK_ROWS, pairs_for_core: int = 1) -> int:
    """Blocks of at most about `block_rows` vectors, and enough block pairs to keep every core busy."""
    rows = df.count()
    for_cores = math.ceil(math.sqrt(pairs_for_core * df.sparkSession.sparkContext.defaultParallelism))
    return max(1, math.ceil(rows / block_rows), min(math.ceil(rows / 256), for_cores))


def profile_blocks(df: DataFrame, vec: str) -> int:
    """Blocks for profiles: larger ones of short vectors, each of which is copied to as many tasks as there are blocks."""
    width = df.agg(F.max(F.size(vec)).alias("w")).first()["w"] or 1
    return n_blocks(df, min(4 * BLOCK_ROWS, max(BLOCK_ROWS, BLOCK_NUMBERS // max(1, width))), 8)


def between_vectors(metric: str):
    """The function from two matrices to the distances between their rows. Self-contained, so that workers need numpy only."""
    if metric not in METRICS:
        raise ValueError(f"metric {metric} is not one of {METRICS}")

    def between(x, y):
        import numpy as np

        if metric in ("euclidean", "sqeuclidean"):
            d = np.empty((len(x), len(y)))
            for i in range(len(x)):  # differences first: no cancellation for near copies
                diff = y - x[i]
                d[i] = np.einsum("ij,ij->i", diff, diff)
            return np.sqrt(d) if metric == "euclidean" else d
        product = x @ y.T
        if metric == "cosine":
            norms = np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
            return 1.0 - np.divide(product, norms, out=np.zeros_like(product), where=norms > 0)  # 1 from a zero vector
        lift = np.sqrt(1.0 + np.einsum("ij,ij->i", x, x))
        arg = np.outer(lift, np.sqrt(1.0 + np.einsum("ij,ij->i", y, y))) - product
        return np.arccosh(np.where(arg - 1.0 < 1e-6, 1.0, arg))

    return between


def between_strips(metrics: Sequence[str]):
    """Like `between_vectors`, for sums over many distances: a list with a matrix for each metric, from one matrix product.

    Where a euclidean distance is short beside the vectors, differences are taken first after all, so no distance has an error
    beyond about 1e-12 of itself. The nearest of a row is looked up so and then measured by differences.
    """
    metrics = list(metrics)
    if set(metrics) - set(METRICS):
        raise ValueError(f"metrics {metrics} are not all of {METRICS}")

    def squares(x, y, product):
        import numpy as np

        lengths = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)
        d = lengths - 2.0 * product
        lengths *= 0.01
        rows, cols = np.nonzero(~(d > lengths))  # NaN as well
        for i in range(0, len(rows), 65_536):
            r, c = rows[i : i + 65_536], cols[i : i + 65_536]
            diff = y[c] - x[r]
            d[r, c] = np.einsum("ij,ij->i", diff, diff)
        return d

    def between(x, y):
        import numpy as np

        with np.errstate(invalid="ignore", over="ignore"):
            product, found = x @ y.T, {}
            if "euclidean" in metrics or "sqeuclidean" in metrics:
                found["sqeuclidean"] = squares(x, y, product)
                found["euclidean"] = np.sqrt(found["sqeuclidean"]) if "euclidean" in metrics else None
            if "cosine" in metrics:
                norms = np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
                found["cosine"] = 1.0 - np.divide(product, norms, out=np.zeros_like(product), where=norms > 0)  # 1 from a zero vector
            if "hyperbolic" in metrics:
                lift = np.sqrt(1.0 + np.einsum("ij,ij->i", x, x))
                arg = np.outer(lift, np.sqrt(1.0 + np.einsum("ij,ij->i", y, y))) - product
                # The definition of arccosh, with a logarithm that works on several numbers at a time.
                found["hyperbolic"] = np.where(arg - 1.0 < 1e-6, 0.0, np.log(arg + np.sqrt((arg - 1.0) * (arg + 1.0))))
        return [found[m] for m in metrics]

    return between


def matrix_of():
    """The function from an Arrow column of vectors to a matrix, self-contained as well."""

    def matrix(column):
        import numpy as np

        column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))

    return matrix


def _block_pairs(df: DataFrame, key: str, vec: str, blocks: int):
    """Each unordered pair of blocks once: a vector is copied to the pairs of its block; NULL vectors are left out."""

    def side(own: str, other: str, others):
        rows = df.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v"))
        rows = rows.where(F.col("v").isNotNull()).withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        return rows.withColumn(other, F.explode(others)).groupBy("bi", "bj")

    return side("bi", "bj", F.sequence("bi", F.lit(blocks - 1))), side("bj", "bi", F.sequence(F.lit(0), "bj"))


def _block_function(metric: str | Sequence[str], reduce: str, names: Sequence[str]):
    """The task over one pair of blocks. Self-contained, so that workers need nothing but numpy and arrow."""
    metrics = [metric] if isinstance(metric, str) else list(metric)
    between, matrix, strip, cells = between_strips(metrics) if reduce == "profile" else between_vectors(metric), matrix_of(), STRIP_ROWS, STRIP_CELLS
    named = not isinstance(metric, str)

    def measured(name, low, x, y):
        """The least distances, of rows to rows: euclidean ones by differences, so that equal vectors are equally far."""
        import numpy as np

        if name not in ("euclidean", "sqeuclidean"):
            return low
        diff = y - x
        d = np.einsum("ij,ij->i", diff, diff)
        return np.sqrt(d) if name == "euclidean" else d

    def rows_of(d, own):
        """Per row: number, sum, least distance and where it is (the first of the least), greatest distance, all but `own`."""
        import numpy as np

        low, high, n = d, d, np.full(len(d), d.shape[1])
        if own is not None:
            low, high, n = np.where(own, np.inf, d), np.where(own, -np.inf, d), n - own.sum(axis=1)
        at = low.argmin(axis=1)
        total = d.sum(axis=1) if own is None else np.where(own, 0.0, d).sum(axis=1)
        return n, total, low[np.arange(len(d)), at], at, high.max(axis=1)

    def columns_added(sums, d, start):
        """The same per column, added to that of the rows before `start`."""
        import numpy as np

        n, total, least, at, greatest = sums
        low = d.min(axis=0)
        # NaN is the least of all, as it is for argmin.
        later = np.flatnonzero((low < least) | (np.isnan(low) & ~np.isnan(least)))
        at[later] = start + d[:, later].argmin(axis=0)
        least[later] = low[later]
        n += len(d)
        total += d.sum(axis=0)
        np.maximum(greatest, d.max(axis=0), out=greatest)

    def summed(name, ids, n, total, least, nearest, greatest):
        import pyarrow as pa

        keep = n > 0
        values = {x: pa.array(v[keep]) for x, v in zip(names[named:], (ids, n, total, least, nearest, greatest))}
        return pa.table(({names[0]: pa.array([name] * int(keep.sum()), pa.string())} if named else {}) | values)

    def task(key, left, right):
        import numpy as np
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            return pa.table({name: [] for name in names})
        a = left.column("id").to_numpy(zero_copy_only=False)
        b = right.column("id").to_numpy(zero_copy_only=False)
        x, y = matrix(left.column("v")), matrix(right.column("v"))
        one_block = key[0].as_py() == key[1].as_py()
        if reduce == "profile":
            # Distances are summed up a few rows of the block at a time: of both blocks only sums stay.
            tables, m, step = [], len(b), min(strip, max(16, cells // len(b)))
            others = [(np.zeros(m, np.int64), np.zeros(m), np.full(m, np.inf), np.zeros(m, np.int64), np.full(m, -np.inf)) for _ in metrics]
            for start in range(0, len(a), step):
                ids, some = a[start : start + step], x[start : start + step]
                found = between(some, y)
                # Equal ids are in one block.
                own = ids[:, None] == b[None, :] if one_block else None
                for i, d in enumerate(found if isinstance(found, list) else [found]):
                    n, total, least, at, greatest = rows_of(d, own)
                    tables.append(summed(metrics[i], ids, n, total, measured(metrics[i], least, some, y[at]), b[at], greatest))
                    if not one_block:
                        columns_added(others[i], d, start)
            for name, (n, total, least, at, greatest) in zip(metrics, () if one_block else others):
                tables.append(summed(name, b, n, total, measured(name, least, y, x[at]), a[at], greatest))
            return pa.concat_tables(tables)
        d = between(x, y)
        rows, cols = np.nonzero(a[:, None] < b[None, :]) if one_block else np.nonzero(a[:, None] != b[None, :])
        x, y = a[rows], b[cols]
        turned = x > y
        return pa.table(dict(zip(names, (pa.array(np.where(turned, y, x)), pa.array(np.where(turned, x, y)), pa.array(d[rows, cols])))))

    return task


def _over_blocks(df, key, vec, metric, reduce, columns, blocks):
    a, b = _block_pairs(df, key, vec, blocks)
    id_type = dict(df.dtypes)[key]
    schema = ", ".join(f"{n} {id_type if t == 'id' else t}" for n, t in columns)
    return a.cogroup(b).applyInArrow(_block_function(metric, reduce, [n for n, _ in columns]), schema)


def distance_profile(df: DataFrame, key: str, vec: str, metric: str | Sequence[str] = "euclidean", blocks: int | None = None) -> DataFrame:
    """Distances from every vector to all others, summarised: `key, n, mean_d, min_d, nearest, max_d`.

    Of several metrics, each has its rows under its name in a first column `metric`; vectors meet once for all of them.
    """
    columns = [("id", "id"), ("n", "bigint"), ("total", "double"), ("min_d", "double"), ("nearest", "id"), ("max_d", "double")]
    named = [] if isinstance(metric, str) else ["metric"]
    parts = _over_blocks(df, key, vec, metric, "profile", [(name, "string") for name in named] + columns, blocks or profile_blocks(df, vec))
    return parts.groupBy(*named, F.col("id").alias(key)).agg(
        F.sum("n").alias("n"),
        (F.sum("total") / F.sum("n")).alias("mean_d"),
        F.min("min_d").alias("min_d"),
        F.min_by("nearest", F.struct("min_d", "nearest")).alias("nearest"),
        F.max("max_d").alias("max_d"),
    )


def rank_neighbours(edges: DataFrame, node: str, k: int) -> DataFrame:
    """The k rows of least `d` per node, by neighbour on ties, with their `rank`."""
    from pyspark.sql import Window

    order = Window.partitionBy(node).orderBy("d", "neighbour")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pairwise(df: DataFrame, key: str, vec: str, metric: str = "euclidean", blocks: int | None = None) -> DataFrame:
    """The condensed distance table `a, b, d` with `a < b`: n·(n−1)/2 rows by definition.

    Use `distance_profile`, `nearest` or `distances_of` where the whole table is not the wanted result.
    """
    columns = [("a", "id"), ("b", "id"), ("d", "double")]
    return _over_blocks(df, key, vec, metric, "pairs", columns, blocks or n_blocks(df))


def whiten(df: DataFrame, vec: str) -> DataFrame:
    """Vectors in which euclidean distance is the Mahalanobis distance of the originals.

    Tasks sum products of components; one d×d matrix, bounded by the width of the vectors, reaches the driver. NULL vectors
    stay NULL. The vectors are multiplied a batch at a time, once: they are settled.
    """
    import numpy as np

    def partial(batches):
        import numpy as np
        import pyarrow as pa

        n, total, outer = 0, 0.0, 0.0
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, -1)
            n, total, outer = n + len(x), total + x.sum(axis=0), outer + x.T @ x
        if n:
            yield pa.RecordBatch.from_pydict(
                {"n": [n], "s": pa.array([total.tolist()]), "o": pa.array([outer.ravel().tolist()])}
            )

    parts = df.select(F.col(vec).cast("array<double>")).where(F.col(vec).isNotNull()).mapInArrow(partial, "n bigint, s array<double>, o array<double>")
    sums = parts.select("n", F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    outers = parts.select(F.posexplode("o").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    first = sums.orderBy("i").toPandas()
    n, mean = int(first["n"][0]), first["x"].to_numpy() / first["n"].to_numpy()
    outer = outers.orderBy("i").toPandas()["x"].to_numpy().reshape(len(mean), -1)
    inverse = np.linalg.inv((outer - n * np.outer(mean, mean)) / (n - 1))
    basis = np.linalg.cholesky(inverse).T
    place, matrix = df.columns.index(vec), matrix_of()

    def whitened(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            given = batch.column(place)
            x = matrix(given.drop_null()) @ basis.T
            lengths = np.where(given.is_valid().to_numpy(zero_copy_only=False), len(basis), 0)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, lengths.cumsum()), pa.int32()), pa.array(x.ravel()), mask=given.is_null())
            yield pa.RecordBatch.from_arrays([lists if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    given = df.withColumn(vec, F.col(vec).cast("array<double>"))
    return settle(given.mapInArrow(whitened, given.schema), "whitened")


def distances_of(pairs: DataFrame, vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """Adds the vectors `va, vb` of both ends of given pairs."""
    for end in ("a", "b"):
        side = vectors.select(F.col(key).alias(end), V.as_doubles(F.col(vec)).alias(f"v{end}"))
        pairs = pairs.join(side, end)
    return pairs


# -- distance tables ---------------------------------------------------------------------------------------------


def lookup_distances(pairs: DataFrame, d: DataFrame) -> DataFrame:
    """Adds `d` to given pairs in either order; equal ends are at 0."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    asked = pairs.withColumn("_a", low).withColumn("_b", high)
    table = d.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("d").alias("_d"))
    found = asked.join(table, ["_a", "_b"], "left")
    return found.withColumn("d", F.when(F.col("a") == F.col("b"), F.lit(0.0)).otherwise(F.col("_d"))).drop("_a", "_b", "_d")


def expand_distances(pairs: DataFrame, members: DataFrame, d: DataFrame) -> DataFrame:
    """Distances of given pairs of members, each at its representative: same-representative pairs are at 0.

    Only the asked pairs are expanded; `members` is `accession, rep`, `d` holds the representatives.
    """
    for end in ("a", "b"):
        side = members.select(F.col("accession").alias(end), F.col("rep").alias(f"_rep_{end}"))
        pairs = pairs.join(side, end)
    reps = pairs.select(F.col("a").alias("_ma"), F.col("b").alias("_mb"), F.col("_rep_a").alias("a"), F.col("_rep_b").alias("b"))
    return lookup_distances(reps, d).select(F.col("_ma").alias("a"), F.col("_mb").alias("b"), "d")


def collapse_distances(d: DataFrame, meta: DataFrame, key: str, rank: str, linkage: str = "average") -> DataFrame:
    """Distance table of the taxa at a rank, from the pairs whose ends lie in different taxa."""
    link = {"average": F.avg, "complete": F.max, "single": F.min}[linkage]
    for end in ("a", "b"):
        d = d.join(meta.select(F.col(key).alias(end), F.col(rank).alias(f"_{end}")), end)
    across = d.where(F.col("_a") != F.col("_b"))
    return across.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(link("d").alias("d"))


def subset_distances(d: DataFrame, taxa: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Pairs among n sampled taxa."""
    from cladeflow.operators import filters

    return filters.trim_distances(d, ordering.sample_rows(taxa.select(key), key, n, seed), key)


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the rank of `value` over the table; equal values share their mean rank.

    Ranks are settled on distinct values and given back by value, in salted copies for values held by many rows.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordering.prefix(counts, [], ordering.sketch_buckets(counts, [], [F.col(value)]), [F.col(value)], sums={"_cum": F.col("_n")})
    ranked = ranked.select(value, (F.col("_cum") - (F.col("_n") - 1) / 2).alias(out), F.col("_n").alias("_rows"))
    return ordering.salted_join(df, ranked, [value], spread=[c for c in df.columns if c != value])


def distance_correlation(d1: DataFrame, d2: DataFrame) -> DataFrame:
    """`n, pearson, spearman` over the pairs that both tables hold."""
    both = d1.select("a", "b", F.col("d").alias("x")).join(d2.select("a", "b", F.col("d").alias("y")), ["a", "b"])
    # Ranking reads its input several times: settle the joined pairs first.
    both = cut_lineage(both)
    ranked = average_ranks(average_ranks(both, "x", "_rx"), "y", "_ry")
    return ranked.agg(
        F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson"), F.corr("_rx", "_ry").alias("spearman")
    )


def distance_error(d: DataFrame, vectors: DataFrame, key: str, vec: str, mode: str = "mae", factor: float = 2.0, metric: str = "sqeuclidean") -> DataFrame:
    """Mean error between vector distances and the target distances of a table: `n, error`.

    `mae` compares distances; `similarity` and `relative` compare 1/(1+d/factor), the latter divided by the target;
    `hinge` counts excess only, against targets divided by their maximum.
    """
    rows = distances_of(d.select("a", "b", F.col("d").alias("target")), vectors, key, vec)
    measure = {
        "sqeuclidean": V.squared_distance,
        "euclidean": lambda x, y: F.sqrt(V.squared_distance(x, y)),
        "hyperbolic": V.hyperbolic_distance,
    }[metric]
    rows = rows.withColumn("_d", measure(F.col("va"), F.col("vb")))
    if mode == "mae":
        error = F.abs(F.col("_d") - F.col("target"))
    elif mode in ("similarity", "relative"):
        target = V.similarity(F.col("target"), factor)
        error = F.abs(V.similarity(F.col("_d"), factor) - target)
        error = error / target if mode == "relative" else error
    elif mode == "hinge":
        error = F.greatest(F.col("_d") - F.col("target") / d.agg(F.max("d")).scalar(), F.lit(0.0))
    else:
        raise ValueError(f"unknown mode {mode}")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("error"))


def fuzzy_cross_entropy(edges: DataFrame, vectors: DataFrame, key: str, vec: str, a: float, b: float) -> DataFrame:
    """Mean cross-entropy between edge weights `p` and low-dimensional probabilities, both kept off 0 and 1: `n, loss`."""
    rows = distances_of(edges, vectors, key, vec)
    q = V.low_dim_probability(F.sqrt(V.squared_distance(F.col("va"), F.col("vb"))), a, b)

    def clamp(x):
        return F.greatest(F.least(x, F.lit(1 - 1e-4)), F.lit(1e-4))

    rows = rows.select(clamp(F.col("p")).alias("p"), clamp(q).alias("q"))
    p, q = F.col("p"), F.col("q")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q))).alias("loss"))


def knn_vote(neighbours: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Label most neighbours carry, the smallest label on ties: `id, pred`."""
    named = neighbours.join(labels.select(F.col(key).alias("neighbour"), F.col(label).alias("_label")), "neighbour")
    counts = named.groupBy("id", "_label").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("id").agg(F.min_by("_label", F.struct(-F.col("_n"), "_label")).alias("pred"))
