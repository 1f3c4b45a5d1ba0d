"""Near-duplicate vectors: a neighbour graph by descent, exact link counts inside its groups, audited recall."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from cladeflow.llm.common import components, settle

THRESHOLD = 0.9
#: Neighbours kept for each vector at first, and for those whose list is saturated with links.
NEIGHBOURS, ENLARGED = 8, 32
#: Neighbours below this cosine have no direction in common and are not kept.
FLOOR = 0.0
#: Rounds of descent, and turns with twice as many tables each until the audit holds.
ROUNDS, TRIES = 4, 5
#: Vectors of a starting bucket, aimed at and at most; vectors of a block of the exact count, at most and in a middling group.
AIMED, MOST, BLOCK, SMALL = 512, 2_048, 2_048, 128
#: Share of list entries that must change for another round.
MOVING = 0.002
#: Vectors whose links are counted by brute force for the audit, at first and at most: more are taken until `SEEN` of them
#: have a true link. `RECALL` is the share of the links that must be found.
AUDITED, AUDITED_MOST, SEEN, RECALL = 512, 8_192, 32, 0.99


def planes_of(n: int) -> int:
    """Hyperplanes that cut n vectors into buckets of about `AIMED`."""
    return max(0, min(48, math.ceil(math.log2(max(1, n / AIMED)))))


def tables_of(n: int) -> int:
    """Tables by which two vectors at the threshold share a bucket of n vectors with probability `RECALL`."""
    together = (1 - math.acos(THRESHOLD) / math.pi) ** planes_of(n)
    return 1 if together >= RECALL else math.ceil(math.log1p(-RECALL) / math.log1p(-together))


def matrix(vectors, width: int | None = None) -> np.ndarray:
    """Unit rows in double precision, from an Arrow list column or a series of arrays; shorter vectors are filled up with zeros."""
    if isinstance(vectors, pa.Array):
        lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    else:
        rows = [np.asarray(v, dtype=np.float64) for v in vectors]
        lengths = np.array([len(v) for v in rows], dtype=np.int64)
        flat = np.concatenate(rows) if rows else np.array([])
    width = width or int(lengths.max(initial=0))
    if (lengths == width).all():
        out = flat.reshape(len(lengths), width)
    else:
        out = np.zeros((len(lengths), width))
        out[np.arange(width) < lengths[:, None]] = flat
    # An exact scaling by a power of two, so that squares neither overflow nor vanish.
    out = np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, keepdims=True, initial=0))[1])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def usable(column: str):
    """Whether a vector has a direction: not null or empty, all components finite, not all zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(column, lambda x: x != 0)


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k greatest entries of each row that reach the floor; the diagonal must be below it."""
    k = min(k, sims.shape[1] - 1)
    if k < 1:
        return np.array([], dtype=int), np.array([], dtype=int)
    columns = np.argpartition(sims, -k, axis=1)[:, -k:]
    rows = np.repeat(np.arange(len(sims)), k)
    columns = columns.ravel()
    good = sims[rows, columns] >= FLOOR
    return rows[good], columns[good]


def _spanning(linked: np.ndarray, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect each group of a link matrix: of every vector to one that was reached before it.

    With `groups`, members of one group count as connected, and only links between groups are given.
    """
    if groups is not None:
        linked = linked | (groups[:, None] == groups)
    n = len(linked)
    free, a, b = np.ones(n, bool), [], []
    for start in range(n):
        if not free[start]:
            continue
        free[start], front = False, np.array([start])
        while len(front):
            reached = linked[front] & free
            new = np.flatnonzero(reached.any(axis=0))
            a.append(new)
            b.append(front[reached[:, new].argmax(axis=0)])
            free[new] = False
            front = new
    if not a:
        return (np.array([], dtype=int),) * 2
    a, b = np.concatenate(a), np.concatenate(b)
    if groups is not None:
        apart = groups[a] != groups[b]
        a, b = a[apart], b[apart]
    return a, b


def _offers(ids: np.ndarray, sims: np.ndarray, k: int, groups: np.ndarray | None = None) -> list[np.ndarray]:
    """`u, v, s, span` of a matrix of cosines: the k nearest of every row, and links that span what is linked."""
    np.fill_diagonal(sims, -1.0)
    rows, columns = _best(sims, k)
    a, b = _spanning(sims >= THRESHOLD, groups)
    return [ids[np.r_[rows, a]], ids[np.r_[columns, b]], sims[np.r_[rows, a], np.r_[columns, b]], np.arange(len(rows) + len(a)) >= len(rows)]


def starting_graph(vectors: DataFrame, n: int, width: int, seed: int, tables: int) -> DataFrame:
    """`u, v, s, span`: neighbours within buckets of random hyperplane signs, and links that span each bucket's groups.

    Buckets with more than about `MOST` vectors are split at random, in another way for each of the tables; the parts of a
    bucket go to different tasks.
    """
    planes = planes_of(n)
    normals = np.random.default_rng(seed).standard_normal((tables, planes, width))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(planes, dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column("vec"), width)
            for t in range(tables):
                key = ((x @ normals[t].T) > 0) @ powers if planes else np.zeros(len(x), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(key.astype(np.int64)), batch.column("c"), batch.column("vec")],
                    names=["t", "key", "c", "vec"],
                )

    kind = vectors.schema["vec"].dataType.simpleString()
    signed = vectors.select("c", "vec").mapInArrow(sign, f"t int, key long, c long, vec {kind}")
    sizes = signed.groupBy("t", "key").count().where(F.col("count") > MOST)
    parts = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / MOST).cast("int")
    dealt = signed.join(settle(sizes, "crowded"), ["t", "key"], "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("c", F.col("t") + seed), parts)).drop("count")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        x, c = matrix(pdf["vec"], width), pdf["c"].to_numpy()
        # The random split leaves a part with a few more than `MOST`.
        cuts = np.array_split(np.arange(len(c)), math.ceil(len(c) / (1.25 * MOST)))
        found = [_offers(c[i], x[i] @ x[i].T, NEIGHBOURS) for i in cuts if len(i)]
        u, v, s, span = (np.concatenate(z) for z in zip(*found)) if found else ([], [], [], [])
        return pd.DataFrame({"u": u, "v": v, "s": s, "span": span})

    # The join leaves rows by bucket, which would satisfy the grouping: parts of one bucket would stay in one task.
    parted = dealt.select("t", "key", "part", "c", "vec").repartition("t", "key", "part")
    return parted.groupBy("t", "key", "part").applyInPandas(join, "u long, v long, s double, span boolean")


def top_lists(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct neighbours of each vector, after one shuffle by vector."""
    by = Window.partitionBy("u").orderBy(F.col("s").desc(), "v")
    distinct = edges.repartition("u").groupBy("u", "v").agg(F.max("s").alias("s"))
    return distinct.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= k).drop("_rank")


def local_join(lists: DataFrame, vectors: DataFrame, k: int, width: int, centres: DataFrame | None = None) -> DataFrame:
    """`u, v, s, span`: for each vector, its neighbours and the vectors it is a neighbour of meet, and offer each other.

    `vectors` has `c, vec, g`, the group that is known already: links that join groups of a meeting are offered as well,
    whether or not they are among the nearest.
    """
    reverse = Window.partitionBy("v").orderBy(F.col("s").desc(), "u")
    back = lists.withColumn("_rank", F.row_number().over(reverse)).where(F.col("_rank") <= k).select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = lists.select("u", "v").unionByName(back).unionByName(lists.select("u", F.col("u").alias("v"))).distinct()
    if centres is not None:
        around = around.join(centres, "u", "left_semi")
    meeting = around.join(vectors.select(F.col("c").alias("v"), "vec", "g"), "v").groupBy("u").agg(F.collect_list(F.struct("v", "vec", "g")).alias("met"))

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for met in batch.column("met"):
                members = met.values
                x = matrix(members.field("vec"), width)
                found.append(_offers(members.field("v").to_numpy(), x @ x.T, k, members.field("g").to_numpy()))
            if found:
                u, v, s, span = (np.concatenate(z) for z in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s), pa.array(span)], names=["u", "v", "s", "span"])

    return meeting.mapInArrow(offer, "u long, v long, s double, span boolean")


def descend(start: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """`u, v`: links that span the groups found from a starting graph, refined until few list entries change, then once more
    with longer lists.

    Lists are cut at their nearest entries, so links that join tight groups do not last in them. The starting graph's
    groups are therefore kept as an edge from each vector to its group's least, and a meeting offers every link between
    two of these groups. Edges are linear in the vectors; other links only serve the lists.
    """
    groups = settle(components(start.where("span"), "u", "v"), "begun")
    known = vectors.join(groups, F.col("c") == F.col("node"), "left").select("c", "vec", F.coalesce("component", "c").alias("g"))
    known = settle(known, "known")
    links = [groups.where("node != component").select(F.col("node").alias("u"), F.col("component").alias("v"))]
    lists = settle(top_lists(start.where("not span").select("u", "v", "s"), NEIGHBOURS), "lists")
    for _ in range(ROUNDS):
        offers = settle(local_join(lists, known, NEIGHBOURS, width).groupBy("u", "v", "span").agg(F.max("s").alias("s")), "offers")
        links.append(offers.where("span").select("u", "v"))
        new = settle(top_lists(lists.unionByName(offers.where("not span").select("u", "v", "s")), NEIGHBOURS), "lists")
        entries = new.count()
        moved = new.join(lists, ["u", "v"], "left_anti").count()
        lists = new
        if moved <= MOVING * entries:
            break
    full = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("least")).where((F.col("n") >= NEIGHBOURS) & (F.col("least") >= THRESHOLD))
    full = settle(full.select("u"), "saturated")
    if not full.isEmpty():
        wider = local_join(lists, known, ENLARGED, width, centres=full)
        links.append(wider.where("span").select("u", "v"))
    return reduce(DataFrame.unionByName, links)


def count_links(groups: DataFrame, width: int) -> DataFrame:
    """`c, links, others`: for each distinct vector the number of vectors it links with, itself and its copies included,
    and the number of other distinct ones.

    `groups` has `component, c, vec, n`. A group is dealt into blocks of at most about `BLOCK` vectors, and each pair of blocks is
    one product whose entries at the threshold are summed inside the task: no pair leaves it. Pairs of blocks are shuffled
    anew, so that those of one group go to different tasks.
    """
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    # Eight blocks where that leaves `SMALL` vectors in each, so that the pairs of a middling group are dealt as well.
    blocks = F.greatest(F.ceil(F.col("_size") / BLOCK), F.least(F.ceil(F.col("_size") / SMALL), F.lit(8)))
    sizes = sizes.select("component", blocks.cast("int").alias("blocks"))
    dealt = groups.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "vec", "n")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = matrix(pdf["vec"], width), pdf["n"].to_numpy(dtype=np.float64)
        own, i, j = pdf["own"].to_numpy(), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        a = np.flatnonzero(own == i)
        b = a if i == j else np.flatnonzero(own == j)
        links, others = np.zeros(len(x)), np.zeros(len(x))
        if len(a) and len(b):
            linked = (x[a] @ x[b].T) >= THRESHOLD
            if i == j:
                np.fill_diagonal(linked, True)
                links[a], others[a] = linked @ n[b], linked.sum(axis=1) - 1
            else:
                links[a], links[b] = linked @ n[b], n[a] @ linked
                others[a], others[b] = linked.sum(axis=1), linked.sum(axis=0)
        return pd.DataFrame({"c": pdf["c"], "links": np.rint(links).astype(np.int64), "others": others.astype(np.int64)})

    counted = paired.repartition("component", "i", "j").groupBy("component", "i", "j").applyInPandas(count, "c long, links long, others long")
    return counted.groupBy("c").agg(F.sum("links").alias("links"), F.sum("others").alias("others"))


def audit(vectors: DataFrame, found: DataFrame, width: int, first: int = AUDITED, most: int = AUDITED_MOST) -> float | None:
    """Share of the true links to other distinct vectors that were found (`others`): a mean over the vectors with some.

    Vectors with the least hashes are taken, four times as many a turn until `SEEN` of them have a true link; the queries,
    `most` at most, are all that is sent. None if they were not the whole table and no link was seen: nothing is measured.
    """

    def measured(size: int) -> tuple[int, float | None, bool]:
        chosen = vectors.orderBy(F.xxhash64("c"), "c").limit(size).select("c", "vec").toPandas()
        queries, ids = matrix(chosen["vec"], width), chosen["c"].to_numpy()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(ids), dtype=np.int64)
            for batch in batches:
                x = matrix(batch.column("vec"), width)
                for i in range(0, len(ids), AUDITED):
                    total[i : i + AUDITED] += ((queries[i : i + AUDITED] @ x.T) >= THRESHOLD).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["c", "near"])

        # Each query is near itself.
        near = vectors.select("vec").mapInArrow(count, "c long, near long").groupBy("c").agg((F.sum("near") - 1).alias("all")).where(F.col("all") > 0)
        share = F.least(F.coalesce("others", F.lit(0)), "all") / F.col("all")
        row = near.join(found, "c", "left").agg(F.count(F.lit(1)).alias("seen"), F.avg(share).alias("mean")).first()
        return row["seen"], row["mean"], len(ids) < size

    size = first
    while True:
        seen, mean, whole = measured(size)
        if whole or seen >= SEEN or size >= most:
            return float(mean) if seen else 1.0 if whole else None
        size = min(4 * size, most)


def vector_groups(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """`vec_id, n_links, component_id, kept, audited_recall`: links of all vectors by cosine ≥ 0.9 in double precision.

    Equal vectors are one node with a weight. Nodes get a neighbour graph by descent; its links make groups; inside the
    groups every pair is compared, in blocks, so no link below the threshold is reported and none inside a group is
    missed. Links across groups can only be missed if no table, list or chain of links joins them: the number of tables
    follows from that of the vectors, an audit counts all links of a bounded number of vectors by brute force, and further
    tables are added while less than `RECALL` are found. If that does not hold after `TRIES` turns, it is an error. Where
    the audit meets no link at all, `audited_recall` is null.

    Null vectors, zero vectors and vectors with null or non-finite components link with nothing and are their own
    component. Shorter vectors are filled up with zeros. Null ids are kept; they are never the least one unless a group
    has no other, and never `kept`. Repeated rows link with each other. An empty table gives no rows.
    """
    kind = "float" if table.schema[vec_col].dataType == T.ArrayType(T.FloatType(), True) else "double"
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    rows = rows.withColumn("ok", F.coalesce(usable("vec"), F.lit(False)))
    good = rows.where("ok").groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"))
    vectors = settle(good.withColumn("c", F.monotonically_increasing_id()), "vectors")
    known = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    n, width = known["n"], known["width"] or 1
    edges, recall = None, 0.0
    for turn in range(TRIES):
        tables = tables_of(n) << turn
        linked = descend(settle(starting_graph(vectors, n, width, 3 + turn, tables), "start"), vectors, width)
        edges = settle((linked if edges is None else edges.unionByName(linked)).distinct(), "edges")
        groups = settle(components(edges, "u", "v"), "groups")
        members = groups.select(F.col("node").alias("c"), "component").join(vectors, "c")
        counted = settle(count_links(members.select("component", "c", "vec", "n"), width), "counted")
        recall = audit(vectors, counted, width)
        if recall is None or recall >= RECALL:
            break
    else:
        raise RuntimeError(f"only {recall:.4f} of the links of the audited vectors were found, {RECALL} are asked for")
    named = vectors.join(groups, F.col("c") == F.col("node"), "left").join(counted, "c", "left")
    named = named.withColumn("root", F.coalesce("component", "c"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    nodes = named.join(least, "root").select(F.col("vec").alias("_vec"), F.coalesce("links", "n").alias("links"), "component_id")
    joined = rows.where("ok").join(nodes, F.col("vec") == F.col("_vec")).select("vec_id", (F.col("links") - 1).alias("n_links"), "component_id")
    rest = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return joined.unionByName(rest).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", kept, F.lit(recall).cast("double").alias("audited_recall"))
