"""Prefix trie of conversations: which opening turns are shared, by how many, and how much text that sharing saves.

Texts stay where they are read: a turn goes on as a digest of its role and text and its number of code points. The opening of
a conversation up to a depth is known by two sums of digests of (turn, depth), so that openings of one long conversation
are summed over many tasks. A count-min sketch counts the openings, up to two. It never counts too few: an estimate of one
proves that an opening belongs to one conversation, and its node is given out where the row lies. Only openings that may be
shared are shuffled and grouped exactly. A node's sums over its subtree come back along its smallest member: every node
below hands its part to the rows of that conversation, so no level of the trie needs a round of its own.

Null roles and texts count as empty. Rows without a conversation id belong to no conversation. Turns of one conversation with
equal numbers, null ones first, go in the order of the digests of role and text; repeated rows are turns each. An empty table
has no root and gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cladeflow.llm.common import power_buckets, text_of
from cladeflow.operators import ordering
from cladeflow.session import settle

#: Rows of the sketch; the least and most bits of a cell number. With two bits a cell the sketch is 64 MB at most, which bounds
#: what is sent to executors; where there are more openings than cells, more of them count as possibly shared.
SKETCH_ROWS, LEAST_BITS, MOST_BITS = 4, 14, 26
#: Cells of the sketch in one row of the table that is merged.
BLOCK = 1 << 16
#: Ids that one task sorts and hashes at once; more go through it as a stream.
ENDS_AT_ONCE, IDS_A_CHUNK = 10_000, 4_096
#: Conversations share their first turns with the one whose id is the next lower multiple of this; how many of them is less than this.
FAMILY, HEADS = 100, 6
#: The key of the root.
ROOT = b"\0"


def _head_turns(conv: Column) -> Column:
    return (F.crc32(conv.cast("string")) % HEADS).cast("int")


def _key(depth: Column, sums: list[Column]) -> Column:
    """Sixteen bytes that stand for an opening; null above depth 1."""
    name = F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums])
    return F.when(depth > 0, F.unhex(F.substring(F.sha2(name, 256), 1, 32)))


def numbered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`conv_id, pos, digest, n`: the turns of every conversation, numbered from 1, with the code points of their texts."""
    role, text = text_of(f"`{role_col}`"), text_of(f"`{text_col}`")
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(named, 256), 1, 32)).alias("digest"),
        F.length(text).cast("long").alias("n"),
    )
    turns = settle(turns, "turns")
    placed = ordering.prefix(turns, ["conv_id"], ordering.id_buckets("turn"), [F.col("turn"), F.col("digest")], sums={"pos": F.lit(1)})
    return settle(placed.select("conv_id", "pos", "digest", "n"), "numbered")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with the first turns of the first of their family: `(turns, conversations)`.

    The turns are `conv_id, d, digest, n, length`, numbered by `d` from 1 up to `length`; the conversations `conv_id, length`.
    """
    conv = F.col("conv_id")
    counts = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_turns"))
    first = own.where((conv % FAMILY == 0) & (F.col("pos") < HEADS)).groupBy(conv.alias("_family"))
    first = first.agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "n"))).alias("_first"))
    convs = counts.withColumn("_family", conv - conv % FAMILY).withColumn("_h", _head_turns(conv)).join(first, "_family", "left")
    # A family without its first conversation has no turns to share.
    head = F.when(F.col("_first").isNotNull(), F.slice("_first", F.lit(1), F.col("_h")))
    shared = F.coalesce(F.size(head), F.lit(0))
    convs = convs.select("conv_id", "_turns", head.alias("_head"), F.greatest(shared, F.lit(0)).alias("_shared"), "_h")
    convs = convs.withColumn("length", F.col("_shared") + F.greatest(F.col("_turns") - F.col("_h"), F.lit(0)))
    convs = settle(convs, "conversations")
    heads = convs.select("conv_id", "length", F.explode("_head").alias("_t"))
    heads = heads.select("conv_id", F.col("_t.pos").alias("d"), "_t.digest", "_t.n", "length")
    later = own.where(F.col("pos") > _head_turns(conv))
    later = ordering.salted_join(later, convs.select("conv_id", "_h", "_shared", "length", "_turns"), ["conv_id"], ["pos"], rows="_turns")
    later = later.select("conv_id", (F.col("pos") - F.col("_h") + F.col("_shared")).alias("d"), "digest", "n", "length")
    return heads.unionByName(later), convs.select("conv_id", "length")


def openings(turns: DataFrame) -> DataFrame:
    """`conv_id, d, key, parent, n, length`: each conversation's openings by depth, with the key of the one before."""
    print_ = F.sha2(F.concat_ws(":", F.hex("digest"), F.col("d").cast("string")), 256)
    digests = turns.select("conv_id", "d", "n", "length", print_.alias("_p"))
    parts = [F.conv(F.substring("_p", at, 15), 16, 10).cast("decimal(19,0)").alias(f"_z{at}") for at in (1, 16)]
    rows = settle(digests.select("conv_id", "d", "n", "length", *parts), "prints")
    summed = ordering.prefix(rows, ["conv_id"], [F.shiftright("d", ordering.BLOCK_BITS)], [F.col("d")], sums={f"_s{at}": F.col(f"_z{at}") for at in (1, 16)})
    before = [F.col(f"_s{at}") - F.col(f"_z{at}") for at in (1, 16)]
    keys = _key(F.col("d"), [F.col(f"_s{at}").cast("decimal(38,0)") for at in (1, 16)])
    parents = _key(F.col("d") - 1, [b.cast("decimal(38,0)") for b in before])
    return settle(summed.select("conv_id", "d", keys.alias("key"), parents.alias("parent"), "n", "length"), "openings")


# -- the sketch ----------------------------------------------------------------------------------------------------------


def _cells(keys: pa.Array, bits: int) -> np.ndarray:
    """The cell of each key in every row of the sketch; keys are sixteen bytes of a digest, four for each row."""
    words = np.frombuffer(b"".join(keys.to_pylist()), dtype="<u4").reshape(len(keys), SKETCH_ROWS)
    return (words & np.uint32((1 << bits) - 1)).T.astype(np.int64)


def sketch(rows: DataFrame, bits: int) -> np.ndarray:
    """Count-min counts of `key`, up to two, four cells in a byte: every task counts its rows, and the counts are added by block."""
    cells = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((SKETCH_ROWS, cells), dtype=np.uint8)
        for batch in batches:
            for own, at in zip(counts, _cells(batch.column(0), bits)):
                cell, found = np.unique(at, return_counts=True)
                own[cell] = np.minimum(own[cell] + np.minimum(found, 2), 2)
        for r in range(SKETCH_ROWS):
            for start in range(0, cells, BLOCK):
                block = counts[r, start : start + BLOCK]
                if block.any():
                    yield pa.RecordBatch.from_pydict({"r": [r], "b": [start // BLOCK], "counts": [zlib.compress(block.tobytes(), 1)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r, b, data in zip(*(c.to_pylist() for c in batch.columns)):
                block = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
                total[r, b] = np.minimum(total.get((r, b), 0) + block, 2).astype(np.uint8)
        for (r, b), block in total.items():
            packed = (block.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"r": [r], "b": [b], "counts": [packed.tobytes()]})

    schema = "r long, b long, counts binary"
    parts = rows.select("key").mapInArrow(count, schema).repartition("r", "b").mapInArrow(add, schema)
    found = np.zeros((SKETCH_ROWS, cells // 4), dtype=np.uint8)
    for row in parts.toLocalIterator():
        block = np.frombuffer(row["counts"], dtype=np.uint8)
        found[row["r"], row["b"] * BLOCK // 4 :][: len(block)] = block
    return found


def screen(rows: DataFrame, bits: int | None = None) -> DataFrame:
    """Openings with `single`, whether the sketch proves that one conversation alone has them, and `parent_single`."""
    bits = bits or power_buckets(2 * rows.count(), 1, LEAST_BITS, MOST_BITS).bit_length() - 1
    sent = rows.sparkSession.sparkContext.broadcast((bits, sketch(rows, bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, counts = sent.value

        def single(keys: pa.Array) -> pa.Array:
            found = np.zeros(len(keys), dtype=bool)
            given = keys.is_valid().to_numpy(zero_copy_only=False)
            if given.any():
                at = _cells(keys.drop_null(), bits)
                estimate = np.min([(own[c >> 2] >> ((c & 3) * 2).astype(np.uint8)) & 3 for own, c in zip(counts, at)], axis=0)
                found[given] = estimate == 1
            return pa.array(found)

        for batch in batches:
            more = [single(batch.column(name)) for name in ("key", "parent")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "single", "parent_single"])

    schema = T.StructType([*rows.schema.fields, *[T.StructField(name, T.BooleanType(), False) for name in ("single", "parent_single")]])
    return settle(rows.mapInArrow(run, schema), "screened")


# -- ends ----------------------------------------------------------------------------------------------------------------


def ends_digests(ends: DataFrame, at_once: int = ENDS_AT_ONCE) -> DataFrame:
    """`key, ends_sha256`: the SHA-256 of the ascending ids of each key, joined by commas.

    SHA-256 is a chain, so one task must see all ids of a key in the end. Up to `at_once` ids are sorted in a row. Where there
    are more, ranges of ids become pieces of the joined text in many tasks, and the pieces pass one task in order.
    """
    counts = ends.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    large = counts.where(F.col("_n") > at_once).select("key")
    # Fewer keys than ids divided by `at_once`.
    hot = F.broadcast(large)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    few = ends.join(hot, "key", "left_anti").groupBy("key").agg(F.sha2(joined, 256).alias("ends_sha256"))
    if large.isEmpty():
        return few

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece() -> pa.RecordBatch:
            text = ",".join(map(str, ids))
            return pa.RecordBatch.from_pydict({"key": [key], "first": [ids[0]], "piece": [zlib.compress(text.encode())]})

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != key or len(ids) == IDS_A_CHUNK):
                    yield piece()
                    ids = []
                key = k
                ids.append(c)
        if ids:
            yield piece()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    if state is not None:
                        yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [state.hexdigest()]})
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(zlib.decompress(data))
        if state is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [state.hexdigest()]})

    ranges = ends.join(hot, "key", "left_semi").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    cut = settle(ranges.select("key", "conv_id").mapInArrow(pieces, "key binary, first long, piece binary"), "pieces")
    ordered = cut.repartition("key").sortWithinPartitions("key", "first")
    return few.unionByName(ordered.mapInArrow(chain, "key binary, ends_sha256 string"))


# -- the trie ------------------------------------------------------------------------------------------------------------


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see `rebuilt`).

    `conv_id` (the smallest member), `depth`, `parent_conv_id`, `n_convs`, `n_children`, `n_leaves`, `saved_tokens`, `ends_sha256`.
    """
    turns, convs = rebuilt(numbered_turns(df, conv_col, turn_col, role_col, text_col))
    rows = screen(openings(turns), bits)
    ended = F.col("d") == F.col("length")

    shared = rows.where("not single")
    nodes = settle(
        shared.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"),
            F.max("d").alias("depth"),
            F.max("parent").alias("parent"),
            F.max("n").alias("_len"),
            F.count(F.lit(1)).alias("n_convs"),
            F.count_if(ended).alias("_ends"),
            # The sketch may take the next opening of a proven single one for shared: its parent is in no group.
            F.max("parent_single").alias("_own"),
        ),
        "nodes",
    )
    saved, leaf = (F.col("n_convs") - 1) * F.col("_len"), (F.col("_ends") == F.col("n_convs")).cast("long")

    # What is below a node: the parts of nodes along their smallest members, and proven tails as one leaf each.
    marks = nodes.select("conv_id", F.col("depth").alias("d"), saved.alias("_saved"), leaf.alias("_leaf"))
    marked = shared.select("conv_id", "d", "key").join(marks, ["conv_id", "d"], "left")
    tails = rows.where(F.col("single") & ended).select("conv_id", "d", F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("_saved"), F.lit(1).cast("long").alias("_leaf"))
    marked = settle(marked.unionByName(tails), "marks")
    block = -F.shiftright("d", ordering.BLOCK_BITS)
    below = ordering.prefix(marked, ["conv_id"], [block], [-F.col("d")], sums={"_below": F.col("_saved"), "_leaves": F.col("_leaf")})
    sums = below.where(F.col("key").isNotNull()).groupBy("key").agg(F.sum("_below").alias("saved_tokens"), F.sum("_leaves").alias("n_leaves"))

    # Children, and the smallest members of parents; a parent with very many children is dealt over tasks.
    heads = rows.where("single and not parent_single and d > 1").select("key", "parent", "conv_id", F.col("d").alias("depth"), "length")
    grouped = nodes.where("depth > 1 and not _own")
    children = heads.select("parent").union(grouped.select("parent")).groupBy("parent").agg(F.count(F.lit(1)).alias("_children"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")).join(children, "parent")
    inner = grouped.select("key", "parent", "conv_id", "depth", F.lit(None).cast("long").alias("length"), "n_convs")
    below_others = inner.unionByName(heads, allowMissingColumns=True)
    placed = settle(ordering.salted_join(below_others, parents, ["parent"], ["key"], rows="_children"), "placed")

    # The root.
    whole = convs.agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n")).first()
    top = rows.where("d = 1 and single").count() + nodes.where("depth = 1").count()
    totals = marked.agg(F.sum("_saved").alias("saved"), F.sum("_leaf").alias("leaves")).first()

    ends = shared.where(ended).select("key", "conv_id").unionByName(convs.where("length = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    digests = ends_digests(settle(ends, "ends"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    spark = df.sparkSession
    root = spark.createDataFrame(
        [(ROOT, whole["least"], None, whole["n"], top, (totals["leaves"] or 0) or 1, totals["saved"] or 0)] if whole["n"] else [],
        "key binary, conv_id long, parent_conv_id long, n_convs long, _children long, n_leaves long, saved_tokens long",
    ).withColumn("depth", F.lit(0).cast("long"))

    least = F.lit(whole["least"]).cast("long")
    above = F.when(F.col("depth") == 1, least).otherwise(F.col("conv_id")).alias("parent_conv_id")
    known = nodes.where("depth = 1 or _own").select("key", "conv_id", above, "depth", "n_convs")
    known = known.unionByName(placed.where("n_convs is not null").select("key", "conv_id", "parent_conv_id", "depth", "n_convs"))
    known = known.join(children.withColumnRenamed("parent", "key"), "key", "left").join(sums, "key", "left")
    known = known.unionByName(root).join(digests, "key", "left")
    first = rows.where("single and not parent_single and d = 1").select("conv_id", least.alias("parent_conv_id"), F.col("d").alias("depth"), "length")
    alone = first.unionByName(placed.where("n_convs is null").select("conv_id", "parent_conv_id", "depth", "length"))
    alone = alone.unionByName(rows.where("single and parent_single").select("conv_id", F.col("conv_id").alias("parent_conv_id"), F.col("d").alias("depth"), "length"))
    is_end = F.col("depth") == F.col("length")

    def long(value: Column | int, name: str) -> Column:
        return (F.lit(value) if isinstance(value, int) else value).cast("long").alias(name)

    return known.select(
        "conv_id", long(F.col("depth"), "depth"), "parent_conv_id", long(F.col("n_convs"), "n_convs"), long(F.coalesce("_children", F.lit(0)), "n_children"),
        long(F.col("n_leaves"), "n_leaves"), long(F.col("saved_tokens"), "saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    ).unionByName(
        alone.select(
            "conv_id", long(F.col("depth"), "depth"), "parent_conv_id", long(1, "n_convs"), long(F.when(is_end, 0).otherwise(1), "n_children"),
            long(1, "n_leaves"), long(0, "saved_tokens"), F.when(is_end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"),
        )
    )
