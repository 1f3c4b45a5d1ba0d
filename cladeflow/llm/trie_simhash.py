"""SimHash fingerprints and their links, by a self-join of the binary trie of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cladeflow.llm.common import components, settle

SHINGLE = 3
SEED = 42
BUDGET = 3
#: Fingerprints of a subtrie that one task joins, aimed at and at most.
AIMED, MOST = 1_024, 20_000
#: Shingles that are hashed and counted at once.
_CHUNK = 65_536


def simhash(text: bytes) -> int:
    """The 64-bit fingerprint of a text: a bit is 1 if it is set in over half the hashes of the shingles."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    cuts = zip(starts[:n].tolist(), (ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]).tolist())
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in cuts), dtype=">u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def add_fingerprints(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every whole text as a signed 64-bit number; null texts count as empty: zero."""
    kept = [c for c in df.columns if c != out]
    schema = df.drop(out).schema.add(out, "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).cast(pa.binary())
            marks = [simhash(t.as_py() or b"") for t in texts]
            signed = pa.array(np.array(marks, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], signed], names=[*kept, out])

    return df.mapInArrow(run, schema)


# -- inside a task: node pairs of one or two subtries ---------------------------------------------------------------


def _bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class _Labels:
    """Connected groups of rows, by the least row number."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label[:] = label[label]


def _walk(left: np.ndarray, right: np.ndarray, start: int, errors: int, half: int, found, leaf: int = 16, chunk: int = 1 << 18) -> None:
    """Visit pairs of trie nodes of two sorted arrays together, from level `start` on, and give leaf pairs to `found`.

    A node is a run of an array that shares its leading bits. `errors` bits differ so far; a pair is left when more than
    `half` bits differ within the first 32 levels, or more than `BUDGET` in all. Small pairs are compared directly. If
    both arrays are the same object, each unordered pair is visited once. Pairs of nodes are kept on a stack in chunks,
    so memory does not follow their number.
    """
    same = left is right
    stack = [(start, *[np.array([v]) for v in (0, len(left), 0, len(right), errors)])]
    while stack:
        level, a0, a1, b0, b1, e = stack.pop()
        if len(a0) > chunk:
            for i in range(0, len(a0), chunk):
                stack.append((level, *[x[i : i + chunk] for x in (a0, a1, b0, b1, e)]))
            continue
        small = ((a1 - a0) * (b1 - b0) <= leaf * leaf) | (level >= 64)
        if small.any():
            s0, s1, t0, t1 = a0[small], a1[small], b0[small], b1[small]
            sizes = (s1 - s0) * (t1 - t0)
            for i in range(0, len(sizes), chunk // (leaf * leaf)):
                part = slice(i, i + chunk // (leaf * leaf))
                n, width = sizes[part], (t1 - t0)[part]
                first = np.repeat(np.cumsum(n) - n, n)
                k = np.arange(n.sum()) - first
                w = np.repeat(width, n)
                found(np.repeat(s0[part], n) + k // w, np.repeat(t0[part], n) + k % w)
        a0, a1, b0, b1, e = (x[~small] for x in (a0, a1, b0, b1, e))
        if not len(a0):
            continue
        bit = np.uint64(1) << np.uint64(63 - level)
        ones = np.concatenate([[0], np.cumsum((left & bit) != 0)])
        am = a1 - (ones[a1] - ones[a0])
        if not same:
            ones = np.concatenate([[0], np.cumsum((right & bit) != 0)])
        bm = b1 - (ones[b1] - ones[b0])
        most = half if level < 32 else BUDGET
        twins = (a0 == b0) & (a1 == b1) if same else np.zeros(len(a0), bool)
        more = [(a0, am, b0, bm, e), (am, a1, bm, b1, e)]
        ok = e < most
        more.append(tuple(x[ok] for x in (a0, am, bm, b1, e + 1)))
        ok = ok & ~twins
        more.append(tuple(x[ok] for x in (am, a1, b0, bm, e + 1)))
        a0, a1, b0, b1, e = (np.concatenate(x) for x in zip(*more))
        alive = (a1 > a0) & (b1 > b0)
        stack.append((level + 1, *[x[alive] for x in (a0, a1, b0, b1, e)]))


def subtrie_links(home: np.ndarray, guests: np.ndarray, guest_errors: np.ndarray, depth: int, half: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all linked fingerprints of a subtrie, among its own and between guests and its own.

    Every fingerprint is linked to the least one of its group, so there are fewer edges than fingerprints.
    """
    home = np.unique(home)
    every = np.concatenate([home, guests])
    groups = _Labels(len(every))

    def found_at(shift: int, right: np.ndarray, places: np.ndarray | None):
        def found(a: np.ndarray, b: np.ndarray) -> None:
            close = _bit_count(home[a] ^ right[b]) <= BUDGET
            groups.link(a[close], (b[close] if places is None else places[b[close]]) + shift)

        return found

    _walk(home, home, depth, 0, half, found_at(0, home, None))
    below = np.uint64((1 << (64 - depth)) - 1)
    for errors in np.unique(guest_errors):
        places = np.flatnonzero(guest_errors == errors)
        # Guests come from several prefixes; from `depth` on they form one trie.
        places = places[np.argsort(guests[places] & below, kind="stable")]
        right = guests[places]
        _walk(home, right, depth, int(errors), half, found_at(len(home), right, places))
    label = groups.label
    moved = np.flatnonzero(label != np.arange(len(label)))
    return every[moved], every[label[moved]]


# -- over the cluster ------------------------------------------------------------------------------------------------


def _masks(bits: int, most: int):
    """Every way in which at most `most` of `bits` bits differ, as `(mask, errors)`."""
    return [(sum(1 << b for b in chosen), k) for k in range(most + 1) for chosen in combinations(range(bits), k)]


def fingerprint_links(marks: DataFrame, aimed: int = AIMED, most: int = MOST) -> DataFrame:
    """`a, b`: edges that connect all distinct fingerprints within `BUDGET` bits, directly or through others.

    Three errors leave at most one in the upper or in the lower 32 bits. So the trie is joined with itself twice, once by
    the fingerprint and once by the fingerprint with its halves swapped, with a budget of one error in the first 32 levels
    and of three in all. The upper levels are dealt over the cluster: a fingerprint lives in the subtrie of its prefix
    and visits the subtries whose prefix differs within the budget and is greater. Subtries with more than `most` rows
    are opened by eight more levels, until none is that large.
    """
    distinct = settle(marks.select(F.col("fingerprint").alias("v")).distinct(), "marks")
    n = distinct.count()
    depth = max(0, min(24, (max(1, n) // aimed).bit_length()))
    both = distinct.select(F.lit(0).alias("turn"), "v").union(distinct.select(F.lit(32), F.expr("shiftleft(v, 32) | shiftrightunsigned(v, 32)")))
    rows = both.withColumns({"e": F.lit(0), "guest": F.lit(False), "key": F.lit(0).cast("long")})
    rows, at, parts = _open(rows, 0, depth), depth, []
    while True:
        rows = settle(rows, "subtries")
        heavy = rows.groupBy("turn", "key").count().where(F.col("count") > most).select("turn", "key")
        if at >= 64 or heavy.isEmpty():
            parts.append(_join(rows, at))
            break
        heavy = settle(heavy, "heavy")
        parts.append(_join(rows.join(heavy, ["turn", "key"], "left_anti"), at))
        step = min(8, 64 - at) if at >= 32 else min(8, 32 - at)
        rows = _open(rows.join(heavy, ["turn", "key"], "left_semi"), at, step)
        at += step
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.union(part)
    return settle(edges, "edges")


def _open(rows: DataFrame, at: int, step: int) -> DataFrame:
    """Deal rows from subtries at level `at` to those `step` levels below, guests and visits included."""
    if not step:
        return rows
    end = at + step
    most = 1 if end <= 32 else BUDGET
    own = F.shiftrightunsigned("v", 64 - end).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
    masks = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(k).alias("k")) for m, k in _masks(step, most)]))
    opened = rows.withColumn("_own", own).select("*", masks.alias("_m"))
    child = F.col("_own").bitwiseXOR(F.col("_m.mask"))
    errors = F.col("e") + F.col("_m.k")
    # Of two subtries that visit each other, the lesser goes to the greater one; a guest visits all within its budget.
    wanted = (errors <= most) & (F.col("guest") | (child >= F.col("_own")))
    return opened.where(wanted).select(
        "turn", "v", errors.cast("int").alias("e"), (F.col("guest") | (F.col("_m.k") > 0)).alias("guest"),
        (F.shiftleft("key", step) + child).alias("key"),
    )


def _join(rows: DataFrame, depth: int) -> DataFrame:
    def run(key, pdf):
        guest = pdf["guest"].to_numpy(dtype=bool)
        values = pdf["v"].to_numpy(dtype=np.int64).view(np.uint64)
        a, b = subtrie_links(values[~guest], values[guest], pdf["e"].to_numpy(dtype=np.int64)[guest], depth)
        if key[0]:
            a, b = ((x << np.uint64(32)) | (x >> np.uint64(32)) for x in (a, b))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return rows.groupBy("turn", "key").applyInPandas(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`row, fingerprint, root, component_id`: near-duplicate groups of whole documents; `row` holds a document's columns.

    Texts are lower-cased in A-Z, shingled by three words (fewer words: all of them), and linked when their fingerprints
    differ in at most three bits. `component_id` is the least id reachable by links, `root` a fingerprint that names the group. Null and blank texts have fingerprint
    zero and link like any other; null ids never are the least one unless a group has no other; rows that repeat are of
    one group. An empty table gives no rows. A fingerprint that many documents share enters the join once.
    """
    marked = add_fingerprints(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("_text")), "_text").drop("_text")
    marked = settle(marked, "fingerprints")
    classes = settle(marked.groupBy("fingerprint").agg(F.min(f"row.{id_col}").alias("least")), "classes")
    linked = components(fingerprint_links(classes), "a", "b")
    rooted = classes.join(linked, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("root")
    )
    leasts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(leasts, "root").select(F.col("fingerprint").alias("_mark"), "root", "component_id")
    return marked.join(named, F.col("fingerprint") == F.col("_mark")).drop("_mark")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the least id of their near-duplicate group, with the columns of the input; one row for each group."""
    groups = simhash_groups(docs, id_col, text_col)
    kept = groups.where(F.col(f"row.{id_col}").eqNullSafe(F.col("component_id")))
    first = kept.groupBy("root").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return first.select("row.*")
