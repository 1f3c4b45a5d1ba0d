"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

import base64
import hashlib
import math
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from cladeflow.llm.common import settle, text_of

#: Cells of the sketch that is the fingerprint; a failed peeling is tried again with `GROWTH` times as many.
CELLS, GROWTH = 12, 4
#: A paragraph of more words counts as several pieces of so many.
PIECE_WORDS = 16
#: Steps of a range of ids at most.
STEPS = 256
HASHES = 3
_LOW = (1 << 64) - 1


def pieces(text: str, piece_words: int = PIECE_WORDS) -> set[int]:
    """The distinct 64-bit digests of a text's paragraphs (lines); long paragraphs are cut into pieces, blank ones left out."""
    found = set()
    for line in text.split("\n"):
        words = line.split()
        for i in range(0, len(words), piece_words):
            found.add(xxhash.xxh64_intdigest(" ".join(words[i : i + piece_words]).encode("utf-8", "surrogatepass")))
    return found


def _mix(key: int, salt: int) -> int:
    """A 64-bit finaliser: multiply and fold."""
    key = ((key ^ salt) * 0x9E3779B97F4A7C15) & _LOW
    key = ((key ^ (key >> 29)) * 0xBF58476D1CE4E5B9) & _LOW
    return key ^ (key >> 32)


class Sketch:
    """Cells of (count, XOR of keys, XOR of checks); each key lies in one cell of each third."""

    def __init__(self, cells: int):
        self.third = cells // HASHES
        self.count = [0] * cells
        self.keys = [0] * cells
        self.checks = [0] * cells

    @classmethod
    def of(cls, digests: set[int], cells: int) -> Sketch:
        sketch = cls(cells)
        for key in digests:
            sketch.add(key, 1)
        return sketch

    def add(self, key: int, times: int) -> tuple[int, int, int]:
        mixed = _mix(key, len(self.count))
        check, third = mixed >> 32, self.third
        a, b, c = mixed % third, third + (mixed >> 21) % third, 2 * third + (mixed >> 42) % third
        for i in (a, b, c):
            self.count[i] += times
            self.keys[i] ^= key
            self.checks[i] ^= check
        return a, b, c

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(len(self.count))
        out.count = [x - y for x, y in zip(self.count, other.count)]
        out.keys = [x ^ y for x, y in zip(self.keys, other.keys)]
        out.checks = [x ^ y for x, y in zip(self.checks, other.checks)]
        return out

    def peel(self) -> tuple[set[int], set[int]] | None:
        """The keys of the left and of the right side only, by emptying cells of one key; None if some cell stays full."""
        left, right = set(), set()
        todo = list(range(len(self.count)))
        while todo:
            i = todo.pop()
            times, key = self.count[i], self.keys[i]
            if times not in (1, -1) or _mix(key, len(self.count)) >> 32 != self.checks[i]:
                continue
            (left if times == 1 else right).add(key)
            todo.extend(self.add(key, -times))
        return None if any(self.count) or any(self.keys) else (left, right)

    def text(self) -> str:
        """The cells in base64: count (4 bytes), keys (8 bytes) and check (4 bytes) of each."""
        cells = (struct.pack(">iQI", n, k, c) for n, k, c in zip(self.count, self.keys, self.checks))
        return base64.b64encode(b"".join(cells)).decode()


def difference(a: set[int], b: set[int], cells: int = CELLS, seen: dict | None = None) -> tuple[set[int], set[int]]:
    """The digests of one version only, recovered from the sketches of both; a failure is tried again with larger ones.

    From 1.5 cells a key on, peeling succeeds but for rare collisions, which the next size resolves. `seen` keeps
    sketches between calls, by the identity of the set and the size.
    """
    seen = {} if seen is None else seen

    def sketch(digests: set[int]) -> Sketch:
        key = (id(digests), cells)
        if key not in seen:
            seen[key] = Sketch.of(digests, cells)
        return seen[key]

    while True:
        peeled = sketch(a).minus(sketch(b)).peel()
        if peeled is not None:
            return peeled
        cells *= GROWTH


def likeness(a: set[int], b: set[int], seen: dict | None = None) -> float:
    """Share of the digests of both versions that the other one has too: 1 for equal sets, 0 for disjoint ones."""
    if not a and not b:
        return 1.0
    left, right = difference(a, b, seen=seen)
    return 1.0 - (len(left) + len(right)) / (len(a) + len(b))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the start of another one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame, id_col: str, text_col: str, per_bucket: int = 2_000) -> DataFrame:
    """`doc_id, text, following`: each text beside the text of the next lower id; after the lowest id comes the highest.

    Documents go into buckets by id: 256 ranges between quantiles of the id, each cut into at most `STEPS` equal steps, so
    that a bucket has about `per_bucket` rows, and more only in tables beyond 131 million rows, which the window then sorts
    on disk. The first document of each bucket is also sent, as a guest, to the bucket before it, where it stands last; so
    texts are shuffled once. An id that fills a whole range, and the rows without an id, which stand after all others, are
    cut by the text's digest, by which rows of one id are ordered; only equal texts of one id meet in one bucket. The list
    of buckets thus never has more than 256 · `STEPS` + 129 · 256 rows, about 100,000 of some 60 bytes, at any size of the
    table: it is what passes the window without a partition, and what is broadcast.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    quantiles = F.percentile_approx("doc_id", [i / 256 for i in range(257)], 10_000).alias("cuts")
    known = ids.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("named"), quantiles).first()
    drawn = known["cuts"] or []
    cuts, often = sorted(set(drawn)), sorted({a for a, b in zip(drawn, drawn[1:]) if a == b})
    steps = min(STEPS, max(1, math.ceil(known["n"] / (256 * per_bucket))))
    at = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array(F.lit(0).cast("long"))
    cell = F.size(F.filter(at, lambda c: c <= F.col("doc_id")))
    low, high = F.get(at, cell - 1), F.coalesce(F.get(at, cell), F.col("doc_id") + 1)
    inside = F.floor((F.col("doc_id") - low) / (high - low) * steps)
    bucket = F.when(F.col("doc_id").isNull(), -1).when(cell == 0, 0).otherwise(cell * steps + F.least(inside, F.lit(steps - 1))).cast("long")
    # A frequent id is a cut, so it is the lowest of its bucket and its parts stand after the other rows.
    parted = F.col("doc_id").isNull() | (F.array_contains(F.array(*[F.lit(c) for c in often]), F.col("doc_id")) if often else F.lit(False))
    part = F.lit(255) - F.conv(F.substring("_digest", 1, 2), 16, 10).cast("long")
    bucket = bucket * 512 + F.when(parted, part).otherwise(256)
    dealt = ids.withColumn("_digest", F.md5("text")).withColumn("_bucket", bucket)
    order = [F.col("doc_id").desc_nulls_last(), F.col("_digest")]
    # Texts are read for this list only where some id is parted.
    least = F.min(F.when(parted, F.col("_digest"))) if often or known["named"] < known["n"] else F.lit(None).cast("string")
    heads = dealt.groupBy("_bucket").agg(F.max("doc_id").alias("_head"), least.alias("_first"))
    downwards = Window.orderBy(F.col("_bucket").desc())
    targets = heads.select(
        F.col("_bucket").alias("_own"), "_head", "_first", F.lag("_bucket").over(downwards).alias("_before"), F.min("_bucket").over(Window.partitionBy()).alias("_last")
    ).select("_own", "_head", "_first", F.coalesce("_before", "_last").alias("_to"))
    is_head = F.col("doc_id").eqNullSafe(F.col("_head")) & F.coalesce(F.col("_digest") == F.col("_first"), F.lit(True))
    found = dealt.join(F.broadcast(settle(targets, "heads")), (F.col("_bucket") == F.col("_own")) & is_head)
    guests = found.groupBy("_to").agg(F.min_by(F.struct("doc_id", "text", "_digest"), "_digest").alias("g")).select(
        "g.doc_id", "g.text", "g._digest", F.col("_to").alias("_bucket"), F.lit(1).alias("_guest")
    )
    rows = dealt.withColumn("_guest", F.lit(0)).unionByName(guests)
    following = F.lead("text").over(Window.partitionBy("_bucket").orderBy("_guest", *order))
    return rows.withColumn("following", following).where("_guest = 0").select("doc_id", "text", "following")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_pieces`.

    The fingerprint is a sketch of the paragraph digests in `CELLS` cells. Likeness is the share of digests in common,
    computed from what peeling the difference of two sketches recovers, larger sketches being built where it fails.
    Null texts count as empty; two texts without paragraphs are alike (1), one without and one with are not (0). A table
    of one row is its own next document; an empty table gives no rows.
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, n_pieces long"
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last_pieces = None, set()
        for batch in batches:
            out = []
            ids, texts, after = batch.column("doc_id"), batch.column("text"), batch.column("following")
            for i in range(batch.num_rows):
                text, following = texts[i].as_py(), after[i].as_py() or ""
                own = last_pieces if text == last_text else pieces(text)
                changed = edited(text, following)
                changed_pieces, next_pieces = pieces(changed), pieces(following)
                last_text, last_pieces = following, next_pieces
                seen: dict = {}
                near_edited, near_next = likeness(own, changed_pieces, seen), likeness(own, next_pieces, seen)
                sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                marks = [(seen.get((id(s), CELLS)) or Sketch.of(s, CELLS)).text() for s in (own, changed_pieces)]
                out.append((ids[i].as_py(), len(text), sha, *marks, near_edited, near_next, len(own)))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=names)

    return with_next(docs, id_col, text_col).mapInArrow(run, schema)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
