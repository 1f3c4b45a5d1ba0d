"""Whether windows occur in the record they came from, without comparing a window with every place of the record.

Records and windows are sampled alike: of every span of successive runs of `SEED` residues, the one whose hash is least is a
seed. A window that occurs in a record brings its seeds along, so it is enough to look at the places of that seed of the
window which is rarest in the record; a seed that the record lacks rules the window out at once. Places are verified residue
by residue. A window is looked up by the seeds of the longest of the `SPANS` that it holds whole, and a record has seeds of
those spans that its windows ask for: an index row for about every 256 residues where windows are long, and for every
sixteen where they are short. The work is linear in records and windows.

Runs of one residue make no seeds, since one long run of unknowns would make as many places. Windows of a single residue, and
those too short for a seed, are looked up in the whole record instead, each different one once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from cladeflow.functions import sequence as S
from cladeflow.operators import windows as W
from cladeflow.session import remove_read, settle

SEED, SPANS = 32, (32, 128, 512)
#: Residues between the starts of tiles, in which records are sampled and verified.
TILE = 1 << 16


def _sampler(span: int = SPANS[0]):
    """The function from residues to (hashes, places) of their seeds. Self-contained, so that workers need numpy only."""
    seed = SEED

    def seeds(text: bytes):
        import numpy as np

        code = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
        n = len(code) - seed + 1
        if n < span:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        # Hash and evenness of runs of 1, 2, 4 ... residues, each from two of the half length.
        hashes, factor = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 0xBF58476D1CE4E5B9
        even, size = np.ones(len(code), dtype=bool), 1
        while size < seed:
            even = even[:-size] & even[size:] & (code[: len(even) - size] == code[size : len(even)])
            hashes = (hashes[:-size] ^ (hashes[:-size] >> np.uint64(29))) * np.uint64(factor) + hashes[size:]
            factor, size = (factor * factor + 2) % (1 << 64), size * 2
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        hashes ^= hashes >> np.uint64(29)
        hashes[even] = np.iinfo(np.uint64).max
        # The least hash of each span, by doubling as well; a place is a seed if it is the least of some span.
        low, size = hashes, 1
        while size < span:
            low, size = np.minimum(low[:-size], low[size:]), size * 2
        padded = np.concatenate([np.zeros(span - 1, dtype=np.uint64), low, np.zeros(span - 1, dtype=np.uint64)])
        size = 1
        while size < span:
            padded, size = np.maximum(padded[:-size], padded[size:]), size * 2
        reach = padded[:n]
        at = np.flatnonzero((hashes == reach) & ~even)
        return hashes[at].view(np.int64), at

    return seeds


def seed_index(records: DataFrame, key: str, seq: str, span: int = SPANS[0]) -> DataFrame:
    """`key, hash, pos`: the seeds of every record with their places; some at the borders of tiles come twice."""
    # Neighbouring tiles share the spans that cross their border.
    tiles = W.tile(records.select(key, seq), seq, TILE, SEED + span - 2).select(F.col(key).alias("key"), "tile_start", F.col(seq).cast("binary").alias("text"))
    seeds, key_type = _sampler(span), tiles.schema["key"]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                found = [seeds(t) for t in batch.column(2).to_pylist()]
                rows = np.repeat(np.arange(len(found)), [len(h) for h, _ in found])
                hashes, places = (np.concatenate([x[i] for x in found]) for i in (0, 1))
                places = places + batch.column(1).to_numpy()[rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(hashes), pa.array(places)], names=["key", "hash", "pos"])

    schema = T.StructType([key_type, T.StructField("hash", T.LongType()), T.StructField("pos", T.LongType())])
    return tiles.mapInArrow(run, schema)


def _query_seeds(texts: DataFrame, span: int) -> DataFrame:
    """`key, wid, hash, offset`: every seed of every text."""
    seeds, key_type = _sampler(span), texts.schema["key"]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [seeds(t.encode()) for t in batch.column(2).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(h) for h, _ in found]))
            columns = [batch.column(0).take(rows), batch.column(1).take(rows)]
            values = [np.concatenate([x[i] for x in found]) if found else np.zeros(0, dtype=np.int64) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, values)], names=["key", "wid", "hash", "offset"])

    schema = T.StructType([key_type, T.StructField("wid", T.StringType()), T.StructField("hash", T.LongType()), T.StructField("offset", T.LongType())])
    return texts.select("key", "wid", "text").mapInArrow(run, schema)


def find_texts(texts: DataFrame, records: DataFrame, key: str, seq: str) -> DataFrame:
    """`key, wid`: which of the rows `key, wid, text` occur in the record of their key."""
    plain = (F.col("_n") < SEED + SPANS[0] - 1) | (F.trim(F.col("text"), F.substring("text", 1, 1)) == "")
    widest = F.lit(SPANS[0])
    for span in SPANS[1:]:
        widest = F.when(F.col("_n") >= SEED + span - 1, span).otherwise(widest)
    texts = settle(texts.select("key", "wid", "text", F.length("text").alias("_n")).withColumn("_span", F.when(plain, 0).otherwise(widest)), "texts")
    own = settle(records.select(F.col(key).alias("key"), F.col(seq).alias("_record")), "records")
    short = texts.where("_span = 0").join(own, "key").where(F.col("_record").contains(F.col("text"))).select("key", "wid")

    longer, parts = texts.where("_span > 0"), []
    for span in SPANS:
        asking = texts.where(F.col("_span") == span)
        # Records without a text of these lengths need no seeds of the span, and of the others only seeds that texts have.
        asked = settle(_query_seeds(asking, span), "asked")
        sought = own.join(asked.select("key").distinct(), "key", "left_semi")
        index = settle(seed_index(sought, "key", "_record", span).join(asked, ["key", "hash"], "left_semi"), "seeds")
        counts = index.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("_c"))
        known = asked.join(counts, ["key", "hash"], "left")
        rarest = known.groupBy("key", "wid").agg(
            F.count_if(F.col("_c").isNull()).alias("_missing"), F.min_by(F.struct("hash", "offset"), F.struct("_c", "hash", "offset")).alias("_s")
        )
        places = rarest.where("_missing = 0").select("key", "wid", "_s.*").join(index, ["key", "hash"])
        places = settle(places.select("key", "wid", (F.col("pos") - F.col("offset")).alias("at")).where("at >= 0").distinct(), "places")
        remove_read(index, asked)
        parts.append(places)
    places = reduce(DataFrame.unionByName, parts)

    # Every place starts in one tile, and tiles reach over the longest text.
    longest = longer.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    tiles = own.withColumn("_start", F.explode(W._ordinals(F.length("_record"), TILE)))
    tiles = tiles.select("key", F.expr(f"_start div {TILE}").alias("_tile"), W.slice_seq(F.col("_record"), F.col("_start"), F.lit(TILE + longest)).alias("_part"))
    met_by = places.join(longer, ["key", "wid"]).withColumn("_tile", F.shiftright("at", TILE.bit_length() - 1))
    met = met_by.join(tiles, ["key", "_tile"])
    same = W.slice_seq(F.col("_part"), F.col("at") % TILE, F.length("text")) == F.col("text")
    found = settle(met.where(same).select("key", "wid").union(short).distinct(), "found")
    remove_read(texts, own, *parts)
    return found


def verify_windows(windows: DataFrame, records: DataFrame, key: str, seq: str, pad: str = S.PAD) -> DataFrame:
    """Whether each window, or its reverse complement, occurs in the record it came from: `hit, rc_hit`.

    Padding is stripped on the right first. `key` names one record; windows without a record, or with a NULL key, give no
    row, and NULL windows are neither hit.
    """
    rows = windows.join(records.select(key).distinct(), key, "left_semi")
    bare, turned = F.rtrim(F.col("window"), F.lit(pad)), S.revcomp(F.col("text"))
    # Each different text once; what is turned is made again where it is wanted.
    texts = rows.select(F.col(key).alias("key"), bare.alias("text")).where("text is not null")
    texts = texts.groupBy("key", F.md5("text").alias("wid")).agg(F.first("text").alias("text"))
    both = texts.select("key", F.explode(F.array(F.struct("wid", "text"), F.struct(F.md5(turned).alias("wid"), turned.alias("text")))).alias("_q"))
    found = find_texts(both.select("key", "_q.*"), records, key, seq)
    rows = rows.withColumn("_w", F.md5(bare)).withColumn("_t", F.md5(S.revcomp(bare)))
    for wid, out in (("_w", "hit"), ("_t", "rc_hit")):
        own = found.select(F.col("key").alias(key), F.col("wid").alias(wid), F.lit(True).alias(out))
        rows = rows.join(own, [key, wid], "left").withColumn(out, F.when(F.col("window").isNotNull(), F.coalesce(out, F.lit(False))))
    return rows.drop("_w", "_t")
