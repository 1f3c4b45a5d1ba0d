"""Streams that carry the state of a key from one micro-batch to the next, in Spark's state store.

Rows of a key are combined per micro-batch in Arrow batches, and only its sums travel on. The functions are self-contained,
so that workers need numpy and pandas only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T


def ended_means(stream: DataFrame, key: str, order: str, vec: str, slack: int = 0) -> DataFrame:
    """Mean vector of every key, once, when the key has ended: `key, vec, n_chunks`.

    `order` is a whole number from 0 that never falls by more than `slack` along the stream, and is the same for all rows of a key.
    It is the event time of the stream: when a later key is seen, the watermark passes the keys before it, their means come
    out and their sums leave the store. The last key waits until something later comes; a row with a NULL key (`end_mark`)
    closes a stream and has no mean. For `append` mode. Rows that come after their key has ended are dropped, as late rows.
    """
    timed = stream.select(F.col(key).alias("key"), F.timestamp_millis(F.col(order).cast("bigint") + 1).alias("_at"), F.col(vec).cast("array<double>").alias("v"))
    key_type = timed.schema["key"]
    state = T.StructType([T.StructField("total", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
    output = T.StructType([T.StructField(key, key_type.dataType), T.StructField(vec, T.ArrayType(T.DoubleType())), T.StructField("n_chunks", T.LongType())])
    names = [key, vec, "n_chunks"]

    def update(group, frames: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        if store.hasTimedOut:
            total, n = store.get
            store.remove()
            if group[0] is not None:
                yield pd.DataFrame({names[0]: [group[0]], names[1]: [(np.array(total) / n).tolist()], names[2]: [n]})
            return
        total, n = store.get if store.exists else (None, 0)
        total, last = None if total is None else np.array(total), None
        for frame in frames:
            vectors = [x for x in frame["v"] if x is not None]
            if vectors:
                part = np.stack(vectors).sum(axis=0)
                total = part if total is None else total + part
            n += len(frame)
            last = frame["_at"].max() if last is None else max(last, frame["_at"].max())
        store.update(([] if total is None else total.tolist(), n))
        # The watermark must go beyond the time of the key, not just reach it.
        store.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + 1, store.getCurrentWatermarkMs() + 1))

    keyed = timed.withWatermark("_at", f"{slack} milliseconds").groupBy("key")
    return keyed.applyInPandasWithState(update, output, state, "append", "EventTimeTimeout")


def end_mark(rows: DataFrame, order: str, slack: int = 0) -> DataFrame:
    """One row of the columns of `rows` that closes a stream: NULL but for an order beyond all of them."""
    after = rows.agg((F.max(order) + slack + 2).cast(rows.schema[order].dataType).alias(order))
    return after.select(*[F.col(c) if c == order else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])


#: Groups of keys whose summaries are kept together.
BUCKETS = 1024


def carried_lca(
    stream: DataFrame, tax: DataFrame, key: str, subject: str, score: str, ranks: Sequence[str], frac: float = 0.9, buckets: int = BUCKETS
) -> DataFrame:
    """ORF taxa kept up to date: `key, n_hits, score` and the ranks, for each ORF that a micro-batch has changed.

    What is kept of an ORF are its distinct scores within `frac` of its best one, each with its number of hits, those with a
    lineage, and the first and last name per rank with the number of names. Such summaries add up, a better hit drops those it
    leaves behind, and the taxon follows from them: hits themselves are not kept. For `update` mode; scores are whole numbers.

    Most ORFs have a few hits, so ORFs are dealt to `buckets` by a hash: the summaries of a bucket are one value in the state
    store, packed, with each name once, and a micro-batch is added to them column by column. ORFs without a key have a bucket
    of their own.
    """
    ranks = list(ranks)
    known = tax.select(F.col(subject).alias("_subject"), *ranks, F.lit(True).alias("_known"))
    number = F.col(score).cast("bigint")
    named = stream.join(known, F.col(subject) == F.col("_subject"), "left").select(
        F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(F.col(key)), F.lit(buckets))).cast("int").alias("bucket"),
        F.col(key).alias("key"),
        F.coalesce(number, F.lit(0)).alias("score"),
        number.isNotNull().cast("bigint").alias("rows"),
        F.coalesce("_known", F.lit(False)).cast("bigint").alias("known"),
        *[F.col(r).alias(f"name{i}") for i, r in enumerate(ranks)],
    )
    state = T.StructType([T.StructField("steps", T.BinaryType())])
    output = T.StructType(
        [T.StructField(key, named.schema["key"].dataType), T.StructField("n_hits", T.LongType()), T.StructField(score, T.DoubleType())]
        + [T.StructField(r, T.StringType()) for r in ranks]
    )
    places = range(len(ranks))

    def steps_of(frame):
        """Hits as summaries of one hit each."""
        frame = frame[frame["rows"] > 0]
        steps = frame[["key", "score", "rows", "known"]].copy()
        for i in places:
            names = frame[f"name{i}"]
            steps[f"low{i}"], steps[f"high{i}"], steps[f"named{i}"] = names, names, names.notna().astype("int64")
        return steps

    def added(parts):
        """Summaries of the same score of a key in one, and of those the ones near the best."""
        import numpy as np
        import pandas as pd

        steps = pd.concat(parts, ignore_index=True)
        lists, rules = {}, {"rows": "sum", "known": "sum"}
        for i in places:
            # Names are numbered in order, none being beyond all of them.
            codes, values = pd.factorize(pd.concat([steps[f"low{i}"], steps[f"high{i}"]], ignore_index=True).astype(object), sort=True)
            lists[i] = np.append(values.to_numpy() if hasattr(values, "to_numpy") else values, None)
            low, high = codes[: len(steps)], codes[len(steps) :]
            steps[f"low{i}"], steps[f"high{i}"] = np.where(low < 0, len(values), low), high
            rules |= {f"low{i}": "min", f"high{i}": "max", f"named{i}": "sum"}
        steps = steps.groupby(["key", "score"], as_index=False, sort=False).agg(rules)
        steps = steps[steps["score"] >= frac * steps.groupby("key", sort=False)["score"].transform("max")].reset_index(drop=True)
        for i in places:
            for name in (f"low{i}", f"high{i}"):
                steps[name] = lists[i][steps[name].to_numpy()]
        return steps

    def taxa_of(steps):
        import numpy as np

        numbered = steps[["key", "rows", "known", *[f"named{i}" for i in places]]].assign(total=steps["score"] * steps["rows"])
        bounds, rules = {}, {c: "sum" for c in numbered.columns if c != "key"}
        for i in places:
            # A step without names has none of either; its key then has too few names, or none at all.
            bounds[f"same{i}"] = steps[f"low{i}"].eq(steps[f"high{i}"]) | steps[f"low{i}"].isna()
            first = steps[f"low{i}"].groupby(steps["key"], sort=False).transform("first")
            bounds[f"same{i}"] &= steps[f"low{i}"].isna() | steps[f"low{i}"].eq(first)
            rules |= {f"same{i}": "all", f"low{i}": "first"}
        whole = numbered.assign(**bounds, **{f"low{i}": steps[f"low{i}"] for i in places}).groupby("key", as_index=False, sort=False).agg(rules)
        out = {key: whole["key"], "n_hits": whole["rows"], score: whole["total"] / whole["rows"]}
        for i, r in enumerate(ranks):
            agreed = whole[f"same{i}"] & whole[f"low{i}"].notna() & (whole[f"named{i}"] == whole["known"])
            out[r] = np.where(agreed, whole[f"low{i}"].astype(object), None)
        return out

    def packed(steps) -> bytes:
        import pyarrow as pa

        table = pa.Table.from_pandas(steps, preserve_index=False)
        for i in places:
            for name in (f"low{i}", f"high{i}"):
                names = table.column(name).cast(pa.string()).combine_chunks().dictionary_encode()
                table = table.set_column(table.schema.get_field_index(name), name, names)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        return sink.getvalue().to_pybytes()

    def unpacked(kept: bytes):
        import pyarrow as pa

        table = pa.ipc.open_stream(kept).read_all()
        for i, field in enumerate(table.schema):
            if pa.types.is_dictionary(field.type):
                table = table.set_column(i, field.name, table.column(i).cast(field.type.value_type))
        return table.to_pandas()

    def update(group, frames: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        import pandas as pd

        unnamed, waiting, n, touched = group[0] == -1, [], 0, []
        if store.exists:
            waiting.append(unpacked(bytes(store.get[0])))
        for frame in frames:
            if unnamed:
                frame = frame.assign(key=0)
            touched.append(frame["key"].drop_duplicates())
            waiting.append(steps_of(frame))
            n += len(waiting[-1])
            if n > max(100_000, len(waiting[0])):
                waiting, n = [added(waiting)], 0
        waiting = [x for x in waiting if len(x)]
        if not waiting:
            return
        steps = added(waiting)
        store.update((packed(steps),))
        changed = steps[steps["key"].isin(pd.concat(touched))].reset_index(drop=True)
        if len(changed):
            out = pd.DataFrame(taxa_of(changed))
            yield out.assign(**{key: None}) if unnamed else out

    return named.groupBy("bucket").applyInPandasWithState(update, output, state, "update", "NoTimeout")
