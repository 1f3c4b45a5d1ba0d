"""Mixing sources to target weights by fractional repetition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from cladeflow.llm.common import WORD, number_rows, settle

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 9
#: Hexadecimal digits of a digest that make a fraction: 48 bits, exact in a double.
DIGITS = 12


def words(text: Column) -> Column:
    """Number of words; null counts as a text without words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only; a null key draws as the text `null`."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """`source, source_size, target` from rows `source, size`.

    Sources in code point order (null last) take the weights in turn. They share `share` times all sizes by weight; a
    target stops at `most` times its source's size and the excess goes to the others by weight, until none is above.
    With λ words per unit of weight a source is full when `most · size <= λ · weight`. Each round raises λ to what the
    full sources leave over, until no further source is full; a round is one aggregate over the table of sources.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = number_rows(totals, F.col("source").asc_nulls_last(), name="_rank")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    sources = settle(
        numbered.select("source", "source_size", F.get(cycle, (F.col("_rank") % len(weights)).cast("int")).cast("long").alias("_weight")), "sources"
    )
    cap = F.col("source_size") * float(most)
    budget = share * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        is_full = cap <= F.lit(level) * F.col("_weight")
        row = sources.agg(
            F.count(F.when(is_full, 1)).alias("n"),
            F.sum(F.when(is_full, F.col("source_size")).otherwise(0)).alias("taken"),
            F.sum(F.when(is_full, 0).otherwise(F.col("_weight"))).alias("weight"),
        ).first()
        if row["n"] == full:
            break
        full = row["n"]
        level = (budget - most * float(row["taken"] or 0)) / row["weight"] if row["weight"] else math.inf
    return sources.select("source", "source_size", F.when(cap <= F.lit(level) * F.col("_weight"), cap).otherwise(F.lit(level) * F.col("_weight")).alias("target"))


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
    share: float = SHARE, most: float = MOST, seed: int = SEED,
) -> DataFrame:
    """`row, size, source_size, target, copies`: how often each document enters the mix; `row` holds its columns.

    A source's rate is its target over its size. Each document comes floor(rate) times, and once more when a draw seeded
    by its id falls below the fraction. Null texts have size 0; sources without words have rate 0; rows that share an id
    share their draw; null ids share one. An empty table gives an empty plan.
    """
    sized = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    targets = source_targets(sized.select("source", "size"), weights, share, most).withColumnRenamed("source", "_source")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    whole = F.floor(rate)
    copies = whole + (draw(F.col(f"row.{id_col}"), seed) < rate - whole).cast("long")
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as `mix_plan` says, with the columns of the input."""
    plan = mix_plan(docs, **options).where("copies > 0")
    return plan.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")).select("row.*")
