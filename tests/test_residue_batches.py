"""Residues coded and k-mers counted in Arrow batches, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cladeflow.functions import sequence as S
from cladeflow.operators import aggregate

ODD = [None, "", "acgtNxe*", "ACGTRYSWKMBDHVN", "é😀A", "zZ-", "A" * 300]


def test_codes_and_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, s string").repartition(2)
    rows = df.select("s", S.encode_seq(F.col("s")).alias("d"), S.encode_seq(F.col("s"), "protein").alias("p")).select(
        "*", S.codes_text(F.col("d")).alias("t"), S.decode_seq(F.col("d")).alias("back"), S.one_hot_seq(F.col("p"), 26).alias("hot")
    )
    for r in rows.collect():
        if r["s"] is None:
            assert r["d"] is r["p"] is r["t"] is r["back"] is r["hot"] is None
            continue
        upper = r["s"].upper()
        dna = [S.DNA_VOCAB.index(c if c in S.DNA_VOCAB else "N") for c in upper]
        protein = [S.AA_VOCAB.index(c if c in S.AA_VOCAB else "X") for c in upper]
        assert (r["d"], r["p"], r["t"]) == (dna, protein, ",".join(map(str, dna)))
        assert r["back"] == "".join(S.DNA_VOCAB[c] for c in dna)
        assert r["hot"] == [[int(i == c) for i in range(26)] for c in protein]


def test_unknown_codes_are_left_out(spark):
    df = spark.createDataFrame([([0, 99, None, 3],), (None,), ([],)], "c array<int>")
    got = [tuple(r) for r in df.select(S.decode_seq(F.col("c")), S.one_hot_seq(F.col("c"), 2)).collect()]
    assert got == [("AW", [[1, 0], [0, 0], [0, 0], [0, 0]]), (None, None), ("", [])]


@pytest.mark.parametrize("k,letters", [(1, "ACGT"), (4, "ACGTN"), (9, "ACGTN"), (31, "ACGTRYN")])
def test_kmers_equal_a_count(spark, k, letters):
    rng = random.Random(k)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3), "".join(rng.choices(letters, k=rng.choice([0, k - 1, k, 50, 900])))) for _ in range(40)]
    rows += [("a", 1, None), ("a", 1, "ACGT" * 40_000)]
    got = aggregate.kmer_counts(spark.createDataFrame(rows, "g string, h int, s string").repartition(3), ["g", "h"], "s", k)
    want = Counter((g, h, s[i : i + k]) for g, h, s in rows if s for i in range(len(s) - k + 1))
    assert {(r["g"], r["h"], r["kmer"]): r["n"] for r in got.collect()} == dict(want)


def test_counters_leave_the_task_not_residues(spark):
    df = spark.createDataFrame([("g", "ACGT" * 100_000)], "g string, s string")
    text = aggregate.tetramer_freq(df, ["g"], "s")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "regexp_extract_all" not in text
    assert aggregate.kmer_counts(df, [], "s").count() == 4


def test_what_a_function_needs_does_not_grow_with_the_batch(monkeypatch):
    import pyarrow as pa

    from cladeflow.functions import sequence as S

    sizes, held = [], []
    monkeypatch.setattr(S, "PIECE", 100)
    monkeypatch.setattr(S.F, "arrow_udf", lambda run, returns: held.append(run))

    def double(texts):
        sizes.append(sum(len(t or "") for t in texts.to_pylist()))
        return pa.array([None if t is None else t + t for t in texts.to_pylist()], pa.string())

    S._over_batches(double, "string", S._text_bytes())
    texts = ["A" * n for n in (0, 30, 60, 250, 10, 0, 99, 2)] + [None, "C" * 40]
    got = held[0](pa.array(["skipped", *texts]).slice(1)).to_pylist()
    assert got == [None if t is None else t + t for t in texts]
    assert len(sizes) > 3 and sorted(sizes)[-1] == 250 and sorted(sizes)[-2] <= 102
