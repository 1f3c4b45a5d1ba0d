"""What the physical plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

from catalog.common import table
from catalog.registry import QUERIES
from cladeflow.operators import windows

# Python runs where a user model, vector blocks or a table function ask for it, and in the two fitted models.
PYTHON = {"f08_encode", "f09_decode", "f12_one_hot", "f13_canonical_kmer", "f14_kmers", "f24_zero_fill", "a17_tetramer_freq", "x01_score_windows", "x08_classify_sequences", "x07_window_udtf", "w10_balanced_local", "j10_pairwise", "j10_mahalanobis"}
# These run jobs of their own while the query is built.
EAGER = ("g0", "g1", "s0", "s1", "t0", "x03", "x04", "x05", "o04", "c10", "a24", "a25", "x09", "p10", "j10", "a29")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = sorted(n for n in QUERIES if not n.startswith(EAGER))


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops_and_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON:
        assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text and "MapInArrow" not in text


def test_columns_and_filters_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["u03_drop_keys"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(l_returnflag)" in text and "l_comment" not in text
    assert "ReadSchema: struct<p_partkey:bigint>" in text
    counts = plan(QUERIES["c07_dataset_stats"](spark, sf_dir))
    assert "Generate" not in counts


def test_windows_need_no_shuffle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("seq"))
    assert "Exchange" not in plan(windows.window_sequences(docs, "seq", 1000, 500))
    lengths = docs.select("doc_id", F.length("seq").cast("long").alias("L"))
    assert "Exchange" not in plan(windows.split_windows(lengths, "doc_id", "L", 1000, 500))
    spans = plan(windows.window_spans(lengths, "L", 1000, 500))
    assert "Exchange" not in spans


def test_split_permutation_travels_without_residues(spark, sf_dir):
    text = plan(QUERIES["a18_hits_lca"](spark, sf_dir))
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_extendedprice:double>" in text
