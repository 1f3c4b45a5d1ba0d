"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from catalog.registry import ORACLES, QUERIES
from compare import connect, same



@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        ok, message = same(df, connect(sf_dir), ORACLES[name])
        assert ok, message
    else:
        assert df.count() > 0


def test_entry(spark, sf_dir):
    assert {r["level"] for r in entry.entry(spark).collect()} == {"family", "genus", "species"}


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
