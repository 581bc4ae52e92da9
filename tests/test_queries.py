"""Every registered query of the engine against its SQL."""

import pytest

import __spark_entry__ as entry  # registers every query
from gridloom.plans.queries import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    if name in ORACLES:
        assert compare(spark, sf_dir, QUERIES[name], ORACLES[name]) is None
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["week", "n_titles", "n_new", "n_repeat", "fresh_pct"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
