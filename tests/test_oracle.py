"""Every registered query against its DuckDB twin on the small tables."""

import pytest

import __spark_entry__ as entry
from compare_util import compare, duck
from conftest import SMALL_SF
from vouch.queries import all_oracle_sql, all_queries

QUERIES = all_queries()
ORACLE = all_oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL_SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL_SF)
    res = compare(df, con, ORACLE[name])
    assert res["match"], res


def test_every_query_has_a_twin_and_is_registered():
    assert set(QUERIES) == set(ORACLE) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["suite", "test_id", "seq", "status", "points"]
