"""Every registered query against its DuckDB oracle (sf0.001), and a
rows-only run for the queries without SQL."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck

from conftest import SF_SMALL

NAMES = sorted(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, E.queries()[name], E.oracle_sql().get(name), SF_SMALL, con)
    assert r["status"] in ("match", "rows-only"), r
    assert r["rows"] >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["user_id", "digest_date", "part", "category_no", "category", "rank", "label", "title"]
    assert df.count() > 0
