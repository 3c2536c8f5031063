"""Every registered query against its SQL, over the whole tables."""

import pytest

from __spark_entry__ import entry
from tablevet.registry.details import detail_oracles, detail_queries
from tablevet.registry.growing import growing_oracles, growing_queries
from tablevet.registry.oracles import all_oracles
from tablevet.registry.queries import all_queries
from tablevet.registry.variants import variant_oracles, variant_queries
from tests.oracle import connect, spark_result, sql_result

QUERIES = all_queries() | variant_queries() | growing_queries() | detail_queries()
ORACLES = all_oracles() | variant_oracles() | growing_oracles() | detail_oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, con):
    names, rows = spark_result(QUERIES[name](spark, sf_dir))
    sql_names, sql_rows = sql_result(con, ORACLES[name])
    assert names == sql_names
    assert rows == sql_rows
    assert rows


def test_entry(spark):
    assert entry(spark).count() == 9
