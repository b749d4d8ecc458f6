"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import connect, difference

import __spark_entry__ as driver
from broadsheet.suite import queries, sql

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(sql.oracle_sql())
    assert set(queries.queries()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_agrees_with_sql(spark, db, name):
    assert difference(spark, db, SMALL, name) == ""


def test_entry(spark):
    assert 0 < driver.entry(spark).count() <= 100


def test_the_default_bench_covers_the_long_queries():
    import bench

    assert {"saved_query_stats", "match_diacritics", "corpus_load"} <= set(bench.HEADLINE)
