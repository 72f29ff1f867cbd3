"""Every registered query against the same query in DuckDB, over the smallest tables."""

import compare
import pytest

import __spark_entry__
from workload import cleaning, ingest, metrics

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: q for module in (cleaning, ingest, metrics) for name, q in module.QUERIES.items()}
ORACLE = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF_DIR)


def test_every_query_has_its_check():
    assert set(QUERIES) <= set(ORACLE)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    assert compare.difference(QUERIES[name](spark, SF_DIR), connection, ORACLE[name]) is None
