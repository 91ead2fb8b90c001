"""Every query with SQL gives exactly the SQL's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as registry
import check
from conftest import SMALL


@pytest.fixture(scope="module")
def connection():
    db = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        table = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    yield db
    db.close()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    status, _, _, detail = check.compare(spark, connection, name, SMALL)
    assert status == "ok", detail


def test_registry_is_consistent(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    flagship = registry.entry(spark)
    assert flagship.count() == 14
