import duckdb
import pytest
from pathlib import Path

import __spark_entry__ as registry
from compare import difference
from scanloom.catalog.oracle import ORACLE
from scanloom.catalog.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(registry.queries()) and set(ORACLE) <= set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    ours = registry.queries()[name](spark, SF_DIR).toPandas()
    assert difference(ours, duck.execute(registry.oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert registry.entry(spark).columns == ["depth", "x", "r", "g", "b"]
