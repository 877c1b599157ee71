"""Every registered query against its SQL twin on the smallest data folder."""
import os

import duckdb
import pytest

import __spark_entry__ as driver
from palisade.plans.catalog import QUERIES
from palisade.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no data folder")

# DuckDB type of each Spark result type.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.keys() <= driver.queries().keys()
    assert ORACLES.keys() <= driver.oracle_sql().keys()


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    twin = con.execute(ORACLES[name])
    types = {c[0]: str(c[1]) for c in twin.description}
    order = [c[0] for c in twin.description]
    df = QUERIES[name](spark, SF)
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    got = [tuple(r[c] for c in order) for r in df.collect()]
    assert _sorted(got) == _sorted(twin.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
