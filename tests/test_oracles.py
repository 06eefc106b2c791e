"""Every query of the library against its oracle SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import pytest

from archivolt.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else repr(round(float(value), 6))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    found = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    rows = sorted(tuple(map(plain, r)) for r in found.select(*[f"`{c}`" for c in columns]).collect())
    if name not in registry.ORACLES:
        raise AssertionError(f"{name} has no oracle and needs a test of its own")
    wanted = duck.sql(registry.ORACLES[name])
    assert sorted(wanted.columns) == columns
    order = [wanted.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in wanted.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
