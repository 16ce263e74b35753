"""Every registered query of the engine against its oracle on the smallest tables."""

import glob
import os

import pytest

from quarrylane.plans import registry

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 8) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted("|".join(map(plain, r)) for r in found.select(*[f"`{c}`" for c in columns]).collect())
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == sorted("|".join(plain(r[i]) for i in order) for r in result.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
