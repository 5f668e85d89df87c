"""Every registered query that has SQL, against DuckDB on the smallest tables; those of other operators are tested beside them."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

from fringework.plans import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    return v.replace(tzinfo=None).isoformat() if isinstance(v, dt.datetime) else repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = own.queries()[name](spark, SF)
    found = duck.execute(own.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(df.columns)
    want = sorted(tuple(plain(x[columns.index(c)]) for c in order) for x in found.fetchall())
    assert sorted(tuple(plain(x[c]) for c in order) for x in df.collect()) == want
