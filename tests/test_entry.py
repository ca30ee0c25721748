"""The driver's contract."""

from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from arrayq import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (float, Decimal)):
        return repr(round(float(x), 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(plain, x)) + "]"
    return repr(x)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_queries_against_sql(spark, duck, name):
    want = duck.execute(own.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    expected = want.fetchall()
    got = own.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(plain, got.select(*columns).collect())) == sorted(map(plain, expected))
