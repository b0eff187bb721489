"""The driver's contract: every query runs at the smallest size, and equals its SQL where there is one."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__
from weftgraph.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name in ORACLES:
        want = con.execute(ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)


def test_contract():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert oracles.keys() <= queries.keys() and QUERIES.keys() <= queries.keys()
