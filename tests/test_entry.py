"""The driver contract: every query with an oracle equals it."""

import duckdb
import pytest

import __spark_entry__ as entry
from barwright.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    return None if value is None or value != value else round(value, 5) + 0.0 if isinstance(value, float) else float(value) if isinstance(value, int) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(catalog.ORACLE[name]).fetchall()
    names = [d[0] for d in duck.sql(catalog.ORACLE[name]).description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted([tuple(plain(r[c]) for c in columns) for r in got.collect()], key=key) == sorted([tuple(plain(r[k]) for k in at) for r in want], key=key)
