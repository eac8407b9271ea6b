"""Corpus queries with SQL equal it."""

import duckdb
import pytest

from barwright.llm import queries

from ..test_entry import DATA, TABLES, plain


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.sql(queries.ORACLE[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted([tuple(plain(r[c]) for c in columns) for r in got.collect()], key=key) == sorted([tuple(map(plain, r)) for r in want], key=key)
