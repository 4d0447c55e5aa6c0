"""Every query with a SQL twin gives the same rows on the smallest tables."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op")]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return round(float(x), 6) if type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    result = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in result.description]
    assert sorted(cols) == sorted(df.columns)
    want = collections.Counter(repr(tuple(plain(r[cols.index(c)]) for c in df.columns)) for r in result.fetchall())
    assert collections.Counter(repr(tuple(map(plain, r))) for r in df.collect()) == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
