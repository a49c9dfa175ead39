"""Every reference query with oracle SQL against DuckDB on the smallest tables."""

import collections

import duckdb
import pytest

from orelink.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, db, name):
    df = catalogue.queries()[name](spark, DATA)
    names = sorted(df.columns)
    norm = lambda v: tuple(v) if isinstance(v, list) else v
    got = collections.Counter(tuple(map(norm, r)) for r in df.select(*names).collect())
    found = db.execute(catalogue.oracle_sql()[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    want = collections.Counter(tuple(norm(r[order.index(n)]) for n in names) for r in found.fetchall())
    assert got == want
