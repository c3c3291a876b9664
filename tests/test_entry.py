"""Driver contract: entry smoke, and every catalogue query against its DuckDB oracle at sf0.001."""
import math
import re

import duckdb
import pytest

import __spark_entry__ as E
from given_tables import SF001

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [q for q in E.queries() if q != "pipeline" and not re.match(r"op\d+_", q)]     # the others have tests of their own


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["item_id", "domain", "reason"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(OWN) <= set(E.oracle_sql()) and set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    res = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(res.columns)
    order = sorted(df.columns)
    key = lambda t: tuple((x is None, str(x)) for x in t)
    srows = sorted((tuple(_norm(r[c]) for c in order) for r in df.collect()), key=key)
    idx = [res.columns.index(c) for c in order]
    orows = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=key)
    assert srows == orows
