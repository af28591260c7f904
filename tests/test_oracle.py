"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import math
import os

import pytest

from weftgraph import queries, queries_more  # noqa: F401  it registers its queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = db.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr) == got
