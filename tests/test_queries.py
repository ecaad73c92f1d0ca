"""Every query with SQL against DuckDB over the smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__
from tamis.plans import contact_queries, policy_queries, record_queries, stream_queries

PLANS = (record_queries, policy_queries, contact_queries, stream_queries)
QUERIES, ORACLES = ({k: v for p in PLANS for k, v in getattr(p, name).items()} for name in ("QUERIES", "ORACLES"))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    told = duck.execute(ORACLES[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(columns, told.fetchall())


def test_entry(spark):
    if os.path.isdir(SF):
        assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
