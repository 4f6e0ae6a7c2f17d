"""Each named query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from residua.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
NAMES = sorted(ORACLES)

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    mine = sorted(([plain(v) for v in r] for r in frame.select(columns).collect()), key=repr)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(([plain(r[i]) for i in order] for r in cursor.fetchall()), key=repr)
    assert mine == theirs and mine


def test_every_query_is_listed():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 50


def test_scans_read_only_needed_columns(spark):
    plan = QUERIES["kmer_count"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
