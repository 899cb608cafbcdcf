"""Every binding against its DuckDB SQL (same comparison as tools/oracle_check.py)."""

from collections import Counter

import pytest

import __spark_entry__ as E
from tools.oracle_check import duck, rows_of

from .conftest import SF_SMALL

QUERIES = E.queries()
SQLS = E.oracle_sql()  # tests/llm holds the training-data queries without SQL against brute force


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle():
    from benchlens.bindings import load_all
    queries, sqls = load_all()
    assert set(queries) == set(sqls)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_matches_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    sql = SQLS[name].replace("/root/testdata/sf0.01/", SF_SMALL + "/")
    cur = con.execute(sql)
    dc = [d[0] for d in cur.description]
    drows = cur.fetchall()
    srows = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(dc)
    assert Counter(rows_of(df.columns, srows)) == Counter(rows_of(dc, drows))


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert set(df.columns) == {"event_type", "write_bw_median_mbs", "write_bw_min_mbs",
                               "read_bw_median_mbs", "read_bw_min_mbs"}
