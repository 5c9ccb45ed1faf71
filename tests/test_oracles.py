"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry
from rankforge.plans import ORACLE, QUERIES
from check_oracles import TABLES, compare
from tests.conftest import plan_of

ROWS_ONLY = {"chunk_bpe_window"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rel = duck.sql(ORACLE[name])
    assert compare(df.columns, [tuple(r) for r in df.collect()], rel.columns, rel.fetchall()) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
