"""Every registered query with SQL gives the same rows as DuckDB; the others give rows."""

import pytest

import __spark_entry__ as entry
from check import connect, rows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


HOT = ["seed_edges", "cross_unit_chain_1hop", "segment_intervals", "node_to_block_asof", "roc_auc", "fpr_at_tpr",
       "build_vocab", "quota_round_robin", "group_kfold", "simple_features", "boundary_flags"]


@pytest.mark.parametrize("name", HOT)
def test_same_rows_when_everything_is_hot(tight, con, name):
    df = QUERIES[name](tight, SF)
    rel = con.sql(ORACLE[name])
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
