"""Every query against the SQL that states it, on an independent engine."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest

from skylattice.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 2) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_sql(spark, duck, sf, name):
    ours = catalogue.QUERIES[name](spark, sf)
    columns = sorted(ours.columns)
    theirs = duck.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({catalogue.ORACLES[name]})").fetchall()
    left = sorted(repr([plain(r[c]) for c in columns]) for r in ours.collect())
    assert left == sorted(repr([plain(float(v) if type(v).__name__ == "Decimal" else v) for v in r]) for r in theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_give_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
