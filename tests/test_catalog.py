"""Registered queries against DuckDB on the small tables."""

from __future__ import annotations

import os

import pytest

from tallystone.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def rows(pdf):
    cols = sorted(pdf.columns)
    return sorted(map(tuple, pdf[cols].map(lambda v: round(float(v), 6) if isinstance(v, float) else v).astype(str).values.tolist()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_module_runs_without_the_optional_part(spark):
    import __spark_entry__ as entry

    assert "sast_summary" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
