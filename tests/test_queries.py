"""Every query that has SQL against the SQL engine, on the smallest data folder."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from voxmill.plans import queries as core


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        kind = type(v).__name__
        if "float" in kind:
            return round(float(v), 8)
        return int(v) if "int" in kind else bool(v) if kind == "bool_" else v

    return sorted((tuple(map(plain, r)) for r in pdf.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_against_sql(spark, data, db, name):
    a, b = core.QUERIES[name](spark, data).toPandas(), db.sql(core.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_rows_only(spark, data, name):
    assert core.QUERIES[name](spark, data).count() > 0
