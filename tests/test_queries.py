"""Every registered query of the engine against DuckDB on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from ledgerlake.queries import QUERIES, SQL, entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    plain = lambda v: float(v) if isinstance(v, Decimal) else v
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted((tuple(clean(plain(r[i])) for i in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF), duck.sql(SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours.columns, ours.collect()) == rows(theirs.columns, theirs.fetchall())


def test_entry(spark):
    assert entry(spark, SF).columns == ["o_orderkey", "o_totalprice"]
