"""Every query of the library against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from marquee.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(frame, columns):
    def cell(v):
        if not isinstance(v, (list, tuple)) and pd.isna(v):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        try:
            return f"{float(v):.6f}"
        except (TypeError, ValueError):
            return str(v)

    return sorted((tuple(map(cell, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    want, got = duck.execute(ORACLES[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert _rows(got, columns) == _rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
